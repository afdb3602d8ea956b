"""N-gram join, fingerprints and repeated passages against brute force."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from marlstone.llm import ngram_join, queries, suffix_dedup
from marlstone.llm.fingerprints import minhash_classes
from tests.llm.test_text import words_of

SCHEMA = "doc_id long, text string"
ODD = "doc_id long, text string, sig string, size string, leader int, key double, __spans int, n_chars long, `part` string"


def corpus(seed=5, groups=12):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(150)]
    rows, n = [], 0
    for g in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([4, 20, 60, 200]))]
        for _ in range(rnd.randrange(1, 7)):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            rows.append((n * 7 % 1009, " ".join(t)))
            n += 1
    return rows + [(2000, None), (2001, ""), (2002, "  \n"), (None, rows[0][1]), (2003, "One two"), (2004, "one TWO"), (2005, "one"), rows[3], rows[3]]


def gram_sets(rows, n=3):
    """Documents as (doc_id, n-gram set), with the texts they have."""
    out = defaultdict(set)
    for i, t in rows:
        w = words_of(t and t.lower())
        if i is not None and w:
            out[i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))].add(t)
    return out


def brute_classes(rows, t, n=3):
    """(doc_id, class_id, links) and the (doc_id, set) of every document with a link."""
    docs = sorted(gram_sets(rows, n), key=lambda d: (d[0], sorted(d[1])))
    links, parent = Counter(), {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(docs, 2):
        if len(a[1] & b[1]) / len(a[1] | b[1]) >= t:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)), key=lambda d: (d[0], sorted(d[1])))
            parent[y] = x
    return [(d[0], find(d)[0], k) for d, k in links.items()], {d: find(d) for d in docs}


@pytest.mark.parametrize("t", [0.4, 0.6, 0.9])
def test_join_is_exact(spark, t):
    rows = corpus()
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), threshold=t).collect()
    assert sorted(map(tuple, got)) == sorted(brute_classes(rows, t)[0])


def test_a_repeated_id_with_two_texts_is_two_documents(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "p q r s t u v w"), (3, "p q r s t u v w"), (4, "unlike all the others here")]
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1), (2, 1, 1), (2, 2, 1), (3, 2, 1)]
    kept = ngram_join.one_per_group(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, kept)) == [rows[0], rows[2], rows[4]]


def test_large_groups_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(25):
        t = list(base)
        t[rnd.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(t)))
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), threshold=0.6).collect()
    assert sorted(map(tuple, got)) == [(i, 0, 24) for i in range(25)]


@pytest.mark.parametrize("grams", [40, 2_000_000])
def test_copies_in_and_across_chunks(spark, monkeypatch, grams):
    """A third of all rows are one text, others are copies of it but for a word."""
    import pyarrow as pa

    rnd = random.Random(8)
    base = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(base)) for i in range(0, 90, 3)] + [(i, " ".join(base[:20] + [f"x{i}"] + base[21:])) for i in range(1, 30, 3)] + [(i, " ".join(f"u{rnd.random()}" for _ in range(20))) for i in range(2, 90, 3)]
    monkeypatch.setattr(ngram_join, "CHUNK_GRAMS", grams)
    monkeypatch.setattr(ngram_join.tx, "SLICE_BYTES", 300)
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part]), pa.array([hash(r[1]) for r in part])], names=["doc_id", "text", "row"]) for part in (rows[:25], rows[25:])]

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr("pyspark.TaskContext", Task)
    sent = list(ngram_join._census(lambda c: ngram_join.gram_sets(c, 3), 5)(iter(batches)))
    back = [x for k in range(5) for x in ngram_join._count(b.filter(pa.array([r["part"] % 5 == k for r in b.to_pylist()])) for b in sent)]
    got = [r for b in ngram_join._prefixes(0.6)(iter(back)) for r in b.to_pylist()]
    assert {r["doc_id"] for r in got} == {d for d, _, _ in brute_classes(rows, 0.6)[0]}
    assert all(r["size"] == 28 and r["prefix"] in (0, 28 - 17 + 1 - (28 - len(r["grams"]))) for r in got)
    assert len({tuple(r["grams"]) for r in got if r["prefix"] and r["doc_id"] % 3 == 0}) == 1


def test_one_per_group_keeps_the_smallest_of_each_component(spark):
    rows = corpus(9)
    sets, roots = gram_sets(rows), brute_classes(rows, 0.6)[1]
    kept = ngram_join.one_per_group(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", sig int, root string"), threshold=0.6)
    assert kept.columns == ["doc_id", "text", "sig", "root"]
    stay = {(d[0], t) for d, r in roots.items() if d == r for t in sets[d]}
    want = sorted({r for r in rows if r[0] is None or r in stay or not words_of(r[1])}, key=repr)
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.sig: r.root for r in ngram_join.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


@pytest.mark.parametrize("t", [0.7, 0.5])
def test_fingerprints_find_what_is_alike(spark, tmp_path, t):
    rows = corpus(11, 40)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    want = {d: k for d, _, k in brute_classes(rows, t)[0]}
    found = minhash_classes(spark.createDataFrame(rows, SCHEMA)) if t == 0.7 else queries.op4_document_fingerprints(spark, str(tmp_path))
    got = {r.doc_id: r.links for r in found.collect()}
    assert all(v <= want[k] for k, v in got.items())
    assert sum(got.values()) >= 0.9 * sum(want.values()) and len(got) >= 0.9 * len(want)


def brute_spans(rows, depth):
    where = defaultdict(set)
    for i, t in rows:
        w = words_of(t)
        if i is not None:
            for p in range(len(w) - depth + 1):
                where[tuple(w[p : p + depth])].add((i, p))
    marks = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for k, (i, p) in enumerate(sorted(places)):
                marks[i, k == 0].add(p)
    out = set()
    for (i, first), ps in marks.items():
        run = []
        for p in sorted(ps):
            if run and p > run[-1] + depth:
                out.add((i, run[0], run[-1] + depth, first))
                run = []
            run.append(p)
        out.add((i, run[0], run[-1] + depth, first))
    return out


def passages(seed=2):
    rnd = random.Random(seed)
    fresh = iter(range(100000))
    shared = [[f"p{k}_{i}" for i in range(rnd.randrange(8, 30))] for k in range(4)]
    rows = []
    for i in range(25):
        t = []
        for _ in range(rnd.randrange(1, 5)):
            t += [f"u{next(fresh)}" for _ in range(rnd.randrange(0, 12))]
            if rnd.random() < 0.6:
                t += rnd.choice(shared)
        rows.append((i * 3 % 26, rnd.choice([" ", "\n", "  "]).join(t)))
    return rows + [rows[2], (40, None), (41, ""), (None, rows[1][1]), (42, "same " * 30), (43, " " + rows[5][1] + " \n")]


@pytest.mark.parametrize("depth", [8, 7])
def test_spans_are_the_repeated_windows(spark, depth):
    rows = passages()
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, SCHEMA), depth).collect()
    assert sorted(map(tuple, got)) == sorted(brute_spans(rows, depth))


@pytest.mark.parametrize("chunk", [16, 90, 1 << 20])
def test_chunks_may_cut_documents(monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rows = passages(4)
    run = suffix_dedup._suffixes(8, 3)
    import pyarrow as pa

    keep = [(i, t or "", 0) for i, t in rows if i is not None]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in keep], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["doc_id", "text", "crc"])
    sent = list(run(iter([batch])))
    places = sum(len(r["head"] or b"") // 3 for b in sent for r in b.to_pylist())
    found = list(suffix_dedup._groups(3)(iter(sent)))
    ids = [[r["part"] for r in b.to_pylist()] for b in found]
    spans = [tuple(r.values()) for k in range(3) for b in suffix_dedup._spans(8)(b.filter(pa.array([p == k for p in i])) for b, i in zip(found, ids)) for r in b.to_pylist()]
    assert sorted((s[0], s[2], s[3], s[4]) for s in spans) == sorted(brute_spans([(i, t) for i, t, _ in keep], 8))
    if chunk > 90:  # one entry for each window of the chunk
        assert places == len({tuple(words_of(t)[p : p + 8]) for _, t, _ in keep for p in range(len(words_of(t)) - 7)})


def test_a_passage_of_half_of_all_documents(spark):
    rnd = random.Random(3)
    hot = " ".join(f"h{i}" for i in range(12))
    rows = [(i, f"a{i} b{i} {hot} c{i}" if i % 2 else " ".join(f"u{rnd.random()}" for _ in range(15))) for i in range(200)]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, SCHEMA).repartition(5), 8).collect()
    assert sorted(map(tuple, got)) == sorted((i, 2, 14, i == 1) for i in range(1, 200, 2))


def test_cutting_leaves_one_of_each_passage(spark):
    rows = passages(6)
    docs = spark.createDataFrame([(i, t, "a", "b", 1, 1.0, 2, -1, "p") for i, t in rows], ODD)
    got = suffix_dedup.without_repeats(docs, 8)
    assert got.columns == docs.columns
    cut = defaultdict(set)
    for i, a, b, first in brute_spans(rows, 8):
        if not first:
            cut[i] |= set(range(a, b))
    want = []
    for i, t in rows:
        w = words_of(t)
        left = [x for k, x in enumerate(w) if i is None or k not in cut[i]]
        if left or not w:
            want.append((i, None if t is None else " ".join(left)))
    assert sorted([(r.doc_id, None if r.text is None else " ".join(words_of(r.text))) for r in got.collect()], key=repr) == sorted(want, key=repr)
    assert all(r.n_chars in (-1, len(r.text or "")) for r in got.collect())


@pytest.mark.parametrize("make", [ngram_join.ngram_jaccard_join, minhash_classes, suffix_dedup.repeated_spans, suffix_dedup.without_repeats, ngram_join.one_per_group])
def test_empty_tables_and_clashing_columns(spark, make):
    assert make(spark.createDataFrame([], ODD)).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e", None, "s", 1, None, 0, 9, None), (None, None, None, None, None, None, None, None, None), (2, "x" * 300000, "", "", 0, 0.0, 0, 0, "")], ODD)
    assert make(odd).count() in (0, 3)

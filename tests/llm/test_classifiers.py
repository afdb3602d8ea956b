"""Quality classifier, quality rules and toxicity: held-out accuracy, brute force, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import quality_classifier as qc
from marlstone.llm import quality_rules as qr
from marlstone.llm import toxicity as tx
from marlstone.llm.labelled import labelled_sample

DOCS = "doc_id long, text string, score double, term int, y string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=3):
    """Good prose, junk of repeated words and marks, and toxic prose with words of its own; labels of half."""
    rnd = random.Random(seed)
    prose = [f"word{i}" for i in range(300)]
    bad = [f"vile{'abcdefgh'[i]}" for i in range(8)]
    docs, labels = [], []
    for i in range(n):
        kind = rnd.choice(["good", "good", "junk", "toxic"])
        words = [rnd.choice(prose) for _ in range(rnd.randrange(20, 120))]
        if kind == "junk":
            words = [w for w in words[:30] for _ in range(rnd.randrange(2, 5))] + ["###", "$$$"] * 10
        if kind == "toxic":
            for _ in range(max(4, len(words) // 8)):
                words[rnd.randrange(len(words))] = rnd.choice(bad)
        docs.append((i, " ".join(words), None, 1, "x"))
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
        else:
            labels.append((i, None, None))
        docs[-1] = (*docs[-1], kind)
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame([d[:5] for d in docs], DOCS).cache(), spark.createDataFrame(labels, LABELS).cache(), {d[0]: d[5] for d in docs}


ODD = [(9000, None, 0.0, 0, ""), (9001, "", 0.0, 0, ""), (None, "word1 word2 word3", 0.0, 0, ""), (9002, "word5 " * 200_000, 0.0, 0, ""), (1, "again", 0.0, 0, "")]


def test_classifier_keeps_good_held_out_documents(tables):
    docs, labels, kinds = tables
    kept = {r.doc_id for r in qc.keep_good(docs, labels).collect()}
    held = [i for i in kinds if i % 2 == 0]
    assert np.mean([(i in kept) == (kinds[i] != "junk") for i in held]) > 0.95
    assert qc.keep_good(docs, labels).columns == docs.columns
    assert {r.doc_id for r in qc.quality_scores(docs, labels).collect()} == kept


def test_rules_keep_good_held_out_documents(tables):
    docs, labels, kinds = tables
    kept = {r.doc_id for r in qr.quality_rules(docs, labels).collect()}
    assert np.mean([(i in kept) == (kinds[i] != "junk") for i in kinds if i % 2 == 0]) > 0.95


def test_toxic_documents_are_found_with_evidence(tables):
    docs, labels, kinds = tables
    found = {r.doc_id: r for r in tx.toxic_documents(docs, labels).collect()}
    held = [i for i in kinds if i % 2 == 0]
    assert np.mean([(i in found) == (kinds[i] == "toxic") for i in held]) > 0.95
    assert all(0.5 <= r.score <= 1 and r.evidence for r in found.values())


def test_copy_of_a_rare_toxic_example_is_found(spark):
    vile = [f"grue{a} snark{a} blight mordant" for a in "abcd"]
    rows = [(i, t) for i, t in enumerate(vile)] + [(i, f"calm{i} prose{i % 7} about gardens") for i in range(10, 50)]
    docs = spark.createDataFrame([(*r, None, 1, "x") for r in [*rows, (100, vile[2]), (101, "calm11 gardens"), (102, None)]], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i < 4)) for i, _ in rows], LABELS)
    found = {r.doc_id: r for r in tx.toxic_documents(docs, labels).collect()}
    assert set(found) == {0, 1, 2, 3, 100} and found[100].evidence[0] == "2:1.0000:1"


@pytest.mark.parametrize("make", [qc.quality_scores, qc.keep_good, qr.quality_rules, tx.toxic_documents])
def test_odd_rows_and_empty_tables(spark, tables, make):
    docs, labels, _ = tables
    both = docs.unionByName(spark.createDataFrame(ODD, DOCS))
    ids = [r.doc_id for r in make(both, labels).collect()]
    assert 9000 not in ids and 9001 not in ids or make is tx.toxic_documents
    assert make(docs.where("false"), labels).count() == 0
    none = make(both, labels.where("false"))
    assert none.count() == (0 if make is tx.toxic_documents else docs.count() + 3)
    one = make(both, labels.where("quality = 1 and toxic = 0"))
    assert one.count() >= 0


def test_sample_is_bounded_and_leaves_out_contradictions(spark, tables):
    docs, labels, _ = tables
    twice = labels.unionByName(spark.createDataFrame([(1, 0, 1), (1, 1, 0), (3, 7, 7)], LABELS))
    own = labelled_sample(docs, twice, "quality", 50).collect()
    assert len(own) <= 50 and 1 not in {r.doc_id for r in own} and len({r.doc_id for r in own}) == len(own)


def test_ftrl_is_the_plain_recursion():
    rng = np.random.default_rng(1)
    examples = [(np.array([0, 2, 4]), np.array([1.0, 0.5, 1.0]), int(rng.random() < 0.5)) for _ in range(30)]
    z, n = np.zeros(5), np.zeros(5)
    weight = lambda j: 0.0 if abs(z[j]) <= qc.L1 else -(z[j] - np.sign(z[j]) * qc.L1) / ((qc.BETA + np.sqrt(n[j])) / qc.ALPHA + qc.L2)
    for i, x, y in examples:
        w = [weight(j) for j in i]
        p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x))))
        for j, a, b in zip(i, x, w):
            g = (p - y) * a
            z[j] += g - (np.sqrt(n[j] + g * g) - np.sqrt(n[j])) / qc.ALPHA * b
            n[j] += g * g
    assert qc.ftrl(examples, 2, 1) == pytest.approx([weight(j) for j in range(5)], abs=1e-6)


def test_forest_is_monotone_and_flattened():
    rng = np.random.default_rng(2)
    x = rng.random((800, 3))
    y = ((x[:, 0] + 0.3 * rng.random(800) - 0.5 * x[:, 1]) > 0.4).astype(float)
    forest = qr.boost(x, y, {1: -1, 0: 1})
    assert np.mean((forest.score(x) > 0.5) == y) > 0.9
    grid = np.repeat(rng.random((40, 3)), 30, axis=0)
    grid[:, 1] = np.tile(np.linspace(0, 1, 30), 40)
    assert (np.diff(forest.score(grid).reshape(40, 30), axis=1) <= 1e-12).all()
    grid[:, 0], grid[:, 1] = grid[:, 1].copy(), 0.3
    assert (np.diff(forest.score(grid).reshape(40, 30), axis=1) >= -1e-12).all()

    def walk(row):
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    assert forest.score(x[:50]) == pytest.approx([walk(r) for r in x[:50]])


def test_statistics_of_one_text_do_not_depend_on_its_neighbours():
    texts = ["One two two, three!\nfour\nfour", "", None, "é " * 50, "x", "\n\n"]
    whole, words = qr.column_statistics(pa.array(texts))
    assert words.tolist() == [True, False, False, True, True, False]
    for k, t in enumerate(texts):
        assert qr.column_statistics(pa.array([t], pa.string()))[0][0] == pytest.approx(whole[k])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_is_exact(seed):
    rng = np.random.default_rng(seed)
    dense = np.where(rng.random((150, 40)) < 0.15, rng.random((150, 40)), 0)
    dense[:, 0] += 0.01
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    row, term = np.nonzero(dense)
    index = tx.build(row, term, dense[row, term], np.arange(150) * 3, np.zeros(150), 40, dense=8, block=16)
    q = np.where(rng.random((60, 40)) < 0.2, rng.random((60, 40)), 0)
    q[:, 0] += 0.01
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    r, t = np.nonzero(q)
    queries, who, sims = tx.nearest(index, r, t, q[r, t], 7)
    want = np.sort(q @ dense.T, axis=1)[:, ::-1][:, :7]
    assert queries.tolist() == list(range(60)) and sims == pytest.approx(want, abs=1e-5)
    assert np.take_along_axis(q @ dense.T, index.ids[who] // 3, 1) == pytest.approx(want, abs=1e-5)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(5)
    x = rng.random(300)
    steps, value = tx.isotonic(x, (rng.random(300) < x).astype(float))
    assert (np.diff(steps) > 0).all() and np.mean(np.diff(value) < -0.05) < 0.1

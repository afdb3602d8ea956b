"""URL filters, secret scans and byte-level BPE against brute force, and the pipeline's stages."""

import fnmatch
import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from marlstone.llm import bpe, ngram_join, packing, quality_classifier, queries, secret_scan, suffix_dedup
from marlstone.llm import url_filters as uf
from marlstone.llm.queries import ORACLE, QUERIES
from tests.compare import connect, differences
from tests.llm.test_duplicates import brute_classes, brute_spans
from tests.llm.test_packing import brute as brute_packing
from tests.llm.test_text import words_of

SMALL = ("op2_suffix_array_dedup", "op5_url_filters", "op6_secret_scans", "op7_ngram_jaccard_join")


@pytest.mark.parametrize("name", SMALL)
def test_queries_equal_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_automaton_is_glob_matching(seed):
    rnd = random.Random(seed)
    rules = ["".join(rnd.choice("ab*?*c/") for _ in range(rnd.randrange(0, 14))) for _ in range(40)] + ["*", "", "a" * 130 + "*", "**b**"]
    texts = ["".join(rnd.choice("abc/") for _ in range(rnd.randrange(0, 12))) for _ in range(200)] + ["a" * 140, "é/ü"]
    raw = [t.encode() for t in texts]
    got = uf.Automaton.of(tuple(rules)).matches(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = [[bool(re.fullmatch(fnmatch.translate(r), b.decode("latin-1"))) for r in rules] for b in raw]
    assert got.tolist() == want


def test_canonical_urls_and_odd_pages(spark):
    rows = [(1, " HTTP://M.Example.NET:80#top "), (2, None), (3, ""), (None, "https://a.b:443/X?y#z"), (5, "nonsense"), (6, "http://x/" + "a" * 50_000 + ".exe"), (6, "http://x/q.exe")]
    got = uf.url_filter(spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, rules int, blocked string"), ("*.exe", "http://m.*")).collect()
    assert [(r.page_id, r.url[:20], r.rules, r.blocked) for r in got] == [(1, "http://m.example.net/", [1], True)[:1] + ("http://m.example.net", [1], True), (2, "", [], False), (3, "", [], False), (None, "https://a.b/X?y", [], False), (5, "nonsense", [], False), (6, "http://x/aaaaaaaaaaa", [0], True), (6, "http://x/q.exe", [0], True)]
    assert uf.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert not uf.url_filter(spark.createDataFrame(rows, "page_id long, url string"), ()).where("blocked").count()


KEY, TOKEN = "AKIA" + "Z" * 16, "ghp_" + "a1" * 18


def texts():
    return [(1, f"x {KEY} y"), (2, f"x {KEY} y"), (3, f"{TOKEN} and {KEY}, {KEY}"), (4, "nothing"), (5, None), (6, ""), (None, f"token = {'q' * 20}"), (7, "a " * 200_000 + KEY), (1, f"x {KEY} y")]


def findings(rows):
    out = set()
    for i, t in rows:
        for r in secret_scan.RULES:
            out |= {(i, r.name, r.version, hashlib.sha256(m.encode()).hexdigest()) for m in re.findall(r.pattern, t or "")}
    return out


def test_findings_are_those_of_all_rules_on_all_texts(spark):
    docs = spark.createDataFrame([(*t, "p", 1) for t in texts()], "doc_id long, text string, path string, rule int")
    got = [tuple(r) for r in secret_scan.secret_findings(docs).collect()]
    assert set(got) == findings(texts()) and len(got) == len(set(got))
    assert secret_scan.secret_findings(docs.where("false")).count() == 0


def test_the_ledger_scans_only_what_is_new(spark, tmp_path):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    ledger = secret_scan.Ledger(spark, str(tmp_path / "ledger"))
    secret_scan.scan(docs, ledger)
    history = secret_scan.versions(docs)
    assert secret_scan.unseen(history, ledger, secret_scan.RULES).count() == 0
    moved = spark.createDataFrame([(9, texts()[0][1]), (10, f"new {TOKEN}")], "doc_id long, text string")
    assert secret_scan.unseen(secret_scan.versions(moved), ledger, secret_scan.RULES).count() == 1
    assert {tuple(r) for r in secret_scan.secret_findings(moved, ledger).collect()} == findings([(9, texts()[0][1]), (10, f"new {TOKEN}")])
    newer = (secret_scan.Rule("aws_access_key", 2, r"\bAKIA[A-Z]+", ("AKIA",)), *secret_scan.RULES[1:])
    todo = secret_scan.unseen(history, ledger, newer).collect()
    assert todo and all(r.rules == ["aws_access_key@2"] for r in todo)


def test_redaction(spark):
    docs = spark.createDataFrame([(*t, 5, "h") for t in texts()], "doc_id long, text string, n_chars long, hit string")
    got = secret_scan.redacted(docs).collect()
    assert got[0].asDict().keys() == dict.fromkeys(docs.columns).keys() and len(got) == len(texts())
    assert not any(KEY in (r.text or "") or TOKEN in (r.text or "") for r in got)
    assert all(r.n_chars in (5, len(r.text or "")) for r in got) and {r.text for r in got if r.doc_id == 4} == {"nothing"}


@pytest.mark.parametrize("length", [300, 1000, 5000])
def test_nothing_of_a_long_secret_stays(spark, length):
    run = "Zq3" * (length // 3)
    secrets = ["ghp_" + run, "xoxb-" + run, "AIza" + run, "sk_live_" + run, "eyJ" + run + ".eyJ" + run + "." + run, f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{run}\n-----END RSA PRIVATE KEY-----", f"-----BEGIN PRIVATE KEY-----\n{run}=", f"postgres://me:{run}:{run}@host", f'client_secret = "{run}"', f"db_password={run}@{run}", f"AUTH_TOKEN: {run}", f"apiKey='{run}'", f"X-Api-Key: {run}"]
    docs = spark.createDataFrame([(i, f"before {t} after", "d", 1, "s") for i, t in enumerate(secrets)], "doc_id long, text string, doc string, sha int, id string")
    got = {r.doc_id: r for r in secret_scan.redacted(docs).collect()}
    assert len(got) == len(secrets) and not any("Zq3" in r.text for r in got.values())
    assert all((r.text.endswith("after") or "[private_key]" in r.text) and (r.doc, r.sha, r.id) == ("d", 1, "s") for r in got.values())  # a key without an end takes all that may belong to it
    assert secret_scan.redacted(docs.where("false")).columns == docs.columns and secret_scan.redacted(docs.where("false")).count() == 0


def test_query_and_stage_take_a_ledger(spark, tmp_path):
    spark.createDataFrame(texts(), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    folder = str(tmp_path / "ledger")
    first = queries.op6_secret_scans(spark, str(tmp_path), folder).collect()
    history = secret_scan.versions(spark.read.parquet(str(tmp_path / "documents.parquet")))
    assert secret_scan.unseen(history, secret_scan.Ledger(spark, folder), secret_scan.RULES).count() == 0
    spark.conf.set("marlstone.secrets.ledger", folder)
    try:
        assert secret_scan.Ledger(spark).folder == folder
        assert sorted(queries.op6_secret_scans(spark, str(tmp_path)).collect(), key=repr) == sorted(first, key=repr)
    finally:
        spark.conf.unset("marlstone.secrets.ledger")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert not any(KEY in (r.text or "") for r in corpus_pipeline.secrets(spark, docs, "", folder).collect())


def encoder():
    return bpe.Codec.of(bpe.vocabulary()).encoding


@pytest.mark.parametrize("chunk,overlap", [(64, 24), (50, 10), (65_536, 1024)])
def test_bpe_is_that_of_the_whole_text(spark, chunk, overlap):
    rnd = random.Random(7)
    made = ["".join(rnd.choice(["a", "bc", " ", "  ", "\n", "'s", "9", "é", "…", "日本", "🙂", ".", "we'll"]) for _ in range(rnd.randrange(0, 400))) for _ in range(60)]
    rows = list(enumerate(made)) + [(100, None), (101, ""), (None, "x"), (102, "<|endoftext|>"), (103, "a" * 700), (104, " " * 500), (0, made[0])]
    got = bpe.bpe_encode(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, tokens int"), chunk=chunk, overlap=overlap)
    want = [(i, None if t is None else encoder().encode_ordinary(t)) for i, t in rows]
    assert sorted(((r.doc_id, r.tokens) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert all(r.round_trip in (None, True) and (r.n_tokens or 0) == len(r.tokens or []) for r in got.collect())
    back = bpe.bpe_decode(got).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(rows, key=repr)
    assert bpe.bpe_encode(got.where("false").selectExpr("doc_id", "'' as text")).count() == 0


def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_every_stage_is_the_brute_force_one(spark, sf_dir):
    """Each stage on all that its predecessor kept, held against sequential versions."""
    docs = small(spark, sf_dir)
    names = docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "secret scans", "best-fit packing"]

    first = stages["quality classifier"](spark, docs, sf_dir).collect()
    weights = quality_classifier.fit(docs, labels)
    every = docs.collect()
    kept = [r for r in every if len(words_of(r.text)) and _score(weights, r.text) >= quality_classifier.CUT]
    assert sorted(first) == sorted(kept) and first[0].asDict().keys() == dict.fromkeys(names).keys()

    second = stages["n-gram Jaccard join"](spark, spark.createDataFrame(kept, docs.schema), sf_dir).collect()
    classes = {d: c for d, c, _ in brute_classes([(r.doc_id, r.text) for r in kept], ngram_join.THRESHOLD)[0]}
    want = [r for r in kept if classes.get(r.doc_id, r.doc_id) == r.doc_id]
    assert sorted(second) == sorted(want)

    third = stages["suffix-array dedup"](spark, spark.createDataFrame(want, docs.schema), sf_dir).collect()
    cut = {}
    for i, a, b, is_first in brute_spans([(r.doc_id, r.text) for r in want], suffix_dedup.DEPTH):
        if not is_first:
            cut.setdefault(i, set()).update(range(a, b))
    expected = {r.doc_id: [w for k, w in enumerate(words_of(r.text)) if k not in cut.get(r.doc_id, ())] for r in want}
    assert {r.doc_id: words_of(r.text) for r in third} == {i: w for i, w in expected.items() if w}

    fourth = stages["secret scans"](spark, spark.createDataFrame(third, docs.schema), sf_dir).collect()

    def clean(t):
        for r in secret_scan.RULES:
            t = re.sub(r.pattern, f"[{r.name}]", t)
        return t

    assert {r.doc_id: r.text for r in fourth} == {r.doc_id: clean(r.text) for r in third}

    fifth = stages["best-fit packing"](spark, spark.createDataFrame(fourth, docs.schema), sf_dir).collect()
    assert sorted(map(tuple, fifth)) == sorted(brute_packing([(r.doc_id, r.text) for r in fourth], packing.CAPACITY))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, fifth))


def _score(weights, text):
    import pyarrow as pa

    return quality_classifier.score_texts(pa.array([text.lower()]), weights)[0]

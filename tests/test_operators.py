"""Operators on small rows: collapsing, profiles, context, sources, sinks, models, indicators, streams."""

import random
import re
import threading
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marlstone.functions import net, text, times
from marlstone.operators import collapse, indicators, model, orgs, profile, signals, vocabulary
from marlstone.plans import registry
from marlstone.sources import sinks, tables
from marlstone.streaming.collapse import collapse_stream


def sequential(rows, window):
    """Groups of (key, file, row, time), one row after the other."""
    top, last, opened, out = None, {}, {}, []
    for key, file, row, t in sorted(rows, key=lambda r: (r[1], r[2])):
        if t is None:
            out.append([row])
            continue
        for k in [k for k, g in opened.items() if top is not None and g[0] + window < top]:
            out.append(opened.pop(k)[1])
        top = t if top is None else max(top, t)
        if (file, key) in last and t < last[file, key]:
            out.append([row])
            continue
        last[file, key] = t
        if (g := opened.get((file, key))) and t - g[0] <= window:
            g[1].append(row)
        else:
            if g:
                out.append(opened.pop((file, key))[1])
            opened[file, key] = (t, [row])
    return sorted([r for _, r in opened.values()] + out)


@pytest.mark.parametrize("seed", [1, 2])
def test_collapse_is_the_sequential_one(spark, seed, monkeypatch):
    monkeypatch.setattr(collapse, "BLOCK", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rnd, rows, t = random.Random(seed), [], 0
    for i in range(400):
        t += rnd.randrange(0, 200)
        rows.append((rnd.choice("abc"), f"f{i // 200}", i, None if rnd.random() < 0.03 else t - rnd.choice([0, 0, 0, 500, 1500])))
    df = spark.createDataFrame(rows, "k string, file string, r long, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = collapse.collapse(df, [F.col("k")], "ts", "file", "r", 15, line="r").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sequential(rows, 900)
    assert sorted(r.source_row_numbers for r in got) == sorted(_ranges(w) for w in want)
    assert {r.aggregation_issue for r in got} >= {None, "AGGREGATION_TIMESTAMP_INVALID"}
    assert all(r.occurrence_count == 1 or r.aggregation_status == "aggregated" for r in got)


def _ranges(rows):
    out = []
    for r in sorted(rows):
        if out and out[-1][1] == r - 1:
            out[-1][1] = r
        else:
            out.append([r, r])
    return ";".join(str(a) if a == b else f"{a}-{b}" for a, b in out)


def test_collapse_of_nothing(spark):
    df = spark.createDataFrame([], "k string, r long, ts timestamp")
    assert collapse.collapse(df, [F.col("k")], "ts", "f", "r").count() == 0


def test_a_stream_gives_the_groups_of_a_batch(spark, tmp_path):
    rows = [("a", 100, 1), ("a", 700, 2), ("b", 1000, 3), ("a", 1001, 4), ("a", 900, 5), ("c", 9100, 6)]
    spark.createDataFrame(rows, "k string, t long, r long").select("k", F.timestamp_seconds("t").alias("ts"), "r").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, r long").parquet(str(tmp_path / "in"))
    q = collapse_stream(stream, "k", "ts", "r").writeStream.format("memory").queryName("collapsed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.key, r.first_row, r.last_row, r.occurrence_count, r.out_of_order) for r in spark.table("collapsed").collect()}
    assert ("a", 1, 2, 2, False) in got and ("a", 5, 5, 1, True) in got and ("b", 3, 3, 1, False) in got


def test_profile_learns_and_scores(spark, tmp_path):
    rows = [("h1", "edit", "1.5", "open file one"), ("h1", "edit", "2.5", "open file two"), ("h2", "shell", "2.0", "list all")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, host string, process string, duration string, command string")
    o = profile.Options(entity=("host",), text=("command",), categorical=("process",), numeric=("duration",), ignored=("id",), entity_minimum=2)
    profile.learn(df, o).save(str(tmp_path / "p"))
    p = profile.Profile.load(spark, str(tmp_path / "p"))
    new = [("h1", "edit", "2.0", "open file one"), ("h1", "shell", "9", "erase every disk now"), ("h3", "shell", "2", "list all"), ("h1", None, "x", "open"), ("h1", "edit", "1_0", None)]
    got = profile.score(spark.createDataFrame([(i, *r) for i, r in enumerate(new)], df.schema), p, "id").orderBy("id").collect()
    codes = [[e.reason_code for e in r.evidence] for r in got]
    assert codes[0] == [] and not got[0].is_anomaly and got[0].profile_scope == "entity"
    assert codes[1] == ["UNKNOWN_CATEGORICAL_VALUE", "NUMERIC_OUTSIDE_BENIGN_PROFILE", "UNSEEN_TEXT_TOKENS"]
    assert codes[2] == ["UNKNOWN_ENTITY"] and got[2].profile_scope == "global"
    assert codes[3] == ["MISSING_PROFILED_FIELD", "NUMERIC_VALUE_MALFORMED", "UNSEEN_TEXT_TOKENS"]
    assert codes[4] == ["NUMERIC_OUTSIDE_BENIGN_PROFILE", "MISSING_PROFILED_FIELD"]
    with pytest.raises(ValueError):
        profile.Options.of({"unknown": 1})
    with pytest.raises(ValueError):
        profile.learn(df, profile.Options(numeric=("absent",)))


def contexts(spark, rows, **how):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row long, user_uid string, login_result string, event_time_iso string")
    return {r.row: r.cross_tokens for r in signals.context_tokens(df, "row", **how).collect()}


def test_context_is_causal_and_inclusive(spark):
    token = ["cross:failed_login_burst_and_successful_login_same_user_15m"]
    at = "2026-01-01T{}Z".format
    assert contexts(spark, [("u", "failure", at("10:00:00")), ("u", "accepted", at("10:15:00"))]) == {1: token}
    assert contexts(spark, [("u", "failure", at("10:00:00")), ("u", "accepted", at("10:15:01"))]) == {}
    assert contexts(spark, [("u", "failure", at("10:00:00")), ("v", "accepted", at("10:05:00"))]) == {}
    assert contexts(spark, [("u", "accepted", at("10:05:00")), ("u", "failure", at("10:00:00"))]) == {0: token}
    assert contexts(spark, [("u", "failure", at("23:50:00")), ("u", "accepted", "2026-01-02T00:04:00Z")]) == {1: token}  # over a chunk's edge
    assert contexts(spark, [("u", "failure", at("10:00:00")), ("u", "accepted", at("10:00:00"))]) == {1: token}
    assert contexts(spark, [("u", "failure", None), ("u", "accepted", at("10:00:00")), ("u", "success failure", "x")]) == {2: token}
    assert contexts(spark, [("u", "success failure", None)], minutes=0) == {0: token}


def test_signals_read_each_column_once(spark):
    df = spark.createDataFrame([(1, "203.0.114.9", " 22 ", "Open Secret.txt", "x1y2z3a4b5c6.example.org.", "5000.0")], "row long, dst_ip string, dst_port string, process_command_line string, domain string, total_size string")
    wide = signals.prepared(df)
    out = wide.select("row", *(c.alias(s) for s, c in signals.library(wide.columns).items()))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("trim(") <= 4 * len(df.columns)
    on = {s for s, x in out.first().asDict().items() if x is True}
    assert {"sensitive_file_read", "large_upload", "outbound_ssh", "rare_destination_ip", "first_seen_domain", "high_entropy_domain"} <= on and "external_tls_post" not in on


def test_tasks_do_not_grow_with_the_input(spark, tmp_path):
    spark.range(100_000).write.parquet(str(tmp_path / "t.parquet"))
    df, cores = tables.table(spark, str(tmp_path), "t"), spark.sparkContext.defaultParallelism
    assert tables.spread(df, 4096).rdd.getNumPartitions() > max(cores, 50) and tables.spread(df, 4096).count() == 100_000
    assert tables.spread(df).rdd.getNumPartitions() == max(cores, df.rdd.getNumPartitions())


def test_zones_and_addresses(spark):
    cases = ["10.1.2.3", "10.1.2.3:80", "[2001:db8::1]:443", "2001:db8::1", "http://10.1.2.9/x", "name:80", "", None, "10.1.2.3/8"]
    df = spark.createDataFrame([(c,) for c in cases], "a string")
    zones = [r[0] for r in df.select(net.network_zone("a")).collect()]
    assert zones == ["10.1.2.0/24", "10.1.2.0/24", "2001:db8::/64", "2001:db8::/64", "10.1.2.0/24", None, None, None, "10.1.2.0/24"]
    df = spark.createDataFrame([("8.8.8.8",), ("10.0.0.1",), ("169.254.1.1",), ("::1",), ("2606:4700::1",), (None,), ("x",)], "a string")
    assert [r[0] for r in df.select(net.is_external(F.col("a"), True)).collect()] == [True, False, False, False, True, False, False]


def test_times_and_numbers(spark):
    df = spark.createDataFrame([("2026-07-20t09:00:00z",), ("2026-07-20_09:00:00",), ("2026-07-20",), ("2026",), ("junk",), (None,)], "t string")
    got = [r[0] for r in df.select(text.utc_text(times.iso_time(F.col("t"), "Europe/Berlin"))).collect()]
    assert got == ["2026-07-20T09:00:00Z", "2026-07-20T07:00:00Z", "2026-07-19T22:00:00Z", "", "", ""]
    df = spark.createDataFrame([("1_000",), ("1.0d",), ("1f",), (".5",), ("1e3",), ("inf",), ("",), ("-7.",)], "t string")
    assert [r[0] for r in df.select(text.number(F.col("t"))).collect()] == [1000.0, None, None, 0.5, 1000.0, None, None, -7.0]
    both = spark.createDataFrame([("1767225600", "2026-01-01T00:00:01Z"), ("1767225600", "2026-01-01T00:00:02Z"), ("x", "2026-01-01T00:00:00Z")], "e string, i string")
    assert [r[0] for r in both.select(times.event_time(F.col("e"), F.col("i"))[1]).collect()] == [None, "CONFLICT", "INVALID"]


def test_csv_with_line_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('time,notes\n1,"two\nlines"\n2,short\n3\n\n4,"=x",more\n')
    (tmp_path / "b.csv").write_text("time,other\n9,z\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    assert tables.union_header(spark, paths) == ["time", "notes", "other"]
    rows = tables.read_csv_lines(spark, paths).orderBy("source_file", "source_row_number").collect()
    assert [(r.time, r.notes, r.other, r.source_row_number, r.source_line_number, r.malformed) for r in rows] == [("1", "two\nlines", "", 1, 2, False), ("2", "short", "", 2, 4, False), ("3", "", "", 3, 5, True), ("", "", "", 4, 6, True), ("4", "=x", "", 5, 7, True), ("9", "", "z", 1, 2, False)]


def test_numbers_of_a_log_table(spark):
    df = spark.createDataFrame([(1, "443.0", "007"), (2, " ", None), (3, "1.5", "x")], "row long, dst_port string, user_uid string")
    assert [(r.dst_port, r.user_uid) for r in tables.canonical_numbers(df, "row").collect()] == [("443", "007"), (None, None), ("1.5", "x")]
    with pytest.raises(PySparkException, match="dst_port, row 9"):
        tables.canonical_numbers(spark.createDataFrame([(9, "many")], "row long, dst_port string"), "row").collect()


def test_forwarded_csv_keeps_original_values(spark, tmp_path):
    df = spark.createDataFrame([("f", 1, "=1+1", "=x")], "source_file string, source_row_number long, notes string, why string")
    df = df.withColumn("decision", F.struct(F.lit("forward").alias("action"), F.lit("system").alias("category"), F.lit("A").alias("reason_code"), F.col("why").alias("reason_details"), F.lit(None).cast("string").alias("matched_policy_id")))
    r = sinks.forwarded_columns(df, ["notes"]).first()
    assert r.notes == "=1+1" and r.filter_reason_details == "'=x" and r.matched_policy_id == ""
    sinks.write_csv(sinks.forwarded_columns(df, ["notes"]), str(tmp_path / "out"))
    assert tables.read_csv(spark, str(tmp_path / "out")).first().notes == "=1+1"


def test_zipped_rows_must_match(spark):
    a, b = spark.range(3).withColumnRenamed("id", "r"), spark.range(2).select(F.col("id").alias("r"), F.lit("x").alias("label"))
    assert orgs.zipped(a.where("r < 2"), b, "r").count() == 2
    with pytest.raises(PySparkException, match="row counts differ"):
        orgs.zipped(a, b, "r").collect()


def test_sgd_lowers_the_loss_and_tfidf_coordinates_agree():
    rng = np.random.default_rng(0)
    x = (rng.random((60, 5)) < 0.5).astype(float)
    y = (x[:, 0] > 0).astype(float)
    start = np.concatenate([[0], np.cumsum((x > 0).sum(1))])
    index = np.nonzero(x)[1]
    one = model.sgd(start, index, np.ones(len(index)), y, np.zeros(5), 0.0, 0.1, 8, 0, 0.0, 1, 1.0, 1.0)
    many = model.sgd(start, index, np.ones(len(index)), y, np.zeros(5), 0.0, 0.5, 8, 60, 0.0, 1, 1.0, 1.0)
    assert one["loss"] == pytest.approx(np.log(2)) and many["loss"] < 0.2 and many["accuracy"] == 1.0

def test_sgd_takes_the_memory_of_a_piece():
    n = 400_000
    start, index, y = np.arange(n + 1), np.arange(n) % 5, (np.arange(n) % 3 == 0).astype(np.int8)
    tracemalloc.start()
    out = model.sgd(start, index, np.ones(n), y, np.zeros(5), 0.0, 0.1, 1 << 30, 1, 0.0, 1, 1.0, 1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * 8 * 2  # the values and a piece; whole batches took more than 30 bytes a row
    assert abs(out["bias"] + 0.1 * (0.5 - y.mean())) < 1e-12 and out["accuracy"] > 0.66


def test_training_keeps_its_examples_in_files():
    schema = pa.schema([("label", pa.string()), ("subcategory", pa.string()), ("org", pa.string()), ("__is_model", pa.int32()), ("gv_index", pa.int64()), ("weight", pa.float64()), ("idf", pa.float64()), ("bias", pa.float64()), ("y", pa.int8()), ("positive_weight", pa.float64()), ("negative_weight", pa.float64()), ("__index", pa.list_(pa.int64())), ("__value", pa.list_(pa.float64()))])
    rows = 2_000
    # org a has no weights, b has weights and 80 batches of examples of 20 features, c has weights only
    some = lambda org, n: pa.RecordBatch.from_pydict({"label": ["t"] * n, "subcategory": ["s"] * n, "org": [org] * n, "__is_model": [0] * n, "gv_index": [None] * n, "weight": [None] * n, "idf": [None] * n, "bias": [None] * n, "y": [k % 2 for k in range(n)], "positive_weight": [1.0] * n, "negative_weight": [1.0] * n, "__index": [list(range(20)) for _ in range(n)], "__value": [[1.0] * 20 for _ in range(n)]}, schema)
    head = lambda org: pa.RecordBatch.from_pydict({"label": ["t"] * 20, "subcategory": ["s"] * 20, "org": [org] * 20, "__is_model": [1] * 20, "gv_index": list(range(20)), "weight": [0.0] * 20, "idf": [1.0] * 20, "bias": [0.5] * 20, "y": [None] * 20, "positive_weight": [None] * 20, "negative_weight": [None] * 20, "__index": [None] * 20, "__value": [None] * 20}, schema)
    many = some("b", rows)
    tracemalloc.start()
    found = [r for out in model._training(None, False, 0.1, 64, 1, 0.0, 1)([some("a", 5), head("b"), *[many] * 80, head("c")]) for r in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["org"], r["examples"]) for r in found] == [("b", rows * 80)]
    assert peak < rows * 80 * 20 * 8  # one of the arrays would take that much


def test_averaging_keeps_uncovered_weights(spark):
    w = spark.createDataFrame([("l", "s", i, float(i)) for i in range(3)], "label string, subcategory string, gv_index long, weight double")
    u = spark.createDataFrame([("l", "s", "a", 2, 1.0, [0, 2], [3.0, 5.0]), ("l", "s", "b", 1, 4.0, [1], [7.0])], "label string, subcategory string, org string, examples long, bias double, indexes array<long>, weights array<double>")
    new, bias = model.averaged(w, u)
    assert {r.gv_index: pytest.approx(r.weight) for r in new.collect()} == {0: 2.0, 1: 3.0, 2: 4.0}
    assert bias.first().bias == pytest.approx(2.0)


def test_models_are_saved_and_checked(spark, tmp_path):
    w = spark.createDataFrame([("l", "s", 0, 1.0)], "label string, subcategory string, gv_index long, weight double")
    axis = spark.createDataFrame([("t", 0)], "tag string, gv_index long")
    sinks.save_model(str(tmp_path / "m"), {"namespace": "x"}, weights=w, axis=axis)
    manifest, found = sinks.load_model(spark, str(tmp_path / "m"), {"namespace": "x"})
    assert manifest["tables"] == ["axis", "weights"] and found["weights"].first().weight == 1.0
    with pytest.raises(ValueError, match="namespace"):
        sinks.load_model(spark, str(tmp_path / "m"), {"namespace": "y"})


def test_hierarchy():
    h = model.Hierarchy.default(["benign", "data exfil", "other"], {"other": {"subcategories": ["llm"], "weights": {"llm": 2}}})
    assert h.subcategories["other"] == ("llm",) and h.weights["other"]["llm"] == 2.0 and h.weights["benign"]["bias"] == 0.0
    assert model.Hierarchy.from_json(h.to_json()).weights == h.weights
    assert h.averaged().weights["benign"] == pytest.approx({"system": 1 / 3, "network": 1 / 3, "cross": 1 / 3, "bias": 0.0})
    with pytest.raises(ValueError):
        h.averaged(llm=0.0)


def test_indicators_in_texts(spark):
    md5, sha = "d41d8cd98f00b204e9800998ecf8427e", "A" * 64
    cases = [
        (f"see http://Bad.example.com/a/file.exe, then 10.0.0.300 and 1.2.3.4, md5={md5} sha {sha}", [("domain", "bad.example.com"), ("ipv4", "1.2.3.4"), ("md5", md5), ("sha256", sha.lower()), ("url", "http://Bad.example.com/a/file.exe")]),
        (f"entity_id={md5} uuid: {md5}", []),
        (f"file_hash_id={md5}", [("md5", md5)]),
        ("http://5.6.7.8:80/x", [("ipv4", "5.6.7.8"), ("url", "http://5.6.7.8:80/x")]),
        (None, []),
        ("", []),
    ]
    got = spark.createDataFrame([(c,) for c, _ in cases], "t string").select(indicators.extract(F.col("t")).alias("i")).collect()
    assert [[tuple(x) for x in r.i] for r in got] == [w for _, w in cases]


def test_indicator_records_and_bundle(spark):
    logs = spark.createDataFrame([(0, 0, "1.2.3.4", "x"), (0, 1, None, "see evil.example.org")], "org_index int, row_index long, dst_ip string, message string")
    risky = spark.createDataFrame([(0, 0, "org_0_row_0", None, 0.9, 0), (0, 1, "org_0_row_1", "bad", 0.8, 1)], "org_index int, row_index long, internal_log_id string, predicted_label string, max_risk_probability double, order int")
    why = spark.createDataFrame([("org_0_row_0", "worse", 0.5, "{}", 0)], "internal_log_id string, predicted_label string, max_risk_probability double, top_contributions string, order int").withColumn("top_contributions", F.array(F.struct("top_contributions")))
    found = indicators.records(risky, logs, why, "message")
    rows = {(r.indicator_type, r.indicator_value): r for r in found.collect()}
    assert set(rows) == {("ipv4", "1.2.3.4"), ("domain", "evil.example.org")} and rows["ipv4", "1.2.3.4"].predicted_label == "worse"
    objects = [r.object for r in indicators.bundle(found).collect()]
    assert any('"pattern":"[ipv4-addr:value = \'1.2.3.4\']"' in o for o in objects)
    with pytest.raises(PySparkException, match="no log row"):
        indicators.records(risky.withColumn("row_index", F.col("row_index") + 5), logs).collect()
    assert [tuple(r) for r in indicators.counts(found.where("false")).collect()] == [("none", 0)]


def test_stix_patterns():
    p = indicators.parse_pattern
    assert p("[url:value = 'https://www.A.com/x']") == [("url", "https://www.a.com/x"), ("domain", "a.com")]
    assert p("[url:value = 'http://a.com/']") == [("domain", "a.com")]
    assert p("[ipv4-addr:value IN ('1.1.1.1', '10.0.0.5/8')]") == [("ipv4", "1.1.1.1"), ("ipv4", "10.0.0.0/8")]
    assert p("[file:hashes.'SHA-256' = 'AB'] AND [file:name = 'x.exe']") == [("sha256", "ab"), ("file_name", "x.exe")]
    assert p("junk") == [] and p(None) == []


def test_stix_files(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"type": "bundle", "objects": [{"type": "indicator", "pattern": "[domain-name:value = \'WWW.a.com\']"}, {"type": "identity"}]}')
    (tmp_path / "l.jsonl").write_text('{"type": "indicator", "pattern": "[domain-name:value = \'a.com\']"}\nbad\n')
    a, b = (indicators.stix_indicators(indicators.read_stix(spark, str(tmp_path / n))) for n in ("b.json", "l.jsonl"))
    assert indicators.quality(indicators.compare(a, b)).first().f1 == 1.0


PAGES = [(1, "http://a.example.com/x", '<a href="http://a.example.com/x">seen</a> from 10.0.0.1 today'), (5, "http://b.example.org/", "nothing"), (6, None, None)]


def test_whole_sets_of_page_indicators_are_compared(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.indicator_type: tuple(r)[1:] for r in registry.QUERIES["indicator_set_compare_whole"](spark, str(tmp_path)).collect()}
    assert got == {"url": (1, 2, 1, 0, 1), "domain": (1, 2, 1, 0, 1), "ipv4": (1, 0, 0, 1, 0)}
    q = registry.QUERIES["indicator_quality_whole"](spark, str(tmp_path)).first()
    assert (q.true_positives, q.false_positives, q.false_negatives) == (2, 1, 2)


def test_indicators_of_html_are_found(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {tuple(r) for r in registry.QUERIES["ioc_html"](spark, str(tmp_path)).collect()}
    assert got == {(1, "url", "http://a.example.com/x"), (1, "domain", "a.example.com"), (1, "ipv4", "10.0.0.1")}


def test_tokens_are_counted_in_pieces_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(text, "PIECE_BYTES", 20)
    rows = [(0, "a", None), (1, None, ""), (2, "b", "Ab ab, (AB) x=1. 'y:z;' café-au lait İx"), (3, "b", "ab " * 30 + "q"), (3, "b", "zz ab")]
    df = spark.createDataFrame(rows, "k int, g string, t string").coalesce(1)
    want = Counter((r.k, r.g, t) for r in df.select("k", "g", text.tokenize(F.col("t")).alias("x")).collect() for t in r.x)
    got = vocabulary.text_frequency(df, F.col("t"), "k", "g").collect()
    assert {(r.k, r.g, r.token): r.tf for r in got} == dict(want) and len(got) == len(want)
    words = pa.RecordBatch.from_pydict({"k": [7], "t": ["one " * 1000]})
    counted = text._counted(words, pa.schema([("k", pa.int64()), ("token", pa.string()), ("tf", pa.int64())]))
    assert counted.to_pylist() == [{"k": 7, "token": "one", "tf": 1000}]  # a row a token, not one a word


def test_logits_of_features_without_a_subcategory(spark):
    w = spark.createDataFrame([(a, s, i, 1.0 + i + 10 * (a == "b") + 100 * (s == "u")) for a in "ab" for s in "tu" for i in range(2)], "label string, subcategory string, gv_index long, weight double")
    b = spark.createDataFrame([(a, s, 0.5) for a in "ab" for s in "tu"], "label string, subcategory string, bias double")
    f = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0)], "row long, gv_index long, value double")
    rows = spark.range(1, 3).withColumnRenamed("id", "row")
    shared = {tuple(r) for r in model.logits(f, w, b, rows, "row").collect()}
    assert shared == {(1, "a", "t", 5.5), (1, "b", "t", 35.5), (1, "a", "u", 305.5), (1, "b", "u", 335.5), *((2, a, s, 0.5) for a in "ab" for s in "tu")}
    both = f.crossJoin(w.select("subcategory").distinct())
    assert {tuple(r) for r in model.logits(both, w, b, rows, "row").collect()} == shared
    one = {tuple(r) for r in model.logits(both.where("subcategory = 't'"), w, b, rows, "row").collect()}
    assert (1, "b", "t", 35.5) in one and (1, "b", "u", 0.5) in one


def test_training_does_not_hold_its_examples(spark):
    n, per, width = 30_000, 100, 50
    rng = np.random.default_rng(3)
    key = {c: pa.array(["x"] * n) for c in ("label", "subcategory", "org")}
    lists = lambda values: pa.ListArray.from_arrays(pa.array(np.arange(0, n * per + 1, per, dtype=np.int32)), pa.array(values))
    own = key | {"__is_model": pa.array(np.zeros(n, np.int32)), "gv_index": pa.nulls(n, pa.int64())} | {c: pa.nulls(n, pa.float64()) for c in ("weight", "idf", "bias")} | {"y": pa.array(rng.integers(0, 2, n).astype(np.int8)), "positive_weight": pa.array(np.ones(n)), "negative_weight": pa.array(np.ones(n)), "__index": lists(np.sort(rng.integers(0, width, (n, per)), 1).ravel()), "__value": lists(np.ones(n * per))}
    head = {c: v[:width] for c, v in key.items()} | {"__is_model": pa.array(np.ones(width, np.int32)), "gv_index": pa.array(np.arange(width))} | {c: pa.array(np.full(width, x)) for c, x in (("weight", 0.01), ("idf", 1.0), ("bias", 0.0))} | {c: pa.nulls(width, own[c].type) for c in ("y", "positive_weight", "negative_weight", "__index", "__value")}
    s = model._Specialist(("x", "x", "x"), False)
    for part in (head, own):
        s.add(pa.RecordBatch.from_pydict(part))
    mapped = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("RssFile")).split()[1]) >> 10
    before, seen, done = mapped(), [0], threading.Event()

    def watch():
        while not done.is_set():
            seen.append(mapped())
            time.sleep(0.002)

    watcher = threading.Thread(target=watch)
    watcher.start()
    got = s.trained(0.05, 64, 1, 1e-4, 42)[0]
    done.set()
    watcher.join()
    assert max(seen) - before < 16  # MB; the examples are 36
    start, index, value, y = np.arange(0, n * per + 1, per), own["__index"].flatten().to_numpy(), np.ones(n * per), own["y"].to_numpy()
    want = model.sgd(start, index, value, y, np.full(width, 0.01), 0.0, 0.05, 64, 1, 1e-4, 42 + sum(map(ord, "x|x|x")), 1.0, 1.0)
    assert got["examples"] == n and got["loss"] == want["loss"] and got["bias"] == want["bias"] and (got["weights"] == want["weights"]).all()


def test_texts_are_counted_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.createDataFrame([(1, "One two one")], "row long, text string")
    assert {(r.token, r.tf) for r in text.token_counts(df, F.col("text"), "row").collect()} == {("one", 2), ("two", 1)}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20


def test_signals_are_compiled(spark):
    df = spark.createDataFrame([(1, "h", "203.0.114.9", "22", "open Secret.txt", "9000")], "row long, host string, dst_ip string, dst_port string, process_command_line string, total_size string")
    tokens = signals.row_tokens(df)
    found = tokens.first()["cross_tokens"]
    assert len(found) == len(set(found)) > 0 and [signals.TOKENS.index(t) for t in found] == sorted(signals.TOKENS.index(t) for t in found)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(signals.row_tokens(df)._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    assert sizes and max(sizes) <= 8000  # a JVM does not compile larger methods


def test_context_reads_its_rows_once(spark):
    at = "2026-01-01T{}Z".format
    rows = [("u", "failure", None), ("u", "accepted", None), ("u", "success failure", "x"), ("u", "accepted", at("10:05:00")), ("u", "failure", at("10:00:00"))]
    token = ["cross:failed_login_burst_and_successful_login_same_user_15m"]
    assert contexts(spark, rows) == contexts(spark, rows, minutes=1440) == {2: token, 3: token}
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row long, user_uid string, login_result string, event_time_iso string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(signals.context_tokens(df, "row")._jdf.queryExecution(), "codegen")
        tree = signals.context_tokens(df, "row")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert tree.count("Scan ExistingRDD") == 1
    assert max(int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", plan)) <= 8000


def test_late_rows_are_found_without_a_window_of_a_key(spark):
    df = spark.createDataFrame([("k", "f", 1, "2026-01-01 10:00:00")], "k string, f string, r long, t string").withColumn("ts", F.col("t").cast("timestamp"))
    plan = collapse.collapse(df, [F.col("k")], "ts", "f", "r")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"windowspecdefinition\(__key", plan)
    rng, carry, top = np.random.default_rng(5), None, {}
    keys, times = np.sort(rng.integers(0, 12, 400)).astype(object), rng.integers(-50, 50, 400)
    for a in range(0, 400, 23):
        late, carry = collapse.late_rows(keys[a : a + 23], times[a : a + 23], carry)
        for k, x, got in zip(keys[a : a + 23], times[a : a + 23], late):
            assert got == (k in top and x < top[k])
            top[k] = max(top.get(k, x), x)

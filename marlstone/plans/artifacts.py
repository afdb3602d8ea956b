"""Queries through files: what is written with the sinks and read back with the sources is what went in.

Each writes to a new folder in the session's shared folder (a temporary one in local sessions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.keyed import hmac_sha256_sql, key_of
from marlstone.operators import federated, indicators, model, orgs, policy, profile, signals
from marlstone.plans.logs import _DECIDED_SQL, _HOST_SQL, _IOC_SQL, _NUMBERS, _SIDES_SQL, POLICY, _collapse_sql, _compared, _page_iocs, _rounded, log_rows
from marlstone.plans.words import _CONF, _hashed, _hashed_sql
from marlstone.sources import artifacts, sinks, tables
from marlstone.sources.artifacts import scratch
from marlstone.sources.tables import table
from marlstone.streaming.collapse import collapse_stream

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name || chr(10) || '\"' || n_name || '\", x' AS note, '' AS absent, row_number() OVER (ORDER BY n_nationkey) AS source_row_number, row_number() OVER (ORDER BY n_nationkey) * 2 AS source_line_number, false AS malformed FROM nation")
def csv_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that span two lines, written as CSV and read with row and line numbers and a column that the file lacks."""
    n, path = table(spark, sf_dir, "nation"), scratch(spark, "csv")
    own = n.orderBy("n_nationkey").coalesce(1).select("n_nationkey", F.concat("n_name", F.lit('\n"'), "n_name", F.lit('", x')).alias("note"))
    own.write.option("header", True).option("escape", '"').csv(path)
    columns = tables.union_header(spark, [path]) + ["absent"]
    return tables.read_csv_lines(spark, [f"{path}/*.csv"], columns).select("n_nationkey", "note", "absent", "source_row_number", "source_line_number", "malformed")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def csv_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, path = table(spark, sf_dir, "customer"), scratch(spark, "csv")
    sinks.write_csv(c.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("c_mktsegment")), path)
    return tables.read_csv(spark, path)


@query("""SELECT k AS org_index, n_nationkey AS row_index, 'org_' || k || '_row_' || n_nationkey AS internal_log_id, CAST(n_nationkey * 10 AS VARCHAR) AS source_log_id, n_name AS text, CASE WHEN n_regionkey < 2 THEN 'benign' ELSE 'attack' END AS label, CAST(n_regionkey AS VARCHAR) AS dst_port FROM nation CROSS JOIN (SELECT unnest([0, 1]) AS k)""")
def dataset_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs and ground truths of two organisations, aligned by row."""
    n, logs, truths = table(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1), [], []
    for k in range(2):
        logs.append(scratch(spark, "log"))
        truths.append(scratch(spark, "truth"))
        n.select((F.col("n_nationkey") * 10).alias("log_id"), F.col("n_name").alias("message"), F.concat("n_regionkey", F.lit(".0")).alias("dst_port")).write.option("header", True).csv(logs[k])
        n.select(F.when(F.col("n_regionkey") < 2, " Benign").otherwise("ATTACK").alias("Label"), F.lit("x").alias("more")).write.option("header", True).csv(truths[k])
    out = federated.load(spark, [f"{p}/*.csv" for p in logs], [f"{p}/*.csv" for p in truths], "Label")
    return out.select("org_index", "row_index", "internal_log_id", "source_log_id", "text", "label", "dst_port")


@query("SELECT event_id, event_type, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type, NULL FROM events WHERE event_id % 2 = 1")
def jsonl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, path = table(spark, sf_dir, "events"), scratch(spark, "lines")
    sinks.write_json(e.select("event_id", "event_type", F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("value")), path)
    return tables.read_jsonl(spark, path, "event_id long, event_type string, value double")


@query("SELECT * FROM (SELECT DISTINCT indicator_type, CASE WHEN indicator_type = 'domain' THEN regexp_replace(indicator_value, '^www[.]', '') ELSE lower(indicator_value) END AS indicator_value FROM (" + _IOC_SQL + " SELECT indicator_type, indicator_value FROM i WHERE indicator_type <> 'url'))")
def stix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of pages as a bundle of STIX patterns, and what is read back from it."""
    found, path = _page_iocs(spark, sf_dir).where("indicator_type <> 'url'").select("indicator_type", "indicator_value").distinct(), scratch(spark, "stix")
    made = found.select(F.lit("indicator").alias("type"), indicators.pattern(F.col("indicator_type"), F.upper("indicator_value")).alias("pattern"))
    made.unionByName(spark.createDataFrame([("malware", "[domain-name:value = 'not.me']"), ("indicator", "nothing")], "type string, pattern string")).write.json(path)
    text = spark.read.text(path)
    bundle = f"{path}-bundle.jsonl"
    text.write.text(bundle)
    return indicators.stix_indicators(indicators.read_stix(spark, bundle))


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS count, round(min({c}), 4) AS minimum, round(max({c}), 4) AS maximum, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS deviation FROM lineitem" for c in _NUMBERS))
def profile_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile saved twice; the last version is read."""
    path, wanted = scratch(spark, "profile"), profile.Options(numeric=_NUMBERS)
    l = table(spark, sf_dir, "lineitem").select(*_NUMBERS)
    profile.learn(l.where("l_quantity > 10"), wanted).save(path)
    profile.learn(l, wanted).save(path)
    return _rounded(profile.Profile.load(spark, path).stats, ["field"])


@query(f"SELECT label, subcategory, gv_index, round({_hashed_sql('gv_index', 'label', 'subcategory')}, 9) AS weight FROM (SELECT unnest(['a', 'b']) AS label), (SELECT unnest(['system', 'cross']) AS subcategory), (SELECT DISTINCT user_id AS gv_index FROM events)")
def model_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis, path = table(spark, sf_dir, "events").select(F.col("user_id").alias("gv_index")).distinct(), scratch(spark, "model")
    subs = spark.createDataFrame([(c, s) for c in "ab" for s in ("system", "cross")], "label string, subcategory string")
    weights = axis.crossJoin(F.broadcast(subs)).withColumn("weight", _hashed(F.col("gv_index").cast("string"), F.col("label"), F.col("subcategory")))
    sinks.save_model(path, {"labels": ["a", "b"]}, weights=weights, axis=axis)
    _, found = sinks.load_model(spark, path, {"labels": ["a", "b"]})
    return found["weights"].select("label", "subcategory", "gv_index", F.round("weight", 9).alias("weight"))


_BASE_TAG = hmac_sha256_sql(key_of(42), "'benign-baseline|domains|' || host")


@query(f"SELECT DISTINCT org AS org_index, 'domains' AS kind, {_BASE_TAG} AS tag FROM (SELECT {_HOST_SQL} AS host, regexp_extract(url, '^https?://[^/]*/([a-z][a-z])/', 1) AS org FROM pages WHERE url LIKE 'http://%') WHERE host <> ''")
def novelty_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of benign values, saved and read back."""
    url, path = F.col("url"), scratch(spark, "baseline")
    p = table(spark, sf_dir, "pages").select(url.alias("domain"), F.concat(F.lit("o"), F.regexp_extract(url, "^https?://[^/]*/([a-z][a-z])/", 1)).alias("org_index"), F.when(url.startswith("http://"), "benign").otherwise("other").alias("label"))
    artifacts.write_baseline(signals.baseline(p, key_of(42)), path, p.where("label = 'benign'").groupBy("org_index").agg(F.count("*").alias("n")))
    return artifacts.read_baseline(spark, path).withColumn("org_index", F.substring("org_index", 2, 9))


@query(_DECIDED_SQL + "SELECT CAST(event_id AS VARCHAR) AS event_id, 'forward' AS filter_action, reason_code AS filter_reason, category AS evaluated_category, matched_policy_id FROM c WHERE reason_code <> 'ALLOWED'")
def forwarded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the policy forwards, as CSV."""
    rows, path = log_rows(spark, sf_dir), scratch(spark, "forwarded")
    sinks.write_csv(sinks.forwarded_columns(policy.forwarded(policy.with_decision(rows, POLICY)), rows.columns), path)
    return tables.read_csv(spark, path).select("event_id", "filter_action", "filter_reason", "evaluated_category", "matched_policy_id")


@query(_DECIDED_SQL + "SELECT count(*) AS total_rows, count(*) FILTER (reason_code <> 'ALLOWED') AS forwarded_rows, count(*) FILTER (reason_code = 'ALLOWED') AS suppressed_rows, count(DISTINCT reason_code) AS reasons FROM c")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "summary")
    artifacts.write_summary(policy.summary(policy.with_decision(log_rows(spark, sf_dir), POLICY)), path)
    d = F.from_json("value", "total_rows long, forwarded_rows long, suppressed_rows long, rows_by_reason map<string,long>")
    return spark.read.text(path).select(d.alias("d")).select("d.total_rows", "d.forwarded_rows", "d.suppressed_rows", F.size("d.rows_by_reason").cast("long").alias("reasons"))


@query("SELECT event_id, 1.0::DOUBLE AS anomaly_score, 'UNKNOWN_CATEGORICAL_VALUE' AS code FROM events WHERE event_type = 'error'")
def anomaly_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies as CSV with their evidence as JSON."""
    e, path = table(spark, sf_dir, "events").select("event_id", "event_type"), scratch(spark, "anomalies")
    o = profile.Options(categorical=("event_type",), ignored=("event_id",))
    sinks.write_anomalies(profile.score(e, profile.learn(e.where("event_type <> 'error'"), o), "event_id"), path)
    rows = tables.read_csv(spark, path)
    evidence = F.from_json("evidence", "array<struct<reason_code:string>>")
    return rows.select(F.col("event_id").cast("long").alias("event_id"), F.col("anomaly_score").cast("double").alias("anomaly_score"), F.element_at(evidence, 1)["reason_code"].alias("code"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    p = F.col("doc_id") % 100 / 100
    return l.select("doc_id", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("label"), F.when(F.col("toxic") == 0, "yes").when(F.col("doc_id") % 5 == 0, "maybe").otherwise("no").alias("predicted_label"), p.alias("max_risk_probability"), (p >= 0.75).alias("is_high_risk"), F.array("doc_id", "toxic").alias("probabilities"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, '[' || doc_id || ',' || toxic || ']' AS probabilities, CASE WHEN doc_id % 100 >= 75 THEN 1 ELSE 0 END AS lines FROM labels")
def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as CSV, and how many of the lines of high risk are a row's."""
    path = scratch(spark, "predictions")
    artifacts.write_predictions(_scored(spark, sf_dir), path)
    risky = spark.read.json(f"{path}/high_risk").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("n")) if spark.read.text(f"{path}/high_risk").count() else spark.createDataFrame([], "doc_id string, n int")
    rows = tables.read_csv(spark, f"{path}/predictions_csv").select("doc_id", "probabilities")
    return rows.join(risky, "doc_id", "left").groupBy("doc_id", "probabilities").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("int").alias("lines"))


@query(_CONF + " SELECT 'true_' || t AS true_label, CAST(sum(n) FILTER (p = 'maybe') AS VARCHAR) AS pred_maybe, CAST(sum(n) FILTER (p = 'no') AS VARCHAR) AS pred_no, CAST(sum(n) FILTER (p = 'yes') AS VARCHAR) AS pred_yes FROM m GROUP BY t")
def testing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion matrix of a test run, from its file."""
    path = scratch(spark, "testing")
    artifacts.write_testing(_scored(spark, sf_dir), path)
    return tables.read_csv(spark, f"{path}/confusion_matrix")


@query("""WITH i AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders), g AS (SELECT id, 'org_' || ((row_number() OVER (ORDER BY sha256('42|' || id), id) - 1) % 4 + 1) AS org FROM i)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unassigned' ELSE org END AS part FROM orders JOIN g ON g.id = CAST(o_custkey AS VARCHAR)""")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the folders of their organisations."""
    o, path = table(spark, sf_dir, "orders"), scratch(spark, "split")
    rows = o.select(F.col("o_orderkey").alias("row"), F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey").cast("string")).otherwise("none").alias("normalized_id"))
    owners = orgs.org_of_ids(o.select(F.col("o_custkey").cast("string").alias("normalized_id")), 4)
    artifacts.write_split(rows, rows.select("row", "key"), orgs.split_rows(rows, owners, "row"), "row", path)
    return spark.read.option("header", True).csv(f"{path}/raw").select(F.col("key").cast("long").alias("o_orderkey"), "part")


@query("""WITH i AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders), g AS (SELECT id, 'org_' || ((row_number() OVER (ORDER BY sha256('42|' || id), id) - 1) % 4 + 1) AS org FROM i),
r AS (SELECT a.org AS x, b.org AS y FROM orders LEFT JOIN g a ON a.id = CAST(o_custkey AS VARCHAR) LEFT JOIN g b ON b.id = CAST(o_custkey + o_orderkey % 3 AS VARCHAR))
SELECT CASE WHEN y IS NULL OR x = y THEN x END AS org, CASE WHEN y IS NULL OR x = y THEN 'kept' ELSE 'inter_org' END AS fate, count(*) AS rows FROM r GROUP BY ALL""")
def split_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by organisation and fate, with ids in all four columns."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", c.cast("string").alias("normalized_id"), (c + k % 3).cast("string").alias("entity_id"), F.lit(" NaN").alias("source_entity_id"), F.concat(F.lit(" "), c.cast("string")).alias("target_entity_id"))
    return orgs.split_summary(orgs.split_rows(o, orgs.org_of_ids(o, 4), "o_orderkey"))


@query(_SIDES_SQL + "SELECT *, test_count - in_both AS only_in_test, truth_count - in_both AS only_in_truth FROM c")
def comparison_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison of indicators, from its file."""
    path, compared = scratch(spark, "comparison"), _compared(spark, sf_dir)
    artifacts.write_comparison(compared, indicators.quality(compared), path)
    return tables.read_jsonl(spark, f"{path}/by_type", compared.schema)


@query(_IOC_SQL + "SELECT indicator_type, CAST(count(*) AS VARCHAR) AS count FROM i GROUP BY indicator_type")
def indicator_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type of the indicators of pages, from the file beside bundle and records."""
    path = scratch(spark, "indicators")
    p = table(spark, sf_dir, "pages").select(F.lit(0).alias("org_index"), F.col("page_id").alias("row_index"), F.col("url"))
    risky = p.select("org_index", "row_index", orgs.internal_id(F.lit(0), F.col("row_index")).alias("internal_log_id"), F.lit("x").alias("predicted_label"), F.lit(0.9).alias("max_risk_probability"), F.col("row_index").alias("order"))
    artifacts.write_indicators(indicators.records(risky, p), path)
    return tables.read_csv(spark, f"{path}/summary")


@query("""SELECT org, round(-0.05 * sum(pw * (p - y)) / count(*), 9) AS bias, count(*) AS examples FROM (
  SELECT CAST(user_id % 3 AS VARCHAR) AS org, (event_type = 'error')::INT AS y, 0.5 AS p, CASE WHEN event_type = 'error' THEN 2.0 ELSE 0.5 END AS pw FROM events) GROUP BY org""")
def sgd_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bias after one epoch in one batch from weights of zero, which has a closed form."""
    updates = _one_batch(spark, sf_dir)
    return updates.select("org", F.round("bias", 9).alias("bias"), F.col("examples").alias("examples"))


def _one_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    features = F.array(F.struct((F.col("event_id") % 10).cast("long").alias("gv_index"), F.lit(2.0).alias("value")))
    examples = e.select(F.lit("t").alias("label"), F.lit("s").alias("subcategory"), (F.col("user_id") % 3).cast("string").alias("org"), F.col("event_id").alias("row"), (F.col("event_type") == "error").cast("int").alias("y"), F.lit(2.0).alias("positive_weight"), F.lit(0.5).alias("negative_weight"), features.alias("features"))
    weights = spark.range(10).select(F.lit("t").alias("label"), F.lit("s").alias("subcategory"), F.col("id").alias("gv_index"), F.lit(0.0).alias("weight"))
    biases = spark.createDataFrame([("t", "s", 0.0)], "label string, subcategory string, bias double")
    orgs_ = spark.createDataFrame([(str(k),) for k in range(3)], "org string")
    index = weights.crossJoin(F.broadcast(orgs_)).select("subcategory", "org", "gv_index", F.lit(1.0).alias("idf"))
    return model.train_round(examples, weights, biases, index, batch=1 << 30, ridge=0.01)


@query("""WITH e AS (SELECT CAST(user_id % 3 AS VARCHAR) AS org, event_id % 10 AS gv_index, (event_type = 'error')::INT AS y, CASE WHEN event_type = 'error' THEN 2.0 ELSE 0.5 END AS pw FROM events), n AS (SELECT org, count(*) AS n FROM e GROUP BY org),
u AS (SELECT org, gv_index, -0.05 * sum(2.0 * pw * (0.5 - y)) / any_value(n) AS w FROM e JOIN n USING (org) GROUP BY org, gv_index), o AS (SELECT org, n, gv_index, coalesce(w, 0) AS w FROM n CROSS JOIN (SELECT unnest(range(0, 10)) AS gv_index) LEFT JOIN u USING (org, gv_index))
SELECT gv_index, round(sum(n * w) / sum(n), 9) AS weight FROM o GROUP BY gv_index""")
def sgd_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights after a round of one batch in each of three organisations, averaged by their sizes."""
    weights = spark.range(10).select(F.lit("t").alias("label"), F.lit("s").alias("subcategory"), F.col("id").alias("gv_index"), F.lit(0.0).alias("weight"))
    new, _ = model.averaged(weights, federated.written(_one_batch(spark, sf_dir), "updates"))  # read twice
    return new.select("gv_index", F.round("weight", 9).alias("weight"))


@query(_collapse_sql("event_type || user_id % 3", "event_id", 900_000_000).replace("greatest(t, coalesce(p, t)) AS m", "t AS m").replace("SELECT k AS grp, min(r)", "SELECT k AS key, min(r)").replace("AS source_row_number_first", "AS first_row").replace("AS source_row_number_last", "AS last_row").replace("CASE WHEN count(*) > 1 THEN 'aggregated' ELSE 'individual' END AS aggregation_status, issue AS aggregation_issue", "issue IS NOT NULL AS out_of_order"))
def stream_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream in one micro-batch after the other until none is left; groups go out when they close or the stream does."""
    e = table(spark, sf_dir, "events").select(F.concat("event_type", (F.col("user_id") % 3).cast("string")).alias("grp"), F.col("event_id").alias("r"), F.col("ts").cast("timestamp").alias("ts"))
    source, out = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    last = spark.createDataFrame([("__end", 1 << 50, "2200-01-01 00:00:00")], "grp string, r long, ts string").withColumn("ts", F.to_timestamp("ts"))
    e.coalesce(1).write.parquet(f"{source}/a")
    last.coalesce(1).write.parquet(f"{source}/b")
    events = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").option("latestFirst", "false").option("maxFilesPerTrigger", 1).parquet(source)
    found = collapse_stream(events, "grp", "ts", "r", 15)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    micros = lambda c: F.unix_micros(F.col(c))
    return spark.read.schema(found.schema).parquet(out).where("key <> '__end'").select("key", "first_row", "last_row", "occurrence_count", micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"), "out_of_order")

"""What runs leave behind: predictions, test reports, splits, indicators, comparisons, summaries, novelty baselines.

Tables go through Spark's commit protocol.  A single document (a summary, a manifest) is a line of JSON with
sorted keys in a folder of its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import metrics
from marlstone.operators.indicators import bundle, counts
from marlstone.sources.sinks import flat, write_bundle, write_csv, write_json

BASELINE_VERSION = 1


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder of the session; a local session without one gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_document(spark: SparkSession, document: Mapping, path: str) -> None:
    spark.createDataFrame([(json.dumps(document, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    row = spark.read.text(path).first()
    if row is None:
        raise ValueError(f"{path} is empty")
    return json.loads(row[0])


def write_baseline(tags: DataFrame, path: str, rows: DataFrame | None = None) -> None:
    """Tags of benign values as lines (org_index, kind, tag) in their order, partitioned by organisation, with the number of benign rows beside them."""
    tags.repartition("org_index").sortWithinPartitions("org_index", "kind", "tag").write.mode("overwrite").partitionBy("org_index").json(f"{path}/tags")
    numbers = {str(r["org_index"]): r["n"] for r in rows.collect()} if rows is not None else {}  # one row an organisation
    write_document(tags.sparkSession, {"version": BASELINE_VERSION, "benign_rows": numbers}, f"{path}/head")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(org_index, kind, tag); another version or a tag that is none is an error."""
    head = read_document(spark, f"{path}/head")
    if head.get("version") != BASELINE_VERSION:
        raise ValueError(f"unknown baseline version {head.get('version')!r}")
    tags = spark.read.schema("kind string, tag string, org_index string").json(f"{path}/tags")
    good = F.col("tag").rlike("^[0-9a-f]{64}$") & F.col("kind").isNotNull()
    return tags.select("org_index", "kind", F.when(good, F.col("tag")).otherwise(F.raise_error(F.lit("a tag of the baseline is malformed")).cast("string")).alias("tag"))


def write_summary(summary: DataFrame, path: str, collapsed: int = 0) -> dict:
    """Totals and counts by reason, from ``policy.summary``; returns what is written."""
    rows = summary.collect()  # one row a reason
    total, forwarded = sum(r["n"] for r in rows), sum(r["forwarded"] for r in rows)
    out = {"total_rows": total, "forwarded_rows": forwarded, "suppressed_rows": total - forwarded, "suppressed_share": (total - forwarded) / total if total else 0.0, "collapsed_rows": collapsed, "rows_by_reason": {r["reason_code"]: r["n"] for r in rows}}
    write_document(summary.sparkSession, out, path)
    return out


def write_predictions(predictions: DataFrame, path: str, explanations: DataFrame | None = None) -> None:
    """All predictions as CSV (nested values as JSON, columns in the order of their names) and as lines, the high-risk ones as lines, and the explanations."""
    write_csv(flat(predictions), f"{path}/predictions_csv")
    write_json(predictions, f"{path}/predictions")
    write_json(predictions.where("is_high_risk"), f"{path}/high_risk")
    if explanations is not None:
        write_json(explanations, f"{path}/explanations")


def report_text(report: DataFrame) -> DataFrame:
    """The report as lines of text: classes in order, then the averages."""
    last = F.array_position(F.array(F.lit("accuracy"), F.lit("macro avg"), F.lit("weighted avg")), F.col("label"))
    shown = F.format_string("%-24s %9.4f %9.4f %9.4f %9d", "label", "precision", "recall", "f1", "support")
    return report.select(last.alias("k"), "label", shown.alias("value")).orderBy("k", "label").select("value")  # a few lines


def write_testing(scored: DataFrame, path: str, true: str = "label", predicted: str = "predicted_label", explanations: DataFrame | None = None) -> None:
    """Predictions, confusion matrix (``true_*`` by ``pred_*``), metrics and a text report of labelled rows."""
    matrix = metrics.confusion(scored, true, predicted)
    classes = sorted(r[0] for r in matrix.select("true_label").distinct().collect())  # the classes
    report = metrics.report(matrix)
    write_predictions(scored, path, explanations)
    write_csv(metrics.confusion_wide(matrix, classes).coalesce(1), f"{path}/confusion_matrix")
    write_json(report.coalesce(1), f"{path}/metrics")
    report_text(report).coalesce(1).write.mode("overwrite").text(f"{path}/report")


def write_split(rows: DataFrame, truth: DataFrame, split: DataFrame, row: str, path: str, seed: int = 42) -> dict:
    """Raw rows and ground truth of each organisation, of rows between organisations and of unassigned ones, and an account of them all.

    ``split`` has (row, org, fate) of ``orgs.split_rows``.
    """
    place = F.coalesce("org", "fate").alias("part")
    own = split.select(row, place, "fate")
    for name, df in (("raw", rows), ("groundtruth", truth)):
        df.join(own.select(row, "part"), row).repartition("part", F.floor(F.col(row) / 1_000_000)).sortWithinPartitions(row).drop(row).write.mode("overwrite").partitionBy("part").option("header", True).option("escape", '"').csv(f"{path}/{name}")
    by = {(r["part"], r["fate"]): r["n"] for r in own.groupBy("part", "fate").agg(F.count("*").alias("n")).collect()}  # one row an organisation
    total = rows.count()
    kept = {p: n for (p, f), n in by.items() if f == "kept"}
    out = {"total_rows": total, "seed": seed, "rows_by_organisation": kept, "inter_org_rows": by.get(("inter_org", "inter_org"), 0), "unassigned_rows": by.get(("unassigned", "unassigned"), 0), "all_accounted": sum(by.values()) == total}
    write_document(rows.sparkSession, out, f"{path}/summary")
    return out


def write_indicators(found: DataFrame, path: str) -> None:
    """STIX bundle, records and counts by type of ``indicators.records``."""
    write_bundle(bundle(found), f"{path}/bundle")
    write_csv(found.orderBy("indicator_id", "internal_log_id"), f"{path}/records")
    write_csv(counts(found).orderBy("indicator_type").coalesce(1), f"{path}/summary")


def comparison_table(compared: DataFrame) -> DataFrame:
    """Lines of text: a head, a line for each type in order, and the totals."""
    line = lambda name: F.format_string("%-24s %10d %10d %10d %12d %12d", name, "test_count", "truth_count", "in_both", "only_in_test", "only_in_truth")
    numbers = ("test_count", "truth_count", "in_both", "only_in_test", "only_in_truth")
    total = compared.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers)).select(F.lit(2).alias("k"), F.lit("").alias("t"), line(F.lit("all")).alias("value"))
    each = compared.select(F.lit(1).alias("k"), F.col("indicator_type").alias("t"), line(F.col("indicator_type")).alias("value"))
    head = compared.sparkSession.createDataFrame([(0, "", "%-24s %10s %10s %10s %12s %12s" % ("type", "test", "truth", "both", "only test", "only truth"))], "k int, t string, value string")
    return head.unionByName(each).unionByName(total).orderBy("k", "t").select("value")


def write_comparison(compared: DataFrame, quality: DataFrame, path: str) -> None:
    write_json(compared.orderBy("indicator_type").coalesce(1), f"{path}/by_type")
    write_json(quality.coalesce(1), f"{path}/overall")
    comparison_table(compared).coalesce(1).write.mode("overwrite").text(f"{path}/table")


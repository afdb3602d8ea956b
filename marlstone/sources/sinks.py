"""Writers: forwarded rows, anomalies, predictions, STIX bundles and model artifacts.

All go through Spark's commit protocol: files appear when the job has succeeded.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import guarded
from marlstone.operators.indicators import stix_id


def forwarded_columns(df: DataFrame, original: list[str], extra: list[str] = ()) -> DataFrame:
    """Metadata first (guarded against spreadsheet formulas), then the original columns, untouched."""
    d = F.col("decision")
    renamed = [("action", "filter_action"), ("reason_code", "filter_reason"), ("reason_details", "filter_reason_details"), ("category", "evaluated_category"), ("matched_policy_id", "matched_policy_id")]
    own = [c for c in ("source_file", "source_row_number", "source_line_number", *extra) if c in df.columns]
    meta = [*(guarded(F.col(c).cast("string")).alias(c) for c in own), *(guarded(F.coalesce(d[a], F.lit(""))).alias(b) for a, b in renamed)]
    return df.select(*meta, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in original if c not in own))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_anomalies(scored: DataFrame, path: str) -> None:
    """Anomalies only, evidence as JSON."""
    write_csv(scored.where("is_anomaly").withColumn("evidence", F.to_json("evidence")), path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON and columns in order of their names, for CSV."""
    return df.select(*(F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(c) for c in sorted(df.columns)))


def write_bundle(objects: DataFrame, path: str) -> None:
    """Indicators as lines in the order of their ids, and beside them the bundle's head, whose id names them all."""
    objects.orderBy("indicator_id").select(F.col("object").alias("value")).write.mode("overwrite").text(f"{path}/objects")
    ids = objects.agg(F.concat_ws("|", F.array_sort(F.collect_list("indicator_id"))).alias("ids"))
    ids.select(F.to_json(F.struct(F.lit("bundle").alias("type"), stix_id("bundle", F.col("ids")).alias("id"))).alias("value")).write.mode("overwrite").text(f"{path}/bundle")


def save_model(path: str, manifest: dict, **tables: DataFrame) -> None:
    """Parquet tables and a manifest; state is partitioned by label and subcategory where it has them."""
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        by = [c for c in ("label", "subcategory") if c in df.columns]
        (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(f"{path}/{name}")
    text = json.dumps(manifest | {"version": 1, "tables": sorted(tables)}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_model(spark: SparkSession, path: str, expect: dict | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """(manifest, tables); what ``expect`` names must agree, weights must be finite and lie on the axis."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest.get("version") != 1:
        raise ValueError(f"unknown version {manifest.get('version')!r}")
    for k, v in (expect or {}).items():
        if manifest.get(k) != v:
            raise ValueError(f"{k}: {manifest.get(k)!r} was saved, {v!r} is expected")
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in manifest["tables"]}
    if "weights" in tables:
        w = tables["weights"]
        if not w.where("weight is null or isnan(weight) or abs(weight) = double('Infinity')").isEmpty():
            raise ValueError("a weight is not finite")
        if "axis" in tables and not w.join(tables["axis"], "gv_index", "left_anti").isEmpty():
            raise ValueError("a weight lies outside the axis")
    return manifest, tables

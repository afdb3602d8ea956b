"""Confusion matrices and precision, recall and F1 with zero where there is nothing to divide by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """(true_label, predicted_label, n) for all pairs of classes, zeros too."""
    counts = df.groupBy(F.col(true).alias("true_label"), F.col(predicted).alias("predicted_label")).agg(F.count("*").alias("n"))
    classes = counts.select(F.col("true_label").alias("c")).union(counts.select("predicted_label")).where("c is not null").distinct()
    pairs = classes.select(F.col("c").alias("true_label")).crossJoin(classes.select(F.col("c").alias("predicted_label")))  # classes squared
    return pairs.join(counts, ["true_label", "predicted_label"], "left").select("true_label", "predicted_label", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_wide(matrix: DataFrame, classes: list[str]) -> DataFrame:
    """One row a true class, one column a predicted one."""
    return matrix.groupBy("true_label").pivot("predicted_label", classes).agg(F.sum("n")).withColumnsRenamed({c: f"pred_{c}" for c in classes}).withColumn("true_label", F.concat(F.lit("true_"), F.col("true_label")))


def report(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support): each class, then ``accuracy``, ``macro avg`` and ``weighted avg``; per-class accuracy is the recall."""
    flat = matrix.select(F.inline(F.array(F.struct(F.col("true_label").alias("label"), F.col("n").alias("support"), F.lit(0).alias("found")), F.struct(F.col("predicted_label").alias("label"), F.lit(0).alias("support"), F.col("n").alias("found")))), F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0).alias("hit"))
    by = flat.groupBy("label").agg(F.sum("support").alias("support"), F.sum("found").alias("found"), (F.sum("hit") / 2).alias("hit"))
    p, r = ratio(F.col("hit"), F.col("found")), ratio(F.col("hit"), F.col("support"))
    each = by.select("label", p.alias("precision"), r.alias("recall"), "support", "hit").withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    measures = ["precision", "recall", "f1"]
    macro = each.agg(*(F.avg(m).alias(m) for m in measures), F.sum("support").alias("support")).withColumn("label", F.lit("macro avg"))
    weighted = each.agg(*(ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures), F.sum("support").alias("support")).withColumn("label", F.lit("weighted avg"))
    accuracy = each.agg(ratio(F.sum("hit"), F.sum("support")).alias("precision"), F.sum("support").alias("support")).select(F.lit("accuracy").alias("label"), "precision", F.col("precision").alias("recall"), F.col("precision").alias("f1"), "support")
    names = ["label", *measures, "support"]
    return each.select(*names).unionByName(accuracy).unionByName(macro.select(*names)).unionByName(weighted.select(*names)).withColumn("support", F.col("support").cast("long"))

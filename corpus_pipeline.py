"""A corpus pipeline: quality, near duplicates, repeated passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet to the shared folder and read again as the next one's documents.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import ngram_join, packing, quality_classifier, secret_scan, suffix_dedup
from marlstone.llm.store import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null texts and texts without words are rejected; rows without a doc_id and repeated rows are scored each."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id.

    Rows without a doc_id and texts without words stay; a row that repeats another stays once."""
    return ngram_join.one_per_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of passages of 50 words or more are cut out.

    Null and empty texts, and rows without a doc_id, stay as they are; a document of which nothing is left goes."""
    return suffix_dedup.without_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """Secrets are replaced by the name of the rule that found them; ``ledger`` is the folder of what was scanned before.

    Null and empty texts stay as they are, and so do all rows and the other columns."""
    return secret_scan.redacted(docs, secret_scan.Ledger(spark, ledger))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each document gets its place in a training sequence.

    Null and empty texts have no pieces."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("secret scans", secrets),
    ("best-fit packing", sequences),
]

ORACLE_SQL = None
"""The first stage trains a classifier, which SQL cannot express; tests hold the stages against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the table of documents; an empty table gives no places."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

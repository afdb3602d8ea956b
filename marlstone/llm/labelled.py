"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.store import bounded_batches

SAMPLE = 10_000
"""Labelled documents that a classifier is fitted on, at most; the bound is the ``sample`` parameter of the operators."""


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y): the labelled documents that come first in the order of a hash of doc_id.

    A doc_id labelled both ways and labels other than 0 and 1 are left out; so are documents
    without text.  Of rows that repeat a doc_id the smallest text is used.  An empty table gives an empty sample.
    """
    bounded_batches(docs.sparkSession)
    y = labels.where(f"doc_id is not null and {target} in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(target).cast("int").alias("y"), F.max(target).cast("int").alias("most")).where("y = most").select("doc_id", "y")
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))  # at most ``sample`` rows are broadcast

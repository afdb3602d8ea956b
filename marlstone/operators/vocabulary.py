"""Token counts, vocabularies of organisations, keyed tags and the global axis they share.

Tables are long: (org, row, token, tf), (org, token, df, position), (tag, index).  Only tags, never
tokens, leave an organisation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.keyed import tag
from marlstone.functions.text import token_counts


SLICES = 64


def term_frequency(df: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """(keys, token, tf) from an array of tokens in each row."""
    return df.select(*keys, F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("tf"))


def text_frequency(df: DataFrame, text: Column, *keys: str) -> DataFrame:
    """(keys, token, tf) of a text column; as ``term_frequency`` of its tokens, but for large texts.

    A row's tokens are counted where it is.  Only rows whose keys occur again (found by a job over the keys) are
    shuffled to be added up.
    """
    again = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*(F.col(k).alias(f"__{k}") for k in keys))
    if again.isEmpty():
        return token_counts(df, text, *keys)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    added = token_counts(df.join(again, same, "left_semi"), text, *keys).groupBy(*keys, "token").agg(F.sum("tf").alias("tf"))
    return token_counts(df.join(again, same, "left_anti"), text, *keys).unionByName(added)


def document_frequency(tf: DataFrame, *org: str) -> DataFrame:
    """(org, token, df): rows that have a token."""
    return tf.groupBy(*org, "token").agg(F.count("*").alias("df"))


def most_df(max_df: float, documents: Column) -> Column:
    """Upper bound of the band: a share of the documents, at least one, or a number of them."""
    if max_df <= 0:
        raise ValueError("max_df must be positive")
    return F.greatest(F.lit(1), F.floor(F.lit(max_df) * documents)) if max_df <= 1 else F.lit(int(max_df))


def local_vocabulary(df: DataFrame, documents: DataFrame, features: int, min_df: int = 2, max_df: float = 0.95, org: str = "org") -> DataFrame:
    """(org, token, df, position, used_fallback): the ``features`` most frequent tokens within the band, ties by token.

    Where the band holds fewer than could be had, it is opened to all.  ``documents`` has (org, n).
    """
    if features <= 0 or min_df < 1:
        raise ValueError("features and min_df must be 1 or more")
    order = [F.desc("df"), F.asc("token")]
    wide = df.join(F.broadcast(documents), org)  # one row an organisation
    wide = wide.withColumn("__in", (F.col("df") >= min_df) & (F.col("df") <= most_df(max_df, F.col("n"))))
    enough = wide.groupBy(org).agg((F.count_if("__in") < F.least(F.lit(features), F.count("*"))).alias("used_fallback"))
    kept = wide.join(F.broadcast(enough), org).where(F.col("__in") | F.col("used_fallback"))
    # the best of each slice of an organisation first, so no task ranks all its tokens
    kept = kept.withColumn("__slice", F.pmod(F.xxhash64("token"), F.lit(SLICES)))
    best = kept.withColumn("__r", F.row_number().over(Window.partitionBy(org, "__slice").orderBy(*order))).where(F.col("__r") <= features)
    ranked = best.withColumn("position", F.row_number().over(Window.partitionBy(org).orderBy(*order)) - 1)
    return ranked.where(F.col("position") < features).select(org, "token", "df", "position", "used_fallback")


def idf(df: DataFrame, documents: DataFrame, org: str = "org") -> DataFrame:
    """Add ``idf = ln((1 + max(1, n)) / (1 + df)) + 1``."""
    return df.join(F.broadcast(documents), org).withColumn("idf", F.log((1 + F.greatest(F.lit(1), F.col("n"))) / (1 + F.col("df"))) + 1).drop("n")


def tagged(vocabulary: DataFrame, key: bytes, kind: str) -> DataFrame:
    """Add each token's keyed tag; different tokens are hashed once each."""
    tokens = vocabulary.select("token").distinct().withColumn("tag", tag(key, kind, F.col("token")))
    return vocabulary.join(tokens, "token")


def global_axis(tags: DataFrame) -> DataFrame:
    """(tag, gv_index): the sorted union of all tags.

    Ranks are made within ranges of tags (by their first three digits) and shifted by the ranges'
    counts, so no task sees all tags.
    """
    every = tags.select("tag").distinct().withColumn("__part", F.substring("tag", 1, 3))
    sizes = every.groupBy("__part").agg(F.count("*").alias("__n"))
    shift = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__shift"))  # 4096 rows
    ranked = every.withColumn("__r", F.row_number().over(Window.partitionBy("__part").orderBy("tag")) - 1)
    return ranked.join(F.broadcast(shift), "__part").select("tag", (F.col("__r") + F.col("__shift")).cast("long").alias("gv_index"))


def index_vectors(vocabulary: DataFrame, axis: DataFrame) -> DataFrame:
    """Each organisation's tokens with their places on the global axis."""
    return vocabulary.join(axis, "tag")


def features(tf: DataFrame, axis: DataFrame, key: bytes, kind: str) -> DataFrame:
    """(…, gv_index, value): counts on the global axis, by tag; tokens without a place are dropped, those only other organisations have are not."""
    tokens = tf.select("token").distinct().withColumn("tag", tag(key, kind, F.col("token"))).join(axis, "tag").select("token", "gv_index")
    return tf.join(tokens, "token").drop("token").withColumnRenamed("tf", "value")

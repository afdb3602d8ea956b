"""Split rows among organisations by the ids they refer to, and align tables row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import clean_id

ID_COLUMNS = ("normalized_id", "entity_id", "source_entity_id", "target_entity_id")


def org_of_ids(df: DataFrame, orgs: int, seed: int = 42, column: str = "normalized_id") -> DataFrame:
    """(id, org): different ids dealt round-robin in the order of a seeded hash, so organisations differ by one id at most.

    Ranks are made within ranges of the hash and shifted by their counts.
    """
    if orgs < 1:
        raise ValueError("there must be an organisation")
    ids = df.select(clean_id(F.col(column).cast("string")).alias("id")).where("id is not null").distinct()
    ids = ids.withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}|"), F.col("id")), 256)).withColumn("__part", F.substring("__h", 1, 3))
    sizes = ids.groupBy("__part").agg(F.count("*").alias("__n"))
    shift = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__shift"))  # 4096 rows
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("__h", "id")) - 1 + F.col("__shift")
    return ids.join(F.broadcast(shift), "__part").select("id", F.concat(F.lit("org_"), ((rank % orgs) + 1).cast("string")).alias("org"))


def split_rows(df: DataFrame, owners: DataFrame, row: str, columns: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """(row, org, fate): ``kept`` where the row's ids belong to one organisation, ``inter_org`` with several, ``unassigned`` with none."""
    here = [c for c in columns if c in df.columns]
    if not here:
        return df.select(row, F.lit(None).cast("string").alias("org"), F.lit("unassigned").alias("fate"))
    ids = df.select(row, F.explode(F.array_distinct(F.array_compact(F.array(*(clean_id(F.col(f"`{c}`").cast("string")) for c in here))))).alias("id"))
    found = ids.join(owners, "id").groupBy(row).agg(F.min("org").alias("__a"), F.max("org").alias("__b"))
    out = df.select(row).join(found, row, "left")
    same = F.col("__a") == F.col("__b")
    return out.select(row, F.when(same, F.col("__a")).alias("org"), F.when(F.col("__a").isNull(), "unassigned").when(same, "kept").otherwise("inter_org").alias("fate"))


def split_summary(split: DataFrame) -> DataFrame:
    return split.groupBy("org", "fate").agg(F.count("*").alias("rows"))


def zipped(left: DataFrame, right: DataFrame, row: str) -> DataFrame:
    """Rows of two tables with the same number; a number that only one of them has is an error."""
    right = right.withColumn("__r", F.lit(True))
    out = left.withColumn("__l", F.lit(True)).join(right, row, "full_outer")
    wrong = F.col("__l").isNull() | F.col("__r").isNull()
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("row counts differ at row "), F.col(row).cast("string"))).cast(left.schema[row].dataType)).otherwise(F.col(row))
    return out.withColumn(row, checked).drop("__l", "__r")


def label_column(columns: Sequence[str], wanted: str | None = None) -> str:
    """The column asked for, or the only one, or ``label``."""
    if wanted:
        if wanted in columns:
            return wanted
    elif len(columns) == 1:
        return columns[0]
    elif "label" in columns:
        return "label"
    raise ValueError(f"no label column among {list(columns)}")


def text_columns(columns: Sequence[str], wanted: Sequence[str] | None = None) -> list[str]:
    """The columns asked for, or the first usual one, or all."""
    if wanted:
        if absent := [c for c in wanted if c not in columns]:
            raise ValueError(f"columns that are not there: {absent}")
        return list(wanted)
    return next(([c] for c in ("message", "log", "raw_log", "text") if c in columns), list(columns))


def source_id_column(columns: Sequence[str]) -> str | None:
    low = {c.lower(): c for c in reversed(columns)}
    return next((low[c] for c in ("log_id", "logid", "event_id", "id") if c in low), None)


def internal_id(org: Column, row: Column) -> Column:
    return F.format_string("org_%s_row_%s", org.cast("string"), row.cast("string"))

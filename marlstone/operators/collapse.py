"""Collapse repeated events into windows anchored at the first occurrence.

Rows of a key, in input order, join the open group while they lie within the window of its
first event and no event of the whole input so far lies beyond it (groups close when time has
passed, whatever key moved it).  A row earlier than its key's last one is late and goes out alone;
so does one without a valid time.

Layout.  The running maximum over the input is made in two levels: a maximum for each block of
rows, a prefix over the blocks (one short row each), then a window within each block.  The
keys are shuffled and sorted once; late rows are found by a running maximum, carried from batch to batch.  What is left is
non-decreasing in both time and running maximum, so a group ends at the first row where the larger of the two
passes the group's end: a binary search, made for all the keys of a batch together in numpy, with the
open group carried from batch to batch.  A key of any number of rows needs constant memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import compact_ranges, utc_text

BLOCK = 1 << 17
FEW = 256


def running_max(df: DataFrame, file: str, row: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """Add the maximum of a value over all the earlier rows, in the order of (file, row)."""
    cut = F.floor(F.col(row) / block)
    blocks = df.groupBy(F.col(file).alias("__bfile"), cut.alias("__block")).agg(F.max(value).alias("__top"))
    before = Window.orderBy("__bfile", "__block").rowsBetween(Window.unboundedPreceding, -1)  # one row for ``block`` rows of input
    blocks = blocks.select("__bfile", "__block", F.max("__top").over(before).alias("__before"))
    within = Window.partitionBy(file, "__b").orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    wide = df.withColumn("__b", cut)
    wide = wide.join(blocks, (F.col(file).eqNullSafe(F.col("__bfile"))) & (F.col("__b") == F.col("__block"))).drop("__bfile", "__block")
    return wide.withColumn(name, F.greatest("__before", F.max(value).over(within))).drop("__b", "__before")


def anchors(key: np.ndarray, time: np.ndarray, top: np.ndarray, window: int, carry: tuple | None) -> tuple[np.ndarray, tuple]:
    """Index of the first row of each row's group; -1 for the group that ``carry`` (key, first time) holds open.

    Rows come sorted by key and order; ``top`` is non-decreasing within a key.
    """
    n = len(key)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.append(edge[1:], n)
    out = np.empty(n, np.int64)
    now, stop, limit = edge.copy(), end, time[edge] + window
    first = edge.copy()
    if carry is not None and key[0] == carry[0]:
        first[0], limit[0] = -1, carry[1] + window
    opened = carry[1] if carry is not None and key[0] == carry[0] else None
    while len(now):
        if len(now) <= FEW:  # rounds over a few keys gain nothing: one search after the other
            for k in range(len(now)):
                at, end_, head, until = int(now[k]), int(stop[k]), int(first[k]), int(limit[k])
                own, own_time = top[:end_], time
                while at < end_:
                    low = at + int(own[at:].searchsorted(until, "right"))
                    low = max(low, at + 1) if head >= 0 else low
                    out[at:low] = head
                    at = head = low
                    if at < end_:
                        until = int(own_time[at]) + window
            break
        low, high = now.copy(), stop.copy()
        while (gap := low < high).any():  # first row beyond the limit
            mid = (low + high) >> 1
            inside = gap & (top[np.minimum(mid, n - 1)] <= limit)
            low = np.where(inside, mid + 1, low)
            high = np.where(gap & ~inside, mid, high)
        low = np.where(first >= 0, np.maximum(low, now + 1), low)  # a new group has its first row
        for_each = np.repeat(first, low - now)
        at = np.repeat(now - np.concatenate([[0], np.cumsum(low - now)[:-1]]), low - now) + np.arange((low - now).sum())
        out[at] = for_each
        rest = low < stop
        now, stop = low[rest], stop[rest]
        first, limit = now.copy(), time[np.minimum(now, n - 1)] + window
    last = out[-1]
    return out, (key[-1], int(time[last]) if last >= 0 else opened)


def late_rows(key: np.ndarray, time: np.ndarray, carry: tuple | None) -> tuple[np.ndarray, tuple]:
    """Which rows are earlier than one of their key before; ``carry`` is (key, latest time) of the rows so far."""
    n = len(key)
    part = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    values, rank = np.unique(time, return_inverse=True)
    rank = part * len(values) + rank  # grows from key to key, so one running maximum serves all
    top = np.maximum.accumulate(rank)
    out = rank < top
    latest = int(values[top[-1] % len(values)])
    if carry is not None and key[0] == carry[0]:
        out |= (part == 0) & (time < carry[1])
        latest = max(latest, carry[1]) if part[-1] == 0 else latest
    return out, (key[n - 1], latest)


def _anchored(window: int):
    """Adds ``anchor_file``, ``anchor_row`` and ``__late``; columns: key, file, row, time, top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = held = latest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, at = batch.schema.names, {c: i for i, c in enumerate(batch.schema.names)}
            key = batch.column(at["__key"]).to_numpy(zero_copy_only=False)
            time, top = (batch.column(at[c]).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("__time", "__top"))
            late, latest = late_rows(key, time, latest)
            good, own = np.flatnonzero(~late), np.arange(batch.num_rows)
            if len(good):
                first, carry = anchors(key[good], time[good], top[good], window, carry)
                own[good] = np.where(first < 0, -1, good[first])
            file, row = batch.column(at["__file"]), batch.column(at["__row"])
            source = pa.array(np.maximum(own, 0))
            files, rows = file.take(source).to_pylist(), row.take(source).to_pylist()
            for i in np.flatnonzero(own < 0):
                files[i], rows[i] = held
            if len(good):
                held = (files[good[-1]], rows[good[-1]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(files, file.type), pa.array(rows, pa.int64()), pa.array(late)], names=[*names, "anchor_file", "anchor_row", "__late"])

    return run


def collapse(df: DataFrame, key: list[Column], time: str, file: str | Column, row: str, window_minutes: float = 15, issue: str | None = None, line: str | None = None, global_flush: bool = True) -> DataFrame:
    """One row for each group of equal events, with the columns of the first.

    ``time`` names a timestamp column, null where it is invalid (``issue`` may name a column that
    says why), ``row`` one with the rows' order within a file.  Adds key columns as
    the first row has them and source_row_number_first, _last, source_row_numbers (and the same for
    lines), occurrence_count, first_seen, last_seen, aggregation_status and aggregation_issue.
    Without ``global_flush`` only the key's own events close its groups, which saves the running maximum.
    """
    if window_minutes <= 0:
        raise ValueError("the window must be positive")
    columns, micros = df.columns, int(window_minutes * 60_000_000)
    file = F.lit(file) if isinstance(file, str) and file not in columns else F.col(file) if isinstance(file, str) else file
    identity = F.unhex(F.sha2(F.to_json(F.struct(F.struct(file.alias("f")), *(k.cast("string").alias(f"k{i}") for i, k in enumerate(key))), {"ignoreNullFields": "false"}), 256))
    wide = df.select(F.struct("*").alias("__first"), identity.alias("__key"), file.cast("string").alias("__file"), F.col(row).cast("bigint").alias("__row"), F.unix_micros(F.col(time).cast("timestamp")).alias("__time"), *([F.col(line).cast("bigint").alias("__line")] if line else []))
    if global_flush:
        wide = running_max(wide, "__file", "__row", "__time", "__seen")
    else:
        wide = wide.withColumn("__seen", F.lit(None).cast("bigint"))
    good = wide.where("__time is not null").withColumn("__top", F.greatest("__time", "__seen"))
    good = good.repartition("__key").sortWithinPartitions("__key", "__file", "__row")
    schema = T.StructType([*good.schema, T.StructField("anchor_file", T.StringType()), T.StructField("anchor_row", T.LongType()), T.StructField("__late", T.BooleanType())])
    good = good.mapInArrow(_anchored(micros), schema).drop("__top").withColumn("__alone", F.col("__late"))
    alone = wide.where("__time is null").withColumns({"anchor_file": F.col("__file"), "anchor_row": F.col("__row"), "__late": F.lit(False), "__alone": F.lit(True)})
    both = good.unionByName(alone.select(*good.columns))
    ranges = {"row": F.col("__row"), **({"line": F.col("__line")} if line else {})}
    aggregates = [F.min_by("__first", F.col("__row")).alias("__first")]
    for name, c in ranges.items():
        aggregates += [F.min(c).alias(f"source_{name}_number_first"), F.max(c).alias(f"source_{name}_number_last"), compact_ranges(F.collect_list(c)).alias(f"source_{name}_numbers")]
    aggregates += [F.count("*").alias("occurrence_count"), F.min("__time").alias("__low"), F.max("__time").alias("__high")]
    out = both.groupBy("__key", "anchor_file", "anchor_row", "__alone", "__late").agg(*aggregates)
    why = F.when(F.col("__low").isNull(), F.concat(F.lit("AGGREGATION_TIMESTAMP_"), F.coalesce(F.col("__first")[issue] if issue else F.lit(None), F.lit("INVALID")))).when(F.col("__late"), "AGGREGATION_OUT_OF_ORDER_TIMESTAMP")
    added = [c for c in out.columns if c.startswith(("source_", "occurrence"))]
    seen_text = [utc_text(F.timestamp_micros(c)).alias(n) for c, n in (("__low", "first_seen"), ("__high", "last_seen"))]
    status = F.when(F.col("occurrence_count") > 1, "aggregated").otherwise("individual").alias("aggregation_status")
    return out.select(*(F.col("__first")[c].alias(c) for c in columns), *added, *seen_text, status, why.alias("aggregation_issue"))

"""Best-fit packing of documents into training sequences of a fixed number of words.

A document longer than a sequence is cut into whole sequences and a rest; then
pieces go, largest first, each into the sequence with the smallest gap that
holds it (ties: the sequence opened first), and into a new one if none does.

The method is bulk-synchronous.  Pieces are range-sorted by (length descending,
doc_id, piece) in Spark, where each gets its rank among the pieces of its
length.  A round matches all pieces of one length at once: the open gaps, sorted by
room, are swept from the successor of that length upwards; the pieces that want
the same gap are told apart by rank (a gap of room u takes the next ``u // v`` of
them, which is what best fit does one by one); the gaps are updated and the next
round begins.  Gaps are held as runs of sequences with the same room and lengths as
counts, so a round's state depends on the sequence length, not on the
corpus, and the driver sees a few numbers for each length and partition.  Then every
partition of pieces finds its places by one sorted search (the successor
among the runs), without another shuffle.

Pieces of equal length go by (doc_id, piece), and of gaps with equal room the sequence opened first is filled, so ties
are decided.  A very long text is counted in a slice of its own and becomes as many pieces as it takes.
A null text or one without words has no pieces.  A null doc_id is packed like
others, first among equals.  Rows that repeat are packed once each.  An
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import text as tx
from marlstone.llm.store import trimmed, written

CAPACITY = 2048

_PIECES = "doc_id long, piece int, start_word int, n_words int"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start_word", pa.int32()), ("n_words", pa.int32())])


def _pieces(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tx.text_buffers(batch.column(1))
            counts = [np.zeros(0, np.int64)]
            for i, j in tx.slices(offsets):
                counts.append(tx.Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).counts)
            n = np.concatenate(counts)
            k = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            start = piece * capacity
            size = np.minimum(n[row] - start, capacity)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int32()) for x in (piece, start, size))], schema=_PIECES_ARROW)

    return run


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the rank among the partition's pieces of the same length; rows come sorted by length."""
    from pyspark import TaskContext

    part, size, seen = TaskContext.get().partitionId(), -1, 0
    for batch in batches:
        n = batch.column(3).to_numpy()
        if not len(n):
            continue
        edge = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
        rank = np.arange(len(n)) - np.repeat(edge, np.diff(np.append(edge, len(n))))
        if n[0] == size:
            rank[: edge[1] if len(edge) > 1 else len(n)] += seen
        size, seen = n[-1], int(rank[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(rank)], names=[*batch.schema.names, "part", "rank"])


def best_fit_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Where the pieces of each length go, as rows (length, first rank, first sequence, pieces a sequence, words used before).

    Exactly sequential best fit decreasing, a round for each length.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # room: heap of (first sequence, sequences)
    rooms: list[int] = []
    opened, out = 0, []

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in gaps:
                gaps[room] = []
                insort(rooms, room)
            heapq.heappush(gaps[room], (first, n))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect_left(rooms, size)  # the successor
            if at < len(rooms):
                room = rooms[at]
                first, n = heapq.heappop(gaps[room])
                if not gaps[room]:
                    del gaps[room], rooms[at]
            else:
                room, first, n = capacity, opened, -(-left // (capacity // size))
                opened += n
            each = room // size
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            out.append((size, rank, first, each, capacity - room))
            put(room - each * size, first, full)
            if rest:
                put(room - rest * size, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
            rank += full * each + rest
            left -= full * each + rest
    return np.array(out, np.int64).reshape(-1, 5)


PLACED = "doc_id long, piece int, start_word int, n_words int, sequence long, position int"
_PLACED_ARROW = pa.schema([*_PIECES_ARROW, ("sequence", pa.int64()), ("position", pa.int32())])


def _placed(runs: np.ndarray, firsts: dict[int, tuple[np.ndarray, np.ndarray]]):
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    keys = (runs[:, 0] << 44) + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, part, rank = (batch.column(k).to_numpy().astype(np.int64) for k in (3, 4, 5))
            if not len(size):
                continue
            for p in np.unique(part):
                own = part == p
                sizes, first = firsts[int(p)]
                rank[own] += first[np.searchsorted(sizes, size[own])]
            r = runs[np.searchsorted(keys, (size << 44) + rank, "right") - 1]
            nth = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(r[:, 2] + nth // r[:, 3]), pa.array((r[:, 4] + nth % r[:, 3] * size).astype(np.int32))], schema=_PLACED_ARROW)

    return run


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start_word, n_words, sequence, position) of every piece of every document."""
    if not 0 < capacity < 1 << 19:  # lengths and ranks share 64 bits
        raise ValueError("the capacity must be 1 to 524,287 words")
    spark = docs.sparkSession
    items = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(trimmed(_pieces(capacity)), _PIECES), "pieces")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = [F.desc("n_words"), F.asc_nulls_first("doc_id"), F.asc("piece")]
    ranged = items.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    ranked = written(ranged.mapInArrow(_ranked, f"{_PIECES}, part int, rank long"), "ranked")
    seen: dict[int, int] = {}
    firsts: dict[int, dict[int, int]] = {}
    for r in sorted(ranked.groupBy("part", "n_words").count().collect()):  # partitions in order of range; at most partitions + capacity rows
        firsts.setdefault(r["part"], {})[r["n_words"]] = seen.get(r["n_words"], 0)
        seen[r["n_words"]] = seen.get(r["n_words"], 0) + r["count"]
    runs = best_fit_runs(seen, capacity)
    lookup = {p: (np.array(sorted(f)), np.array([f[s] for s in sorted(f)])) for p, f in firsts.items()}
    return ranked.mapInArrow(_placed(runs, lookup), PLACED)

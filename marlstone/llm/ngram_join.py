"""N-gram Jaccard join: every pair of documents whose sets of word n-grams are alike.

The method is rare-first prefix filtering.  Documents become sets of hashed
lower-case word n-grams; all n-grams are ordered by document frequency, rarest
first; a document can only be like another if they share one of its first
``|x| - ceil(t |x|) + 1`` n-grams.  Length, positional and suffix filters then
thin the candidates, and each pair that is left is verified once.

How that is laid out for Spark:

* *Census.*  Each task turns its documents into chunks and sends every n-gram of
  a chunk once to the n-gram's hash range: six bytes (48 bits of its hash), and two for the document's slot
  in the chunk or, where several documents of the chunk have it, four for their number; their slots then
  stay with the chunk.  However many documents have an n-gram, its range gets one entry a chunk.  There n-grams of one document only
  are found; they can match nothing, so only the others travel back, with their
  document frequency.  N-grams are never a row of their own, and nothing is
  broadcast.  An n-gram is known by 48 bits and the number of its hash range,
  so the number of bits follows the size of the input.
* *Prefixes.*  A document whose prefix has only n-grams of its own is done: this
  is nearly all of a corpus.
* *Groups.*  A prefix n-gram's documents all go to the group of the smallest
  signature among them, so the number of rows stays in proportion to the prefixes
  however long the list is, and two documents that share a prefix n-gram always meet.  A pair
  that meets in several groups counts in the first of them only.  A group
  of more than ``BLOCK`` sets, or of more than ``CELL_GRAMS`` n-grams, is cut into a triangle of cells, which a task takes one
  after the other.
* *Classes.*  Documents with the same n-gram set are one node.  A cell gives each node its number of
  links and one edge to the smallest node that it is connected with there; pairs are
  never a row.  Connected nodes are a class.

Rows without a doc_id and texts without words take no part.  A doc_id that repeats with
another n-gram set is another document; with the same set it is one.  A text of 1 or 2
words has one n-gram, the whole; a very long one is read whole, in a slice of its own.  N-grams of equal frequency go by their hash.  Other columns are ignored.  The input must be deterministic (a table
read from files is), as tasks may run again after an executor is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import text as tx
from marlstone.llm.store import bounded_batches, trimmed, written

CHUNK_GRAMS = 2_000_000
CHUNK_DOCS = 65_535
BLOCK = 1024
CELL_GRAMS = 4_000_000
BROADCAST_BYTES = 64 << 20
RELATION_ROW = 64
"""Bytes that a row of a few numbers takes in a hashed relation, with its slot in the table."""
NGRAM = 3
THRESHOLD = 0.6


def input_parts(df: DataFrame, target: int = 8 << 20) -> int:
    """Partitions for a shuffle that grows with the input: one for ``target`` bytes of it, beyond 16,384 for up to 16 times that, and no fewer than the session's.

    The size is what the planner knows of the files of a plain scan; for other plans, whose
    estimates can be off by any factor, the texts are measured.
    """
    bounded_batches(df.sparkSession)
    plan = df._jdf.queryExecution().optimizedPlan()
    if any(s in plan.toString() for s in ("Join", "LogicalRDD", "Aggregate", "InMemoryRelation", "Generate")):
        size = (df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2
    else:
        size = int(plan.stats().sizeInBytes())
    return int(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // target, 16_384), size // (16 * target)))


def by_id(df: DataFrame, parts: int, column: str) -> DataFrame:
    """Rows to the partition that an integer column names, modulo their number."""
    return df.repartitionById(parts, F.pmod(F.col(column), F.lit(parts)).cast("int"))


def _column(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def gram_sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, distinct n-gram hashes, bounds, signatures of the sets, their sizes) for each slice of a text column."""
    raw, offsets = tx.text_buffers(column)
    for i, j in tx.slices(offsets):
        w = tx.Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        g, b = tx.distinct(*tx.ngrams(w.hashes(), w.bounds, n))
        yield i, j, g, b, tx.set_signatures(g, b), np.diff(b)


_PARTS = ("low", "high", "slots", "dfs", "many", "many_slots", "ids", "rows", "sizes", "sigs")
CENSUS = "part long, chunk long, " + ", ".join(f"{k} binary" for k in _PARTS)
_CENSUS_ARROW = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), *((k, pa.binary()) for k in _PARTS)])


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_column([r[i] for r in rows], f.type) for i, f in enumerate(_CENSUS_ARROW)], schema=_CENSUS_ARROW)


def _range_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.uint16 if parts <= 65536 else np.uint32)


def _identity(low: np.ndarray, high: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    """One 64-bit number of an n-gram from 48 bits of its hash and its range."""
    return tx.mix((low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)) + np.asarray(part).astype(np.uint64) * tx._K1).astype(np.int64)


def _census(sets, parts: int):
    """``sets`` makes (first row, last row, keys, bounds, signatures, sizes) from a text column; the sizes are those of the sets that the keys stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        grams = docs = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, grams, docs, count
            chunk = (task << 24) + count
            h, ids, rows, keys, sigs, size = (np.concatenate([x[c] for x in held]) for c in range(6))
            held, grams, docs, count = [], 0, 0, count + 1
            slot = np.repeat(np.arange(len(keys), dtype=np.uint16), keys)
            order = np.argsort(h, kind="stable")  # ranges are in the order of the hash
            h, slot = h[order], slot[order]
            edge = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), h[1:] != h[:-1]]))
            run = np.diff(np.append(edge, len(h)))
            key, part = h[edge], _range_of(h[edge], parts)
            low, high = key.astype(np.uint32), (key >> np.uint64(32)).astype(np.uint16)
            one = run == 1
            first = slot[edge]
            found, starts = np.unique(part, return_index=True)
            out = []
            for p, a, z in zip(found, starts, np.append(starts[1:], len(part))):
                s, m = one[a:z], ~one[a:z]  # n-grams of one document of the chunk come first
                out.append((int(p), chunk, np.concatenate([low[a:z][s], low[a:z][m]]).tobytes(), np.concatenate([high[a:z][s], high[a:z][m]]).tobytes(), first[a:z][s].tobytes(), run[a:z][m].astype(np.uint32).tobytes(), *[None] * 6))
            own = np.repeat(~one, run)  # they come back in the same order
            out.append((chunk, chunk, None, None, None, None, run[~one].astype(np.uint16).tobytes(), slot[own].tobytes(), ids.tobytes(), rows.tobytes(), size.astype(np.int32).tobytes(), sigs.tobytes()))
            return _emit(out)

        for batch in batches:
            doc, row = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_numpy().astype(np.int64)
            for i, j, g, b, sig, weight in sets(batch.column(1)):
                if docs and (grams + len(g) > CHUNK_GRAMS or docs + j - i > CHUNK_DOCS):
                    yield flush()
                for a in range(0, j - i, CHUNK_DOCS):
                    z = min(a + CHUNK_DOCS, j - i)
                    if a:
                        yield flush()
                    held.append((g[b[a] : b[z]], doc[i + a : i + z], row[i + a : i + z], np.diff(b[a : z + 1]), sig[a:z], weight[a:z]))
                    grams, docs = grams + int(b[z] - b[a]), docs + z - a
        if docs:
            yield flush()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In one hash range: keep the n-grams of two documents or more, with their number."""
    ranges: dict[int, list[tuple]] = {}
    for batch in batches:
        rows = [tuple(r.values()) for r in batch.to_pylist()]
        if meta := [r for r in rows if r[2] is None]:
            yield _emit(meta)
        for r in rows:
            if r[2] is not None:
                ranges.setdefault(r[0], []).append(r[1:6])
    for part in sorted(ranges):
        rows = ranges.pop(part)
        low, high, slots, many = ([np.frombuffer(r[c], t) for r in rows] for c, t in ((1, np.uint32), (2, np.uint16), (3, np.uint16), (4, np.uint32)))
        key = np.concatenate([x.astype(np.uint64) | y.astype(np.uint64) << np.uint64(32) for x, y in zip(low, high)])
        own = np.concatenate([np.concatenate([np.ones(len(x), np.int64), y]) for x, y in zip(slots, many)])
        order = np.argsort(key)
        s = key[order]
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        df = np.empty(len(key), np.int64)
        df[order] = np.repeat(np.add.reduceat(own[order], edge), np.diff(np.append(edge, len(s))))
        df = np.minimum(df, 0xFFFFFFFF).astype(np.uint32 if df.max() > 0xFFFF else np.uint16)
        del key, own, order, s
        out, at = [], 0
        for (chunk, *_), x, y, sl in zip(rows, low, high, slots):
            d = df[at : at + len(x)]
            keep = d > 1
            if keep.any():
                out.append((part, chunk, x[keep].tobytes(), y[keep].tobytes(), sl[keep[: len(sl)]].tobytes(), d[keep].tobytes(), *[None] * 6))
            at += len(x)
        if out:
            yield _emit(out)


SETS = "doc_id long, row long, sig long, size int, prefix int, grams array<long>"
_SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("sig", pa.int64()), ("size", pa.int32()), ("prefix", pa.int32()), ("grams", pa.list_(pa.int64()))])


def overlap_needed(size: np.ndarray, threshold: float) -> np.ndarray:
    """Fewest common n-grams that a set of this size needs with any partner."""
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


def _prefixes(threshold: float | None):
    """Chunks put together again; without a threshold every document with a shared key stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meta: dict[int, tuple] = {}
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            for r in (tuple(r.values()) for r in batch.to_pylist()):
                if r[2] is None:
                    meta[r[1]] = tuple(np.frombuffer(v, t) for v, t in zip(r[6:], (np.uint16, np.uint16, np.int64, np.int64, np.int32, np.int64)))
                else:
                    wide = len(r[5]) == len(r[2])
                    parts.setdefault(r[1], []).append((r[0], *(np.frombuffer(v, t) for v, t in zip(r[2:6], (np.uint32, np.uint16, np.uint16, np.uint32 if wide else np.uint16)))))
        for chunk in sorted(parts):
            many, many_slots, ids, hashes, sizes, sigs = meta.pop(chunk)
            rows = sorted(parts.pop(chunk), key=lambda r: r[0])
            known = [_identity(r[1], r[2], r[0]) for r in rows]
            several, dfs = (np.concatenate([x[len(r[3]) :] for x, r in zip(v, rows)]) for v in (known, [r[4] for r in rows]))
            key = np.concatenate([*(k[: len(r[3])] for k, r in zip(known, rows)), np.repeat(several, many)])
            slot = np.concatenate([*(r[3] for r in rows), many_slots])
            df = np.concatenate([*(r[4][: len(r[3])] for r in rows), np.repeat(dfs, many)])
            shared = np.bincount(slot, minlength=len(sizes))
            prefix = shared if threshold is None else sizes - overlap_needed(sizes, threshold) + 1 - (sizes - shared)
            alive = prefix > 0
            live = np.flatnonzero(alive & (sizes > 0))
            order = live[np.lexsort((hashes[live], ids[live], sigs[live]))]
            again = np.zeros(len(sizes), bool)
            again[order[1:][sigs[order][1:] == sigs[order][:-1]]] = True  # a copy in the chunk leaves the n-grams to the first
            keep = (alive & ~again)[slot]
            key, slot, df = key[keep], slot[keep], df[keep]
            order = np.lexsort((key, df, slot))
            key = key[order]
            prefix, shared = np.where(again, 0, prefix), np.where(again, 0, shared)
            ends = np.cumsum(shared[live])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(key))
            yield pa.RecordBatch.from_arrays([pa.array(ids[live]), pa.array(hashes[live]), pa.array(sigs[live]), pa.array(sizes[live], pa.int32()), pa.array(prefix[live], pa.int32()), lists], schema=_SETS_ARROW)

    return run


def shared_keys(docs: DataFrame, sets, threshold: float | None) -> tuple[DataFrame, int]:
    """The documents that may have a partner, with the keys they share: (doc_id, row, sig, size, prefix, grams), written; and the partitions to use.

    ``row`` is a hash of the text as it is.  Of the copies in a chunk one has keys, the others have a prefix of 0.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"), F.xxhash64("text").alias("row")).where("doc_id is not null and text is not null")
    parts = input_parts(own)
    census = by_id(own.mapInArrow(trimmed(_census(sets, parts)), CENSUS), parts, "part").mapInArrow(trimmed(_count), CENSUS)
    return written(census.repartition(parts, "chunk").mapInArrow(trimmed(_prefixes(threshold)), SETS), "sets"), parts


def candidate_sets(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> tuple[DataFrame, int]:
    """The documents that may have a partner; see ``shared_keys``.

    ``grams`` are the n-grams that other documents have too, rarest first;
    ``size`` counts all; ``prefix`` is the number of ``grams`` in the prefix.
    """
    return shared_keys(docs, lambda column: gram_sets(column, n), threshold)


def _blocked_products(doc: np.ndarray, col: np.ndarray, n: int, width: int = 4096) -> np.ndarray:
    """Common columns of each two documents, from (doc, column) incidences sorted by column."""
    out = np.zeros((n, n), np.float32)
    top = int(col[-1]) + 1 if len(col) else 0
    for a in range(0, top, width):
        i, j = np.searchsorted(col, [a, a + width])
        block = np.zeros((n, min(width, top - a)), np.float32)
        block[doc[i:j], col[i:j] - a] = 1
        out += block @ block.T
    return out


def _compact(doc: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Incidences of n-grams that occur twice or more, with columns numbered and sorted."""
    if not len(gram):
        return doc, gram
    order = np.argsort(gram, kind="stable")
    g, d = gram[order], doc[order]
    edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
    run = np.diff(edge)
    col = np.repeat(np.arange(len(run)), run)
    keep = np.repeat(run > 1, run)
    d, col = d[keep], col[keep]
    return d, np.unique(col, return_inverse=True)[1] if len(col) else col


def pairs_in_group(sizes: np.ndarray, grams: list[np.ndarray], prefix: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, Jaccard) of each pair in a group, i < j: prefix, length, positional and suffix filters, then verification.

    With ``prefix`` None every pair is a candidate, and only the length filter applies.
    """
    none = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    n = len(sizes)
    lens = np.array([len(g) for g in grams])
    doc, gram = np.repeat(np.arange(n), lens), np.concatenate(grams)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(lens) - lens, lens)
    need = overlap_needed(sizes, threshold)
    alive = np.ones(n, bool)
    for _ in range(2):  # n-grams that nobody else here has can't count; a document with too few others leaves
        d, c = _compact(doc[alive[doc]], gram[alive[doc]])
        alive &= np.bincount(d, minlength=n) >= np.maximum(need, 1)
    live = np.flatnonzero(alive)
    if len(live) < 2:
        return none
    new = np.full(n, -1)
    new[live] = np.arange(len(live))
    keep = alive[doc]
    doc, gram, pos = new[doc[keep]], gram[keep], pos[keep]
    size, m = sizes[live].astype(np.float64), len(live)
    alpha = np.ceil(threshold / (1 + threshold) * (size[:, None] + size[None, :]) - 1e-9).astype(np.float32)
    ok = np.triu((np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-9), 1)
    if prefix is not None:
        front = pos < prefix[live][doc]
        common = _blocked_products(*_compact(doc[front], gram[front]), m)
        rest = (need[live] - 1).astype(np.float64)
        ok &= (common > 0) & (common + np.maximum(rest[:, None], rest[None, :]).astype(np.float32) >= alpha)
        del common
    i, j = np.nonzero(ok)
    del ok
    if not len(i):
        return none
    d, c = _compact(doc, gram)
    if prefix is not None:
        spread = np.zeros((m, 16), np.int32)
        np.add.at(spread, (d, (c * 40503 >> 4) & 15), 1)
        fit = np.zeros(len(i), bool)
        for a in range(0, len(i), 1 << 16):
            z = slice(a, a + (1 << 16))
            fit[z] = np.minimum(spread[i[z]], spread[j[z]]).sum(1) >= alpha[i[z], j[z]]
        i, j = i[fit], j[fit]
        if not len(i):
            return none
    if len(i) > 2 * m or m <= 64:
        both = _blocked_products(d, c, m)[i, j].astype(np.float64)
    else:
        order = np.argsort(d, kind="stable")
        cut = np.searchsorted(d[order], np.arange(m + 1))
        cols = c[order]
        both = np.array([len(np.intersect1d(cols[cut[x] : cut[x + 1]], cols[cut[y] : cut[y + 1]], assume_unique=True)) for x, y in zip(i, j)], np.float64)
    jac = both / (size[i] + size[j] - both)
    good = jac >= threshold - 1e-12
    return live[i[good]], live[j[good]], jac[good]


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each node's component."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            break
    return root


FOUND = "sig long, root long, links long"
_FOUND_ARROW = pa.schema([("sig", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of one cell after the other; they come sorted by cell."""
    now, rows = None, []
    for batch in batches:
        cell = [batch.column(k).to_numpy() for k in range(3)]
        rest = [batch.column(k).to_numpy() for k in range(3, 8)]
        lists = [(batch.column(k).offsets.to_numpy(), batch.column(k).values.to_numpy()) for k in (8, 9)]
        for r in range(batch.num_rows):
            key = tuple(c[r] for c in cell)
            if key != now:
                if len(rows) > 1:
                    yield now, rows
                now, rows = key, []
            rows.append((*(v[r] for v in rest), *(v[o[r] : o[r + 1]].copy() for o, v in lists)))
    if len(rows) > 1:
        yield now, rows


def _verify(threshold: float, use_prefix: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (leader, ci, cj), rows in _cells(batches):
            rows.sort(key=lambda r: r[0])
            sig, copies, size, prefix, side = (np.array([r[k] for r in rows]) for k in range(5))
            i, j, _ = pairs_in_group(size, [r[5] for r in rows], prefix if use_prefix else None, threshold)
            if ci != cj:
                keep = side[i] != side[j]
                i, j = i[keep], j[keep]
            if not len(i):
                continue
            met = [r[6][r[6] < leader] for r in rows]  # groups before this one in which a pair has met already
            if any(map(len, met)):
                d, c = _compact(np.repeat(np.arange(len(rows)), list(map(len, met))), np.concatenate(met))
                if len(c):
                    first = _blocked_products(d, c, len(rows))[i, j] == 0
                    i, j = i[first], j[first]
            if not len(i):
                continue
            links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
            own = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(sig[own]), pa.array(sig[_roots(i, j, len(rows))[own]]), pa.array(links[own].astype(np.int64))], schema=_FOUND_ARROW)

    return run


def leaders(meets: DataFrame) -> DataFrame:
    """Groups to compare, (sig, leader), from (sig, key): all sets with a key in common meet at the smallest of them.

    Copies of a chunk have gone already.  Keys are reduced to their smallest and largest set before they are shuffled, and a hot
    key's sets are joined with one row, which adaptive execution can split.
    """
    led = meets.groupBy("key").agg(F.min("sig").alias("leader"), F.max("sig").alias("most")).where("leader < most").select("key", "leader")
    return written(meets.join(led, "key").select("sig", "leader").distinct(), "groups")


def linked_sets(sets: DataFrame, led: DataFrame, threshold: float, parts: int, use_prefix: bool = True, copies: DataFrame | None = None, sized: DataFrame | None = None) -> DataFrame:
    """(sig, root, links) of each set in each cell where it has a partner, from whole sets verified once per pair.

    ``sets`` has (doc_id, row, sig, size, prefix, grams) and ``led`` the groups of ``leaders``.  Given ``copies``, (sig, copies),
    ``sets`` has one row for each set, and ``sized`` tells the sizes without making them.
    """
    cuts = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("grams") / CELL_GRAMS)).cast("int")
    sizes = (sets if sized is None else sized).where("prefix > 0").groupBy("sig").agg(F.max("size").alias("size"))
    hot = led.join(sizes, "sig").groupBy("leader").agg(F.count("*").alias("n"), F.sum("size").alias("grams")).where((F.col("n") > BLOCK) | (F.col("grams") > CELL_GRAMS)).select("leader", cuts.alias("cuts"))
    seats = led.join(hot, "leader", "left").select("sig", F.struct("leader", F.coalesce("cuts", F.lit(1)).alias("cuts")).alias("seat"))
    own = seats.groupBy("sig").agg(F.array_sort(F.collect_set("seat")).alias("seats"))
    if copies is not None:
        reps = sets.select("sig", "size", "prefix", "grams").join(copies, "sig").join(own, "sig").dropDuplicates(["sig"])
    else:  # one of each set, found by its smallest row, so that no copies of a set travel with their n-grams
        least = sets.groupBy("sig").agg(F.countDistinct("doc_id").alias("copies"), F.min(F.when(F.col("prefix") > 0, F.struct("doc_id", "row"))).alias("rep"))
        chosen = least.join(own, "sig").select("sig", "copies", F.col("rep.doc_id").alias("doc_id"), F.col("rep.row").alias("row"), "seats")
        reps = sets.where("prefix > 0").join(chosen, ["sig", "doc_id", "row"]).dropDuplicates(["sig"])
    placed = reps.select("*", F.col("seats.leader").alias("leaders"), F.explode("seats").alias("seat")).select("*", "seat.leader", "seat.cuts")
    placed = placed.withColumn("side", F.pmod(F.xxhash64("sig"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    placed = placed.select("leader", F.least("side", "other").alias("ci"), F.greatest("side", "other").alias("cj"), "sig", "copies", "size", "prefix", "side", "grams", "leaders")
    return placed.repartition(parts, "leader", "ci", "cj").sortWithinPartitions("leader", "ci", "cj").mapInArrow(trimmed(_verify(threshold, use_prefix)), FOUND)


def classed(sets: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, row, sig, class_id, links) of every document with a link, from the links of the sets."""
    found = written(found, "links")
    roots = components(found.select(F.col("sig").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("sig").agg(F.sum("links").alias("links"))
    near = written(links.join(roots, "sig", "left").select("sig", "links", F.coalesce("root", "sig").alias("root")), "near")
    docs = sets.select("doc_id", "row", "sig").distinct()
    own = docs.groupBy("sig").agg(F.min("doc_id").alias("least"), F.countDistinct("doc_id").alias("copies"))
    own = own.join(near, "sig", "left").select("sig", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "sig").alias("root"))
    own = own.where("copies > 1 or links > 0 ")
    first = own.groupBy("root").agg(F.min("least").alias("class_id"))
    own = own.join(first, "root").select("sig", "class_id", (F.col("links") + F.col("copies") - 1).alias("links"))
    return docs.join(own, "sig").select("doc_id", "row", "sig", "class_id", "links")


def prefix_keys(sets: DataFrame) -> DataFrame:
    return sets.select("sig", F.explode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("key"))


def ngram_jaccard_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links): one row for each document that is like another one.

    Two documents are linked if their n-gram sets have a Jaccard similarity of ``threshold`` or more;
    ``links`` counts a document's partners, and ``class_id`` is the smallest doc_id of all that it is connected with.  Documents without a
    link have no row.  An empty table, null texts and texts without words give no rows.
    """
    sets, parts = candidate_sets(docs, n, threshold)
    found = linked_sets(sets, leaders(prefix_keys(sets)), threshold, parts)
    return classed(sets, found).select("doc_id", "sig", "class_id", "links").distinct().select("doc_id", "class_id", "links")


def components(edges: DataFrame) -> DataFrame:
    """(sig, root) of each node but the roots, from edges (a, b): the smallest node of its connected component.

    Alternates large-star and small-star steps; every step is written to the shared
    folder, and the number of steps grows with the logarithm of the size.  An edge of a node with itself says nothing.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = written(small, "edges")
        last, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return now.select(F.col("u").alias("sig"), F.col("v").alias("root"))


def one_per_group(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that are like one of a smaller doc_id, directly or through others.

    Of each class the smallest doc_id stays, with all
    its columns (the smallest hash of the text, if it has several in the class).  Rows that repeat a doc_id and its text are one.  Documents
    without a doc_id or without words stay.
    """
    sets, parts = candidate_sets(docs, n, threshold)
    found = classed(sets, linked_sets(sets, leaders(prefix_keys(sets)), threshold, parts))
    found = written(found.select("doc_id", "row", "class_id"), "classes")
    kept_rows = found.where("doc_id = class_id").groupBy("class_id").agg(F.min("row").alias("kept"))
    gone = found.join(kept_rows, "class_id").where("doc_id <> class_id or row <> kept").select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row")).distinct()
    gone = written(gone, "gone")
    own = docs.select(F.struct("*").alias("doc"), F.xxhash64("text").alias("hash"), F.col("doc_id").cast("long").alias("id"))
    kept = own.join(checked_broadcast(gone, gone.count() * RELATION_ROW), (F.col("id") == F.col("gone_id")) & (F.col("hash") == F.col("gone_row")), "left_anti")
    repeated = sets.groupBy("doc_id", "row").count().where("count > 1").select(F.col("doc_id").alias("two_id"), F.col("row").alias("two_row"))
    if not repeated.isEmpty():
        twice = written(repeated, "repeated")
        once, same = checked_broadcast(twice, twice.count() * RELATION_ROW), (F.col("id") == F.col("two_id")) & (F.col("hash") == F.col("two_row"))
        again = kept.join(once, same, "left_semi").groupBy("id", "hash").agg(F.first("doc").alias("doc"))
        kept = kept.join(once, same, "left_anti").select("doc").unionByName(again.select("doc"))
    return kept.select("doc.*")


def checked_broadcast(df: DataFrame, size: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a table whose measured size allows it; leave the join to a shuffle beyond that."""
    return F.broadcast(df) if size <= most else df

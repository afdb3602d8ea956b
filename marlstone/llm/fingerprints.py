"""MinHash fingerprints: near-duplicate documents by banded signatures, verified by Jaccard.

A document is the set of its hashed lower-case word shingles.  ``bands * rows``
universal hash functions ``a x + b`` (mod 2^64, a odd) permute the shingles; each one's
minimum is an entry of the signature, and the entries of a band are hashed together.
Band keys are counted like n-grams in ``ngram_join``, so only keys of two documents or more become rows;
documents that agree in a band are candidates: they meet in Spark in the group of the
smallest set signature of the band, so a band of thousands of copies costs as many rows as
it has different texts.  Shingle sets are then made again for one document of each candidate set only, and every candidate pair's Jaccard
similarity is computed from whole sets of 64-bit shingles, once.

With 20 bands of 5 rows a pair of similarity 0.7 is a candidate with probability 0.975, one
of 0.8 with 0.9996.  The query looks for ``NEAR`` = 0.5 with 48 bands of 4 rows: a pair of
similarity 0.5 is a candidate with probability 0.955, one of 0.6 with 0.9987.  Rows without a doc_id and texts without words take no part; documents with
the same set are one node of the classes (see ``ngram_join``), and a doc_id that repeats with another set is another document.  Very long texts are
read whole, in a slice of their own.  Ties do not arise: classes and links depend on sets only.
Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import text as tx
from marlstone.llm.ngram_join import RELATION_ROW, SETS, _SETS_ARROW, checked_broadcast, classed, gram_sets, leaders, linked_sets, shared_keys
from marlstone.llm.store import trimmed, written

SHINGLE = 3
BANDS = 20
ROWS = 5
THRESHOLD = 0.7
NEAR = 0.5
NEAR_BANDS = 48
NEAR_ROWS = 4
SEED = 20240607
SLICE = 512 << 10
"""Bytes of text whose shingles are permuted together; they then stay in the processor's cache."""

def permutations(count: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, count, dtype=np.uint64)


def signatures(grams: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows, permutations) minima of rows of shingles, none of them empty."""
    out = np.empty((len(bounds) - 1, len(a)), np.uint64)
    space = np.empty(len(grams), np.uint64)
    for k in range(len(a)):
        np.multiply(grams, a[k], out=space)
        np.add(space, b[k], out=space)
        out[:, k] = np.minimum.reduceat(space, bounds[:-1])
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(signature), bands), np.uint64)
    for k in range(bands):
        h = np.full(len(signature), k + 1, np.uint64)
        for r in range(k * rows, (k + 1) * rows):
            h = tx.mix(h * tx._K1 + signature[:, r])
        keys[:, k] = h
    return keys.astype(np.int64)


def _banded(n: int, bands: int, rows: int):
    """The band keys of each text, in the form of sets for the census."""
    a, b = permutations(bands * rows)

    def sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        raw, offsets = tx.text_buffers(column)
        for i, j in tx.slices(offsets, SLICE):
            w = tx.Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            g, bounds = tx.distinct(*tx.ngrams(w.hashes(), w.bounds, n))
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            keys = band_keys(signatures(g, np.append(bounds[full], bounds[-1]), a, b), bands, rows) if len(full) else np.zeros((0, bands), np.int64)
            yield i, j, keys.ravel().view(np.uint64), np.concatenate([[0], np.cumsum((sizes > 0) * bands)]), tx.set_signatures(g, bounds), sizes

    return sets


def _shingled(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), batch.column(2)
            for i, j, g, bounds, sigs, sizes in gram_sets(batch.column(1), n):
                size = pa.array(sizes, pa.int32())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), rows.slice(i, j - i), pa.array(sigs), size, size, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(g.astype(np.int64)))], schema=_SETS_ARROW)

    return run


def minhash_classes(docs: DataFrame, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links): one row for each document that is a near duplicate of another one.

    ``links`` counts the candidates whose Jaccard similarity is ``threshold`` or more; ``class_id`` is the smallest doc_id of
    all that a document is connected with.  Documents without a link have no row.
    """
    signed, parts = shared_keys(docs, _banded(n, bands, rows), None)
    led = leaders(signed.select("sig", F.explode("grams").alias("key")))
    reps = signed.groupBy("sig").agg(F.min(F.struct("doc_id", "row")).alias("rep")).join(led, "sig", "left_semi").select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.row").alias("rep_row"))
    reps = written(reps.distinct(), "representatives")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"), F.xxhash64("text").alias("row")).where("doc_id is not null and text is not null")
    own = own.join(checked_broadcast(reps, reps.count() * RELATION_ROW), (F.col("doc_id") == F.col("rep_id")) & (F.col("row") == F.col("rep_row")), "left_semi")
    copies = signed.groupBy("sig").agg(F.countDistinct("doc_id").alias("copies"))
    sets = own.select("doc_id", "text", "row").mapInArrow(trimmed(_shingled(n)), SETS)
    return classed(signed, linked_sets(sets, led, threshold, parts, False, copies, signed)).select("doc_id", "sig", "class_id", "links").distinct().select("doc_id", "class_id", "links")

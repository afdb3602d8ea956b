"""Quality classifier: logistic regression on hashed word n-grams, trained online with FTRL-proximal.

Tokens are runs of letters and digits or runs of punctuation, lower-case; a token equal to the one
before it is read as a sign of repetition.  Tokens and pairs of neighbours are hashed to
2^18 weights; a document's value for each is its frequency over the square root of the number of tokens
times a scale, so the score is a sparse dot product: a gather of weights and a sum.

FTRL-proximal keeps, for every weight, a learning rate of its own and an L1 penalty that leaves
unseen or useless weights at exactly zero.  It is fitted on a bounded sample of labelled documents (``sample``),
in one task, since the examples come one after the other; scoring is narrow, without a shuffle, and the
weights (1 MB) go with the task.

A text that is null or has no words has no evidence and counts as rejected; a null doc_id is scored as
any other row, and rows that repeat are scored each.  A very long text is read whole, in a slice of its own.  A score equal
to the cut is kept.  An empty table gives an empty result.  Without any labels all documents with words are
kept at a score of 0.5.  Other columns are ignored (or passed on by ``keep_good``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import text as tx
from marlstone.llm.labelled import SAMPLE, labelled_sample
from marlstone.llm.store import trimmed

BITS = 18
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
CUT = 0.5
_AGAIN = np.uint64(0x5EED)


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, bounds) of texts: tokens, then pairs, of each."""
    w = tx.Words(raw, offsets, split=True)
    h = w.hashes()
    n = len(h)
    inner = np.ones(max(n - 1, 0), bool)
    edge = w.bounds[1:-1]
    inner[edge[(edge > 0) & (edge < n)] - 1] = False
    again = np.zeros(n, bool)
    again[1:] = (h[1:] == h[:-1]) & inner
    h[again] = _AGAIN
    pair = tx.mix(h[:-1] * tx._K1 + h[1:])[inner]
    row = np.concatenate([w.row, w.row[:-1][inner]])
    f = (np.concatenate([tx.mix(h), pair]) >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(row, kind="stable")
    return f[order], np.searchsorted(row[order], np.arange(len(offsets)))


def batch_features(column: pa.Array, bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = tx.text_buffers(column)
    for i, j in tx.slices(offsets):
        yield i, j, *features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the intercept) from examples (features, values, label), in order."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= L1, 0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for i, x, y in examples:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    return weights(np.arange(len(z))).astype(np.float32)


def example(f: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    i, c = np.unique(f, return_counts=True)
    return np.append(i, 1 << bits).astype(np.int32), np.append(c / np.sqrt(max(len(f), 1)), 1.0).astype(np.float32)


def _train(bits: int, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            ids, ys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for i, j, f, b in batch_features(batch.column(1), bits):
                found += [(int(ids[i + r]), *(example(f[b[r] : b[r + 1]], bits)), int(ys[i + r])) for r in range(j - i)]
        found.sort(key=lambda e: (int(tx.mix(np.array([e[0]], np.int64).view(np.uint64))[0]), e[0]))
        w = ftrl([e[1:] for e in found], bits, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["weights"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, target: str = "quality") -> np.ndarray:
    """Weights fitted on the labelled sample; all zero without labels."""
    own = labelled_sample(docs.select("doc_id", F.lower("text").alias("text")), labels, target, sample)
    rows = own.repartition(1).mapInArrow(trimmed(_train(BITS, EPOCHS)), "weights binary").collect()
    return np.frombuffer(rows[0][0], np.float32) if rows else np.zeros((1 << BITS) + 1, np.float32)


def score_texts(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Probability of good quality of each text, 0 for one without words."""
    out = []
    for i, j, f, b in batch_features(column):
        n = np.diff(b)
        total = np.concatenate([[0.0], np.cumsum(weights[f], dtype=np.float64)])
        dot = (total[b[1:]] - total[b[:-1]]) / np.sqrt(np.maximum(n, 1)) + weights[-1]
        out.append(np.where(n > 0, 1 / (1 + np.exp(-dot)), 0.0))
    return np.concatenate(out) if out else np.zeros(0)


def _score(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(batch.column(1), weights))], names=["doc", "score"])

    return run


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc, score): the rows as structs with their score; one narrow pass."""
    own = docs.select(F.struct("*").alias("doc"), F.lower("text").alias("lower"))
    return own.mapInArrow(trimmed(_score(weights)), own.select("doc", F.lit(0.0).alias("score")).schema)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """The documents, with all their columns, whose quality score is at least ``cut``."""
    return scored(docs, fit(docs, labels, sample)).where(F.col("score") >= cut).select("doc.*")


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """(doc_id, score, keep) of the documents that the classifier keeps."""
    weights = fit(docs, labels, sample)
    own = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("doc"), F.lower("text").alias("lower"))
    own = own.mapInArrow(trimmed(_score(weights)), "doc struct<doc_id: long>, score double")
    return own.where(F.col("score") >= cut).select("doc.doc_id", "score", F.lit(True).alias("keep"))

"""Quality rules: gradient-boosted trees over statistics of a document's text.

Each document becomes a dozen numbers (``FEATURES``), computed for all rows of a batch at once from
the bytes.  Trees are grown on quantile histograms with second-order gain and logistic
loss.  On chosen features (``MONOTONE``) the score may only fall (-1) or only rise (+1) as the feature
grows: a split that would break this is not taken, and the bounds of both sides pass down the tree, so
the whole model is monotone in them.  The trees are flattened to numpy arrays (feature, threshold,
children, value) and scored for all rows and trees together, one level at a time.

The model is fitted on the driver from the numbers of a bounded sample of labelled documents
(``sample`` rows of a dozen doubles); scoring is one narrow pass.

A null text or one without words is rejected with a score of 0; a null doc_id is scored like any
other row, and rows that repeat are scored each.  A very long text is read whole, in a slice of its own.  A score equal to the cut
is kept; of cuts with an equal gain the lowest of the first feature is taken.  An empty table gives an empty result.  Without labels everything with words stays at
0.5.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import text as tx
from marlstone.llm.labelled import SAMPLE, labelled_sample

FEATURES = ("log_words", "mean_word", "longest_word", "punctuation", "upper", "digits", "beyond_ascii", "distinct_words", "repeated_words", "repeated_lines", "words_per_line", "marked_words", "distinct_pairs")
MONOTONE = {"repeated_words": -1, "repeated_lines": -1, "punctuation": -1, "marked_words": -1}
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 60, 4, 0.15, 64, 20, 1.0
CUT = 0.5

_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1
_PUNCT = (tx._CLASS == 2).astype(np.int32)
_HIGH = (np.arange(256) >= 128).astype(np.int32)
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[48:58] = _ALPHA[128:] = True


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _kinds(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of different values in each row, told apart by 40 bits or more."""
    n = len(bounds) - 1
    bits = max(n, 1).bit_length()
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(bounds))
    key = np.sort(row << np.uint64(64 - bits) | h >> np.uint64(bits))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(64 - bits)).astype(np.int64), minlength=n)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, features) of a run of texts; a text without words has zeros."""
    w = tx.Words(raw, offsets)
    rows, n = len(offsets) - 1, w.counts
    size = np.maximum(np.diff(offsets), 1)
    words = np.maximum(n, 1)
    h = w.hashes()
    inner = w.row[1:] == w.row[:-1]
    same = np.zeros(len(h), bool)
    same[1:] = inner & (h[1:] == h[:-1])
    different = _kinds(h, w.bounds)
    pairs, pair_bounds = tx.ngrams(h, w.bounds, 2)
    pair_kinds = _kinds(pairs, pair_bounds) / np.maximum(np.diff(pair_bounds), 1)
    length = w.end - w.start
    longest = np.zeros(rows)
    some = np.flatnonzero(n)
    if len(some):
        longest[some] = np.maximum.reduceat(length, w.bounds[some])
    mark = ~_ALPHA[raw[np.minimum(w.end - 1, max(len(raw) - 1, 0))]]
    before = np.where(length > 1, ~_ALPHA[raw[np.maximum(w.end - 2, 0)]], True) if len(raw) else mark
    newline = np.flatnonzero(raw == 10)
    cut = np.searchsorted(newline, offsets)
    lines = np.diff(cut) + 1
    starts = np.sort(np.concatenate([offsets[:-1][np.diff(offsets) > 0], newline + 1]))
    starts = np.unique(starts[starts < len(raw)])
    first = np.searchsorted(w.start, starts)
    line_row = np.searchsorted(offsets, starts, "right") - 1
    ends = np.append(first[1:], len(h))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(tx.mix(h * np.uint64(0x9E3779B97F4A7C15)) if len(h) else h, dtype=np.uint64)])
    line = sums[ends] - sums[first]
    filled = ends > first
    bounds = np.searchsorted(line_row[filled], np.arange(rows + 1))
    kinds = _kinds(line[filled], bounds)
    made = np.maximum(np.diff(bounds), 1)
    out = np.stack([
        np.log1p(n), _sums(length, w.bounds) / words, longest, _sums(_PUNCT[raw], offsets) / size, _sums(_UPPER[raw], offsets) / size,
        _sums(_DIGIT[raw], offsets) / size, _sums(_HIGH[raw], offsets) / size, different / words, _sums(same, w.bounds) / words,
        1 - kinds / made, n / lines, _sums(mark & before, w.bounds) / words, pair_kinds,
    ], axis=1)
    out[n == 0] = 0
    return out


def column_statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, has words) of a text column."""
    raw, offsets = tx.text_buffers(column)
    out = [statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in tx.slices(offsets)]
    x = np.concatenate(out) if out else np.zeros((0, len(FEATURES)))
    return x, x[:, 0] > 0


@dataclass
class Forest:
    """Trees as flat arrays; a leaf is its own child.  ``roots`` has the first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int = DEPTH

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability for each row, level by level for all trees at once."""
        out = np.empty(len(x))
        for a in range(0, len(x), 8192):
            part = x[a : a + 8192]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[a : a + 8192] = 1 / (1 + np.exp(-(self.base + self.value[node].sum(1))))
        return out


def boost(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Fit a forest; constant at 0.5 without rows, at the share of ones if there is one class only."""
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        score = np.full(len(y), base)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = grad[rows], hess[rows]
            value = float(np.clip(-g.sum() / (h.sum() + RIDGE), low, high))
            me = len(nodes)
            nodes.append([0, np.inf, me, me, value * RATE])
            score[rows] += 0  # leaves are added below
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * LEAST:
                total_g, total_h = g.sum(), h.sum()
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    k = binned[rows, f]
                    bg, bh, bn = (np.cumsum(np.bincount(k, v, len(c) + 1))[:-1] for v in (g, h, np.ones(len(k))))
                    wl = np.clip(-bg / (bh + RIDGE), low, high)
                    wr = np.clip(-(total_g - bg) / (total_h - bh + RIDGE), low, high)
                    gain = -(bg * wl + 0.5 * (bh + RIDGE) * wl * wl) - ((total_g - bg) * wr + 0.5 * (total_h - bh + RIDGE) * wr * wr) + (total_g * value + 0.5 * (total_h + RIDGE) * value * value)
                    fine = (bn >= LEAST) & (len(rows) - bn >= LEAST)
                    if (sign := monotone.get(f, 0)) != 0:
                        fine &= sign * (wr - wl) >= 0
                    gain = np.where(fine, gain, -np.inf)
                    at = int(np.argmax(gain))
                    if gain[at] > best[0]:
                        best = (gain[at], (f, at, float(wl[at]), float(wr[at])))
            if best[1] is None:
                score[rows] += value * RATE
                return me
            f, at, wl, wr = best[1]
            goes = binned[rows, f] <= at
            middle, sign = (wl + wr) / 2, monotone.get(f, 0)
            left = grow(rows[goes], level + 1, middle if sign < 0 else low, middle if sign > 0 else high)
            right = grow(rows[~goes], level + 1, middle if sign > 0 else low, middle if sign < 0 else high)
            nodes[me] = [f, float(cuts[f][at]), left, right, 0.0]
            return me

        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = p - y, p * (1 - p)
            roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    else:
        nodes.append([0, np.inf, 0, 0, 0.0])
        roots.append(0)
    a = np.array(nodes)
    return Forest(a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), a[:, 4], np.array(roots, np.int32), base, depth)


_X = "doc_id long, y int, " + ", ".join(f"{f} double" for f in FEATURES)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, _ = column_statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x[:, f]) for f in range(len(FEATURES)))], names=["doc_id", "y", *FEATURES])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, target: str = "quality") -> Forest:
    rows = labelled_sample(docs, labels, target, sample).mapInArrow(_labelled, _X).toPandas().sort_values("doc_id")  # ``sample`` rows at most
    return boost(rows[list(FEATURES)].to_numpy(), rows["y"].to_numpy(float), {FEATURES.index(f): s for f, s in MONOTONE.items()})


def _score(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, words = column_statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(words, forest.score(x), 0.0))], names=["doc_id", "score"])

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """(doc_id, score, keep) of the documents whose score is at least ``cut``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(_score(fit(docs, labels, sample)), "doc_id long, score double").where(F.col("score") >= cut).withColumn("keep", F.lit(True))

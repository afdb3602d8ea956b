"""Vectorised word hashing over Arrow string buffers.

Words are the longest runs of bytes other than space, tab, newline, vertical
tab, form feed and carriage return; a null text has no words.  A word is known
by a 64-bit hash of its bytes, computed eight bytes at a time for all words of
a slice together, so the per-word cost does not include a Python call.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
"""Texts are hashed in runs of rows of about this many bytes, to bound memory."""

_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.ones(256, np.uint8)  # 0 white space, 1 letters, digits and bytes beyond ASCII, 2 punctuation
_CLASS[_SEP] = 0
_CLASS[[c for c in range(128) if not chr(c).isalnum() and not _SEP[c]]] = 2
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xBF58476D1CE4E5B9)
_K3 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _K2
    x ^= x >> np.uint64(27)
    x *= _K3
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Words of consecutive texts: ``start``/``end`` byte positions, ``row`` and ``bounds`` (first word of each row)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, split: bool = False):
        """``split``: words end where letters and punctuation meet, too."""
        n = len(raw)
        self.padded = np.zeros(n + 8, np.uint8)
        self.padded[:n] = raw
        word = ~_SEP[raw]
        first = word.copy()
        last = word.copy()
        if split:
            kind = _CLASS[raw]
            change = kind[1:] != kind[:-1]
        else:
            change = word[1:] != word[:-1]
        first[1:] &= change
        last[:-1] &= change
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        first[cut] = word[cut]
        last[cut - 1] = word[cut - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of the bytes from start to end (default: of each word)."""
        start = self.start if start is None else start
        length = (self.end if end is None else end) - start
        view = np.ndarray((len(self.padded) - 7,), "<u8", self.padded.data, strides=(1,))
        out = mix((view[start] & _MASK[np.minimum(length, 8)]) + _K1 * length.astype(np.uint64))
        at, step = np.flatnonzero(length > 8), 8
        while len(at):
            part = view[start[at] + step] & _MASK[np.minimum(length[at] - step, 8)]
            out[at] = mix((out[at] ^ part) + _K1)
            step += 8
            at = at[length[at] > step]
        return out


def ngrams(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the word n-grams of each row.

    A row of 1 to n - 1 words has one n-gram, its whole word sequence; a row
    without words has none.
    """
    counts = np.diff(bounds)
    total = len(words)
    if n == 1 or not total:
        return words, bounds
    acc = np.zeros(total, np.uint64)
    for k in range(n):
        m = total - k
        if m <= 0:
            break
        acc[:m] = mix(acc[:m] + words[k:] * _K1 + np.uint64(k + 1))
    row = np.repeat(np.arange(len(counts)), counts)
    keep = np.arange(total) <= bounds[1:][row] - n
    short = np.flatnonzero((counts > 0) & (counts < n))
    for r in short:  # at most n - 1 words each
        h = np.zeros(1, np.uint64)
        for k, i in enumerate(range(bounds[r], bounds[r + 1])):
            h = mix(h + words[i : i + 1] * _K1 + np.uint64(k + 1))
        acc[bounds[r]] = h[0]
        keep[bounds[r]] = True
    sizes = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    return acc[keep], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def distinct(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the new bounds."""
    if not len(grams):
        return grams, np.zeros_like(bounds)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((grams, row)) if len(bounds) > 2 else np.argsort(grams)
    g, r = grams[order], row[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    g, r = g[keep], r[keep]
    return g, np.searchsorted(r, np.arange(len(bounds)))


def set_signatures(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One signed 64-bit value for each row's set of n-grams, the same for the same set."""
    sizes = np.diff(bounds).astype(np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams + _K1), dtype=np.uint64)])
    other = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams ^ _K3), dtype=np.uint64)])
    a = total[bounds[1:]] - total[bounds[:-1]]
    b = other[bounds[1:]] - other[bounds[:-1]]
    return mix(mix(a + sizes) ^ b).astype(np.int64)

import random

import numpy as np
import pyarrow as pa

from marlstone.llm import text as tx

WHITE = " \t\n\x0b\f\r"


def words_of(t):
    out, now = [], ""
    for c in t or "":
        if c in WHITE:
            out, now = out + [now] * bool(now), ""
        else:
            now += c
    return out + [now] * bool(now)


def test_words_and_hashes_follow_the_texts():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab é\n\t xyz0123456789_") for _ in range(rnd.randrange(60))) for _ in range(300)] + [None, "", " ", "x", "long" * 50]
    raw, offsets = tx.text_buffers(pa.array(texts))
    w = tx.Words(raw, offsets)
    h = w.hashes()
    known = {}
    for i, t in enumerate(texts):
        got = [bytes(raw[a:b]).decode() for a, b in zip(w.start[w.bounds[i] : w.bounds[i + 1]], w.end[w.bounds[i] : w.bounds[i + 1]])]
        assert got == words_of(t)
        for word, x in zip(got, h[w.bounds[i] : w.bounds[i + 1]]):
            assert known.setdefault(word, x) == x
    assert len(set(known.values())) == len(known)


def test_sliced_array_and_slices():
    texts = pa.array(["aa bb", "cc", None, "dd ee ff"]).slice(1)
    raw, offsets = tx.text_buffers(texts)
    assert bytes(raw) == b"ccdd ee ff" and offsets.tolist() == [0, 2, 2, 10]
    assert list(tx.slices(offsets, 3)) == [(0, 2), (2, 3)]
    assert list(tx.slices(np.zeros(1, np.int64), 3)) == []


def test_ngrams_of_short_rows():
    raw, offsets = tx.text_buffers(pa.array(["a b c d", "a b", "", "a", "a b c"]))
    w = tx.Words(raw, offsets)
    g, b = tx.ngrams(w.hashes(), w.bounds, 3)
    assert np.diff(b).tolist() == [2, 1, 0, 1, 1]
    assert g[0] == g[b[4]]


def test_split_words_at_punctuation():
    raw, offsets = tx.text_buffers(pa.array(["ab*** c", "!!x"]))
    w = tx.Words(raw, offsets, split=True)
    assert [bytes(raw[a:b]) for a, b in zip(w.start, w.end)] == [b"ab", b"***", b"c", b"!!", b"x"]

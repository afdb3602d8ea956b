import random

import pytest

from marlstone.llm.packing import best_fit_packing
from tests.llm.test_text import words_of


def brute(rows, capacity):
    items = []
    for i, t in rows:
        n = len(words_of(t))
        items += [(min(capacity, n - s), i, s // capacity) for s in range(0, n, capacity)]
    items.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0, x[2]))
    room, out = [], []
    for size, i, piece in items:
        fits = [(r, k) for k, r in enumerate(room) if r >= size]
        if fits:
            _, k = min(fits)
        else:
            room.append(capacity)
            k = len(room) - 1
        out.append((i, piece, piece * capacity, size, k, capacity - room[k]))
        room[k] -= size
    return out


@pytest.mark.parametrize("capacity,seed", [(10, 1), (64, 2), (7, 3), (1, 4)])
def test_packing_is_best_fit_decreasing(spark, capacity, seed):
    rnd = random.Random(seed)
    rows = [(i, "w " * rnd.choice([0, 1, 2, 3, 5, 8, 13, 21, 34, rnd.randrange(90)])) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "a b c"), (502, "x y"), (502, "x y")]
    got = best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string"), capacity).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, capacity), key=repr)


def test_empty_and_clashing_columns(spark):
    assert best_fit_packing(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(1, "a b", 5, "x", None)], "doc_id long, text string, piece int, sequence string, rank int")
    assert [tuple(r) for r in best_fit_packing(odd).collect()] == [(1, 0, 0, 2, 0, 0)]


def test_very_long_text(spark):
    got = best_fit_packing(spark.createDataFrame([(1, "w " * 500_001)], "doc_id long, text string")).collect()
    assert sum(r.n_words for r in got) == 500_001 and len({(r.sequence, r.position) for r in got}) == len(got) == 245

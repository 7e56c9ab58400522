"""Hard negatives against every score, and the tree's bounds."""

import math

import numpy as np
import pytest

from strataflow.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, row string, q int, block string"


def by_hand(rows, positives=5, negatives=3):
    kept = []
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        kept.append((vec_id, label, [max(-(2**31) + 1, min(2**31 - 1, math.floor(256 * v))) for v in x]))
    out = []
    for i, (anchor, own, q) in enumerate(kept):
        if anchor % 50:
            continue
        score = [sum(a * b for a, b in zip(q, r)) for _, _, r in kept]
        order = sorted((j for j in range(len(kept)) if j != i), key=lambda j: (-score[j], kept[j][0]))
        for p in [j for j in order if kept[j][1] == own][:positives]:
            good = [j for j in order if kept[j][1] != own and 50 * score[p] <= 100 * score[j] <= 95 * score[p]][:negatives]
            out += [(anchor, kept[p][0], k + 1, kept[j][0], score[p], score[j]) for k, j in enumerate(good)]
    return sorted(out)


def mined(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "r", 1, "b") for r in rows], SCHEMA)
    got = hn.hard_negatives(df, **sizes).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r) for r in got.collect())


def vectors(n, seed, d=6):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)) + 0.6, 1)  # few different values: many ties
    rows = [(i, [float(v) for v in x[i]], int(rng.integers(0, 3)) if i % 3 else 1) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [1.0] * d, None), (n + 2, [1.0, None] + [0.0] * (d - 2), 1), (n + 3, [math.nan] * d, 1), (n + 4, [math.inf] * d, 1), (None, [1.0] * d, 1)]
    return [*rows, (400, [0.5] * d, 2), (400, [0.5] * d, 2), (403, [1.0, 2.0], 0), (404, [], 1), (350, [0.0] * d, 4)]


@pytest.mark.parametrize("sizes", [{}, {"block": 40, "chunk": 3}])
def test_by_hand(spark, sizes):
    rows = vectors(300, 1)
    got = mined(spark, rows, **sizes)
    assert got == by_hand(rows) and len(got) > 50


def test_scores_beyond_doubles(spark):
    rows = [(i, [float((i * 7919) % 1009) * 3000 + 0.01, 1e30 if i == 4 else 0.25 * i], i % 2) for i in range(60)]
    assert mined(spark, rows) == by_hand(rows)


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(50, [1.0], 1)]) == []


def test_tree_leaves_out_what_cannot_count():
    rng = np.random.default_rng(0)
    x = np.floor(np.repeat(rng.normal(size=(20, 8)) * 800, 100, 0) + rng.normal(size=(2000, 8)) * 4)
    a, ids = x[::100].copy(), np.arange(2000)
    low, high = np.full((20, 1), -hn.FAR), np.full((20, 1), hn.FAR)
    score, place, looked = hn.best_in_windows(x, ids, ids, np.zeros(2000, int), a, np.full(20, -1), np.zeros(20, int), low, high, 3, True, leaf=16)
    want = np.lexsort((np.broadcast_to(ids, (20, 2000)), -(a @ x.T)), axis=-1)[:, :3]
    assert (place[:, 0] == want).all() and (score[:, 0] == np.take_along_axis(a @ x.T, want, 1)).all()
    assert looked < 20 * 2000 / 16 / 2  # of all pairs of an anchor and a leaf


def test_equal_vectors_split():
    tree = hn.BallTree(np.ones((1000, 3)), 16)
    assert max(e - b for b, e, left in zip(tree.begin, tree.end, tree.left) if not left) <= 16

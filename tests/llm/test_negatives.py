"""Hard negatives: packed scores, and whole results against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import negatives

VECTORS = "vec_id long, embedding array<double>, label int, `a.b` int, VALUES string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)


def brute(rows, anchor, n_positives=5, n_negatives=5):
    clean = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
             if i is not None and label is not None and v is not None
             and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in clean if anchor(i)}:
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in clean
                         if j != i))
        for p, j, _ in [s for s in scored if s[2] == label][:n_positives]:
            unlike = [(n, k) for n, k, other in scored
                      if other != label and 80 * -p <= 100 * -n <= 100 * -p]
            out += [(i, j, rank, k, -p, -n) for rank, (n, k) in enumerate(unlike[:n_negatives], 1)]
    return sorted(out)


def mined(spark, rows, every=5):
    found = negatives.mine(frame(spark, rows).repartition(3), F.col("vec_id") % every == 0)
    return sorted(map(tuple, found.collect()))


def vectors(n, seed, dims=20, spread=0.4, labels=4):
    r = random.Random(seed)
    middle = [r.gauss(0, spread) for _ in range(dims)]
    return [(i, [m + r.gauss(0, spread) for m in middle], r.randint(0, labels)) for i in range(n)]


@pytest.mark.parametrize("low, high, dims", [(-256, 255, 64), (-1, 0, 3), (0, 0, 8), (5, 90, 17),
                                             (-(1 << 27), (1 << 27) - 1, 64), (-1000, 10, 1)])
def test_scores_equal_inner_products(low, high, dims):
    r = np.random.default_rng(1)
    rows, anchors = (r.integers(low, high, (n, dims), endpoint=True) for n in (5000, 7))
    planes = negatives.packed(rows)
    got = negatives.scores(negatives.tables(anchors, planes.shape[1], planes.shape[0]), planes)
    assert (got == anchors @ rows.T).all()


def test_first_rows_break_ties_by_id():
    score, ids = np.array([3, 9, 3, 3, 9, 1]), np.array([8, 7, 2, 5, 6, 0])
    assert negatives.first_rows(score, ids, 4).tolist() == [4, 1, 2, 3]
    assert negatives.first_rows(score, ids, 99).tolist() == [4, 1, 2, 3, 0, 5]
    assert negatives.first_rows(score[:0], ids[:0], 3).tolist() == []


@pytest.mark.parametrize("block, anchor, stretch", [(16384, 8192, 2048), (7, 3, 2), (50, 1000, 9)])
def test_equals_brute_force(spark, monkeypatch, block, anchor, stretch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", anchor)
    monkeypatch.setattr(negatives, "STRETCH", stretch)
    rows = vectors(150, 2)
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 300 and mined(spark, rows) == want


def test_ties_nulls_copies_and_odd_vectors(spark):
    rows = [(i, [0.5, 0.5], i % 2) for i in range(20)]  # one score everywhere
    rows += [(20, None, 1), (None, [0.5], 1), (25, [0.5, None], 0), (30, [math.nan, 1.0], 0),
             (35, [math.inf, 1.0], 0), (40, [0.5, 0.5], None), (45, [], 0), (50, [0.1] * 30, 1),
             (55, [-0.5, -0.25], 0), (7, [0.5, 0.5], 1), (5, [0.5, 0.5], 1)]
    want = brute(rows, lambda i: i % 5 == 0)
    assert want and mined(spark, rows) == want


def test_hot_label_and_far_components(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0.4, 0.3) for _ in range(9)], 0 if i % 3 else i) for i in range(120)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)
    far = rows + [(1000, [1e30] * 9, 0), (1001, [600_000.0] * 9, 1)]  # beyond 28 bits: no part
    assert mined(spark, far) == mined(spark, rows)


def test_empty_tables_and_lone_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [0.5], 1)]) == []
    assert mined(spark, [(0, [0.5], 1)]) == []
    assert mined(spark, [(0, [0.5], 1), (1, [0.5], 1)]) == []
    one = mined(spark, [(0, [0.5], 1), (1, [0.5], 1), (2, [0.45], 3)])
    assert one == [(0, 1, 1, 2, 128 * 128, 128 * 115)]

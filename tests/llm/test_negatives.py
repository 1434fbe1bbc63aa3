"""Hard negatives against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from devicepulse.llm import negatives

LONG = 1 << 63


def brute(rows, step):
    """Rows of the result, from (id, label, vector)."""
    valid = {
        (i, label, tuple(max(-LONG, min(LONG - 1, math.floor(min(max(256 * x, -1e300), 1e300)))) for x in v))
        for i, label, v in rows
        if i is not None and label is not None and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for i, label, v in valid:
        if i % step:
            continue
        scored = [
            (-max(-LONG, min(LONG - 1, sum(a * b for a, b in zip(v, w)))), j, other)
            for j, other, w in valid
            if j != i and len(w) == len(v)
        ]
        for p, j, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fit = sorted(s for s in scored if s[2] != label and -80 * p <= -100 * s[0] <= -100 * p)
            out += [(i, j, r + 1, k, -p, -n) for r, (n, k, _) in enumerate(fit[:5])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, row string, q int, dim int")


def check(spark, rows, step=10):
    df = table(spark, [(i, label, v, "r", 1, 2) for i, label, v in rows])
    got = negatives.hard_negatives(df, F.col("vec_id") % step == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, step)
    return got


@pytest.mark.parametrize("tile", [1 << 23, 1 << 12])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(negatives, "TILE_BYTES", tile)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 24))
    rows = [
        (i, int(rng.integers(3)), (centres[i % 4] + rng.normal(size=24) * 0.4).round(1).tolist())
        for i in range(300)
    ]
    assert check(spark, rows).count() > 100


def test_odd_rows(spark):
    rows = [
        (0, 1, [1.0, 0.5]), (10, 1, [0.0, 0.0]), (20, 2, [-1.0, 1.0]), (1, 1, [1.0, 0.5]), (2, 2, [1.0, 0.4]),
        (3, 2, [1.0, 0.45]), (3, 2, [1.0, 0.45]), (4, 2, None), (5, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]),
        (6, 1, [1.0, None]), (7, 2, [float("nan"), 1.0]), (8, 2, [float("inf"), 1.0]), (9, 3, []), (30, 3, []),
        (11, 4, []), (12, 2, [0.9]), (13, 1, [0.9]), (40, 1, [0.8]), (14, 2, [0.9, 0.45]), (15, 1, [0.9, 0.45]),
    ]
    check(spark, rows)
    big = [(0, 1, [1e18, 1e18]), (1, 1, [1e16, 3e15]), (2, 2, [9e15, 3e15]), (3, 2, [1e300, 1.0]), (10, 2, [3e7, 3e7])]
    check(spark, big)
    assert negatives.hard_negatives(table(spark, []), F.lit(True)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    # Smooth vectors, which their segments describe well.
    base = np.repeat(rng.normal(size=(400, 8)), 8, axis=1) * 256
    q = np.floor(base + rng.normal(size=base.shape) * 4).astype(np.int64)
    block = negatives.Block(np.arange(400), np.zeros(400, int), q)
    exact = q @ q.T
    slack = negatives.SLACK * block.norm[:, None] * block.norm
    widths = []
    for mean, spread in block.levels:
        middle, reach = mean @ mean.T, spread @ spread.T + slack
        assert (middle - reach <= exact).all() and (exact <= middle + reach).all()
        widths.append(reach.mean())
    assert len(block.levels) == 3 and widths[2] < widths[0] / 10


def test_scores_only_what_bounds_leave(monkeypatch):
    rng = np.random.default_rng(3)
    q = np.floor(np.repeat(rng.normal(size=(2_000, 8)), 8, axis=1) * 256).astype(np.int64)
    block = negatives.Block(np.arange(2_000), np.zeros(2_000, int), q)
    left = []
    exact = negatives._exact

    def counted(a, b, which, open_):
        left.append(open_.mean())
        return exact(a, b, which, open_)

    monkeypatch.setattr(negatives, "_exact", counted)
    which = np.arange(64)
    low, high = np.full(64, -LONG), np.full(64, LONG - 1)
    asked, row, score = negatives.best(block, block, which, low, high, True, 5)
    truth = q[:64] @ q.T
    np.fill_diagonal(truth, -LONG)
    assert max(left) < 0.05
    assert (np.sort(score.reshape(64, 5)) == np.sort(truth)[:, -5:]).all()

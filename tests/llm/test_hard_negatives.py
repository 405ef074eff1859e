"""Ball trees against comparing all rows: ties, equal vectors, hot labels, unlike lengths, nulls, large numbers, empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import hard_negatives as H

SCHEMA = "vec_id bigint, label int, embedding array<double>, key string, rank int, vector int"


def _table(spark, rows):
    return spark.createDataFrame([(i, l, v, "k", 0, 1) for i, l, v in rows], SCHEMA).repartition(4)


def _mined(df, every, **options):
    return sorted(map(tuple, H.mine(df, F.col("vec_id") % every == 0, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def _clustered(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = []
    for k in range(n):
        v = centres[rng.integers(12)] + spread * rng.normal(size=dims)
        rows.append((k, int(rng.integers(4)) if rng.random() < 0.6 else 0, (np.round(v * 4) / 4).tolist()))
    return rows


@pytest.mark.parametrize(("seed", "spread", "part_rows"), [(1, 0.2, 200), (2, 1.0, 64), (3, 0.0, 5000)])
def test_equals_all_pairs(spark, seed, spread, part_rows):
    """With spread 0 a twelfth of the rows has each vector: long ties."""
    rows = _clustered(seed, 1200, 6, spread)
    want = H.brute_force([(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows], 25)
    got = _mined(_table(spark, rows), 25, part_rows=part_rows)
    assert got == want and want


def test_large_numbers_are_exact(spark):
    rng = random.Random(4)
    rows = [(k, k % 3, [rng.choice([3e6, -1e6, 2e6 + rng.random()]) for _ in range(5)]) for k in range(300)]
    want = H.brute_force([(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows], 20)
    assert _mined(_table(spark, rows), 20, part_rows=100) == want and any(abs(r[4]) > 2**53 for r in want)


def test_rows_that_take_no_part(spark):
    good = _clustered(6, 150, 4, 0.5)
    bad = [(200, None, [1.0]), (201, 1, None), (202, 1, [1.0, None, 2.0]), (203, 1, [float("nan")]), (204, 1, [float("inf")]), (205, 0, [1e300]), (None, 1, [1.0])]
    assert _mined(_table(spark, good + bad), 10) == _mined(_table(spark, good), 10)
    assert _mined(_table(spark, good + good[:30]), 10) == _mined(_table(spark, good), 10)
    assert _mined(_table(spark, []), 10) == [] and _mined(_table(spark, bad), 10) == []
    short = [(0, 1, [1.0, 2.0]), (1, 1, [1.0]), (2, 2, [1.0, 0.0, 5.0]), (3, 2, [])]
    want = H.brute_force([(i, l, [math.floor(256 * x) for x in v] + [0] * (3 - len(v))) for i, l, v in short], 10)
    assert _mined(_table(spark, short), 10) == want and want


def test_balls_pass_by_rows_outside_the_window():
    """Clusters far apart: a search compares a small share of the rows, and finds the same."""
    rng = np.random.default_rng(7)
    centres = rng.integers(-4000, 4000, size=(40, 8))
    vectors = centres[rng.integers(40, size=8000)] + rng.integers(-40, 40, size=(8000, 8))
    keys = np.arange(8000)
    tree = H.Tree(keys, vectors, 6)
    asked = vectors[:20]
    for low, high in ((np.full(20, H._LOW + 1), np.full(20, 1 << 62)), ((asked * asked).sum(axis=1) * 8 // 10, (asked * asked).sum(axis=1) * 9 // 10)):
        best, visited = H.Best(20, 5), [0]
        H.search(tree, best, np.arange(20), np.arange(20), asked, keys[:20], low, high, visited)
        scores = asked @ vectors.T
        for q in range(20):
            ranked = sorted((-s, k) for k, s in enumerate(scores[q].tolist()) if k != q and low[q] <= s <= high[q])[:5]
            assert ranked == [(-s, k) for s, k in zip(best.scores[q].tolist(), best.keys[q].tolist(), strict=True) if s > H._LOW]
        assert visited[0] < 0.25 * 20 * 8000

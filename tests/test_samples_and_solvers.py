"""Permutations, ranks' correlation, directed solvers, densities: against plain versions."""

import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import evaluate as E
from weftgraph.operators import propagate as X
from weftgraph.operators import stats as S


@pytest.mark.parametrize("n", [1, 2, 7, 16, 50, 1001])
def test_permutation(spark, n):
    """Every place of rows x columns once, in an order that the salt tells."""
    rows = int(np.ceil(np.sqrt(n)))
    size = rows * -(-n // rows)
    assert 0 <= size - n < rows
    out = spark.range(size).select(E.permuted(F.col("id"), F.lit(n), F.lit("t"), 1).alias("a"), E.permuted(F.col("id"), F.lit(n), F.lit("u"), 1).alias("b")).collect()
    assert sorted(r.a for r in out) == sorted(r.b for r in out) == list(range(size))
    if n > 40:
        assert [r.a for r in out] != [r.b for r in out] and [r.a for r in out] != list(range(size))


def test_negatives(spark):
    universe = spark.createDataFrame([(f"v{k}",) for k in range(100)] * 2, "node string")
    positives = spark.createDataFrame([("a", f"v{k}") for k in range(10)] + [("b", f"v{k}") for k in range(90)] + [("c", "v1")], "term string, node string")
    drawn = [tuple(r) for r in E.sample_negatives(positives, universe, 0.9).collect()]
    own = {tuple(r) for r in positives.collect()}
    assert len(drawn) == len(set(drawn)) and not set(drawn) & own
    by = {t: sum(x == t for x, _ in drawn) for t in "abc"}
    assert by == {"a": 9, "b": 10, "c": 0}  # b has ten other nodes in all, and gets each
    assert set(drawn) == {tuple(r) for r in E.sample_negatives(positives, universe, 0.9).collect()}
    assert set(drawn) != {tuple(r) for r in E.sample_negatives(positives, universe, 0.9, rep=2).collect()}
    assert E.sample_negatives(positives.limit(0), universe, 1.0).count() == E.sample_negatives(positives, universe.limit(0), 1.0).count() == 0
    # Each node is drawn about as often as any other.
    many = spark.range(400).select(F.concat(F.lit("t"), "id").alias("term"), F.lit("v0").alias("node"))
    counts = E.sample_negatives(many, universe, 20).groupBy("node").count().collect()
    assert len(counts) == 99 and all(40 < r["count"] < 130 for r in counts)


def _tau(x, y):
    both = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(len(x)) for j in range(i))
    return both / (len(x) * (len(x) - 1) / 2)


def test_kendall_in_ranges(spark):
    rng, rows, want = random.Random(3), [], {}
    for key, n, values in (("few", 2, 9), ("ties", 300, 4), ("hot", 250, 0), ("many", 300, 10**6)):
        x = [rng.randrange(values) if values else rng.choice([5, 5, 5, rng.randrange(10)]) for _ in range(n)]
        y = [a + rng.randrange(max(2, values)) if rng.random() < 0.7 else rng.choice([3, 3, a]) for a in x]
        rows += [(key, float(a), float(b)) for a, b in zip(x, y, strict=True)]
        want[key] = _tau(x, y)
    rows.append(("one", 1.0, 1.0))
    table = spark.createDataFrame(rows, "k string, x double, y double")
    for ranges, whole in ((7, 10), (3, 0), (128, 1000)):
        got = {r.k: r.tau for r in S.kendall_tau(table, ["k"], ranges, whole).collect()}
        assert got.pop("one") is None and got == pytest.approx(want)
    assert S.kendall_tau(table.limit(0), ["k"]).collect() == []


def test_directed_solver(spark):
    rng = random.Random(5)
    rows = [(f"v{a}", f"v{b}", rng.choice([0.5, 1.0, 3.0])) for a in range(25) for b in rng.sample(range(25), 5) if a != b]
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    labels = spark.createDataFrame([("t", "v0", 1), ("t", "v3", 1), ("t", "v7", -1), ("u", "v9", 1)], "term string, node string, label int")
    w = np.zeros((25, 25))
    for a, b, x in rows:
        w[int(a[1:]), int(b[1:])] = x
    p = w / w.sum(1)[:, None]
    got = {(r.term, r.node): r.score for r in X.solve(edges, labels, 0.9, "bicgstab", 1e-11).collect()}
    for term, fixed, ones in (("t", [0, 3, 7], [0, 3]), ("u", [9], [9])):
        free = [k for k in range(25) if k not in fixed]
        want = np.linalg.solve(np.eye(len(free)) - 0.9 * p[np.ix_(free, free)], 0.9 * p[np.ix_(free, ones)].sum(1))
        assert [got.get((term, f"v{k}"), 0.0) for k in free] == pytest.approx(list(want), abs=1e-8)
    assert not X.is_symmetric(edges)
    with pytest.raises(ValueError, match="symmetric"):
        X.solve(edges, labels, 0.9, "cg")
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        X.solve(edges, labels, 0.9, "bicgstab", 1e-14, max_rounds=1)
    assert any("residual" in str(x.message) for x in told)


def test_density(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 1, 3000), rng.normal(6, 0.5, 2000)])
    made = S.density(spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double"), "v", 200, 0.3).orderBy("point").collect()
    at, got = np.array([r["at"] for r in made]), np.array([r.density for r in made])
    want = np.exp(-(((at[:, None] - v) / 0.3) ** 2) / 2).sum(1) / (np.sqrt(2 * np.pi) * 0.3 * len(v))
    assert np.abs(got - want).max() < 2e-3 and got.sum() * (at[1] - at[0]) == pytest.approx(1, abs=0.01)
    assert S.density(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").collect() == []

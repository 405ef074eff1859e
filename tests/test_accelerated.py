"""Semi-iteration and its bounds against dense algebra, random features against the exact kernel."""

import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import classify as K
from weftgraph.operators import propagate as X


def _network(spark, n=40, hub=True):
    rng, w = random.Random(4), np.zeros((n, n))
    for a in range(n):
        for b in rng.sample(range(n), 3):
            if a != b:
                w[a, b] = w[b, a] = rng.choice([0.5, 1.0, 4.0])
    if hub:
        w[0, 1:] = w[1:, 0] = 1.0
    w[5, 5] = 2.0
    rows = [(f"v{a}", f"v{b}", float(w[a, b])) for a, b in zip(*np.nonzero(w), strict=True)]
    return spark.createDataFrame(rows, "src string, dst string, weight double"), w


def _labels(spark):
    rows = [("t", "v1", 1), ("t", "v3", 1), ("t", "v7", -1), ("u", "v9", 1), ("u", "v0", -1), ("t", "nowhere", 1)]
    return spark.createDataFrame(rows, "term string, node string, label int")


@pytest.mark.parametrize("plus", [False, True])
def test_settle(spark, plus):
    edges, w = _network(spark)
    p = w / w.sum(1)[:, None]
    got = {(r.term, r.node): r.score for r in X.settle(edges, _labels(spark), 0.8, 1e-8, plus=plus).collect()}
    for term, ones, none in (("t", [1, 3], [7]), ("u", [9], [0])):
        free = [k for k in range(len(w)) if k not in ones and (plus or k not in none)]
        want = np.linalg.solve(np.eye(len(free)) - 0.8 * p[np.ix_(free, free)], 0.8 * p[np.ix_(free, ones)].sum(1))
        assert [got.pop((term, f"v{k}"), 0.0) for k in free] == pytest.approx(list(want), abs=1e-8)
    assert set(got) == {("t", "v1"), ("t", "v3"), ("u", "v9"), ("t", "nowhere")} and set(got.values()) == {1.0}
    assert X.settle(edges, _labels(spark).limit(0), 0.9).collect() == []


def test_preconditioned(spark):
    edges, w = _network(spark)
    s = w / np.sqrt(np.outer(w.sum(1), w.sum(1)))
    a = np.eye(len(w)) + 2.0 * (np.diag(s.sum(0)) - s)
    y = spark.createDataFrame([("t", "v1", 1.0), ("t", "v3", -2.0), ("u", "v9", 1.0), ("u", "nowhere", 3.0), ("u", "v4", None)], "term string, node string, score double")
    got = {(r.term, r.node): r.score for r in X.preconditioned_solve(edges, y, 2.0, 1e-7).collect()}
    assert got.pop(("u", "nowhere")) == 3.0
    for term, sources in (("t", {1: 1.0, 3: -2.0}), ("u", {9: 1.0})):
        want = np.linalg.solve(a, [sources.get(k, 0.0) for k in range(len(w))])
        assert [got.get((term, f"v{k}"), 0.0) for k in range(len(w))] == pytest.approx(list(want), abs=1e-7)


def test_bound_holds_and_is_sharp(spark):
    edges, w = _network(spark)
    g = 0.5 * w / w.sum(1)[:, None] ** 0.5 / w.sum(0)[None, :] ** 0.5
    scaled = edges.withColumn("weight", F.col("weight") * 0.05)
    for table, dense in ((scaled, 0.05 * w), (spark.createDataFrame([(f"v{a}", f"v{b}", float(g[a, b])) for a, b in zip(*np.nonzero(g), strict=True)], "src string, dst string, weight double"), g)):
        true = np.abs(np.linalg.eigvals(dense)).max()
        one, six = X.spectral_bound(table, 1), X.spectral_bound(table, 6)
        assert true <= six * (1 + 1e-12) and six <= one and six < 1.2 * true
    assert X.spectral_bound(edges.limit(0)) == 0.0


def test_rounds_and_refusals(spark):
    edges, _ = _network(spark, 12)
    given = spark.createDataFrame([("t", "v1", 1.0)], "term string, node string, score double")
    with pytest.raises(ValueError, match="bound"):
        X.semi_iterate(edges, given, ["term"], 1.0)
    with pytest.raises(ValueError, match="symmetric"):
        X.settle(edges.filter("src < dst"), _labels(spark))
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        X.settle(edges, _labels(spark), 0.9, 1e-9, max_rounds=2)
    assert any("may be left" in str(x.message) for x in told)


def _exact_machine(k, y, known, c):
    """Squared hinge loss in the span of the known rows, by Newton steps on the exact kernel with a penalised bias."""
    k = k + 1
    a, sub, target = np.zeros(len(known)), k[np.ix_(known, known)], 2.0 * y - 1
    for _ in range(60):
        on = target * (sub @ a) < 1
        new = np.zeros(len(known))
        new[on] = np.linalg.solve(sub[np.ix_(on, on)] + np.eye(on.sum()) / (2 * c), target[on])
        if np.abs(new - a).max() < 1e-12:
            break
        a = new
    return k[:, known] @ a


def test_kernel_features_and_machine(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 3))
    y = (np.linalg.norm(x, axis=1) < 1.4).astype(int)  # no line parts these
    rows = [(str(k), [float(v) for v in x[k]], int(y[k]) if k % 2 else None) for k in range(200)]
    odd = [("null", None, 1), ("hole", [1.0, None, 2.0], 1), ("short", [1.0], 0), ("nan", [float("nan"), 0.0, 0.0], None)]
    table = spark.createDataFrame(rows + odd, "node string, embedding array<double>, y int")
    made = {r.node: r.embedding for r in K.kernel_features(table, 0.4, 2048).collect()}
    assert [made.pop(name) for name, *_ in odd] == [None] * 4
    f = np.array([made[str(k)] for k in range(200)])
    exact = np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(2))
    error = np.abs(f @ f.T - exact)
    assert error.max() < 6 / np.sqrt(2048) and error.mean() < 1 / np.sqrt(2048)
    got = {r.node: r.score for r in K.kernel_machine(table, 0.4, size=384).collect()}
    assert set(got) == {str(k) for k in range(200)}
    score = np.array([got[str(k)] for k in range(200)])
    want = _exact_machine(exact, y[1::2], np.arange(1, 200, 2), 1.0)
    assert np.corrcoef(score, want)[0, 1] > 0.97 and np.abs(score - want).mean() < 0.15
    held = np.arange(0, 200, 2)
    assert ((score > 0) == (y == 1))[held].mean() > 0.9
    empty = table.limit(0)
    assert K.kernel_features(empty, 1.0, 4).collect() == K.kernel_machine(empty, 1.0, size=4).collect() == []

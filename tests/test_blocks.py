"""Products in blocks against dense algebra: hubs over several seats, many lanes, empty tables; and the plan of a round."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import blocks as B
from weftgraph.operators import propagate as X


def _network(spark, n=60, hub=True, seed=1):
    rng, pairs = random.Random(seed), {}
    for k in range(n):
        for other in rng.sample(range(n), 4):
            if other != k:
                pairs[min(k, other), max(k, other)] = rng.choice([0.5, 1.0, 2.0])
        if hub and k:
            pairs[0, k] = 1.0
    rows = [(f"v{a}", f"v{b}", w) for (a, b), w in pairs.items()]
    return spark.createDataFrame(rows + [(b, a, w) for a, b, w in rows], "src string, dst string, weight double"), rows


def _dense(rows, n):
    w = np.zeros((n, n))
    for a, b, x in rows:
        w[int(a[1:]), int(b[1:])] = w[int(b[1:]), int(a[1:])] = x
    return w


@pytest.mark.parametrize(("block_nodes", "seat"), [(7, 20), (1000, 1 << 20), (1, 3)])
def test_product(spark, block_nodes, seat):
    edges, rows = _network(spark)
    net = B.Blocks(edges, block_nodes, seat)
    if seat < 60:  # the hub's block, at least, lies at several seats
        assert net.spark.table(net._table).groupBy("seat_block").agg(F.countDistinct("seat").alias("n")).filter("n > 1").count() > 0
    rng = random.Random(2)
    scores = {(f"t{t}", f"v{k}"): rng.random() for t in range(150) for k in rng.sample(range(60), 5)}
    table = spark.createDataFrame([(t, v, s) for (t, v), s in scores.items()], "term string, node string, score double")
    lanes = B.Lanes(table, ["term"])
    state = B.pack_scores(table, net, lanes)
    packed = {(r.term, r.node): r.score for r in B.unpack_scores(state, net, lanes).collect()}
    assert packed == scores
    made = B.unpack_scores(net.sums(lambda kept, places, cells: (places, cells), net.products(state)), net, lanes).collect()
    x = np.zeros((150, 60))
    for (t, v), s in scores.items():
        x[int(t[1:]), int(v[1:])] = s
    want = x @ _dense(rows, 60)
    got = np.zeros((150, 60))
    for r in made:
        got[int(r.term[1:]), int(r.node[1:])] += r.score
    assert np.abs(got - want).max() < 1e-12 and len(made) == (want != 0).sum()


def test_edges_stay_where_they_are(spark):
    """A round shuffles scores only: nothing but the scan stands between the join and the network's table."""
    edges, _ = _network(spark)
    net = B.Blocks(edges, 7, 20)
    table = spark.createDataFrame([("t", "v1", 1.0)], "term string, node string, score double")
    plan = net.products(B.pack_scores(table, net, B.Lanes(table, ["term"])))._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    scan = next(k for k, x in enumerate(lines) if net._table in x or "seat_block" in x and "FileScan" in x and "weights" in x)
    depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
    above = [x for x in lines[:scan] if len(x) - len(x.lstrip(" :+-")) < depth]
    while above and "Join" not in above[-1]:
        assert "Exchange" not in above[-1]
        above.pop()
    assert above and "Join" in above[-1]


def test_propagation_equals_dense_algebra(spark):
    edges, rows = _network(spark, 40, seed=4)
    labels = spark.createDataFrame([(f"t{t}", f"v{k}", 1 if k % 2 else -1) for t in range(70) for k in range(t % 5, 40, 9)], "term string, node string, label int")
    got = {(r.term, r.node): r.score for r in X.propagate(edges, labels, 0.9, 6).collect()}
    w = _dense(rows, 40)
    p = w / w.sum(1)[:, None]
    for t in range(70):
        own = range(t % 5, 40, 9)
        fixed = np.array([k in own for k in range(40)])
        ones = np.array([k in own and k % 2 for k in range(40)], float)
        first = np.where(fixed, 0, 0.9 * p @ ones)
        s = first
        for _ in range(5):
            s = np.where(fixed, 0, 0.9 * p @ s) + first
        for k in range(40):
            assert got.get((f"t{t}", f"v{k}"), 0.0) == pytest.approx(1.0 if ones[k] else s[k])


def test_empty(spark):
    none = spark.createDataFrame([], "term string, node string, label int")
    edges, _ = _network(spark, 10)
    assert X.propagate(edges, none, 0.9, 3).collect() == []
    assert X.propagate(edges.limit(0), none, 0.9, 3).collect() == []
    alone = spark.createDataFrame([("t", "elsewhere", 1)], "term string, node string, label int")
    assert [tuple(r) for r in X.propagate(edges, alone, 0.9, 3).collect()] == [("t", "elsewhere", 1.0)]

"""Networks made by hand, against values by hand and dense algebra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import classify, combine, evaluate, graph, propagate, stats, tables
from weftgraph.plans import runs

PATH = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 1.0)]


@pytest.fixture(scope="module")
def path(spark):
    return spark.createDataFrame(PATH + [(b, a, w) for a, b, w in PATH], "src string, dst string, weight double")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([("t", "a", 1), ("t", "d", -1)], "term string, node string, label int")


def _dense(edges):
    rows = edges.collect()
    names = sorted({r.src for r in rows})
    w = np.zeros((len(names),) * 2)
    for r in rows:
        w[names.index(r.src), names.index(r.dst)] = r.weight
    return names, w


def _scores(df):
    return {r.node: r.score for r in df.collect()}


def test_symmetrise(spark):
    raw = spark.createDataFrame([("a", "b", 1.0), ("a", "b", 2.0), ("b", "a", 4.0), ("c", "c", 5.0)], "src string, dst string, weight double")
    got = {(r.src, r.dst): r.weight for r in graph.symmetrise(graph.sum_edges(raw)).collect()}
    assert got == {("a", "b"): 7.0, ("b", "a"): 7.0, ("c", "c"): 10.0}


def test_index(spark):
    nodes = spark.createDataFrame([(f"n{k:04d}",) for k in np.random.default_rng(1).permutation(500)], "node string")
    assert [r.idx for r in graph.index_nodes(nodes).orderBy("node").collect()] == list(range(500))
    assert graph.index_nodes(nodes.limit(0)).collect() == []


def test_propagation_reaches_the_fixed_point(path, labels):
    names, w = _dense(path)
    p = w / w.sum(1, keepdims=True)
    free = [names.index(x) for x in "bc"]
    f = 0.8 * p[free, names.index("a")]
    want = np.linalg.solve(np.eye(2) - 0.8 * p[np.ix_(free, free)], f)
    got = _scores(propagate.propagate(path, labels, 0.8, 200, 1e-10))
    assert got["a"] == 1 and "d" not in got and np.allclose([got["b"], got["c"]], want, atol=1e-8)


def test_static_and_looped_rounds_agree(path, labels):
    static, looped = _scores(propagate.propagate(path, labels, 0.9, 4)), _scores(propagate.propagate(path, labels, 0.9, 5))
    assert set(static) == set(looped) and all(looped[k] >= static[k] - 1e-12 for k in static)


@pytest.mark.parametrize("name", ["genemania", "rl"])
def test_laplacian_systems(spark, path, labels, name):
    names, w = _dense(path)
    d = w.sum(1)
    s = w / np.sqrt(np.outer(d, d))
    lap = np.diag(s.sum(0)) - s
    y = np.zeros(4) if name == "genemania" else np.zeros(4)
    y[names.index("a")] = 1
    if name == "genemania":
        y[names.index("d")] = -1
    want = np.linalg.solve(np.eye(4) + lap, y)
    nodes = graph.nodes_of(path)
    got = propagate.genemania(path, labels, nodes, tol=1e-12) if name == "genemania" else propagate.regularised_laplacian(path, labels, tol=1e-12)
    assert np.allclose([_scores(got).get(n, 0.0) for n in names], want, atol=1e-8)


def test_bounds_hold(path, labels):
    ones = labels.filter("label > 0")
    scores, rounds = propagate.bounds(path, ones, 0.5, 30)
    full = _scores(propagate.propagate(path, ones, 0.5, 300, 1e-14))
    last = rounds.orderBy(F.desc("round")).first()
    for node, score in _scores(scores).items():
        assert score <= full[node] + 1e-9 and (node == "a" or full[node] <= score + last.ub + 1e-9)
    assert last.unranked == 0


def test_components(spark):
    rows = [(f"n{k}", f"n{k + 1}", 1.0) for k in range(40) if k % 10 != 9] + [("n0", "n35", 1.0)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(rows, "src string, dst string, weight double")).collect()}
    assert len(set(got.values())) == 3 and got["n3"] == got["n38"] == "n0"


def test_paths(spark, path):
    costs = path.withColumn("cost", F.col("weight"))
    reached = graph.distances(costs, spark.createDataFrame([("a",)], "node string"))
    assert {r.node: (r.dist, r.hops) for r in reached.collect()} == {"a": (0.0, 0), "b": (1.0, 1), "c": (3.0, 2), "d": (4.0, 3)}
    walk = graph.path_nodes(reached).filter("target = 'd'").orderBy("step").collect()
    assert [r.node for r in walk] == ["d", "c", "b", "a"]


def test_removal(spark, path):
    gone = graph.without_nodes(path, spark.createDataFrame([("b",)], "node string"))
    assert {(r.src, r.dst) for r in gone.collect()} == {("c", "d"), ("d", "c")}


def test_term_weights_prefer_the_informative_channel(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(12):
        for j in range(12):
            if i < j:
                same = (i < 6) == (j < 6)
                for c, w in (("good", 1.0 if same else 0.0), ("noise", float(rng.random()))):
                    if w:
                        rows += [(c, f"n{i:02d}", f"n{j:02d}", w), (c, f"n{j:02d}", f"n{i:02d}", w)]
    channels = spark.createDataFrame(rows, "channel string, src string, dst string, weight double")
    labels = spark.createDataFrame([("t", f"n{i:02d}", 1 if i < 6 else -1) for i in range(12)], "term string, node string, label int")
    one = {r.channel: r.alpha for r in combine.term_weights(channels, labels).collect()}
    all_ = {r.channel: r.alpha for r in combine.shared_weights(channels, labels).collect()}
    assert one["good"] > 5 * abs(one["noise"]) and all_["good"] > 5 * abs(all_["noise"])
    alone = {r.channel: r.alpha for r in combine.term_weights(channels, labels.filter("label > 0")).collect()}
    assert alone == {"good": 0.5, "noise": 0.5}


def test_measures(spark):
    rows = [("x", "a", 0.9), ("x", "b", 0.8), ("x", "c", 0.7), ("x", "d", 0.6), ("x", "e", 0.5), ("x", "f", 0.4)]
    truth = [("x", "a", 1), ("x", "b", -1), ("x", "c", 1), ("x", "d", 1), ("x", "e", -1), ("x", "f", -1)]
    points = evaluate.curve(spark.createDataFrame(rows, "alg string, node string, score double"), spark.createDataFrame(truth, "alg string, node string, label int"), ["alg"])
    m = evaluate.measures(points, ["alg"]).first()
    assert math.isclose(m.avgp, (1 + 2 / 3 + 3 / 4) / 3) and math.isclose(m.auroc, 7 / 9) and math.isclose(m.fmax, 6 / 7)
    # The first step is a positive alone; before the others there is one false positive.
    area = (1 + (1 - math.log(3 / 2)) + (1 - math.log(4 / 3))) / 3
    assert math.isclose(m.auprc, area, rel_tol=1e-9)
    tied = evaluate.curve(spark.createDataFrame([(a, n, 1.0) for a, n, _ in rows], "alg string, node string, score double"), spark.createDataFrame(truth, "alg string, node string, label int"), ["alg"])
    assert evaluate.measures(tied, ["alg"]).first().auroc == 0.0  # one point only
    early = evaluate.early_precision(points, ["alg"], [0.5], [1]).first()
    assert math.isclose(early.prec_r50, 2 / 3) and math.isclose(early.prec_k1, 3 / 4)


def test_folds_are_even(spark):
    rows = spark.createDataFrame([("t", f"n{k}", 1 if k < 11 else -1) for k in range(31)] + [("u", "x", 1)], "term string, node string, label int")
    got = evaluate.split_folds(rows, 5).groupBy("term", "label", "fold").count().collect()
    assert {r.term for r in got} == {"t"} and {r["count"] for r in got if r.label == 1} == {2, 3} and {r["count"] for r in got if r.label == -1} == {4}


def test_uniform_bins(spark):
    got = stats.uniform_bins(spark.createDataFrame([(f"n{k}", d) for k, d in enumerate([9, 8, 8, 8, 5, 4, 3, 2])], "node string, degree long"), 4).collect()
    assert [r.bin for r in sorted(got, key=lambda r: (-r.degree, r.node))] == [1, 1, 2, 2, 3, 3, 4, 4]


def test_svm_is_optimal(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=60) > 0).astype(int)
    rows = spark.createDataFrame([(str(k), [float(v) for v in x[k]], int(y[k])) for k in range(60)], "node string, embedding array<double>, y int")
    got = np.array([_scores(classify.svm(rows))[str(k)] for k in range(60)])
    w = np.linalg.lstsq(np.column_stack([x, np.ones(60)]), got, rcond=None)[0]
    sign = 2 * y - 1
    loss = lambda v: v @ v / 2 + (np.maximum(0, 1 - sign * (np.column_stack([x, np.ones(60)]) @ v)) ** 2).sum()
    assert all(loss(w) <= loss(w + 0.01 * rng.normal(size=4)) + 1e-9 for _ in range(20))


def test_ranks_with_gaps(spark):
    ranks = spark.createDataFrame([("x", "a", 1), ("x", "b", 2), ("y", "b", 1)], "alg string, node string, rank long")
    got = {r.node: (r.median_rank, r.mean_rank) for r in tables.aggregate_ranks(ranks).collect()}
    assert got == {"a": (1.0, 1.0), "b": (1.5, 1.5)}


def test_configured_runs(path, labels):
    settings = {"local": {"should_run": [True]}, "FastSinkSource": {"should_run": [True], "alpha": [0.5, 0.9], "rounds": [2]}, "rl": {"should_run": [False]}}
    assert [r[0] for r in runs.expand(settings)] == ["local", "fastsinksource", "fastsinksource"] and [r[0] for r in runs.expand(settings, ["RL"])] == ["rl"]
    got = runs.run_all(path, labels, graph.nodes_of(path), settings)
    assert {(r.alg, r.params) for r in got.select("alg", "params").distinct().collect()} == {("local", ""), ("fastsinksource", "-alpha0_5-rounds2"), ("fastsinksource", "-alpha0_9-rounds2")}


def test_expected_steps_equal_dense_algebra(spark):
    rows = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 1.0), ("a", "d", 3.0), ("d", "e", 1.0)]
    both = rows + [(b, a, w) for a, b, w in rows]
    names = "abcde"
    w = np.zeros((5, 5))
    for a, b, x in both:
        w[names.index(a), names.index(b)] = x
    d = 1 / np.sqrt(w.sum(0))
    s = d[:, None] * w * d[None]
    degree, state = s.sum(0), np.array([0.5, 0, 0.5, 0, 0])
    sources = spark.createDataFrame([("a",), ("c",), ("unknown",)], "node string")
    for row in propagate.expected_steps(spark.createDataFrame(both, "src string, dst string, weight double"), sources, [1.0, 3.0]).collect():
        leave = 1 / (1 + row.alpha * degree)
        x, stay, mean, square, n = state, 1 - leave @ state, 0.0, 0.0, 0
        while True:
            n, x = n + 1, (s / degree) @ x
            gain = n * (leave @ x) * stay
            mean, square, stay = mean + gain, square + n * gain, stay * (1 - leave @ x)
            if gain < 1e-4:
                break
        assert row.rounds == n and abs(row.expected - mean) < 1e-9 and abs(row.variance - (square - mean**2)) < 1e-9


def test_grid_layout_places_groups_in_rows(spark):
    members = [("big", f"n{k}") for k in range(5)] + [("mid", "m1"), ("mid", "m2")] + [("one", "o")] + [("big", "n0")]
    got = {(r.grp, r.node): (r.x, r.y) for r in tables.grid_layout(spark.createDataFrame(members, "grp string, node string")).collect()}
    assert len(got) == 8
    assert [got["big", f"n{k}"] for k in range(5)] == [(0, 0), (75, 0), (150, 0), (0, 55), (75, 55)]
    assert [got["mid", m] for m in ("m1", "m2")] == [(255, 0), (330, 0)] and got["one", "o"] == (435, 0)
    wide = [(f"g{k}", f"n{k}{j:03}") for k in range(2) for j in range(144)]
    got = {(r.grp, r.node): (r.x, r.y) for r in tables.grid_layout(spark.createDataFrame(wide, "grp string, node string")).collect()}
    assert got["g0", "n0143"] == (825, 605) and got["g1", "n1000"] == (0, 725)
    assert tables.grid_layout(spark.createDataFrame([], "grp string, node string")).count() == 0

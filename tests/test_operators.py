"""Solvers, classifiers, bounds, edge kinds, display texts, statistics, splits and runs against dense algebra or plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions.order import Ordered
from weftgraph.operators import classify, combine, evaluate, graph, propagate, stats, tables
from weftgraph.plans import configs, runs
from weftgraph.sources import readers


@pytest.fixture(scope="module")
def net(spark):
    rng = np.random.default_rng(5)
    w = np.triu(np.round(rng.random((30, 30)), 3) * (rng.random((30, 30)) < 0.2), 1)
    w[np.arange(29), np.arange(1, 30)] += 0.5
    w = w + w.T
    rows = [(f"n{i:02}", f"n{j:02}", float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)]
    return spark.createDataFrame(rows, "src string, dst string, weight double"), w


@pytest.fixture(scope="module")
def marks(spark):
    rows = [("t", f"n{k:02}", 1 if k % 2 else -1) for k in range(0, 30, 4)] + [("t", f"n{k:02}", 1) for k in (1, 9)]
    return spark.createDataFrame(rows + [("u", "n05", 1)], "term string, node string, label int"), rows


def _by_node(df, term="t"):
    return {r.node: r.score for r in df.collect() if r.term == term}


def _fixed_point(w, rows, alpha, plus):
    p = w / w.sum(1, keepdims=True)
    fixed = {int(n[1:]): y for _, n, y in rows if y > 0 or not plus}
    free = [k for k in range(len(w)) if k not in fixed]
    f = alpha * p[free][:, [k for k, y in fixed.items() if y > 0]].sum(1)
    return dict(zip(free, np.linalg.solve(np.eye(len(free)) - alpha * p[np.ix_(free, free)], f), strict=True))


@pytest.mark.parametrize("plus", [False, True])
def test_solver_equals_dense_algebra(net, marks, plus):
    edges, w = net
    want = _fixed_point(w, marks[1], 0.9, plus)
    got = _by_node(propagate.solve(edges, marks[0], 0.9, "gmres", tol=1e-11, plus=plus))
    assert all(abs(got[f"n{k:02}"] - v) < 1e-9 for k, v in want.items()) and got["n01"] == 1.0
    with pytest.raises(ValueError):
        propagate.solve(edges, marks[0], 0.9, "other")


@pytest.mark.parametrize("plus", [False, True])
@pytest.mark.filterwarnings("ignore:bounds")
def test_bounds_keep_negatives(net, marks, plus):
    edges, w = net
    want = _fixed_point(w, marks[1], 0.5, plus)
    scores, rounds = propagate.bounds(edges, marks[0].filter("term = 't'"), 0.5, plus=plus, compare=True)
    got = _by_node(scores)
    assert all(abs(got[f"n{k:02}"] - v) < 1e-3 for k, v in want.items()) and ("n00" in got) == plus
    table = rounds.orderBy("round").collect()
    assert table[-1].tau == 1.0 and table[-1].unranked == 0 and table[0].stretch <= table[0].unranked and all(r.change >= 0 for r in table)


def test_bounds_reach_all_nodes(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in rows + [(b, a) for a, b in rows]], "src string, dst string, weight double")
    scores, _ = propagate.bounds(edges, spark.createDataFrame([("t", "a", 1)], "term string, node string, label int"), 0.5)
    assert set(_by_node(scores)) == set("abcde")


def test_reachable_nodes(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in rows + [(b, a) for a, b in rows]], "src string, dst string, weight double")
    labels = spark.createDataFrame([("t", "a", 1), ("t", "c", -1)], "term string, node string, label int")
    assert {r.node for r in propagate.reachable(edges, labels).collect()} == {"b"}
    got = _by_node(propagate.fixed_scores(edges, labels.filter("label > 0"), 1.0, reached_only=True))
    assert got == {"b": 0.5, "c": 0.0, "d": 0.0}


@pytest.mark.parametrize("loss", ["logistic", "svm"])
def test_network_classifiers_are_optimal(net, marks, loss):
    edges, w = net
    d = w.sum(1)
    s = w / np.sqrt(np.outer(d, d))
    at, y = [int(n[1:]) for _, n, _ in marks[1]], np.array([v for _, _, v in marks[1]], float)
    x, weight, bias = s[at], np.zeros(30), 0.0
    for _ in range(40_000):
        m = y * (x @ weight + bias)
        g = y / (1 + np.exp(m)) if loss == "logistic" else 2 * y * np.maximum(0, 1 - m)
        weight, bias = weight + 0.05 * (x.T @ g - weight), bias + 0.05 * g.sum()
    want = s @ weight + bias
    want = 1 / (1 + np.exp(-want)) if loss == "logistic" else want
    got = _by_node(classify.network_scores(edges, marks[0].filter("term = 't'"), loss))
    for k in range(30):
        if k not in at:
            assert abs(got[f"n{k:02}"] - want[k]) < 2e-3
        else:
            assert got.get(f"n{k:02}") == (1.0 if y[at.index(k)] > 0 else None)


def test_channel_weights_equal_dense_systems(spark):
    rng = np.random.default_rng(8)
    n, names = 14, ["a", "b", "c"]
    y = np.array([1] * 5 + [-1] * 6 + [0] * 3)
    w = {c: np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.6), 1) for c in names}
    w["a"] += np.triu(np.outer(y > 0, y > 0), 1)
    w = {c: m + m.T for c, m in w.items()}
    rows = [(c, f"n{i:02}", f"n{j:02}", float(m[i, j])) for c, m in w.items() for i, j in zip(*np.nonzero(m), strict=True)]
    channels = spark.createDataFrame(rows, "channel string, src string, dst string, weight double")
    labels = spark.createDataFrame([("t", f"n{k:02}", int(v)) for k, v in enumerate(y) if v], "term string, node string, label int")
    p, q = 5, 6
    for shared in (False, True):
        pairs = [(i, j) for i in range(n) for j in range(n) if y[i] and y[j] and (y[i] > 0 or y[j] > 0) and (i < j if shared else True)]
        gram, target = np.zeros((4, 4)), np.zeros(4)
        plus, minus = ((q / 11) ** 2, -p * q / 121) if shared else (2 * q / 11, -2 * p / 11)
        for i, j in pairs:
            both = y[i] > 0 and y[j] > 0
            v = np.array([0, *[w[c][i, j] for c in names]])
            goal = (plus if both else minus) if shared else (plus**2 if both else plus * minus)
            gram += np.outer(v, v)
            target += v * goal
            if i != j:
                scale = 1 if shared else 1 / (p * (p - 1) + 2 * p * q)
                gram[0] += scale * v
                gram[:, 0] += scale * v
        if shared:
            gram[0, 0], target[0] = p * (p - 1) / 2 + p * q, p * (p - 1) / 2 * plus + p * q * minus
        else:
            scale = 1 / (p * (p - 1) + 2 * p * q)
            gram[0, 0], target[0] = scale, scale**2 * (p * (p - 1) * plus**2 + 2 * p * q * plus * minus)
        made = (combine.shared_weights if shared else combine.term_weights)(channels, labels)
        got, want = {r.channel: r.alpha for r in made.collect()}, combine._solve(gram, target, names)
        assert all(abs(got[c] - want[c]) < 1e-9 for c in names)


def test_edge_kinds(spark):
    cases = [
        ("anything", False, "KEGG", ["physical"]),
        ("", True, "SPIKE", ["spike_regulation"]),
        ("", True, "KEGG", []),
        ("Dephosphorylation", True, "KEGG", ["enzymatic"]),
        ("phosphorylation; activation", True, "SPIKE", ["activation", "phosphorylation"]),
        ("inhibition,methylation", True, "KEGG", ["enzymatic", "inhibition"]),
        ("MI:0217(phosphorylation reaction)", True, "other", ["phosphorylation"]),
        ("activation", True, "other", ["enzymatic"]),
        (None, True, "other", ["enzymatic"]),
    ]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k long, interaction string, directed boolean, source string, want array<string>")
    for r in rows.select("want", graph.edge_kinds(F.col("interaction"), F.col("directed"), F.col("source")).alias("got")).collect():
        assert r.got == r.want
    ev = spark.createDataFrame([("a", "b", "activation", True, "KEGG"), ("b", "a", "", False, "x")], "src string, dst string, interaction string, directed boolean, source string")
    assert {(r.src, r.dst): r.kinds for r in graph.kinds_of_edges(ev).collect()} == {("a", "b"): ["activation", "physical"], ("b", "a"): ["physical"]}


def test_display_texts(spark):
    names = ["short", "it's", "a name that is longer than the width of a line", "alpha-beta-gamma-delta-epsilon-zeta-eta", "x" * 40, "y" * 51, "twentyfive characters long now and on", "one " * 12]
    want = ["short", "its", "a name that is longer than \nthe width of a line", "alpha-beta-gamma-delta-epsilon-\nzeta-eta", "x" * 40, "y" * 15 + "[...]", "twentyfive characters long \nnow and on", ("one " * 7 + "\n" + "one " * 5)]
    rows = spark.createDataFrame(list(zip(range(8), names, want, strict=True)), "k long, name string, want string")
    for r in rows.select("want", tables.short_name(F.col("name")).alias("got")).collect():
        assert r.got == r.want
    one = spark.createDataFrame([("P1", "Q2", {"b": "2", "a": "1"})], "u string, v string, notes map<string,string>")
    row = one.select(tables.node_popup(F.col("u"), "uniprot", F.col("notes")).alias("n"), tables.node_popup(F.col("u"), "other").alias("o"), tables.edge_popup(F.col("u"), F.col("v"), (F.lit("p"), F.lit(None))).alias("e")).first()
    assert row.n.endswith("<b>a</b>: 1</br><b>b</b>: 2</br>") and "uniprot/P1" in row.n and row.o == "P1</br>" and row.e == "<b>P1 - Q2</b></br>"


def test_ordered_tables(spark):
    rng = random.Random(3)
    values = [rng.randrange(50) for _ in range(700)]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v long").repartition(5)
    got = Ordered(rows, "v", "k").rank("r").running_sum(F.col("v"), "s").following_min(F.col("k"), "m").table().collect()
    order = sorted(range(700), key=lambda k: (values[k], k))
    low = list(itertools.accumulate(reversed(order), min))[::-1]
    want = {k: (i + 1, sum(values[x] for x in order[: i + 1]), low[i]) for i, k in enumerate(order)}
    assert {r.k: (r.r, r.s, r.m) for r in got} == want
    assert Ordered(rows.limit(0), "v").rank("r").table().count() == 0


def test_rates_and_q_values(spark):
    rng = np.random.default_rng(2)
    p = np.round(np.concatenate([rng.random(40), rng.random(20) / 100]), 6)
    rows = spark.createDataFrame([(str(k), "x" if k % 3 else "y", float(v)) for k, v in enumerate(p)], "name string, ont string, pval double")

    def dense(values):
        order = np.argsort(values, kind="stable")
        raw = values[order] * len(values) / np.arange(1, len(values) + 1)
        out = np.empty(len(values))
        out[order] = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
        return out

    whole = {r.name: r for r in stats.adjust(rows, "name").collect()}
    share = min(1, (p > 0.05).mean() / 0.95)
    for k, v in enumerate(dense(p)):
        assert abs(whole[str(k)].padj - v) < 1e-12 and abs(whole[str(k)].qval - share * v) < 1e-12
    within = {r.name: r.padj for r in stats.adjust(rows, "name", ["ont"]).collect()}
    some = [k for k in range(60) if k % 3 == 0]
    assert all(abs(within[str(k)] - v) < 1e-12 for k, v in zip(some, dense(p[some]), strict=True))


def test_signed_rank_is_exact_for_few_pairs(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for n in (5, 8, 11):
        x, y = rng.random(n), rng.random(n)
        rows += [(f"k{n}", float(a), float(b)) for a, b in zip(x, y, strict=True)]
        d = x - y
        r = np.argsort(np.argsort(np.abs(d))) + 1
        w = r[d > 0].sum()
        want[f"k{n}"] = np.mean([sum(r[k] for k in range(n) if s[k]) >= w for s in itertools.product((0, 1), repeat=n)])
    rows += [("few", 1.0, 0.0)] * 4 + [("tied", 1.0, 0.0)] * 6
    got = {r.g: r for r in stats.signed_rank_tests(spark.createDataFrame(rows, "g string, x double, y double"), ["g"]).collect()}
    assert set(got) == {*want, "tied"} and all(math.isclose(got[k].pval, v) for k, v in want.items())
    assert all(math.isclose(got[k].corrected, min(1, 4 * v)) for k, v in want.items()) and got["tied"].pval < 0.05


def test_leave_one_out_counts_along_an_order(spark):
    rng = np.random.default_rng(6)
    names = [f"n{k}" for k in range(12)]
    values = [(a, b, float(rng.integers(0, 4))) for a in names for b in names[:4]]
    df = spark.createDataFrame(values, "source string, node string, value double")
    got = {r.node: (r.total, r.pval) for r in stats.leave_one_out(df, spark.createDataFrame([(n,) for n in names[:4]], "node string"), spark.createDataFrame([(n,) for n in [*names, "none"]], "node string")).collect()}
    total = {a: sum(v for s, b, v in values if s == a and b != a) for a in [*names, "none"]}
    assert got == {a: (total[a], (1 + sum(v > total[a] for v in total.values())) / 13) for a in names[:4]}


def test_groups_left_out(spark):
    labels = [("t", f"n{k}", 1 if k < 9 else -1) for k in range(18)]
    groups = [(f"n{k}", "g" if k % 3 else "h") for k in range(18)] + [("n0", "g"), ("n9", "g")]
    other = [("t", "n9", 1), ("t", "n0", -1), *[("t", f"n{k}", 1 if k < 9 else -1) for k in range(1, 9)], ("t", "n12", -1), ("t", "n15", -1)]
    make = lambda rows, s: spark.createDataFrame(rows, s)
    for oracle, evaluation in ((False, None), (False, other), (True, other)):
        out = evaluate.leave_group_out(make(labels, "term string, node string, label int"), make(groups, "node string, group string"), 2, oracle, make(evaluation, "term string, node string, label int") if evaluation else None)
        got = {(r.group, r.node, r.label, r.train) for r in out.collect()}
        tested, want = {n: y for _, n, y in evaluation or labels}, set()
        for g in "gh":
            inside = {n for n, x in groups if x == g}
            train = {n: y for _, n, y in labels if n not in inside}
            test = {n: y for n, y in tested.items() if n in inside and train.get(n) != 1}
            if oracle:
                train = {n: y for n, y in train.items() if not (y < 0 and test.get(n) == 1)}
            test = {n: y for n, y in test.items() if y > 0 or n not in train}
            sides = [sum(y == s for y in d.values()) for d in (train, test) for s in (1, -1)]
            if sides[0] >= 2 and sides[2] >= 2 and sides[1] and sides[3]:
                want |= {(g, n, y, True) for n, y in train.items()} | {(g, n, y, False) for n, y in test.items()}
        assert got == want and want


def test_combined_enrichment(spark):
    rows = spark.createDataFrame([("d1", "a", 0.001), ("d2", "a", 0.02), ("d1", "b", 0.5)], "dataset string, name string, padj double")
    known = spark.createDataFrame([("a", 0.001), ("c", 0.001), ("b", 0.9)], "name string, padj double")
    texts = spark.createDataFrame([("a", "set a"), ("c", "set c")], "name string, description string")
    got = {r.name: (r.n_datasets, r.best, r.in_reference, r.description) for r in stats.combined_enrichment(rows, 0.05, texts, known).collect()}
    assert got == {"a": (2, 0.001, True, "set a"), "c": (0, None, True, "set c")}


@pytest.mark.filterwarnings("ignore:bounds")
def test_runs_are_timed_and_named(net, marks, tmp_path):
    edges, _ = net
    settings = {"sinksource": {"should_run": [True], "alpha": [0.8], "solver": ["cg"]}, "sinksource_bounds": {"should_run": [True], "alpha": [0.2]}, "sinksourceplus_bounds": {"should_run": [True], "alpha": [0.2]}, "svm": {"should_run": [True], "max_rounds": [3]}}
    got = runs.run_all(edges, marks[0].filter("term = 't'"), graph.nodes_of(edges), settings, times=str(tmp_path / "times"))
    scores = {a: {r.node: r.score for r in got.filter(F.col("alg") == a).collect()} for a in settings}
    assert len(scores["svm"]) >= 20 and scores["sinksource_bounds"] != scores["sinksourceplus_bounds"] and "n00" not in scores["sinksource_bounds"]
    times = edges.sparkSession.read.parquet(str(tmp_path / "times")).collect()
    assert sorted(r.alg for r in times) == sorted(settings) and all(r.seconds > 0 for r in times)


def test_configurations():
    assert configs.merged({"num_reps": 3, "cv_seed": None}, {"eval_settings": {"num_reps": 9, "cv_seed": 5, "folds": 2}}) == {"num_reps": 3, "cv_seed": 5, "folds": 2}
    settings = {
        "input_dir": "in", "output_dir": "out", "exp_name": "e", "pos_neg_file": "p.txt",
        "algs": {"local": {"should_run": [True]}, "rl": {"should_run": [False], "alpha": [1.0]}},
        "eval_settings": {"cross_validation_folds": 5, "num_reps": 2},
        "networks_to_run": [{"names": ["a", "b"], "net_settings": {"weight": "add"}}, {"names": ["c"], "network_collection": True}],
    }
    made = configs.generate(settings, {"a": ["a.txt"], "b": ["b1.txt", "b2.txt"], "c": ["d/x.txt.gz", "d/y.txt"]})
    assert list(made) == ["a-b-cv5-nr2", "c-cv5-nr2"] and list(made["a-b-cv5-nr2"]["algs"]) == ["local"]
    first, second = (made[k]["input_settings"]["datasets"] for k in made)
    assert first == [{"exp_name": "e", "net_version": "a-b", "net_files": ["a.txt", "b1.txt", "b2.txt"], "pos_neg_file": "p.txt", "weight": "add"}]
    assert [(d["exp_name"], d["net_version"], d["net_files"]) for d in second] == [("e-x", "c/x", ["d/x.txt.gz"]), ("e-y", "c/y", ["d/y.txt"])]
    assert list(next(iter(configs.generate(settings, {"a": [], "b": [], "c": []}, ["RL"]).values()))["algs"]) == ["rl"]
    with pytest.raises(ValueError):
        configs.generate(settings, {"a": []})


def test_a_table_is_kept_until_forced(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(len(made))
    at = str(tmp_path / "kept")
    assert [readers.cached(spark, at, make, f).count() for f in (False, False, True, False)] == [1, 1, 2, 2]

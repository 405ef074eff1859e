"""Faults that the third round's reviewer found."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import blocks as B
from weftgraph.operators import propagate as X
from weftgraph.plans import file_queries
from weftgraph.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def test_drug_dump_is_packed(spark):
    """A dump takes less than the tables' rows that it holds: its tags are packed, in files that many tasks can read."""
    t = Tables(spark, SF)
    files = glob.glob(f"{file_queries._dump(t)}/part-*")
    assert files and all(f.endswith(".gz") for f in files)
    acts = t.lineitem.filter("l_returnflag in ('A', 'R')").select("l_partkey", "l_suppkey", "l_returnflag").distinct().count()
    assert sum(map(os.path.getsize, files)) < 60 * acts


@pytest.fixture(scope="module")
def star(spark):
    """Two hubs of twenty leaves each way."""
    rows = [(hub, f"v{k}", 1.0 + k % 3) for hub in ("h0", "h1") for k in range(20)]
    return spark.createDataFrame(rows + [(b, a, w) for a, b, w in rows], "src string, dst string, weight double")


def _refuse(*_, **__):
    raise AssertionError("not in blocks")


def test_few_keys_take_few_lanes_and_hubs_share_a_block(spark, star):
    net = B.Blocks(star, 5)
    table = spark.createDataFrame([("t", f"v{k}", 1.0) for k in range(20)], "term string, node string, score double")
    state = B.pack_scores(table, net, B.Lanes(table, ["term"]))
    assert all(len(r.cells) == 2 * len(r.places) for r in state.collect())  # a place is 4 bytes, a lane 8
    assert net.index.filter("node like 'h%'").select("block").distinct().count() == 1
    assert net.index.filter("node like 'h%'").join(net.index.filter("node like 'v%'").select("block"), "block").count() == 0


def test_laplacian_is_solved_in_blocks(spark, star, monkeypatch):
    monkeypatch.setattr(X, "conjugate_gradients", _refuse)
    y = spark.createDataFrame([("t", "h0", 1.0), ("u", "v3", 2.0), ("u", "elsewhere", 3.0)], "term string, node string, score double")
    got = {(r.term, r.node): r.score for r in X.laplacian_solve(star, y, 2.0, 1e-11).collect()}
    names = sorted({r.src for r in star.collect()})
    w = np.zeros((22, 22))
    for r in star.collect():
        w[names.index(r.src), names.index(r.dst)] = r.weight
    s = w / np.sqrt(np.outer(w.sum(1), w.sum(1)))
    a = np.eye(22) + 2 * (np.diag(s.sum(0)) - s)
    for term, node, value in (("t", "h0", 1.0), ("u", "v3", 2.0)):
        want = np.linalg.solve(a, value * (np.array(names) == node))
        assert all(abs(got[term, n] - x) < 1e-9 for n, x in zip(names, want, strict=True))
    assert got["u", "elsewhere"] == 3.0


def test_laplacian_of_negative_weights_is_solved_too(spark, star):
    y = spark.createDataFrame([("t", "h0", 1.0)], "term string, node string, score double")
    lap = X.laplacian(star.withColumn("weight", F.lit(1.0)))
    assert lap.count() and X.laplacian_solve(star, y, -0.1, 1e-9).count() == 22


def test_few_rounds_are_multiplied_in_blocks(spark, star, monkeypatch):
    monkeypatch.setattr(X, "spread", _refuse)
    labels = spark.createDataFrame([("t", "h0", 1)], "term string, node string, label int")
    got = {r.node: r.score for r in X.propagate(star, labels, 0.5, 2).collect()}
    assert got["h0"] == 1.0 and got["v3"] == 0.25 and got["h1"] == pytest.approx(0.125)


def test_logistic_reaches_the_minimum(spark):
    """To more digits than a fit by the JVM's optimiser reached, which also failed where its task could not be sent."""
    from weftgraph.operators import classify

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 3)), rng.integers(0, 2, 60)
    rows = [(str(k), [float(v) for v in x[k]], int(y[k]) if k < 50 else None) for k in range(60)]
    got = {r.node: r.score for r in classify.logistic(spark.createDataFrame(rows, "node string, embedding array<double>, y int"), 2.0).collect()}
    p = np.array([got[str(k)] for k in range(60)])
    w = np.linalg.lstsq(np.column_stack([x, np.ones(60)]), np.log(p / (1 - p)), rcond=None)[0]
    assert np.abs(np.r_[w[:3], 0] + 2.0 * np.column_stack([x, np.ones(60)])[:50].T @ (p - y)[:50]).max() < 1e-8


def test_a_line_of_thirty_words_needs_a_stop():
    from weftgraph.llm import quality_rules

    words = " ".join(f"word{k}" for k in range(30))
    assert quality_rules.brute_force(f"{words}\n{words} more.")[1] == [f"{words} more."]
    assert quality_rules.brute_force(f"{words}.\n{words} more.")[1] == [f"{words}.", f"{words} more."]

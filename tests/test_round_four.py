"""What the findings of round 4 name: one network for all sets of a query, and disk that is given back as soon as it can be."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import lineage
from weftgraph.operators import blocks as B
from weftgraph.operators import graph
from weftgraph.operators import propagate as X
from weftgraph.plans import catalog

SF = "/root/testdata/sf0.001"


def _tables(spark):
    """Tables in the shared folder, by the name of what they hold."""
    at = lineage.shared_dir(spark).removeprefix("file:")
    return {name for name in os.listdir(at) if name.startswith("weftgraph")}


def _shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(k).getName() for k in range(files.size())) if name.startswith("shuffle_")}


def _products(net, rows):
    lanes = B.Lanes(rows, ["term"])
    made = net.sums(lambda kept, places, cells: (places, cells), net.products(B.pack_scores(rows, net, lanes)))
    return {(r.term, r.node): r.score for r in B.unpack_scores(made, net, lanes).collect()}


@pytest.mark.parametrize("lam", [None, 0.0, 0.5])
def test_pairs_are_read_both_ways(spark, lam):
    rng = random.Random(7)
    rows = [("v0", f"v{k:02}", rng.random()) for k in range(1, 50)] + [(f"v{a:02}", f"v{b:02}", rng.random()) for a in range(1, 50) for b in rng.sample(range(a + 1, 51), min(2, 50 - a))]
    pairs = spark.createDataFrame([*rows, ("v03", "v03", 2.0), ("w", "w", 1.0)], "src string, dst string, weight double")
    whole = graph.both_ways(pairs)
    assert whole.count() == 2 * len(rows) + 2
    one, two = B.Blocks(pairs, 7, 20, lam=lam, pairs=True, write=True), B.Blocks(whole, 7, 20, lam=lam)
    scores = spark.createDataFrame([(f"t{t}", f"v{k:02}", rng.random()) for t in range(3) for k in rng.sample(range(1, 51), 9)] + [("t0", "w", 1.0)], "term string, node string, score double")
    got, want = _products(one, scores), _products(two, scores)
    assert got.keys() == want.keys() and got == pytest.approx(want)
    assert {tuple(r) for r in one.degrees.collect()} == {tuple(r) for r in graph.degrees(whole).select("node", "degree").collect()}


def test_pairs_are_those_of_the_symmetric_network(spark):
    raw = spark.createDataFrame([("b", "a", 2.0), ("a", "b", 2.0), ("c", "c", 1.0), ("b", "a", 1.0), ("a", "b", 1.0)], "src string, dst string, weight double")
    assert sorted(map(tuple, graph.symmetric_pairs(raw).collect())) == [("a", "b", 3.0), ("c", "c", 1.0)]
    assert sorted(map(tuple, graph.symmetrise(raw).collect())) == [("a", "b", 3.0), ("b", "a", 3.0), ("c", "c", 1.0)]


def test_random_positives_make_one_network(spark):
    """The term and its random sets are keys of one product; before, each run wrote the edges and a network of its own."""
    query = next(q for q in catalog.QUERIES if q.name == "t17_random_positives")
    before = _tables(spark)
    assert query.run(spark, SF).count() > 0
    new = _tables(spark) - before
    assert sum(name.startswith("weftgraph_") for name in new) == 1
    assert not any("edges" in name or "numbered" in name for name in new)


def test_propagation_leaves_the_network_only(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0), ("c", "b", 1.0)], "src string, dst string, weight double")
    labels = spark.createDataFrame([("t", "a", 1)], "term string, node string, label int")
    before = _tables(spark)
    scores = X.propagate(edges, labels, 0.5, 2)
    new = _tables(spark) - before
    assert sum(name.startswith("weftgraph_") for name in new) == 1
    # Of tables that are read again, none holds the edges.
    assert all("weight" not in spark.read.parquet(f"{lineage.shared_dir(spark)}/{name}").columns for name in new if name.startswith("weftgraph-"))
    assert {r.node: r.score for r in scores.collect()} == pytest.approx({"a": 1.0, "b": 0.25, "c": 0.125})


def test_what_was_shuffled_goes_when_it_is_written(spark):
    before = _shuffled(spark)
    kept = spark.conf.get(lineage.CLEANUP, None)
    table = lineage.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    end = time.time() + 10
    while time.time() < end and _shuffled(spark) - before:
        time.sleep(0.1)
    assert not _shuffled(spark) - before and spark.conf.get(lineage.CLEANUP, None) == kept
    assert table.agg(F.sum("count")).first()[0] == 1000


def test_a_scratch_table_ends_with_its_block(spark):
    before = _tables(spark)
    with lineage.scratch(spark.range(5), "test") as table:
        assert table.count() == 5 and len(_tables(spark) - before) == 1
    assert _tables(spark) == before

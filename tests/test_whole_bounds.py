"""Bounds run until ranks are fixed, by the reference's limit of rounds."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import propagate


def _network(spark, rows):
    both = rows + [(b, a, w) for a, b, w in rows]
    return spark.createDataFrame(both, "src string, dst string, weight double"), spark.createDataFrame([("t", "a", 1)], "term string, node string, label int")


def test_bounds_fix_every_rank(spark):
    # c and d differ little, so that 20 rounds at 0.8 leave them open.
    edges, labels = _network(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("b", "d", 1.001), ("c", "e", 1.0), ("d", "e", 1.0)])
    _, rounds = propagate.bounds(edges, labels)
    last = rounds.orderBy(F.desc("round")).first()
    assert last["round"] > 20 and last.unranked == 0


def test_equal_scores_are_told(spark):
    edges, labels = _network(spark, [("a", "b", 1.0), ("a", "c", 1.0)])
    with pytest.warns(UserWarning, match="2 nodes are unranked"):
        _, rounds = propagate.bounds(edges, labels, 0.1)
    last = rounds.orderBy(F.desc("round")).first()
    assert last.unranked == 2 and last["round"] < 40
    with pytest.warns(UserWarning, match="unranked after 3 rounds"):
        propagate.bounds(edges, labels, 0.8, 3)

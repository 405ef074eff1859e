"""Runs that are cut off and tried again, and streams that are started again, leave what one whole run does."""

import pytest

from weftgraph.sources import readers as R
from weftgraph.streaming import edges as E

EVENTS = "event_id long, user_id long, event_type string"


def _write(spark, rows, path):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def test_stream_adds_what_is_new(spark, tmp_path):
    source, kept, checkpoint = (str(tmp_path / x) for x in ("events", "kept", "checkpoint"))
    first = [(1, 1, "a"), (2, 1, "a"), (3, 2, "b"), (4, None, "a"), (5, 3, None)]
    _write(spark, first, source)
    stream = spark.readStream.schema(EVENTS).parquet(source)
    assert sorted(map(tuple, E.keep_edges(stream, kept, checkpoint).collect())) == [("U1", "a", 2.0), ("U2", "b", 1.0)]
    second = [(6, 1, "a"), (7, 2, "c"), (1, 1, "a")]
    _write(spark, second, source)
    whole = sorted(map(tuple, E.event_edges(spark.createDataFrame(first + second, EVENTS)).collect()))
    assert sorted(map(tuple, E.keep_edges(stream, kept, checkpoint).collect())) == whole
    # A third start has nothing to read, and a batch that was cut off isn't read.
    (tmp_path / "kept" / "batch=9").mkdir()
    assert sorted(map(tuple, E.keep_edges(stream, kept, checkpoint).collect())) == whole
    assert E.last_edges_kept(spark, str(tmp_path / "none")).collect() == []


def test_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = lambda n: spark.range(n)
    assert R.open_runs(spark, path, ["a", "b", "a"]) == ["a", "b"]
    with pytest.raises(ValueError, match="no whole run"):
        R.read_runs(spark, path)
    R.write_run(rows(3), path, "a")
    R.write_run(rows(5), path, "b")
    (tmp_path / "runs" / "run=b" / "_SUCCESS").unlink()
    assert R.open_runs(spark, path, ["a", "b"]) == ["b"]
    assert {(r.run, r["count"]) for r in R.read_runs(spark, path).groupBy("run").count().collect()} == {("a", 3)}
    R.write_run(rows(4), path, "b")
    R.write_run(rows(3), path, "a")
    assert {(r.run, r["count"]) for r in R.read_runs(spark, path).groupBy("run").count().collect()} == {("a", 3), ("b", 4)}
    with pytest.raises(ValueError, match="no name"):
        R.write_run(rows(1), path, "../x")

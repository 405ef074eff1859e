"""Cutting the lineage of loops: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None
#: Whether Spark removes what a query has shuffled as the query ends; by default it does when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where it is unset and the session is local."""
    global _local
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    _local = _local or tempfile.mkdtemp(prefix="weftgraph-")
    return _local


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a query that runs in here has shuffled is removed as it ends: for queries that write all they make."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def _write(df: DataFrame, name: str) -> str:
    """The folder of df as a written table, which the driver removes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftgraph-{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    _files(spark, path, lambda files, at: files.deleteOnExit(at))
    return path


def _files(spark: SparkSession, path: str, act) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(at.getFileSystem(spark._jsc.hadoopConfiguration()), at)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later failures restart from the written table.

    Results may read the table as long as the application lives, so that its driver removes it when it ends."""
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, name))


@contextmanager
def scratch(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """df written to the shared folder and read again, in here only: the table is removed at the end of the block."""
    path = _write(df, name)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        _files(df.sparkSession, path, lambda files, at: files.delete(at, True))


def cut(df: DataFrame) -> DataFrame:
    """df with a short plan: each round of a loop begins from a written table."""
    return materialize(df, "round")

"""A named query over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from weftgraph.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    make: Callable[[Tables], DataFrame]
    sql: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.make(Tables(spark, sf_dir))

"""Ranks and running values over one total order of a whole table, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.lineage import materialize


class Ordered:
    """A table dealt into ranges of an order, each sorted by itself. A running value is that within a range and what the
    ranges before it (or after it) give together: a row for each range, of which there are as many as partitions.

    The table's name of its range is `part_`. Rows that the order doesn't tell apart come in any order."""

    def __init__(self, rows: DataFrame, *order: str | Column):
        n = max(1, rows.sparkSession.sparkContext.defaultParallelism)
        self.order = order
        self.rows = materialize(rows.repartitionByRange(n, *order).withColumn("part_", F.spark_partition_id()), "ordered")

    def _local(self) -> Window:
        return Window.partitionBy("part_").orderBy(*self.order)

    def _with(self, each: DataFrame, local: Column, join, name: str) -> Ordered:
        out = object.__new__(Ordered)
        out.order = self.order
        out.rows = self.rows.withColumn("local_", local).join(F.broadcast(each), "part_", "left").withColumn(name, join).drop("local_", "other_")
        return out

    def running_sum(self, value: Column, name: str) -> Ordered:
        """With the sum of a value over all rows up to this one."""
        each = self.rows.groupBy("part_").agg(F.sum(value).alias("sum_"))
        before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
        each = each.select("part_", F.sum("sum_").over(before).alias("other_"))
        local = F.sum(value).over(self._local().rowsBetween(Window.unboundedPreceding, 0))
        return self._with(each, local, F.coalesce("other_", F.lit(0)) + F.coalesce("local_", F.lit(0)), name)

    def rank(self, name: str) -> Ordered:
        """With places from 1."""
        return self.running_sum(F.lit(1).cast("long"), name)

    def following_min(self, value: Column, name: str) -> Ordered:
        """With the least value of this row and all after it."""
        each = self.rows.groupBy("part_").agg(F.min(value).alias("min_"))
        after = Window.orderBy("part_").rowsBetween(1, Window.unboundedFollowing)
        each = each.select("part_", F.min("min_").over(after).alias("other_"))
        local = F.min(value).over(self._local().rowsBetween(0, Window.unboundedFollowing))
        return self._with(each, local, F.least("local_", "other_"), name)

    def table(self) -> DataFrame:
        return self.rows.drop("part_")

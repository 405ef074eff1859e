"""The test tables as networks, labels and mappings: the inputs of the queries in `weftgraph.plans`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Domain tables over one folder of Parquet files; every one is lazy and reads only the columns it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        return self.table(name)

    def raw_edges(self) -> DataFrame:
        """(src, dst, weight) as in a file: supplier to part, one row for each line item."""
        return self.lineitem.select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), F.col("l_quantity").alias("weight"))

    def channel_edges(self) -> DataFrame:
        """(channel, src, dst, weight, seq): a channel for each return flag; seq is a total order of the rows."""
        return self.lineitem.select(
            F.col("l_returnflag").alias("channel"),
            F.concat(F.lit("S"), "l_suppkey").alias("src"),
            F.concat(F.lit("P"), "l_partkey").alias("dst"),
            F.col("l_quantity").alias("weight"),
            ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity")).alias("seq"),
        )

    def labels(self) -> DataFrame:
        """(term, node, label): small parts of a type are its positives, large ones its negatives."""
        label = F.when(F.col("p_size") <= 25, 1).when(F.col("p_size") > 40, -1)
        return self.part.select(F.col("p_type").alias("term"), F.concat(F.lit("P"), "p_partkey").alias("node"), label.alias("label")).filter("label is not null")

    def scores(self) -> DataFrame:
        """(alg, node, score): three rankings of the parts, with ties and gaps."""
        node = F.concat(F.lit("P"), "p_partkey").alias("node")
        one = self.part.select(F.lit("price").alias("alg"), node, F.col("p_retailprice").alias("score"))
        two = self.part.select(F.lit("size").alias("alg"), node, F.col("p_size").cast("double").alias("score"))
        three = self.part.filter("p_partkey % 3 = 0").select(F.lit("third").alias("alg"), node, (F.col("p_partkey") % 97).cast("double").alias("score"))
        return one.union(two).union(three)


#: The same tables in SQL.
EDGES_SQL = """
raw AS (SELECT concat('S', l_suppkey) AS src, concat('P', l_partkey) AS dst, l_quantity AS weight FROM lineitem),
und AS (SELECT src, dst, sum(weight) AS weight FROM raw GROUP BY src, dst),
edges AS (SELECT src, dst, weight FROM und UNION ALL SELECT dst, src, weight FROM und)"""
LABELS_SQL = """
labels0 AS (SELECT p_type AS term, concat('P', p_partkey) AS node,
  CASE WHEN p_size <= 25 THEN 1 WHEN p_size > 40 THEN -1 END AS label FROM part),
terms AS (SELECT * FROM labels0 WHERE label IS NOT NULL)"""
SCORES_SQL = """
scores AS (
  SELECT 'price' AS alg, concat('P', p_partkey) AS node, p_retailprice AS score FROM part
  UNION ALL SELECT 'size', concat('P', p_partkey), CAST(p_size AS DOUBLE) FROM part
  UNION ALL SELECT 'third', concat('P', p_partkey), CAST(p_partkey % 97 AS DOUBLE) FROM part WHERE p_partkey % 3 = 0)"""

"""Networks kept from event streams: windows of events become weighted edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.readers import committed


def windowed_edges(events: DataFrame, length: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(start, src, dst, weight): events of a user and a type in each window; events later than `late` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    counts = timed.groupBy(F.window("ts", length), F.concat(F.lit("U"), "user_id").alias("src"), F.col("event_type").alias("dst"))
    return counts.agg(F.count("*").cast("double").alias("weight")).select(F.col("window.start").alias("start"), "src", "dst", "weight")


def event_edges(events: DataFrame) -> DataFrame:
    """(src, dst, weight): how many events of each type a user has; on a stream, kept by pair as state."""
    ends = events.filter("user_id is not null and event_type is not null").groupBy(F.concat(F.lit("U"), "user_id").alias("src"), F.col("event_type").alias("dst"))
    return ends.agg(F.count("*").cast("double").alias("weight"))


def keep_edges(events: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The network of a stream of events, after what has arrived so far: started again on the same checkpoint, it reads what
    is new and adds it to the state. Each batch writes the network as it then is to a folder of its own, so that a batch
    that is done again replaces itself; the last one is read."""

    def written(network: DataFrame, batch: int) -> None:
        network.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = event_edges(events).writeStream.outputMode("complete").foreachBatch(written).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return last_edges_kept(events.sparkSession, path)


def last_edges_kept(spark: SparkSession, path: str) -> DataFrame:
    """The network of the last batch that was written whole."""
    found = [int(name.split("=")[1]) for name in committed(spark, path)]
    if not found:
        return spark.createDataFrame([], "src string, dst string, weight double")
    return spark.read.parquet(f"{path}/batch={max(found)}")

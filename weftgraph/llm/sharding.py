"""Two-pass external shuffle, in built-in functions only.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash of the key and all else that a record
holds, so that the records of a frequent or null key are spread, too. Records that are wholly equal share that hash; where
more than COPIES do, they are counted first and each copy is scattered by its number, so that any number of them is spread.
Pass two puts each bucket into a fixed order, gives it a seeded Fisher-Yates shuffle, and deals the records out. A record's
place in the whole order is the number of records in earlier buckets plus its place in its own. Shards are runs of places
whose lengths differ by one at most (law `rows`), so that a bucket is written as it is, to one shard or to neighbours, and
numbers have no gaps.

Lost executors: a bucket has one partition id, its order before the shuffle is fixed by its contents, and the random
numbers by seed and partition id, so that a repeated task deals the same records to the same places, however the input is
partitioned.

Defined results: any column may be null; a null text has no bytes. Repeated rows are dealt one by one, and which of two
wholly equal rows comes first makes no difference. Very long texts make larger buckets, as a record is never cut. An empty
table gives an empty table. Columns of the input keep their names; a clashing result name gets a trailing underscore in
`shuffle_records`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm._common import fresh, materialize

#: Records and bytes that a bucket holds on average. Parameters: a cluster with more memory a task takes larger ones.
BUCKET_ROWS = 32_768
BUCKET_BYTES = 32 << 20
SEED = 20_240_229
#: Wholly equal records that may share a bucket; and copies that one row stands for while they are numbered.
COPIES, CHUNK = 64, 1000
#: Bucket counts are summed in blocks of so many buckets, then over the blocks.
BLOCK = 1024
#: Offsets of buckets and hashes of copied records (16 bytes each) are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_ROWS = 1 << 20


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text, and one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def bucket_count(rows: int, size: int) -> int:
    return max(1, -(-rows // BUCKET_ROWS), -(-size // BUCKET_BYTES))


def _scattered(records: DataFrame, key: str, n_buckets: int, seed: int) -> DataFrame:
    """(mix, bucket, row) of all records."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(records.columns)])
    rows = records.select(F.xxhash64(F.lit(seed), F.col(f"`{key}`"), row).alias("mix"), row.alias("row"))
    copied = materialize(rows.groupBy("mix").agg(F.count("*").alias("n")).filter(F.col("n") > COPIES).select("mix"), "copied-records")
    n = copied.count()
    if n:
        found = F.broadcast(copied) if n <= BROADCAST_ROWS else copied
        counted = rows.join(found, "mix", "left_semi").groupBy("mix", "row").agg(F.count("*").alias("n"))
        chunks = counted.select("mix", "row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk")).repartition("mix", "chunk")
        last = F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1
        each = chunks.select("mix", "row", F.explode(F.sequence(F.col("chunk") * CHUNK, last)).alias("i"))
        rows = rows.join(found, "mix", "left_anti").unionByName(each.select(F.xxhash64("mix", "i").alias("mix"), "row"))
    return rows.select("mix", F.pmod("mix", F.lit(n_buckets)).cast("int").alias("bucket"), "row")


def shuffle_records(records: DataFrame, key: str, n_shards: int, n_buckets: int, seed: int = SEED) -> DataFrame:
    """records with `shard` (int) and `slot` (long). The columns must be of types that can be sorted."""
    shard, slot = fresh(records, "shard"), fresh(records, "slot")
    scattered = _scattered(records, key, n_buckets, seed)
    buckets = (
        scattered.repartitionById(n_buckets, F.col("bucket"))
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list(F.struct("mix", "row"))).alias("rows"))
    )
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("bucket") / BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n_block"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n_block").over(earlier), F.lit(0)).alias("base"), F.sum("n_block").over(Window.partitionBy()).alias("total"))
    before = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(blocks, "block").select(
        "bucket", "total", (F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("start")
    )
    if n_buckets <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    # Shard s has the places p with s = p * n div total; it begins at the ceiling of s * total / n.
    dealt = (
        buckets.withColumn("rows", F.shuffle("rows", seed))
        .select("bucket", F.posexplode("rows").alias("i", "r"))
        .join(offsets, "bucket")
        .select("r", (F.col("start") + F.col("i")).alias("place"), "total")
        .select("r", "place", "total", F.expr(f"place * {n_shards} div total").alias("s"))
    )
    return dealt.select(
        *[F.col(f"r.row.c{k}").alias(c) for k, c in enumerate(records.columns)],
        F.col("s").cast("int").alias(shard),
        F.expr(f"place - (s * total + {n_shards - 1}) div {n_shards}").alias(slot),
    )


def write_shards(records: DataFrame, key: str, path: str, n_shards: int, n_buckets: int, seed: int = SEED) -> None:
    """Write the dealt records, a folder for each shard; a file holds a bucket's run of slots, in order. Nothing is moved again."""
    dealt = shuffle_records(records, key, n_shards, n_buckets, seed)
    shard, slot = dealt.columns[-2:]
    dealt.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def shard_plan(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest of the shuffled docs: key, size, text_crc32, law, shard, slot, grown_shard."""
    rows, held = docs.agg(F.count("*"), F.coalesce(F.sum(text_size(F.col(f"`{text}`"))), F.lit(0))).first()
    dealt = shuffle_records(docs, key, n_shards, bucket_count(rows, held))
    shard, slot = dealt.columns[-2:]
    return dealt.select(
        F.col(f"`{key}`"),
        text_size(F.col(f"`{text}`")).alias("size"),
        text_crc32(F.col(f"`{text}`")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col(shard).alias("shard"),
        F.col(slot).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

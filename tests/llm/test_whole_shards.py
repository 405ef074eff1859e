"""Whole records are dealt, and those of one key are spread."""

from weftgraph.llm import sharding


def test_whole_records_are_dealt(spark, monkeypatch):
    made = []
    deal = sharding.shuffle_records
    monkeypatch.setattr(sharding, "shuffle_records", lambda records, key, n, n_buckets, *a: made.append((records.columns, n_buckets)) or deal(records, key, n, n_buckets, *a))
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 1000)
    docs = spark.range(50).selectExpr("id as doc_id", "repeat('x', 99) as text", "'s' as source")
    plan = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_plan(docs).collect()}
    assert made == [(["doc_id", "text", "source"], 5)]
    assert plan == {r.doc_id: (r.shard, r.slot) for r in deal(docs, "doc_id", 8, 5).collect()}


def test_records_of_one_key_are_spread(spark):
    rows = spark.range(4000).selectExpr("cast(null as long) as doc_id", "cast(id as string) as text")
    seen = [int(r.text) for r in sharding.shuffle_records(rows, "doc_id", 1, 8).orderBy("slot").collect()]
    alike = [int(r.text) for r in sharding.shuffle_records(rows.repartition(3), "doc_id", 1, 8).orderBy("slot").collect()]
    assert seen == alike and sorted(seen) == list(range(4000))
    plan = sharding.shuffle_records(rows, "doc_id", 1, 8)
    sizes = [len(x) for x in plan.rdd.glom().collect() if x]
    assert len(sizes) == 8 and max(sizes) < 700


def _sizes(rows, n):
    out = {}
    for r in sharding._scattered(rows, "doc_id", n, sharding.SEED).groupBy("bucket").count().collect():
        out[r.bucket] = r["count"]
    return out


def test_equal_and_null_keys_are_spread_evenly(spark):
    null = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "cast(id as string) as text")
    one = spark.range(20_000).selectExpr("7L as doc_id", "cast(id as string) as text")
    same = spark.range(20_000).selectExpr("7L as doc_id", "'equal' as text")
    for rows in (null, one, same):
        sizes = _sizes(rows, 5)
        assert len(sizes) == 5 and sum(sizes.values()) == 20_000 and all(abs(n - 4000) < 400 for n in sizes.values())
    both = same.union(null)
    plan, again = ({(r.doc_id, r.text, r.shard, r.slot) for r in sharding.shuffle_records(x, "doc_id", 8, 5).collect()} for x in (both, both.repartition(7)))
    assert plan == again and len(plan) == 40_000


def test_shards_and_slots_follow_from_the_order(spark):
    """Places recomputed in plain Python from the buckets that pass one makes."""
    rows = spark.range(3000).selectExpr("id as doc_id", "repeat('x', int(id % 50)) as text")
    for n_shards in (1, 7, 8):
        got = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_records(rows, "doc_id", n_shards, 6).collect()}
        bucket = {r.row.c0: r.bucket for r in sharding._scattered(rows, "doc_id", 6, sharding.SEED).collect()}
        order = sorted(got, key=lambda k: got[k])
        assert [bucket[k] for k in order] == sorted(bucket.values())  # a bucket's records stand together, buckets in order
        sizes = [sum(s == k for s, _ in got.values()) for k in range(n_shards)]
        assert max(sizes) - min(sizes) <= 1
        place, at = {}, 0
        for k in range(n_shards):
            assert sorted(slot for s, slot in got.values() if s == k) == list(range(sizes[k]))
            place |= {x: at + got[x][1] for x in got if got[x][0] == k}
            at += sizes[k]
        assert all(got[x][0] == place[x] * n_shards // 3000 for x in got)


def test_large_records_are_written(spark, tmp_path):
    rows = spark.range(2000).selectExpr("if(id < 1200, 1, id) as doc_id", "if(id = 5, repeat('long ', 400000), repeat(cast(id as string), 20)) as text")
    sharding.write_shards(rows, "doc_id", str(tmp_path / "out"), 4, 6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.exceptAll(back.distinct()).count() == 0 and back.select("doc_id", "text").exceptAll(rows).count() == 0 and back.count() == 2000
    assert sorted((r.shard, r["count"]) for r in back.groupBy("shard").count().collect()) == [(k, 500) for k in range(4)]
    files = list((tmp_path / "out").rglob("*.parquet"))
    assert len(files) <= 6 + 4
    for f in files:
        slots = [r.slot for r in spark.read.parquet(str(f)).collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots)))

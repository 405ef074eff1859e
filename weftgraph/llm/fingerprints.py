"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's set are the distinct hashes of its 5-word shingles, as in the n-gram join; its sketch are the k least of them. The k
least of two sketches together are the sketch of both sets' union, so that sketches of parts make the sketch of the whole,
exactly, in any order. Among the k least of a union, the share of those in both sets estimates the resemblance, and of those
in one set how much of it the other contains; the k-th least tells how many there are. Sets of at most k are told exactly.

A sketch is a sorted array of unsigned 64-bit hashes here, and bytes (big-endian, so that they compare as the hashes do) in
tables. `fingerprint` columns are these bytes in base 64.

Defined results: a null or empty text and one without words have the empty sketch; two empty sketches are alike (1), an empty
one is unlike any other (0). A text of fewer than five words is one shingle. Texts of any length are read whole. Rows with
null or repeated keys are sketched each by its own text. Other columns, whatever their names, are not read; an empty table
gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._common import fresh, slices, utf8
from weftgraph.llm.ngram_join import PIECE, shingle_sets

#: Hashes of a sketch. An estimated resemblance r has a standard error of sqrt(r (1 - r) / K) at most.
K = 64
#: Keys drawn to cut documents into runs of neighbours, and runs for each shuffle partition.
KEYS, RUNS = 20_000, 4
#: Sketches of one group are merged in so many parts first.
PARTS = 64
#: Groups that a task holds at a time.
HELD = 50_000
_NONE = np.zeros(0, np.uint64)


def bottom(x: np.ndarray, k: int = K) -> np.ndarray:
    """The k least of a sorted set."""
    return x[:k]


def merge(sketches: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of a union."""
    return np.unique(np.concatenate([_NONE, *sketches]))[:k]


def distinct(x: np.ndarray, k: int = K) -> float:
    """How many distinct shingles the sketched set has: exact below k."""
    return float(len(x)) if len(x) < k else (k - 1) / (float(x[k - 1]) + 1) * 2.0**64


def _met(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int, int, int]:
    """Among the k least of the union: all, those in both, in a, in b."""
    union = merge((a, b), k)
    in_a, in_b = np.isin(union, a), np.isin(union, b)
    return len(union), int((in_a & in_b).sum()), int(in_a.sum()), int(in_b.sum())


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The sets' Jaccard similarity: exact if their union has at most k."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    n, both, _, _ = _met(a, b, k)
    return both / n


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of the first set that lies in the second; an empty set lies in any."""
    if len(a) == 0:
        return 1.0
    _, both, in_a, _ = _met(a, b, k)
    return both / in_a if in_a else 0.0


def packed(x: np.ndarray) -> bytes:
    return x.astype(">u8").tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, ">u8").astype(np.uint64)


def printed(x: np.ndarray) -> str:
    return base64.b64encode(packed(x)).decode()


def sketches(data: np.ndarray, offsets: np.ndarray, k: int = K) -> list[np.ndarray]:
    """The sketch of each text in a buffer of UTF-8."""
    return [bottom(x, k).copy() for x in shingle_sets(data, offsets)]


def _of_texts(texts: list[bytes], k: int) -> list[np.ndarray]:
    offsets = np.cumsum([0, *map(len, texts)])
    return sketches(np.frombuffer(b"".join(texts), np.uint8), offsets, k)


def sketch_documents(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """docs with `sketch` (bytes) and `n_distinct` (estimated distinct shingles)."""
    sketch, number = fresh(docs, "sketch"), fresh(docs, "n_distinct")
    place = docs.columns.index(text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=text):
            found = sketches(*utf8(batch.column(place)), k)
            own = [pa.array(map(packed, found), pa.binary()), pa.array([distinct(x, k) for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, sketch, number])

    return docs.mapInArrow(run, f"{kinds}, `{sketch}` binary, `{number}` double")


def _merged_in_task(k: int, parts: int):
    """The sketch of what a task reads of each group, in whatever order; groups are given out once there are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict = {}
        for batch in batches:
            kind = batch.schema.types[0]
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[name] = merge((held.get(name, _NONE), unpacked(value)), k)
            if len(held) >= HELD:
                yield _rows(held, TaskContext.get().partitionId() % parts, kind)
                held.clear()
        if held:
            yield _rows(held, TaskContext.get().partitionId() % parts, kind)

    return run


def _merged_in_order(k: int):
    """The sketch of each group; rows come by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            kind = batch.schema.types[0]
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name not in held and len(held) >= HELD:
                    yield _rows(held, 0, kind)
                    held.clear()
                held[name] = merge((held.get(name, _NONE), unpacked(value)), k)
        if held:
            yield _rows(held, 0, kind)

    return run


def _rows(held: dict, part: int, kind: pa.DataType) -> pa.RecordBatch:
    values = pa.array(map(packed, held.values()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(held), kind), values, pa.array(np.full(len(held), part), pa.int64())], names=["by", "sketch", "part"])


def merge_sketches(rows: DataFrame, by: str, k: int = K, sketch: str = "sketch") -> DataFrame:
    """(by, sketch, n_distinct): the sketch of each group's union, null sketches left out.

    Each task merges what it reads of a group before anything is shuffled; what is left meets in PARTS parts of a group first."""
    kind = rows.schema[by].dataType.simpleString()
    schema = f"by {kind}, sketch binary, part bigint"
    out = rows.filter(F.col(f"`{sketch}`").isNotNull()).select(F.col(f"`{by}`").alias("by"), F.col(f"`{sketch}`").alias("sketch"))
    out = out.mapInArrow(_merged_in_task(k, PARTS), schema)
    for keys in (["by", "part"], ["by"]):
        out = out.repartition(*keys).sortWithinPartitions(*keys).select("by", "sketch", "part").mapInArrow(_merged_in_order(k), schema)
    size = F.length("sketch") / 8
    last = F.conv(F.hex(F.substring("sketch", 8 * k - 7, 8)), 16, 10).cast("double")
    number = F.when(size < k, size).otherwise((k - 1) / (last + 1) * 2.0**64)
    return out.select(F.col("by").alias(by), "sketch", number.alias("n_distinct"))


def edited(text: str, following: str) -> str:
    """A text whose last half is replaced by the first characters of the following one, as many or all that it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _key(number: int | None, own: int) -> tuple:
    return (0, 0, own) if number is None else (1, number, own)


def _runs(docs: DataFrame, runs: int) -> list[tuple]:
    """Keys of rows, ascending, the last one that of the greatest: each is the first, in descending order, of a run of neighbours.

    About a fixed number of distinct keys is drawn by hash, so that any key's rows are in proportion; they steer the cut,
    never the result."""
    keys = docs.select("key", "own")
    n, most = keys.agg(F.count("*"), F.max(F.struct(F.col("key").isNotNull().alias("some"), "key", "own"))).first()
    if most is None:
        return []
    drawn = keys.filter(F.pmod(F.xxhash64("key", "own"), F.lit(1 << 30)) < int(min(1, KEYS / n) * (1 << 30))).distinct().collect()
    found = sorted({_key(r.key, r.own) for r in drawn})
    step = max(1, -(-len(found) // runs))
    return sorted({*found[step - 1 :: step], _key(most.key, most.own)})


DIGEST = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _bytes_of(text: bytes, offset: int) -> int:
    """The place of a code point in UTF-8, or the end beyond the last; read in pieces."""
    for at in range(0, len(text), PIECE):
        starts = (np.frombuffer(text[at : at + PIECE], np.uint8) & 0xC0) != 0x80
        n = int(np.count_nonzero(starts))
        if offset < n:
            return at + int(np.flatnonzero(starts)[offset])
        offset -= n
    return len(text)


def fingerprint_digest(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Each document's fingerprint, and how near it is to the next one's and to its own text edited with the next one's.

    The next document is that with the next lower key, then the next lower hash of the text, nulls last; after the last comes
    the first. Documents are dealt once, into runs of neighbours; a run's first row is also sent to the run before, which
    needs it to end. Keys are integers."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.select("key", F.xxhash64("text").alias("own"), "text")
    firsts = _runs(rows, RUNS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = spark.sparkContext.broadcast(firsts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = held.value
        for batch in batches:
            run, extra, take = [], [], []
            for n, (number, own) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                x = _key(number, own)
                at = bisect_left(firsts, x)
                run.append(at)
                extra.append(False)
                take.append(n)
                if firsts[at] == x:
                    run.append((at + 1) % len(firsts))
                    extra.append(True)
                    take.append(n)
            place = pa.array(take, pa.int64())
            columns = [pa.array(run, pa.int64()), pa.array(extra), *(c if len(take) == batch.num_rows else c.take(place) for c in batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=["run", "extra", "key", "own", "text"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (run, key, text, sketch) of the row that waits for its next
        for batch in slices(batches):
            data, offsets = utf8(batch.column(4))
            whole = data.tobytes()
            texts = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            own = sketches(data, offsets, k)
            made, pairs = [], []
            for run, extra, number, value, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts, own, strict=True):
                if before is not None and before[0] == run:
                    _, waiting, old, y = before
                    n = len(old) - int(np.count_nonzero((np.frombuffer(old, np.uint8) & 0xC0) == 0x80))
                    half = n // 2
                    made.append(old[: _bytes_of(old, n - half)] + value[: _bytes_of(value, half)])
                    pairs.append((waiting, n, y, x))
                before = None if extra else (run, number, value, x)
            if not pairs:
                continue
            after = _of_texts(made, k)
            keys, sizes, one, other = zip(*pairs, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in made]),
                    pa.array(map(printed, one), pa.string()),
                    pa.array(map(printed, after), pa.string()),
                    pa.array([resemblance(x, y, k) for x, y in zip(one, after, strict=True)]),
                    pa.array([resemblance(x, y, k) for x, y in zip(one, other, strict=True)]),
                ],
                names=["key", *(x.split()[0] for x in DIGEST.split(", "))],
            )

    dealt = rows.mapInArrow(deal, "run bigint, extra boolean, key bigint, own bigint, text string").repartition("run")
    dealt = dealt.sortWithinPartitions("run", "extra", F.col("key").desc_nulls_last(), F.col("own").desc())
    return dealt.mapInArrow(digest, f"key bigint, {DIGEST}").withColumnRenamed("key", key)

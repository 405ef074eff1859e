"""N-gram Jaccard join: documents whose sets of 5-word shingles are alike, by a grouped prefix join.

Sets are lists of 64-bit shingle hashes in one order for all: shingles seen often come last, then by hash. How often is
told by a sketch of fixed size over all documents, which steers cost but never the result. Two sets that reach the
threshold share a shingle among their prefixes. Documents with the same prefix and size are one group, and groups stand
for their members in the candidate search; equal sets are one node from the start.

Candidates are verified in two rounds. Round one verifies each group with the least of those of like size that it shares
a shingle with (a star, so that a cluster of n copies costs about n checks). Round two takes, from every shared shingle,
the pairs that round one has not yet joined, so that no link between components is missed. Pairs pass a size filter, a
positional filter and a parity bitmap filter first, none of which loses a link; members' whole sets decide. Components follow by alternating large-star and small-star steps.

Defined results: a null text and one without words have an empty set, link with nothing and are their own component. A
text of fewer than five words is one shingle. Equal texts link if they have a word. Rows with a null or repeated key are
judged by their texts; the component's id is its least key that is not null. Texts of any length are read whole, in pieces.
Ties have no choice to make: every link counts. Other columns, whatever their names, are not carried by `link_documents` and
stay in `drop_near_copies`. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._common import fresh, materialize, slices, small_batches, utf8
from weftgraph.llm.url_filter import BlockedBloom, hits

SHINGLE = 5
#: Percent of the union that two linked sets share at least.
PERCENT = 80
#: Counters of the frequency sketch, four bytes each, and rows that it is summed in.
SKETCH, SKETCH_PARTS = 1 << 22, 64
#: Partial sketches added in one task at a time.
FAN_IN = 64
#: Bytes of text that are hashed at a time, and of sets that are compared at a time.
PIECE, COMPARED = 1 << 18, 1 << 20

_RANDOM = np.random.default_rng(20_231)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RANDOM.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64; those for a longer piece than usual are not kept."""
    size = max(n, PIECE)
    if _powers and len(_powers[0]) > size:
        return _powers[0], _powers[1]
    made = [np.cumprod(np.append(np.uint64(1), np.full(size, np.uint64(b)))) for b in (_BASE, _INVERSE)]
    if size == PIECE:
        _powers[:] = made
    return made[0], made[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of some texts, and the number of words before each text and at the end.

    Texts are read in pieces of PIECE bytes, cut between words, so that what it takes besides the texts and the hashes has a
    bound; only a word longer than that makes a longer piece."""
    n = len(data)
    words, starts, at = [], [], 0
    while at < n:
        end = min(at + PIECE, n)
        if end < n:
            gaps = np.flatnonzero(_SEP[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                # No separator here: cut at the next text's begin, or at the next separator, which is looked for by pieces.
                stop = int(offsets[np.searchsorted(offsets, at, side="right")]) if offsets[-1] > at else n
                look = end
                while look < stop and not _SEP[data[look : look + PIECE]].any():
                    look += PIECE
                if look < stop:
                    look += int(np.argmax(_SEP[data[look : look + PIECE]]))
                end = min(look, stop)
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, side="right")] - at
        one, start = _piece_hashes(data[at:end], inner)
        words.append(one)
        starts.append(start + at)
        at = end
    if not words:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(words), np.searchsorted(start, offsets)


def _piece_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in a piece; words end at offsets, too."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    sep = _SEP[data]
    inside = ~sep
    start = np.flatnonzero(inside & (np.concatenate(([True], sep[:-1])) | edge[:-1]))
    end = np.flatnonzero(inside & (np.concatenate((sep[1:], [True])) | edge[1:])) + 1
    up, down = _tables(n)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[data] * up[:n])))
    return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(data, offsets)
    if len(words) >= SHINGLE:
        n = len(words) - SHINGLE + 1
        whole = _mix(sum((words[k : k + n] * _PLACE[k] for k in range(SHINGLE)), np.zeros(n, np.uint64)))
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            x = np.sort(whole[a : b - SHINGLE + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            sets.append(x[keep])
        elif b > a:
            one = words[a:b] * _PLACE[: b - a]
            sets.append(_mix(np.array([one.sum(dtype=np.uint64) + np.uint64(b - a)])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def prefix_size(n: int) -> int:
    """So many of the first shingles of a set of n meet those of every set that it may link with."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def _identity(x: np.ndarray, salt: int) -> int:
    """A hash of a set; as a signed 64-bit number."""
    total = np.array([(int(x.sum(dtype=np.uint64)) + len(x) * 0x2545F4914F6CDD1D ^ salt) % (1 << 64)], np.uint64)
    other = np.bitwise_xor.reduce(_mix(x + np.uint64(salt))) if len(x) else np.uint64(0)
    return int(_mix(_mix(total) + np.array([other], np.uint64)).view(np.int64)[0])


def _sketch(texts: DataFrame) -> np.ndarray:
    """Documents for each counter of the sketch, summed in a tree of bounded fan-in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        for batch in slices(batches, PIECE):
            sets = shingle_sets(*utf8(batch.column(0)))
            if sets:
                np.add.at(counts, (np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), 1)
        if counts.any():
            from pyspark import TaskContext

            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, SKETCH_PARTS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(SKETCH_PARTS, TaskContext.get().partitionId(), np.int64)), pa.array(np.arange(SKETCH_PARTS)), pa.array(parts, pa.binary())], names=["task", "part", "counts"]
            )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH // SKETCH_PARTS, np.uint32)
        for x in pdf.counts:
            total = _saturating(total, np.frombuffer(zlib.decompress(x), np.uint32))
        return pd.DataFrame({"task": [pdf.task.iloc[0] // FAN_IN], "part": [pdf.part.iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    rows = texts.mapInArrow(count, "task bigint, part bigint, counts binary")
    tasks = texts.rdd.getNumPartitions()
    while True:
        rows = rows.groupBy(F.floor(F.col("task") / FAN_IN).alias("block"), "part").applyInPandas(lambda _, pdf: add(pdf), "task bigint, part bigint, counts binary")
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    total = np.zeros(SKETCH, np.uint32)
    size = SKETCH // SKETCH_PARTS
    for row in rows.collect():  # SKETCH_PARTS rows of a fixed size
        total[row.part * size : (row.part + 1) * size] = np.frombuffer(zlib.decompress(row.counts), np.uint32)
    return total


def _saturating(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = a + b
    return np.where(total < a, np.uint32(0xFFFFFFFF), total)


def _levels(counts: np.ndarray) -> np.ndarray:
    """How far each counter stands out: 0 for what chance gives, then by powers of two."""
    mean = counts.mean()
    excess = counts - (mean + 6 * np.sqrt(mean) + 8)
    return np.where(excess > 0, 1 + np.floor(np.log2(np.maximum(excess, 1))), 0).astype(np.uint8)


def _bitmap(x: np.ndarray) -> bytes:
    """Parity of the set's shingles over two to four bits for each: the bits in which two sets' maps differ are no more
    than the shingles in which the sets do."""
    size = max(64, 1 << (2 * len(x) - 1).bit_length()) if len(x) else 64
    counts = np.bincount(((x >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """Bits in which two maps differ; the longer is folded to the length of the shorter."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) != len(b):
        size = min(len(a), len(b))
        a, b = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _print(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def _documents(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """key, print (a hash of the text), n, node (a hash of the set), grp (a hash of prefix and size), prefix (in the common order), bits (its bitmap)."""
    held = docs.sparkSession.sparkContext.broadcast(levels)
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = held.value
        for batch in slices(batches, PIECE):
            sets = shingle_sets(*utf8(batch.column(1)))
            n, node, group, prefix = [], [], [], []
            for x in sets:
                order = np.argsort(levels[(x & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")
                first = x[order[: prefix_size(len(x))]]
                n.append(len(x))
                node.append(_identity(x, 11))
                group.append(_identity(first, 23 + len(x)))
                prefix.append(first)
            ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(n, pa.int64()),
                    pa.array(node, pa.int64()),
                    pa.array(group, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), _signed(flat)),
                    pa.array([_bitmap(x) for x in sets], pa.binary()),
                ],
                names=["key", "print", "n", "node", "grp", "prefix", "bits"],
            )

    rows = docs.select("key", "text", _print(F.col("text")).alias("print"))
    return rows.mapInArrow(run, f"key {kind}, print bigint, n bigint, node bigint, grp bigint, prefix array<bigint>, bits binary")


def _may_link(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """Size, prefix and positional filters for a shingle at places p1 and p2 of sets of sizes n1 and n2.

    At the first shingle that two linked sets share, all of them hold."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    need = -(-PERCENT * (n1 + n2) // (100 + PERCENT))
    short = small - -(-2 * PERCENT * small // (100 + PERCENT)) + 1
    early = np.where(n1 < n2, p1 < short, np.where(n2 < n1, p2 < short, np.minimum(p1, p2) < short))
    return (100 * small >= PERCENT * large) & early & (np.minimum(n1 - p1, n2 - p2) >= need)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut between values of the first column; a value is never parted."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        if len(columns[0]) == 0:
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1], side="left"))
        if cut:
            yield [c[:cut] for c in columns]
        held = [c[cut:] for c in columns]
    if held is not None and len(held[0]):
        yield held


def _starts(token: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], token[1:] != token[:-1]))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, place, node) of shared tokens, each with the leader it is checked with and whether it may link.

    Rows come by token and place, so that the leader is the set with the fewest rarer shingles before the shared one: in
    a cluster of edited copies, the one that is like most others. Rows of sets too small or large for it get the next.

    A token may have any number of rows. From one batch to the next only its leaders are held, whose sizes are pairwise
    unlike and so are few; or its only row so far, which counts if another follows."""
    held, old = None, 0
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if len(columns[0]) == 0:
            continue
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        token, place, node = columns
        new = np.arange(len(token)) >= old
        start = _starts(token)
        alone = start & np.append(start[1:], True)
        last, leaders, single = token[-1], [], alone[-1]
        if single:
            held, old = [c[-1:] for c in columns], 0
        token, place, node, new = (c[~alone] for c in (token, place, node, new))
        while len(token):
            p, n = place >> 32, place & 0xFFFFFFFF
            rows = np.arange(len(token))
            lead = np.maximum.accumulate(np.where(_starts(token), rows, 0))
            like = 100 * np.minimum(n, n[lead]) >= PERCENT * np.maximum(n, n[lead])
            may = (lead != rows) & _may_link(n[lead], p[lead], n, p)
            if token[-1] == last:
                leaders.append([c[lead[-1:]] for c in (token, place, node)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[like & new]) for c in (token, place, node, node[lead], may)], names=["token", "place", "node", "lead", "may"]
            )
            token, place, node, new = (c[~like] for c in (token, place, node, new))
        if not single:
            held, old = [np.concatenate(x) for x in zip(*leaders, strict=True)], len(leaders)


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows (token, place, node, lead, part) that may link, stand in different parts and weren't checked as a star."""
    for token, place, node, lead, part in _runs(batches):
        bounds = np.append(np.flatnonzero(_starts(token)), len(token))
        mixed = np.minimum.reduceat(part, bounds[:-1]) != np.maximum.reduceat(part, bounds[:-1])
        for a, b in zip(bounds[:-1][mixed].tolist(), bounds[1:][mixed].tolist(), strict=True):
            if b - a == 2 and (lead[a] == node[b - 1] or lead[b - 1] == node[a]):
                continue
            p, n = place[a:b] >> 32, place[a:b] & 0xFFFFFFFF
            order = np.argsort(n, kind="stable")
            p, n, own, head, group = p[order], n[order], node[a:b][order], lead[a:b][order], part[a:b][order]
            ends = np.searchsorted(n, n * 100 // PERCENT, side="right")
            left, right = [], []
            for i in range(b - a - 1):
                j = np.arange(i + 1, ends[i])
                j = j[(group[j] != group[i]) & (head[j] != own[i]) & (head[i] != own[j]) & _may_link(n[i], p[i], n[j], p[j])]
                if len(j):
                    left.append(np.full(len(j), own[i]))
                    right.append(own[j])
            if left:
                x, y = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _close(nodes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave a link possible."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = np.array([_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)], np.int64)
            # Sets that share s of sizes m and n differ in m + n - 2 s; the threshold bounds s from below.
            keep = (100 + PERCENT) * (sizes - apart) >= 2 * PERCENT * sizes
            yield batch.select([0, 1]).filter(pa.array(keep))

    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x"))
    two = nodes.select(F.col("node").alias("b"), "n", F.col("bits").alias("y"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "m", "n", "x", "y")
    return materialize(joined.mapInArrow(check, "a bigint, b bigint"), f"{name}-close")


def _name(key: Column, *more: Column) -> Column:
    """A key, and what else tells a row, as a string that is never null."""
    return F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), key.isNull().cast("string"), *[x.cast("string") for x in more])


def _verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold; nodes has size, bitmap and a document's key for each node."""
    pairs = _close(nodes, pairs, name)
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = materialize(nodes.join(need, "node", "left_semi").select("node", "key"), f"{name}-wanted")
    bloom = BlockedBloom(wanted.select(_name(F.col("key")).alias("key")).distinct())
    held = docs.sparkSession.sparkContext.broadcast(bloom.words.view(np.uint64))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of the documents that the filter passes: a few more than are wanted do no harm, and no document moves."""
        for batch in batches:
            batch = batch.filter(pa.array(hits(held.value, batch.column(1).to_numpy(), batch.column(2).to_numpy())))
            for part in slices([batch], PIECE):
                made = shingle_sets(*utf8(part.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array([_identity(x, 11) for x in made], pa.int64()), pa.array([x.tobytes() for x in made], pa.binary())], names=["node", "shingles"])

    made = docs.select("text", *bloom.hashes(_name(F.col("key")))).mapInArrow(sets, "node bigint, shingles binary")
    made = materialize(made.dropDuplicates(["node"]), f"{name}-sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, COMPARED, "y"):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(made.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    joined = joined.join(made.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    return materialize(joined.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"), name)


def components(links: DataFrame) -> DataFrame:
    """(node, part) for the nodes of links (a, b) but for each component's least node, which is its part."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, last = materialize(edges, "links"), None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == last or mark[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("part"))
        last = mark
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(moved.union(small.select("u", "m")).distinct(), "small")


def _parted(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("token").sortWithinPartitions("token", *order)


def link_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, component_id (the least key of its component)."""
    out = _linked(docs, key, text)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _linked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, print, n, part (a component, null for a text without words) and component_id of every row.

    All rounds are written here, in batches that are small in bytes."""
    with small_batches(docs.sparkSession):
        return _rounds(docs, key, text)


def _rounds(docs: DataFrame, key: str, text: str) -> DataFrame:
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    levels = _levels(_sketch(docs.select("text")))
    made = materialize(_documents(docs, levels), "documents")
    full = made.filter("n > 0")
    nodes = full.groupBy("node").agg(F.min("key").alias("key"), F.first("grp").alias("grp"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = materialize(nodes, "nodes")
    groups = full.groupBy("grp").agg(F.min("node").alias("node"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    rows = groups.select(F.posexplode("prefix").alias("p", "token"), "n", "node")
    rows = rows.select("token", F.shiftleft(F.col("p").cast("long"), 32).bitwiseOR(F.col("n")).alias("place"), "node")
    shared = "token bigint, place bigint, node bigint, lead bigint, may boolean"
    shared = materialize(_parted(rows, "place", "node").mapInArrow(_stars, shared), "shared")

    # Groups of several sets: each member is checked with the group's own node, and shares all its tokens.
    heads = nodes.groupBy("grp").agg(F.min("node").alias("head"), F.count("*").alias("size")).filter("size > 1")
    members = materialize(nodes.join(heads.select("grp", "head"), "grp").select("head", "node", "n"), "members")
    inner = members.filter("head <> node").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b"))
    stars = shared.filter("may").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"))
    first = materialize(stars.union(inner).distinct(), "first-pairs")
    links = _verify(docs, nodes, first, "first-links")
    parts = components(links)

    others = members.filter("head <> node").select(F.col("head").alias("lead_node"), F.col("node").alias("member"))
    # Round one checked a member with its head alone, and not with the leaders that the head was checked with.
    spread = shared.join(others, shared.node == others.lead_node).select("token", "place", F.col("member").alias("node"), F.col("lead_node").alias("lead"))
    within = members.select(F.col("head").alias("token"), F.col("n").alias("place"), "node", F.col("head").alias("lead"))
    rest = shared.select("token", "place", "node", "lead").union(spread).union(within).join(parts, "node", "left")
    rest = rest.select("token", "place", "node", "lead", F.coalesce("part", "node").alias("part"))
    # Most shingles of a cluster of copies lie in one component by now; only the others' rows are brought together.
    rest = materialize(rest, "rest")
    mixed = rest.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    rest = rest.join(mixed.select("token"), "token", "left_semi")
    second = _parted(rest, "place", "node").mapInArrow(_rest, "a bigint, b bigint").distinct().join(first, ["a", "b"], "left_anti")
    second = materialize(second, "second-pairs")
    if second.limit(1).count():
        more = _verify(docs, nodes, second, "second-links")
        parts = components(parts.select(F.col("node").alias("a"), F.col("part").alias("b")).union(more))

    labelled = made.select("key", "print", "n", "node").join(parts, "node", "left").select("key", "print", "n", F.when(F.col("n") > 0, F.coalesce("part", "node")).alias("part"))
    least = labelled.filter("n > 0").groupBy("part").agg(F.min("key").alias("least"), F.count("*").alias("size")).filter("size > 1")
    # Written apart, so that the join's large side is dealt by itself and a large component can be split.
    out = labelled.join(materialize(least.select("part", "least"), "least"), "part", "left")
    own = F.when(F.col("n") > 0, F.coalesce("least", "key")).otherwise(F.col("key"))
    return out.select("key", "print", "n", "part", own.alias("component_id"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that with the least key that is not null, then the least hash of its text.

    Rows are told apart by key and text, so that rows that share a key are judged each by its own text. Of rows with equal
    key and text the least by its other columns stays (any, where these can't be ordered). Texts without words link with nothing, so that each of their rows stays."""
    rows = materialize(_linked(docs, key, text), "linked-rows")
    order = F.struct(F.col("key").isNull().alias("no"), "key", "print")
    firsts = rows.filter("part is not null").groupBy("part").agg(F.min(order).alias("f"), F.count("*").alias("size")).filter("size > 1")
    firsts = materialize(firsts.select("part", "f.key", "f.print"), "first-rows").select("part", F.col("key").alias("k"), F.col("print").alias("p"))
    later = rows.join(firsts, "part").filter(~(F.col("key").eqNullSafe(F.col("k")) & (F.col("print") == F.col("p"))))
    later = materialize(later.select("key", "print").distinct(), "later-rows")
    twice = materialize(rows.filter("part is not null").groupBy("key", "print").agg(F.count("*").alias("size")).filter("size > 1").select("key", "print"), "equal-rows")
    name = fresh(docs, "print")
    marked = docs.withColumn(name, _print(F.col(f"`{text}`")))

    def among(t: DataFrame, how: str, left: DataFrame) -> DataFrame:
        """The rows that are (left_semi) or aren't (left_anti) in a table of keys and prints. Rows that a filter of bounded
        size passes are joined with it; the others are certain, and stay where they are."""
        may = fresh(left, "may")
        told = BlockedBloom(t.select(_name(F.col("key"), F.col("print")).alias("key"))).holds(_name(F.col(f"`{key}`"), F.col(name)))
        left = left.withColumn(may, told)
        t = t.select(F.col("key").alias("_key"), F.col("print").alias("_print"))
        possible = left.filter(may)
        joined = possible.join(t, possible[f"`{key}`"].eqNullSafe(t["_key"]) & (possible[name] == t["_print"]), how)
        return (joined if how == "left_semi" else joined.unionByName(left.filter(~F.col(may)))).drop(may)

    kept = among(later, "left_anti", marked)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not twice.limit(1).count():
        return kept.select(*columns)
    several = among(twice, "left_semi", kept).withColumn(fresh(marked, "whole"), F.struct(*columns))
    whole = several.columns[-1]
    try:
        one = several.groupBy(F.col(f"`{key}`").alias("k"), F.col(name).alias("p")).agg(F.min(whole).alias("r"))
        one.schema  # noqa: B018  (asks for the analysis)
    except AnalysisException:
        one = several.groupBy(F.col(f"`{key}`").alias("k"), F.col(name).alias("p")).agg(F.first(whole).alias("r"))
    return among(twice, "left_anti", kept).select(*columns).unionByName(one.select("r.*"))


def brute_force(texts: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
    """(key, size of the set, component) by comparing all pairs; for tests."""
    import re

    sets = []
    for _, text in texts:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))} if words else set())
    part = list(range(len(texts)))

    def root(x: int) -> int:
        while part[x] != x:
            x = part[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= PERCENT * len(x | sets[j]):
                part[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (k, _) in enumerate(texts):
        least[root(i)] = min(k, least.get(root(i), k))
    return [(k, len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(texts)]

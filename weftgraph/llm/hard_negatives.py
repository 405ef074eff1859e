"""Hard-negative mining by ball trees: each anchor's nearest rows of its label, and rows of other labels that score almost as high.

Rows are dealt into parts of bounded size. Each part builds a ball tree for each label; a ball bounds the inner products of its
rows with an anchor from both sides. Positives are the first rows of the anchor's own label: a ball strictly beneath the
anchor's current last place is passed by. Negatives are looked for in all other labels' trees, for all of an anchor's positives
at once, each with its window of scores: a ball that lies above or beneath the window, or strictly beneath the current last
place, is passed by. What the parts find is ranked again by anchor. Bounds only pass by what can't be in the result.

Anchors are a stated part of the rows and meet every part in blocks; a part is read by one task, with its anchors in turn.

Scores are inner products of floor(scale * x), as integers. Defined results: rows with a null key, label or vector, a null or
non-finite component, or a vector so long that its scores may not fit 64 bits (squared length of 2^62 or more) take no part.
Vectors of unlike length are compared as if the shorter ended in zeros; an empty one scores 0. Rows that share a key are one
row: that with the least label, then vector. Ties go to the smaller key. An anchor without positives, and a positive without
negatives, give no row; an empty table gives an empty table. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm._common import materialize

#: Rows of a part, on average; rows of a leaf; anchors searched at once.
PART_ROWS, LEAF, BLOCK = 16_384, 48, 512
#: Squared lengths below this keep every score within 64 bits.
LONGEST = 1 << 62
_LOW = np.iinfo(np.int64).min


def _product(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of rows. Doubles hold them exactly, and use the fast product, while squared lengths are below 2^53."""
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if exact else a @ b.T


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    first: int
    end: int
    children: list[Node] = field(default_factory=list)


class Tree:
    """A ball tree over rows of one label. Of rows with equal vectors the first `keep` by key are held: later ones come after
    these in every ranking of at most that many."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, keep: int):
        order = np.lexsort((keys, *vectors.T))
        keys, vectors = keys[order], vectors[order]
        new = np.ones(len(keys), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        begin = np.flatnonzero(new)
        nth = np.arange(len(keys)) - begin[np.cumsum(new) - 1]
        self.keys, self.vectors = keys[nth < keep], vectors[nth < keep]
        self.exact = bool((self.vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < 2**52)
        self.points = self.vectors.astype(np.float64)
        self.root = self._node(0, len(self.keys))
        del self.points

    def _node(self, first: int, end: int) -> Node:
        points = self.points[first:end]
        centre = points.mean(axis=0)
        away = np.sqrt(((points - centre) ** 2).sum(axis=1))
        node = Node(centre, float(away.max(initial=0)), first, end)
        if end - first > LEAF and node.radius > 0:
            far = points[int(away.argmax())]
            other = points[int(((points - far) ** 2).sum(axis=1).argmax())]
            side = points @ (other - far)
            order = np.argsort(side, kind="stable")
            for x in (self.keys, self.vectors, self.points):
                x[first:end] = x[first:end][order]
            half = first + (end - first) // 2
            node.children = [self._node(first, half), self._node(half, end)]
        return node


class Best:
    """For each query the first k of (score, key): by score, then the smaller key."""

    def __init__(self, n: int, k: int):
        self.scores = np.full((n, k), _LOW)
        self.keys = np.full((n, k), np.iinfo(np.int64).max)

    @property
    def last(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        """Scores of some queries with some keys; _LOW where a key isn't for the query."""
        better = (scores >= self.last[rows][:, None]).any(axis=1) & (scores > _LOW).any(axis=1)
        rows, scores = rows[better], scores[better]
        if not len(rows):
            return
        k = self.scores.shape[1]
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        keys = np.concatenate([self.keys[rows], np.broadcast_to(keys, (len(rows), len(keys)))], axis=1)
        order = np.lexsort((keys, -1 - scores), axis=1)[:, :k]  # -1 - x turns the order and can't overflow
        self.scores[rows] = np.take_along_axis(scores, order, axis=1)
        self.keys[rows] = np.take_along_axis(keys, order, axis=1)


def search(tree: Tree, best: Best, rows: np.ndarray, owner: np.ndarray, vectors: np.ndarray, keys: np.ndarray, low: np.ndarray, high: np.ndarray, visited: list[int] | None = None) -> None:
    """Add to `best` what the tree's rows give to some queries: scores from low to high, never with the query's own key.

    Queries (places in best) may share an anchor: owner is the place of theirs in vectors. low and high are by query; a query
    looks for its first rows, so that its last place so far counts as a lower end as well."""
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    exact = tree.exact and bool((length < 2**26).all())
    floats = vectors.astype(np.float64)
    stack = [(tree.root, rows)]
    while stack:
        node, rows = stack.pop()
        anchors, at = np.unique(owner[rows], return_inverse=True)
        middle = floats[anchors] @ node.centre
        # What doubles may err by, and a half more, so that a bound never falls short of an exact score.
        slack = node.radius * length[anchors] * (1 + 1e-9) + np.abs(middle) * 1e-9 + length[anchors] * (np.abs(node.centre).max(initial=0) + 1) * 1e-9 + 0.5
        top, bottom = (middle + slack)[at], (middle - slack)[at]
        stay = (top >= low[rows]) & (bottom <= high[rows]) & (top >= best.last[rows])
        rows, at = rows[stay], at[stay]
        if not len(rows):
            continue
        if node.children:
            mean = [float((floats[owner[rows]] @ c.centre).mean()) for c in node.children]
            stack += [(c, rows) for _, c in sorted(zip(mean, node.children, strict=True), key=lambda x: x[0])]  # the nearer is popped first
            continue
        if visited is not None:
            visited[0] += len(rows) * (node.end - node.first)
        used, at = np.unique(owner[rows], return_inverse=True)
        own_keys = tree.keys[node.first : node.end]
        scores = _product(vectors[used], tree.vectors[node.first : node.end], exact)
        scores = np.where(own_keys[None, :] == keys[used][:, None], _LOW, scores)[at]
        best.add(rows, np.where((scores >= low[rows][:, None]) & (scores <= high[rows][:, None]), scores, _LOW), own_keys)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors, padded with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], Iterator[pa.RecordBatch]]]:
    """For each part its rows, and its anchors as they come. Batches are sorted by part, rows before anchors."""
    waiting: list[pa.RecordBatch] = []
    source = iter(batches)

    def pull() -> bool:
        while not waiting:
            batch = next(source, None)
            if batch is None:
                return False
            part, anchor = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((part[1:] != part[:-1]) | (anchor[1:] != anchor[:-1])) + 1
            waiting.extend(batch.slice(a, b - a) for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True) if b > a)
        return True

    def of(part: int, anchor: bool) -> Iterator[pa.RecordBatch]:
        while pull() and waiting[0].column(0)[0].as_py() == part and waiting[0].column(1)[0].as_py() == anchor:
            yield waiting.pop(0)

    while pull():
        part = waiting[0].column(0)[0].as_py()
        rows, anchors = list(of(part, False)), of(part, True)
        yield rows, anchors
        for _ in anchors:
            pass


FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, key bigint, score bigint"


def _find(k: int, keep: int, width: int, others: bool):
    """What a part gives to each anchor (rows of its label), or to each of its positives (rows of other labels, in the window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, anchors in _parts(batches):
            trees: dict = {}
            if rows:
                keys = np.concatenate([b.column(2).to_numpy() for b in rows])
                labels = np.concatenate([b.column(3).to_numpy() for b in rows])
                vectors = np.concatenate([_matrix(b.column(4), width) for b in rows])
                order = np.argsort(labels, kind="stable")
                names, begin = np.unique(labels[order], return_index=True)
                for name, own in zip(names.tolist(), np.split(order, begin[1:]), strict=True):
                    trees[name] = Tree(keys[own], vectors[own], keep)
            for batch in anchors:
                for at in range(0, batch.num_rows, BLOCK):
                    block = batch.slice(at, BLOCK)
                    if others:
                        block = block.filter(pc.greater(pc.list_value_length(block.column(5)), 0))
                    out = _block(trees, block, k, width, others) if block.num_rows else None
                    if out is not None:
                        yield out

    return run


def _block(trees: dict, block: pa.RecordBatch, k: int, width: int, others: bool) -> pa.RecordBatch | None:
    keys, labels, vectors = block.column(2).to_numpy(), block.column(3).to_numpy(), _matrix(block.column(4), width)
    if others:
        owner = np.repeat(np.arange(len(keys)), block.column(5).value_lengths().to_numpy(zero_copy_only=False))
        positive = block.column(5).flatten().to_numpy(zero_copy_only=False)
        high = block.column(6).flatten().to_numpy(zero_copy_only=False)
        low = block.column(7).flatten().to_numpy(zero_copy_only=False)
    else:
        owner, positive = np.arange(len(keys)), np.zeros(len(keys), np.int64)
        low, high = np.full(len(keys), _LOW + 1), np.full(len(keys), np.iinfo(np.int64).max)
    best = Best(len(owner), k)
    for name, tree in trees.items():
        rows = np.flatnonzero((labels[owner] == name) != others)
        if len(rows):
            search(tree, best, rows, owner, vectors, keys, low, high)
    at, place = np.nonzero(best.scores > _LOW)
    if not len(at):
        return None
    columns = keys[owner[at]], positive[at], high[at], best.keys[at, place], best.scores[at, place]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in FOUND.split(", ")])


def _dealt(rows: DataFrame, anchors: DataFrame, parts: int) -> DataFrame:
    """Each part's rows, then all anchors."""
    empty = F.array().cast("array<bigint>")
    at = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("long")
    own = rows.select(at.alias("part"), F.lit(False).alias("anchor"), "key", "label", "vector", empty.alias("positives"), empty.alias("highs"), empty.alias("lows"))
    # Anchors are a hundredth of the rows by contract; each part needs all of them.
    sent = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(True).alias("anchor"), "key", "label", "vector", "positives", "highs", "lows")
    return own.unionByName(sent).repartition("part").sortWithinPartitions("part", "anchor", "key")


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80, scale: int = 256, part_rows: int = PART_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, embedding).

    anchor: a condition on vec_id that says which rows are anchors. An anchor's positives are its first rows of the same label;
    a positive's negatives the first rows of other labels whose score is from low_percent of the positive's to the positive's."""
    spark = rows.sparkSession
    ints = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")))
    # A component that a long can't hold stays the greatest one here, and so makes the vector too long.
    squares = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + F.pow(F.floor(scale * x.cast("double")).cast("double"), F.lit(2.0)))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    clean = rows.select("vec_id", "label", "embedding").filter("vec_id is not null and label is not null and embedding is not null").filter(finite).filter(squares < float(LONGEST))
    clean = clean.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), ints.alias("vector"))
    once = clean.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select(F.col("vec_id").alias("key"), "r.label", "r.vector")
    once = materialize(once, "vectors")
    n, width = once.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = max(1, width or 0)
    parts = max(1, -(-n // part_rows), min(4 * spark.sparkContext.defaultParallelism, -(-n // 512)))
    empty = F.array().cast("array<bigint>")
    chosen = once.withColumn("vec_id", F.col("key")).filter(anchor).drop("vec_id")
    asked = chosen.select("key", "label", "vector", empty.alias("positives"), empty.alias("highs"), empty.alias("lows"))
    near = _dealt(once, asked, parts).mapInArrow(_find(positives, positives + 1, width, False), FOUND)
    near = _first(near, ["anchor_id"], positives).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "key", "score"))).alias("p"))
    # 100 * negative >= low_percent * positive, in whole numbers.
    least = F.transform("p", lambda x: F.ceil(x["score"].cast("decimal(20,0)") * low_percent / 100).cast("long"))
    near = near.select(F.col("anchor_id").alias("key"), F.col("p.key").alias("positives"), F.col("p.score").alias("highs"), least.alias("lows"))
    asked = materialize(chosen.join(near, "key"), "anchors")
    found = _dealt(once, asked, parts).mapInArrow(_find(negatives, negatives, width, True), FOUND)
    found = _first(found, ["anchor_id", "positive_id"], negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def shifted(rows: DataFrame) -> DataFrame:
    """The contract's rows: labels of keys divisible by 7 become the next of ten."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def brute_force(rows: list[tuple[int, int, list[int]]], every: int, positives: int = 5, negatives: int = 5, low: int = 80) -> list[tuple]:
    """The result over integer vectors by comparing all; for tests."""

    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    found = []
    for key, label, vector in rows:
        if key % every:
            continue
        ranked = sorted((-score(vector, v), k, l) for k, l, v in rows if k != key)
        near = [(s, k) for s, k, l in ranked if l == label][:positives]
        for s, k in near:
            wrong = [(x, i) for x, i, l in ranked if l != label and low * -s <= 100 * -x <= 100 * -s][:negatives]
            found += [(key, k, r + 1, i, -s, -x) for r, (x, i) in enumerate(wrong)]
    return sorted(found)

"""Networks of hubs and spokes: every edge touches one of a few hubs, as the nations of a trade network, and labels are on hubs.

What a spoke gets in a round follows from its hubs alone, so that the spokes can be eliminated: two steps from hub to hub through
all spokes are a matrix of hubs, which one pass over the spokes sums. Rounds and solvers then run on that matrix (at most
MOST x MOST numbers, on the driver), and one pass gives the spokes their scores. Any other network is multiplied by `propagate`'s
joins or `blocks`: `spokes_of` gives None for it."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.lineage import materialize

#: Hubs at most, nodes for each hub at least, labels and scores of hubs that the driver holds.
MOST, SHARE, LABELS, HELD = 256, 4, 1 << 18, 1 << 16
#: Spokes of a packed row, edges of a task that packs them, scores that a task orders at once, and those of a lane's range.
TILE, TASK_EDGES, ORDERED, RANGE = 1024, 1 << 20, 1 << 21, 1 << 20
#: Lanes of a pass, and lanes at most.
LANES, MOST_LANES = 128, 4096


class Spokes:
    """A network of hubs and spokes with its labels; made by `spokes_of`."""

    def __init__(self, edges: DataFrame, hubs: list, nodes: int, count: int, top: float, labels: list, keys: list[str], kinds):
        self.spark, self.hubs, self.nodes, self.top, self.keys = edges.sparkSession, hubs, nodes, top, keys
        self.kind = edges.schema["src"].dataType.simpleString()
        width = self.width = len(hubs)
        places = {h: k for k, h in enumerate(hubs)}
        ends = F.broadcast(self.spark.createDataFrame([(h, k) for h, k in places.items()], f"hub {self.kind}, place int"))
        placed = edges.select("src", "dst", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
        placed = placed.join(ends.select(F.col("hub").alias("src"), F.col("place").alias("one")), "src", "left")
        placed = placed.join(ends.select(F.col("hub").alias("dst"), F.col("place").alias("two")), "dst", "left")
        self.core, self.linked = np.zeros((width, width)), np.zeros((width, width), bool)
        for r in placed.filter("one is not null and two is not null").groupBy("one", "two").agg(F.sum("weight").alias("w")).collect():  # hubs by hubs
            self.core[r.one, r.two], self.linked[r.one, r.two] = r.w, True
        out = F.col("two").isNotNull()
        one = placed.filter("one is null or two is null").select(
            F.when(out, F.col("src")).otherwise(F.col("dst")).alias("node"), F.when(out, F.col("two")).otherwise(F.col("one") + width).alias("place"), "weight"
        )
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-count // TASK_EDGES))
        rows = one.repartition(tasks, "node").groupBy("node").agg(F.collect_list("place").alias("places"), F.collect_list("weight").alias("weights"))
        self.table = materialize(rows.mapInArrow(_packer(2 * width), f"names array<{self.kind}>, at binary, weights binary"), "spokes")
        self.lanes = list(dict.fromkeys(tuple(r[: len(keys)]) for r in labels))
        number = {k: i for i, k in enumerate(self.lanes)}
        self.kinds = ", ".join(f"{k} {kinds[k].dataType.simpleString()}" for k in keys)
        #: Labels as (lane, hub, label), with NaN for null.
        self.labels = np.array([(number[tuple(r[: len(keys)])], places[r[-2]], np.nan if r[-1] is None else r[-1]) for r in labels]).reshape(-1, 3)
        self._reduce()

    def tiles(self, make: Callable, schema: str) -> DataFrame:
        """make(tiles) for each task; a tile is (names, weights to hubs, weights from hubs, which of either are edges)."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def unpacked():
                for batch in batches:
                    for k in range(batch.num_rows):
                        names = batch.column(0)[k].values
                        at = np.frombuffer(batch.column(1)[k].as_buffer(), np.int32)
                        dense, has = np.zeros(len(names) * 2 * width), np.zeros(len(names) * 2 * width, bool)
                        dense[at], has[at] = np.frombuffer(batch.column(2)[k].as_buffer(), np.float64), True
                        dense, has = dense.reshape(-1, 2 * width), has.reshape(-1, 2 * width)
                        yield names, dense[:, :width], dense[:, width:], has[:, :width], has[:, width:]

            yield from make(unpacked())

        return self.table.mapInArrow(run, schema)

    def _reduce(self) -> None:
        """Sums over all spokes: two steps from hub to hub, which of them there are, hubs' strengths; whether weights are the same both ways.

        `lam` (see `row_normalise`) changes spokes' strengths, so that its steps are summed by `steps`."""
        self.strength, self.passes, self.symmetric = self.core.sum(1), np.zeros_like(self.linked), True
        self._steps = {}
        self.steps(0.0)
        back = np.abs(self.core - self.core.T) > 1e-9 * np.abs(self.core)
        self.symmetric = self.symmetric and not back.any()

    def steps(self, lam: float) -> np.ndarray:
        """Hub to hub through spokes: sums of W_hi W_ij / d_i."""
        if lam in self._steps:
            return self._steps[lam]
        width, more = self.width, lam * self.top

        def make(tiles):
            sums, ways, strength, odd = np.zeros((width, width)), np.zeros((width, width)), np.zeros(width), 0.0
            for _, out, back, is_out, is_back in tiles:
                sums += back.T @ (out * _inverse(out.sum(1) + more)[:, None])
                ways += is_back.T.astype(float) @ is_out.astype(float)
                strength += back.sum(0)
                odd = max(odd, float((np.abs(out - back) > 1e-9 * np.minimum(np.abs(out), np.abs(back))).any()))
            flat = np.concatenate([sums.ravel(), ways.ravel(), strength])
            yield pa.RecordBatch.from_pydict({"k": np.arange(len(flat) + 1), "v": np.append(flat, odd)})

        flat = np.zeros(2 * width * width + width + 1)
        for r in self.tiles(make, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            flat[r.k] = r.v
        n = width * width
        self._steps[lam] = flat[:n].reshape(width, width)
        if len(self._steps) == 1:
            self.passes, self.strength = flat[n : 2 * n].reshape(width, width) > 0, self.strength + flat[2 * n : -1]
            self.symmetric = not flat[-1]
        return self._steps[lam]

    def marks(self, which: Callable) -> np.ndarray:
        """Hubs by lanes: whether a lane's hub has such a label."""
        out = np.zeros((self.width, len(self.lanes)), bool)
        chosen = self.labels[which(self.labels[:, 2])]
        out[chosen[:, 1].astype(int), chosen[:, 0].astype(int)] = True
        return out

    def named(self, found: DataFrame, *columns: str) -> DataFrame:
        """Lanes replaced by their keys."""
        lanes = self.spark.createDataFrame([(k, *x) for k, x in enumerate(self.lanes)], f"lane int, {self.kinds}")
        return found.join(F.broadcast(lanes), "lane").select(*self.keys, *columns)

    def scores(self, x: np.ndarray, own: np.ndarray, factor: float = 1.0, lam: float = 0.0, reached: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
        """(keys, node, score): factor * P x of the spokes and `own` of the hubs, without zeros; reached: hubs whose neighbours
        have a score, if of 0, and hubs that have."""
        more, width = lam * self.top, len(self.lanes)

        def make(tiles):
            for names, out, _, is_out, _ in tiles:
                s = factor * _product(out * _inverse(out.sum(1) + more)[:, None], x)
                row, lane = np.nonzero(s if reached is None else _product(is_out, reached[0]))
                yield pa.RecordBatch.from_arrays([pa.array(lane.astype(np.int32)), names.take(pa.array(row)), pa.array(s[row, lane])], names=["lane", "node", "score"])

        found = self.tiles(make, f"lane int, node {self.kind}, score double")
        hubs = np.nonzero(own if reached is None else reached[1])
        rows = [(int(lane), self.hubs[h], float(own[h, lane])) for h, lane in zip(*hubs, strict=True)]
        assert own.shape == (self.width, width)
        return self.named(found.unionByName(self.spark.createDataFrame(rows, f"lane int, node {self.kind}, score double")), "node", "score")


def _inverse(d: np.ndarray) -> np.ndarray:
    return np.divide(1.0, d, out=np.zeros(len(d)), where=d != 0)


def _product(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a x, summed in the order of hubs, so that equal rows of any two tiles give the same numbers."""
    out = np.zeros((len(a), x.shape[1]))
    for h in np.flatnonzero(a.any(0)):
        out += a[:, h, None] * x[h]
    return out


def _packer(width: int):
    """Spokes with lists of places and weights as rows of TILE spokes; edges that are there twice are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TILE):
                part = batch.slice(a, TILE)
                lengths = np.diff(part.column(1).offsets.to_numpy())
                at = np.repeat(np.arange(part.num_rows), lengths) * width + part.column(1).flatten().to_numpy(zero_copy_only=False)
                at, where = np.unique(at, return_inverse=True)
                weights = np.bincount(where, part.column(2).flatten().to_numpy(zero_copy_only=False), len(at))
                names = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([names, pa.array([at.astype(np.int32).tobytes()]), pa.array([weights.tobytes()])], names=["names", "at", "weights"])

    return run


def spokes_of(edges: DataFrame, labels: DataFrame, keys: list[str]) -> Spokes | None:
    """The network as hubs and spokes if it is one: no negative weights, labels on MOST nodes at most, and with the nodes of
    highest degrees these are MOST hubs at most, and a SHARE-th of the nodes, of which every edge has one."""
    rows = labels.select(*keys, "node", F.col("label").cast("double")).limit(LABELS + 1).collect()
    marked = list(dict.fromkeys(r[-2] for r in rows))
    if len(rows) > LABELS or len(marked) > MOST or None in marked:
        return None
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    degrees = materialize(ends.groupBy("node").count(), "degrees")
    nodes = degrees.count()
    by_degree = [r.node for r in degrees.orderBy(F.desc("count"), "node").limit(MOST).collect()]
    ranked = marked + [n for n in by_degree if n not in set(marked)]
    kind = edges.schema["src"].dataType.simpleString()
    ranks = F.broadcast(edges.sparkSession.createDataFrame([(n, k) for k, n in enumerate(ranked) if n is not None], f"hub {kind}, rank int"))
    none = 4 * MOST
    near = edges.join(ranks.select(F.col("hub").alias("src"), F.col("rank").alias("a")), "src", "left").join(ranks.select(F.col("hub").alias("dst"), F.col("rank").alias("b")), "dst", "left")
    rank = F.when(F.isnull("src") | F.isnull("dst"), none).otherwise(F.least(F.coalesce("a", F.lit(none)), F.coalesce("b", F.lit(none))))
    seen = near.agg(F.max(rank).alias("rank"), F.count("*").alias("n"), F.min("weight").alias("least"), F.max("weight").alias("top")).first()
    if not seen.n or seen.rank == none or (seen.least or 0.0) < 0:
        return None
    hubs, lanes = ranked[: max(seen.rank + 1, len(marked))], len({tuple(r[: len(keys)]) for r in rows})
    if len(hubs) > MOST or len(hubs) * SHARE > nodes or not 0 < lanes <= min(MOST_LANES, HELD // len(hubs)):
        return None
    return Spokes(edges, hubs, nodes, seen.n, float(seen.top or 0.0), rows, keys, labels.schema)


def _reduced(net: Spokes, alpha: float, lam: float, root: bool = False) -> np.ndarray:
    """alpha P, or alpha W / sqrt(d d'), between hubs, with the spokes eliminated."""
    d = net.strength + lam * net.top
    inverse = _inverse(np.sqrt(d) if root else d)
    both = alpha * net.core + alpha * alpha * net.steps(lam)
    return inverse[:, None] * both * (inverse if root else 1.0)


def _fixed(net: Spokes, plus: bool) -> tuple[np.ndarray, np.ndarray]:
    ones = net.marks(lambda y: y > 0)
    return ones, ones if plus else net.marks(lambda y: np.ones(len(y), bool))


def fixed_point(net: Spokes, alpha: float, method: str, tol: float, max_rounds: int, plus: bool, lam: float) -> DataFrame:
    """(keys, node, score) of free nodes: the fixed point of `propagate`. method: cg, bicgstab or semi (Chebyshev's semi-iteration)."""
    ones, fixed = _fixed(net, plus)
    root = method == "cg"
    r = _reduced(net, alpha, lam, root)
    scale = np.sqrt(net.strength + lam * net.top) if root else np.ones(net.width)
    given = np.where(fixed, 0.0, r @ (ones * scale[:, None]))
    times = lambda v: np.where(fixed, 0.0, r @ v)
    x = {"cg": _conjugate, "bicgstab": _stabilised, "semi": _semi}[method](times, given, tol, max_rounds, alpha)
    x = x * _inverse(scale)[:, None]
    return net.scores(np.where(ones, 1.0, x), x, alpha, lam)


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=np.abs(b) > 1e-300)


def _conjugate(times, y: np.ndarray, tol: float, max_rounds: int, _: float) -> np.ndarray:
    """x = times(x) + y for all lanes by conjugate gradients."""
    x, r, p = np.zeros_like(y), y.copy(), y.copy()
    rr = (r * r).sum(0)
    for _ in range(max_rounds):
        q = p - times(p)
        a = np.where(np.sqrt(rr) > tol, _over(rr, (p * q).sum(0)), 0.0)
        x, r = x + a * p, r - a * q
        new = (r * r).sum(0)
        p, rr = r + _over(new, rr) * p, new
        left = float(np.sqrt(new).max(initial=0.0))
        if left <= tol:
            break
    else:
        warnings.warn(f"conjugate_gradients: a residual of {left:.3g} is left after {max_rounds} rounds", stacklevel=4)
    return x


def _stabilised(times, y: np.ndarray, tol: float, max_rounds: int, _: float) -> np.ndarray:
    """x = times(x) + y for all lanes by stabilised two-sided gradients; a lane that breaks down begins anew, as in `propagate`."""
    x, r, q, p = np.zeros_like(y), y.copy(), y.copy(), y.copy()
    for _ in range(max_rounds):
        v = p - times(p)
        rho = (q * r).sum(0)
        a = np.where(np.sqrt((r * r).sum(0)) > tol, _over(rho, (q * v).sum(0)), 0.0)
        s = r - a * v
        u = s - times(s)
        w = _over((u * s).sum(0), (u * u).sum(0))
        x = x + a * p + np.where(a != 0, w * s, 0.0)
        r = np.where(a != 0, s - w * u, r)
        rr, after = (r * r).sum(0), (q * r).sum(0)
        dead = (np.abs(after) < 1e-14 * rr) | (a == 0) | (w == 0)
        b = np.where(dead, 0.0, _over(after, rho) * _over(a, w))
        q, p = np.where(dead, r, q), np.where(dead, r, r + b * (p - w * v))
        left = float(np.sqrt(rr).max(initial=0.0))
        if left <= tol:
            break
    else:
        warnings.warn(f"stabilised_gradients: a residual of {left} is left after {max_rounds} rounds", stacklevel=4)
    return x


def _semi(times, y: np.ndarray, tol: float, max_rounds: int, bound: float) -> np.ndarray:
    """x = times(x) + y for all lanes by Chebyshev's semi-iteration; rows of the reduced matrix sum to the bound at most."""
    if not 0 <= bound < 1:
        raise ValueError(f"semi_iterate needs a bound from 0 to below 1, not {bound}")
    shrink = bound / (1 + np.sqrt(1 - bound * bound))
    wanted = max(1, int(np.ceil(np.log(tol / 2) / np.log(shrink)))) if shrink > 0 else 1
    if wanted > max_rounds:
        warnings.warn(f"semi_iterate: an error of {2 * shrink**max_rounds:.3g} of the solution may be left after {max_rounds} rounds", stacklevel=4)
    old, x, w = np.zeros_like(y), y, 1.0
    for k in range(1, min(wanted, max_rounds) + 1):
        w = 1 / (1 - bound * bound / 2) if k == 1 else 1 / (1 - bound * bound * w / 4)
        old, x = x, w * (times(x) + y) + (1 - w) * old
    return x


class Rounds:
    """Hubs' scores, and which have one, after each round of `propagate` from 0: positives are 1 from the start."""

    def __init__(self, net: Spokes, alpha: float, plus: bool):
        self.net, self.alpha, (self.ones, self.fixed) = net, alpha, _fixed(net, plus)
        inverse = _inverse(net.strength)[:, None]
        self._core, self._steps = alpha * inverse * net.core, alpha * alpha * inverse * net.steps(0.0)
        self.x, self.has = [self.ones.astype(float)], [self.ones]

    def upto(self, k: int) -> None:
        net = self.net
        while len(self.x) <= k:
            new = self._core @ self.x[-1] + (self._steps @ self.x[-2] if len(self.x) > 1 else 0.0)
            has = net.linked.astype(float) @ self.has[-1] > 0
            if len(self.x) > 1:
                has |= net.passes.astype(float) @ self.has[-2] > 0
            self.x.append(np.where(self.ones, 1.0, np.where(self.fixed, 0.0, new)))
            self.has.append(np.where(self.fixed, self.ones, has))

    def statistics(self, first: int, last: int, top: np.ndarray, ends: list[np.ndarray]) -> dict:
        """{(round, lane): (unranked, stretch, greatest change, bound, least score, nodes)} of rounds first to last, of lanes
        with scores. ends: where the ranges of a lane's scores begin, by which tasks merge them."""
        net, alpha, n = self.net, self.alpha, len(self.net.lanes)
        self.upto(last)
        before = np.concatenate([self.x[k - 1] if k else np.zeros_like(self.x[0]) for k in range(first - 1, last + 1)], axis=1)
        has = np.concatenate(self.has[first - 1 : last], axis=1).astype(float)
        bound = np.concatenate([alpha**k / (1 - alpha) * top for k in range(first, last + 1)])

        def made(scores: np.ndarray, change: np.ndarray, there: np.ndarray):
            """A row for each lane and range: chains of scores each within the bound of the one before."""
            rows, order = [], np.sort(np.where(there, scores, np.inf).T, axis=1)
            least = np.where(there & (scores > 0), scores, np.inf).min(0)
            most = np.where(there, change, -np.inf).max(0)
            count = there.sum(0)
            for lane in np.flatnonzero(count):
                v = order[lane, : count[lane]]
                part = np.searchsorted(ends[lane % n], v, side="right")
                start = np.flatnonzero(np.concatenate(([True], (v[:-1] + bound[lane] < v[1:]) | (part[1:] != part[:-1]))))
                size, stop = np.diff(np.append(start, len(v))), np.append(start[1:], len(v)) - 1
                cuts = np.flatnonzero(np.concatenate(([True], np.diff(part[start]) != 0)))
                for a, b in zip(cuts, [*cuts[1:], len(start)], strict=True):
                    many = np.flatnonzero(size[a:b] > 1)
                    rows.append((int(lane), int(part[start[a]]), float(most[lane]), float(least[lane]), v[start[a:b]].tobytes(), many.astype(np.int32).tobytes(), v[stop[a:b][many]].tobytes(), size[a:b][many].tobytes()))
            return rows

        names = ["lane", "part", "change", "least", "starts", "many", "stops", "sizes"]
        types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 4]
        schema = "lane int, part int, change double, least double, starts binary, many binary, stops binary, sizes binary"

        def make(tiles):
            held, size = [], 0

            def batches():
                rows = made(*map(np.concatenate, zip(*held, strict=True))) if held else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

            for _, out, _, is_out, _ in tiles:
                s = alpha * _product(out * _inverse(out.sum(1))[:, None], before)
                held.append((s[:, n:], s[:, n:] - s[:, :-n], is_out.astype(float) @ has > 0))
                size += len(out) * len(bound)
                if size >= ORDERED:
                    yield from batches()
                    held, size = [], 0
            yield from batches()

        # Hubs are few, and are one more row of each lane.
        now = np.concatenate(self.x[first : last + 1], axis=1)
        old = np.concatenate([np.where(self.ones, 0.0, x) for x in self.x[first - 1 : last]], axis=1)
        there = np.concatenate([h & ~self.fixed for h in self.has[first : last + 1]], axis=1)
        rows = net.tiles(make, schema).unionByName(net.spark.createDataFrame(made(now, now - old, there), schema))
        merged = rows.groupBy("lane", "part").applyInPandas(_merger(bound), "lane int, part int, change double, least double, n bigint, low double, high double, chains array<bigint>, rest bigint")
        found: dict = {}
        for r in sorted(merged.collect(), key=lambda r: (r.lane, r.part)):  # some numbers for each round, lane and range
            found.setdefault(r.lane, []).append(r)
        out = {}
        for lane, parts in found.items():
            unranked, stretch = _joined(parts, bound[lane])
            out[first + lane // n, lane % n] = unranked, stretch, max(r.change for r in parts), float(bound[lane]), min(r.least for r in parts), sum(r.n for r in parts)
        return out

    def history(self, last: int) -> DataFrame:
        """(keys, round, x, y): scores of free nodes in each round that they have one, and in the last."""
        net, alpha, n, hubs = self.net, self.alpha, len(self.net.lanes), self.net.width
        self.upto(last)
        before, has = np.stack(self.x[:last], 1), np.stack(self.has[:last], 1).astype(float)
        width = max(1, LANES // last)
        schema = "lane int, round int, x double, y double"

        def make(tiles):
            for _, out, _, is_out, _ in tiles:
                scaled = alpha * out * _inverse(out.sum(1))[:, None]
                for c in range(0, n, width):
                    m = min(width, n - c)
                    x = _product(scaled, before[:, :, c : c + m].reshape(hubs, -1))
                    row, at = np.nonzero(is_out.astype(float) @ has[:, :, c : c + m].reshape(hubs, -1) > 0)
                    values = [(c + at % m).astype(np.int32), (1 + at // m).astype(np.int32), x[row, at], x[row, (last - 1) * m + at % m]]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["lane", "round", "x", "y"])

        rows = [(int(c), k, float(self.x[k][h, c]), float(self.x[last][h, c])) for k in range(1, last + 1) for h, c in zip(*np.nonzero(self.has[k] & ~self.fixed), strict=True)]
        return net.named(net.tiles(make, schema).unionByName(net.spark.createDataFrame(rows, schema)), "round", "x", "y")


def _merger(bound: np.ndarray):
    """Chains of all tasks merged: those of a range's scores, whole. What lies between the first and the last chain is told by
    its stretches of chains of several scores: at the beginning, the longest, and at the end, 0 where a lone score parts them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lane = int(pdf.lane.iloc[0])
        starts = [np.frombuffer(x, np.float64) for x in pdf.starts]
        stops, sizes = [s.copy() for s in starts], [np.ones(len(s), np.int64) for s in starts]
        for k, (many, stop, size) in enumerate(zip(pdf.many, pdf.stops, pdf.sizes, strict=True)):
            at = np.frombuffer(many, np.int32)
            stops[k][at], sizes[k][at] = np.frombuffer(stop, np.float64), np.frombuffer(size, np.int64)
        starts, stops, sizes = map(np.concatenate, (starts, stops, sizes))
        order = np.argsort(starts, kind="stable")
        starts, stops, sizes = starts[order], np.maximum.accumulate(stops[order]), sizes[order]
        new = np.flatnonzero(np.concatenate(([True], stops[:-1] + bound[lane] < starts[1:])))
        chains = np.add.reduceat(sizes, new)
        inner = chains[1:-1]
        lone = np.flatnonzero(inner == 1)
        told, rest = [], 0
        if len(inner) and not len(lone):
            told = [int(inner.sum())]
        elif len(inner):
            edges = np.concatenate(([-1], lone, [len(inner)]))
            sums = np.concatenate(([0], np.cumsum(inner)))
            runs = sums[edges[1:]] - sums[edges[:-1] + 1]
            told = [int(runs[0]), 0, int(runs[1:-1].max(initial=0)), 0, int(runs[-1])]
            rest = int(runs.sum()) - sum(told)
        told = [int(chains[0]), *told, *([int(chains[-1])] if len(chains) > 1 else [])]
        return pd.DataFrame({"lane": [lane], "part": [int(pdf.part.iloc[0])], "change": [pdf.change.max()], "least": [pdf.least.min()], "n": [int(sizes.sum())], "low": [starts[0]], "high": [stops[-1]], "chains": [told], "rest": [rest]})

    return run


def _joined(parts: list, bound: float) -> tuple[int, int]:
    """(unranked, longest stretch) of a lane whose ranges follow one another."""
    chains, rest, high = [], 0, None
    for r in parts:
        own = list(r.chains)
        if high is not None and high + bound >= r.low:
            own[0] += chains.pop()
        # A lone score is 0 from here on unless the next range's first chain takes it up.
        chains += own
        rest += r.rest
        high = r.high
    sizes = [0 if c == 1 else c for c in chains]
    longest = run = 0
    for c in sizes:
        run = run + c if c else 0
        longest = max(longest, run)
    return sum(sizes) + rest, longest


def bounded(net: Spokes, alpha: float, max_rounds: int, plus: bool) -> tuple[Rounds, int, int, list[tuple]]:
    """`propagate.bounds` on hubs and spokes: (rounds, the last one, nodes left unranked, statistics by key and round)."""
    rounds, n = Rounds(net, alpha, plus), len(net.lanes)
    rounds.upto(1)
    first = rounds.x[0]

    def tops(tiles):
        most = np.zeros(n)
        for _, out, _, _, _ in tiles:
            most = np.maximum(most, (alpha * _product(out * _inverse(out.sum(1))[:, None], first)).max(0, initial=0.0))
        yield pa.RecordBatch.from_pydict({"lane": np.arange(n, dtype=np.int32), "top": most})

    top = np.where(rounds.fixed, 0.0, rounds.x[1]).max(0, initial=0.0)
    for r in net.tiles(tops, "lane int, top double").groupBy("lane").agg(F.max("top").alias("top")).collect():
        top[r.lane] = max(top[r.lane], r.top)
    ends = [np.zeros(0) for _ in range(n)]
    parts = -(-net.nodes // RANGE)
    if parts > 1:
        # Quantiles of late scores deal the ranges; every range is merged whole, wherever its ends lie.
        rounds.upto(64)
        number = {k: i for i, k in enumerate(net.lanes)}
        late = net.scores(rounds.x[63], np.zeros_like(first), alpha)
        for r in late.groupBy(*net.keys).agg(F.percentile_approx("score", F.array(*[F.lit(k / parts) for k in range(1, parts)]), 100 * parts).alias("q")).collect():
            ends[number[tuple(r[: len(net.keys)])]] = np.unique(r.q)
    found, k, left, reached, each = [], 0, 0, 0, max(1, LANES // max(1, n))
    done = False
    while not done and k < max_rounds:
        some = rounds.statistics(k + 1, min(max_rounds, k + each), top, ends)
        for k in range(k + 1, min(max_rounds, k + each) + 1):
            rows = [(lane, some[k, lane]) for lane in range(n) if (k, lane) in some]
            found += [(*net.lanes[lane], int(s[0]), int(s[1]), float(s[2]), s[3], k) for lane, s in rows]
            seen, reached, left = reached, sum(s[5] for _, s in rows), sum(s[0] for _, s in rows)
            moving = any(s[0] > 0 and np.isfinite(s[4]) and s[3] > s[4] * 2.0**-54 for _, s in rows)
            if reached == seen and not (left and moving) or not reached:
                done = True
                break
    return rounds, k, left, found


def machine(net: Spokes, loss: str, c: float, tol: float, max_rounds: int) -> tuple[DataFrame, list[tuple], float, int]:
    """`classify.network_scores` on hubs and spokes: ((keys, node, score) of products with the last weights, biases by key,
    the last move, rounds). Weights are S a for a on labelled nodes, so that a round is one of hubs; how far it moves any
    weight is asked of the spokes for many rounds in one pass."""
    n = len(net.lanes)
    lane, hub, y = net.labels[:, 0].astype(int), net.labels[:, 1].astype(int), net.labels[:, 2]
    root = _inverse(np.sqrt(net.strength))
    one = root[:, None] * net.core * root
    two = root[:, None] * net.steps(0.0) * root + one @ one
    count = np.bincount(lane, minlength=n)
    curve = (0.25 if loss == "logistic" else 2.0) * c
    step = 1 / (1 + 2 * curve)
    a, bias, moves, states = np.zeros((net.width, n)), np.zeros(n), [], []
    for _ in range(max_rounds):
        margin = y * ((two @ a)[hub, lane] + bias[lane])
        pull = np.nan_to_num(c * (y / (1 + np.exp(np.minimum(margin, 700.0))) if loss == "logistic" else 2 * y * np.maximum(0.0, 1 - margin)))
        new = (1 - step) * a
        np.add.at(new, (hub, lane), step * pull)
        moved = np.bincount(lane, pull, n)
        bias = bias + moved / (2 * curve * count)
        moves.append((new - a, float(np.abs(moved / count).max(initial=0.0))))
        a = new
        states.append((a, bias))
    far, at, each = 0.0, -1, max(1, LANES // max(1, n))
    while at + 1 < len(moves):
        some = moves[at + 1 : at + 1 + each]
        change = np.concatenate([root[:, None] * d for d, _ in some], axis=1)

        def farthest(tiles, change=change):
            most = np.zeros(change.shape[1])
            for _, out, _, _, _ in tiles:
                most = np.maximum(most, np.abs(_product(out * np.sqrt(_inverse(out.sum(1)))[:, None], change)).max(0, initial=0.0))
            yield pa.RecordBatch.from_pydict({"lane": np.arange(len(most), dtype=np.int32), "far": most})

        most = np.abs(np.concatenate([one @ d for d, _ in some], axis=1)).max(0, initial=0.0)
        for r in net.tiles(farthest, "lane int, far double").groupBy("lane").agg(F.max("far").alias("far")).collect():
            most[r.lane] = max(most[r.lane], r.far)
        for k, (_, g) in enumerate(some):
            far, at = max(float(most[k * n : (k + 1) * n].max(initial=0.0)), g), at + 1
            if far <= tol:
                break
        if far <= tol:
            break
    a, bias = states[at] if states else (a, bias)
    return _machine_scores(net, one @ a, two @ a, root), [(*key, float(b)) for key, b in zip(net.lanes, bias, strict=True)], far, at + 1


def _machine_scores(net: Spokes, w: np.ndarray, own: np.ndarray, root: np.ndarray) -> DataFrame:
    """(keys, node, score): S w, of spokes from the hubs' weights and of hubs as given. A spoke has no spoke for a neighbour."""

    def make(tiles):
        x = root[:, None] * w
        for names, out, _, _, _ in tiles:
            s = _product(out * np.sqrt(_inverse(out.sum(1)))[:, None], x)
            row, lane = np.nonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(lane.astype(np.int32)), names.take(pa.array(row)), pa.array(s[row, lane])], names=["lane", "node", "score"])

    schema = f"lane int, node {net.kind}, score double"
    hubs = [(int(lane), net.hubs[h], float(own[h, lane])) for h, lane in zip(*np.nonzero(own), strict=True)]
    return net.named(net.tiles(make, schema).unionByName(net.spark.createDataFrame(hubs, schema)), "node", "score")

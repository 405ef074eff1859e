"""Label propagation, Laplacian diffusion and their relatives: every term, fold and repetition is a key of one table.

A product of the network with all score vectors is one join and one sum (`spread`). STATIC rounds of propagation at most are one
plan of such products. Longer runs multiply in blocks (`blocks`), as a joined row for every edge and key is too much to move: edges
stay where they were written, and scores of many keys travel as dense rows. Loops cut the lineage every round."""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from weftgraph.functions.lineage import cut
from weftgraph.operators.blocks import Blocks, Lanes, by_place, cells_of, pack_scores, places_of, unpack_scores
from weftgraph.operators.graph import both_ways, laplacian, row_normalise, symmetric_normalise
from weftgraph.operators.spokes import bounded, fixed_point, spokes_of
from weftgraph.operators.stats import kendall_tau

#: Rounds of propagation that are one plan, and rounds whose scores are summed at once.
STATIC, MOST_PARTS = 1, 16


def spread(edges: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, score): sum over neighbours j of W_ij * score_j."""
    joined = edges.join(scores.withColumnRenamed("node", "dst"), "dst")
    return joined.groupBy(*keys, F.col("src").alias("node")).agg(F.sum(F.col("weight") * F.col("score")).alias("score"))


def local(edges: DataFrame, labels: DataFrame, plus: bool = False, keys: list[str] | None = None) -> DataFrame:
    """One step of the row-normalised network from the labels; plus: without the negatives. Positives aren't pinned."""
    keys = keys or ["term"]
    y = labels.filter("label > 0") if plus else labels
    return spread(row_normalise(edges), y.select(*keys, "node", F.col("label").cast("double").alias("score")), keys)


def propagate(
    edges: DataFrame | None, labels: DataFrame, alpha: float = 0.95, rounds: int = 10, eps: float = 0.0, plus: bool = False, lam: float = 0.0, keys: list[str] | None = None, net: Blocks | None = None, pairs: bool = False
) -> DataFrame:
    """Propagation from fixed positives: s <- alpha * (P s + P 1_pos) on free nodes, from 0, for `rounds` rounds, or until no
    score grows by more than eps. Positives end at 1; negatives are fixed at 0 (plus: there are none).

    net: the blocks of the network, normalised with lam, if there are some; edges are not read then. pairs: an edge is there once
    and is read both ways."""
    keys = keys or ["term"]
    fixed = (labels.filter("label > 0") if plus else labels).select(*keys, "node").distinct()
    ones = labels.filter("label > 0").select(*keys, "node", F.lit(1.0).alias("score")).distinct()
    if net is None and rounds <= STATIC and not eps:
        p = cut(row_normalise(both_ways(edges) if pairs else edges, lam))
        free = lambda s: s.join(fixed, [*keys, "node"], "left_anti").withColumn("score", alpha * F.col("score"))
        state = first = free(spread(p, ones, keys))
        for _ in range(1, rounds):
            state = free(spread(p, state, keys)).unionByName(first).groupBy(*keys, "node").agg(F.sum("score").alias("score"))
        return state.filter("score > 0").unionByName(ones)
    lanes = Lanes(labels, keys)
    net = net or Blocks(edges, width=lanes.width, lam=lam, pairs=pairs, write=True)
    walls = cut(pack_scores(fixed.withColumn("score", F.lit(1.0)), net, lanes))
    state = first = cut(net.sums(_next(alpha), net.products(cut(pack_scores(ones, net, lanes))), (0, walls), more=("gain",)))
    if not eps:
        state = _grown_by(first, lambda step: net.sums(_next(alpha), net.products(step), (0, walls), more=("gain",)), rounds, net)
    else:
        for _ in range(1, rounds):
            state = cut(net.sums(_next(alpha), net.products(state), (0, walls), (1, first), (2, state), more=("gain",)))
            if (state.agg(F.max("gain")).first()[0] or 0.0) <= eps:
                break
    return unpack_scores(state, net, lanes).filter("score > 0").unionByName(ones)


def _grown_by(first: DataFrame, following, rounds: int, net: Blocks) -> DataFrame:
    """The sum of what each round adds to the scores. What a round adds follows from what the last one added, and lies where that
    leads: on a network of two sides on one side only, so that a round multiplies half of the edges."""
    columns = ["block", "chunk", "places", "cells"]
    whole = lambda parts: cut(net.sums(lambda kept, places, cells: (places, cells), reduce(DataFrame.unionByName, parts)))
    step, parts = first, [first.select(*columns)]
    for _ in range(1, rounds):
        step = cut(following(step))
        parts.append(step.select(*columns))
        if len(parts) > MOST_PARTS:
            parts = [whole(parts)]
    return whole(parts) if len(parts) > 1 else parts[0]


def _next(alpha: float):
    """A block's next scores: alpha times the sums, nothing on fixed nodes (kind 0), and what fixed ones give (1); the greatest
    growth from the scores before (2)."""

    def finish(kept: dict, places, sums):
        cells = alpha * sums
        if 1 in kept:
            places, cells = by_place(np.concatenate([places, places_of(kept[1])]), np.concatenate([cells, cells_of(kept[1])]))
        if 0 in kept:
            _, here, there = np.intersect1d(places, places_of(kept[0]), assume_unique=True, return_indices=True)
            cells[here] = np.where(cells_of(kept[0])[there] > 0, 0.0, cells[here])
        grown = cells
        if 2 in kept:
            grown = by_place(np.concatenate([places, places_of(kept[2])]), np.concatenate([cells, -cells_of(kept[2])]))[1]
        return places, cells, float(grown.max(initial=0.0))

    return finish


def bounds(
    edges: DataFrame, labels: DataFrame, alpha: float = 0.8, max_rounds: int = 1000, plus: bool = False, keys: list[str] | None = None, compare: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Propagation until the bounds fix every rank: (scores, statistics of each round). Negatives are fixed at 0 (plus: there are none).

    After i rounds a score can still grow by alpha^i max(f) / (1 - alpha). A node is ranked when its interval meets neither
    neighbour's in score order; a node without score never is, and rounds go on while nodes get their first one. Equal scores
    stay unranked: rounds end when no bound is large enough to move any score, as doubles, or after max_rounds. The last
    round's statistics and a warning tell what is left.

    Statistics: unranked nodes, the longest stretch of them in score order, the greatest change of a score in the round, the
    bound `ub`; and with `compare` also tau, Kendall's of the round's order of nodes and the last round's. On hubs and spokes many
    rounds are told in one pass (see `spokes`)."""
    keys = keys or ["term"]
    if not alpha < 1:
        raise ValueError("bounds need alpha < 1")
    net = spokes_of(edges, labels, keys)
    if net:
        return _bounds_of_spokes(net, labels, alpha, max_rounds, plus, keys, compare)
    fixed = (labels.filter("label > 0") if plus else labels).select(*keys, "node")
    p = cut(row_normalise(edges))
    ones = labels.filter("label > 0").select(*keys, "node", F.lit(1.0).alias("score"))
    free = lambda s: s.join(fixed, [*keys, "node"], "left_anti")
    first = cut(free(spread(p, ones, keys)).withColumn("score", alpha * F.col("score")))
    top = cut(first.groupBy(*keys).agg(F.max("score").alias("top")))
    state, rows, states, reached, left = first.withColumn("change", F.col("score")), None, None, 0, 0
    order = Window.partitionBy(*keys).orderBy("score", "node")
    for k in range(1, max_rounds + 1):
        if k > 1:
            new = free(spread(p, state, keys).withColumn("score", alpha * F.col("score"))).withColumn("old", F.lit(0.0))
            both = new.unionByName(first.withColumn("old", F.lit(0.0))).unionByName(state.select(*keys, "node", F.lit(0.0).alias("score"), F.col("score").alias("old")))
            state = both.groupBy(*keys, "node").agg(F.sum("score").alias("score"), F.sum("old").alias("old"))
            state = cut(state.select(*keys, "node", "score", (F.col("score") - F.col("old")).alias("change")))
        if compare:
            one = state.select(*keys, "node", "score", F.lit(k).alias("round"))
            states = one if states is None else states.unionByName(one)
        gap = state.join(top, keys).withColumn("ub", alpha**k / (1 - alpha) * F.col("top"))
        gap = gap.withColumn("before", F.lag("score").over(order)).withColumn("after", F.lead("score").over(order)).withColumn("place", F.row_number().over(order))
        open_ = (F.coalesce(F.col("before") + F.col("ub") >= F.col("score"), F.lit(False))) | F.coalesce(F.col("score") + F.col("ub") >= F.col("after"), F.lit(False))
        gap = gap.withColumn("open", open_)
        run = F.col("place") - F.row_number().over(Window.partitionBy(*keys, "open").orderBy("score", "node"))
        runs = gap.withColumn("run", run).groupBy(*keys, "open", "run").agg(
            F.count("*").alias("n"), F.first("ub").alias("ub"), F.min(F.when(F.col("score") > 0, F.col("score"))).alias("least"), F.max("change").alias("change")
        )
        size = F.when(F.col("open"), F.col("n")).otherwise(F.lit(0))
        one = runs.groupBy(*keys).agg(
            F.sum(size).alias("unranked"), F.max(size).alias("stretch"), F.max("change").alias("change"), F.first("ub").alias("ub"), F.min("least").alias("least"), F.sum("n").alias("n")
        )
        said = Observation()
        moving = F.max((F.col("unranked") > 0) & (F.col("ub") > F.col("least") * 2.0**-54))
        one = cut(one.withColumn("round", F.lit(k)).observe(said, F.sum("unranked").alias("left"), moving.alias("moving"), F.sum("n").alias("reached")))
        rows = one.drop("least", "n") if rows is None else rows.unionByName(one.drop("least", "n"))
        seen, told = reached, said.get
        left, reached = told["left"], told["reached"]
        if reached == seen and not (left and told["moving"]) or not reached:
            break
    if left:
        warnings.warn(f"bounds: {left} nodes are unranked after {k} rounds", stacklevel=2)
    if compare:
        last = state.select(*keys, "node", F.col("score").alias("y"))
        taus = kendall_tau(states.withColumnRenamed("score", "x").join(last, [*keys, "node"]).select(*keys, "round", "x", "y"), [*keys, "round"])
        rows = rows.join(taus, [*keys, "round"], "left")
    return state.select(*keys, "node", "score").unionByName(ones), rows


def _bounds_of_spokes(net, labels: DataFrame, alpha: float, max_rounds: int, plus: bool, keys: list[str], compare: bool) -> tuple[DataFrame, DataFrame]:
    rounds, k, left, found = bounded(net, alpha, max_rounds, plus)
    if left:
        warnings.warn(f"bounds: {left} nodes are unranked after {k} rounds", stacklevel=3)
    rows = net.spark.createDataFrame(found, f"{net.kinds}, unranked long, stretch long, change double, ub double, round int")
    if compare:
        rows = rows.join(kendall_tau(rounds.history(k), [*keys, "round"]), [*keys, "round"], "left")
    ones = labels.filter("label > 0").select(*keys, "node", F.lit(1.0).alias("score"))
    state = net.scores(rounds.x[k - 1], rounds.x[k], alpha, reached=(rounds.has[k - 1], rounds.has[k] & ~rounds.fixed))
    return state.unionByName(ones), rows


def conjugate_gradients(times, y: DataFrame, keys: list[str], tol: float, max_rounds: int) -> DataFrame:
    """(keys, node, score): the solution of A x = y for all keys at once; times(v) is A v of (keys, node, score), A symmetric
    and positive definite. A key is done when its residual's norm is tol or less."""
    axis = [*keys, "node"]
    state = cut(y.select(*axis, F.lit(0.0).alias("x"), F.col("score").alias("r"), F.col("score").alias("p")))
    for _ in range(max_rounds):
        q = times(state.select(*axis, F.col("p").alias("score")).filter("score <> 0")).withColumnRenamed("score", "q")
        t = cut(state.join(q, axis, "full_outer").na.fill(0.0, ["q", "x", "r", "p"]))
        a = t.groupBy(*keys).agg((F.sum(F.col("r") * F.col("r"))).alias("rr"), F.sum(F.col("p") * F.col("q")).alias("pq"))
        t = t.join(a, keys).withColumn("a", F.when(F.sqrt("rr") > tol, F.coalesce(F.try_divide("rr", "pq"), F.lit(0.0))).otherwise(0.0))
        t = cut(t.select(*axis, (F.col("x") + F.col("a") * F.col("p")).alias("x"), (F.col("r") - F.col("a") * F.col("q")).alias("r"), "p", "rr"))
        new = cut(t.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r")).alias("new"), F.first("rr").alias("old")))
        state = t.drop("rr").join(new, keys)
        state = cut(state.select(*axis, "x", "r", (F.col("r") + F.coalesce(F.try_divide("new", "old"), F.lit(0.0)) * F.col("p")).alias("p")))
        left = new.agg(F.max(F.sqrt("new"))).first()[0] or 0.0
        if left <= tol:
            break
    else:
        warnings.warn(f"conjugate_gradients: a residual of {left:.3g} is left after {max_rounds} rounds", stacklevel=2)
    return state.select(*axis, F.col("x").alias("score"))


def stabilised_gradients(times, y: DataFrame, keys: list[str], tol: float, max_rounds: int) -> DataFrame:
    """(keys, node, score): the solution of A x = y for all keys at once by stabilised two-sided gradients; A need not be
    symmetric. times(v) is A v of (keys, node, score). A key is done when its residual's norm is tol or less; one whose
    recurrence breaks down (a divisor near 0) begins anew from its residual. A warning tells the residual that is left."""
    axis, dot = [*keys, "node"], lambda a, b: F.sum(F.col(a) * F.col(b))
    of = lambda name: F.col(name).alias("score")
    over = lambda a, b: F.coalesce(F.when(F.abs(b) > 1e-300, a / b), F.lit(0.0))
    state = cut(y.select(*axis, F.lit(0.0).alias("x"), of("score").alias("r"), of("score").alias("q"), of("score").alias("p")))
    left = None
    for _ in range(max_rounds):
        v = times(state.select(*axis, of("p")).filter("score <> 0")).withColumnRenamed("score", "v")
        t = cut(state.join(v, axis, "full_outer").na.fill(0.0, ["x", "r", "q", "p", "v"]))
        a = t.groupBy(*keys).agg(dot("q", "r").alias("rho"), dot("q", "v").alias("qv"), dot("r", "r").alias("rr"))
        a = a.select(*keys, "rho", F.when(F.sqrt("rr") > tol, over(F.col("rho"), F.col("qv"))).otherwise(0.0).alias("a"))
        s = cut(t.join(a, keys).withColumn("s", F.col("r") - F.col("a") * F.col("v")))
        u = times(s.select(*axis, of("s")).filter("score <> 0")).withColumnRenamed("score", "u")
        s = cut(s.join(u, axis, "full_outer").na.fill(0.0, ["x", "r", "q", "p", "v", "s", "u"]).drop("rho", "a").join(a, keys))
        w = s.groupBy(*keys).agg(dot("u", "s").alias("us"), dot("u", "u").alias("uu"))
        s = s.join(w.select(*keys, over(F.col("us"), F.col("uu")).alias("w")), keys)
        s = s.withColumn("x", F.col("x") + F.col("a") * F.col("p") + F.when(F.col("a") != 0, F.col("w") * F.col("s")).otherwise(0.0))
        s = cut(s.withColumn("r", F.when(F.col("a") != 0, F.col("s") - F.col("w") * F.col("u")).otherwise(F.col("r"))))
        b = s.groupBy(*keys).agg(dot("q", "r").alias("next"), dot("r", "r").alias("rr"), F.first("rho").alias("rho"), F.first("a").alias("a"), F.first("w").alias("w"))
        # Where q has become orthogonal to the residual, or a step was nothing, the recurrence begins anew.
        dead = (F.abs("next") < 1e-14 * F.col("rr")) | (F.col("a") == 0) | (F.col("w") == 0)
        b = cut(b.select(*keys, "rr", dead.alias("dead"), F.when(dead, 0.0).otherwise(over(F.col("next"), F.col("rho")) * over(F.col("a"), F.col("w"))).alias("b")))
        s = s.drop("rho", "a").join(b, keys)
        p = F.col("r") + F.col("b") * (F.col("p") - F.col("w") * F.col("v"))
        state = cut(s.select(*axis, "x", "r", F.when(F.col("dead"), F.col("r")).otherwise(F.col("q")).alias("q"), F.when(F.col("dead"), F.col("r")).otherwise(p).alias("p")))
        left = b.agg(F.max(F.sqrt("rr"))).first()[0] or 0.0
        if left <= tol:
            break
    else:
        warnings.warn(f"stabilised_gradients: a residual of {left} is left after {max_rounds} rounds", stacklevel=2)
    return state.select(*axis, of("x"))


def is_symmetric(edges: DataFrame) -> bool:
    """Whether each edge has one of the same weight the other way."""
    whole = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    back = whole.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("back"))
    far = F.abs(F.col("w") - F.coalesce("back", F.lit(0.0))) > 1e-9 * F.abs("w")
    return not whole.join(back, ["src", "dst"], "left").filter(far).limit(1).count()


def laplacian_solve(edges: DataFrame, y: DataFrame, alpha: float = 1.0, tol: float = 1e-5, max_rounds: int = 1000, keys: list[str] | None = None) -> DataFrame:
    """(I + alpha L) f = y, all keys at once; S, of a symmetric network, is normalised symmetrically first. A key's residual is of norm tol or less.

    With D the diagonal and N the rest, f = D^-1 N f + D^-1 y, whose eigenvalues lie below 1: a row of N sums to less than its D.
    `semi_iterate` solves that in blocks. Negative weights give no such bound; then conjugate gradients solve the system."""
    keys = keys or ["term"]
    axis = [*keys, "node"]
    lap = cut(laplacian(symmetric_normalise(edges)))
    diagonal = cut(lap.filter("src = dst").select(F.col("src").alias("node"), (1 + alpha * F.col("weight")).alias("d")))
    g = lap.filter("src <> dst").join(diagonal, F.col("src") == F.col("node")).select("src", "dst", (-alpha * F.col("weight") / F.col("d")).alias("weight"))
    g = cut(g.filter("weight <> 0"))
    if g.filter("weight < 0").limit(1).count():

        def times(v: DataFrame) -> DataFrame:
            part = spread(lap, v, keys).withColumn("score", alpha * F.col("score"))
            return part.unionByName(v.select(*axis, "score")).groupBy(*axis).agg(F.sum("score").alias("score"))

        return conjugate_gradients(times, y, keys, tol, max_rounds)
    given = cut(y.join(diagonal, "node", "left").select(*axis, F.col("score").cast("double").alias("score"), F.coalesce("d", F.lit(1.0)).alias("d")))
    norm = given.groupBy(*keys).agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm")).agg(F.max("norm")).first()[0] or 0.0
    net = Blocks(g)
    given = given.select(*axis, (F.col("score") / F.col("d")).alias("score"))
    return semi_iterate(g, given, keys, spectral_bound(g, net=net), tol / max(1.0, norm), max_rounds, net=net)


#: Names of the solvers that a run may ask for, and those of them that a symmetric system alone allows.
SYMMETRIC = ("cg", "minres")
SOLVERS = ("spsolve", "bicg", "bicgstab", "cg", "cgs", "gmres", "lgmres", "minres", "qmr", "gcrotmk")


def solve(
    edges: DataFrame, labels: DataFrame, alpha: float = 1.0, solver: str = "cg", tol: float = 1e-5, max_rounds: int = 1000, plus: bool = False, lam: float = 0.0, keys: list[str] | None = None
) -> DataFrame:
    """The fixed point of `propagate`, (I - alpha P) s = alpha P 1_pos on the free nodes.

    Names of SYMMETRIC use conjugate gradients, and a network that isn't symmetric is an error; the others use stabilised
    two-sided gradients, on P as it is, for directed networks too. For the former, P = W / d for a symmetric W, so that with u = sqrt(d) s the system is (I - alpha W / sqrt(d d')) u = sqrt(d) f, which is
    symmetric and, below alpha 1 or where every node has a way to a fixed one, positive definite.
    Of a network of hubs and spokes the hubs' system is solved alone (see `spokes`)."""
    if solver not in SOLVERS:
        raise ValueError(f"no such solver: {solver}")
    keys = keys or ["term"]
    axis = [*keys, "node"]
    fixed = (labels.filter("label > 0") if plus else labels).select(*axis)
    ones = labels.filter("label > 0").select(*axis, F.lit(1.0).alias("score"))
    net = spokes_of(edges, labels, keys)
    if net and (net.symmetric or solver not in SYMMETRIC):
        return fixed_point(net, alpha, "cg" if solver in SYMMETRIC else "bicgstab", tol, max_rounds, plus, lam).unionByName(ones)
    if solver not in SYMMETRIC:
        p = cut(row_normalise(edges, lam))
        free = lambda v: v.withColumn("score", alpha * F.col("score")).join(fixed, axis, "left_anti")

        def directed(v: DataFrame) -> DataFrame:
            moved = free(spread(p, v, keys)).withColumn("score", -F.col("score"))
            return moved.unionByName(v.select(*axis, "score")).groupBy(*axis).agg(F.sum("score").alias("score"))

        found = stabilised_gradients(directed, free(spread(p, ones, keys)), keys, tol, max_rounds)
        return found.filter("score <> 0").unionByName(ones)
    if not is_symmetric(edges):
        raise ValueError(f"{solver} needs a symmetric network")
    total = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("d"))
    if lam:
        total = total.crossJoin(F.broadcast(edges.agg(F.max("weight").alias("top")))).select("node", (F.col("d") + lam * F.col("top")).alias("d"))
    root = cut(total.select("node", F.sqrt("d").alias("root")))
    near = edges.join(root.withColumnRenamed("node", "src"), "src").join(root.select(F.col("node").alias("dst"), F.col("root").alias("other")), "dst")
    near = cut(near.select("src", "dst", (F.col("weight") / F.col("root") / F.col("other")).alias("weight")))

    def times(v: DataFrame) -> DataFrame:
        part = spread(near, v, keys).withColumn("score", -alpha * F.col("score")).join(fixed, axis, "left_anti")
        return part.unionByName(v.select(*axis, "score")).groupBy(*axis).agg(F.sum("score").alias("score"))

    f = spread(near, ones.join(root, "node").select(*axis, F.col("root").alias("score")), keys)
    f = f.join(fixed, axis, "left_anti").withColumn("score", alpha * F.col("score"))
    u = conjugate_gradients(times, f, keys, tol, max_rounds)
    return u.join(root, "node").select(*axis, (F.col("score") / F.col("root")).alias("score")).filter("score <> 0").unionByName(ones)


def spectral_bound(g: DataFrame, rounds: int = 4, net: Blocks | None = None) -> float:
    """A bound of the eigenvalues' sizes of a network without negative weights: the greatest growth of any node of a positive
    vector v, (G v)_i / v_i, is one for each v. Some steps towards the leading vector make it sharper; the least is returned.

    net: the network's blocks, if there are some."""
    net = net or Blocks(g)
    ones = net.index.select(F.lit(0).alias("key"), "node", F.lit(1.0).alias("score"))
    v = cut(pack_scores(ones, net, Lanes(ones, ["key"])))
    least = math.inf
    for _ in range(rounds):
        v = cut(net.sums(_grown, net.products(v), (0, v), more=("growth",)))
        least = min(least, v.agg(F.max("growth")).first()[0] or 0.0)
    return least


def _grown(kept: dict, places, sums):
    """A block's next vector, that of before (kind 0) and its product, and the greatest growth of any of its nodes."""
    own, cells = places_of(kept[0]), cells_of(kept[0])
    more = np.zeros_like(cells)
    more[np.searchsorted(own, places)] = sums
    return own, cells + more, float((more / cells).max(initial=0.0))


def semi_iterate(g: DataFrame, given: DataFrame, keys: list[str], bound: float, tol: float = 1e-9, max_rounds: int = 1000, walls: DataFrame | None = None, net: Blocks | None = None) -> DataFrame:
    """(keys, node, score): x = G x + given for all keys at once, x 0 on walls (keys, node), by Chebyshev's semi-iteration.

    G must be similar to a symmetric matrix, with eigenvalues in [-bound, bound], bound below 1. A round mixes G x + given with
    the scores of the round before the last, x <- w (G x + given) + (1 - w) old; w follows from the bound alone. So a round is one
    product in blocks and one written table: no sums over all nodes, nothing through the driver. The error falls by
    r = bound / (1 + sqrt(1 - bound^2)) a round, where plain rounds fall by the bound (at 0.95: 0.72), and the number of rounds
    for an error of tol of the solution's norm is known beforehand. A warning tells what max_rounds leaves of it.

    Nodes without an edge keep what is given; null scores count as 0. net: the blocks of G, if there are some."""
    if not 0 <= bound < 1:
        raise ValueError(f"semi_iterate needs a bound from 0 to below 1, not {bound}")
    given = cut(given.select(*keys, "node", F.col("score").cast("double").alias("score")).na.fill(0.0, ["score"]))
    net, lanes = net or Blocks(g), Lanes(given, keys)
    shrink = bound / (1 + math.sqrt(1 - bound * bound))
    wanted = max(1, math.ceil(math.log(tol / 2) / math.log(shrink))) if shrink > 0 else 1
    if wanted > max_rounds:
        warnings.warn(f"semi_iterate: an error of {2 * shrink**max_rounds:.3g} of the solution may be left after {max_rounds} rounds", stacklevel=2)
    first = state = cut(pack_scores(given, net, lanes))
    fixed = [] if walls is None else [(0, cut(pack_scores(walls.select(*keys, "node", F.lit(1.0).alias("score")), net, lanes)))]
    old, weight = None, 1.0
    for k in range(1, min(wanted, max_rounds) + 1):
        weight = 1 / (1 - bound * bound / 2) if k == 1 else 1 / (1 - bound * bound * weight / 4)
        kept = [*fixed, (1, first), *([(2, old)] if old is not None else [])]
        old, state = state, cut(net.sums(_mixed(weight), net.products(state), *kept))
    alone = given.join(net.index.select("node"), "node", "left_anti").groupBy(*keys, "node").agg(F.sum("score").alias("score"))
    return unpack_scores(state, net, lanes).unionByName(alone.filter("score <> 0"))


def _mixed(weight: float):
    """A block's next scores: weight times the sums off the walls (kind 0) and what is given (1), and the rest of the last but one (2)."""

    def finish(kept: dict, places, sums):
        parts = [(places, weight * sums), *[(places_of(kept[k]), share * cells_of(kept[k])) for k, share in ((1, weight), (2, 1 - weight)) if k in kept]]
        if 0 in kept:
            _, here, there = np.intersect1d(places, places_of(kept[0]), assume_unique=True, return_indices=True)
            parts[0][1][here] = np.where(cells_of(kept[0])[there] > 0, 0.0, parts[0][1][here])
        return by_place(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]))

    return finish


def settle(edges: DataFrame, labels: DataFrame, alpha: float = 0.95, tol: float = 1e-9, max_rounds: int = 1000, plus: bool = False, lam: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """The fixed point of `propagate` on a symmetric network without negative weights by `semi_iterate`: rows of alpha P sum to
    alpha at most, which bounds its eigenvalues. At alpha 0.95 an error of 1e-9 takes 67 rounds; plain ones take 404."""
    keys = keys or ["term"]
    axis = [*keys, "node"]
    net = spokes_of(edges, labels, keys)
    if not (net.symmetric if net else is_symmetric(edges)):
        raise ValueError("settle needs a symmetric network")
    if net:
        ones = labels.filter("label > 0").select(*axis, F.lit(1.0).alias("score")).distinct()
        return fixed_point(net, alpha, "semi", tol, max_rounds, plus, lam).unionByName(ones)
    fixed = (labels.filter("label > 0") if plus else labels).select(*axis).distinct()
    ones = labels.filter("label > 0").select(*axis, F.lit(1.0).alias("score")).distinct()
    g = cut(row_normalise(edges, lam).withColumn("weight", alpha * F.col("weight")))
    given = spread(g, ones, keys).join(fixed, axis, "left_anti")
    return semi_iterate(g, given, keys, alpha, tol, max_rounds, fixed).filter("score <> 0").unionByName(ones)


def preconditioned_solve(edges: DataFrame, y: DataFrame, alpha: float = 1.0, tol: float = 1e-9, max_rounds: int = 1000, keys: list[str] | None = None) -> DataFrame:
    """(I + alpha L) f = y as `laplacian_solve`, of a network that is shown to be symmetric first."""
    if not is_symmetric(edges):
        raise ValueError("preconditioned_solve needs a symmetric network")
    return laplacian_solve(edges, y, alpha, tol, max_rounds, keys)


def reachable(edges: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, node): free nodes that a positive reaches without passing a negative, by rounds of neighbours."""
    keys = keys or ["term"]
    axis = [*keys, "node"]
    links = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    walls = labels.filter("label < 0").select(*axis)
    seen = front = cut(labels.filter("label > 0").select(*axis).distinct())
    while front.limit(1).count():
        step = front.join(links.withColumnRenamed("src", "node"), "node").select(*keys, F.col("dst").alias("node")).distinct()
        front = cut(step.join(walls, axis, "left_anti").join(seen, axis, "left_anti"))
        seen = cut(seen.unionByName(front))
    return seen.join(labels.select(*axis), axis, "left_anti")


def genemania(edges: DataFrame, labels: DataFrame, nodes: DataFrame, **more) -> DataFrame:
    """Targets 1 and -1, and (n+ - n-) / (n+ + n-) for the unlabelled nodes of every term.

    A solution is linear in its targets: that of ones everywhere is solved once, for all terms, and scaled by a term's bias;
    what labelled nodes differ from the bias are a term's only targets. Nodes times terms are the result's rows alone."""
    bias = labels.groupBy("term").agg((F.sum("label") / F.count("*")).cast("double").alias("bias"))
    every = nodes.select("node").distinct()
    rest = labels.join(bias, "term").select(F.lit(False).alias("ones"), "term", "node", (F.col("label") - F.col("bias")).alias("score")).join(every, "node", "left_semi")
    ones = every.select(F.lit(True).alias("ones"), F.lit("").cast(labels.schema["term"].dataType).alias("term"), "node", F.lit(1.0).alias("score"))
    f = cut(laplacian_solve(edges, ones.unionByName(rest), keys=["ones", "term"], **more))
    grid = f.filter("ones").select("node", F.col("score").alias("one")).join(bias, F.lit(True))
    own = f.filter("not ones").select("term", "node", "score")
    return grid.join(own, ["term", "node"], "left").select("term", "node", (F.col("bias") * F.col("one") + F.coalesce("score", F.lit(0.0))).alias("score"))


def regularised_laplacian(edges: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """Target 1 on positives, 0 elsewhere."""
    return laplacian_solve(edges, labels.filter("label > 0").select("term", "node", F.lit(1.0).alias("score")), **more)


def diffusion(edges: DataFrame, sources: DataFrame, **more) -> DataFrame:
    """(source, node, score): the columns of (I + alpha L)^-1 that belong to the sources, and no others."""
    y = sources.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("score"))
    return laplacian_solve(edges, y, keys=["source"], **more)


def contributors(columns: DataFrame, edges: DataFrame, targets: DataFrame, cutoff: float) -> DataFrame:
    """For each target node: contributing sources above cutoff of their column-normalised diffusion, the share of them that
    are neighbours, the share of diffusion that neighbours give, and the top source."""
    rows = columns.join(targets.select("node"), "node", "left_semi")
    share = rows.withColumn("part", F.col("score") / F.sum("score").over(Window.partitionBy("node")))
    near = edges.select(F.col("src").alias("node"), F.col("dst").alias("source")).distinct().withColumn("near", F.lit(1))
    share = share.join(near, ["node", "source"], "left").na.fill(0, ["near"])
    return share.groupBy("node").agg(
        F.sum((F.col("part") > cutoff).cast("long")).alias("n_contributors"),
        F.sum(((F.col("part") > cutoff) & (F.col("near") == 1)).cast("long")).alias("n_near"),
        (1 - F.sum(F.when(F.col("near") == 1, F.col("part")).otherwise(0.0))).alias("effective_diffusion"),
        F.max_by("source", F.struct("part", "source")).alias("top_source"),
        F.max_by("near", F.struct("part", "source")).alias("top_is_near"),
    )


def fixed_scores(edges: DataFrame, labels: DataFrame, alpha: float, keys: list[str] | None = None, reached_only: bool = False) -> DataFrame:
    """(keys, node, score): what fixed positives give to free nodes, alpha * P 1_pos. Nodes that no positive touches have no row.

    reached_only: a row, if of 0, for every free node that a positive reaches once the negatives are gone, and for no other."""
    keys = keys or ["term"]
    axis = [*keys, "node"]
    ones = labels.filter("label > 0").select(*axis, F.lit(1.0).alias("score"))
    given = spread(row_normalise(edges), ones, keys).withColumn("score", alpha * F.col("score"))
    given = given.join(labels.select(*axis), axis, "left_anti")
    if not reached_only:
        return given
    return reachable(edges, labels, keys).join(given, axis, "left").na.fill(0.0, ["score"])


def expected_steps(edges: DataFrame, sources: DataFrame, alphas: list[float], tol: float = 1e-4, max_rounds: int = 1000) -> DataFrame:
    """(alpha, expected, variance, rounds): transitions of a walk from a random source before it leaves the system.

    A round moves the walk once for all alphas, which differ only in the chance of leaving; an alpha is done when a round
    adds less than tol to its expectation. The driver holds four numbers for each alpha."""
    s = cut(symmetric_normalise(edges))
    degree = cut(s.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("d")))
    moves = cut(s.join(degree.withColumnRenamed("node", "dst"), "dst").select("src", "dst", (F.col("weight") / F.col("d")).alias("weight")))
    named = sources.select("node").distinct().join(degree.select("node"), "node", "left_semi")
    count = named.count()
    walk = named.select(F.lit(0).alias("k"), "node", F.lit(1.0 / max(count, 1)).alias("score"))

    def leaving(walk: DataFrame) -> list[float]:
        chances = walk.join(degree, "node").agg(*[F.sum(F.col("score") / (1 + a * F.col("d"))) for a in alphas]).first()
        return [c or 0.0 for c in chances]

    stay = [1 - p for p in leaving(walk)]
    mean, square, done = [0.0] * len(alphas), [0.0] * len(alphas), [0] * len(alphas)
    for n in range(1, max_rounds):
        if all(done):
            break
        walk = cut(spread(moves, walk, ["k"]))
        for i, p in enumerate(leaving(walk)):
            if not done[i]:
                gain = n * p * stay[i]
                mean[i] += gain
                square[i] += n * gain
                stay[i] *= 1 - p
                done[i] = n if gain < tol else 0
    rows = [(float(a), m, q - m * m, r or max_rounds) for a, m, q, r in zip(alphas, mean, square, done, strict=True)]
    return edges.sparkSession.createDataFrame(rows, "alpha double, expected double, variance double, rounds int")

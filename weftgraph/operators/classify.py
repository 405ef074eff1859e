"""Supervised scores over node features, and clusters of degrees."""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.lineage import cut
from weftgraph.operators.graph import symmetric_normalise
from weftgraph.operators.propagate import spread
from weftgraph.operators.spokes import machine, spokes_of


def logistic(rows: DataFrame, c: float = 1.0, max_rounds: int = 100) -> DataFrame:
    """(node, score): the probability of class 1 of rows (node, embedding, y), trained on those with y, for ready features of up to some hundreds.

    Minimised is |w|^2 / 2 + c * the sum of losses, with a bias that is not penalised, by damped Newton steps as in `svm`."""
    data = rows.select("node", "y", F.col("embedding").cast("array<double>").alias("x"))
    # Written first: every step reads a plain table, whatever the plan of the rows holds.
    known = cut(data.filter("y is not null").select("x", F.col("y").cast("double").alias("y")))
    first = known.first()
    if first is None:
        raise ValueError("logistic needs rows with y")
    size = len(first.x) + 1
    penalty = np.r_[np.ones(size - 1), 0.0]

    def sums(fixed: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The loss, its gradient, and its curvature, whose sums over partitions the driver holds."""

        def part(batches):
            total, g, h = 0.0, np.zeros(size), np.zeros((size, size))
            for pdf in batches:
                if len(pdf):
                    x = np.column_stack([np.stack(pdf.x.to_numpy()), np.ones(len(pdf))])
                    y, at = pdf.y.to_numpy(), x @ fixed
                    p = np.exp(-np.logaddexp(0, -at))
                    total += float((np.logaddexp(0, at) - y * at).sum())
                    g += x.T @ (p - y)
                    h += x.T @ (x * (p * (1 - p))[:, None])
            yield pd.DataFrame({"k": np.arange(1 + size + size * size), "v": np.concatenate([[total], g, h.ravel()])})

        flat = np.zeros(1 + size + size * size)
        for r in known.mapInPandas(part, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            flat[r.k] = r.v
        loss = float(penalty @ fixed**2) / 2 + c * flat[0]
        return loss, penalty * fixed + c * flat[1 : 1 + size], np.diag(penalty) + c * flat[1 + size :].reshape(size, size)

    w = np.zeros(size)
    loss, g, h = sums(w)
    for _ in range(max_rounds):
        step, share = np.linalg.lstsq(h, g, rcond=None)[0], 1.0
        new = sums(w - step)
        while new[0] > loss + 1e-12 * abs(loss) and share > 1e-6:
            share /= 2
            new = sums(w - share * step)
        w, (loss, g, h) = w - share * step, new
        if np.abs(share * step).max() < 1e-10:
            break
    weights = F.array(*[F.lit(float(x)) for x in w[:-1]])
    dot = F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(float(w[-1])), lambda a, b: a + b)
    return data.select("node", (1 / (1 + F.exp(-dot))).alias("score"))


def svm(rows: DataFrame, c: float = 1.0, rounds: int = 60) -> DataFrame:
    """(node, score): the decision value of a linear machine with squared hinge loss, for ready features of up to some hundreds.

    Each Newton step sums a gradient and a small Hessian (of the features' number squared, which the driver holds) over
    partitions; rows stay where they are. Rows of a network are features for `network_scores`, which has no such bound."""
    data = rows.select("node", "y", F.col("embedding").cast("array<double>").alias("x"))
    known = data.filter("y is not null")
    first = known.first()
    if first is None:
        return data.select("node", F.lit(0.0).alias("score"))
    size = len(first.x) + 1
    w = np.zeros(size)
    for _ in range(rounds):
        fixed = w.copy()

        def part(batches, fixed=fixed):
            g, h = np.zeros(size), np.zeros((size, size))
            for pdf in batches:
                if len(pdf):
                    x = np.column_stack([np.stack(pdf.x.to_numpy()), np.ones(len(pdf))])
                    y = 2.0 * pdf.y.to_numpy() - 1
                    gap = 1 - y * (x @ fixed)
                    on = gap > 0
                    g += -2 * (x[on].T @ (y[on] * gap[on]))
                    h += 2 * x[on].T @ x[on]
            yield pd.DataFrame({"k": np.arange(size + size * size), "v": np.concatenate([g, h.ravel()])})

        sums = known.select("x", "y").mapInPandas(part, "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # size + size^2 numbers
        flat = np.zeros(size + size * size)
        for r in sums:
            flat[r.k] = r.v
        step = np.linalg.solve(np.eye(size) + c * flat[size:].reshape(size, size), w + c * flat[:size])
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    weights = F.array(*[F.lit(float(x)) for x in w[:-1]])
    dot = F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(float(w[-1])), lambda a, b: a + b)
    return data.select("node", dot.alias("score"))


def _draws(size: int, places: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal deviates (size x places) and phases, from digests of their places, so that every engine can draw the same."""
    digest = lambda *key: hashlib.md5("|".join(map(str, (seed, *key))).encode()).hexdigest()
    share = lambda text: int(text, 16) / 2**32
    pairs = [[(share(h[:8]) + 2.0**-33, share(h[8:16])) for h in (digest(j, k) for k in range(places))] for j in range(size)]
    u = np.array(pairs).reshape(size, places, 2)
    return np.sqrt(-2 * np.log(u[..., 0])) * np.cos(2 * np.pi * u[..., 1]), np.array([2 * np.pi * share(digest(j, "phase")[:8]) for j in range(size)])


def kernel_features(rows: DataFrame, gamma: float, size: int = 256, seed: int = 1) -> DataFrame:
    """rows with `embedding` replaced by `size` random Fourier features of the kernel exp(-gamma |x - y|^2).

    Products of two rows' features estimate their kernel with a standard error of sqrt(1 / size) at most, whatever the number of rows,
    so that a linear machine on them stands for a kernel machine, whose matrix of all pairs is never made. A row whose vector is
    null, of another length than the first, or holds a null or no finite number has null features."""
    seen = rows.filter("embedding is not null").select(F.size("embedding").alias("n")).first()
    places = seen.n if seen else 0
    spread_of, phase = _draws(size, places, seed)
    matrix = np.sqrt(2 * gamma) * spread_of.T

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = pd.Series([None] * len(batch), dtype=object)
            good = [k for k, x in enumerate(batch) if x is not None and len(x) == places and np.isfinite(np.asarray(x, float)).all()]
            if good:
                made = np.sqrt(2 / size) * np.cos(np.stack([np.asarray(batch.iloc[k], float) for k in good]) @ matrix + phase)
                for k, x in zip(good, made, strict=True):
                    out.iat[k] = x
            yield out

    return rows.withColumn("embedding", features(F.col("embedding").cast("array<double>")))


def kernel_machine(rows: DataFrame, gamma: float, c: float = 1.0, size: int = 256, seed: int = 1) -> DataFrame:
    """(node, score) of rows (node, embedding, y): `svm` with the kernel exp(-gamma |x - y|^2), by `kernel_features`.

    Rows without features (see there) train nothing and get no score."""
    made = cut(kernel_features(rows.select("node", "embedding", "y"), gamma, size, seed).filter("embedding is not null"))
    return svm(made, c)


def network_scores(
    edges: DataFrame, labels: DataFrame, loss: str = "logistic", c: float = 1.0, tol: float = 1e-4, max_rounds: int = 100, nodes: DataFrame | None = None
) -> DataFrame:
    """(term, node, score) of a linear classifier for each term whose features are the rows of the symmetrically normalised
    network: trained on labelled nodes, for all others (or for `nodes`) the probability of a positive (logistic) or the decision
    value (svm, squared hinge). Training positives get 1; terms without any go.

    Minimised is |w|^2 / 2 + c * the sum of losses, with a bias that is not penalised. A gradient takes two products with the
    network, for all terms at once, and no step of it leaves Spark. The network's norm is 1 at most and so bounds all curvatures: fixed
    steps converge at a rate that depends on c alone. On hubs and spokes a round is one of the labelled nodes (see `spokes`)."""
    if loss not in ("logistic", "svm"):
        raise ValueError(f"no such loss: {loss}")
    known = labels.select("term", "node", F.col("label").cast("double").alias("y"))
    counts = known.groupBy("term").agg(F.count("*").alias("n"), F.count_if(F.col("y") > 0).alias("p")).filter("p > 0")
    known = cut(known.join(counts.select("term", "n"), "term"))
    net = spokes_of(edges, known.select("term", "node", F.col("y").alias("label")), ["term"])
    if net and net.symmetric:
        products, biases, far, _ = machine(net, loss, c, tol, max_rounds)
        if far > tol:
            warnings.warn(f"network_scores: the last round still moved scores by {far:.3g}", stacklevel=2)
        bias = net.spark.createDataFrame(biases, f"{net.kinds}, bias double")
        return _machine_scores(edges, known, products, bias, loss, nodes)
    s = cut(symmetric_normalise(edges))
    curve = (0.25 if loss == "logistic" else 2.0) * c
    step = 1 / (1 + 2 * curve)
    weights = known.select("term", "node", F.lit(0.0).alias("score")).limit(0)
    bias = cut(counts.select("term", "n", F.lit(0.0).alias("bias")))
    margin = lambda: F.col("y") * (F.coalesce("score", F.lit(0.0)) + F.col("bias"))
    for _ in range(max_rounds):
        at = known.join(spread(s, weights, ["term"]), ["term", "node"], "left").join(bias.select("term", "bias"), "term")
        pull = F.col("y") / (1 + F.exp(margin())) if loss == "logistic" else 2 * F.col("y") * F.greatest(F.lit(0.0), 1 - margin())
        pull = cut(at.select("term", "node", (c * pull).alias("score")))
        change = spread(s, pull, ["term"]).withColumn("score", step * F.col("score")).unionByName(weights.withColumn("score", -step * F.col("score")))
        both = change.withColumn("old", F.lit(0.0)).unionByName(weights.select("term", "node", F.lit(0.0).alias("score"), F.col("score").alias("old")))
        new = cut(both.groupBy("term", "node").agg(F.sum("score").alias("change"), F.sum("old").alias("old")))
        moved = pull.groupBy("term").agg(F.sum("score").alias("g"))
        bias = cut(bias.join(moved, "term", "left").select("term", "n", F.coalesce(F.col("g"), F.lit(0.0)).alias("g"), (F.col("bias") + F.coalesce("g", F.lit(0.0)) / (2 * curve * F.col("n"))).alias("bias")))
        weights = new.select("term", "node", (F.col("old") + F.col("change")).alias("score"))
        moves = new.select(F.abs("change").alias("m")).union(bias.select((F.abs("g") / F.col("n")).alias("m")))
        far = moves.agg(F.max("m")).first()[0] or 0.0
        bias = bias.drop("g")
        if far <= tol:
            break
    else:
        warnings.warn(f"network_scores: the last round still moved scores by {far:.3g}", stacklevel=2)
    return _machine_scores(s, known, spread(s, weights, ["term"]), bias, loss, nodes)


def _machine_scores(edges: DataFrame, known: DataFrame, products: DataFrame, bias: DataFrame, loss: str, nodes: DataFrame | None) -> DataFrame:
    """What the products with the weights make of the nodes that weren't trained on, and 1 for training positives."""
    universe = nodes.select("node").distinct() if nodes is not None else edges.select(F.col("src").alias("node")).distinct()
    asked = universe.join(bias.select("term", "bias"), F.lit(True)).join(known.select("term", "node"), ["term", "node"], "left_anti")
    value = F.coalesce("score", F.lit(0.0)) + F.col("bias")
    value = 1 / (1 + F.exp(-value)) if loss == "logistic" else value
    found = asked.join(products, ["term", "node"], "left").select("term", "node", value.alias("score"))
    return found.unionByName(known.filter("y > 0").select("term", "node", F.lit(1.0).alias("score")))


def degree_clusters(degrees: DataFrame, bins: int, seed: int = 1) -> DataFrame:
    """(node, degree, bin): one-dimensional k-means of the degrees, bins from 1 by falling centre."""
    data = VectorAssembler(inputCols=["degree"], outputCol="features").transform(degrees.withColumn("degree", F.col("degree").cast("double")))
    model = KMeans(k=bins, seed=seed).fit(data)
    order = {int(k): b + 1 for b, k in enumerate(np.argsort([-c[0] for c in model.clusterCenters()]))}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return model.transform(data).select("node", F.col("degree").cast("long").alias("degree"), F.element_at(place, F.col("prediction")).alias("bin"))

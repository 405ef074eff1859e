"""Weights for the channels of a network set, and their combination.

Sums over pairs of labelled nodes are one aggregate of pairs that hold an array of all their channels' weights, for all terms
at once; the systems, of the size of the channel count, are solved row by row. Channels are columns here: a set has few, and
more than MAX_CHANNELS are an error."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHANNELS = 64


def channel_names(channels: DataFrame) -> list[str]:
    names = [r.channel for r in channels.select("channel").distinct().limit(MAX_CHANNELS + 1).collect()]
    if len(names) > MAX_CHANNELS:
        raise ValueError(f"more than {MAX_CHANNELS} channels")
    return sorted(names)


def combine(channels: DataFrame, weights: DataFrame) -> DataFrame:
    """The weighted sum of channels (channel, src, dst, weight); weights is (channel, alpha)."""
    return channels.join(F.broadcast(weights), "channel").groupBy("src", "dst").agg(F.sum(F.col("alpha") * F.col("weight")).alias("weight"))


def _labelled(channels: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, channel, src, dst, weight, a, b): edges between labelled nodes, a of which at least one is positive."""
    one = labels.select("term", F.col("node").alias("src"), F.col("label").alias("a"))
    two = labels.select("term", F.col("node").alias("dst"), F.col("label").alias("b"))
    return channels.join(one, "src").join(two, ["term", "dst"]).filter("a > 0 or b > 0")


def _sums(channels: DataFrame, labels: DataFrame, names: list[str], upper: bool) -> DataFrame:
    """A row for each term: its positives p and negatives n, sums of channels over pairs of two positives (pp) and of unlike
    labels (pn), and of products of two channels (gram, row by row); null for a term without pairs."""
    pairs = _labelled(channels, labels)
    if upper:
        pairs = pairs.filter("src < dst")
    weights = [F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("weight"))), F.lit(0.0)) for c in names]
    wide = pairs.groupBy("term", "src", "dst", "a", "b").agg(F.array(*weights).alias("w"))
    both = (F.col("a") > 0) & (F.col("b") > 0)
    each = lambda kind: [F.sum(F.when(kind, F.col("w")[i]).otherwise(0.0)) for i in range(len(names))]
    gram = [F.sum(F.col("w")[i] * F.col("w")[j]) for i in range(len(names)) for j in range(len(names))]
    sums = wide.groupBy("term").agg(F.array(*each(both)).alias("pp"), F.array(*each(~both)).alias("pn"), F.array(*gram).alias("gram"))
    counts = labels.groupBy("term").agg(F.count_if(F.col("label") > 0).alias("p"), F.count_if(F.col("label") < 0).alias("n"))
    return counts.join(sums, "term", "left")


def _solve(gram: np.ndarray, target: np.ndarray, names: list[str]) -> dict[str, float]:
    """Least squares with a bias in place 0; channels with negative weights go until none is left."""
    keep = [i for i in range(1, len(target)) if gram[i, i] > 0]
    while keep:
        at = [0, *keep]
        try:
            alpha = np.linalg.solve(gram[np.ix_(at, at)], target[at])
        except np.linalg.LinAlgError:
            break
        bad = [i for i, x in zip(keep, alpha[1:], strict=True) if x < 0]
        if not bad:
            found = {i: float(x) for i, x in zip(keep, alpha[1:], strict=True)}
            return {n: found.get(k + 1, 0.0) for k, n in enumerate(names)}
        keep = [i for i in keep if i not in bad]
    return dict.fromkeys(names, 1 / len(names))


def _arrays(row, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    zero = lambda x, n: np.zeros(n) if x is None else np.asarray(x, float)
    return zero(row.pp, size), zero(row.pn, size), zero(row.gram, size * size).reshape(size, size)


def term_weights(channels: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, channel, alpha): for each term by itself; a term without negatives gets equal weights."""
    names = channel_names(channels)
    size = len(names)

    def solve(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples():
                p, n = int(row.p), int(row.n)
                if not p or not n:
                    rows += [(row.term, c, 1 / size) for c in names]
                    continue
                total, pairs = p + n, p * (p - 1) + 2 * p * n
                pos, neg, scale = 2 * n / total, -2 * p / total, 1 / pairs
                pp, pn, products = _arrays(row, size)
                gram, target = np.zeros((size + 1,) * 2), np.zeros(size + 1)
                gram[0, 0] = scale
                target[0] = scale * (p * (p - 1) * pos**2 + 2 * p * n * pos * neg) / pairs
                gram[0, 1:] = gram[1:, 0] = scale * (pp + pn)
                gram[1:, 1:] = products
                target[1:] = pp * pos**2 + pn * pos * neg
                rows += [(row.term, c, a) for c, a in _solve(gram, target, names).items()]
            yield pd.DataFrame(rows, columns=["term", "channel", "alpha"])

    return _sums(channels, labels, names, upper=False).mapInPandas(solve, "term string, channel string, alpha double")


def shared_weights(channels: DataFrame, labels: DataFrame) -> DataFrame:
    """(channel, alpha): one set of weights for all terms with two positives and two negatives at least.

    The terms' systems are averaged in Spark; the driver holds one of the channels' size."""
    names = channel_names(channels)
    size = len(names)
    rows = _sums(channels, labels, names, upper=True).filter("p > 1 and n > 1")
    total = F.col("p") + F.col("n")
    pos, neg = F.pow(F.col("n") / total, F.lit(2)), -F.col("p") * F.col("n") / (total * total)
    alike, unlike = F.col("p") * (F.col("p") - 1) / 2, F.col("p") * F.col("n")
    at = lambda c, i: F.coalesce(F.get(F.col(c), F.lit(i)), F.lit(0.0))
    one = rows.agg(
        F.count("*").alias("m"),
        F.avg(alike + unlike).alias("corner"),
        F.avg(alike * pos + unlike * neg).alias("target"),
        F.array(*[F.avg(at("pp", i) + at("pn", i)) for i in range(size)]).alias("edge"),
        F.array(*[F.avg(at("pp", i) * pos + at("pn", i) * neg) for i in range(size)]).alias("targets"),
        F.array(*[F.avg(at("gram", i)) for i in range(size * size)]).alias("gram"),
    ).first()
    if not one.m:
        alpha = dict.fromkeys(names, 1 / max(1, size))
    else:
        gram, target = np.zeros((size + 1,) * 2), np.zeros(size + 1)
        gram[0, 0], target[0] = one.corner, one.target
        gram[0, 1:] = gram[1:, 0] = one.edge
        gram[1:, 1:] = np.reshape(one.gram, (size, size))
        target[1:] = one.targets
        alpha = _solve(gram, target, names)
    return channels.sparkSession.createDataFrame(list(alpha.items()), "channel string, alpha double")

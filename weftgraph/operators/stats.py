"""Significance and overlap statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.lineage import materialize
from pyspark.sql.types import DoubleType

from weftgraph.functions.order import Ordered
from weftgraph.operators.evaluate import draw


def uniform_bins(degrees: DataFrame, bins: int) -> DataFrame:
    """(node, degree, bin): bins from 1 down the degrees, ties by node.

    From the place where a bin has had its share of nodes, the next node whose degree isn't the bin's first begins another.
    So a degree is parted once at most, and the rule, which carries state, runs over the distinct degrees, which are few."""
    counts = degrees.groupBy("degree").agg(F.count("*").alias("n"))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("degree", ascending=False)
        width = -(-int(pdf.n.sum()) // bins)
        rows, bin_, start, first = [], 1, 0, None
        for degree, n in zip(pdf.degree, pdf.n, strict=True):
            first = degree if first is None else first
            at = max(start, bin_ * width)
            parted = at < start + n and degree != first
            rows.append((degree, bin_, at - start if parted else int(n)))
            if parted:
                bin_, first = bin_ + 1, degree
            start += int(n)
        return pd.DataFrame(rows, columns=["degree", "bin", "kept"])

    kind = degrees.schema["degree"].dataType.simpleString()
    table = counts.groupBy(F.lit(True)).applyInPandas(assign, f"degree {kind}, bin int, kept long")
    place = F.row_number().over(Window.partitionBy("degree").orderBy("node")) - 1
    rows = degrees.select("node", "degree").withColumn("place", place).join(F.broadcast(table), "degree")
    return rows.select("node", "degree", (F.col("bin") + (F.col("place") >= F.col("kept")).cast("int")).alias("bin"))


def matched_sets(positives: DataFrame, binned: DataFrame, sets: int) -> DataFrame:
    """(rep, node, positive): for each set and positive a node of the same bin, with replacement across positives."""
    order = Window.partitionBy("bin").orderBy("node")
    pool = binned.withColumn("k", F.row_number().over(order) - 1)
    sizes = binned.groupBy("bin").agg(F.count("*").alias("size"))
    want = positives.select("node").join(binned, "node").join(F.broadcast(sizes), "bin").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(sets))))
    pick = F.conv(F.substring(draw("node", F.col("rep").cast("string")), 1, 8), 16, 10).cast("long") % F.col("size")
    want = want.select(F.col("node").alias("positive"), "bin", "rep", pick.cast("int").alias("k"))
    return want.join(pool.select("bin", "k", "node"), ["bin", "k"]).select("rep", "node", "positive")


def permutation_p(scores: DataFrame, random: DataFrame) -> DataFrame:
    """(node, score, pval): the share of random scores (rep, node, score) that reach the node's own."""
    joined = scores.join(random.select("node", F.col("score").alias("rand")), "node")
    return joined.groupBy("node").agg(F.first("score").alias("score"), F.avg((F.col("rand") >= F.col("score")).cast("double")).alias("pval"))


def simple_sets(nodes: DataFrame, size: int, sets: int) -> DataFrame:
    """(rep, node): for each set so many nodes, none twice, in the order of their draws."""
    grid = nodes.select("node").distinct().withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(sets))))
    order = Window.partitionBy("rep").orderBy(draw("node", F.col("rep").cast("string")), "node")
    return grid.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= size).select("rep", "node")


def two_sample_ks(one: DataFrame, other: DataFrame, value: str) -> DataFrame:
    """One row: the greatest amount by which the first sample's distribution stands below the second's, and its
    asymptotic one-sided p-value."""
    both = one.select(F.col(value).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(other.select(F.col(value), F.lit(0), F.lit(1)))
    steps = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    steps = Ordered(steps, "v").running_sum(F.col("a"), "run_a").running_sum(F.col("b"), "run_b").table()
    sizes = F.broadcast(steps.agg(F.sum("a").alias("m"), F.sum("b").alias("n")))
    gap = F.col("run_b") / F.col("n") - F.col("run_a") / F.col("m")
    out = steps.crossJoin(sizes).agg(F.greatest(F.max(gap), F.lit(0.0)).alias("d"), F.first("m").alias("m"), F.first("n").alias("n"))
    return out.select("d", F.exp(-2 * F.col("d") * F.col("d") * F.col("m") * F.col("n") / (F.col("m") + F.col("n"))).alias("pval"))


def jaccard(lists: DataFrame, key: str) -> DataFrame:
    """(a, b, both, jaccard) for all ordered pairs of lists that share a node."""
    sizes = lists.groupBy(key).agg(F.count_distinct("node").alias("n"))
    rows = lists.select(key, "node").distinct()
    pairs = rows.select(F.col(key).alias("a"), "node").join(rows.select(F.col(key).alias("b"), "node"), "node").groupBy("a", "b").agg(F.count("*").alias("both"))
    pairs = pairs.join(sizes.select(F.col(key).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(key).alias("b"), F.col("n").alias("nb")), "b")
    return pairs.select("a", "b", "both", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


@F.pandas_udf(DoubleType())
def hypergeometric_sf(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    """P(X >= k) for X marked among drawn of total."""
    from math import exp, lgamma

    def comb(n: int, r: int) -> float:
        return lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1)

    out = []
    for a, m, n, d in zip(k, total, marked, drawn, strict=True):
        low, high = max(int(a), 0, int(n + d - m)), int(min(n, d))
        all_ = comb(int(m), int(d))
        out.append(min(1.0, sum(exp(comb(int(n), x) + comb(int(m - n), int(d) - x) - all_) for x in range(low, high + 1))))
    return pd.Series(out, dtype="float64")


def enrichment(chosen: DataFrame, sets: DataFrame, universe: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, name, k, n, pval, padj, qval): overlap of the chosen nodes with each set (keys, name, node), with false discovery
    rates and q-values, which are told for each of the keys (an ontology, say) by itself."""
    keys = keys or []
    inside = sets.select(*keys, "name", "node").join(universe.select("node").distinct(), "node", "left_semi").distinct()
    pick = chosen.select("node").distinct().join(universe.select("node").distinct(), "node", "left_semi").withColumn("hit", F.lit(1))
    counts = inside.join(pick, "node", "left").groupBy(*keys, "name").agg(F.count("hit").alias("k"), F.count("*").alias("n"))
    sizes = universe.agg(F.count_distinct("node").alias("total")).crossJoin(F.broadcast(pick.agg(F.count("*").alias("drawn"))))
    rows = counts.filter("k > 0").crossJoin(F.broadcast(sizes)).withColumn("pval", hypergeometric_sf("k", "total", "n", "drawn"))
    return adjust(rows.select(*keys, "name", "k", "n", "pval"), "name", keys)


#: Share of the p-values above which they count as those of true null hypotheses.
NULL_FROM = 0.05


def adjust(rows: DataFrame, key: str, keys: list[str] | None = None) -> DataFrame:
    """rows with padj, Benjamini and Hochberg's false discovery rate of pval, and qval, that rate times the share of true null
    hypotheses, as estimated from the p-values above NULL_FROM; within keys, if given."""
    if keys:
        whole = Window.partitionBy(*keys).orderBy("pval", key)
        everything = Window.partitionBy(*keys)
        rows = rows.withColumn("m_", F.count("*").over(everything)).withColumn("null_", F.count_if(F.col("pval") > NULL_FROM).over(everything))
        rows = rows.withColumn("raw_", F.col("pval") * F.col("m_") / F.row_number().over(whole))
        rows = rows.withColumn("low_", F.min("raw_").over(whole.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    else:
        size = F.broadcast(rows.agg(F.count("*").alias("m_"), F.count_if(F.col("pval") > NULL_FROM).alias("null_")))
        placed = Ordered(rows.crossJoin(size), "pval", key).rank("rank_")
        rows = placed.following_min(F.col("pval") * F.col("m_") / F.col("rank_"), "low_").table().drop("rank_")
    padj = F.least(F.lit(1.0), F.col("low_"))
    share = F.least(F.lit(1.0), F.col("null_") / F.col("m_") / (1 - NULL_FROM))
    return rows.withColumn("padj", padj).withColumn("qval", share * padj).drop("m_", "null_", "raw_", "low_")


def significant(rows: DataFrame, p: float = 0.01, q: float = 0.05) -> DataFrame:
    return rows.filter((F.col("padj") <= p) & (F.col("qval") <= q))


def spearman(scores: DataFrame, key: str) -> DataFrame:
    """(a, b, rho) over the nodes that both score, tied ranks averaged."""
    rows = scores.select(key, "node", "score")
    pairs = rows.select(F.col(key).alias("a"), "node", F.col("score").alias("x")).join(rows.select(F.col(key).alias("b"), "node", F.col("score").alias("y")), "node").filter("a < b")
    for value, name in (("x", "rx"), ("y", "ry")):
        order, ties = Window.partitionBy("a", "b").orderBy(value), Window.partitionBy("a", "b", value)
        pairs = pairs.withColumn(name, F.rank().over(order) + (F.count("*").over(ties) - 1) / 2)
    return pairs.groupBy("a", "b").agg(F.corr("rx", "ry").alias("rho"))


def signed_rank(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, w, z, tied): Wilcoxon's signed rank sum of x - y without zeros, its normal deviate with tie correction, and the
    sum of that correction, which is 0 without ties."""
    rows = pairs.withColumn("d", F.round(F.col("x") - F.col("y"), 9)).filter("d <> 0").withColumn("m", F.abs("d"))
    order, ties = Window.partitionBy(*keys).orderBy("m"), Window.partitionBy(*keys, "m")
    rows = rows.withColumn("t", F.count("*").over(ties)).withColumn("r", F.rank().over(order) + (F.col("t") - 1) / 2)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w"), F.sum((F.col("t") * F.col("t") - 1).cast("double")).alias("tied")
    )
    n = F.col("n")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("tied") / 2) / 24)
    return out.select(*keys, "n", "w", ((F.col("w") - n * (n + 1) / 4) / spread).alias("z"), "tied")


@F.pandas_udf(DoubleType())
def signed_rank_p(n: pd.Series, w: pd.Series, tied: pd.Series, z: pd.Series) -> pd.Series:
    """P(W >= w) for n pairs: exact without ties up to 50 pairs, else by the normal deviate."""
    from math import erfc, floor, sqrt

    out, known = [], {}
    for m, x, t, d in zip(n, w, tied, z, strict=True):
        m = int(m)
        if t or m > 50:
            out.append(erfc(d / sqrt(2)) / 2)
            continue
        if m not in known:
            ways = np.ones(1)  # subsets of the ranks up to k, by their sum
            for k in range(1, m + 1):
                ways = np.append(ways, np.zeros(k)) + np.append(np.zeros(k), ways)
            known[m] = ways / 2.0**m
        out.append(min(1.0, float(known[m][max(0, floor(x)) :].sum())))
    return pd.Series(out, dtype="float64")


def signed_rank_tests(pairs: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """(keys, n, w, z, pval, corrected): one-sided tests of x > y for the keys with so many pairs at least, and their p-values
    times the number of tests."""
    enough = pairs.groupBy(*keys).agg(F.count("*").alias("pairs")).filter(F.col("pairs") >= least)
    rows = signed_rank(pairs.join(enough.select(*keys), keys, "left_semi"), keys)
    tests = F.broadcast(enough.agg(F.count("*").alias("tests")))
    rows = rows.withColumn("pval", signed_rank_p("n", "w", "tied", "z")).crossJoin(tests)
    return rows.select(*keys, "n", "w", "z", "pval", F.least(F.lit(1.0), F.col("pval") * F.col("tests")).alias("corrected"))


def wins(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, wins, ties, losses) of x against y."""
    share = lambda c: F.avg(c.cast("double"))
    return pairs.groupBy(*keys).agg(share(F.col("x") > F.col("y")).alias("wins"), share(F.col("x") == F.col("y")).alias("ties"), share(F.col("x") < F.col("y")).alias("losses"))


def inversions(y: np.ndarray) -> int:
    """Pairs of y that stand in falling order, by merging sorted runs of doubled length."""
    y = np.unique(y, return_inverse=True)[1].astype(np.int64)
    n, total, width, place = len(y), 0, 1, np.arange(len(y))
    while width < n:
        run = place // (2 * width)
        left = (place // width) % 2 == 0
        order = np.lexsort((~left, y, run))  # of equals, the left run's first
        # Each of the right run passes those of its left run that stand after it.
        ahead = np.cumsum(left[order])
        ends = np.minimum((run + 1) * 2 * width, n) - 1
        total += int((ahead[ends[order]] - ahead)[~left[order]].sum())
        y, width = y[order], 2 * width
    return total


#: Ranges that a ranking is cut into by either value, and rows of a ranking that stays whole.
RANGES, WHOLE = 128, 20_000


def kendall_tau(ranks: DataFrame, keys: list[str], ranges: int = RANGES, whole: int = WHOLE) -> DataFrame:
    """(keys, tau) of two rankings (x, y) of nodes: concordant less discordant pairs, over all. A pair tied in either counts as
    neither; a single row has no tau.

    Discordant pairs are counted in ranges of x, in ranges of y, and by the counts of both. A pair in one range of x is seen
    there; of pairs in two ranges of x, one in one range of y is seen there, and the others follow from how many rows each pair
    of ranges has. Ranges lie between the quantiles of a ranking, and a quantile's own value is a range by itself, in which no
    pair is discordant: no task reads more than a share of a ranking, however many ties it has."""
    rows = ranks.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    ends = lambda name: F.when(F.col("n") > whole, F.array_distinct(f"{name}s")).otherwise(F.array().cast("array<double>")).alias(f"{name}s")
    own = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("x", shares, 10 * ranges).alias("xs"), F.percentile_approx("y", shares, 10 * ranges).alias("ys"))
    own = materialize(own.select(*keys, "n", ends("x"), ends("y")), "quantiles")
    place = lambda name: (2 * F.size(F.filter(f"{name}s", lambda e: e < F.col(name))) + F.array_contains(f"{name}s", F.col(name)).cast("int")).alias(f"{name}_range")
    placed = materialize(rows.join(own, keys).select(*keys, "x", "y", place("x"), place("y")), "placed")
    kinds = ", ".join(f"{k} {ranks.schema[k].dataType.simpleString()}" for k in keys)

    def counted(first: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            y = pdf.y.to_numpy()[np.lexsort((pdf.y.to_numpy(), pdf[first].to_numpy()))]
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "pairs": [inversions(y)]})

        return run

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((pdf.x_range.max() + 1, pdf.y_range.max() + 2), np.int64)
        counts[pdf.x_range, pdf.y_range] = pdf.n
        later = counts[::-1].cumsum(0)[::-1] - counts  # of higher ranges of x
        lower = later.cumsum(1) - later  # and lower ranges of y
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "pairs": [int((counts * lower).sum())]})

    schema = f"{kinds}, pairs bigint"
    found = placed.filter("x_range % 2 = 0").groupBy(*keys, "x_range").applyInPandas(counted("x"), schema)
    found = found.unionByName(placed.filter("y_range % 2 = 0").groupBy(*keys, "y_range").applyInPandas(counted("x_range"), schema))
    found = found.unionByName(placed.groupBy(*keys, "x_range", "y_range").agg(F.count("*").alias("n")).groupBy(*keys).applyInPandas(across, schema))

    def tied(*columns: str) -> DataFrame:
        return placed.groupBy(*keys, *columns).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))

    parts = found.withColumn("by", -2 * F.col("pairs"))
    for table, sign in ((tied("x"), -1), (tied("y"), -1), (tied("x", "y"), 1)):
        parts = parts.unionByName(table.withColumn("by", sign * F.col("pairs")))
    whole_ = own.select(*keys, F.expr("n * (n - 1) div 2").alias("all"))
    return whole_.join(parts.groupBy(*keys).agg(F.sum("by").alias("by")), keys).select(*keys, F.try_divide(F.col("all") + F.col("by"), F.col("all")).alias("tau"))


def histogram(values: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n, density): equal bins from the least to the greatest value; the greatest is in the last."""
    ends = F.broadcast(values.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total")))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))
    rows = values.filter(F.col(value).isNotNull()).crossJoin(ends)
    return rows.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"), (F.count("*") / F.first("total") / F.first(width)).alias("density"))


def density(values: DataFrame, value: str, points: int = 64, width: float | None = None) -> DataFrame:
    """(point, at, density): a Gaussian kernel density at equal steps from the least to the greatest value.

    Values are binned linearly first: each gives its weight to the two points beside it, by its distance. The points' weights,
    of which there are as many as points, are then convolved with the kernel. width: the kernel's deviation, by default the
    values' times n^(-1/5)."""
    rows = values.select(F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"), F.coalesce(F.stddev("v"), F.lit(0.0)).alias("sd"))
    spread = F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)) if width is None else F.lit(float(width))
    ends = F.broadcast(ends.filter("hi > lo").select("lo", "n", ((F.col("hi") - F.col("lo")) / (points - 1)).alias("step"), spread.alias("h")))
    at = (F.col("v") - F.col("lo")) / F.col("step")
    below = F.least(F.floor(at), F.lit(points - 2)).cast("int")
    placed = rows.crossJoin(ends).select(F.explode(F.array(F.struct(below.alias("bin"), (1 - (at - below)).alias("w")), F.struct((below + 1).alias("bin"), (at - below).alias("w")))).alias("b"))
    weights = placed.groupBy("b.bin").agg(F.sum("b.w").alias("w"))
    grid = rows.sparkSession.range(points).select(F.col("id").cast("int").alias("point")).crossJoin(ends)
    far = (F.col("point") - F.col("bin")) * F.col("step") / F.col("h")
    kernel = F.exp(-far * far / 2) / (F.sqrt(2 * F.pi()) * F.col("h") * F.col("n"))
    # points x points numbers, whatever the number of values.
    summed = grid.join(F.broadcast(weights), F.lit(True)).groupBy("point").agg(F.first(F.col("lo") + F.col("point") * F.col("step")).alias("at"), F.sum(F.col("w") * kernel).alias("density"))
    return summed.select("point", "at", "density")


def pair_values(values: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, source, node, value) for all ordered pairs of a set's nodes that have a value (source, node, value)."""
    one, two = sets.select("rep", F.col("node").alias("source")).distinct(), sets.select("rep", "node").distinct()
    return values.filter("source <> node").join(one, "source").join(two, ["rep", "node"]).select("rep", "source", "node", "value")


def box_summary(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, low, q1, median, q3, high, n_out): quartiles, the ends of the whiskers (the outermost values within one and a
    half of the quartiles' distance from them), and the values beyond."""
    part = lambda p, name: F.percentile(value, p).alias(name)
    boxes = values.groupBy(*keys).agg(part(0.25, "q1"), part(0.5, "median"), part(0.75, "q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    rows = values.join(boxes, keys).withColumn("inside", inside)
    kept = F.when(F.col("inside"), F.col(value))
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(kept).alias("low"), *[F.first(c).alias(c) for c in ("q1", "median", "q3")], F.max(kept).alias("high"), F.count_if(~F.col("inside")).alias("n_out")
    )


def leave_one_out(values: DataFrame, positives: DataFrame, random: DataFrame) -> DataFrame:
    """(node, total, pval): a positive's summed values to the other positives, against those of the drawn nodes.

    values is (source, node, value) for positives as nodes; the p-value is (1 + drawn sums above) / drawn nodes. Drawn sums are
    counted along one order of all sums."""
    pos = positives.select("node").distinct()
    sums = values.filter("source <> node").join(pos, "node", "left_semi").groupBy("source").agg(F.sum("value").alias("total"))
    total = lambda t: t.select(F.col("node").alias("source")).distinct().join(sums, "source", "left").na.fill(0.0, ["total"])
    own, drawn = total(pos), total(random)
    steps = drawn.groupBy("total").agg(F.count("*").alias("n")).unionByName(own.select("total", F.lit(0).cast("long").alias("n")).distinct()).groupBy("total").agg(F.sum("n").alias("n"))
    steps = Ordered(steps, "total").running_sum(F.col("n"), "up_to").table()
    size = F.broadcast(drawn.agg(F.count("*").alias("m")))
    out = own.join(steps.select("total", "up_to"), "total").crossJoin(size)
    return out.select(F.col("source").alias("node"), "total", ((1 + F.col("m") - F.col("up_to")) / F.col("m")).alias("pval"))


def combined_enrichment(rows: DataFrame, cutoff: float, descriptions: DataFrame | None = None, reference: DataFrame | None = None) -> DataFrame:
    """(name, n_datasets, best): sets that are enriched in any dataset, by the number of datasets and least adjusted p.

    descriptions (name, description) adds those; reference (name, padj) adds in_reference, and the reference's own enriched
    sets, with no dataset."""
    good = rows.filter(F.col("padj") < cutoff)
    out = good.groupBy("name").agg(F.count_distinct("dataset").alias("n_datasets"), F.min("padj").alias("best"))
    if reference is not None:
        known = reference.filter(F.col("padj") < cutoff).select("name").distinct().withColumn("in_reference", F.lit(True))
        out = out.join(known, "name", "full_outer").na.fill(0, ["n_datasets"]).na.fill(False, ["in_reference"])
    if descriptions is not None:
        out = out.join(descriptions.groupBy("name").agg(F.min("description").alias("description")), "name", "left")
    return out

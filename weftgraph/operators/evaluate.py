"""Sampling, splits and ranking measures; every term, fold and repetition is a key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.lineage import materialize
from weftgraph.functions.order import Ordered


def draw(*parts: Column | str) -> Column:
    """A reproducible random order: the digest of a key's parts."""
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, int) else p for p in parts]).cast("binary"))


#: Rounds of a permutation; each adds to one half of a place a digest of the other.
FEISTEL = 4


def permuted(place: Column, count: Column, *salt: Column | str) -> Column:
    """A place of 0 to rows * columns - 1 under a permutation told by the salt; rows = ceil(sqrt(count)), and columns as many
    as hold count places, so that fewer than rows of the results are count or more."""
    rows = F.ceil(F.sqrt(count)).cast("long")
    columns = F.ceil(count / rows).cast("long")
    halves = F.struct((place / columns).cast("long").alias("a"), F.pmod(place, columns).alias("b"))
    mixed = lambda half, k: F.conv(F.substring(draw(half.cast("string"), *salt, k), 1, 8), 16, 10).cast("long")

    def step(k: int):
        if k % 2:
            return lambda h: F.struct(h["a"].alias("a"), F.pmod(h["b"] + mixed(h["a"], k), columns).alias("b"))
        return lambda h: F.struct(F.pmod(h["a"] + mixed(h["b"], k), rows).alias("a"), h["b"].alias("b"))

    for k in range(FEISTEL):
        halves = F.element_at(F.transform(F.array(halves), step(k)), 1)
    return F.element_at(F.transform(F.array(halves), lambda h: h["a"] * columns + h["b"]), 1)


def sample_negatives(positives: DataFrame, universe: DataFrame, factor: float, rep: int = 1) -> DataFrame:
    """(term, node): int(factor * n+) nodes of the universe for each term, none of its positives, none twice.

    Nodes have places in the order of their names; a term draws them by a permutation of its own, and needs no more draws than
    it has negatives and positives and than the permutation leaves its range (the square root of the nodes' number at most). The
    nodes that no term draws are not looked at."""
    places = Ordered(universe.select("node").distinct(), "node").rank("place").table()
    places = materialize(places.select("node", (F.col("place") - 1).cast("long").alias("place")), "places")
    n = places.count()
    own = positives.select("term", "node").distinct()
    wanted = own.groupBy("term").agg(F.floor(factor * F.count("*")).alias("k"), F.count("*").alias("p"))
    rows = max(1, math.isqrt(max(0, n - 1)) + 1 if n else 1)
    size = rows * -(-n // rows)
    draws = F.least(F.lit(size), F.col("k") + F.col("p") + (size - n))
    drawn = wanted.filter("k > 0").select("term", "k", F.explode(F.sequence(F.lit(0).cast("long"), draws - 1)).alias("turn")) if n else wanted.select("term", "k", F.lit(0).cast("long").alias("turn")).limit(0)
    drawn = drawn.withColumn("place", permuted(F.col("turn"), F.lit(n), "term", rep)).join(places, "place").join(own, ["term", "node"], "left_anti")
    order = Window.partitionBy("term").orderBy("turn")
    return drawn.withColumn("n", F.row_number().over(order)).filter("n <= k").select("term", "node")


def split_folds(labels: DataFrame, folds: int, rep: int = 1) -> DataFrame:
    """labels with a fold; positives and negatives are split apart, and a term with too few of either goes."""
    order = Window.partitionBy("term", "label").orderBy(draw("node", "term", rep), "node")
    rows = labels.withColumn("fold", (F.row_number().over(order).cast("long") - 1) % folds)
    enough = labels.groupBy("term").agg(F.count_if(F.col("label") > 0).alias("p"), F.count_if(F.col("label") < 0).alias("n"))
    return rows.join(enough.filter((F.col("p") >= folds) & (F.col("n") >= folds)).select("term"), "term", "left_semi")


def leave_group_out(labels: DataFrame, groups: DataFrame, least: int = 10, oracle: bool = False, evaluation: DataFrame | None = None) -> DataFrame:
    """(group, term, node, label, train): for each group its nodes are tested and all others train; too small terms go.

    Tested labels are those of `evaluation`, if it is given. A node of several groups may be on both sides: then no training
    positive is tested, and no training label is tested as a negative. oracle: no tested positive trains as a negative."""
    own = lambda t: t.select("term", "node", "label").join(groups.select("node", F.col("group").alias("own")).distinct(), "node")
    test = own(labels if evaluation is None else evaluation).withColumnRenamed("own", "group")
    pairs = test.select("term", "group").distinct()
    inside = groups.select("node", "group").distinct().withColumn("in", F.lit(True))
    train = pairs.join(labels.select("term", "node", "label"), "term").join(inside, ["node", "group"], "left").filter("`in` is null").drop("in")
    axis = ["group", "term", "node"]
    test = test.join(train.filter("label > 0").select(*axis), axis, "left_anti")
    if oracle:
        hidden = test.filter("label > 0").select(*axis, F.lit(-1).alias("label"))
        train = train.join(hidden, [*axis, "label"], "left_anti")
    negatives = test.filter("label < 0").join(train.select(*axis), axis, "left_anti")
    test = test.filter("label > 0").unionByName(negatives)
    rows = train.select(*axis, "label").withColumn("train", F.lit(True)).unionByName(test.select(*axis, "label").withColumn("train", F.lit(False)))
    count = lambda label, side: F.count_if((F.col("label") == label) & (F.col("train") == F.lit(side)))
    good = rows.groupBy("group", "term").agg(count(1, True).alias("a"), count(1, False).alias("b"), count(-1, True).alias("c"), count(-1, False).alias("d"))
    good = good.filter((F.col("a") >= least) & (F.col("b") >= least) & (F.col("c") > 0) & (F.col("d") > 0))
    return rows.join(good.select("group", "term"), ["group", "term"], "left_semi").select("group", "term", "node", "label", "train")


def skip_done(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The runs that have no results yet."""
    return wanted.select(*keys).distinct().join(done.select(*keys).distinct(), keys, "left_anti")


def curve(scores: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, score, idx, label, tp, fp, prec, rec, fpr): a point at every labelled node down the ranking.

    idx counts unlabelled nodes too, from 0. Keys without positives or without negatives go."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "node")
    rows = scores.withColumn("idx", F.row_number().over(order).cast("long") - 1).join(labels, [*keys, "node"])
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("tp", F.sum((F.col("label") > 0).cast("long")).over(run)).withColumn("fp", F.sum((F.col("label") < 0).cast("long")).over(run))
    totals = labels.groupBy(*keys).agg(F.count_if(F.col("label") > 0).alias("n_pos"), F.count_if(F.col("label") < 0).alias("n_neg"))
    rows = rows.join(totals.filter("n_pos > 0 and n_neg > 0"), keys)
    return rows.select(
        *keys, "node", "score", "idx", "label", "tp", "fp", "n_pos", "n_neg",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("prec"), (F.col("tp") / F.col("n_pos")).alias("rec"), (F.col("fp") / F.col("n_neg")).alias("fpr"),
    )


def measures(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fmax, avgp, auprc, auroc, n_pos): of the points of `curve`.

    AUROC counts ties half. AUPRC is the integral of precision over recall with precision interpolated between distinct
    scores along counts of true and false positives."""
    f = F.coalesce(F.try_divide(2 * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec")), F.lit(0.0))
    one = points.groupBy(*keys).agg(F.max(f).alias("fmax"), (F.sum(F.when(F.col("label") > 0, F.col("prec")).otherwise(0.0)) / F.max("n_pos")).alias("avgp"), F.max("n_pos").alias("n_pos"))
    steps = points.groupBy(*keys, "score").agg(F.max("tp").alias("tp"), F.max("fp").alias("fp"), F.max("n_pos").alias("p"), F.max("n_neg").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"))
    steps = steps.withColumn("tp0", F.coalesce(F.lag("tp").over(order), F.lit(0))).withColumn("fp0", F.coalesce(F.lag("fp").over(order), F.lit(0)))
    dt, df = F.col("tp") - F.col("tp0"), F.col("fp") - F.col("fp0")
    roc = df / F.col("n") * (F.col("tp") + F.col("tp0")) / 2 / F.col("p")
    h = df / dt
    a, b = 1 + h, F.col("fp0") - h * F.col("tp0")
    whole = (dt / a - b / (a * a) * (F.ln(a * F.col("tp") + b) - F.ln(a * F.col("tp0") + b))) / F.col("p")
    pr = F.when(dt == 0, F.lit(0.0)).when(F.abs(b) < 1e-12, dt / a / F.col("p")).otherwise(whole)
    two = steps.groupBy(*keys).agg(F.sum(pr).alias("auprc"), F.sum(roc).alias("auroc"), F.count("*").alias("n_points"))
    out = one.join(two, keys)
    single = F.col("n_points") <= 1
    return out.select(*keys, "fmax", "avgp", F.when(single, 0.0).otherwise(F.col("auprc")).alias("auprc"), F.when(single, 0.0).otherwise(F.col("auroc")).alias("auroc"), "n_pos")


def early_precision(points: DataFrame, keys: list[str], recalls: list[float], factors: list[int]) -> DataFrame:
    """Precision at the first point that reaches each recall, and at the first whose rank reaches each factor times n+."""
    at = lambda name, ok: F.coalesce(F.min_by(F.when(ok, F.col("prec")), F.when(ok, F.col("idx"))), F.max_by("prec", "idx")).alias(name)
    columns = [at(f"prec_r{int(round(100 * r))}", F.col("rec") >= r) for r in recalls] + [at(f"prec_k{k}", F.col("idx") >= k * F.col("n_pos")) for k in factors]
    return points.groupBy(*keys).agg(*columns)


def over_random(measure: Column, factor: float) -> Column:
    return measure / F.lit(1 / (1 + factor))


def split_by_mask(labels: DataFrame, mask: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test): labels of nodes outside of the mask and of those in it."""
    nodes = mask.select("node").distinct()
    return labels.join(nodes, "node", "left_anti"), labels.join(nodes, "node", "left_semi")

"""Networks as edge tables (src, dst, weight), both directions stored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.lineage import cut, materialize
from weftgraph.functions.order import Ordered


def sum_edges(raw: DataFrame) -> DataFrame:
    """Duplicate edges of a single-network file are summed."""
    return raw.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def last_edges(raw: DataFrame, order: str, *keys: str) -> DataFrame:
    """Of duplicate undirected edges of a channel the last in file order counts."""
    ends = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    return raw.select(*keys, *ends, "weight", order).groupBy(*keys, "src", "dst").agg(F.max_by("weight", order).alias("weight"))


def symmetrise(edges: DataFrame) -> DataFrame:
    """W + W' unless W is symmetric already; a self-loop doubles with the rest. Repeated edges are summed."""
    return both_ways(symmetric_pairs(edges))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each edge of a table that has it once, and its reverse; a self-loop once."""
    forth, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ways = F.when(F.col("src") == F.col("dst"), F.array(forth)).otherwise(F.array(forth, back))
    return pairs.select(F.explode(ways).alias("w"), "weight").select("w.src", "w.dst", "weight")


def symmetric_pairs(edges: DataFrame) -> DataFrame:
    """The edges of `symmetrise`, each once, the lesser name first.

    One aggregate by unordered pair has both directions' sums, which also tell whether W is symmetric."""
    forth = F.col("src") <= F.col("dst")
    pairs = edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(
        F.sum(F.when(forth, F.col("weight"))).alias("forth"), F.sum(F.when(~forth, F.col("weight"))).alias("back")
    )
    # Not a filter: that would be read before the pairs are summed, which then would be done twice.
    same = pairs.agg(F.coalesce(F.bool_and(F.when(F.col("u") != F.col("v"), F.col("forth").eqNullSafe(F.col("back")))), F.lit(False)).alias("same"))
    loops = F.when(F.col("u") == F.col("v"), F.col("forth"))
    weight = F.when(F.col("same"), F.col("forth")).otherwise(F.coalesce("forth", F.lit(0.0)) + F.coalesce(F.col("back"), loops, F.lit(0.0)))
    return pairs.crossJoin(F.broadcast(same)).select(F.col("u").alias("src"), F.col("v").alias("dst"), weight.alias("weight"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def index_nodes(nodes: DataFrame) -> DataFrame:
    """(node, idx): places 0..N-1 in lexicographic order."""
    return Ordered(nodes.select("node").distinct(), "node").rank("rank").table().select("node", (F.col("rank") - 1).alias("idx"))


def unweighted(edges: DataFrame) -> DataFrame:
    return edges.filter("weight > 0").withColumn("weight", F.lit(1.0))


def degrees(edges: DataFrame, *keys: str) -> DataFrame:
    """(node, degree, strength): neighbours and summed weight."""
    return edges.groupBy(*keys, F.col("src").alias("node")).agg(F.count_distinct("dst").alias("degree"), F.sum("weight").alias("strength"))


def row_normalise(edges: DataFrame, lam: float = 0.0) -> DataFrame:
    """W_ij / (strength_i + lam * max W); a row without weight gives 0."""
    total = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    if lam:
        total = total.crossJoin(F.broadcast(edges.agg(F.max("weight").alias("top")))).withColumn("total", F.col("total") + lam * F.col("top")).drop("top")
    return edges.join(total, "src").select("src", "dst", F.coalesce(F.try_divide("weight", "total"), F.lit(0.0)).alias("weight"))


def symmetric_normalise(edges: DataFrame, *keys: str) -> DataFrame:
    """W_ij / sqrt(strength_i * strength_j), for each channel if keys name one."""
    total = edges.groupBy(*keys, "src").agg(F.sum("weight").alias("d"))
    left = edges.join(total.withColumnRenamed("d", "du"), [*keys, "src"])
    both = left.join(total.select(*keys, F.col("src").alias("dst"), F.col("d").alias("dv")), [*keys, "dst"])
    return both.select(*keys, "src", "dst", F.coalesce(F.try_divide("weight", F.sqrt(F.col("du") * F.col("dv"))), F.lit(0.0)).alias("weight"))


def laplacian(edges: DataFrame) -> DataFrame:
    """The column sums of S on the diagonal, less S."""
    diagonal = edges.groupBy("dst").agg(F.sum("weight").alias("weight")).select(F.col("dst").alias("src"), "dst", "weight")
    return diagonal.unionByName(edges.withColumn("weight", -F.col("weight"))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """No edge of any of the nodes."""
    out = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_anti")
    return out.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select(*edges.columns)


def within_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The subgraph that the nodes induce."""
    out = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    return out.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(*edges.columns)


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair once, the lesser name first, self-loops left out."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").distinct()


def add_networks(*networks: DataFrame) -> DataFrame:
    """The sum of several networks."""
    both = networks[0]
    for x in networks[1:]:
        both = both.unionByName(x)
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def without_pairs(edges: DataFrame, ones: DataFrame, others: DataFrame) -> DataFrame:
    """No edge between a node of ones and a node of others, either way."""
    flag = lambda t, end, name: t.select(F.col("node").alias(end)).distinct().withColumn(name, F.lit(True))
    e = edges
    for t, name in ((ones, "a"), (others, "b")):
        for end in ("src", "dst"):
            e = e.join(flag(t, end, f"{name}_{end}"), end, "left")
    hit = lambda x, y: F.coalesce(F.col(x), F.lit(False)) & F.coalesce(F.col(y), F.lit(False))
    return e.filter(~(hit("a_src", "b_dst") | hit("b_src", "a_dst"))).select(*edges.columns)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that is reachable; by alternating large-star and small-star steps."""
    nodes = nodes_of(edges)
    links = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct())
    last = None
    while True:
        mark = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == last or mark[0] == 0:
            break
        last = mark
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(moved.union(small.select("u", "m")).distinct())
    return nodes.join(links.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def network_statistics(edges: DataFrame, component: DataFrame, positives: DataFrame) -> DataFrame:
    """One row: nodes with edges, edges, components, quantiles of their sizes, and the share and positives of the largest."""
    sizes = component.groupBy("component").agg(F.count("*").alias("size"))
    pos = component.join(positives.select("node").distinct(), "node", "left_semi").groupBy("component").agg(F.count("*").alias("pos"))
    one = sizes.join(pos, "component", "left").agg(
        F.sum("size").alias("n_nodes"),
        F.count("*").alias("n_components"),
        F.max("size").alias("max_size"),
        F.percentile("size", 0.75).alias("p75"),
        F.percentile("size", 0.5).alias("p50"),
        F.percentile("size", 0.25).alias("p25"),
        (100.0 * F.max("size") / F.sum("size")).alias("percent_largest"),
        F.max_by(F.coalesce("pos", F.lit(0)), F.struct("size", "component")).alias("positives_largest"),
    )
    return one.crossJoin(F.broadcast(undirected(edges).agg(F.count("*").alias("n_edges"))))


def cost_ln(weight: Column, top: Column) -> Column:
    return -F.ln(weight / (F.greatest(top, F.lit(1.0)) + 1))


def cost_log10(weight: Column, top: Column) -> Column:
    return -F.log10(weight / top * 0.7)


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (source, node, dist, parent) the least of each source and node in a batch, so that a hub's many rows become few where they are made."""
    for batch in batches:
        if batch.num_rows:
            source, node, dist, parent = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            order = np.lexsort((parent, dist, node, source))
            source, node = source[order], node[order]
            yield batch.take(pa.array(order[np.concatenate(([True], (source[1:] != source[:-1]) | (node[1:] != node[:-1])))]))


def distances(edges: DataFrame, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """(source, node, dist, hops, parent): cheapest paths by relaxation; edges carry `cost`, those without one are none. Parents are the least node.

    Nodes are numbered in the order of their names, so that the least number is the least name. A round's rows all have as many hops
    as there were rounds; they are reduced by batches before they are sorted or sent."""
    axis = ["source", "node"]
    named = materialize(index_nodes(nodes_of(edges).union(sources.select("node"))), "names")
    one, two = named.select(F.col("node").alias("src"), F.col("idx").alias("a")), named.select(F.col("node").alias("dst"), F.col("idx").alias("b"))
    steps = edges.filter("cost is not null").join(one, "src").join(two, "dst").select("a", "b", F.col("cost").cast("double").alias("cost"))
    steps = materialize(steps.repartition("b").sortWithinPartitions("b"), "steps")
    start = sources.select("node").distinct().join(named, "node").select(F.col("idx").alias("source"), F.col("idx").alias("node"))
    state = cut(start.select(*axis, F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.lit(None).cast("long").alias("parent")))
    frontier, k = state, 0
    while rounds is None or k < rounds:
        k += 1
        step = frontier.join(steps, F.col("node") == F.col("a")).select("source", F.col("b").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"), F.col("a").alias("parent"))
        step = step.mapInArrow(_nearest, "source bigint, node bigint, dist double, parent bigint")
        best = step.groupBy(*axis).agg(F.min(F.struct("dist", "parent")).alias("b")).select(*axis, "b.dist", F.lit(k).alias("hops"), "b.parent")
        old = state.select(*axis, F.col("dist").alias("old"), F.col("hops").alias("old_hops"))
        better = best.join(old, axis, "left").filter("old is null or dist < old - 1e-12 or (abs(dist - old) <= 1e-12 and hops < old_hops)")
        frontier = cut(better.drop("old", "old_hops"))
        if not frontier.limit(1).count():
            break
        state = cut(state.join(frontier.select(*axis), axis, "left_anti").unionByName(frontier))
    name = lambda c: named.select(F.col("idx").alias(c), F.col("node").alias(f"{c}_name"))
    told = state.join(name("source"), "source").join(name("node"), "node").join(name("parent"), "parent", "left")
    return told.select(F.col("source_name").alias("source"), F.col("node_name").alias("node"), "dist", "hops", F.col("parent_name").alias("parent"))


def closest_sources(reached: DataFrame) -> DataFrame:
    """(node, source, dist, hops): the cheapest source of each node, ties by name; unreachable nodes have no row."""
    return reached.groupBy("node").agg(F.min(F.struct("dist", "source", "hops")).alias("b")).select("node", "b.source", "b.dist", "b.hops")


def near_sources(reached: DataFrame, least: int = 2) -> DataFrame:
    """(node, source, within): all sources within the node's least number of hops to any, or within `least` if that is more."""
    nearest = reached.groupBy("node").agg(F.greatest(F.min("hops"), F.lit(least)).alias("within"))
    return reached.join(nearest, "node").filter("hops <= within").select("node", "source", "within")


def path_nodes(reached: DataFrame) -> DataFrame:
    """(node, target, step): the nodes on a shortest path to each node's nearest source, the least parent first."""
    near = reached.groupBy("node").agg(F.min(F.struct("dist", "source")).alias("b")).select(F.col("node").alias("target"), F.col("b.source").alias("source"))
    walk = cut(near.withColumn("node", F.col("target")).withColumn("step", F.lit(0)))
    found = walk
    while True:
        up = reached.select("source", "node", "parent").filter("parent is not null")
        walk = cut(walk.join(up, ["source", "node"]).select("target", "source", F.col("parent").alias("node"), (F.col("step") + 1).alias("step")))
        if not walk.limit(1).count():
            return found.select("target", "source", "node", "step")
        found = cut(found.unionByName(walk))


def neighbour_shares(edges: DataFrame, positives: DataFrame) -> DataFrame:
    """(node, n_pos, share): positive neighbours, and their share of all neighbours."""
    pos = positives.select(F.col("node").alias("dst")).distinct().withColumn("hit", F.lit(1))
    joined = edges.select("src", "dst").distinct().join(pos, "dst", "left")
    out = joined.groupBy(F.col("src").alias("node")).agg(F.count("hit").alias("n_pos"), F.count("*").alias("n"))
    return out.select("node", "n_pos", (F.col("n_pos") / F.col("n")).alias("share"))


def stranded(component: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """(term, n_test, n_stranded): test positives, and those in components without a training positive of their term."""
    reached = train.join(component, "node").select("term", "component").distinct().withColumn("ok", F.lit(1))
    rows = test.join(component, "node").join(reached, ["term", "component"], "left")
    return rows.groupBy("term").agg(F.count("*").alias("n_test"), F.count_if(F.col("ok").isNull()).alias("n_stranded"))


#: Sources whose types are words, the word of each kind in them, and the term that other sources use.
WORD_SOURCES = ("KEGG", "SPIKE")
KIND_WORDS = {"activation": ("activation",), "inhibition": ("inhibition",), "enzymatic": ("dephosphorylation", "ubiquitination", "methylation", "glycosylation")}
PHOSPHORYLATION, PHOSPHORYLATION_TERM = "phosphorylation", "MI:0217"


def edge_kinds(interaction: Column, directed: Column, source: Column) -> Column:
    """The sorted kinds of an interaction (an array): undirected ones are physical; of directed ones those that the type's words
    tell in sources of words (none for a type without any, a regulation for an empty type of the source that has such);
    elsewhere phosphorylation by its term, or else enzymatic."""
    text = F.lower(F.coalesce(interaction, F.lit("")))
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
    words = [F.when(has(*found), F.lit(kind)) for kind, found in KIND_WORDS.items()]
    words.append(F.when(has(PHOSPHORYLATION) & ~has(f"de{PHOSPHORYLATION}"), F.lit(PHOSPHORYLATION)))
    by_term = F.when(F.contains(F.coalesce(interaction, F.lit("")), F.lit(PHOSPHORYLATION_TERM)), F.lit(PHOSPHORYLATION)).otherwise(F.lit("enzymatic"))
    kinds = (
        F.when(~directed, F.array(F.lit("physical")))
        .when((source == "SPIKE") & (text == ""), F.array(F.lit("spike_regulation")))
        .when(source.isin(*WORD_SOURCES), F.array_compact(F.array(*words)))
        .otherwise(F.array(by_term))
    )
    return F.sort_array(kinds)


def kinds_of_edges(evidence: DataFrame) -> DataFrame:
    """(src, dst, kinds): the sorted kinds of all evidence (src, dst, interaction, directed, source) of an edge; undirected
    evidence counts for both directions."""
    kinds = evidence.select("src", "dst", "directed", edge_kinds(F.col("interaction"), F.col("directed"), F.col("source")).alias("k"))
    back = kinds.filter("not directed").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "directed", "k")
    rows = kinds.unionByName(back).select("src", "dst", F.explode_outer("k").alias("kind"))
    return rows.groupBy("src", "dst").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))

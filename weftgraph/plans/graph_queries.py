"""Network construction, structure, paths and combinations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions.lineage import materialize
from weftgraph.operators import combine as C
from weftgraph.operators import graph as G
from weftgraph.plans.query import Query
from weftgraph.sources.tables import EDGES_SQL, Tables


def edges(t: Tables):
    return G.symmetrise(t.raw_edges())


def pairs(t: Tables):
    """The edges, each once."""
    return G.symmetric_pairs(t.raw_edges())


def _six(df, *columns):
    return df.select(*[c for c in df.columns if c not in columns], *[F.round(c, 6).alias(c) for c in columns])


def _parts(t: Tables, where: str):
    return t.part.filter(where).select(F.concat(F.lit("P"), "p_partkey").alias("node"))


def _suppliers(t: Tables, where: str):
    return t.supplier.filter(where).select(F.concat(F.lit("S"), "s_suppkey").alias("node"))


#: Line items of a task that brings them to their orders or counts them, on average.
TASK_LINES = 1 << 20


def _trade(t: Tables):
    """The whole network of nations that trade with customers: every order and line item, counted and written once.

    Tasks are as many as the line items ask for, and count by numbers, so that a task's memory does not grow with the tables."""
    n = max(t.spark.sparkContext.defaultParallelism, -(-t.lineitem.count() // TASK_LINES))
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey")
    s = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    pairs = o.repartition(n, "o_orderkey").join(s.repartition(n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    counts = pairs.select("c_custkey", "s_nationkey").repartition(n, "c_custkey").groupBy("c_custkey", "s_nationkey").agg(F.count("*").cast("double").alias("weight"))
    raw = materialize(counts.select(F.concat(F.lit("C"), "c_custkey").alias("src"), F.concat(F.lit("N"), "s_nationkey").alias("dst"), "weight"), "trade")
    return raw.union(raw.select("dst", "src", "weight"))


_TRADE_SQL = """traw AS (SELECT concat('C', c_custkey) AS src, concat('N', s_nationkey) AS dst, CAST(count(*) AS DOUBLE) AS weight
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
tedges AS (SELECT * FROM traw UNION ALL SELECT dst, src, weight FROM traw)"""


def _forest(t: Tables):
    """A network of many components: customers and all their orders."""
    one = t.orders.select(F.concat(F.lit("O"), "o_orderkey").alias("src"), F.concat(F.lit("C"), "o_custkey").alias("dst"), F.lit(1.0).alias("weight"))
    return one.union(one.select("dst", "src", "weight"))


def _order_labels(t: Tables):
    """(term, node, label): orders of a priority, positive if they are finished and negative if open."""
    label = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1)
    return t.orders.select(F.col("o_orderpriority").alias("term"), F.concat(F.lit("O"), "o_orderkey").alias("node"), label.alias("label")).filter("label is not null")


_FOREST_SQL = """fraw AS (SELECT concat('O', o_orderkey) AS src, concat('C', o_custkey) AS dst FROM orders),
fedges AS (SELECT * FROM fraw UNION ALL SELECT dst, src FROM fraw)"""
_COMPONENT_SQL = f"""WITH RECURSIVE {_FOREST_SQL},
reach AS (SELECT src AS node, src AS root FROM fedges UNION SELECT e.dst, r.root FROM reach r JOIN fedges e ON e.src = r.node WHERE r.root <= e.dst)"""


def _starts(t: Tables):
    return t.spark.createDataFrame([("N1",), ("N2",), ("N3",)], "node string")


def _hops(t: Tables):
    return G.distances(_trade(t).withColumn("cost", F.lit(1.0)), _starts(t))


def _paths(t: Tables):
    """Cheapest paths of the trade network, by the logarithm of weights."""
    e = _trade(t)
    cost = e.crossJoin(F.broadcast(e.agg(F.max("weight").alias("top")))).select("src", "dst", G.cost_ln(F.col("weight"), F.col("top")).alias("cost"))
    return G.distances(cost, _starts(t))


_HOPS_SQL = f"""WITH RECURSIVE {_TRADE_SQL},
walk AS (SELECT s AS source, s AS node, 0 AS hops FROM (SELECT unnest(['N1', 'N2', 'N3']) AS s)
  UNION SELECT source, dst, hops + 1 FROM walk JOIN tedges ON src = node WHERE hops < 8),
dist AS (SELECT source, node, min(hops) AS hops FROM walk GROUP BY 1, 2)"""
# An edge of no cost from each node to itself keeps what a round has found.
_PATHS_SQL = f"""{_HOPS_SQL}, cost AS (SELECT src, dst, -ln(weight / (greatest((SELECT max(weight) FROM tedges), 1) + 1)) AS cost FROM tedges
  UNION ALL SELECT n, n, 0.0 FROM (SELECT src AS n FROM tedges UNION SELECT unnest(['N1', 'N2', 'N3']))),
relaxed AS (SELECT 0 AS k, s AS source, s AS node, 0.0::DOUBLE AS dist FROM (SELECT unnest(['N1', 'N2', 'N3']) AS s)
  UNION ALL SELECT max(k) + 1, source, dst, min(dist + cost) FROM relaxed JOIN cost ON src = node WHERE k < 12 GROUP BY source, dst),
cheap AS (SELECT source, node, round(dist, 9) AS dist FROM relaxed WHERE k = 12)"""


def _channels(t: Tables):
    e = t.channel_edges().groupBy("channel", "src", "dst").agg(F.sum("weight").alias("weight"))
    return e.union(e.select("channel", "dst", "src", "weight"))


_CHANNELS_SQL = """cund AS (SELECT l_returnflag AS channel, concat('S', l_suppkey) AS src, concat('P', l_partkey) AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2, 3),
cedges AS (SELECT * FROM cund UNION ALL SELECT channel, dst, src, weight FROM cund),
cd AS (SELECT channel, src AS node, sum(weight) AS d FROM cedges GROUP BY 1, 2),
cnorm AS (SELECT e.channel, e.src, e.dst, weight / sqrt(a.d * b.d) AS weight FROM cedges e JOIN cd a ON a.channel = e.channel AND a.node = e.src JOIN cd b ON b.channel = e.channel AND b.node = e.dst)"""

_DEG_SQL = "d AS (SELECT src AS node, count(*) AS degree, sum(weight) AS strength FROM edges GROUP BY 1)"

def _interaction():
    """Types of interactions, for the events' numbers."""
    kinds = ("Phosphorylation", "dephosphorylation", "activation,phosphorylation", "", "MI:0217(phosphorylation reaction)", "inhibition; ubiquitination", "binding")
    return F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("event_id") % 7 + 1).cast("int"))


def _source():
    return F.element_at(F.array(*[F.lit(k) for k in ("KEGG", "SPIKE", "other", "more")]), (F.col("event_id") % 4 + 1).cast("int"))


QUERIES = [
    Query("s1_edge_list", edges, f"WITH {EDGES_SQL} SELECT src, dst, weight FROM edges"),
    Query(
        "g1_node_index",
        lambda t: G.index_nodes(G.nodes_of(edges(t))),
        f"WITH {EDGES_SQL}, n AS (SELECT DISTINCT src AS node FROM edges) SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM n",
    ),
    Query("a1_degrees", lambda t: G.degrees(edges(t)), f"WITH {EDGES_SQL}, {_DEG_SQL} SELECT node, degree, strength FROM d"),
    Query("p5_unweighted", lambda t: G.unweighted(edges(t)), f"WITH {EDGES_SQL} SELECT src, dst, 1.0::DOUBLE AS weight FROM edges WHERE weight > 0"),
    Query(
        "g3_row_normalise",
        lambda t: _six(G.row_normalise(edges(t), 0.5), "weight"),
        f"WITH {EDGES_SQL}, {_DEG_SQL} SELECT src, dst, round(weight / (strength + 0.5 * (SELECT max(weight) FROM edges)), 6) AS weight FROM edges JOIN d ON node = src",
    ),
    Query(
        "g4_symmetric_normalise",
        lambda t: _six(G.symmetric_normalise(edges(t)), "weight"),
        f"WITH {EDGES_SQL}, {_DEG_SQL} SELECT src, dst, round(weight / sqrt(a.strength * b.strength), 6) AS weight FROM edges JOIN d a ON a.node = src JOIN d b ON b.node = dst",
    ),
    Query(
        "g5_laplacian",
        lambda t: _six(G.laplacian(G.symmetric_normalise(edges(t))), "weight"),
        f"""WITH {EDGES_SQL}, {_DEG_SQL}, s AS (SELECT src, dst, weight / sqrt(a.strength * b.strength) AS w FROM edges JOIN d a ON a.node = src JOIN d b ON b.node = dst)
        SELECT src, dst, round(-w, 6) AS weight FROM s UNION ALL SELECT dst, dst, round(sum(w), 6) FROM s GROUP BY dst""",
    ),
    Query(
        "g6_remove_nodes",
        lambda t: G.without_nodes(edges(t), _parts(t, "p_size <= 25")),
        f"WITH {EDGES_SQL}, x AS (SELECT concat('P', p_partkey) AS node FROM part WHERE p_size <= 25) SELECT * FROM edges WHERE src NOT IN (SELECT node FROM x) AND dst NOT IN (SELECT node FROM x)",
    ),
    Query(
        "g7_induced_subgraph",
        lambda t: G.within_nodes(edges(t), _parts(t, "p_size <= 25").union(_suppliers(t, "s_nationkey < 8"))),
        f"""WITH {EDGES_SQL}, x AS (SELECT concat('P', p_partkey) AS node FROM part WHERE p_size <= 25 UNION ALL SELECT concat('S', s_suppkey) FROM supplier WHERE s_nationkey < 8)
        SELECT * FROM edges WHERE src IN (SELECT node FROM x) AND dst IN (SELECT node FROM x)""",
    ),
    Query(
        "j16_undirected_pairs",
        lambda t: G.undirected(G.within_nodes(edges(t), _parts(t, "p_size < 15").union(_suppliers(t, "s_nationkey < 15")))),
        f"""WITH {EDGES_SQL}, x AS (SELECT concat('P', p_partkey) AS node FROM part WHERE p_size < 15 UNION ALL SELECT concat('S', s_suppkey) FROM supplier WHERE s_nationkey < 15)
        SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, weight FROM edges WHERE src IN (SELECT node FROM x) AND dst IN (SELECT node FROM x)""",
    ),
    Query(
        "u6_add_networks",
        lambda t: G.add_networks(*[_channels(t).filter(F.col("channel") == c).select("src", "dst", "weight") for c in ("A", "N", "R")]),
        f"WITH {EDGES_SQL} SELECT src, dst, weight FROM edges",
    ),
    Query("g10_components", lambda t: G.connected_components(_forest(t)), f"{_COMPONENT_SQL} SELECT node, min(root) AS component FROM reach GROUP BY node"),
    Query(
        "g11_network_statistics",
        lambda t: (lambda e: G.network_statistics(e, G.connected_components(e), _order_labels(t).filter("label > 0")))(_forest(t)).select(
            "n_nodes", "n_components", "max_size", "p75", "p50", "p25", F.round("percent_largest", 6).alias("percent_largest"), "n_edges"
        ),
        f"""{_COMPONENT_SQL}, c AS (SELECT node, min(root) AS component FROM reach GROUP BY node), s AS (SELECT component, count(*) AS size FROM c GROUP BY 1)
        SELECT CAST(sum(size) AS BIGINT) AS n_nodes, count(*) AS n_components, max(size) AS max_size, quantile_cont(size, 0.75) AS p75, quantile_cont(size, 0.5) AS p50,
        quantile_cont(size, 0.25) AS p25, round(100.0 * max(size) / sum(size), 6) AS percent_largest, (SELECT count(*) FROM fraw) AS n_edges FROM s""",
    ),
    Query(
        "g12_stranded",
        lambda t: (lambda c, y: G.stranded(c, y.filter("label > 0"), y.filter("label < 0")))(G.connected_components(_forest(t)), _order_labels(t)),
        f"""{_COMPONENT_SQL}, c AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
        l AS (SELECT o_orderpriority AS term, concat('O', o_orderkey) AS node, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN -1 END AS label FROM orders),
        ok AS (SELECT DISTINCT term, component FROM l JOIN c USING (node) WHERE label > 0)
        SELECT l.term, count(*) AS n_test, count(*) FILTER (ok.term IS NULL) AS n_stranded FROM l JOIN c USING (node) LEFT JOIN ok ON ok.term = l.term AND ok.component = c.component WHERE label < 0 GROUP BY 1""",
    ),
    Query(
        "g20_seed_degrees",
        lambda t: G.degrees(edges(t)).join(_parts(t, "p_size <= 5"), "node", "left_semi"),
        f"WITH {EDGES_SQL}, {_DEG_SQL} SELECT node, degree, strength FROM d WHERE node IN (SELECT concat('P', p_partkey) FROM part WHERE p_size <= 5)",
    ),
    Query(
        "a14_component_sizes",
        lambda t: G.connected_components(_forest(t)).groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(20),
        f"{_COMPONENT_SQL}, c AS (SELECT node, min(root) AS component FROM reach GROUP BY node) SELECT component, count(*) AS size FROM c GROUP BY 1 ORDER BY size DESC, component LIMIT 20",
    ),
    Query(
        "g23_edge_kinds",
        lambda t: t.events.select("event_id", F.array_join(G.edge_kinds(_interaction(), F.col("event_id") % 5 > 0, _source()), "|").alias("kinds")),
        """WITH e AS (SELECT event_id, event_id % 5 > 0 AS directed, CASE event_id % 4 WHEN 0 THEN 'KEGG' WHEN 1 THEN 'SPIKE' WHEN 2 THEN 'other' ELSE 'more' END AS source,
          CASE event_id % 7 WHEN 0 THEN 'Phosphorylation' WHEN 1 THEN 'dephosphorylation' WHEN 2 THEN 'activation,phosphorylation' WHEN 3 THEN '' WHEN 4 THEN 'MI:0217(phosphorylation reaction)'
            WHEN 5 THEN 'inhibition; ubiquitination' ELSE 'binding' END AS i FROM events),
        k AS (SELECT event_id, unnest(CASE WHEN NOT directed THEN ['physical'] WHEN source = 'SPIKE' AND i = '' THEN ['spike_regulation']
          WHEN source IN ('KEGG', 'SPIKE') THEN [CASE WHEN i LIKE '%activation%' THEN 'activation' END, CASE WHEN i LIKE '%inhibition%' THEN 'inhibition' END,
            CASE WHEN i LIKE '%dephosphorylation%' OR i LIKE '%ubiquitination%' THEN 'enzymatic' END,
            CASE WHEN lower(i) LIKE '%phosphorylation%' AND i NOT LIKE '%dephosphorylation%' THEN 'phosphorylation' END]
          WHEN i LIKE '%MI:0217%' THEN ['phosphorylation'] ELSE ['enzymatic'] END) AS kind FROM e)
        SELECT e.event_id, coalesce(string_agg(kind, '|' ORDER BY kind), '') AS kinds FROM e LEFT JOIN k ON k.event_id = e.event_id GROUP BY 1""",
    ),
    Query(
        "g13_weighted_paths",
        lambda t: _six(_paths(t), "dist").select("source", "node", "dist"),
        f"{_PATHS_SQL} SELECT source, node, round(dist, 6) AS dist FROM cheap",
    ),
    Query(
        "g16_closest_by_cost",
        lambda t: G.closest_sources(_paths(t).withColumn("dist", F.round("dist", 9))).select("node", "source").join(_hops(t).select("source", "node", "hops"), ["source", "node"]),
        f"{_PATHS_SQL}, best AS (SELECT node, source FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY dist, source) AS r FROM cheap) WHERE r = 1) SELECT source, node, hops FROM best JOIN dist USING (source, node)",
    ),
    Query(
        "g16_near_sources",
        lambda t: G.near_sources(_hops(t)),
        f"{_HOPS_SQL}, n AS (SELECT node, greatest(min(hops), 2) AS within FROM dist GROUP BY 1) SELECT node, source, within FROM dist JOIN n USING (node) WHERE hops <= within",
    ),
    Query(
        "g17_nodes_of_paths",
        lambda t: G.path_nodes(_hops(t)),
        f"""{_HOPS_SQL}, near AS (SELECT node AS target, source FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hops, source) AS r FROM dist) WHERE r = 1),
        par AS (SELECT d.source, d.node, min(e.src) AS parent FROM dist d JOIN tedges e ON e.dst = d.node JOIN dist q ON q.source = d.source AND q.node = e.src AND q.hops = d.hops - 1 GROUP BY 1, 2),
        up AS (SELECT target, source, target AS node, 0 AS step FROM near UNION ALL SELECT u.target, u.source, p.parent, u.step + 1 FROM up u JOIN par p ON p.source = u.source AND p.node = u.node)
        SELECT target, source, node, step FROM up""",
    ),
    Query("g13_hops", lambda t: _hops(t).select("source", "node", "hops"), f"{_HOPS_SQL} SELECT source, node, hops FROM dist"),
    Query(
        "g14_costs",
        lambda t: (lambda e: e.crossJoin(F.broadcast(e.agg(F.max("weight").alias("top")))).select(
            "src", "dst", F.round(G.cost_ln(F.col("weight"), F.col("top")), 6).alias("cost_a"), F.round(G.cost_log10(F.col("weight"), F.col("top")), 6).alias("cost_b")
        ))(edges(t)),
        f"""WITH {EDGES_SQL}, m AS (SELECT max(weight) AS top FROM edges) SELECT src, dst, round(-ln(weight / (greatest(top, 1) + 1)), 6) AS cost_a,
        round(-log10(weight / top * 0.7), 6) AS cost_b FROM edges, m""",
    ),
    Query(
        "g16_closest_source",
        lambda t: G.closest_sources(_hops(t)).select("node", "source", "hops"),
        f"{_HOPS_SQL} SELECT node, arg_min(source, hops * 100 + CAST(substring(source, 2) AS INT)) AS source, min(hops) AS hops FROM dist GROUP BY node",
    ),
    Query(
        "g17_path_nodes",
        lambda t: G.path_nodes(_hops(t)).groupBy("target").agg(F.count("*").alias("n")),
        f"{_HOPS_SQL} SELECT node AS target, CAST(min(hops) + 1 AS BIGINT) AS n FROM dist GROUP BY node",
    ),
    Query(
        "g21_without_class_pairs",
        lambda t: G.without_pairs(edges(t), _suppliers(t, "s_nationkey < 10"), _parts(t, "p_size <= 25")),
        f"""WITH {EDGES_SQL}, a AS (SELECT concat('S', s_suppkey) AS node FROM supplier WHERE s_nationkey < 10), b AS (SELECT concat('P', p_partkey) AS node FROM part WHERE p_size <= 25)
        SELECT * FROM edges WHERE NOT ((src IN (SELECT node FROM a) AND dst IN (SELECT node FROM b)) OR (src IN (SELECT node FROM b) AND dst IN (SELECT node FROM a)))""",
    ),
    Query(
        "g22_neighbour_shares",
        lambda t: _six(G.neighbour_shares(edges(t), _parts(t, "p_size <= 25")), "share"),
        f"""WITH {EDGES_SQL}, b AS (SELECT concat('P', p_partkey) AS node FROM part WHERE p_size <= 25)
        SELECT src AS node, sum(CASE WHEN dst IN (SELECT node FROM b) THEN 1 ELSE 0 END)::BIGINT AS n_pos, round(sum(CASE WHEN dst IN (SELECT node FROM b) THEN 1 ELSE 0 END) / count(*), 6) AS share FROM edges GROUP BY src""",
    ),
    Query("w5_normalised_channels", lambda t: _six(G.symmetric_normalise(_channels(t), "channel"), "weight"), f"WITH {_CHANNELS_SQL} SELECT channel, src, dst, round(weight, 6) AS weight FROM cnorm"),
    Query(
        "w4_combined_channels",
        lambda t: _six(C.combine(G.symmetric_normalise(_channels(t), "channel"), t.spark.createDataFrame([("A", 0.5), ("N", 0.3), ("R", 0.2)], "channel string, alpha double")), "weight"),
        f"""WITH {_CHANNELS_SQL} SELECT src, dst, round(sum(weight * CASE channel WHEN 'A' THEN 0.5 WHEN 'N' THEN 0.3 ELSE 0.2 END), 6) AS weight FROM cnorm GROUP BY 1, 2""",
    ),
    Query("w2_term_weights", lambda t: _six(C.term_weights(G.symmetric_normalise(_channels(t), "channel"), t.labels()), "alpha")),
    Query("w3_shared_weights", lambda t: _six(C.shared_weights(G.symmetric_normalise(_channels(t), "channel"), t.labels()), "alpha")),
]

"""Further selections, joins, aggregates, reshaping and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import evaluate as E
from weftgraph.operators import graph as G
from weftgraph.operators import propagate as X
from weftgraph.operators import stats as S
from weftgraph.operators import tables as T
from weftgraph.plans.graph_queries import _channels, _parts, _six, _suppliers, _trade, edges
from weftgraph.plans.query import Query
from weftgraph.plans.score_queries import _BASE, _CURVE_SQL, _P_SQL, _points, _propagation_sql, _seeds
from weftgraph.plans.table_queries import _RANKS_SQL, _WIDE_SQL, _ranks, _wide
from weftgraph.sources.tables import EDGES_SQL, LABELS_SQL, SCORES_SQL, Tables

_TERMS = ("PROMO", "SMALL")
_BRAND_SQL = "brand AS (SELECT concat('P', p_partkey) AS node, p_brand AS grp FROM part)"


def _brands(t: Tables):
    """(node, grp): a group for every part."""
    return t.part.select(F.concat(F.lit("P"), "p_partkey").alias("node"), F.col("p_brand").alias("grp"))


def _lists(label: int):
    return F.array_join(F.sort_array(F.collect_list(F.when(F.col("label") == label, F.col("node")))), ",")


def _directed(t: Tables):
    """A directed network with some reciprocal pairs: customers' nations to suppliers' nations by status."""
    return t.supplier.select(F.concat(F.lit("N"), "s_nationkey").alias("src"), F.concat(F.lit("N"), (F.col("s_suppkey") * 7) % 25).alias("dst"), F.lit(1.0).alias("weight"))


_DIRECTED_SQL = "dir AS (SELECT concat('N', s_nationkey) AS src, concat('N', s_suppkey * 7 % 25) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM supplier GROUP BY 1, 2)"


def _styled(t: Tables):
    """The pairs of an induced subgraph with a line width from 1 to 10."""
    sub = G.undirected(G.within_nodes(edges(t), _parts(t, "p_size < 15").union(_suppliers(t, "s_nationkey < 15"))))
    ends = sub.agg(F.min("weight").alias("low"), F.max("weight").alias("high"))
    return sub.crossJoin(F.broadcast(ends)).select("src", "dst", "weight", F.round(T.scaled(F.col("weight"), F.col("low"), F.col("high"), 1.0, 10.0), 6).alias("width"))


QUERIES = [
    Query(
        "s9_label_lists",
        lambda t: t.labels().filter(F.col("term").isin(*_TERMS)).groupBy("term").agg(_lists(1).alias("positives"), _lists(-1).alias("negatives")),
        f"""WITH {LABELS_SQL} SELECT term, coalesce(string_agg(node, ',' ORDER BY node) FILTER (label = 1), '') AS positives, coalesce(string_agg(node, ',' ORDER BY node) FILTER (label = -1), '') AS negatives
        FROM terms WHERE term IN {_TERMS} GROUP BY 1""",
    ),
    Query(
        "s11_id_map_list",
        lambda t: t.customer.select(F.col("c_custkey").alias("canonical"), F.upper("c_mktsegment").alias("namespace"), F.col("c_name").alias("alternate")).filter(F.lower("namespace").isin("building", "machinery")),
        "SELECT c_custkey AS canonical, upper(c_mktsegment) AS namespace, c_name AS alternate FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')",
    ),
    Query(
        "s18_results_over_settings",
        lambda t: t.scores().union(t.scores().filter("alg = 'size'")).dropDuplicates(["alg", "node"]).groupBy("alg").agg(F.count("*").alias("n")),
        f"WITH {SCORES_SQL} SELECT alg, count(*) AS n FROM (SELECT DISTINCT alg, node FROM scores) GROUP BY 1",
    ),
    Query("k2_network_lines", lambda t: G.undirected(edges(t)).select(F.concat_ws("\t", "src", "dst", F.col("weight").cast("long").cast("string")).alias("line")),
        f"WITH {EDGES_SQL} SELECT DISTINCT concat(least(src, dst), chr(9), greatest(src, dst), chr(9), CAST(weight AS BIGINT)) AS line FROM edges"),
    Query("p2_columns", lambda t: T.columns_at(t.nation, 1, 2), "SELECT n_name, n_regionkey FROM nation"),
    Query("p4_combined_cutoffs", lambda t: _wide(t).filter("combined >= 50").select("src", "dst", (F.col("combined") > 50).alias("above")),
        f"WITH {_WIDE_SQL} SELECT src, dst, combined > 50 AS above FROM wide WHERE combined >= 50"),
    Query("p6_constant_weight", lambda t: T.constant_weight(t.raw_edges()),
        "SELECT DISTINCT concat('S', l_suppkey) AS src, concat('P', l_partkey) AS dst, 1 AS weight FROM lineitem"),
    Query("p7_chosen_terms", lambda t: t.labels().join(F.broadcast(t.spark.createDataFrame([(x,) for x in _TERMS], "term string")), "term", "left_semi"),
        f"WITH {LABELS_SQL} SELECT term, node, label FROM terms WHERE term IN {_TERMS}"),
    Query("p8_chosen_nodes", lambda t: t.labels().join(_parts(t, "p_retailprice > 910"), "node", "left_semi"),
        f"WITH {LABELS_SQL} SELECT term, node, label FROM terms WHERE node IN (SELECT concat('P', p_partkey) FROM part WHERE p_retailprice > 910)"),
    Query("p9_target_scores", lambda t: t.scores().join(_parts(t, "p_size > 40"), "node", "left_semi"),
        f"WITH {SCORES_SQL} SELECT alg, node, score FROM scores WHERE node IN (SELECT concat('P', p_partkey) FROM part WHERE p_size > 40)"),
    Query(
        "p10_significant_scores",
        lambda t: T.ranked(t.scores().join(t.part.filter("p_partkey % 4 <> 0").select(F.concat(F.lit("P"), "p_partkey").alias("node"), (F.col("p_size") / 50).alias("pval")), "node", "left").filter("pval < 0.2"), ["alg"]).select("alg", "node", "rank"),
        f"""WITH {SCORES_SQL} SELECT alg, node, row_number() OVER (PARTITION BY alg ORDER BY score DESC, node) AS rank FROM scores JOIN part ON node = concat('P', p_partkey)
        WHERE p_partkey % 4 <> 0 AND p_size / 50 < 0.2""",
    ),
    Query("p11_category", lambda t: t.events.filter("event_type = 'click' and user_id % 2 = 0").select("event_id"), "SELECT event_id FROM events WHERE event_type = 'click' AND user_id % 2 = 0"),
    Query(
        "p12_approved",
        lambda t: t.part.filter(F.contains("p_name", F.lit("a")) & F.col("p_retailprice").isNotNull() & (F.col("p_type") == "SMALL")).select("p_partkey"),
        "SELECT p_partkey FROM part WHERE contains(p_name, 'a') AND p_retailprice IS NOT NULL AND p_type = 'SMALL'",
    ),
    Query("p13_false_discovery", lambda t: t.part.filter(F.col("p_size") / 1000 <= 0.01).select(F.element_at(F.split("p_brand", "#"), -1).alias("brand"), "p_partkey"),
        "SELECT split_part(p_brand, '#', 2) AS brand, p_partkey FROM part WHERE p_size / 1000 <= 0.01"),
    Query("p15_all_null", lambda t: T.outer_ranks(_ranks(t).filter("rank <= 200"), ["price", "third"]).dropna(how="all", subset=["price", "third"]),
        f"""WITH {_RANKS_SQL} SELECT node, max(CASE WHEN alg = 'price' THEN rank END) AS price, max(CASE WHEN alg = 'third' THEN rank END) AS third FROM ranks
        WHERE rank <= 200 GROUP BY node HAVING count(*) FILTER (alg <> 'size') > 0"""),
    Query("p18_terms_of_two_lists", lambda t: t.labels().join(F.broadcast(t.spark.createDataFrame([("PROMO",)], "term string").union(t.spark.createDataFrame([("SMALL",), ("PROMO",)], "term string")).distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")),
        f"WITH {LABELS_SQL} SELECT term, count(*) AS n FROM terms WHERE term IN {_TERMS} GROUP BY 1"),
    Query("p19_positives_of_term", lambda t: T.labels_of(t.labels(), "PROMO", 1), f"WITH {LABELS_SQL} SELECT node FROM terms WHERE term = 'PROMO' AND label > 0"),
    Query(
        "p20_large_terms",
        lambda t: T.large_enough(t.part.select(F.col("p_brand").alias("term"), F.concat(F.lit("P"), "p_partkey").alias("node"), F.when(F.col("p_size") <= 25, 1).otherwise(-1).alias("label"))).groupBy("term").agg(F.count("*").alias("n")),
        "SELECT p_brand AS term, count(*) AS n FROM part GROUP BY 1 HAVING count(*) FILTER (p_size <= 25) > 1 AND count(*) FILTER (p_size > 25) > 1",
    ),
    Query("j5_without_positives", lambda t: T.without_positives(t.scores(), _parts(t, "p_size <= 25")), f"WITH {SCORES_SQL} SELECT alg, node, score FROM scores WHERE node NOT IN (SELECT concat('P', p_partkey) FROM part WHERE p_size <= 25)"),
    Query("j6_within_universe", lambda t: _parts(t, "p_size <= 25").join(G.nodes_of(t.raw_edges()), "node", "left_semi"),
        "SELECT concat('P', p_partkey) AS node FROM part WHERE p_size <= 25 AND p_partkey IN (SELECT l_partkey FROM lineitem)"),
    Query(
        "j8_aligned_labels",
        lambda t: T.aligned_labels(G.nodes_of(t.raw_edges()), t.labels()),
        f"WITH {LABELS_SQL}, n AS (SELECT concat('S', l_suppkey) AS node FROM lineitem UNION SELECT concat('P', l_partkey) FROM lineitem) SELECT n.node, term, coalesce(label, 0) AS label FROM n LEFT JOIN terms ON n.node = terms.node",
    ),
    Query(
        "j9_outer_columns",
        lambda t: T.outer_ranks(_ranks(t).filter("rank <= 100"), ["price", "size", "third"]),
        f"""WITH {_RANKS_SQL} SELECT node, max(CASE WHEN alg = 'price' THEN rank END) AS price, max(CASE WHEN alg = 'size' THEN rank END) AS size, max(CASE WHEN alg = 'third' THEN rank END) AS third
        FROM ranks WHERE rank <= 100 GROUP BY node""",
    ),
    Query("j12_groups_of_nodes", lambda t: T.groups_of_nodes(_brands(t), t.labels()),
        f"WITH {LABELS_SQL}, {_BRAND_SQL} SELECT grp, count(*) AS n, min(node) AS first FROM brand WHERE node IN (SELECT node FROM terms) GROUP BY 1"),
    Query(
        "j13_pairs_of_algorithms",
        lambda t: T.pairs_of(t.scores()),
        f"WITH {SCORES_SQL} SELECT a.node, a.alg AS one, b.alg AS two, a.score AS x, b.score AS y FROM scores a JOIN scores b ON a.node = b.node AND a.alg < b.alg",
    ),
    Query(
        "j15_attached_evidence",
        lambda t: T.attach_evidence(t.lineitem.select(F.concat(F.lit("P"), "l_partkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"), "l_orderkey", "l_linenumber"), G.within_nodes(edges(t), _parts(t, "p_size < 15").union(_suppliers(t, "s_nationkey < 15")))),
        """SELECT concat('P', l_partkey) AS src, concat('S', l_suppkey) AS dst, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        WHERE p_size < 15 AND s_nationkey < 15""",
    ),
    Query("j17_product", lambda t: _six(X.spread(G.row_normalise(edges(t)), t.scores(), ["alg"]), "score"),
        f"WITH {EDGES_SQL}, {_P_SQL}, {SCORES_SQL} SELECT alg, src AS node, round(sum(weight * score), 6) AS score FROM p JOIN scores ON node = dst GROUP BY 1, 2"),
    Query(
        "j18_submatrices",
        lambda t: T.submatrix(edges(t), _parts(t, "p_size <= 25").withColumn("label", F.lit(1)).union(_suppliers(t, "s_nationkey < 10").withColumn("label", F.lit(-1)))),
        f"""WITH {EDGES_SQL}, y AS (SELECT concat('P', p_partkey) AS node, 1 AS label FROM part WHERE p_size <= 25 UNION ALL SELECT concat('S', s_suppkey), -1 FROM supplier WHERE s_nationkey < 10)
        SELECT src, dst, weight, a.label AS a, b.label AS b FROM edges JOIN y a ON a.node = src JOIN y b ON b.node = dst""",
    ),
    Query(
        "j19_reach_of_members",
        lambda t: T.reach_of_members(t.supplier.select(F.concat(F.lit("N"), "s_nationkey").alias("outer"), F.concat(F.lit("S"), "s_suppkey").alias("src")), t.raw_edges(), t.labels().filter("label > 0")),
        f"""WITH {LABELS_SQL}, e AS (SELECT DISTINCT l_suppkey, concat('P', l_partkey) AS node FROM lineitem) SELECT concat('N', s_nationkey) AS outer, term, count(*) AS n
        FROM supplier JOIN e ON s_suppkey = l_suppkey JOIN terms USING (node) WHERE label > 0 GROUP BY 1, 2""",
    ),
    Query(
        "a4_joined_columns",
        lambda t: t.part.groupBy("p_brand").agg(F.expr("listagg(p_type, '|') WITHIN GROUP (ORDER BY p_partkey)").alias("types"), F.expr("listagg(p_name, ',') WITHIN GROUP (ORDER BY p_partkey)").alias("names")),
        "SELECT p_brand, string_agg(p_type, '|' ORDER BY p_partkey) AS types, string_agg(p_name, ',' ORDER BY p_partkey) AS names FROM part GROUP BY 1",
    ),
    Query("a7_positives_of_groups", lambda t: T.count_by(t.labels().filter("label > 0").join(_brands(t), "node"), "grp"),
        f"WITH {LABELS_SQL}, {_BRAND_SQL} SELECT grp, count(*) AS n FROM terms JOIN brand USING (node) WHERE label > 0 GROUP BY 1"),
    Query("a8_positives_of_terms", lambda t: T.count_by(t.labels().filter("label > 0"), "term"), f"WITH {LABELS_SQL} SELECT term, count(*) AS n FROM terms WHERE label > 0 GROUP BY 1"),
    Query("a10_median_of_algorithms", lambda t: t.scores().groupBy("alg").agg(F.round(F.median("score"), 6).alias("median")), f"WITH {SCORES_SQL} SELECT alg, round(median(score), 6) AS median FROM scores GROUP BY 1"),
    Query("a15_weight_range", lambda t: edges(t).agg(F.min("weight").alias("low"), F.max("weight").alias("high")), f"WITH {EDGES_SQL} SELECT min(weight) AS low, max(weight) AS high FROM edges"),
    Query("a20_summed_times", lambda t: T.sum_by(t.events.withColumn("run", F.concat_ws("-", "event_type", F.col("user_id") % 3)), ["run"], "value", "seconds").withColumn("seconds", F.round("seconds", 4)),
        "SELECT concat(event_type, '-', user_id % 3) AS run, round(sum(value), 4) AS seconds FROM events GROUP BY 1"),
    Query("a21_values_of_members", lambda t: T.explode_cell(t.part.select("p_type", "p_retailprice", F.col("p_name").alias("member")), "member", " ").transform(T.mean_by, ["p_type", "member"], "p_retailprice", "value").withColumn("value", F.round("value", 6)),
        "SELECT p_type, member, round(avg(p_retailprice), 6) AS value FROM (SELECT p_type, p_retailprice, unnest(string_split(p_name, ' ')) AS member FROM part) GROUP BY 1, 2"),
    Query("r1_ranks_in_order", lambda t: _ranks(t).filter("rank <= 100"), f"WITH {_RANKS_SQL} SELECT alg, node, score, rank FROM ranks WHERE rank <= 100"),
    Query(
        "r6_running_counts",
        lambda t: _points(t).select("alg", "node", "idx", "tp", "fp"),
        f"WITH {_CURVE_SQL} SELECT alg, node, idx, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM curve",
    ),
    Query("r8_least_column", lambda t: _ranks(t).filter("alg <> 'third'").groupBy("node").agg(F.min_by("alg", F.struct("rank", "alg")).alias("alg")),
        f"WITH {_RANKS_SQL} SELECT node, alg FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY rank, alg) AS k FROM ranks WHERE alg <> 'third') WHERE k = 1"),
    Query("r10_grid_layout", lambda t: T.grid_layout(_brands(t))),
    Query("r11_terms_by_positives", lambda t: T.places_by(T.count_by(t.labels().filter("label > 0"), "term"), "n", "term"),
        f"WITH {LABELS_SQL} SELECT term, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, term) AS place FROM terms WHERE label > 0 GROUP BY 1"),
    Query(
        "r12_fixed_ranks",
        lambda t: T.fix_ranks(t.scores(), ["alg"], 0.5).select("alg", "node", "fixed"),
        f"""WITH {SCORES_SQL} SELECT alg, node, coalesce(lag(score) OVER o + 0.5 < score, true) AND coalesce(score + 0.5 < lead(score) OVER o, true) AND score > 0 AS fixed
        FROM scores WINDOW o AS (PARTITION BY alg ORDER BY score, node)""",
    ),
    Query("u1_universe", lambda t: _parts(t, "p_size <= 25").union(G.nodes_of(t.raw_edges())).distinct(),
        "SELECT concat('P', p_partkey) AS node FROM part WHERE p_size <= 25 UNION SELECT concat('S', l_suppkey) FROM lineitem UNION SELECT concat('P', l_partkey) FROM lineitem"),
    Query(
        "m2_melted_measures",
        lambda t: _six(E.measures(_points(t), ["alg"]).unpivot(["alg"], ["fmax", "avgp"], "measure", "value"), "value"),
        f"""WITH {_CURVE_SQL}, m AS (SELECT alg, max(CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END) AS fmax, sum(CASE WHEN label > 0 THEN prec ELSE 0 END) / max(n_pos) AS avgp FROM curve GROUP BY 1)
        SELECT alg, 'fmax' AS measure, round(fmax, 6) AS value FROM m UNION ALL SELECT alg, 'avgp', round(avgp, 6) FROM m""",
    ),
    Query("m3_pivoted_scores", lambda t: T.pivoted(t.scores(), ["price", "size"]),
        f"WITH {SCORES_SQL} SELECT node, max(CASE WHEN alg = 'price' THEN score END) AS price, max(CASE WHEN alg = 'size' THEN score END) AS size FROM scores GROUP BY 1"),
    Query("m4_exploded_cells", lambda t: T.explode_cell(t.events.select("event_id", F.concat_ws("; ", "event_type", "user_id").alias("cell")), "cell", "; "),
        "SELECT event_id, unnest([event_type, CAST(user_id AS VARCHAR)]) AS cell FROM events"),
    Query("m6_transposed", lambda t: t.raw_edges().groupBy(F.col("dst").alias("src"), F.col("src").alias("dst")).agg(F.sum("weight").alias("weight")),
        "SELECT concat('P', l_partkey) AS src, concat('S', l_suppkey) AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2"),
    Query("g2_symmetrised", lambda t: G.symmetrise(G.sum_edges(_directed(t))),
        f"WITH {_DIRECTED_SQL} SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM dir UNION ALL SELECT dst, src, weight FROM dir) GROUP BY 1, 2"),
    Query(
        "g8_places_after_deletion",
        lambda t: (lambda old: G.index_nodes(old.join(_parts(t, "p_size <= 25"), "node", "left_anti").select("node")).withColumnRenamed("idx", "new_idx").join(old, "node"))(G.index_nodes(G.nodes_of(t.raw_edges()))),
        """WITH n AS (SELECT concat('S', l_suppkey) AS node FROM lineitem UNION SELECT concat('P', l_partkey) FROM lineitem), o AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM n)
        SELECT node, row_number() OVER (ORDER BY node) - 1 AS new_idx, idx FROM o WHERE node NOT IN (SELECT concat('P', p_partkey) FROM part WHERE p_size <= 25)""",
    ),
    Query("g9_fixed_scores", lambda t: _six(X.fixed_scores(edges(t), t.labels(), 0.95), "score"),
        f"WITH {_BASE}, {_propagation_sql(0.95, 1)} SELECT term, node, round(score, 6) AS score FROM f"),
    Query("g18_styled_subgraph", _styled,
        f"""WITH {EDGES_SQL}, x AS (SELECT concat('P', p_partkey) AS node FROM part WHERE p_size < 15 UNION ALL SELECT concat('S', s_suppkey) FROM supplier WHERE s_nationkey < 15),
        s AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, weight FROM edges WHERE src IN (SELECT node FROM x) AND dst IN (SELECT node FROM x))
        SELECT src, dst, weight, round(9 * (weight - min(weight) OVER ()) / (max(weight) OVER () - min(weight) OVER ()) + 1, 6) AS width FROM s"""),
    Query("g19_neighbours", lambda t: edges(t).filter("src = 'S1'").select(F.col("dst").alias("node")), f"WITH {EDGES_SQL} SELECT dst AS node FROM edges WHERE src = 'S1'"),
    Query("w1_added_channels", lambda t: G.add_networks(_channels(t).select("src", "dst", "weight")), f"WITH {EDGES_SQL} SELECT src, dst, weight FROM edges"),
    Query("x14_expected_steps", lambda t: _six(X.expected_steps(_trade(t), _seeds(t), [1.0, 2.0, 4.0]), "expected", "variance")),
    Query(
        "e9_degenerate_terms",
        lambda t: E.measures(E.curve(t.scores().filter("alg = 'price'").select(F.lit("PROMO").alias("term"), "node", "score").union(t.scores().filter("alg = 'size'").select(F.lit("none").alias("term"), "node", "score")), t.labels().filter("term = 'PROMO'"), ["term"]), ["term"]).select("term", "n_pos"),
        f"WITH {LABELS_SQL} SELECT term, count(*) FILTER (label > 0) AS n_pos FROM terms WHERE term = 'PROMO' GROUP BY 1",
    ),
    Query(
        "e14_held_out_file",
        lambda t: _six(E.measures(E.curve(t.scores().filter("alg = 'price'"), t.part.filter("p_partkey % 3 = 0").select(F.lit("price").alias("alg"), F.concat(F.lit("P"), "p_partkey").alias("node"), F.when(F.col("p_size") > 25, 1).otherwise(-1).alias("label")), ["alg"]), ["alg"]).select("alg", "avgp"), "avgp"),
        """WITH r AS (SELECT *, p_size > 25 AS pos FROM part WHERE p_partkey % 3 = 0), c AS (SELECT pos, sum(CASE WHEN pos THEN 1 ELSE 0 END) OVER o / row_number() OVER o AS prec FROM r
        WINDOW o AS (ORDER BY p_retailprice DESC, concat('P', p_partkey) ROWS UNBOUNDED PRECEDING)) SELECT 'price' AS alg, round(avg(prec) FILTER (pos), 6) AS avgp FROM c""",
    ),
    Query("e15_over_random", lambda t: E.measures(_points(t), ["alg"]).select("alg", F.round(E.over_random(F.col("avgp"), 5.0), 6).alias("ratio")),
        f"WITH {_CURVE_SQL} SELECT alg, round(6 * sum(CASE WHEN label > 0 THEN prec ELSE 0 END) / max(n_pos), 6) AS ratio FROM curve GROUP BY 1"),
    Query(
        "t14_set_enrichment",
        lambda t: _six(S.enrichment(t.part.filter("p_size > 40").select(F.col("p_partkey").alias("node")), t.part.select(F.col("p_type").alias("name"), F.col("p_partkey").alias("node")), t.part.select(F.col("p_partkey").alias("node"))), "pval", "padj").select("name", "k", "n"),
        "SELECT p_type AS name, count(*) FILTER (p_size > 40) AS k, count(*) AS n FROM part GROUP BY 1 HAVING count(*) FILTER (p_size > 40) > 0",
    ),
]

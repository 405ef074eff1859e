"""Scans, filters, mappings, ranks, set operations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import tables as T
from weftgraph.operators.graph import last_edges
from weftgraph.plans.query import Query
from weftgraph.sources.tables import SCORES_SQL, Tables

_CHANNELS = ("A", "N", "R")


def _wide(t: Tables):
    """A multi-channel file: a weight for each channel and a combined score."""
    e = t.channel_edges()
    return e.groupBy("src", "dst").agg(*[F.sum(F.when(F.col("channel") == c, F.col("weight")).otherwise(0.0)).alias(c) for c in _CHANNELS], F.sum("weight").alias("combined"))


_WIDE_SQL = """wide AS (SELECT concat('S', l_suppkey) AS src, concat('P', l_partkey) AS dst,
  sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS A, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS N,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS R, sum(l_quantity) AS combined FROM lineitem GROUP BY 1, 2)"""


def _names(t: Tables):
    """(from_id, to_id): a part's name to its ids, many to many."""
    return t.part.select(F.concat(F.lit("P"), "p_partkey").alias("from_id"), F.concat_ws("/", "p_brand", "p_type").alias("to_id"))


def _reviewed(t: Tables):
    return t.part.select(F.concat(F.lit("P"), "p_partkey").alias("id")).filter(F.expr("cast(substring(id, 2) as int) % 4 = 0"))


def _name_map(t: Tables):
    return t.part.select(F.col("p_name").alias("from_id"), F.concat(F.lit("P"), "p_partkey").alias("to_id"))


_PREFER_SQL = """m AS (SELECT p_name AS from_id, concat('P', p_partkey) AS to_id, p_partkey % 4 = 0 AS rev FROM part),
any_rev AS (SELECT from_id, max(CASE WHEN rev THEN 1 ELSE 0 END) AS a FROM m GROUP BY from_id),
best AS (SELECT m.from_id, m.to_id FROM m JOIN any_rev USING (from_id) WHERE rev OR a = 0)"""


def _ranks(t: Tables):
    return T.ranked(t.scores(), ["alg"])


_RANKS_SQL = f"""{SCORES_SQL},
ranks AS (SELECT alg, node, score, row_number() OVER (PARTITION BY alg ORDER BY score DESC, node) AS rank FROM scores)"""


def _part_names(t: Tables):
    return t.part.select(F.concat(F.lit("P"), "p_partkey").alias("node"), "p_name", "p_brand", "p_type", "p_size")


def _overall(t: Tables):
    rows = t.part.select("p_type", F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("score"))
    return T.ranked(rows, []).withColumnRenamed("rank", "overall")


def _publication():
    """Ids of publications of all kinds, for the documents' numbers."""
    kinds = ("pubmed", "doi", "omim", "imex", "phosphosite", "netpath", "kegg", "mint", "unknown")
    return F.concat(F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % 9 + 1).cast("int")), F.lit(":10-"), F.col("doc_id"))


QUERIES = [
    Query(
        "s2_multi_file_edges",
        lambda t: last_edges(t.channel_edges(), "seq", "channel"),
        """SELECT l_returnflag AS channel, least(concat('S', l_suppkey), concat('P', l_partkey)) AS src, greatest(concat('S', l_suppkey), concat('P', l_partkey)) AS dst,
        arg_max(l_quantity, (l_orderkey * 10 + l_linenumber) * 100 + l_quantity) AS weight FROM lineitem GROUP BY 1, 2, 3""",
    ),
    Query(
        "s3_channel_scan",
        lambda t: _wide(t).filter("combined >= 30").unpivot(["src", "dst"], list(_CHANNELS), "channel", "weight").filter("weight > 0"),
        f"WITH {_WIDE_SQL} SELECT src, dst, channel, weight FROM (SELECT src, dst, unnest(['A', 'N', 'R']) AS channel, unnest([A, N, R]) AS weight FROM wide WHERE combined >= 30) WHERE weight > 0",
    ),
    Query(
        "s5_split_by_group",
        lambda t: t.lineitem.join(F.broadcast(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")), "l_suppkey")
        .filter("l_quantity >= 20")
        .groupBy("s_nationkey")
        .agg(F.count("*").alias("n_edges"), F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_suppkey").alias("n_suppliers"), F.max("l_quantity").alias("top")),
        """SELECT s_nationkey, count(*) AS n_edges, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers, max(l_quantity) AS top
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 20 GROUP BY 1""",
    ),
    Query(
        "s6_split_by_prefix",
        lambda t: T.count_by(t.pages.select(T.prefix_of(F.split_part("url", F.lit("/"), F.lit(3))).alias("taxon")), "taxon"),
        "SELECT split_part(split_part(url, '/', 3), '.', 1) AS taxon, count(*) AS n FROM pages GROUP BY 1",
    ),
    Query(
        "s7_label_table",
        lambda t: t.table("labels").unpivot(["doc_id"], ["quality", "toxic"], "term", "label").filter("label <> 0"),
        "SELECT doc_id, 'quality' AS term, quality AS label FROM labels WHERE quality <> 0 UNION ALL SELECT doc_id, 'toxic', toxic FROM labels WHERE toxic <> 0",
    ),
    Query(
        "s8_label_list",
        lambda t: t.part.groupBy(F.col("p_type").alias("term"), F.when(F.col("p_size") <= 25, 1).otherwise(-1).alias("label"))
        .agg(F.array_join(F.sort_array(F.collect_list(F.col("p_partkey").cast("string"))), ",").alias("nodes"))
        .select("term", "label", F.explode(F.split("nodes", ",")).alias("node")),
        "SELECT p_type AS term, CASE WHEN p_size <= 25 THEN 1 ELSE -1 END AS label, CAST(p_partkey AS VARCHAR) AS node FROM part",
    ),
    Query(
        "s10_gene_sets",
        lambda t: T.gene_sets(t.part.withColumn("m", F.concat(F.lit("P"), "p_partkey")), "p_brand", "m", "p_type").select("name", "description", F.concat_ws("\t", "members").alias("members")),
        "SELECT p_brand AS name, min(p_type) AS description, string_agg(DISTINCT concat('P', p_partkey), chr(9) ORDER BY concat('P', p_partkey)) AS members FROM part GROUP BY 1",
    ),
    Query(
        "s12_id_map_table",
        lambda t: t.customer.select(F.col("c_custkey").alias("canonical"), "c_name", "c_mktsegment").unpivot(["canonical"], ["c_name", "c_mktsegment"], "namespace", "alternate"),
        "SELECT c_custkey AS canonical, 'c_name' AS namespace, c_name AS alternate FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer",
    ),
    Query(
        "s13_cell_list",
        lambda t: T.explode_cell(t.part.select("p_partkey", F.col("p_name").alias("word")), "word", " "),
        "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part",
    ),
    Query(
        "s14_json_cells",
        lambda t: t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    Query(
        "s17_scores_without_positives",
        lambda t: T.ranked(T.without_positives(t.scores(), _part_names(t).filter("p_size <= 10")), ["alg"]).filter("rank <= 50"),
        f"""WITH {SCORES_SQL} SELECT * FROM (SELECT alg, node, score, row_number() OVER (PARTITION BY alg ORDER BY score DESC, node) AS rank FROM scores
        WHERE node NOT IN (SELECT concat('P', p_partkey) FROM part WHERE p_size <= 10)) WHERE rank <= 50""",
    ),
    Query(
        "k1_top_k_per_key",
        lambda t: T.top_k(t.scores(), ["alg"], 100).select("alg", "node", "rank", F.format_string("%.4e", F.col("score")).alias("score")),
        f"WITH {_RANKS_SQL} SELECT alg, node, rank, printf('%.4e', score) AS score FROM ranks WHERE rank <= 100 AND score <> 0",
    ),
    Query(
        "k9_pivot_report",
        lambda t: T.outer_ranks(_ranks(t), ["price", "size", "third"]).na.fill(0),
        f"""WITH {_RANKS_SQL} SELECT node, max(CASE WHEN alg = 'price' THEN rank END) AS price, max(CASE WHEN alg = 'size' THEN rank END) AS size,
        coalesce(max(CASE WHEN alg = 'third' THEN rank END), 0) AS third FROM ranks GROUP BY node""",
    ),
    Query(
        "p1_in_list_filters",
        lambda t: T.keep_values(t.part, {"p_type": ["STANDARD", "SMALL", "PROMO"], "p_size": list(range(5, 20))}).select("p_partkey", "p_type", "p_size"),
        "SELECT p_partkey, p_type, p_size FROM part WHERE p_type IN ('STANDARD', 'SMALL', 'PROMO') AND p_size BETWEEN 5 AND 19",
    ),
    Query("p3_weight_above", lambda t: _wide(t).filter("combined > 80").select("src", "dst", "combined"), f"WITH {_WIDE_SQL} SELECT src, dst, combined FROM wide WHERE combined > 80"),
    Query(
        "p14_zero_to_null",
        lambda t: _wide(t).select("src", "dst", *[F.nullif(F.col(c), F.lit(0.0)).alias(c) for c in _CHANNELS]).dropna(how="any"),
        f"WITH {_WIDE_SQL} SELECT src, dst, A, N, R FROM wide WHERE A <> 0 AND N <> 0 AND R <> 0",
    ),
    Query(
        "p16_label_recode",
        lambda t: t.part.select("p_partkey", F.when(F.col("p_size") <= 25, "x").otherwise("").alias("positive")),
        "SELECT p_partkey, CASE WHEN p_size <= 25 THEN 'x' ELSE '' END AS positive FROM part",
    ),
    Query(
        "p17_score_flip",
        lambda t: t.scores().crossJoin(F.broadcast(t.scores().agg(F.min("score").alias("low")))).select("alg", "node", F.round(F.col("score") - 2 * F.col("low"), 6).alias("score")),
        f"WITH {SCORES_SQL} SELECT alg, node, round(score - 2 * (SELECT min(score) FROM scores), 6) AS score FROM scores",
    ),
    Query(
        "j1_map_both_ends",
        lambda t: T.map_edges(t.raw_edges().groupBy("src", "dst").agg(F.sum("weight").alias("weight")), _names(t).union(t.supplier.select(F.concat(F.lit("S"), "s_suppkey"), F.concat(F.lit("N"), "s_nationkey"))))
        .groupBy("src", "dst")
        .agg(F.sum("weight").alias("weight"), F.count("*").alias("n")),
        """SELECT concat('N', s_nationkey) AS src, concat(p_brand, '/', p_type) AS dst, sum(l_quantity) AS weight, count(DISTINCT concat(l_suppkey, ' ', l_partkey)) AS n
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    ),
    Query("j2_prefer_reviewed", lambda t: T.prefer_reviewed(_name_map(t), _reviewed(t)), f"WITH {_PREFER_SQL} SELECT from_id, to_id FROM best"),
    Query(
        "j3_map_column",
        lambda t: T.map_column(t.part.select(F.col("p_name").alias("name"), "p_brand").distinct(), "name", T.prefer_reviewed(_name_map(t), _reviewed(t))),
        f"WITH {_PREFER_SQL} SELECT p_name AS name_orig, p_brand, to_id AS name FROM (SELECT DISTINCT p_name, p_brand FROM part) JOIN best ON p_name = from_id",
    ),
    Query(
        "j4_both_ways",
        lambda t: T.both_ways(_name_map(t)),
        "SELECT p_name AS from_id, concat('P', p_partkey) AS to_id FROM part UNION SELECT concat('P', p_partkey), p_name FROM part",
    ),
    Query(
        "j7_target_restriction",
        lambda t: T.without_positives(
            t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("node"), "o_orderkey").join(t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("node")), "node", "left_semi"),
            t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node")),
        ),
        "SELECT c_custkey AS node, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING'",
    ),
    Query(
        "j10_name_lookup",
        lambda t: _ranks(t).filter("rank <= 20").join(_part_names(t).filter("p_size > 20").select("node", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first")), "node", "left").select("alg", "node", F.coalesce("first", "node").alias("name")),
        f"WITH {_RANKS_SQL} SELECT alg, node, coalesce(split_part(p_name, ' ', 1), node) AS name FROM ranks LEFT JOIN part ON node = concat('P', p_partkey) AND p_size > 20 WHERE rank <= 20",
    ),
    Query(
        "j11_attach_lists",
        lambda t: T.attach_lists(t.orders, "o_custkey", "o_orderkey", "orders"),
        "SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1",
    ),
    Query(
        "j14_best_row",
        lambda t: _ranks(t).groupBy("node").agg(F.min_by("alg", F.struct("rank", "alg")).alias("alg"), F.min("rank").alias("rank")),
        f"WITH {_RANKS_SQL} SELECT node, alg, rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY rank, alg) AS k FROM ranks) WHERE k = 1",
    ),
    Query(
        "j20_capped_neighbours",
        lambda t: t.lineitem.select("l_partkey", "l_suppkey").distinct().join(t.lineitem.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("degree")).filter("degree < 25"), "l_partkey"),
        "WITH d AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS degree FROM lineitem GROUP BY 1) SELECT DISTINCT l_partkey, l_suppkey, degree FROM lineitem JOIN d USING (l_partkey) WHERE degree < 25",
    ),
    Query(
        "a5_targets_per_key",
        lambda t: T.attach_lists(t.lineitem, "l_orderkey", "l_partkey", "parts", distinct=True),
        "SELECT l_orderkey, count(DISTINCT l_partkey) AS n, string_agg(DISTINCT l_partkey, '|' ORDER BY l_partkey) AS parts FROM lineitem GROUP BY 1",
    ),
    Query(
        "a6_mapping_statistics",
        lambda t: (lambda e, m: T.mapping_statistics(e, T.map_edges(e, m), m))(
            t.raw_edges().select("src", "dst").distinct(),
            _names(t).filter("to_id like 'Brand#1%'").union(t.supplier.select(F.concat(F.lit("S"), "s_suppkey"), F.concat(F.lit("N"), "s_nationkey"))),
        ),
        """WITH e AS (SELECT DISTINCT concat('S', l_suppkey) AS src, concat('P', l_partkey) AS dst FROM lineitem),
        m AS (SELECT concat('P', p_partkey) AS f, concat(p_brand, '/', p_type) AS t FROM part WHERE p_brand LIKE 'Brand#1%' UNION ALL SELECT concat('S', s_suppkey), concat('N', s_nationkey) FROM supplier),
        x AS (SELECT a.t AS src, b.t AS dst FROM e JOIN m a ON src = a.f JOIN m b ON dst = b.f),
        n AS (SELECT src AS v FROM e UNION SELECT dst FROM e)
        SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM (SELECT src FROM x UNION SELECT dst FROM x)) AS new_nodes,
        (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM x)) AS new_edges,
        (SELECT count(*) FROM n WHERE v NOT IN (SELECT f FROM m)) AS unmapped""",
    ),
    Query(
        "a9_results_overview",
        lambda t: T.overview(t.events, "event_type", "value"),
        "SELECT event_type, round(median(value), 6) AS median, count(*) AS n FROM events GROUP BY 1",
    ),
    Query(
        "a12_enrichment_count",
        lambda t: T.distinct_by(t.part, "p_name", "p_type", "n_types"),
        "SELECT p_name, count(DISTINCT p_type) AS n_types FROM part GROUP BY 1",
    ),
    Query(
        "a13_median_deviation",
        lambda t: T.median_deviation(t.orders, ["o_orderstatus"], "o_totalprice").select("o_orderstatus", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad")),
        """WITH m AS (SELECT o_orderstatus, median(o_totalprice) AS md FROM orders GROUP BY 1)
        SELECT o_orderstatus, round(any_value(md), 4) AS median, round(median(abs(o_totalprice - md)), 4) AS mad FROM orders JOIN m USING (o_orderstatus) GROUP BY 1""",
    ),
    Query(
        "a16_first_reaching",
        lambda t: T.first_reaching(t.events.withColumn("i", F.col("event_id")), ["user_id"], "i", "value", 95.0),
        "SELECT user_id, coalesce(min(CASE WHEN value >= 95.0 THEN event_id END), max(event_id)) AS i FROM events GROUP BY 1",
    ),
    Query(
        "a17_value_counts",
        lambda t: t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("n_nations")),
        "SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_nationkey) AS n_nations FROM customer GROUP BY 1",
    ),
    Query(
        "a18_mean_over_repetitions",
        lambda t: T.mean_over_repetitions(t.scores(), ["node"], 3).select("node", F.round("score", 6).alias("score")),
        f"WITH {SCORES_SQL} SELECT node, round(sum(score) / 3, 6) AS score FROM scores GROUP BY node",
    ),
    Query(
        "a19_edge_shares",
        lambda t: T.shares(t.part.select(F.col("p_brand").alias("v"), F.col("p_type").alias("term")), "v", "term", 0.15).withColumn("share", F.round("share", 6)),
        """SELECT v, term, n, round(n / sum_n, 6) AS share FROM (SELECT p_brand AS v, p_type AS term, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_brand) AS sum_n FROM part GROUP BY 1, 2)
        WHERE n / sum_n > 0.15""",
    ),
    Query(
        "r2_rank_aggregation",
        lambda t: T.aggregate_ranks(_ranks(t)).select("node", "median_rank", "mean_rank"),
        f"""WITH {_RANKS_SQL}, last AS (SELECT alg, max(rank) AS last FROM ranks GROUP BY alg), nodes AS (SELECT DISTINCT node FROM ranks),
        grid AS (SELECT n.node, coalesce(r.rank, l.last) AS rank FROM nodes n CROSS JOIN last l LEFT JOIN ranks r ON r.node = n.node AND r.alg = l.alg)
        SELECT node, round_even(median(rank), 1) AS median_rank, round_even(avg(rank), 1) AS mean_rank FROM grid GROUP BY node""",
    ),
    Query(
        "r3_top_k_by_factor",
        lambda t: T.top_k(t.scores(), ["alg"], t.scores().groupBy("alg").agg(F.floor(0.01 * F.count("*")).alias("k"))).select("alg", "node", "rank"),
        f"WITH {_RANKS_SQL} SELECT r.alg, node, rank FROM ranks r JOIN (SELECT alg, floor(0.01 * count(*)) AS k FROM scores GROUP BY alg) c ON r.alg = c.alg WHERE rank <= k AND score <> 0",
    ),
    Query(
        "r4_top_k_ranges",
        lambda t: _ranks(t).withColumn("k", F.explode(F.array(*[F.lit(x) for x in T.expand_ks([10], [(50, 200, 50)])]))).filter("rank <= k").groupBy("alg", "k").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total")),
        f"WITH {_RANKS_SQL} SELECT alg, k, count(*) AS n, round(sum(score), 4) AS total FROM (SELECT *, unnest([10, 50, 100, 150]) AS k FROM ranks) WHERE rank <= k GROUP BY 1, 2",
    ),
    Query(
        "r7_overall_and_type_ranks",
        lambda t: T.ranked(_overall(t), ["p_type"]).select("p_type", "node", "overall", "rank"),
        """SELECT p_type, p_partkey AS node, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS overall,
        row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part""",
    ),
    Query(
        "r9_first_cover",
        lambda t: T.first_cover(t.part.select("p_name", F.col("p_type").alias("term")).withColumnRenamed("p_name", "node"), t.part.groupBy(F.col("p_type").alias("term")).agg(F.min("p_partkey").alias("place"))),
        """WITH places AS (SELECT p_type AS term, min(p_partkey) AS place FROM part GROUP BY 1)
        SELECT p_name AS node, arg_min(term, place) AS term FROM part JOIN places ON p_type = term GROUP BY 1""",
    ),
    Query(
        "u2_terms_in_both",
        lambda t: t.part.filter("p_size < 10").select("p_name").intersect(t.part.filter("p_size > 45").select("p_name")),
        "SELECT p_name FROM part WHERE p_size < 10 INTERSECT SELECT p_name FROM part WHERE p_size > 45",
    ),
    Query(
        "u3_universe_less_positives",
        lambda t: t.lineitem.select("l_partkey").distinct().exceptAll(t.part.filter("p_size <= 25").select("p_partkey")),
        "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)",
    ),
    Query(
        "u4_bag_union",
        lambda t: t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("b")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k")), allowMissingColumns=True).groupBy("k").agg(F.count("*").alias("n"), F.count("b").alias("nb")),
        "SELECT k, count(*) AS n, count(b) AS nb FROM (SELECT c_nationkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, NULL FROM supplier) GROUP BY k",
    ),
    Query(
        "u5_set_report",
        lambda t: T.set_report(_part_names(t).filter("p_size <= 25"), _part_names(t).filter("p_size > 20")),
        """SELECT CAST(sum(CASE WHEN p_size <= 25 AND p_size > 20 THEN 1 ELSE 0 END) AS BIGINT) AS both, CAST(sum(CASE WHEN p_size <= 20 THEN 1 ELSE 0 END) AS BIGINT) AS first_only,
        CAST(sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS BIGINT) AS second_only FROM part""",
    ),
    Query(
        "m1_evidence_melt",
        lambda t: _wide(t).select("src", "dst", *[F.nullif(F.col(c), F.lit(0.0)).alias(c) for c in _CHANNELS]).unpivot(["src", "dst"], list(_CHANNELS), "interaction_type", "weight").dropna()
        .select(F.col("src").alias("uniprot_a"), F.col("dst").alias("uniprot_b"), F.lit(False).alias("directed"), "interaction_type", F.col("weight").cast("int").alias("detection_method"), F.lit("").alias("publication_id"), F.lit("table").alias("source")),
        f"""WITH {_WIDE_SQL} SELECT src AS uniprot_a, dst AS uniprot_b, false AS directed, interaction_type, CAST(weight AS INT) AS detection_method, '' AS publication_id, 'table' AS source
        FROM (SELECT src, dst, unnest(['A', 'N', 'R']) AS interaction_type, unnest([A, N, R]) AS weight FROM wide) WHERE weight <> 0""",
    ),
    Query(
        "m5_merged_lists",
        lambda t: t.part.groupBy("p_brand").agg(T.joined_list("p_name", "/", distinct=True).alias("names")),
        "SELECT p_brand, string_agg(DISTINCT p_name, '/' ORDER BY p_name) AS names FROM part GROUP BY 1",
    ),
    Query(
        "f_display_names",
        lambda t: t.documents.select("doc_id", T.short_name(F.coalesce("text", F.lit("")), None).alias("name"), T.publication_link(_publication()).alias("link")),
        """SELECT doc_id, CASE WHEN length(replace(text, chr(39), '')) > 50 THEN concat(substring(replace(text, chr(39), ''), 1, 15), '[...]') ELSE replace(text, chr(39), '') END AS name, link FROM (SELECT doc_id, coalesce(text, '') AS text, 
          CASE doc_id % 9 WHEN 0 THEN concat('<a style="color:blue" href="http://www.ncbi.nlm.nih.gov/pubmed/', v, '" target="PubMed">pmid:', v, '</a>')
          WHEN 1 THEN concat('<a style="color:blue" href="http://dx.doi.org/', v, '" target="DOI">doi:', replace(v, '-', '&#8209;'), '</a>')
          WHEN 2 THEN concat('<a style="color:blue" href="http://omim.org/entry/', v, '" target="OMIM">omim:', v, '</a>')
          WHEN 3 THEN concat('<a style="color:blue" href="http://www.ebi.ac.uk/intact/imex/main.xhtml?query=', v, '" target="IMEX">imex:', replace(v, '-', '&#8209;'), '</a>')
          WHEN 4 THEN concat('<a style="color:blue" href="http://www.phosphosite.org/siteAction.action?id=', v, '" target="PSP">phosphosite:', v, '</a>')
          WHEN 5 THEN concat('<a style="color:blue" href="http://www.netpath.org/reactions?path_id=', v, '" target="NetPath">netpath:', v, '</a>')
          WHEN 6 THEN concat('<a style="color:blue" href="http://www.kegg.jp/kegg-bin/show_pathway?', v, '" target="KEGG">map</a>,&nbsp<a style="color:blue" href="http://www.kegg.jp/dbget-bin/www_bget?pathway+', v, '" target="KEGG">evidence</a>')
          ELSE '' END AS link FROM (SELECT *, concat('10-', doc_id) AS v FROM documents))""",
    ),
]

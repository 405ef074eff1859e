"""Propagation, evaluation and significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions.lineage import cut
from weftgraph.operators import classify as K
from weftgraph.operators import evaluate as E
from weftgraph.operators import graph as G
from weftgraph.operators import propagate as X
from weftgraph.operators import stats as S
from weftgraph.operators import tables as T
from weftgraph.operators.blocks import Blocks
from weftgraph.operators.graph import degrees, nodes_of
from weftgraph.plans.graph_queries import _TRADE_SQL, _six, _trade, edges, pairs
from weftgraph.plans.query import Query
from weftgraph.sources.tables import EDGES_SQL, LABELS_SQL, SCORES_SQL, Tables

_P_SQL = """deg AS (SELECT src AS node, sum(weight) AS d FROM edges GROUP BY 1),
p AS (SELECT src, dst, weight / d AS weight FROM edges JOIN deg ON node = src)"""
_BASE = f"{EDGES_SQL}, {LABELS_SQL}, {_P_SQL}"


def _propagation_sql(alpha: float, rounds: int, labels: str = "terms", keys: str = "term", name: str = "") -> str:
    """The rounds of a propagation from a table of labels, as one expression after another; `name` comes before theirs."""
    same = " AND ".join(f"f.{k} = x.{k}" for k in keys.split(", "))
    each = ", ".join(f"s.{k}" for k in keys.split(", "))
    free = f"NOT EXISTS (SELECT 1 FROM {labels} f WHERE {same} AND f.node = x.node)"
    step = lambda source: f"SELECT {keys}, node, {alpha} * v AS score FROM (SELECT {each}, p.src AS node, sum(p.weight * s.score) AS v FROM p JOIN {source} s ON s.node = p.dst GROUP BY ALL) x WHERE {free}"
    out = f"{name}ones AS (SELECT {keys}, node, 1.0::DOUBLE AS score FROM {labels} WHERE label > 0), {name}f AS ({step(f'{name}ones')}), {name}s1 AS (SELECT * FROM {name}f)"
    for k in range(2, rounds + 1):
        out += f", {name}s{k} AS (SELECT {keys}, node, sum(score) AS score FROM ({step(f'{name}s{k - 1}')} UNION ALL SELECT * FROM {name}f) GROUP BY ALL)"
    return out + f", {name}result AS (SELECT * FROM {name}s{rounds} WHERE score > 0 UNION ALL SELECT * FROM {name}ones)"


_X2_SQL = f"{_BASE}, {_propagation_sql(0.95, 3)}"

_NATION_SQL = f"""{_TRADE_SQL}, tlab AS (SELECT concat('R', n_regionkey) AS term, concat('N', n_nationkey) AS node, CASE WHEN n_nationkey % 5 < 3 THEN 1 ELSE -1 END AS label FROM nation),
td AS (SELECT src AS node, sum(weight) AS d FROM tedges GROUP BY 1),
tp AS (SELECT src, dst, weight / d AS weight FROM tedges JOIN td ON node = src UNION ALL SELECT node, node, 0.0 FROM (SELECT node FROM td UNION SELECT node FROM tlab))"""


def _fixed_point_sql(alpha: float, rounds: int, label: str) -> str:
    """Rounds of propagation with the fixed nodes kept in the state; rows of tp without weight keep nodes in it."""
    return f"""WITH RECURSIVE {_NATION_SQL}, fix AS (SELECT term, node, label FROM tlab WHERE {label}),
    st AS (SELECT 0 AS k, term, node, 1.0::DOUBLE AS score FROM fix WHERE label > 0
      UNION ALL SELECT max(k) + 1, s.term, tp.src, CASE WHEN any_value(x.label) > 0 THEN 1.0 WHEN any_value(x.label) < 0 THEN 0.0 ELSE {alpha} * sum(tp.weight * s.score) END
      FROM st s JOIN tp ON tp.dst = s.node LEFT JOIN fix x ON x.term = s.term AND x.node = tp.src WHERE k < {rounds} GROUP BY s.term, tp.src)"""


_NORMAL_SQL = """ts AS (SELECT e.src, e.dst, e.weight / sqrt(a.d * b.d) AS w FROM tedges e JOIN td a ON a.node = e.src JOIN td b ON b.node = e.dst),
tc AS (SELECT dst AS node, 1 + sum(w) AS c FROM ts GROUP BY 1)"""


def _laplace_sql(y: str, rounds: int = 300) -> str:
    """(I + L) f = y on the trade network, for every key of y (key, node, score): customers, which touch nations only, are
    eliminated, and the nations' system is iterated."""
    return f"""WITH RECURSIVE {_NATION_SQL}, {_NORMAL_SQL}, y AS ({y}),
    mm AS (SELECT a.src AS n, b.dst AS m, sum(a.w * b.w / c) AS v FROM ts a JOIN ts b ON b.src = a.dst JOIN tc ON tc.node = a.dst WHERE a.src LIKE 'N%' GROUP BY 1, 2),
    yc AS (SELECT key, src AS n, sum(w * score / c) AS v FROM ts JOIN y ON y.node = dst JOIN tc ON tc.node = dst WHERE src LIKE 'N%' GROUP BY 1, 2),
    rr AS (SELECT g.key, g.node AS n, coalesce(y.score, 0) + coalesce(yc.v, 0) AS v, c FROM (SELECT DISTINCT key, tc.node, c FROM y, tc WHERE tc.node LIKE 'N%') g
      LEFT JOIN y ON y.key = g.key AND y.node = g.node LEFT JOIN yc ON yc.key = g.key AND yc.n = g.node),
    it AS (SELECT 0 AS k, key, n, v / c AS f FROM rr
      UNION ALL SELECT max(k) + 1, it.key, mm.n, (any_value(rr.v) + sum(mm.v * it.f)) / any_value(rr.c) FROM it JOIN mm ON mm.m = it.n JOIN rr ON rr.key = it.key AND rr.n = mm.n WHERE k < {rounds} GROUP BY it.key, mm.n),
    fn AS (SELECT key, n AS node, f AS score FROM it WHERE k = {rounds}),
    f AS (SELECT * FROM fn UNION ALL SELECT fn.key, ts.src, (coalesce(any_value(y.score), 0) + sum(w * fn.score)) / any_value(c) FROM fn JOIN ts ON ts.dst = fn.node JOIN tc ON tc.node = ts.src
      LEFT JOIN y ON y.key = fn.key AND y.node = ts.src GROUP BY fn.key, ts.src
      UNION ALL SELECT key, node, score FROM y WHERE node NOT IN (SELECT node FROM td))"""


_COLUMNS_SQL = _laplace_sql("SELECT s AS key, s AS node, 1.0 AS score FROM (SELECT unnest(['N3', 'N8', 'N12']) AS s)")
_VALUES_SQL = f"{_COLUMNS_SQL}, vals AS (SELECT node AS source, key AS node, score AS value FROM f WHERE node LIKE 'N%')"

# The rule of the bins carries a state down the distinct degrees.
_BINS_SQL = """dd AS (SELECT degree, n, row_number() OVER (ORDER BY degree DESC) AS i, CAST(coalesce(sum(n) OVER (ORDER BY degree DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM (SELECT degree, count(*) AS n FROM bd GROUP BY 1)),
bw AS (SELECT CAST(ceil(sum(n) / 10.0) AS BIGINT) AS width FROM dd),
br AS (SELECT i, degree, n, start, 1 AS bin, degree AS first FROM dd WHERE i = 1
  UNION ALL SELECT x.i, x.degree, x.n, x.start, CASE WHEN greatest(r.start, r.bin * width) < r.start + r.n AND r.degree <> r.first THEN r.bin + 1 ELSE r.bin END,
    CASE WHEN greatest(r.start, r.bin * width) < r.start + r.n AND r.degree <> r.first THEN r.degree ELSE r.first END FROM br r JOIN dd x ON x.i = r.i + 1, bw),
bk AS (SELECT degree, bin, CASE WHEN greatest(start, bin * width) < start + n AND degree <> first THEN greatest(start, bin * width) - start ELSE n END AS kept FROM br, bw),
binned AS (SELECT node, degree, CAST(bin + CASE WHEN place >= kept THEN 1 ELSE 0 END AS INT) AS bin
  FROM (SELECT node, degree, row_number() OVER (PARTITION BY degree ORDER BY node) - 1 AS place FROM bd) JOIN bk USING (degree))"""


def _sets_sql(sets: int) -> str:
    """(rep, node, positive): the positives `pos` (node), drawn from their bins."""
    return f"""pool AS (SELECT node, bin, row_number() OVER (PARTITION BY bin ORDER BY node) - 1 AS k, count(*) OVER (PARTITION BY bin) AS size FROM binned),
    want AS (SELECT node AS positive, bin, rep, CAST(concat('0x', substr(md5(concat(node, '|', rep)), 1, 8)) AS BIGINT) % size AS k FROM pool, (SELECT unnest(range(1, {sets} + 1)) AS rep) WHERE node IN (SELECT node FROM pos)),
    sets AS (SELECT rep, pool.node, positive FROM want JOIN pool ON pool.bin = want.bin AND pool.k = want.k)"""


_POS_SQL = "pos AS (SELECT node FROM terms WHERE term = 'PROMO' AND label > 0), "
_DEGREES_SQL = f"{EDGES_SQL}, {{more}}bd AS (SELECT src AS node, count(DISTINCT dst) AS degree FROM edges{{where}} GROUP BY 1)"


def _held(t: Tables):
    """Labels that propagation did not see are those of the third of the parts that were held out."""
    return t.labels().withColumn("held", F.expr("cast(substring(node, 2) as int) % 3 = 0"))


def _scored(t: Tables):
    rows = t.scores().filter("alg <> 'third'")
    labels = t.part.select(F.concat(F.lit("P"), "p_partkey").alias("node"), F.when(F.col("p_partkey") % 5 == 0, 1).when(F.col("p_partkey") % 5 < 3, -1).alias("label")).filter("label is not null")
    return rows, rows.select("alg", "node").join(labels, "node")


_CURVE_SQL = f"""{SCORES_SQL}, lab AS (SELECT concat('P', p_partkey) AS node, CASE WHEN p_partkey % 5 = 0 THEN 1 WHEN p_partkey % 5 < 3 THEN -1 END AS label FROM part),
idx AS (SELECT alg, node, score, row_number() OVER (PARTITION BY alg ORDER BY score DESC, node) - 1 AS idx FROM scores WHERE alg <> 'third'),
pts AS (SELECT alg, i.node, score, idx, label, sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) OVER o AS tp, sum(CASE WHEN label < 0 THEN 1 ELSE 0 END) OVER o AS fp,
  sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY alg) AS n_pos, sum(CASE WHEN label < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY alg) AS n_neg
  FROM idx i JOIN lab USING (node) WHERE label IS NOT NULL WINDOW o AS (PARTITION BY alg ORDER BY idx ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT *, tp / (tp + fp) AS prec, tp / n_pos AS rec, fp / n_neg AS fpr FROM pts)"""


def _points(t: Tables):
    scores, labels = _scored(t)
    return E.curve(scores, labels, ["alg"])


def _top_lists(t: Tables):
    return T.top_k(t.scores(), ["alg"], 200)


_TOP_SQL = f"{SCORES_SQL}, top AS (SELECT alg, node FROM (SELECT alg, node, row_number() OVER (PARTITION BY alg ORDER BY score DESC, node) AS r FROM scores WHERE score <> 0) WHERE r <= 200)"


def _pairs(t: Tables):
    """Two measures of the same key: mean order value and mean balance by nation and segment."""
    return t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.round(F.avg("c_acctbal"), 2).alias("x"), F.round(F.median("c_acctbal"), 2).alias("y"))


_PAIRS_SQL = "pairs AS (SELECT c_mktsegment, c_nationkey, round(avg(c_acctbal), 2) AS x, round(median(c_acctbal), 2) AS y FROM customer GROUP BY 1, 2)"


def _four(df, *columns):
    """Iterated solutions, to the digits that their tolerance fixes."""
    return df.select(*[c for c in df.columns if c not in columns], *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in columns])


def _path_lengths(t: Tables):
    """(rep, source, node, value): steps between the nodes of a set: the seeds (0), and random sets of as many nodes."""
    e = _trade(t)
    sets = _seeds(t).select(F.lit(0).alias("rep"), "node").unionByName(S.simple_sets(nodes_of(e), 3, 4))
    reached = G.distances(e.withColumn("cost", F.lit(1.0)), sets.select("node").distinct())
    return S.pair_values(reached.select("source", "node", F.col("dist").alias("value")), sets)


def _seeds(t: Tables):
    return t.spark.createDataFrame([("N3",), ("N8",), ("N12",)], "node string")


_MEASURES_SQL = """st AS (SELECT {key}, score, max(tp) AS tp, max(fp) AS fp, max(n_pos) AS p, max(n_neg) AS n FROM curve GROUP BY 1, 2),
st2 AS (SELECT *, coalesce(lag(tp) OVER o, 0) AS tp0, coalesce(lag(fp) OVER o, 0) AS fp0 FROM st WINDOW o AS (PARTITION BY {key} ORDER BY score DESC)),
st3 AS (SELECT *, CASE WHEN tp > tp0 THEN 1 + (fp - fp0) / (tp - tp0) END AS a, CASE WHEN tp > tp0 THEN fp0 - (fp - fp0) / (tp - tp0) * tp0 END AS b FROM st2),
area AS (SELECT {key}, sum((fp - fp0) / n * (tp + tp0) / 2 / p) AS auroc,
  sum(CASE WHEN tp = tp0 THEN 0 WHEN abs(b) < 1e-12 THEN (tp - tp0) / a / p ELSE ((tp - tp0) / a - b / (a * a) * (ln(a * tp + b) - ln(a * tp0 + b))) / p END) AS auprc FROM st3 GROUP BY 1)
SELECT c.{key}, round(max(CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END), 6) AS fmax,
round(sum(CASE WHEN label > 0 THEN prec ELSE 0 END) / max(n_pos), 6) AS avgp, round(max(auroc), 6) AS auroc, round(max(auprc), 6) AS auprc"""
_CROSS_SQL = f"""WITH {_BASE}, split AS (SELECT term, node, label, (row_number() OVER (PARTITION BY term, label ORDER BY md5(concat(node, '|', term, '|1')), node) - 1) % 3 AS fold FROM terms
  WHERE term IN (SELECT term FROM terms GROUP BY 1 HAVING count(*) FILTER (label > 0) >= 3 AND count(*) FILTER (label < 0) >= 3)),
flab AS (SELECT term, k AS fold, node, label FROM split, (SELECT unnest([0, 1, 2]) AS k) WHERE fold <> k),
{_propagation_sql(0.95, 3, "flab", "term, fold", "c")},
tested AS (SELECT s.term, s.node, s.label, round(coalesce(r.score, 0), 9) AS score FROM split s LEFT JOIN cresult r ON r.term = s.term AND r.fold = s.fold AND r.node = s.node),
pts AS (SELECT term, node, score, label, row_number() OVER (PARTITION BY term ORDER BY score DESC, node) - 1 AS idx FROM tested),
cum AS (SELECT *, sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) OVER o AS tp, sum(CASE WHEN label < 0 THEN 1 ELSE 0 END) OVER o AS fp,
  sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY term) AS n_pos, sum(CASE WHEN label < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY term) AS n_neg FROM pts WINDOW o AS (PARTITION BY term ORDER BY idx ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT *, tp / (tp + fp) AS prec, tp / n_pos AS rec FROM cum WHERE n_pos > 0 AND n_neg > 0),
{_MEASURES_SQL.format(key="term")}, CAST(max(n_pos) AS BIGINT) AS n_pos FROM curve c JOIN area USING (term) GROUP BY 1"""



def _feistel_sql(k: int) -> str:
    """One round of the permutation that negatives are drawn by."""
    mixed = lambda half: f"CAST(concat('0x', substr(md5(concat({half}, '|', term, '|1|{k}')), 1, 8)) AS BIGINT)"
    moved = f"a, (b + {mixed('a')}) % c AS b" if k % 2 else f"(a + {mixed('b')}) % r AS a, b"
    return f"h{k + 1} AS (SELECT term, k, n, r, c, turn, {moved} FROM h{k})"


def _directed(t: Tables):
    """The trade network with weights that differ by direction."""
    return _trade(t).withColumn("weight", F.col("weight") * (F.expr("cast(substring(dst, 2) as int) % 3") + 1))


_DIRECTED_SQL = _fixed_point_sql(0.8, 160, "true").replace("tedges AS (", "tedges0 AS (", 1).replace(
    ", tlab AS (", ", tedges AS (SELECT src, dst, weight * (CAST(substr(dst, 2) AS INT) % 3 + 1) AS weight FROM tedges0), tlab AS (", 1
)

def _vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").cast("string").alias("node"), "embedding", (F.col("label") == 0).cast("int").alias("y"))


_FEATURES_SQL = """WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS node, embedding FROM embeddings WHERE embedding IS NOT NULL),
h AS (SELECT j, k, md5(concat('1|', j, '|', k)) AS h FROM (SELECT unnest(range(32)) AS j), (SELECT unnest(range((SELECT max(len(embedding)) FROM e))) AS k)),
w AS (SELECT j, list(sqrt(-2 * ln(CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE + power(2.0, -33))) * cos(2 * pi() * CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) / 4294967296.0::DOUBLE) ORDER BY k) AS w,
  2 * pi() * CAST(concat('0x', substr(md5(concat('1|', j, '|phase')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS phase FROM h GROUP BY j)
SELECT node, CAST(j AS INT) AS place, round(sqrt(2.0 / 32) * cos(list_dot_product(CAST(embedding AS DOUBLE[]), w) + phase), 6) AS value FROM e, w"""

QUERIES = [
    Query(
        "x1_local",
        lambda t: _six(X.local(edges(t), t.labels()), "score"),
        f"WITH {_BASE} SELECT term, p.src AS node, round(sum(p.weight * label), 6) AS score FROM p JOIN terms t ON t.node = p.dst GROUP BY 1, 2",
    ),
    Query(
        "x1_local_plus",
        lambda t: _six(X.local(edges(t), t.labels(), plus=True), "score"),
        f"WITH {_BASE} SELECT term, p.src AS node, round(sum(p.weight), 6) AS score FROM p JOIN terms t ON t.node = p.dst WHERE label > 0 GROUP BY 1, 2",
    ),
    Query("x2_propagation", lambda t: _six(X.propagate(pairs(t), t.labels(), 0.95, 3, pairs=True), "score"), f"WITH {_X2_SQL} SELECT term, node, round(score, 6) AS score FROM result"),
    Query(
        "x2_propagation_ten_rounds",
        lambda t: _six(X.propagate(pairs(t), t.labels(), 0.95, 10, pairs=True), "score"),
        f"WITH {_BASE}, {_propagation_sql(0.95, 10)} SELECT term, node, round(score, 6) AS score FROM result",
    ),
    Query(
        "x2_propagation_topk",
        lambda t: T.top_k(_six(X.propagate(pairs(t), t.labels(), 0.95, 3, pairs=True), "score"), ["term"], 50).select("term", "node", "rank", "score"),
        f"""WITH {_X2_SQL} SELECT * FROM (SELECT term, node, row_number() OVER (PARTITION BY term ORDER BY score DESC, node) AS rank, score
        FROM (SELECT term, node, round(score, 6) AS score FROM result) WHERE score <> 0) WHERE rank <= 50""",
    ),
    Query(
        "x2_propagation_to_eps",
        lambda t: _six(X.propagate(_trade(t), _nation_labels(t), 0.8, 200, 1e-6, plus=True), "score"),
        f"""{_fixed_point_sql(0.8, 120, "label > 0")}, gain AS (SELECT k, max(score - old) AS g FROM (SELECT k, score, coalesce(lag(score) OVER (PARTITION BY term, node ORDER BY k), 0) AS old FROM st) GROUP BY k),
        stop AS (SELECT min(k) AS k FROM gain WHERE k > 1 AND g <= 1e-6) SELECT term, node, round(score, 6) AS score FROM st WHERE k = (SELECT k FROM stop) AND score > 0""",
    ),
    Query(
        "x3_solver",
        lambda t: _six(X.solve(_trade(t), _nation_labels(t), 0.8, "bicgstab", 1e-12), "score"),
        f"{_fixed_point_sql(0.8, 160, 'true')} SELECT term, node, round(score, 6) AS score FROM st WHERE k = 160 AND score > 0",
    ),
    Query("x3_directed", lambda t: _six(X.solve(_directed(t), _nation_labels(t), 0.8, "bicgstab", 1e-12), "score"), f"{_DIRECTED_SQL} SELECT term, node, round(score, 6) AS score FROM st WHERE k = 160 AND score > 0"),
    Query("x3_symmetric", lambda t: _six(X.solve(_trade(t), _nation_labels(t), 0.8, "cg", 1e-12), "score"), f"{_fixed_point_sql(0.8, 160, 'true')} SELECT term, node, round(score, 6) AS score FROM st WHERE k = 160 AND score > 0"),
    Query("x3_semi_iteration", lambda t: _six(X.settle(_trade(t), _nation_labels(t), 0.8, 1e-10), "score"), f"{_fixed_point_sql(0.8, 160, 'true')} SELECT term, node, round(score, 6) AS score FROM st WHERE k = 160 AND score > 0"),
    Query(
        "x4_bounds",
        lambda t: _six(X.bounds(_trade(t), _nation_labels(t), 0.8)[0], "score"),
        f"{_fixed_point_sql(0.8, 160, 'true')} SELECT term, node, round(score, 6) AS score FROM st WHERE k = 160 AND score > 0",
    ),
    Query("x4_bound_rounds", lambda t: _six(X.bounds(_trade(t), _nation_labels(t), 0.8)[1], "ub")),
    Query(
        "x6_genemania",
        lambda t: _four(X.genemania(_trade(t), _nation_labels(t), nodes_of(_trade(t)), tol=1e-9), "score"),
        f"""{_laplace_sql("SELECT b.term AS key, td.node, coalesce(label, bias) AS score FROM td CROSS JOIN (SELECT term, sum(label) / count(*) AS bias FROM tlab GROUP BY 1) b LEFT JOIN tlab l ON l.term = b.term AND l.node = td.node")}
        SELECT key AS term, node, round(score, 4) AS score FROM f""",
    ),
    Query(
        "x7_regularised_laplacian",
        lambda t: _four(X.regularised_laplacian(_trade(t), _nation_labels(t), tol=1e-9), "score"),
        f"{_laplace_sql('SELECT term AS key, node, 1.0 AS score FROM tlab WHERE label > 0')} SELECT key AS term, node, round(score, 4) AS score FROM f",
    ),
    Query(
        "x15_preconditioned",
        lambda t: _four(X.preconditioned_solve(_trade(t), _nation_labels(t).filter("label > 0").select("term", "node", F.lit(1.0).alias("score")), tol=1e-10), "score"),
        f"{_laplace_sql('SELECT term AS key, node, 1.0 AS score FROM tlab WHERE label > 0')} SELECT key AS term, node, round(score, 4) AS score FROM f",
    ),
    Query(
        "x10_kernel_features",
        lambda t: _six(K.kernel_features(_vectors(t), 0.5, 32).select("node", F.posexplode("embedding").alias("place", "value")), "value"),
        _FEATURES_SQL,
    ),
    Query("x10_kernel_machine", lambda t: _six(K.kernel_machine(_vectors(t), 0.5), "score")),
    Query("x8_network_regression", lambda t: K.network_scores(_trade(t), _nation_labels(t), "logistic").withColumn("score", F.round("score", 3))),
    Query("x9_network_svm", lambda t: K.network_scores(_trade(t), _nation_labels(t), "svm").withColumn("score", F.round("score", 3))),
    Query("x8_logistic_regression", lambda t: _six(K.logistic(t.embeddings.select(F.col("vec_id").cast("string").alias("node"), "embedding", (F.col("label") == 0).cast("int").alias("y"))), "score")),
    Query("x9_svm", lambda t: _six(K.svm(t.embeddings.select(F.col("vec_id").cast("string").alias("node"), "embedding", (F.col("label") == 0).cast("int").alias("y"))), "score")),
    Query("x11_diffusion_columns", lambda t: _four(X.diffusion(_trade(t), _seeds(t), tol=1e-9), "score"), f"{_COLUMNS_SQL} SELECT key AS source, node, round(score, 4) AS score FROM f WHERE score <> 0"),
    Query(
        "x12_contributors",
        lambda t: (lambda e: _four(X.contributors(X.diffusion(e, _seeds(t), tol=1e-9), e, nodes_of(e).filter("node like 'C%'"), 0.3), "effective_diffusion"))(_trade(t)),
        f"""{_COLUMNS_SQL}, sh AS (SELECT f.node, key AS source, score / sum(score) OVER (PARTITION BY f.node) AS part, CASE WHEN e.src IS NULL THEN 0 ELSE 1 END AS near
          FROM f LEFT JOIN tedges e ON e.src = f.node AND e.dst = f.key WHERE f.node LIKE 'C%' AND score <> 0)
        SELECT node, CAST(count(*) FILTER (part > 0.3) AS BIGINT) AS n_contributors, CAST(count(*) FILTER (part > 0.3 AND near = 1) AS BIGINT) AS n_near,
        round(1 - coalesce(sum(part) FILTER (near = 1), 0), 4) + 0.0 AS effective_diffusion, arg_max(source, round(part, 9)) AS top_source, arg_max(near, round(part, 9)) AS top_is_near FROM sh GROUP BY node""",
    ),
    Query(
        "e1_sample_negatives",
        lambda t: E.sample_negatives(t.labels().filter("label > 0"), t.labels(), 0.5),
        f"""WITH {LABELS_SQL}, pos AS (SELECT term, node FROM terms WHERE label > 0), u AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS place FROM (SELECT DISTINCT node FROM terms)),
        m AS (SELECT n, r, CAST(ceil(n / r) AS BIGINT) AS c FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS r FROM (SELECT count(*) AS n FROM u))),
        k AS (SELECT term, CAST(floor(0.5 * count(*)) AS BIGINT) AS k, count(*) AS p FROM pos GROUP BY 1),
        h0 AS (SELECT term, k, n, r, c, turn, turn // c AS a, turn % c AS b FROM (SELECT *, unnest(range(0, least(r * c, k + p + r * c - n))) AS turn FROM k, m)),
        {", ".join(_feistel_sql(k) for k in range(E.FEISTEL))},
        d AS (SELECT h.term, k, turn, u.node FROM h{E.FEISTEL} h JOIN u ON u.place = a * c + b WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.term = h.term AND pos.node = u.node))
        SELECT term, node FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY turn) AS i FROM d) WHERE i <= k""",
    ),
    Query("e2_curve", lambda t: _six(_points(t), "prec", "rec", "fpr").select("alg", "node", "idx", "prec", "rec", "fpr"), f"WITH {_CURVE_SQL} SELECT alg, node, idx, round(prec, 6) AS prec, round(rec, 6) AS rec, round(fpr, 6) AS fpr FROM curve"),
    Query(
        "e3_measures",
        lambda t: _six(E.measures(_points(t), ["alg"]), "fmax", "avgp", "auprc", "auroc").select("alg", "fmax", "avgp", "auroc", "auprc"),
        f"""WITH {_CURVE_SQL},
        st AS (SELECT alg, score, max(tp) AS tp, max(fp) AS fp, max(n_pos) AS p, max(n_neg) AS n FROM curve GROUP BY 1, 2),
        st2 AS (SELECT *, coalesce(lag(tp) OVER o, 0) AS tp0, coalesce(lag(fp) OVER o, 0) AS fp0 FROM st WINDOW o AS (PARTITION BY alg ORDER BY score DESC)),
        st3 AS (SELECT *, CASE WHEN tp > tp0 THEN 1 + (fp - fp0) / (tp - tp0) END AS a, CASE WHEN tp > tp0 THEN fp0 - (fp - fp0) / (tp - tp0) * tp0 END AS b FROM st2),
        area AS (SELECT alg, sum((fp - fp0) / n * (tp + tp0) / 2 / p) AS auroc,
          sum(CASE WHEN tp = tp0 THEN 0 WHEN abs(b) < 1e-12 THEN (tp - tp0) / a / p ELSE ((tp - tp0) / a - b / (a * a) * (ln(a * tp + b) - ln(a * tp0 + b))) / p END) AS auprc FROM st3 GROUP BY 1)
        SELECT c.alg, round(max(CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END), 6) AS fmax,
        round(sum(CASE WHEN label > 0 THEN prec ELSE 0 END) / max(n_pos), 6) AS avgp, round(max(auroc), 6) AS auroc, round(max(auprc), 6) AS auprc FROM curve c JOIN area USING (alg) GROUP BY 1""",
    ),
    Query(
        "e7_early_precision",
        lambda t: _six(E.early_precision(_points(t), ["alg"], [0.1, 0.5], [1, 2]), "prec_r10", "prec_r50", "prec_k1", "prec_k2"),
        f"""WITH {_CURVE_SQL} SELECT alg, round(coalesce(arg_min(prec, idx) FILTER (rec >= 0.1), arg_max(prec, idx)), 6) AS prec_r10, round(coalesce(arg_min(prec, idx) FILTER (rec >= 0.5), arg_max(prec, idx)), 6) AS prec_r50,
        round(coalesce(arg_min(prec, idx) FILTER (idx >= n_pos), arg_max(prec, idx)), 6) AS prec_k1, round(coalesce(arg_min(prec, idx) FILTER (idx >= 2 * n_pos), arg_max(prec, idx)), 6) AS prec_k2 FROM curve GROUP BY 1""",
    ),
    Query(
        "e10_folds",
        lambda t: E.split_folds(t.labels(), 5),
        f"""WITH {LABELS_SQL}, ok AS (SELECT term FROM terms GROUP BY 1 HAVING count(*) FILTER (label > 0) >= 5 AND count(*) FILTER (label < 0) >= 5)
        SELECT term, node, label, (row_number() OVER (PARTITION BY term, label ORDER BY md5(concat(node, '|', term, '|1')), node) - 1) % 5 AS fold FROM terms WHERE term IN (SELECT term FROM ok)""",
    ),
    Query("e11_cross_validation", lambda t: _six(_cross_validation(t), "fmax", "avgp", "auprc", "auroc"), _CROSS_SQL),
    Query(
        "e12_leave_group_out",
        lambda t: E.leave_group_out(t.labels(), t.part.select(F.concat(F.lit("P"), "p_partkey").alias("node"), F.col("p_brand").alias("group")), 3).groupBy("group", "term", "label", "train").agg(F.count("*").alias("n")),
        f"""WITH {LABELS_SQL}, g AS (SELECT concat('P', p_partkey) AS node, p_brand AS own FROM part), r AS (SELECT t.*, own FROM terms t JOIN g USING (node)),
        grid AS (SELECT x.own AS "group", r.term, r.node, r.label, r.own <> x.own AS train FROM (SELECT DISTINCT term, own FROM r) x JOIN r USING (term)),
        ok AS (SELECT "group", term FROM grid GROUP BY 1, 2 HAVING count(*) FILTER (label = 1 AND train) >= 3 AND count(*) FILTER (label = 1 AND NOT train) >= 3
          AND count(*) FILTER (label = -1 AND train) > 0 AND count(*) FILTER (label = -1 AND NOT train) > 0)
        SELECT "group", term, label, train, count(*) AS n FROM grid JOIN ok USING ("group", term) GROUP BY 1, 2, 3, 4""",
    ),
    Query(
        "e16_skip_done",
        lambda t: E.skip_done(t.part, t.part.filter("p_size = 1"), ["p_brand", "p_type"]),
        "SELECT DISTINCT p_brand, p_type FROM part EXCEPT SELECT p_brand, p_type FROM part WHERE p_size = 1",
    ),
    Query("t1_uniform_bins", lambda t: S.uniform_bins(degrees(edges(t)).select("node", "degree"), 10), f"WITH RECURSIVE {_DEGREES_SQL.format(more='', where='')}, {_BINS_SQL} SELECT node, degree, bin FROM binned"),
    Query("t2_kmeans_bins", lambda t: K.degree_clusters(degrees(edges(t)).select("node", "degree"), 10)),
    Query(
        "t3_matched_sets",
        lambda t: S.matched_sets(t.labels().filter("label > 0 and term = 'PROMO'"), S.uniform_bins(degrees(edges(t)).select("node", "degree"), 10), 20),
        f"WITH RECURSIVE {_DEGREES_SQL.format(more=LABELS_SQL.strip() + ', ' + _POS_SQL, where='')}, {_BINS_SQL}, {_sets_sql(20)} SELECT rep, node, positive FROM sets",
    ),
    Query(
        "t3_simple_sets",
        lambda t: S.simple_sets(t.labels().select("node"), 25, 6),
        f"""WITH {LABELS_SQL} SELECT rep, node FROM (SELECT rep, node, row_number() OVER (PARTITION BY rep ORDER BY md5(concat(node, '|', rep)), node) AS k
        FROM (SELECT DISTINCT node FROM terms), (SELECT CAST(unnest(range(1, 7)) AS INT) AS rep)) WHERE k <= 25""",
    ),
    Query(
        "t4_permutation_p",
        lambda t: _six(S.permutation_p(t.scores().filter("alg = 'size'"), t.scores().filter("alg = 'third'").union(t.scores().filter("alg = 'price'"))), "pval").select("node", "score", "pval"),
        f"WITH {SCORES_SQL} SELECT a.node, a.score, round(avg(CASE WHEN b.score >= a.score THEN 1.0 ELSE 0 END), 6) AS pval FROM scores a JOIN scores b ON a.node = b.node AND b.alg <> 'size' WHERE a.alg = 'size' GROUP BY 1, 2",
    ),
    Query(
        "t6_two_sample_ks",
        lambda t: _six(S.two_sample_ks(t.orders.filter("o_orderstatus = 'F'"), t.orders.filter("o_orderstatus = 'O'"), "o_totalprice"), "d", "pval"),
        """WITH b AS (SELECT o_totalprice AS v, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS b FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1),
        g AS (SELECT sum(b) OVER o / sum(b) OVER () - sum(a) OVER o / sum(a) OVER () AS gap, sum(a) OVER () AS m, sum(b) OVER () AS n FROM b WINDOW o AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
        d AS (SELECT greatest(max(gap), 0) AS d, max(m) AS m, max(n) AS n FROM g) SELECT round(d, 6) AS d, round(exp(-2 * d * d * m * n / (m + n)), 6) AS pval FROM d""",
    ),
    Query(
        "t9_jaccard",
        lambda t: _six(S.jaccard(_top_lists(t), "alg"), "jaccard"),
        f"""WITH {_TOP_SQL}, n AS (SELECT alg, count(*) AS n FROM top GROUP BY 1) SELECT x.alg AS a, y.alg AS b, count(*) AS "both", round(count(*) / (max(na.n) + max(nb.n) - count(*)), 6) AS jaccard
        FROM top x JOIN top y USING (node) JOIN n na ON na.alg = x.alg JOIN n nb ON nb.alg = y.alg GROUP BY 1, 2""",
    ),
    Query(
        "t10_enrichment",
        lambda t: _six(S.enrichment(t.part.filter("p_size > 40").select(F.col("p_partkey").alias("node")), t.part.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("node")), t.part.select(F.col("p_partkey").alias("node"))).drop("qval"), "pval", "padj"),
        """WITH c AS (SELECT p_brand AS name, count(*) FILTER (p_size > 40) AS k, count(*) AS n FROM part GROUP BY 1), u AS (SELECT count(*) AS m, count(*) FILTER (p_size > 40) AS d FROM part),
        h AS (SELECT name, k, n, unnest(range(k, least(n, d) + 1)) AS x, m, d FROM c, u WHERE k > 0),
        p AS (SELECT name, k, n, least(1, sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + lgamma(m - n + 1) - lgamma(d - x + 1) - lgamma(m - n - d + x + 1)
          - lgamma(m + 1) + lgamma(d + 1) + lgamma(m - d + 1)))) AS pval FROM h WHERE m - n - d + x >= 0 GROUP BY 1, 2, 3),
        r AS (SELECT *, pval * count(*) OVER () / row_number() OVER (ORDER BY pval, name) AS raw FROM p)
        SELECT name, k, n, round(pval, 6) AS pval, round(least(1, min(raw) OVER (ORDER BY pval, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS padj FROM r""",
    ),
    Query(
        "t11_spearman",
        lambda t: _six(S.spearman(t.scores(), "alg"), "rho"),
        f"""WITH {SCORES_SQL}, j AS (SELECT x.alg AS a, y.alg AS b, x.score AS x, y.score AS y FROM scores x JOIN scores y ON x.node = y.node AND x.alg < y.alg),
        r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2 AS ry FROM j)
        SELECT a, b, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1, 2""",
    ),
    Query(
        "t12_signed_rank",
        lambda t: _six(S.signed_rank(_pairs(t), ["c_mktsegment"]).drop("tied"), "w", "z"),
        f"""WITH {_PAIRS_SQL}, d AS (SELECT c_mktsegment, round(x - y, 9) AS d FROM pairs WHERE round(x - y, 9) <> 0),
        r AS (SELECT *, count(*) OVER t AS t, rank() OVER (PARTITION BY c_mktsegment ORDER BY abs(d)) + (count(*) OVER t - 1) / 2 AS r FROM d WINDOW t AS (PARTITION BY c_mktsegment, abs(d)))
        SELECT c_mktsegment, count(*) AS n, round(sum(CASE WHEN d > 0 THEN r ELSE 0 END), 6) AS w,
        round((sum(CASE WHEN d > 0 THEN r ELSE 0 END) - count(*) * (count(*) + 1) / 4) / sqrt((count(*) * (count(*) + 1) * (2 * count(*) + 1) - sum(t * t - 1) / 2) / 24), 6) AS z FROM r GROUP BY 1""",
    ),
    Query(
        "t13_wins",
        lambda t: _six(S.wins(_pairs(t), ["c_mktsegment"]), "wins", "ties", "losses"),
        f"WITH {_PAIRS_SQL} SELECT c_mktsegment, round(avg(CASE WHEN x > y THEN 1.0 ELSE 0 END), 6) AS wins, round(avg(CASE WHEN x = y THEN 1.0 ELSE 0 END), 6) AS ties, round(avg(CASE WHEN x < y THEN 1.0 ELSE 0 END), 6) AS losses FROM pairs GROUP BY 1",
    ),
    Query(
        "e13_split_by_mask",
        lambda t: E.split_by_mask(t.labels(), t.part.filter("p_brand like 'Brand#1%'").select(F.concat(F.lit("P"), "p_partkey").alias("node")))[0],
        f"WITH {LABELS_SQL} SELECT term, node, label FROM terms WHERE node NOT IN (SELECT concat('P', p_partkey) FROM part WHERE p_brand LIKE 'Brand#1%')",
    ),
    Query(
        "t5_leave_one_out",
        lambda t: _four(S.leave_one_out(_columns(t), _seeds(t), t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("node"))), "total", "pval"),
        f"""{_VALUES_SQL}, sums AS (SELECT source, sum(value) AS total FROM vals WHERE source <> node GROUP BY 1), drawn AS (SELECT coalesce(total, 0) AS rand FROM nation LEFT JOIN sums ON source = concat('N', n_nationkey))
        SELECT s AS node, round(coalesce(total, 0), 4) AS total, round((1 + (SELECT count(*) FROM drawn WHERE rand > coalesce(total, 0))) / (SELECT count(*) FROM drawn), 4) AS pval
        FROM (SELECT unnest(['N3', 'N8', 'N12']) AS s) LEFT JOIN sums ON source = s""",
    ),
    Query(
        "t7_seed_pairs",
        lambda t: _four(S.pair_values(_columns(t), _seeds(t).withColumn("rep", F.lit(0))), "value"),
        f"{_VALUES_SQL} SELECT 0 AS rep, source, node, round(value, 4) AS value FROM vals WHERE source <> node AND source IN ('N3', 'N8', 'N12')",
    ),
    Query(
        "t8_path_lengths",
        lambda t: _path_lengths(t).groupBy("rep", "value").agg(F.count("*").alias("n")),
        f"""WITH RECURSIVE {_TRADE_SQL}, sets AS (SELECT 0 AS rep, unnest(['N3', 'N8', 'N12']) AS node UNION ALL SELECT rep, node FROM (SELECT rep, node, row_number() OVER (PARTITION BY rep ORDER BY md5(concat(node, '|', rep)), node) AS k
          FROM (SELECT DISTINCT src AS node FROM tedges), (SELECT CAST(unnest(range(1, 5)) AS INT) AS rep)) WHERE k <= 3),
        walk AS (SELECT DISTINCT node AS source, node, 0 AS hops FROM sets UNION SELECT source, dst, hops + 1 FROM walk JOIN tedges ON src = node WHERE hops < 7),
        dist AS (SELECT source, node, min(hops) AS hops FROM walk GROUP BY 1, 2)
        SELECT a.rep, CAST(hops AS DOUBLE) AS value, count(*) AS n FROM sets a JOIN sets b ON a.rep = b.rep AND a.node <> b.node JOIN dist d ON d.source = a.node AND d.node = b.node GROUP BY 1, 2""",
    ),
    Query("t12_signed_rank_tests", lambda t: _six(S.signed_rank_tests(_pairs(t), ["c_mktsegment"]), "w", "z", "pval", "corrected")),
    Query(
        "t16_box_summary",
        lambda t: _six(S.box_summary(t.orders, ["o_orderpriority"], "o_totalprice"), "low", "q1", "median", "q3", "high"),
        """WITH b AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1),
        r AS (SELECT o.o_orderpriority, o_totalprice AS v, q1, median, q3, o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS i FROM orders o JOIN b USING (o_orderpriority))
        SELECT o_orderpriority, count(*) AS n, round(min(v) FILTER (i), 6) AS low, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(max(v) FILTER (i), 6) AS high,
        CAST(count(*) FILTER (NOT i) AS BIGINT) AS n_out FROM r GROUP BY 1""",
    ),
    Query(
        "t15_combined_enrichment",
        lambda t: _six(S.combined_enrichment(t.part.select(F.col("p_type").alias("dataset"), F.col("p_brand").alias("name"), (F.col("p_size") / 100).alias("padj")), 0.1), "best"),
        "SELECT p_brand AS name, count(DISTINCT p_type) AS n_datasets, round(min(p_size / 100), 6) AS best FROM part WHERE p_size / 100 < 0.1 GROUP BY 1",
    ),
    Query(
        "t17_random_positives",
        lambda t: _six(_rescored(t), "pval").select("node", "pval"),
        f"""WITH RECURSIVE {_DEGREES_SQL.format(more=LABELS_SQL.strip() + ', ' + _POS_SQL, where=" WHERE src LIKE 'P%'")}, {_P_SQL}, {_BINS_SQL}, {_sets_sql(10)},
        rlab AS (SELECT DISTINCT rep, node, 1 AS label FROM sets), plab AS (SELECT 'PROMO' AS term, node, 1 AS label FROM pos),
        {_propagation_sql(0.95, 2, "rlab", "rep", "r")}, {_propagation_sql(0.95, 2, "plab", "term", "q")}
        SELECT a.node, round(avg(CASE WHEN round(b.score, 9) >= round(a.score, 9) THEN 1.0 ELSE 0 END), 6) AS pval FROM qresult a JOIN rresult b ON b.node = a.node WHERE a.node NOT IN (SELECT node FROM pos) GROUP BY 1""",
    ),
    Query("x5_bound_taus", lambda t: _six(X.bounds(_trade(t), _nation_labels(t).filter("term = 'R1'"), 0.5, compare=True)[1], "tau").select("term", "round", "tau")),
    Query("x5_kendall_tau", lambda t: _six(S.kendall_tau(T.top_k(t.scores().filter("alg = 'price'"), ["alg"], -1).join(t.part.select(F.concat(F.lit("P"), "p_partkey").alias("node"), "p_partkey"), "node").select("alg", F.col("rank").cast("double").alias("x"), F.col("p_partkey").cast("double").alias("y")), ["alg"]), "tau"), """WITH r AS (SELECT p_partkey AS y, row_number() OVER (ORDER BY p_retailprice DESC, concat('P', p_partkey)) AS x FROM part WHERE p_retailprice <> 0)
        SELECT 'price' AS alg, round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / ((SELECT count(*) FROM r) * ((SELECT count(*) FROM r) - 1)), 6) AS tau FROM r a, r b"""),
    Query(
        "t16_density",
        lambda t: _six(S.density(t.orders.withColumn("o_totalprice", F.col("o_totalprice") / 1e5), "o_totalprice", 40), "at", "density"),
        """WITH v AS (SELECT o_totalprice / 1e5 AS v FROM orders), e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 39 AS step, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h FROM v),
        b AS (SELECT (v - lo) / step AS p, least(floor((v - lo) / step), 38) AS k FROM v, e),
        w AS (SELECT bin, sum(w) AS w FROM (SELECT k AS bin, 1 - (p - k) AS w FROM b UNION ALL SELECT k + 1, p - k FROM b) GROUP BY 1)
        SELECT CAST(g AS INT) AS point, round(max(lo + g * step), 6) AS at, round(sum(w * exp(-pow((g - bin) * step / h, 2) / 2) / (sqrt(2 * pi()) * h * n)), 6) AS density
        FROM (SELECT unnest(range(0, 40)) AS g), w, e GROUP BY 1""",
    ),
    Query(
        "t16_histogram",
        lambda t: _six(S.histogram(t.orders, "o_totalprice", 20), "density"),
        """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS total FROM orders)
        SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n, round(count(*) / max(total) / max((hi - lo) / 20), 6) AS density FROM orders, e GROUP BY 1""",
    ),
]


def _nation_labels(t: Tables):
    """Terms over the trade network: regions, with their nations as positives and one other nation as a negative."""
    n = t.nation.select(F.concat(F.lit("R"), "n_regionkey").alias("term"), F.concat(F.lit("N"), "n_nationkey").alias("node"), F.when(F.col("n_nationkey") % 5 < 3, 1).otherwise(-1).alias("label"))
    return n


def _cross_validation(t: Tables):
    """All folds are propagated at once: a fold's key is the fold that it leaves out."""
    split = E.split_folds(t.labels(), 3)
    train = split.withColumn("out", F.explode(F.array(*[F.lit(k) for k in range(3)]))).filter("fold <> out").select("term", F.col("out").alias("fold"), "node", "label")
    scores = X.propagate(pairs(t), train, 0.95, 3, keys=["term", "fold"], pairs=True)
    held = split.select("term", "fold", "node", "label")
    tested = held.join(scores, ["term", "fold", "node"], "left").select("term", "node", "label", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))
    return E.measures(E.curve(tested.select("term", "node", "score"), held.select("term", "node", "label"), ["term"]), ["term"])


def _columns(t: Tables):
    """(source, node, value): diffusion between nations, as columns of the seeds; the matrix is symmetric."""
    columns = X.diffusion(_trade(t), _seeds(t), tol=1e-9)
    return columns.filter("node like 'N%'").select(F.col("node").alias("source"), F.col("source").alias("node"), F.col("score").alias("value"))


def _rescored(t: Tables, sets: int = 10):
    """Scores of one term against those from degree-matched random positives: every random set is a key of one run, and so is
    the term itself, as set 0."""
    net = Blocks(pairs(t), width=sets + 1, lam=0.0, pairs=True, write=True)
    labels = t.labels().filter("term = 'PROMO' and label > 0")
    binned = cut(S.uniform_bins(net.degrees.filter("node like 'P%'"), 10))
    drawn = S.matched_sets(labels, binned, sets).select("rep", "node", F.lit(1).alias("label")).distinct()
    given = cut(drawn.unionByName(labels.select(F.lit(0).alias("rep"), "node", F.lit(1).alias("label"))))
    scores = X.propagate(None, given, 0.95, 2, plus=True, keys=["rep"], net=net).select("rep", "node", F.round("score", 9).alias("score"))
    real = T.without_positives(scores.filter("rep = 0").select("node", "score"), labels)
    return S.permutation_p(real, scores.filter("rep > 0"))

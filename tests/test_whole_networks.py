"""Queries without SQL read whole tables and whole rankings."""

import duckdb
import numpy as np

from weftgraph.operators import stats
from weftgraph.plans import catalog, graph_queries
from weftgraph.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def test_tau_counts_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(x), float(y)) for k, n, top in (("a", 300, 10**6), ("b", 257, 20), ("c", 2, 9), ("d", 64, 1)) for x, y in rng.integers(0, top, (n, 2))]
    got = {r.alg: r.tau for r in stats.kendall_tau(spark.createDataFrame(rows, "alg string, x double, y double"), ["alg"]).collect()}
    for k in "abcd":
        x, y = np.array([r[1:] for r in rows if r[0] == k]).T
        assert np.isclose(got[k], (np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum() / (len(x) * (len(x) - 1)))
    assert stats.inversions(np.arange(200_000)[::-1]) == 200_000 * 199_999 // 2


def test_tau_reads_the_whole_ranking(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").filter("p_retailprice <> 0").collect()
    rank = {p.p_partkey: k for k, p in enumerate(sorted(part, key=lambda p: (-p.p_retailprice, f"P{p.p_partkey}")))}
    x, y = (np.array(v, float) for v in zip(*((rank[k], k) for k in rank), strict=True))
    want = (np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum() / (len(x) * (len(x) - 1))
    assert len(x) > 100
    got = next(q for q in catalog.QUERIES if q.name == "x5_kendall_tau").run(spark, SF).first().tau
    assert abs(got - want) < 1e-5


def test_trade_network_is_whole(spark):
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "supplier"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute("""select 'C' || c_custkey, 'N' || s_nationkey, count(*)::double from orders join customer on o_custkey = c_custkey
        join lineitem on o_orderkey = l_orderkey join supplier on l_suppkey = s_suppkey group by 1, 2""").fetchall()
    got = {(r.src, r.dst): r.weight for r in graph_queries._trade(Tables(spark, SF)).collect()}
    assert len(got) == 2 * len(want) and all(got[a, b] == got[b, a] == w for a, b, w in want)

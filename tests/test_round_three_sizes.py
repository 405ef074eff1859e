"""What a task holds, and how long loops take, as tables grow."""

import random

from pyspark.sql import functions as F

from weftgraph.operators import graph as G


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_paths_are_reduced_where_they_are_made(spark, monkeypatch):
    """No sort of all of a hub's rows before they are reduced; paths, ties and parents as by hand."""
    rng, rows = random.Random(5), []
    for k in range(60):
        rows += [(f"v{k}", f"h{h}", float(rng.choice([1, 1, 2]))) for h in range(3) if (k + h) % 4]
    rows += [(b, a, c) for a, b, c in rows]
    plans, keep = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: plans.append(_plan(df)) or keep(df))
    sources = ["h0", "v1", "alone"]
    got = {(r.source, r.node): (r.dist, r.hops, r.parent) for r in G.distances(spark.createDataFrame(rows, "src string, dst string, cost double"), spark.createDataFrame([(s,) for s in [*sources, "h0"]], "node string")).collect()}
    want = {(s, s): (0.0, 0, None) for s in sources}
    for s in sources:
        front = {s: want[s, s]}
        while front:
            step = {}
            for a, b, c in rows:
                if a in front:
                    new = (front[a][0] + c, front[a][1] + 1, a)
                    step[b] = min(step.get(b, new), new)
            front = {b: x for b, x in step.items() if (s, b) not in want or x[:2] < want[s, b][:2]}
            want.update({(s, b): x for b, x in front.items()})
    assert got == want
    rounds = [p for p in plans if "Aggregate" in p and "min(" in p]
    assert rounds and all("MapInArrow" in p for p in rounds)


def test_trade_is_counted_by_numbers(spark, monkeypatch):
    """Tasks grow in number with the line items, and no text is a key of a count."""
    from weftgraph.plans import graph_queries as Q
    from weftgraph.sources.tables import Tables

    plans, keep = [], Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df, name: plans.append(_plan(df)) or keep(df, name))
    monkeypatch.setattr(Q, "TASK_LINES", 100)
    t = Tables(spark, "/root/testdata/sf0.001")
    total = Q._trade(t).agg(F.sum("weight")).first()[0]
    assert total == 2 * t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).count()
    n = -(-t.lineitem.count() // 100)
    assert f"hashpartitioning(c_custkey#" in plans[0] and f", {n})" in plans[0] and "keys=[src" not in plans[0]


def test_join_reads_small_batches(spark, monkeypatch):
    """A worker of the join gets a thousand rows at once, not ten thousand sets, and the session's setting is as before."""
    from weftgraph.llm import ngram_join as N

    name, seen, keep = "spark.sql.execution.arrow.maxRecordsPerBatch", [], N.materialize
    before = spark.conf.get(name)
    monkeypatch.setattr(N, "materialize", lambda df, at: seen.append(int(spark.conf.get(name))) or keep(df, at))
    texts = [(k, " ".join(f"w{(k // 2) * 7 + j}" for j in range(40)) + (" more" if k % 2 else "")) for k in range(12)]
    got = sorted(tuple(r) for r in N.link_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == N.brute_force(texts) and seen and max(seen) == 1000
    assert spark.conf.get(name) == before and N.PIECE <= 1 << 18


def test_graph_elements_are_made_by_many_tasks(spark, monkeypatch):
    """Tasks grow in number with the edges, and no join brings a label's nodes together."""
    from weftgraph.sources import graphs as V

    monkeypatch.setattr(V, "TASK_EDGES", 10)
    edges = spark.createDataFrame([(f"a{k}", f"b{k % 7}") for k in range(200)], "src string, dst string")
    nodes = spark.createDataFrame([(f"a{k}", "same") for k in range(200)], "node string, label string")
    made = V.graph_elements(edges, nodes, spark.createDataFrame([("a1", None, "color", "#FF0000")], "item string, other string, style string, value string"))
    plan = _plan(made)
    assert "hashpartitioning(src#" in plan and ", 20)" in plan
    assert not [line for line in plan.splitlines() if "Join" in line and "label#" in line.split("Join", 1)[1].split(",")[0]]
    labels = [r.label for r in made.filter("group = 'nodes'").orderBy("id").collect()]
    assert labels[:2] == ["same", "same-a1"] and len(set(labels)) == 207


def test_rounds_multiply_what_the_last_one_added(spark, monkeypatch):
    """On a network of two sides a round has scores of one side only, and so half of the edges' work; scores as by hand."""
    import numpy as np

    from weftgraph.operators import blocks as B
    from weftgraph.operators import propagate as X

    rng = random.Random(3)
    rows = [(f"s{a}", f"p{b}", float(rng.choice([1, 2, 5]))) for a in range(6) for b in range(30) if (a + b) % 3]
    edges = spark.createDataFrame(rows + [(b, a, w) for a, b, w in rows], "src string, dst string, weight double")
    labels = {(f"t{b % 2}", f"p{b}"): 1 if b % 5 else -1 for b in range(0, 30, 3)}
    sides, keep = [], B.Blocks.products

    def products(net, state):
        found = state.join(net.index, "block").select("node").distinct().collect()
        sides.append({r.node[0] for r in found})
        return keep(net, state)

    monkeypatch.setattr(B.Blocks, "products", products)
    monkeypatch.setattr(X, "MOST_PARTS", 3)
    got = {(r.term, r.node): r.score for r in X.propagate(edges, spark.createDataFrame([(*k, v) for k, v in labels.items()], "term string, node string, label int"), 0.95, 10).collect()}
    assert sides == [{"p"}, {"s"}] * 5
    names = [f"s{a}" for a in range(6)] + [f"p{b}" for b in range(30)]
    w = np.zeros((36, 36))
    for a, b, x in rows:
        w[names.index(a), names.index(b)] = w[names.index(b), names.index(a)] = x
    p, want = w / w.sum(1)[:, None], {}
    for t in ("t0", "t1"):
        fixed = np.array([(t, n) in labels for n in names])
        ones = np.array([labels.get((t, n), 0) > 0 for n in names], float)
        first = s = np.where(fixed, 0, 0.95 * p @ ones)
        for _ in range(9):
            s = np.where(fixed, 0, 0.95 * p @ s) + first
        want |= {(t, n): x for n, x in zip(names, s + ones, strict=True) if x > 0}
    assert got.keys() == want.keys() and max(abs(got[k] - x) for k, x in want.items()) < 1e-12


def test_edge_rows_are_as_long_as_they_may_be(spark):
    """Arrow's batches of ten thousand rows don't cut the edges that are multiplied at once; few lanes make blocks larger."""
    from weftgraph.operators import blocks as B

    edges = spark.range(60000).selectExpr("concat('a', id % 20000) as src", "concat('b', id % 7) as dst", "1.0 as weight")
    net = B.Blocks(edges)
    longest = spark.table(net._table).agg(F.max(F.length("weights") / 8)).first()[0]
    assert longest > 20000  # 60,000 edges from one block of seven nodes, in rows of 32,768
    assert net.seats.agg(F.sum("seats")).first()[0] == 1

"""Networks of hubs and spokes, whose rounds run on the hubs alone, against dense algebra and plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import classify as K
from weftgraph.operators import propagate as X
from weftgraph.operators import spokes as P

LABELS = [("t", "h0", 1), ("t", "h3", -1), ("u", "h1", 1), ("u", "h4", 1), ("w", "h2", -1), ("t", "nowhere", 1)]


@pytest.fixture(scope="module")
def net(spark):
    """Five hubs and sixty spokes, edges among hubs, a loop, and a hub that no positive reaches."""
    rng, rows = random.Random(3), []
    for v in range(60):
        rows += [(f"h{h}", f"v{v}", float(rng.choice([1, 2, 5]))) for h in rng.sample(range(5), rng.choice([1, 2, 3]))]
    rows += [("h0", "h1", 2.0), *[("h8", f"far{v}", 1.0 + v) for v in range(12)]]
    edges = spark.createDataFrame(rows + [(b, a, w) for a, b, w in rows] + [("h2", "h2", 1.0)], "src string, dst string, weight double")
    return edges, spark.createDataFrame(LABELS, "term string, node string, label int")


def _dense(edges):
    rows = edges.collect()
    names = sorted({r.src for r in rows} | {r.dst for r in rows})
    w = np.zeros((len(names), len(names)))
    for r in rows:
        w[names.index(r.src), names.index(r.dst)] += r.weight
    return names, w


def _refuse(*_, **__):
    raise AssertionError("multiplied by joins of all edges")


def _scores(df):
    found = df.collect()
    assert len({(r.term, r.node) for r in found}) == len(found)
    return {(r.term, r.node): r.score for r in found}


def _same(got, want, tol=1e-8):
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < tol


def _sides(term, plus):
    ones = {n for t, n, y in LABELS if t == term and y > 0}
    return ones, ones if plus else {n for t, n, _ in LABELS if t == term}


def _fixed_point(names, w, alpha, plus, lam=0.0):
    d, out = w.sum(1) + lam * w.max(), {}
    for term in ("t", "u", "w"):
        ones, fixed = _sides(term, plus)
        free = [k for k, n in enumerate(names) if n not in fixed]
        p = alpha * w / d[:, None]
        f = p[np.ix_(free, [k for k, n in enumerate(names) if n in ones])].sum(1)
        x = np.linalg.solve(np.eye(len(free)) - p[np.ix_(free, free)], f)
        out.update({(term, names[k]): v for k, v in zip(free, x, strict=True) if abs(v) > 1e-12})
        out.update({(term, n): 1.0 for n in ones})
    return out


@pytest.mark.parametrize(("solver", "lam", "plus"), [("cg", 0.1, False), ("bicgstab", 0.0, True), ("directed", 0.1, False), ("semi", 0.1, False)])
def test_solvers_run_on_hubs(net, monkeypatch, solver, lam, plus):
    monkeypatch.setattr(X, "spread", _refuse)
    edges, labels = net
    if solver == "directed":
        edges = edges.withColumn("weight", F.col("weight") * F.when(F.col("src") < F.col("dst"), 2).otherwise(1))
        with pytest.raises(ValueError, match="symmetric"):
            X.solve(edges, labels, 0.8, "cg")
        with pytest.raises(ValueError, match="symmetric"):
            X.settle(edges, labels, 0.8)
    found = X.settle(edges, labels, 0.8, 1e-11, plus=plus, lam=lam) if solver == "semi" else X.solve(edges, labels, 0.8, "cg" if solver == "cg" else "bicgstab", 1e-12, plus=plus, lam=lam)
    _same(_scores(found), _fixed_point(*_dense(edges), 0.8, plus, lam))


def test_other_networks_are_not_hubs_and_spokes(spark, net):
    edges, labels = net
    assert P.spokes_of(edges, labels, ["term"]).width == 7  # with the label outside and the hub without one
    ring = spark.createDataFrame([(f"r{k}", f"r{(k + d) % 30}", 1.0) for k in range(30) for d in (1, 29)], edges.schema)
    ring_labels = spark.createDataFrame([("t", "r0", 1)], labels.schema)
    assert P.spokes_of(ring, ring_labels, ["term"]) is None
    assert P.spokes_of(edges.withColumn("weight", -F.col("weight")), labels, ["term"]) is None
    assert P.spokes_of(edges, labels.limit(0), ["term"]) is None


def _rounds(names, w, alpha, last, plus):
    """Statistics of rounds by one sort of all scores: {(term, round): (unranked, stretch, change, ub)}, scores of each."""
    p, out, states = alpha * w / w.sum(1)[:, None], {}, {}
    for term in ("t", "u", "w"):
        ones, fixed = _sides(term, plus)
        x = np.array([float(n in ones) for n in names])
        has, free = x > 0, np.array([n not in fixed for n in names])
        old, top = np.zeros(len(names)), None
        for k in range(1, last + 1):
            has = ((w > 0).astype(float) @ has > 0) & free | np.array([n in ones for n in names])
            x = np.where(free, p @ x, [float(n in ones) for n in names])
            mine = has & free
            if not mine.any():
                break
            top = x[mine].max() if top is None else top
            ub, v = alpha**k / (1 - alpha) * top, np.sort(x[mine])
            near = v[:-1] + ub >= v[1:]
            open_ = np.concatenate((near, [False])) | np.concatenate(([False], near))
            stretch = max(map(len, "".join("x" if o else " " for o in open_).split()), default=0)
            out[term, k] = int(open_.sum()), stretch, (x - old)[mine].max(), ub
            states[term, k] = {n: x[i] for i, n in enumerate(names) if mine[i]}
            old = x
    return out, states


@pytest.mark.filterwarnings("ignore:bounds")
@pytest.mark.parametrize(("plus", "ranges", "ordered"), [(False, 1 << 20, 1 << 21), (True, 12, 1)])
def test_bounds_are_told_by_hubs(spark, monkeypatch, plus, ranges, ordered):
    """Scores that differ much more than doubles do, so that no order depends on how sums were rounded; in one range and in many."""
    monkeypatch.setattr(X, "spread", _refuse)
    monkeypatch.setattr(P, "RANGE", ranges)
    monkeypatch.setattr(P, "ORDERED", ordered)
    monkeypatch.setattr(P, "TILE", 16)
    rng, rows = random.Random(8), []
    for v in range(60):
        rows += [(f"h{h}", f"v{v}", rng.random()) for h in rng.sample(range(5), rng.choice([2, 3, 4]))]
    rows += [("h0", "h1", 0.7), ("h8", "far", 1.0), ("h8", "v1", 0.3)]
    edges = spark.createDataFrame(rows + [(b, a, x) for a, b, x in rows], "src string, dst string, weight double")
    edges = edges.filter("src not in ('h8', 'far') and dst not in ('h8', 'far')")
    labels = spark.createDataFrame(LABELS, "term string, node string, label int")
    names, w = _dense(edges)
    scores, told = X.bounds(edges, labels, 0.5, 30, plus=plus, compare=True)
    got = {(r.term, r["round"]): r for r in told.collect()}
    want, states = _rounds(names, w, 0.5, max(r["round"] for r in got.values()), plus)
    assert got.keys() == want.keys() and len({k for _, k in got}) >= 20
    for key, (unranked, stretch, change, ub) in want.items():
        r = got[key]
        assert (r.unranked, r.stretch) == (unranked, stretch), (key, r, want[key])
        assert abs(r.change - change) < 1e-12 and abs(r.ub - ub) < 1e-12
        last = states[key[0], max(k for t, k in want if t == key[0])]
        x, y = (np.array([s[n] for n in sorted(states[key])]) for s in (states[key], last))
        pairs = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
        assert abs(r.tau - pairs.sum() / (len(x) * (len(x) - 1))) < 1e-9
    last = {(t, n): v for t in ("t", "u", "w") for n, v in states.get((t, max((k for s, k in want if s == t), default=0)), {}).items()}
    _same(_scores(scores), last | {(t, n): 1.0 for t, n, y in LABELS if y > 0}, 1e-12)


@pytest.mark.parametrize("loss", ["logistic", "svm"])
def test_machines_are_trained_on_hubs(net, monkeypatch, loss):
    """The same gradient steps as on all nodes, to the same round."""
    monkeypatch.setattr(K, "spread", _refuse)
    edges, labels = net
    got = _scores(K.network_scores(edges, labels, loss, 2.0, 0.05))
    names, w = _dense(edges)
    s, want, terms = w / np.sqrt(np.outer(w.sum(1), w.sum(1))), {}, {}
    curve, far = (0.25 if loss == "logistic" else 2.0) * 2.0, np.inf
    for term in ("t", "u"):
        rows = [(names.index(n) if n in names else -1, y) for t, n, y in LABELS if t == term]
        terms[term] = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.zeros(len(names)), 0.0
    rounds = 0
    while far > 0.05:
        far, rounds = 0.0, rounds + 1
        for term, (at, y, x, bias) in terms.items():
            margin = y * (np.where(at < 0, 0.0, (s @ x)[at]) + bias)
            pull = 2.0 * (y / (1 + np.exp(margin)) if loss == "logistic" else 2 * y * np.maximum(0.0, 1 - margin))
            v = np.zeros(len(names))
            np.add.at(v, at[at >= 0], pull[at >= 0])
            change = (s @ v - x) / (1 + 2 * curve)
            terms[term] = at, y, x + change, bias + pull.sum() / (2 * curve * len(y))
            far = max(far, np.abs(change).max(), abs(pull.sum()) / len(y))
    for term, (at, y, x, bias) in terms.items():
        v = s @ x + bias
        want |= {(term, n): (1 / (1 + np.exp(-v[k])) if loss == "logistic" else v[k]) for k, n in enumerate(names) if k not in at}
        want |= {(term, n): 1.0 for t, n, y in LABELS if t == term and y > 0}
    assert 2 < rounds < 100
    _same(got, want, 1e-9)

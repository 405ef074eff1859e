"""Runs from a configuration: parameter lists to runs, algorithms by name."""

from __future__ import annotations

import time
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.lineage import materialize
from weftgraph.operators import classify as K
from weftgraph.operators import propagate as X


def _sinksource(e: DataFrame, y: DataFrame, plus: bool = False, solver: str | None = None, **p) -> DataFrame:
    """Rounds, or the fixed point at once if a solver is asked for."""
    if solver is None:
        return X.propagate(e, y, plus=plus, **p)
    return X.solve(e, y, plus=plus, solver=solver, **{k: v for k, v in p.items() if k not in ("rounds", "eps")})


#: Names of algorithms; those with `plus` leave negatives out.
ALGORITHMS = {
    "local": lambda e, y, n, **p: X.local(e, y),
    "localplus": lambda e, y, n, **p: X.local(e, y, plus=True),
    "fastsinksource": lambda e, y, n, **p: _sinksource(e, y, **p),
    "fastsinksourceplus": lambda e, y, n, **p: _sinksource(e, y, plus=True, **p),
    "sinksource": lambda e, y, n, **p: _sinksource(e, y, **p),
    "sinksourceplus": lambda e, y, n, **p: _sinksource(e, y, plus=True, **p),
    "genemania": lambda e, y, n, **p: X.genemania(e, y, n, **p),
    "genemaniaplus": lambda e, y, n, **p: X.regularised_laplacian(e, y, **p),
    "rl": lambda e, y, n, **p: X.regularised_laplacian(e, y, **p),
    "sinksource_bounds": lambda e, y, n, **p: X.bounds(e, y, **p)[0],
    "sinksourceplus_bounds": lambda e, y, n, **p: X.bounds(e, y, plus=True, **p)[0],
    "logistic_regression": lambda e, y, n, **p: K.network_scores(e, y, "logistic", nodes=n, **p),
    "svm": lambda e, y, n, **p: K.network_scores(e, y, "svm", nodes=n, **p),
}


def expand(settings: dict[str, dict], only: list[str] | None = None) -> list[tuple[str, dict]]:
    """(algorithm, parameters) for every combination of listed values of the algorithms that should run."""
    runs = []
    for name, given in settings.items():
        params = {k: v if isinstance(v, list) else [v] for k, v in given.items() if k != "should_run"}
        chosen = name.lower() in [o.lower() for o in only] if only else (given.get("should_run") or [False])[0] is True
        if chosen:
            if name.lower() not in ALGORITHMS:
                raise ValueError(f"no such algorithm: {name}")
            runs += [(name.lower(), dict(zip(params, values, strict=True))) for values in product(*params.values())]
    return runs


def label_of(params: dict) -> str:
    """The parameters as part of a file's name."""
    return "".join(f"-{k}{v}" for k, v in sorted(params.items())).replace(".", "_")


def run_all(edges: DataFrame, labels: DataFrame, nodes: DataFrame, settings: dict[str, dict], only: list[str] | None = None, times: str | None = None) -> DataFrame:
    """(alg, params, term, node, score) of all runs of a configuration.

    times: a path that a row (alg, params, seconds) is added to for each run, which is then made on its own."""
    out = None
    for name, params in expand(settings, only):
        began = time.time()
        one = ALGORITHMS[name](edges, labels, nodes, **params).select(F.lit(name).alias("alg"), F.lit(label_of(params)).alias("params"), "term", "node", "score")
        if times:
            one = materialize(one, "scores")
            row = [(name, label_of(params), time.time() - began)]
            edges.sparkSession.createDataFrame(row, "alg string, params string, seconds double").coalesce(1).write.mode("append").parquet(times)
        out = one if out is None else out.unionByName(one)
    return out

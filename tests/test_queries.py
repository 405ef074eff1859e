"""Every query of the catalogue against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from weftgraph.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) == "<NA>":
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("query", [q for q in catalog.QUERIES if q.sql], ids=lambda q: q.name)
def test_equals_sql(spark, duck, query):
    ours, theirs = query.run(spark, SF).toPandas(), duck.execute(query.sql).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = [sorted((tuple(map(_plain, r)) for r in t[columns].itertuples(index=False)), key=repr) for t in (ours, theirs)]
    assert rows[0] == rows[1] and rows[0]


@pytest.mark.parametrize("query", [q for q in catalog.QUERIES if not q.sql and q.name in ("t1_uniform_bins", "t3_matched_sets", "w2_term_weights", "w3_shared_weights", "x8_logistic_regression", "x5_kendall_tau")], ids=lambda q: q.name)
def test_has_rows(spark, query):
    assert query.run(spark, SF).count() > 0


def test_names_are_unique():
    names = [q.name for q in catalog.QUERIES]
    assert len(names) == len(set(names))

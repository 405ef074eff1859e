"""Sessions against a click-by-click version: dense and sparse clients, many chunks, late and repeated clicks, ties, nulls, empty tables."""

import random
from datetime import datetime, timedelta

import pytest

from weftgraph.llm import sessions as S

SCHEMA = "click_id bigint, ts timestamp_ntz, arrived_at timestamp_ntz, client_id bigint, kind string, value double, chunk string, final int"
EPOCH = datetime(1970, 1, 1)


def _table(spark, rows):
    at = lambda us: None if us is None else EPOCH + timedelta(microseconds=us)
    return spark.createDataFrame([(i, at(t), at(a), who, kind, v, "x", 7) for i, t, a, who, kind, v in rows], SCHEMA)


def _clicks(seed: int, n: int):
    rng, rows = random.Random(seed), []
    for i in range(n):
        who = rng.choice([1, 1, 1, 2, 2, 2, 2, 2, 2, 3, None] + list(range(10, 30)))
        # Client 1 has clicks every few minutes for two days, with hardly a gap; the length rule ends its sessions.
        span = 2_880 if who == 1 else 200 if who == 2 else 100_000
        t = None if rng.random() < 0.01 else 1_700_000_000_000_000 + rng.randrange(span * 2) * 30_000_000
        a = None if rng.random() < 0.05 or t is None else t + rng.choice([1_000_000, 3_600_000_000, 3_600_000_001, 9_000_000_000])
        v = rng.choice([None, 60.0, 59.99, -3.005, 1e6, 0.125])
        rows.append((i * 7 % 10_007, t, a, who, rng.choice(["view", "view", "view", "view", "purchase", None]) if who != 2 else "view", v))
    return rows + rows[:40]


@pytest.mark.parametrize(("seed", "n", "chunk_rows"), [(1, 3000, 5), (2, 3000, 64), (3, 3000, 2), (4, 3000, 100_000)])
def test_equals_click_by_click(spark, seed, n, chunk_rows):
    rows = _clicks(seed, n)
    got = sorted(map(tuple, S.sessions(_table(spark, rows), chunk_rows=chunk_rows).collect()))
    assert got == S.brute_force(rows)
    reasons = {r[7] for r in got}
    assert {"end", "gap", "length"} <= reasons


def test_long_runs_without_certain_breaks(spark):
    """Clicks a minute apart for three days, in chunks of minutes: all depends on the state that comes in."""
    rows = [(k, 1_600_000_000_000_000 + k * 61_000_000, None, 5, "view", 1.0) for k in range(3 * 1440)]
    rows += [(10_000 + k, 1_600_000_000_000_000 + k * 61_000_000, 1_700_000_000_000_000, 5, "view", 1.0) for k in range(0, 4000, 7)]
    got = sorted(map(tuple, S.sessions(_table(spark, rows), chunk_rows=3).collect()))
    assert got == S.brute_force(rows)
    assert {r[7] for r in got} == {"length", "none"}


def test_compose_is_associative():
    rng, rule = random.Random(9), S.Rule(5, 20, 60)
    import numpy as np

    def stretch(t):
        n = rng.randrange(0, 6)
        ts = []
        for _ in range(n):
            t += rng.choice([0, 1, 2, 4])
            ts.append(t)
        return (S.map_of(np.array(ts), np.array([rng.randrange(1000) for _ in ts]), rng.random() < 0.1, rule) if ts else None), t + rng.choice([0, 1, 3, 5])

    for _ in range(300):
        t, maps = 0, []
        for _ in range(3):
            m, t = stretch(t)
            maps.append(m)
        a, b, c = maps
        left, right = S.compose(S.compose(a, b, rule), c, rule), S.compose(a, S.compose(b, c, rule), rule)
        assert (left is None) == (right is None)
        if left is not None:
            assert (left.first, left.last, left.final, left.fresh) == (right.first, right.last, right.final, right.fresh)
            for began in range(left.first - 24, left.first + 1):
                assert left.of((began, -1)) == right.of((began, -1))


def test_empty_and_null_tables(spark):
    assert S.sessions(_table(spark, [])).collect() == []
    assert S.sessions(_table(spark, [(None, 5, None, 1, "view", 1.0), (1, None, None, 1, "view", 1.0), (2, 5, None, None, "view", 1.0)])).collect() == []
    only_late = [(1, 1_000_000, 9_000_000_000, 1, "view", 1.0)]
    assert S.sessions(_table(spark, only_late)).collect() == []
    zoned = spark.sql("select 1L click_id, timestamp'2024-03-10 12:00:00' ts, timestamp'2024-03-10 12:00:01' arrived_at, 4L client_id, 'purchase' kind, 60D value")
    row = S.sessions(zoned).first()
    assert (row.closed_by, row.value_cents, row.start_us) == ("end", 6000, 1_710_072_000_000_000)

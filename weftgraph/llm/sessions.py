"""Gap sessionisation: time chunks summarised as piecewise maps, a prefix scan of the maps, replay of what depended on it.

A client's clicks are cut into chunks of time, so that a busy client's chunks go to many tasks. What a chunk makes of the
session it meets is a map: the state before it (its last click, whether that was final, the open session's first click)
goes to the state after it. Only the open session's first click matters beyond the chunk's first click, and only to the
length rule, so that the map is a list of pieces: for first clicks before a bound the open session is such, beyond the last
bound the incoming session goes on. A final click or a gap inside a chunk makes the map constant.

Maps of `FAN` chunks are composed, then maps of these groups, until each client has one; on the way down each chunk gets
the state before it. From there its clicks up to its first final click or gap are replayed; the sessions after that begin
where they begin whatever came before, and are made with the map, in one pass over the clicks. Sessions that cross chunks are
folded from their parts, read in order.

Defined results: clicks without an id, a client or a time take no part; of rows that share an id the least by time, client,
arrival, finality and value counts, others are repeats of it. A null arrival is timely, a null kind or value is not final and
a null value is 0. Equal times are ordered by click id; a late click at the time of a session's first belongs to it. A client
without timely clicks has no session. An empty table gives an empty table. Other columns, whatever their names, are not read.

Bounds: a task holds one chunk, about `chunk_rows` clicks by the client's busiest day, and more only where more clicks of one
client come within a minute. A map has no more pieces than its client has clicks within one session length with neither gap
nor final click between.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._common import materialize

#: Clicks of a chunk, on a client's busiest day; clients share chunk widths by hash in so many classes; chunks composed at once.
CHUNK_ROWS, CLASSES, FAN = 2048, 4096, 64
#: Rows that a task gives out at once.
ROWS = 4096
DAY = 86_400_000_000
MINUTE = 60_000_000


@dataclass(frozen=True)
class Rule:
    """When sessions end: at least `gap` after the last click, over `length` after the first; clicks are late after `late` (microseconds)."""

    gap: int = 5 * MINUTE
    length: int = 120 * MINUTE
    late: int = 60 * MINUTE


@dataclass
class Map:
    """What a stretch of clicks makes of the state before it.

    first, last, final: its first and last click's time and whether the last is final. fresh: the open session after it, as
    (time, id) of the first click, if a session begins with its first click. fixed: the open session after it is `fresh`,
    whatever came before. Otherwise an open session that began before bounds[k], and not before bounds[k - 1], becomes outs[k];
    one that began later goes on."""

    first: int
    last: int
    final: bool
    fresh: tuple[int, int]
    fixed: bool
    bounds: list[int]
    outs: list[tuple[int, int]]

    def of(self, began: tuple[int, int]) -> tuple[int, int]:
        if self.fixed:
            return self.fresh
        k = bisect_right(self.bounds, began[0])
        return self.outs[k] if k < len(self.outs) else began


def _joined(bounds: list[int], outs: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """Neighbouring pieces with one outcome as one piece."""
    keep = [k for k in range(len(outs)) if k + 1 == len(outs) or outs[k] != outs[k + 1]]
    return [bounds[k] for k in keep], [outs[k] for k in keep]


def compose(a: Map | None, b: Map | None, rule: Rule) -> Map | None:
    """The map of a stretch followed by another; None is the map of a stretch without timely clicks."""
    if a is None or b is None:
        return b if a is None else a
    if a.final or b.first - a.last >= rule.gap:
        return Map(a.first, b.last, b.final, b.fresh, True, [], [])
    fresh = b.of(a.fresh)
    if a.fixed or b.fixed:
        return Map(a.first, b.last, b.final, fresh, True, [], [])
    bounds, outs = list(a.bounds), [b.of(x) for x in a.outs]
    for bound, out in zip(b.bounds, b.outs, strict=True):
        if bounds and bounds[-1] > a.first:
            break  # no session begins after the stretch's first click and before it
        if not bounds or bound > bounds[-1]:
            bounds.append(bound)
            outs.append(out)
    return Map(a.first, b.last, b.final, fresh, False, *_joined(bounds, outs))


def map_of(ts: np.ndarray, ids: np.ndarray, final: bool, rule: Rule) -> Map:
    """The map of clicks in order with neither gap nor final click between them."""
    heads, at = np.unique(ts, return_index=True)
    bounds = heads - rule.length
    upto = int(np.searchsorted(bounds, ts[0], side="right")) + 1
    bounds, at = bounds[:upto], at[:upto]
    while True:  # from each break to the next, until the last
        nxt = np.searchsorted(ts, ts[at] + rule.length, side="right")
        if (nxt == len(ts)).all():
            break
        at = np.where(nxt < len(ts), nxt, at)
    outs = list(zip(ts[at].tolist(), ids[at].tolist(), strict=True))
    return Map(int(ts[0]), int(ts[-1]), final, outs[0], False, *_joined(bounds.tolist(), outs))


def breaks(ts: np.ndarray, began: int, rule: Rule) -> list[int]:
    """Places at which the length rule begins sessions, if the open one began at a time; no gap or final click between."""
    found = []
    while (k := int(np.searchsorted(ts, began + rule.length, side="right"))) < len(ts):
        found.append(k)
        began = int(ts[k])
    return found


MAP = "first_us bigint, last_us bigint, last_final boolean, fresh_us bigint, fresh_id bigint, fixed boolean, bounds array<bigint>, out_us array<bigint>, out_id array<bigint>"
PART = "client_id bigint, session_id bigint, chunk bigint, start_us bigint, end_us bigint, n_clicks bigint, n_late bigint, value_cents bigint, path string, closed_by string, final boolean"
HEAD = "head_us array<bigint>, head_id array<bigint>, head_cents array<bigint>, head_late array<bigint>, head_close string"
_TYPES = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(", "))])


def _flat(m: Map | None) -> tuple:
    if m is None:
        return (None,) * 9
    return m.first, m.last, m.final, *m.fresh, m.fixed, m.bounds, [x for x, _ in m.outs], [x for _, x in m.outs]


def _map(row: dict) -> Map | None:
    if row["first_us"] is None:
        return None
    outs = list(zip(row["out_us"], row["out_id"], strict=True))
    return Map(row["first_us"], row["last_us"], row["last_final"], (row["fresh_us"], row["fresh_id"]), row["fixed"], row["bounds"], outs)


class _Out:
    """Rows given out as record batches of a schema."""

    def __init__(self, text: str):
        self.schema, self.rows = _schema(text), []

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            columns = list(zip(*self.rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
            self.rows = []


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut between values of the first columns: groups are never parted."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        change = np.zeros(batch.num_rows, bool)
        for c in columns[:keys]:
            change[1:] |= c[1:] != c[:-1]
        if held and any(columns[k][0] != held[-1][k][-1] for k in range(keys)):
            change[0] = True
        at = np.flatnonzero(change)
        if len(at):
            cut = int(at[-1])
            whole = [*held, [c[:cut] for c in columns]]
            yield [np.concatenate(x) for x in zip(*whole, strict=True)]
            held = []
            columns = [c[cut:] for c in columns]
        held.append(columns)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _digest(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()


def _summarise(rule: Rule):
    """One pass over chunks: whole sessions (kind 0), the session still open at a chunk's end (1), the chunk's map and head (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(f"kind bigint, {PART}, {MAP}, {HEAD}")
        for client, chunk, ts, ids, late, final, cents in _whole_groups(batches, 2):
            new = np.ones(len(ts), bool)
            new[1:] = (client[1:] != client[:-1]) | (chunk[1:] != chunk[:-1])
            group = np.cumsum(new) - 1
            row = np.flatnonzero(~late)
            g, t, i, f, c = group[row], ts[row], ids[row], final[row], cents[row]
            n = len(row)
            opens, gap = np.ones(n, bool), np.zeros(n, bool)
            opens[1:] = g[1:] != g[:-1]
            gap[1:] = t[1:] - t[:-1] >= rule.gap
            hard = opens | gap
            hard[1:] |= f[:-1]
            begin = np.flatnonzero(hard)
            end = np.append(begin[1:], n)
            starts = hard.copy()
            for k in np.flatnonzero(~opens[begin] & (t[end - 1] - t[begin] > rule.length)) if n else ():
                a = begin[k]
                starts[[a + x for x in breaks(t[a : end[k]], int(t[a]), rule)]] = True
            s = np.flatnonzero(starts)
            e = np.append(s[1:], n)[: len(s)]
            head, last = opens[s], np.append(g[s[1:]] != g[s[:-1]], True)[: len(s)]
            session = np.cumsum(starts) - 1

            late_rows = np.flatnonzero(late)
            before = np.cumsum(~late)[late_rows] - 1
            known = before >= 0
            known[known] = g[before[known]] == group[late_rows][known]
            owner = np.full(len(late_rows), -1)
            owner[known] = session[before[known]]
            settled = (owner >= 0) & ~head[owner] if len(s) else np.zeros(len(owner), bool)
            n_late = np.bincount(owner[settled], minlength=len(s))
            total = np.add.reduceat(c, s) if len(s) else c
            names = list(map(str, i.tolist()))
            first_row = np.flatnonzero(new)
            of_client, of_chunk = client[first_row].tolist(), chunk[first_row].tolist()

            none = (None,) * 14
            for k in np.flatnonzero(~head).tolist():
                a, b, w = s[k], e[k], g[s[k]]
                path = ",".join(names[a:b])
                why = None if last[k] else "end" if f[b - 1] else "gap" if gap[b] else "length"
                part = (of_client[w], i[a], of_chunk[w], t[a], t[b - 1], b - a, n_late[k], total[k], path if last[k] else _digest(path), why, f[b - 1])
                out.rows.append((int(last[k]), *part, *none))
            yield from out.batches(ROWS)

            lates = np.split(ts[late_rows[~settled]], np.searchsorted(group[late_rows[~settled]], np.arange(1, len(first_row))))
            bounds = np.searchsorted(g, np.arange(len(first_row) + 1))
            for w, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                made, upto, why = None, a, None
                if a < b:
                    k = int(session[a])
                    upto = int(e[k])
                    if last[k]:
                        made = map_of(t[a:b], i[a:b], bool(f[b - 1]), rule)
                    else:
                        z = s[session[b - 1]]
                        made = Map(int(t[a]), int(t[b - 1]), bool(f[b - 1]), (int(t[z]), int(i[z])), True, [], [])
                        why = "end" if f[upto - 1] else "gap"
                of_head = t[a:upto].tolist(), i[a:upto].tolist(), c[a:upto].tolist(), lates[w].tolist(), why
                out.rows.append((2, of_client[w], None, of_chunk[w], *(None,) * 8, *_flat(made), *of_head))
            yield from out.batches(ROWS)
        yield from out.batches()

    return run


def _compose_groups(rule: Rule):
    """For each row the map of the rows before it in its group, and for each group the map of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(f"client_id bigint, grp bigint, node bigint, {MAP}")
        key, upto = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if key != (row["client_id"], row["grp"]):
                    if key is not None:
                        out.rows.append((*key, None, *_flat(upto)))
                    key, upto = (row["client_id"], row["grp"]), None
                out.rows.append((*key, row["node"], *_flat(upto)))
                upto = compose(upto, _map(row), rule)
            yield from out.batches(ROWS)
        if key is not None:
            out.rows.append((*key, None, *_flat(upto)))
        yield from out.batches()

    return run


STATE = "was_us bigint, was_final boolean, open_us bigint, open_id bigint"


def _state(row: dict) -> Map | None:
    if row["was_us"] is None:
        return None
    return Map(row["was_us"], row["was_us"], row["was_final"], (row["open_us"], row["open_id"]), True, [], [])


def _apply(rule: Rule):
    """The state before a row: that before its group, through the map of the rows before it in the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(f"client_id bigint, node bigint, {STATE}")
        for batch in batches:
            for row in batch.to_pylist():
                m = compose(_state(row), _map(row), rule)
                out.rows.append((row["client_id"], row["node"], *((m.last, m.final, *m.fresh) if m else (None,) * 4)))
            yield from out.batches()

    return run


def states_before(chunks: DataFrame, rule: Rule) -> DataFrame:
    """(client_id, node, was_us, was_final, open_us, open_id): the state before each chunk, null where nothing timely came before.

    A prefix scan: maps of FAN neighbours are composed in one task, level by level, as often as the chunk numbers' span asks."""
    low, high = chunks.agg(F.min("node"), F.max("node")).first()
    if low is None:
        return chunks.sparkSession.createDataFrame([], f"client_id bigint, node bigint, {STATE}")
    levels, rows = [], chunks
    while True:
        low, high = low // FAN, high // FAN
        grouped = rows.withColumn("grp", F.floor(F.col("node") / FAN)).repartition("client_id", "grp").sortWithinPartitions("client_id", "grp", "node")
        made = materialize(grouped.mapInArrow(_compose_groups(rule), f"client_id bigint, grp bigint, node bigint, {MAP}"), "scan")
        levels.append(made.filter("node is not null"))
        if low == high:
            break
        rows = made.filter("node is null").drop("node").withColumnRenamed("grp", "node")
    states = None
    for level in reversed(levels):
        if states is None:
            level = level.selectExpr("*", *(f"cast(null as {kind}) as {name}" for name, kind in (x.split() for x in STATE.split(", "))))
        else:
            level = level.join(states.withColumnRenamed("node", "grp"), ["client_id", "grp"], "left")
        states = level.mapInArrow(_apply(rule), f"client_id bigint, node bigint, {STATE}")
    return states


def _replay(rule: Rule):
    """Parts of sessions in a chunk's head, by the state before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(PART)
        for batch in batches:
            for row in batch.to_pylist():
                ts, ids, cents = np.array(row["head_us"], np.int64), row["head_id"], row["head_cents"]
                was, at = _state(row), []
                why = None
                if len(ts):
                    if was is None or was.final or ts[0] - was.last >= rule.gap:
                        at = [0, *breaks(ts, int(ts[0]), rule)]
                        why = None if was is None else "end" if was.final else "gap"
                    else:
                        at = breaks(ts, was.fresh[0], rule)
                        why = "length" if at else row["head_close"]
                late = np.searchsorted(ts[at], np.array(row["head_late"], np.int64), side="right").tolist()
                if was is not None:
                    upto = at[0] if at else len(ts)
                    own = (int(ts[upto - 1]), upto, late.count(0), sum(cents[:upto]), ",".join(map(str, ids[:upto]))) if upto else (None, 0, late.count(0), 0, "")
                    final = bool(row["last_final"]) and upto == len(ts) and not row["fixed"] if upto else None
                    if upto or own[2] or why:
                        out.rows.append((row["client_id"], was.fresh[1], row["chunk"], was.fresh[0], *own, why, final))
                for k, a in enumerate(at):
                    b = at[k + 1] if k + 1 < len(at) else len(ts)
                    closed = "length" if k + 1 < len(at) else row["head_close"]
                    final = bool(row["last_final"]) and b == len(ts) and not row["fixed"]
                    own = int(ts[a]), int(ts[b - 1]), b - a, late.count(k + 1), sum(cents[a:b]), ",".join(map(str, ids[a:b]))
                    out.rows.append((row["client_id"], ids[a], row["chunk"], *own, closed, final))
            yield from out.batches(ROWS)
        yield from out.batches()

    return run


SESSION = "client_id bigint, session_id bigint, start_us bigint, end_us bigint, n_clicks bigint, n_late bigint, value_cents bigint, closed_by string, path_sha256 string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sessions of their parts in order; what is held of one does not grow with its clicks."""
    out, key, held, digest = _Out(SESSION), None, None, None

    def done() -> None:
        start, end, n, late, cents, why, final = held
        out.rows.append((*key, start, end, n, late, cents, why or ("end" if final else "none"), digest.hexdigest()))

    for batch in batches:
        for row in batch.to_pylist():
            if key != (row["client_id"], row["session_id"]):
                if key is not None:
                    done()
                key, held, digest = (row["client_id"], row["session_id"]), [row["start_us"], None, 0, 0, 0, None, False], hashlib.sha256()
            if row["n_clicks"]:
                digest.update((b"," if held[2] else b"") + row["path"].encode())
                held[1], held[6] = row["end_us"], row["final"]
            held[2] += row["n_clicks"]
            held[3] += row["n_late"]
            held[4] += row["value_cents"]
            held[5] = held[5] or row["closed_by"]
        yield from out.batches(ROWS)
    if key is not None:
        done()
    yield from out.batches()


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 UTC of a timestamp column; one without a zone counts as UTC, whatever the session's zone."""
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(F.col(f"`{name}`").cast("timestamp"))
    return F.expr(f"cast(cast(`{name}` - timestamp_ntz'1970-01-01' as decimal(18, 6)) * 1000000 as bigint)")


def sessions(clicks: DataFrame, final: Column | None = None, rule: Rule | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Sessions of clicks (click_id, ts, arrived_at, client_id, kind, value): a row each, as the module says.

    final: which clicks end their session, by default purchases of 60 or more. Clients without sessions have no row."""
    rule = rule or Rule()
    final = (F.col("value") >= 60) & (F.col("kind") == "purchase") if final is None else final
    cents = F.when(F.isnan("value"), 0).otherwise(F.floor(100 * F.col("value").cast("double") + 0.5).cast("long"))
    rows = clicks.filter("click_id is not null and client_id is not null and ts is not null").select(
        F.col("click_id").cast("long"), F.col("client_id").cast("long"), micros(clicks, "ts").alias("us"), micros(clicks, "arrived_at").alias("arrived"),
        F.coalesce(final, F.lit(False)).alias("final"), F.coalesce(cents, F.lit(0)).alias("cents"),
    )
    kind = F.pmod(F.xxhash64("client_id"), F.lit(CLASSES))
    # A row for each class: the most clicks that a client of it has on one day.
    busy = rows.groupBy("client_id", F.floor(F.col("us") / DAY).alias("day")).count().groupBy(kind.alias("class")).agg(F.max("count").alias("most"))
    width = F.greatest(F.lit(MINUTE), F.floor(F.lit(DAY) * chunk_rows / F.col("most"))).cast("long")
    once = rows.groupBy("click_id").agg(F.min(F.struct("us", "client_id", "arrived", "final", "cents")).alias("c")).select("click_id", "c.*")
    chunked = once.withColumn("class", kind).join(F.broadcast(busy.select("class", width.alias("width"))), "class").select(
        "client_id", F.floor(F.col("us") / F.col("width")).cast("long").alias("chunk"), "us", "click_id",
        F.coalesce(F.col("arrived") - F.col("us") > rule.late, F.lit(False)).alias("late"), "final", "cents",
    )
    dealt = chunked.repartition("client_id", "chunk").sortWithinPartitions("client_id", "chunk", "us", "late", "click_id")
    made = materialize(dealt.mapInArrow(_summarise(rule), f"kind bigint, {PART}, {MAP}, {HEAD}"), "chunks")
    names = [x.split()[0] for x in MAP.split(", ")]
    chunks = made.filter("kind = 2")
    states = states_before(chunks.select("client_id", F.col("chunk").alias("node"), *names), rule).withColumnRenamed("node", "chunk")
    heads = chunks.select("client_id", "chunk", "last_final", "fixed", *(x.split()[0] for x in HEAD.split(", ")))
    parts = heads.join(states, ["client_id", "chunk"], "left").mapInArrow(_replay(rule), PART)
    parts = parts.unionByName(made.filter("kind = 1").select(*(x.split()[0] for x in PART.split(", "))))
    folded = parts.repartition("client_id", "session_id").sortWithinPartitions("client_id", "session_id", "chunk").mapInArrow(_fold, SESSION)
    whole = made.filter("kind = 0").withColumnRenamed("path", "path_sha256")
    return whole.select(*folded.columns).unionByName(folded)


def brute_force(clicks: list[tuple[int, int | None, int | None, int | None, str | None, float | None]]) -> list[tuple]:
    """Sessions of (click_id, ts, arrived_at, client_id, kind, value), times in microseconds, click by click; for tests."""
    import math

    once = {}
    for i, t, a, who, kind, v in clicks:
        if i is not None and t is not None and who is not None:
            cents = 0 if v is None or math.isnan(v) else math.floor(100 * v + 0.5)
            x = (t, who, (a is not None, a or 0), kind == "purchase" and v is not None and v >= 60, cents)
            once[i] = min(once.get(i, x), x)
    found = []
    for who in {x[1] for x in once.values()}:
        own = sorted((x[0], i, x) for i, x in once.items() if x[1] == who)
        late = [t for t, _, x in own if x[2][0] and x[2][1] - t > 3_600_000_000]
        made: list[list] = []
        for t, i, x in own:
            if x[2][0] and x[2][1] - t > 3_600_000_000:
                continue
            why = None
            if made:
                before = made[-1][-1]
                why = "end" if before[2][3] else "gap" if t - before[0] >= 300_000_000 else "length" if t - made[-1][0][0] > 7_200_000_000 else None
            if not made or why:
                if made:
                    made[-1].insert(0, why)
                made.append([])
            made[-1].append((t, i, x))
        if made:
            made[-1].insert(0, "end" if made[-1][-1][2][3] else "none")
        for k, (why, *own) in enumerate(made):
            upto = made[k + 1][1][0] if k + 1 < len(made) else math.inf
            n_late = sum(own[0][0] <= t < upto for t in late)
            found.append((who, own[0][1], own[0][0], own[-1][0], len(own), n_late, sum(x[4] for _, _, x in own), why, _digest(",".join(str(i) for _, i, _ in own))))
    return sorted(found)

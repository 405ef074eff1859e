"""Sketches against whole sets, merges in any order, and the digest against a version that compares whole texts."""

import hashlib
import random
import re

import numpy as np
import pytest

from weftgraph.llm import fingerprints as P
from weftgraph.llm.ngram_join import shingle_sets


def _set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def _alike(a, b):
    return len(a & b) / len(a | b) if a and b else float(len(a) == len(b))


def _texts(seed, n, words):
    rng = random.Random(seed)
    made = [" ".join(rng.choice(["ab", "Cé", "d", "日本", "x9", "w%d" % rng.randrange(500)]) for _ in range(rng.randrange(words))) for _ in range(n)]
    return [*made, "", None, "one", "  \n ", made[0], made[0] + " more words at the end of this one"]


def _digest(rows, k):
    """The contract by whole sets; exact where sets and unions are no larger than k."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for n, (key, text) in enumerate(order):
        text, following = text or "", order[(n + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = (text[:-half] if half else text) + following[:half]
        out[key] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), _alike(_set(text), _set(changed)), _alike(_set(text), _set(following)))
    return out


def _table(spark, rows):
    return spark.createDataFrame([(i, t, i, 0, "k") for i, t in rows], "doc_id bigint, text string, key bigint, n_chars int, run string").repartition(5)


def test_digest_is_exact_for_sets_within_k(spark):
    texts = _texts(1, 200, 60)
    rows = list(zip(random.Random(2).sample(range(-1000, 1000), len(texts)), texts, strict=True))
    got = P.fingerprint_digest(_table(spark, rows), k=256).collect()
    want = _digest(rows, 256)
    assert len(got) == len(rows)
    for r in got:
        n, sha, near_edited, near_next = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.near_edited == pytest.approx(near_edited) and r.near_next == pytest.approx(near_next)
    prints = {}
    for r in got:
        prints.setdefault(dict(rows)[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())


def test_digest_is_near_for_large_sets(spark):
    rows = list(enumerate(_texts(3, 60, 3000)))
    want = _digest(rows, P.K)
    error = [abs(r.near_edited - want[r.doc_id][2]) for r in P.fingerprint_digest(_table(spark, rows)).collect()]
    assert np.mean(error) < 0.05 and max(error) < 0.3


def test_repeated_and_null_keys_and_small_tables(spark):
    assert P.fingerprint_digest(_table(spark, [])).collect() == []
    one = P.fingerprint_digest(_table(spark, [(4, "a b c d e f")])).first()
    assert (one.near_edited, one.near_next) == (0.0, 1.0)
    assert one.edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()
    same = P.fingerprint_digest(_table(spark, [(7, "t " * 9)] * 400 + [(None, "u v w x y z")] * 200)).collect()
    assert len(same) == 600 and {r.near_next for r in same} == {0.0, 1.0}
    assert sum(r.near_next == 0.0 for r in same) == 2
    with pytest.MonkeyPatch.context() as m:
        m.setattr(P, "PIECE", 3)
        text = "aé日🙂" * 5
        for k in range(25):
            assert text.encode()[: P._bytes_of(text.encode(), k)].decode() == text[:k]


def test_merged_sketches_are_those_of_the_union():
    rng = np.random.default_rng(5)
    parts = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 3, 900, 5000)]
    whole = np.unique(np.concatenate(parts))
    assert (P.merge(map(P.bottom, parts)) == P.bottom(whole)).all()
    assert (P.merge([P.merge(map(P.bottom, parts[2:])), P.bottom(parts[1])]) == P.bottom(whole)).all()
    assert (P.unpacked(P.packed(whole)) == whole).all()


def test_estimates():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 64, 30_000, dtype=np.uint64)
    a, b = np.unique(pool[:20_000]), np.unique(pool[10_000:])
    x, y = P.bottom(a, 1024), P.bottom(b, 1024)
    assert P.distinct(x, 1024) == pytest.approx(20_000, rel=0.1)
    assert P.resemblance(x, y, 1024) == pytest.approx(1 / 3, abs=0.05)
    assert P.containment(x, y, 1024) == pytest.approx(1 / 2, abs=0.07)
    assert P.containment(P.bottom(a[:10]), P.bottom(a[:20])) == 1.0
    assert P.containment(P.bottom(np.zeros(0, np.uint64)), x) == 1.0


def test_groups(spark):
    texts = _texts(8, 300, 200)
    rows = [(i, t, "hot" if i % 3 else f"g{i % 7}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(6)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(P, "HELD", 2)
        got = {r.source: r for r in P.merge_sketches(P.sketch_documents(docs), "source").collect()}
    assert len(got) == len({r[2] for r in rows})
    for source, r in got.items():
        own = [(t or "").encode() for _, t, s in rows if s == source]
        sets = shingle_sets(np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)]))
        whole = np.unique(np.concatenate(sets))
        assert (P.unpacked(bytes(r.sketch)) == P.bottom(whole)).all()
        assert r.n_distinct == pytest.approx(P.distinct(P.bottom(whole)))

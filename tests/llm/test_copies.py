"""The join against brute force on groups of unlike members and long texts, and which row of a group stays."""

import random

import numpy as np
import pytest

from weftgraph.llm import ngram_join


def _groups(rng, n):
    """Clusters of short texts that share their first words and their size, and others that link with some of them only."""
    out = []
    for c in range(n):
        word = lambda: f"c{c}x{rng.randrange(40)}"  # noqa: E731, B023
        head = [word() for _ in range(6)]
        tails = [[word() for _ in range(rng.randrange(2, 6))] for _ in range(3)]
        for _ in range(rng.randrange(2, 6)):
            text = head + rng.choice(tails) + rng.choice(tails)[: rng.randrange(2)]
            if rng.random() < 0.4:
                text = text[rng.randrange(2) : len(text) - rng.randrange(2)]
            out.append(text)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = _groups(rng, 2500)
    rng.shuffle(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = sorted(tuple(r) for r in ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # Only texts of one cluster share a word, so that each cluster is compared by itself.
    clusters: dict[str, list] = {}
    for k, t in rows:
        clusters.setdefault(t.split("x")[0], []).append((k, t))
    want = sorted(x for part in clusters.values() for x in ngram_join.brute_force(part))
    assert got == want and len({x[2] for x in want}) < len(want)


def test_pieces_hash_alike(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "Bc", "déf", "g" * 90], 50)) for _ in range(9)] + ["x" * 500, "", "y" * 70 + " z", " \t "]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    whole = [ngram_join.word_hashes(data, offsets), ngram_join.shingle_sets(data, offsets)]
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(ngram_join, "PIECE", size)
        ngram_join._powers.clear()
        again = [ngram_join.word_hashes(data, offsets), ngram_join.shingle_sets(data, offsets)]
        assert all(np.array_equal(a, b) for x, y in zip(whole, again, strict=True) for a, b in zip(x, y, strict=True))
    ngram_join._powers.clear()


LONG = "the quick brown fox jumps over the lazy dog near the river bank at noon"


def _kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, print string")
    return sorted((tuple(r) for r in ngram_join.drop_near_copies(docs).collect()), key=repr)


def test_rows_are_judged_by_their_own_text(spark):
    rows = [(1, LONG, "a"), (1, LONG, "b"), (2, LONG, "c"), (2, "another text of its own stands here alone", "d"), (None, LONG + " today", "e")]
    assert _kept(spark, rows) == [(1, LONG, "a"), (2, "another text of its own stands here alone", "d")]


def test_rows_without_keys_and_words(spark):
    rows = [(None, LONG, "a"), (None, LONG, "b"), (3, None, "c"), (3, None, "d"), (4, " ", "e"), (5, "", None)]
    assert _kept(spark, rows) == sorted([(None, LONG, "a"), (3, None, "c"), (3, None, "d"), (4, " ", "e"), (5, "", None)], key=repr)
    assert _kept(spark, []) == []


def test_columns_that_have_no_order(spark):
    docs = spark.createDataFrame([(1, LONG, {"a": 1}), (1, LONG, {"a": 1})], "doc_id long, text string, more map<string,int>")
    assert [tuple(r) for r in ngram_join.drop_near_copies(docs).collect()] == [(1, LONG, {"a": 1})]

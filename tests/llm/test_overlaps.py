"""Benchmark windows against brute force: shared runs, ids that are null, large vocabularies and several blocks."""

import random
import time

import pytest

from weftgraph.llm import decontaminate


def _cases(rng):
    words = [f"w{k}" for k in range(14)]
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(str(k), " ".join(pick(rng.choice((1, 5, 12, 13, 14, 20, 27, 40))))) for k in range(12)]
    items += [(None, " ".join(pick(15))), ("3", " ".join(pick(18))), ("x", None), ("y", " . ")]
    long = [x for _, x in items if x and x.count(" ") > 11]
    docs = [None, "", "..."]
    for _ in range(80):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            cut = rng.choice(long).split()
            a = rng.randrange(len(cut))
            parts += [" ".join(cut[a : a + rng.randrange(1, 30)]), rng.choice(("", "other words here", "W1, w2. w3;"))]
        docs.append(" ".join(parts))
    return items, docs


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_runs_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    items, texts = _cases(random.Random(block))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.overlap_digest(docs, bench).collect()}
    for k, text in enumerate(texts):
        assert tuple(got[k])[1:6] == decontaminate.brute_force(text, items), text
    assert sum(r.contaminated for r in got.values()) > 30


def test_items_without_an_id_hit_words(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    row = decontaminate.overlap_digest(docs, spark.createDataFrame([(None, "one")], "item_id long, text string")).first()
    assert (row.n_hit, row.n_items, row.contaminated) == (1, 0, True)


def test_large_vocabularies_are_built_in_time():
    took = {}
    for n in (125_000, 500_000):
        words = [b"word%d" % k for k in range(n)]
        began = time.time()
        made = decontaminate.Windows([(str(k), words[k : k + 500]) for k in range(0, n, 500)])
        took[n] = time.time() - began
        assert made.scan([b"before", *words[n - 40 : n - 20], b"after", *words[200:212]]) == ([(1, 21)], {made.ids.index(str(n - 500))})
    assert took[500_000] < 12 * took[125_000] + 2

"""Cases in which an operator once did less than its whole job."""

import random

from weftgraph.llm import ngram_join


def test_members_of_a_group_meet_the_leader(spark):
    """Sets with equal rare prefixes and sizes are one group; a leader may link with a member and not with the head."""
    rng = random.Random(7)
    words = iter(rng.sample(range(100_000), 4000))
    take = lambda n: [f"w{next(words)}" for _ in range(n)]
    bridge, one, two = take(4), take(76), take(76)
    rows = []
    for _ in range(12):
        rare = take(30)
        rows += [[*rare, *bridge, *one], [*rare, *bridge, *two], [*rare[5:], *bridge, *one]]
    rows = [(k, " ".join(t)) for k, t in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.withColumnRenamed("doc_id", "key")
    made = ngram_join._documents(keyed, ngram_join._levels(ngram_join._sketch(keyed.select("text"))))
    assert made.select("grp").distinct().count() == 24  # the first two of each three are a group
    got = sorted(tuple(r) for r in ngram_join.link_documents(docs).collect())
    assert got == sorted(ngram_join.brute_force(rows))

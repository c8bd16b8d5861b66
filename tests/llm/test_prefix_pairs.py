"""Candidates by prefix."""

import random

from duskwatch.llm import linking


def test_prefix_pairs_miss_none(spark):
    """The bounds by components leave no pair out that reaches the similarity, among sets that share one frequent item."""
    rng = random.Random(5)
    sets = {k: {1, *(rng.randrange(10, 10**9) for _ in range(9))} for k in range(60)}
    sets |= {100 + k: (sets[k] - {max(sets[k])}) | {7 + k} for k in range(0, 60, 6)}
    items = spark.createDataFrame([(k, i, len(s)) for k, s in sets.items() for i in s], "id long, item long, n long")
    labels = spark.createDataFrame([(k, k) for k in sets], "id long, c long")
    got = {(r["a"], r["b"]) for r in linking.prefix_pairs(items, labels, 80).collect()}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert near == {(k, 100 + k) for k in range(0, 60, 6)} and near <= got

"""What pairs of sets make is not shuffled, and items take turns to give their pairs."""

import numpy as np

from duskwatch.llm import linking, work


def test_pairs_are_made_in_turns(spark, monkeypatch):
    rng = np.random.default_rng(11)
    sets = {}
    for k in range(150):  # families of near-copies, and in each one component of several parts
        own = set(range(1000 * (k % 3), 1000 * (k % 3) + 60))
        out = set(rng.choice(sorted(own), int(rng.integers(0, 9)), replace=False).tolist())
        sets[k] = own - out | {100_000 + 100 * k + x for x in range(len(out))}
    component = {k: k % 3 if k < 90 else k for k in sets}
    items = spark.createDataFrame([(k, x, len(s)) for k, s in sets.items() for x in s], "id long, item long, n long")
    labels = spark.createDataFrame(list(component.items()), "id long, c long")
    want = {(a, b) for a in sets for b in sets if a < b and component[a] != component[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    joins, written = [], lambda df: joins.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner"))) or work.written(df)
    monkeypatch.setattr(linking, "written", written)
    monkeypatch.setattr(linking, "TOGETHER", 7, raising=False)
    whole = {(r["a"], r["b"]) for r in linking.prefix_pairs(items, labels, 80).collect()}
    assert len(want) > 100 and want <= whole
    assert [n for columns, n in joins if columns == ["a", "b"]] == [1]  # sets meet by their item alone, so no row of a pair is dealt out before it has passed
    joins.clear()
    monkeypatch.setattr(linking, "PAIRS_AT_ONCE", len(whole), raising=False)  # a pair is given by several items
    monkeypatch.setattr(linking, "TRIAL", 1, raising=False)
    assert {(r["a"], r["b"]) for r in linking.prefix_pairs(items, labels, 80).collect()} == whole
    assert len([n for columns, n in joins if columns == ["a", "b"]]) > 1

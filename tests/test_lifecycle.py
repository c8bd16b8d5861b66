"""Merges that are undone, retention, parameters over time: worked cases and round trips."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from duskwatch import lifecycle_queries as Q
from duskwatch.operators import identity
from duskwatch.plans import cycles, retention, tuning

SF = "/root/testdata/sf0.001"


def profile(i, first, last, mac="", host=None, kind=None, counters=None, addresses=None):
    return (i, float(first), float(last), mac, host, kind, counters, addresses)


PROFILES = [
    profile(1, 10, 50, "", None, "tv", {"a": 1}, [(5.0, "x"), (9.0, "y")]), profile(2, 5, 60, "m2", "h2", None, {"a": 2, "b": 1}, [(4.0, "y"), (30.0, "z")]), profile(3, 5, 40, "m3", "h3", "pc", None, None),
    profile(4, 1, 2, "m4", "", "cam", {}, []), profile(5, 7, 7, None, "h5", "", {"c": 9}, [(1.0, f"p{k}") for k in range(12)]), profile(6, 8, 9, "m6", "h6", "x", {"a": 1}, [(2.0, "q")]),
]


def rows(df):
    return sorted((tuple(sorted(x.items()) if isinstance(x, dict) else x for x in r) for r in df.collect()), key=lambda r: r[0])


def named(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, canonical long")


def test_metadata_merge_by_hand(spark):
    start = spark.createDataFrame(PROFILES, identity.PROFILE)
    got = {r["id"]: r for r in identity.merge_metadata(start.join(named(spark, (1, 1), (2, 1), (3, 1), (5, 5)), "id"), "canonical").collect()}
    one = got[1]
    assert (one["first_seen"], one["last_seen"], one["mac"], one["host"], one["kind"]) == (5, 60, "m2", "h2", "tv")
    assert one["counters"] == {"a": 3, "b": 1} and [tuple(a) for a in one["addresses"]] == [(30.0, "z"), (5.0, "x"), (4.0, "y")]
    assert [a["address"] for a in got[5]["addresses"]] == sorted(f"p{k}" for k in range(12))[:8] and got[5]["kind"] is None


def test_merges_and_splits_give_back_the_tables(spark):
    start = spark.createDataFrame(PROFILES, identity.PROFILE)
    before, log = rows(start), identity.empty_log(start)
    one, log1 = identity.merge(start, log, named(spark, (1, 1), (2, 1), (3, 1), (4, 4)), 1)
    assert [r[0] for r in rows(one)] == [1, 4, 5, 6] and rows(identity.redirects(log1)) == [(1, 1), (2, 1), (3, 1)]
    for wrong in ([1], [2, 3], [1, 2, 3]):
        back, log2 = identity.split(one, log1, spark.createDataFrame([(i,) for i in wrong], "id long"), 2)
        assert rows(back) == before and rows(identity.redirects(log2)) == []
    # a second merge of merged identities, then a split of one of the first
    two, log2 = identity.merge(one, log1, named(spark, (1, 5), (5, 5)), 2)
    assert rows(identity.redirects(log2)) == [(1, 5), (2, 5), (3, 5), (5, 5)] and [r[0] for r in rows(two)] == [4, 5, 6]
    part, log3 = identity.split(two, log2, spark.createDataFrame([(2,), (77,)], "id long"), 3)
    want = identity.merge_metadata(start.where("id IN (1, 3, 5)").withColumn("c", F.lit(5).cast("long")), "c")
    assert rows(part.where("id = 5")) == rows(want) and rows(part.where("id = 2")) == [r for r in before if r[0] == 2] and rows(identity.redirects(log3)) == [(1, 5), (3, 5), (5, 5)]
    # merged again after it was free: the next split gives back what it brought then
    changed = part.where("id <> 2").unionByName(part.where("id = 2").withColumn("last_seen", F.lit(99.0)))
    three, log4 = identity.merge(changed, log3, named(spark, (2, 2), (6, 2)), 4)
    back, _ = identity.split(three, log4, spark.createDataFrame([(6,)], "id long"), 5)
    assert rows(back) == rows(changed)


def test_a_flipped_pin_or_a_broken_bound_blocks_a_candidate(spark):
    cases = Q.golden_cases(spark, SF)
    fields = "candidate string, p_sources double"
    got = {r["candidate"]: r for r in tuning.guard(cases, spark.createDataFrame([("same", None), ("deaf", 99.0)], fields)).collect()}
    assert not got["same"]["blocked"] and got["same"]["cases"] == cases.count() > 0
    listed = cases.limit(1).drop("at_least", "at_most", "pinned").select("*", F.lit("CRITICAL").alias("at_least"), F.lit(None).cast("string").alias("at_most"), F.lit("nowhere").alias("pinned"))
    one = tuning.guard(listed.withColumn("c_decoy", F.lit(0.0)).withColumn("tier", F.lit(3)), spark.createDataFrame([("same", None)], fields)).first()
    assert (one["missed"], one["flipped"], one["blocked"]) == (1, 1, True)
    with pytest.raises(ValueError):
        cycles.decided(cases, spark.range(2000).select(F.col("id").cast("string").alias("candidate")))


def test_confirmed_misses_within_the_window(spark):
    scopes = spark.createDataFrame([(1, 7, 0.7, 0.9), (2, 8, 0.9, 0.7), (3, 9, 0.7, 0.9)], "change_id long, user_id long, parent double, value double")
    seen = spark.createDataFrame([(7, 100.0, 0.7), (7, 100.0, 0.7), (7, 205.0, 0.89), (7, 206.0, 0.9), (7, 900.0, 0.8), (8, 100.0, 0.8), (9, 100.0, 0.8)], "user_id long, t double, confidence double")
    threats = spark.createDataFrame([(7, 200.0), (7, 201.0), (8, 100.0), (9, 500.0)], "user_id long, t double")
    assert [tuple(r) for r in tuning.confirmed_misses(scopes, seen, threats, 100.0).collect()] == [(1, 2)]


def test_proposals_by_hand():
    h = 3600.0
    rows = [(1, 0.0, 0.9, True, True), (2, h / 2, 0.9, True, True), (3, 5 * h, 0.9, True, True), (4, 24 * h, 0.9, False, True), (5, 25 * h, 0.9, True, False), (6, 49 * h, 0.2, True, True), (7, 80 * h, 0.9, True, True), (8, 110 * h, 0.9, True, True), (9, 140 * h, 0.9, True, True)]
    frame = pd.DataFrame([("p", 1, *r) for r in reversed(rows)], columns=["parameter", "scope", "proposal_id", "t", "wanted", "backtest", "night_passes"])
    got = [(r.proposal_id, round(r.active, 6), round(r.value, 6), r.outcome) for r in tuning.fold_proposals(frame).itertuples()]
    assert got == [(1, 0.5, 0.55, "promoted"), (2, 0.5, 0.55, "cooldown"), (3, 0.5, 0.55, "pending"), (4, 0.55, 0.6, "no_backtest"), (5, 0.55, 0.6, "rolled_back"), (6, 0.55, 0.5, "promoted"), (7, 0.5, 0.55, "promoted"), (8, 0.55, 0.6, "promoted"), (9, 0.6, 0.65, "radius")]


def test_retention_leaves_no_orphan(spark):
    tables, now = Q.stored(spark, SF)
    tables["citations"] = tables["evidence"].limit(0).select(F.col("id").alias("evidence"))
    kept = retention.survivors(tables, Q.policies(now), now)
    assert 0 < kept["decisions"].count() < tables["decisions"].count() and kept["containments"].count() == tables["containments"].count()
    for child, column, parent in (("alerts", "decision", "decisions"), ("actions", "alert", "alerts"), ("containments", "decision", "decisions"), ("incidents", "id", None)):
        if parent:
            assert kept[child].where(f"{column} IS NOT NULL").join(kept[parent].select(F.col("id").alias(column)), column, "left_anti").count() == 0
    assert kept["incidents"].join(kept["alerts"].select(F.col("incident").alias("id")), "id", "left_anti").count() == 0


def test_retention_of_nulls_and_citations(spark):
    parents = spark.createDataFrame([(1, 0.0), (2, 9e5), (3, None)], "id long, t double")
    rows = spark.createDataFrame([(1, 1, 0.0), (2, 2, 0.0), (3, None, 0.0), (4, 2, 9e5), (5, 9, 9e5), (6, 3, None)], "id long, parent long, t double")
    cites = spark.createDataFrame([(2,), (None,)], "row long")
    policies = [retention.Policy("p", "id", 5), retention.Policy("r", "id", 5, parents=[("parent", "p")], cited_by=[("c", "row")])]
    kept = retention.survivors({"p": parents, "r": rows, "c": cites}, policies, 1e6)
    assert sorted(r["id"] for r in kept["p"].collect()) == [2, 3] and sorted(r["id"] for r in kept["r"].collect()) == [2, 4, 6]


@pytest.mark.parametrize("budget", [0.0, 1.0, 5_000.0, 40_000.0, 59_000.0])
def test_size_cut_equals_a_running_sum(spark, monkeypatch, budget):
    monkeypatch.setattr(retention, "LEAST_ROWS", 20)
    monkeypatch.setattr(retention, "PARTS", 8)
    rng = random.Random(6)
    rows = [(k, 5.0 if k % 3 == 0 else float(rng.randrange(40)), rng.randrange(100)) for k in range(1200)] + [(5000, None, 10_000), (5001, 3.0, None)]
    df = spark.createDataFrame(rows, "id long, t double, bytes long").repartition(4)
    usable = sorted((t, i, b or 0) for i, t, b in rows if t is not None)
    excess, held, want = sum(b for *_, b in usable) - budget, 0, None
    for t, i, b in usable:
        held += b
        want = (t, i)
        if held >= excess:
            break
    assert retention.size_cut(df, budget) == (want if excess > 0 else None)


def test_size_cut_where_all_fits_or_nothing_is_there(spark):
    df = spark.createDataFrame([(1, 1.0, 5)], "id long, t double, bytes long")
    assert retention.size_cut(df, 5) is None and retention.size_cut(df.limit(0), 0) is None and retention.size_cut(df, 4) == (1.0, 1)


def test_episodes_are_seed_stable_and_found(spark):
    from duskwatch.plans import synthetic
    from duskwatch.sources.tables import events

    e = events(spark, SF)
    one, cases = synthetic.episodes(e)
    again, _ = synthetic.episodes(e.repartition(7))
    key = lambda df: sorted(tuple(r) for r in df.where("event_id < 0").collect())
    assert key(one) == key(again) != key(synthetic.episodes(e, seed=9)[0])
    kinds = cases.groupBy("attack").count().collect()
    assert len(kinds) == 8 and len({r["count"] for r in kinds}) == 1
    odd = cases.where("user_id % 10 = 7 OR user_id % 9 = 0 OR user_id % 5 <> device % 5").count()
    assert odd == 0 and cases.select("user_id").distinct().count() == cases.count()
    found = {r["attack"]: r for r in Q.episode_recall(spark, SF).collect()}
    assert found["decoy_touch"]["alarmed"] == found["decoy_touch"]["episodes"] and found["benign_drift"]["raised"] < 0.3 * found["benign_drift"]["episodes"]
    for attack in ("port_scan", "dga_dns_tunnel", "exfiltration", "lateral_movement", "credential_stuffing", "c2_beaconing"):
        assert found[attack]["noticed"] > 0.6 * found[attack]["episodes"], found


def test_every_decision_other_than_benign_is_explained(spark):
    rows = Q.explanations(spark, SF).collect()
    assert rows and all(r["headline"] and "{" not in r["headline"] + r["reasons"] + r["harmless"] for r in rows)
    assert all(r["actions"] for r in Q.next_actions(spark, SF).collect())

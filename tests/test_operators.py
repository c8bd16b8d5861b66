"""Joins, windows and scalars on tables with nulls, ties, repeats and boundary values."""

import time

import pytest
from pyspark.sql import functions as F

from duskwatch.functions import scalars as S
from duskwatch.operators import graph, joins, windows


def test_asof_takes_the_latest_not_after(spark):
    left = spark.createDataFrame([(1, 7, 10.0), (2, 7, 9.9), (3, 7, 20.0), (4, 8, 1.0), (5, None, 5.0)], "id long, user_id long, t double")
    right = spark.createDataFrame([(7, 10.0, "a"), (7, 15.0, "b"), (7, 15.5, None), (8, 2.0, "c")], "user_id long, t double, k string")
    got = {r["id"]: r["k"] for r in joins.asof(left, right, "user_id", "k").collect()}
    assert got == {1: "a", 2: None, 3: "b", 4: None, 5: None}


def test_range_join_includes_both_ends(spark):
    points = spark.createDataFrame([(1, 0.0), (2, 30.0), (3, 30.1), (4, 100.0), (5, None), (6, -5.0)], "id long, value double")
    ranges = spark.createDataFrame([(0.0, 30.0, "x"), (25.0, 200.0, "y"), (-10.0, -1.0, "z")], "lo double, hi double, label string")
    got = sorted((r["id"], r["label"]) for r in joins.in_range(points, ranges, "value", 16.0).collect())
    assert got == [(1, "x"), (2, "x"), (2, "y"), (3, "y"), (4, "y"), (6, "z")]


def test_longest_suffix_wins_and_stops_at_labels(spark):
    names = spark.createDataFrame([("a.b.example.com",), ("example.com",), ("badexample.com",), ("b.example.com",)], "host string")
    listed = spark.createDataFrame([("example.com", "wide"), ("b.example.com", "narrow")], "suffix string, note string")
    got = {r["host"]: (r["note"], r["matched_parent"]) for r in joins.longest_suffix(names, listed).collect()}
    assert got == {"a.b.example.com": ("narrow", True), "example.com": ("wide", False), "b.example.com": ("narrow", False)}


ROWS = [(1, 1, 0.0, 1.0), (2, 1, 10.0, 2.0), (3, 1, 20.0, 4.0), (4, 1, 31.0, 8.0), (5, 2, 5.0, 1.0), (6, 2, 5.0, 1.0)]


def test_sessions_close_after_the_gap(spark):
    df = spark.createDataFrame(ROWS, "event_id long, user_id long, t double, value double")
    got = sorted((r["user_id"], r["session"], r["n"]) for r in windows.sessions(df, "user_id", 10).collect())
    assert got == [(1, 1, 3), (1, 2, 1), (2, 1, 2)]


def test_sliding_counts_ties_together(spark):
    df = spark.createDataFrame(ROWS, "event_id long, user_id long, t double, value double")
    got = {r["event_id"]: (r["n"], r["total"]) for r in windows.sliding(df, "user_id", 10).collect()}
    assert got == {1: (1, 1.0), 2: (2, 3.0), 3: (2, 6.0), 4: (1, 8.0), 5: (2, 2.0), 6: (2, 2.0)}


def test_newest_breaks_ties_by_id(spark):
    df = spark.createDataFrame(ROWS, "event_id long, user_id long, t double, value double")
    assert sorted(r["event_id"] for r in windows.newest(df, "user_id", 1).collect()) == [4, 6]


def test_address_classes(spark):
    rows = [("10.0.0.1", "private"), ("127.0.0.1", "loopback"), ("192.168.3.4", "private"), ("169.254.1.1", "link-local"), ("224.0.0.9", "multicast"), ("8.8.8.8", "public")]
    df = spark.createDataFrame(rows, "ip string, want string").withColumn("got", S.ip_class(S.ipv4(F.col("ip"))))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_entropy(spark):
    df = spark.createDataFrame([("aaaa", 0.0), ("abab", 1.0), ("abcd", 2.0)], "label string, want double")
    assert all(abs(r["got"] - r["want"]) < 1e-9 for r in df.withColumn("got", S.entropy(F.col("label"))).collect())


def test_components_of_long_paths_and_hubs(spark):
    path = spark.range(1, 100_000).select((F.col("id") * 7919 % 100_003).alias("a"), ((F.col("id") + 1) * 7919 % 100_003).alias("b"))
    hub = spark.range(200_001, 220_000).select(F.lit(200_000).cast("long").alias("a"), F.col("id").alias("b"))
    odd = spark.createDataFrame([(5_000_000, 5_000_000), (None, 3), (7, None)], "a long, b long")
    began = time.time()
    found = graph.components(path.unionByName(hub).unionByName(odd)).groupBy("component").agg(F.count("*").alias("n"), F.min("id").alias("low")).collect()
    assert sorted((r["component"], r["n"]) for r in found) == [(min(i * 7919 % 100_003 for i in range(1, 100_001)), 100_000), (200_000, 20_000)]
    assert all(r["component"] == r["low"] for r in found) and time.time() - began < 120


def test_redirects_follow_long_chains_and_refuse_cycles(spark):
    rows = [(i, i - 1, "x") for i in range(1, 3000)] + [(5000, 4000, "y"), (None, 4, "z"), (6, None, "z")]
    rows.remove((6, 5, "x"))
    got = {r["id"]: r["canonical"] for r in graph.canonical(spark.createDataFrame(rows, "id long, into long, note string"), "id", "into").collect()}
    assert got == {i: 6 if i > 6 else 0 for i in range(1, 3000) if i != 6} | {5000: 4000}
    with pytest.raises(ValueError):
        graph.canonical(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, into long"), "id", "into", rounds=6)

"""Streams against the batch results over the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from duskwatch.streaming import windows


@pytest.fixture()
def events(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, rng.randrange(5), rng.randrange(3), rng.randrange(7200), rng.choice(["view", "error"]), float(i % 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, k int, s int, event_type string, value double")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).withColumn("t", (F.col("s") + 1_700_000_000).cast("double"))
    df.write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in"))


def streamed(spark, events, tmp_path, make, mode):
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    name = f"out_{abs(hash(str(tmp_path))) % 10**9}"
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    return spark.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_windows(spark, events, tmp_path):
    got = streamed(spark, events, tmp_path, windows.device_windows, "complete")
    assert rows(got) == rows(windows.device_windows(events))


def test_repeats(spark, events, tmp_path):
    got = streamed(spark, events, tmp_path, lambda s: windows.without_repeats(s, ["user_id", "k"], "3 hours"), "append")
    assert rows(got.select("user_id", "k")) == rows(events.select("user_id", "k").distinct())


def test_check_ins_stream_equals_batch(spark, events, tmp_path):
    got = streamed(spark, events, tmp_path, windows.check_ins_stream, "update")
    assert rows(got.select("user_id", "k", "intervals", "score")) == rows(windows.check_ins(events).select("user_id", "k", "intervals", "score"))


def test_check_ins_against_a_plain_fold(spark, events):
    want = {}
    series = {}
    for r in sorted(events.collect(), key=lambda r: (r["t"], r["event_id"])):
        series.setdefault((r["user_id"], r["k"]), windows.CheckIns()).add(r["t"])
    for key, c in series.items():
        want[key] = (c.n, round(c.mean, 4), c.missed, round(c.score(), 6))
    got = {(r["user_id"], r["k"]): (r["intervals"], r["mean_gap"], r["missed"], r["score"]) for r in windows.check_ins(events).collect()}
    assert got == want


def test_regular_series_score_high():
    c = windows.CheckIns()
    for t in [0, 0.5, 60, 120, 180, 240, 300, 360, 600]:
        c.add(t)
    assert c.score() == 1.0 and c.missed == 1 and c.n == 6

"""Streaming twins of the window features, and the stateful check-in detector."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def device_windows(stream: DataFrame, length: str = "5 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts, error share and sums of each device and sliding window; rows within ``late`` count in their true window."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"), "user_id").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"), F.sum("value").alias("total")
    ).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "errors", "total")


def without_repeats(stream: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each content key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class CheckIns:
    """Running moments of a series' intervals: check-ins within 2 s are one, and a gap over 1.8 means counts as missed after five intervals."""

    def __init__(self, last: float | None = None, n: int = 0, mean: float = 0.0, m2: float = 0.0, missed: int = 0):
        self.last, self.n, self.mean, self.m2, self.missed = last, n, mean, m2, missed

    def add(self, t: float) -> None:
        if self.last is None or t < self.last:
            self.last = t if self.last is None else self.last
            return
        gap = t - self.last
        if gap < 2:
            return
        self.last = t
        if self.n >= 5 and gap > 1.8 * self.mean:
            self.missed += 1
            return
        self.n += 1
        d = gap - self.mean
        self.mean += d / self.n
        self.m2 += d * (gap - self.mean)

    def score(self) -> float:
        if self.n < 2 or self.mean <= 0:
            return 0.0
        return max(0.0, 1 - math.sqrt(self.m2 / self.n) / self.mean / 0.6)


def check_ins(rows: DataFrame) -> DataFrame:
    """Batch: (user_id, k) series folded in order of time; user_id, k, intervals, mean_gap, missed, score.

    One shuffle and sort bring each series together; a partition is then folded batch by batch with one small state, so
    neither the number of series nor the length of one needs a table of its own in memory.
    """

    def result(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["user_id", "k", "intervals", "mean_gap", "missed", "score"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, c, done = None, CheckIns(), []
        for pdf in batches:
            for user, k, t in zip(pdf["user_id"].tolist(), pdf["k"].tolist(), pdf["t"].tolist(), strict=True):
                if (user, k) != at:
                    if at is not None:
                        done.append((*at, c.n, round(c.mean, 4), c.missed, round(c.score(), 6)))
                    at, c = (user, k), CheckIns()
                c.add(t)
            yield result(done)
            done = []
        if at is not None:
            yield result([(*at, c.n, round(c.mean, 4), c.missed, round(c.score(), 6))])

    series = rows.where("k IS NOT NULL AND user_id IS NOT NULL").select("user_id", "k", "t", "event_id")
    return series.repartition("user_id", "k").sortWithinPartitions("user_id", "k", "t", "event_id").mapInPandas(fold, "user_id long, k int, intervals long, mean_gap double, missed long, score double")


def check_ins_stream(stream: DataFrame, late: str = "10 minutes", silence: int = 30 * 60) -> DataFrame:
    """The same fold over a stream (user_id, k, ts, t), with state for each pair that ends once the watermark is ``silence`` seconds past its last row.

    Rows behind the watermark are left out. Event time ends the state, so a stream that is read to its end stops by itself.
    """

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        c = CheckIns(*state.get) if state.exists else CheckIns()
        for t in sorted(t for pdf in batches for t in pdf["t"].tolist()):
            c.add(t)
        state.update((c.last, c.n, c.mean, c.m2, c.missed))
        state.setTimeoutTimestamp(max(int((c.last + silence) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "k": [key[1]], "intervals": [c.n], "score": [round(c.score(), 6)]})

    rows = stream.where("k IS NOT NULL AND user_id IS NOT NULL AND t IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("user_id", "k").applyInPandasWithState(fold, "user_id long, k int, intervals long, score double", "last double, n long, mean double, m2 double, missed long", "update", "EventTimeTimeout")

"""Features of a device and day, evidence of detectors, and the decision: a pure plan over one wide row for each cycle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """Thresholds; the defaults suit the standard tables, whose devices have few events a day."""

    rate: int = 4
    error_ratio: float = 0.5
    fan_out: int = 4
    z: float = 2.0
    least_days: int = 5
    bytes_high: float = 900.0


def daily(events: DataFrame) -> DataFrame:
    """Per device and day: events, error share, distinct destinations, summed and highest value."""
    return events.groupBy("user_id", "day").agg(
        F.count("*").alias("n"), (F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)) / F.count("*")).alias("error_ratio"),
        F.countDistinct("k").alias("targets"), F.sum("value").alias("total"), F.max("value").alias("top"))


def with_surprise(features: DataFrame) -> DataFrame:
    """One-sided z-score of a day's total against the device's earlier days; 0 with fewer than three of them."""
    before = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    n, mean, dev = F.count("total").over(before), F.avg("total").over(before), F.stddev_pop("total").over(before)
    z = F.when(n >= 3, F.greatest(F.lit(0.0), (F.col("total") - mean) / F.greatest(dev, F.lit(1.0)))).otherwise(F.lit(0.0))
    return features.withColumn("z", F.round(z, 6))


def detected(features: DataFrame, p: Params = Params()) -> DataFrame:
    """Confidence of each detector, 0 where it is silent."""
    def when(fires, value):
        return F.when(fires, F.round(F.least(F.lit(1.0), value), 6)).otherwise(F.lit(0.0))

    return features.select(
        "user_id", "day", "n", "z",
        when(F.col("n") >= p.rate, F.col("n") / (2.0 * p.rate)).alias("c_rate"),
        when((F.col("error_ratio") >= p.error_ratio) & (F.col("n") >= 2), F.col("error_ratio")).alias("c_abuse"),
        when(F.col("targets") >= p.fan_out, 0.4 + 0.08 * F.col("targets")).alias("c_scan"),
        when((F.col("z") >= p.z) & (F.col("total") >= p.bytes_high), 0.5 + F.col("z") / 20).alias("c_exfil"))


def decided(cycle: DataFrame) -> DataFrame:
    """State of each cycle. Rate and scan come from one sensor and count as one source; the path names the first rule that holds."""
    sources = F.when(F.greatest("c_rate", "c_scan") > 0, 1).otherwise(0) + F.when(F.col("c_abuse") > 0, 1).otherwise(0) + F.when(F.col("c_exfil") > 0, 1).otherwise(0)
    best = F.greatest("c_rate", "c_abuse", "c_scan", "c_exfil")
    path = (
        F.when((F.col("c_exfil") >= 0.85) & (F.col("sources") >= 2), "exfil_confirmed").when(F.col("sources") >= 3, "independent_sources")
        .when((F.col("sources") >= 2) & (F.col("best") >= 0.6), "two_sources").when(F.col("best") >= 0.6, "single_strong").when(F.col("best") > 0, "single_weak").otherwise("quiet")
    )
    state = F.when(F.col("path") == "exfil_confirmed", "CRITICAL").when(F.col("path") == "independent_sources", "HIGH").when(F.col("path") == "two_sources", "SUSPICIOUS")
    state = state.when(F.col("path").isin("single_strong", "single_weak"), "ANOMALOUS").otherwise("BENIGN")
    rows = cycle.withColumn("sources", sources.cast("long")).withColumn("best", best).withColumn("path", path)
    return rows.select("user_id", "day", "n", "sources", F.col("best").alias("confidence"), state.alias("state"), F.col("path").alias("decision_path"))


def state_changes(decisions: DataFrame) -> DataFrame:
    """Decisions that differ from the device's previous one in state or path."""
    w = W.partitionBy("user_id").orderBy("day")
    same = F.lag("state").over(w).eqNullSafe(F.col("state")) & F.lag("decision_path").over(w).eqNullSafe(F.col("decision_path"))
    return decisions.withColumn("same", same).where("NOT same").drop("same")

"""As-of, interval, range and suffix joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import parents


def asof(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Each left row (id, key, t) with the right side's ``value`` at the latest time not after it, in one shuffle by key."""
    both = left.select("id", key, "t", F.lit(None).cast(dict(right.dtypes)[value]).alias(value), F.lit(1).alias("side")).unionByName(right.select(F.lit(None).cast(dict(left.dtypes)["id"]).alias("id"), key, "t", value, F.lit(0).alias("side")))
    w = W.partitionBy(key).orderBy("t", "side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("side = 1").drop("side")


def in_range(points: DataFrame, ranges: DataFrame, x: str, width: float) -> DataFrame:
    """Points with the range (lo, hi, label) that holds them, both ends included: an equi-join on buckets of ``width``, then the exact test."""
    spread = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    return points.withColumn("bucket", F.floor(F.col(x) / width)).join(spread, "bucket").where(F.col(x).between(F.col("lo"), F.col("hi"))).drop("bucket")


def longest_suffix(names: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Each host with its longest listed suffix (suffix, note), by an equi-join on the host's parents."""
    rows = names.select("host").distinct().select("host", F.posexplode(parents(F.col("host"))).alias("depth", "suffix"))
    return rows.join(suffixes, "suffix").groupBy("host").agg(F.min_by(F.struct("suffix", "note"), "depth").alias("m"), F.min("depth").alias("depth")).select("host", "m.suffix", "m.note", (F.col("depth") > 0).alias("matched_parent"))

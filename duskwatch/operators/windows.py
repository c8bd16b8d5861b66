"""Sessions, islands, inter-arrival, sliding windows, latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessions(rows: DataFrame, key: str, gap: float) -> DataFrame:
    """Runs of rows whose silence stays within ``gap``; a longer one opens the next."""
    w = W.partitionBy(key).orderBy("t", "event_id")
    opened = rows.withColumn("new", F.when(F.col("t") - F.lag("t").over(w) <= gap, 0).otherwise(1))
    numbered = opened.withColumn("session", F.sum("new").over(w))
    return numbered.groupBy(key, "session").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def inter_arrival(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Mean, spread and variation of the gaps of each key with ``least`` gaps or more."""
    w = W.partitionBy(key).orderBy("t", "event_id")
    gaps = rows.withColumn("gap", F.col("t") - F.lag("t").over(w)).where("gap IS NOT NULL")
    out = gaps.groupBy(key).agg(F.count("*").alias("gaps"), F.round(F.avg("gap"), 4).alias("mean_gap"), F.round(F.stddev_pop("gap") / F.avg("gap"), 6).alias("cv"))
    return out.where(F.col("gaps") >= least)


def sliding(rows: DataFrame, key: str, seconds: int) -> DataFrame:
    """Each row with the number and sum of its key's rows in the ``seconds`` up to it."""
    at = F.floor(F.col("t")).cast("long")
    w = W.partitionBy(key).orderBy("s").rangeBetween(-seconds, 0)
    return rows.withColumn("s", at).select("event_id", key, F.count("*").over(w).alias("n"), F.round(F.sum("value").over(w), 4).alias("total"))


def newest(rows: DataFrame, key: str, count: int) -> DataFrame:
    """The ``count`` newest rows of each key; of equal times the larger event_id is newer."""
    w = W.partitionBy(key).orderBy(F.desc("t"), F.desc("event_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)


def ranked(rows: DataFrame, order: list, groups: list[str], within) -> DataFrame:
    """``rows`` with their place (rank, from 1) by ``order`` over the columns ``groups``, ties by ``within``.

    A table of the group's counts gives each group's first place, so rows are sorted group by group and not all in one task."""
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("size"))
    first = sizes.withColumn("first", F.sum("size").over(W.orderBy(*order)) - F.col("size")).drop("size")  # one row for each group
    return rows.join(first, groups).withColumn("rank", F.col("first") + F.row_number().over(W.partitionBy(*groups).orderBy(within))).drop("first")


def elsewhere(rows: DataFrame, group: list[str], name: str) -> DataFrame:
    """``rows`` (id, ip, seen and others) with ``name``: the smallest id among the rows of the same ``group`` seen strictly earlier at another ip, null without one.

    The smallest id so far and the smallest at any other ip than that one's are both running minima: when a smaller id comes from another ip, the former
    smallest takes the second place. A row at the smallest id's ip takes the second, any other the first. One sort for each group, no pairs."""
    order = W.partitionBy(*group).orderBy("seen", "id")
    earlier = W.partitionBy(*group).orderBy("__at").rangeBetween(W.unboundedPreceding, -1)
    out = rows.where("ip IS NOT NULL").withColumn("__at", F.dense_rank().over(W.partitionBy(*group).orderBy("seen")))
    out = out.withColumn("__so_far", F.min(F.struct("id", "ip")).over(order.rowsBetween(W.unboundedPreceding, -1)))
    out = out.withColumn("__second", F.when(F.col("ip") != F.col("__so_far.ip"), F.greatest("id", "__so_far.id")))
    out = out.withColumn("__first", F.min(F.struct("id", "ip")).over(earlier)).withColumn("__second", F.min("__second").over(earlier))
    return out.withColumn(name, F.when(F.col("ip") != F.col("__first.ip"), F.col("__first.id")).otherwise(F.col("__second"))).drop("__at", "__so_far", "__first", "__second")

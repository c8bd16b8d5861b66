"""Range lists as files: loading, putting in order, and cutting overlaps into disjoint ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import ipv4

#: Addresses of a cell: ranges are cut apart cell by cell. The largest address.
CELL, LAST = 1 << 16, (1 << 32) - 1


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(lo, hi, asn, country, org) of tab-separated lines start, end, asn, country, org, gzip or not; bounds are IPv4 addresses or whole numbers.

    Comments, short lines and ranges that are no numbers, end before they begin or leave the address space are left out."""
    raw = spark.read.schema("start string, end string, asn string, country string, org string").option("sep", "\t").option("comment", "#").csv(path)
    number = lambda c: F.coalesce(ipv4(F.trim(c)), F.expr(f"try_cast(trim({c}) AS long)"))
    rows = raw.select(number("start").alias("lo"), number("end").alias("hi"), F.expr("try_cast(regexp_replace(asn, '^(AS|as)', '') AS long)").alias("asn"), "country", "org")
    return rows.where(F.col("lo").between(0, LAST) & F.col("hi").between(F.col("lo"), LAST) & F.col("asn").isNotNull())


def in_order(ranges: DataFrame) -> bool:
    """Whether the files' rows, as they are read, are already disjoint and ascending within every part and from part to part."""
    placed = ranges.select("lo", "hi", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    before = F.max("hi").over(W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, -1))  # a part is a split of a file
    each = placed.withColumn("late", F.coalesce(F.col("lo") <= before, F.lit(False))).groupBy("part").agg(F.max("late").alias("late"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    last = F.max("hi").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # one row a part
    return not each.withColumn("late", F.col("late") | F.coalesce(F.col("lo") <= last, F.lit(False))).where("late").limit(1).count()


def disjoint(ranges: DataFrame, cell: int = CELL) -> DataFrame:
    """Ranges without overlap that say of every address what the narrowest range over it says (of equal widths the smaller lo, then asn); neighbours that say the same are one.

    Ranges are clipped to cells of ``cell`` addresses; within a cell the bounds cut it into pieces, and each piece takes the best of the ranges over it. Pieces join again by
    what they say, so that a wide range costs its cells and no sort holds more than one label's pieces."""
    wide = ranges.select("*", F.struct((F.col("hi") - F.col("lo")).alias("width"), "lo", "asn", "country", "org").alias("best"))
    parts = wide.select("best", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))).alias("cell"), "lo", "hi")
    parts = parts.select("cell", "best", F.greatest("lo", F.col("cell") * cell).alias("lo"), F.least("hi", (F.col("cell") + 1) * cell - 1).alias("hi"))
    once = parts.groupBy("cell", "lo", "hi").agg(F.min("best").alias("best"))  # of equal pieces only the best counts
    bounds = once.select("cell", F.explode(F.array(F.col("lo"), F.col("hi") + 1)).alias("at")).distinct()
    pieces = bounds.withColumn("to", F.lead("at").over(W.partitionBy("cell").orderBy("at")) - 1).where("to IS NOT NULL")
    p = pieces.join(once.withColumnRenamed("cell", "of"), (F.col("cell") == F.col("of")) & (F.col("lo") <= F.col("at")) & (F.col("hi") >= F.col("to")))
    told = p.groupBy("cell", "at", "to").agg(F.min("best").alias("best")).select("at", "to", "best.asn", "best.country", "best.org")
    w = W.partitionBy("asn", "country", "org").orderBy("at")
    opened = told.withColumn("new", F.when(F.col("at") - 1 <= F.lag("to").over(w), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return opened.groupBy("asn", "country", "org", "run").agg(F.min("at").alias("lo"), F.max("to").alias("hi")).select("lo", "hi", "asn", "country", "org")


def load_ranges(spark: SparkSession, path: str, table: str | None = None, buckets: int = 32) -> DataFrame:
    """Ranges of a file, sorted only if need be and cut apart where they overlap. With ``table`` they are saved as that table, by cell and bucketed by it, for joins that then
    read both sides without a shuffle: a range stands there once for each cell that it touches."""
    rows = read_ranges(spark, path)
    rows = rows if in_order(rows) else disjoint(rows)
    if table:
        spread = rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / CELL), F.floor(F.col("hi") / CELL))))
        spread.write.mode("overwrite").bucketBy(buckets, "cell").sortBy("cell", "lo").saveAsTable(table)
        rows = spark.table(table)
    return rows

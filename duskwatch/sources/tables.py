"""Bindings of domain roles to the standard tables, and readers of feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str):
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})") / F.lit(1e6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device events: user_id is the device, k the destination, t the time in seconds, day and hour in UTC."""
    e = table(spark, sf_dir, "events")
    e = e.select("event_id", "user_id", "event_type", "value", epoch("ts").alias("t"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.withColumn("day", F.floor(F.col("t") / 86400).cast("long")).withColumn("hour", F.floor(F.col("t") / 3600).cast("long") % 24)


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as seen in URLs: page_id, url, host."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)).alias("host"))


def indicator_csv(spark: SparkSession, path: str) -> DataFrame:
    """Indicators (kind, value, confidence, feed) from CSV with # comments; lines that do not parse are left out."""
    rows = spark.read.schema("kind string, value string, confidence double, feed string").option("comment", "#").option("mode", "DROPMALFORMED").csv(path)
    return rows.withColumn("value", F.lower(F.trim("value"))).where("kind IN ('ip', 'cidr', 'domain', 'url', 'ja3') AND value <> ''")


def ip_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated start, end, asn, country, org; gzip is read as it is."""
    return spark.read.schema("start string, end string, asn long, country string, org string").option("sep", "\t").csv(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Event logs as JSON lines with a stated schema; columns the log lacks are null."""
    return spark.read.schema(schema).json(path)

"""Indicator feeds, rulesets, log streams and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import ip_class, ipv4


def hex_decode(content: Column) -> Column:
    """Rule content with its bytes between bars written out: ``ab|63 64|e`` is ``abcde``. Bytes are read as Latin-1; what is no hex stays out."""
    parts = F.split(content, r"\|")
    plain = F.transform(parts, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.coalesce(F.decode(F.unhex(F.regexp_replace(x, r"\s+", "")), "ISO-8859-1"), F.lit(""))))
    return F.array_join(plain, "")


def rule_indicators(lines: DataFrame, text: str = "value") -> DataFrame:
    """(kind, value, category) of ruleset lines: public addresses and the names in contents, hex written out. Comments and other lines give nothing."""
    rule = F.col(text)
    rows = lines.where(rule.rlike(r"^\s*(alert|drop|reject)\b")).select(
        F.regexp_extract(rule, r"classtype:\s*([\w-]+)", 1).alias("category"), F.regexp_extract_all(rule, F.lit(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), F.lit(0)).alias("ips"),
        F.transform(F.regexp_extract_all(rule, F.lit(r'content:\s*"([^"]*)"'), F.lit(1)), lambda x: F.lower(hex_decode(x))).alias("names"))
    address = rows.select("category", F.explode("ips").alias("value")).where(ip_class(ipv4(F.col("value"))) == "public").select(F.lit("ip").alias("kind"), "value", "category")
    name = rows.select("category", F.explode("names").alias("value")).where(F.col("value").rlike(r"^(?:[a-z0-9_-]+\.)+[a-z]{2,}$")).select(F.lit("domain").alias("kind"), "value", "category")
    return address.unionByName(name).distinct()


def feed(spark: SparkSession, path: str, shape: str, name: str, confidence: float = 0.8) -> DataFrame:
    """(kind, value, confidence, feed) of one of four shapes of list; lines with # are comments, lines that do not parse are left out.

    ``ip_csv``: an address, then perhaps a confidence. ``hostfile``: an address and a name a line. ``url_csv``: quoted URLs in the third column.
    ``typed_csv``: kind, value and confidence."""
    lines = spark.read.text(path).where("NOT value RLIKE '^[[:space:]]*(#|$)'")
    cells = F.split("value", r",")
    cell = lambda i: F.trim(F.regexp_replace(F.coalesce(F.get(cells, F.lit(i)), F.lit("")), '^"|"$', ""))
    given = lambda i: F.coalesce(F.expr(f"try_cast(trim(get(split(value, ','), {i})) AS double)"), F.lit(confidence))
    if shape == "ip_csv":
        rows = lines.select(F.lit("ip").alias("kind"), cell(0).alias("value"), given(1).alias("confidence")).where(ipv4(F.col("value")).isNotNull())
    elif shape == "hostfile":
        host = F.lower(F.get(F.split(F.trim("value"), r"\s+"), F.lit(1)))
        rows = lines.select(F.lit("domain").alias("kind"), host.alias("value"), F.lit(confidence).alias("confidence")).where("value LIKE '%.%'")
    elif shape == "url_csv":
        url = F.regexp_replace(F.lower(cell(2)), r"^[a-z]+://|[?#].*$", "")
        rows = lines.select(F.lit("url").alias("kind"), url.alias("value"), F.lit(confidence).alias("confidence")).where("value LIKE '%.%'")
    elif shape == "typed_csv":
        rows = lines.select(F.lower(cell(0)).alias("kind"), F.lower(cell(1)).alias("value"), given(2).alias("confidence")).where("kind IN ('ip', 'cidr', 'domain', 'url', 'ja3') AND value <> ''")
    else:
        raise ValueError(f"unknown shape of feed: {shape}")
    return rows.withColumn("feed", F.lit(name)).dropDuplicates(["kind", "value"])


def valid_or_last(fresh: DataFrame, last: DataFrame | None, least: int) -> DataFrame:
    """A feed's fresh rows if there are enough of them; else the last good ones."""
    return fresh if last is None or fresh.limit(least).count() >= least else last


def log_stream(spark: SparkSession, folder: str, schema: str, per_batch: int = 100) -> DataFrame:
    """New JSON-lines files of a folder as a stream; the query's checkpoint is the cursor, so rotated files are read once. Missing columns are null."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(folder)


def alert_sink(alerts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Alerts (with ``ts``) as JSON lines in a folder for each UTC day, written exactly once; readers prune old days."""
    dated = alerts.withColumn("date", F.to_date("ts"))
    return dated.writeStream.format("json").partitionBy("date").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_alerts(spark: SparkSession, path: str, days: int, schema: str | None = None) -> DataFrame:
    """The newest days of an alert folder: only their partitions are read. With ``schema`` (without the folders' ``date``) an empty folder gives no rows instead of an error."""
    every = spark.read.schema(f"{schema}, date date").json(path) if schema else spark.read.json(path)
    last = every.select(F.max("date").alias("d")).first()["d"]
    return every.where(F.col("date") > F.date_sub(F.lit(last).cast("date"), days))


def archive(rows: DataFrame, path: str, before: str) -> DataFrame:
    """Rows older than the timestamp ``before`` go to compressed JSON lines at ``path``; what stays is returned."""
    old = F.col("ts") < F.to_timestamp(F.lit(before))
    rows.where(old).write.mode("append").option("compression", "gzip").json(path)
    return rows.where(~old | F.col("ts").isNull())


def upsert(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest row (by ``ts``, of equal times the larger as JSON text) of each key in Parquet versions below ``path``: every batch is merged with the last version into the next.

    Only the last two versions stay: a batch that is run again after a failure finds the one it began from."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        both = batch if number == 0 else batch.unionByName(spark.read.parquet(f"{path}/version={number - 1}"), allowMissingColumns=True)
        newest = both.groupBy(key).agg(F.max_by(F.struct(*both.columns), F.struct("ts", F.to_json(F.struct(*both.columns)))).alias("row"))
        newest.select("row.*").write.mode("overwrite").parquet(f"{path}/version={number}")
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Shared helpers: written tables in the cluster's shared folder, checked broadcasts, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most this many narrow rows (16 bytes each: 8 MB).
BROADCAST_ROWS = 500_000
#: Whether shuffle files are deleted at the end of the query that made them; Spark's default is not.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one of our own only where that is unset and everything runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="duskwatch-"))


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends, and lost executors lose nothing.

    What it shuffled goes with the write; otherwise it would lie on the executors' disks until the driver collects its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def keeping(rows: DataFrame, keys: DataFrame, on: str, count: int) -> DataFrame:
    """Rows whose ``on`` is among ``keys``. Keys go to every executor only if their number is small; else both shuffle."""
    return rows.join(F.broadcast(keys) if count <= BROADCAST_ROWS else keys, on, "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of the undirected ``edges`` (a, b); component is the smallest reachable id.

    Large-star and small-star rounds over written tables: each round is two grouped minima with a join, so no vertex's
    neighbours are gathered in one place, and a hub's rows can be split by the skew join.
    """

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        small = written(small.where("a <> b").distinct())
        dropped(now, large)
        now, after = small, mark(small)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())

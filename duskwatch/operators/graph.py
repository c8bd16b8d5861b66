"""Operators over redirects and links between identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of the undirected ``edges`` (a, b); component is the smallest id reachable.

    Large-star and small-star rounds over written tables: each round is two grouped minima with a join, so no vertex's neighbours are gathered in one
    place and a hub's rows can be split by the skew join. Rounds follow the logarithm of the longest path. Loops and null ends link nothing.
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


def canonical(redirects: DataFrame, source: str, target: str, rounds: int = 40) -> DataFrame:
    """``redirects`` (one target for each source) with ``canonical``, the end of each chain.

    Pointer jumping: each round replaces a target by its target's target, so a chain of length n takes log2 n rounds of one
    equality join, each over a table written anew. Null ends are left out. A cycle never settles; it raises ValueError.
    """
    rows = redirects.where(F.col(source).isNotNull() & F.col(target).isNotNull())
    now = written(rows.select(F.col(source).alias("at"), F.col(target).alias("to")))
    for _ in range(rounds):
        step = now.select(F.col("at").alias("to"), F.col("to").alias("further"))
        after = written(now.join(step, "to", "left").select("at", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        dropped(now)
        now = after
        if not now.where("moved").limit(1).count():
            ends = now.select(F.col("at").alias(source), F.col("to").alias("canonical"))
            return rows.drop("canonical").join(ends, source)
    raise ValueError("a chain of redirects does not end: it holds a cycle")

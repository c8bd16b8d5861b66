"""What stays of tables that refer to each other, and where to cut a table that outgrew its budget."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts that the governor cuts a table into at each step, and rows of a part that are summed in one task.
PARTS, LEAST_ROWS = 1000, 10_000


@dataclass
class Policy:
    """How long rows of a table live.

    ``days`` is their age limit by ``t`` (None: age never removes them); a row past it still lives while a surviving row of one of ``cited_by`` (table, column) names it. With
    ``only_cited`` it lives no longer than something names it, however young. ``parents`` (column, table) end a row together with the row they name, ``detached`` ones only lose the
    reference, and ``where`` restricts the policy to some rows; others stay. A policy sees the survivors of those before it, so citing tables come first."""

    table: str
    key: str
    days: float | None = None
    t: str = "t"
    cited_by: list[tuple[str, str]] = field(default_factory=list)
    only_cited: bool = False
    parents: list[tuple[str, str]] = field(default_factory=list)
    detached: list[tuple[str, str]] = field(default_factory=list)
    where: str = "true"


def survivors(tables: dict[str, DataFrame], policies: list[Policy], now: float) -> dict[str, DataFrame]:
    """The rows of each table that stay, as one plan a table: an ordered cascade of semi-joins on distinct keys. Null references name nothing and end nothing."""
    keys = {p.table: p.key for p in policies}
    kept = dict(tables)
    for p in policies:
        rows = kept[p.table]
        for column, other in p.parents:
            alive = kept[other].select(F.col(keys[other]).alias(column)).distinct()
            rows = rows.where(f"{column} IS NULL").unionByName(rows.join(alive, column, "left_semi").select(*rows.columns))
        for column, other in p.detached:
            alive = kept[other].select(F.col(keys[other]).alias(column), F.lit(True).alias("__alive")).distinct()
            rows = rows.join(alive, column, "left").withColumn(column, F.when(F.col("__alive"), F.col(column))).select(*rows.columns)
        bound = F.coalesce(F.expr(p.where), F.lit(False))
        old = F.lit(False) if p.days is None else F.coalesce(F.col(p.t) < now - p.days * 86_400, F.lit(False))
        if p.cited_by:
            cited = kept[p.cited_by[0][0]].select(F.col(p.cited_by[0][1]).alias(p.key))
            for other, column in p.cited_by[1:]:
                cited = cited.unionByName(kept[other].select(F.col(column).alias(p.key)))
            marked = rows.join(cited.distinct().withColumn("__cited", F.lit(True)), p.key, "left")
            dead = F.col("__cited").isNull() & (F.lit(True) if p.only_cited else old)
            rows = marked.where(~(bound & dead)).select(*rows.columns)
        else:
            rows = rows.where(~(bound & old))
        kept[p.table] = rows
    return kept


def size_cut(rows: DataFrame, budget: float, t: str = "t", key: str = "id", size: str = "bytes") -> tuple[float, object] | None:
    """(t, key) of the newest row that must go so that the rest fits ``budget``; None where all fits.

    Rows go in order of (t, key), oldest first. Each step sums the bytes of up to PARTS ranges and goes on inside the one that holds the cut, first by time, then
    by key among rows of one time; a range of at most LEAST_ROWS rows, or one (t, key), is summed row by row. No step sorts more than that in one task.
    Null sizes count as nothing; rows without time or key are left out.
    """
    rows = rows.where(F.col(t).isNotNull() & F.col(key).isNotNull()).select(F.col(t).alias("t"), F.col(key).alias("key"), F.coalesce(F.col(size).cast("double"), F.lit(0.0)).alias("b"))
    total = rows.agg(F.sum("b")).first()[0] or 0.0
    excess = total - budget
    if excess <= 0:
        return None
    by, before = "t", 0.0
    while True:
        if rows.limit(LEAST_ROWS + 1).count() <= LEAST_ROWS:
            running = rows.withColumn("sum", F.sum("b").over(W.orderBy("t", "key").rowsBetween(W.unboundedPreceding, 0)) + before)  # at most LEAST_ROWS rows
            last = running.where(F.col("sum") >= excess).orderBy("t", "key").first() or running.orderBy(F.desc("t"), F.desc("key")).first()
            return last["t"], last["key"]
        ends = sorted(set(rows.agg(F.percentile_approx(by, F.array(*[F.lit(k / PARTS) for k in range(PARTS + 1)]), 100 * PARTS)).first()[0]))
        if len(ends) == 1 and by == "t":
            rows, by = rows.where(F.col("t") == ends[0]), "key"
            continue
        if len(ends) == 1:
            return rows.first()["t"], ends[0]
        part = F.array_size(F.filter(F.array(*map(F.lit, ends[:-1])), lambda e: e < F.col(by)))
        held = before
        for r in rows.groupBy(part.alias("part")).agg(F.sum("b").alias("b")).orderBy("part").collect():  # at most PARTS rows
            if held + r["b"] >= excess:
                break
            held += r["b"]
        before, rows = held, rows.where(part == r["part"])

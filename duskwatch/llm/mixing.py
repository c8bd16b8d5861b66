"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import dropped, written

#: The draw's 2**32 values in 4096 equal buckets, so that no window holds more than a bucket of one source.
BUCKET_BITS = 20


def word_count(text: Column) -> Column:
    """Words between blanks (space, tab to carriage return); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame, order: Column) -> DataFrame:
    """Adds ``rank`` from 0 in ``order``, without one task that holds all sources: range partitions, then their offsets."""
    parts = written(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("offset"))
    local = F.row_number().over(W.partitionBy("part").orderBy(order)) - 1
    return written(parts.withColumn("local", local).join(before, "part").withColumn("rank", F.col("local") + F.col("offset")).drop("part", "local", "offset"))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """Water-filling over (key, source, source_size): weight by rank, target = min(epochs * size, level * weight).

    The level starts at the plain share for each unit of weight. Each round clamps sources above their cap and shares what they
    give up among the others by weight; a clamped source stays clamped, as the level only rises. Rounds are grouped sums.
    """
    order = F.col("source").asc_nulls_last()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = ranked(sources, order).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    want = share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("cap")
        given, open_ = table.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (want - given) / open_ if open_ else level
        if level is not None and (not open_ or new <= level * (1 + 1e-14)):
            break
        level = new
        if level is None:
            level = 0.0
            break
    return table.withColumn("target", F.round(F.least("cap", F.col("weight") * F.lit(level)), 6))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, taken, copies.

    Sources in code-point order (null last, a source like any other) get ``weights`` in turn. Together they take ``share`` of
    all words; no source exceeds ``epochs`` times its words, and the excess goes to the others by weight. Every document
    of a source is taken floor(target / source_size) times; then documents in the order of a seeded draw are taken
    once more until the rest of the target is filled to the nearest document. The draw depends on seed and id alone, so reruns agree.

    Null or empty texts have size 0 and take nothing. A null id draws as the empty string. Equal ids draw alike and are ordered by size;
    repeated rows count each. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), ident)), 1, 8), 16, 10).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("-"))
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"), word_count(F.col(text_col)).alias("size"), draw.alias("draw")).withColumn("bucket", F.shiftright("draw", BUCKET_BITS)))
    hist = written(sized.groupBy("key", "bucket").agg(F.sum("size").alias("words"), F.first("source").alias("source")))
    sources = targets(hist.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), weights, share, epochs)
    at = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    hist = hist.select("key", "bucket", F.coalesce(F.sum("words").over(at), F.lit(0)).alias("earlier")).join(sources.select("key", "source_size", "target"), "key")
    at = W.partitionBy("key", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    middle = F.col("earlier") + F.sum("size").over(at) - F.col("size") / 2
    return (
        sized.join(hist, ["key", "bucket"]).withColumn("whole", whole).withColumn("copies", F.col("whole") + F.when((F.col("size") > 0) & (middle <= rest), 1).otherwise(0))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), F.col("copies").cast("long").alias("copies"))
    )


#: DuckDB SQL for mix_sources with its defaults, over the relation {docs}.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS draw
  FROM {docs}
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, 2.0 * source_size AS cap,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM totals
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM weighted
), levels AS (
  SELECT *, ((SELECT 1.5 * sum(source_size) FROM totals)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ordered
), chosen AS (SELECT arg_min(level, k) FILTER (WHERE level * weight <= cap) AS level, max(level) AS top FROM levels
), filled AS (
  SELECT source, source_size, round(least(cap::DOUBLE, weight * (SELECT coalesce(level, top) FROM chosen)), 6)::DOUBLE AS target FROM weighted
), placed AS (
  SELECT d.*, f.source_size, f.target, CASE WHEN f.source_size > 0 THEN floor(f.target / f.source_size) ELSE 0 END AS whole,
         sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
  FROM sized d JOIN filled f ON d.source IS NOT DISTINCT FROM f.source
), final AS (
  SELECT *, (whole + CASE WHEN size > 0 AND middle <= target - whole * source_size THEN 1 ELSE 0 END)::BIGINT AS copies FROM placed
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM final
"""

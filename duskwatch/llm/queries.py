"""The operators over the standard tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, covertree, decontamination, divergence, licenses, lines, minhash, mixing, paragraphs, suffixes, surrogates, toxicity, urls

HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.embedding_near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(f"NOT ({HELD_OUT})"))
    return toxicity.score_toxicity(docs, model).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.duplicate_lines(table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def _is(kind: str):
    return lambda x: F.when(x == kind, 1).otherwise(0)


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates.with_surrogates(table(spark, sf_dir, "documents"))
    kinds = F.transform("entities", lambda e: e["kind"])
    counts = [F.size(F.array_remove(F.transform(kinds, _is(k)), F.lit(0))).cast("long").alias(f"n_{k}") for k in surrogates.KINDS]
    return found.select("doc_id", F.size("entities").cast("long").alias("n_entities"), *counts, F.sha2("text", 256).alias("text_sha256"))


#: Documents of one source and language that stand in a directory together, by id, as the shards of a collection do.
SHARD = 64


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source: path source/lang/shard/doc_id, or source/lang/shard/LICENSE-doc_id for those that consist mainly of licence text."""
    name = F.concat(F.when(licenses.mainly_licence(F.col("text")), "LICENSE-").otherwise(""), F.col("doc_id").cast("string"))
    shard = F.floor(F.col("doc_id") / SHARD).cast("string")
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", shard, name).alias("path"), "text")
    return licenses.scan_licenses(files).withColumn("doc_id", F.regexp_replace(F.substring_index("path", "/", -1), "^LICENSE-", "").cast("long"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


#: The rules of the URL filter (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Words of a host's name whose pages stand for a published list of URLs to block, as the tables hold no such list.
LISTED = "ads adult bet bets casino pills porn spam xxx"


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    names = F.split(urls.host(F.col("url")), "[.-]")
    listed = pages.where(F.arrays_overlap(names, F.split(F.lit(LISTED), " "))).select("url")
    return urls.judge_urls(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"), listed)


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_benchmark_decontamination, op2_embedding_near_dedup, op3_minhash_near_dedup, op4_substring_dedup, op5_line_dedup,
        op6_source_mixing, op7_toxicity_crf, op8_suffix_array_dedup, op9_pii_surrogates, op10_license_scan,
        op11_source_divergence, op12_url_filter, op13_cross_tokenizer_alignment,
    )
    return {f.__name__: f for f in every}


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: x * x)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, min(r) AS component_id, e.vec_id = min(r) AS kept
FROM embeddings e JOIN reach ON reach.id = e.vec_id GROUP BY e.vec_id
"""

OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes m ON m.doc_id = a JOIN sizes k ON k.doc_id = b WHERE 100 * shared >= 85 * (m.n + k.n - shared)
), reach AS (
  SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM documents d JOIN reach ON reach.id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id
"""


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), occ AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS c FROM occ GROUP BY ALL HAVING count(DISTINCT r) >= 30
), groups AS (SELECT DISTINCT lang, source FROM d
), whole AS (SELECT lang, count(term) AS v, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang
), counts AS (SELECT lang, source, term, count(*) AS c FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL
), sums AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT s.lang, s.source, k.term, coalesce(t.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(t.c, 0) + 5) // (s.n + 5 * w.v) AS p, 1 + 1000000000::HUGEINT * (k.c + 5) // (w.n + 5 * w.v) AS q
  FROM sums s JOIN whole w ON w.lang = s.lang JOIN kept k ON k.lang = s.lang LEFT JOIN counts t ON t.lang = s.lang AND t.source = s.source AND t.term = k.term
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE c > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM parts QUALIFY part = 'pair' OR rank <= 50
"""
SHAPE = urls.SHAPE
OP12_SQL = rf"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id, url, translate(coalesce(regexp_extract(url, '{SHAPE}', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
    coalesce(regexp_extract(url, '{SHAPE}', 2), '') AS path, string_split(substr(coalesce(regexp_extract(url, '{SHAPE}', 3), ''), 2), '&') AS asked FROM pages
), named AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || '?'
    || array_to_string(list_sort(list_filter(asked, lambda x: x <> '' AND NOT regexp_matches(x, '{urls.TRACKING}'))), '&') END AS name FROM u
), listed AS (SELECT DISTINCT name FROM named WHERE list_has_any(regexp_split_to_array(host, '[.-]'), string_split('{LISTED}', ' '))
), rules(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best AS (
  SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN name IN (SELECT name FROM listed WHERE name IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict,
  rule IS NULL AND coalesce(name IN (SELECT name FROM listed WHERE name IS NOT NULL), false) AS listed FROM named LEFT JOIN best USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": OP11_SQL, "op12_url_filter": OP12_SQL, "op2_embedding_near_dedup": OP2_SQL, "op3_minhash_near_dedup": OP3_SQL, "op6_source_mixing": mixing.MIX_SQL.replace("{docs}", "documents")}

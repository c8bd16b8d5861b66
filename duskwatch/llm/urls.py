"""URLs judged by a list of hosts, paths and whole URLs: a blocked Bloom filter passes possible hits to an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import BROADCAST_ROWS, dropped, written

#: Bits of the filter for each listed entry; blocks of 512 bits hold 8 words of 64 bits, and an entry sets one bit in each word.
BITS = 16
WORDS = 8
#: Blocks (72 bytes each) up to which the filter goes to every executor; a larger one meets the candidates by their block.
BROADCAST_BLOCKS = 100_000
#: Parameters of a query that say where a visitor came from and not which page is meant.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host and path of a URL: from the first ``://`` on.
SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty where there is no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, SHAPE, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, SHAPE, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """``//host/path?query`` of a URL: no scheme, user, default port or fragment, host in lower case, no slash at the path's end, parameters in order without those that
    only track; null where there is no ``://``."""
    place = F.regexp_replace(F.regexp_replace(host(url), "^[^@]*@", ""), ":(80|443)$", "")
    asked = F.substring(F.regexp_extract(url, SHAPE, 3), 2, 2**31 - 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.instr(url, "://") > 0, F.concat(F.lit("//"), place, F.regexp_replace(path(url), "/+$", ""), query))


def _spot(entry: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(entry), F.lit(blocks)).alias("block")


def _bit(entry: Column, word: int) -> Column:
    """The bit of an entry in a word: six bits of a second hash."""
    place = F.shiftright(F.xxhash64(entry, F.lit(7)), 6 * word).bitwiseAND(63).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom(entries: DataFrame, count: int) -> tuple[DataFrame, int]:
    """(block, w0 ... w7) of the column ``entry``, and the number of blocks for ``count`` entries; made by grouped bit sums, map-side first."""
    blocks = max(1, -(-count * BITS // (64 * WORDS)))
    return entries.groupBy(_spot(F.col("entry"), blocks)).agg(*[F.bit_or(_bit(F.col("entry"), k)).alias(f"w{k}") for k in range(WORDS)]), blocks


def possible(candidates: DataFrame, entries: DataFrame, count: int) -> DataFrame:
    """``candidates`` whose ``entry`` the filter of ``entries`` may hold: every listed one, and about one in 1700 others."""
    blocks, n = bloom(entries, count)
    blocks = written(blocks)
    found = candidates.withColumn("block", _spot(F.col("entry"), n)).join(F.broadcast(blocks) if n <= BROADCAST_BLOCKS else blocks, "block")
    for k in range(WORDS):
        found = found.where(F.col(f"w{k}").bitwiseAND(_bit(F.col("entry"), k)) != 0)
    return found.drop("block", *[f"w{k}" for k in range(WORDS)])


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, listed.

    ``rules`` (host, path, verdict) fit a host and all its subdomains where the URL's path starts with the rule's (so the path is empty or begins with ``/``); the longest of those that fit (host and path
    together, then the longer host) gives ``rule`` (host and path) and the verdict. ``listed`` (url) are URLs to block: a URL without a fitting rule is blocked if its canonical
    form (:func:`canonical`) is that of a listed one, else allowed. Rules without host and listed URLs that are null fit nothing; of equal rules ``block`` wins.
    A null URL, or one without ``://``, has an empty host and path and is allowed. Repeated rows stay; other columns are ignored.

    Rules and canonical URLs are entries of one blocked Bloom filter. Each URL's candidates are its canonical form and its host's endings with its path's beginnings, of
    the sizes that occur among the rules; only those that the filter may hold reach the exact join. The filter and the list are broadcast up to a checked size
    and shuffle beyond it. Rows and their hits meet in one grouping by (page_id, url), where equal rows meet before the shuffle.
    """
    usable = r"host <> '' AND host NOT RLIKE '[/?#]' AND verdict IS NOT NULL AND (path IS NULL OR path = '' OR path LIKE '/%')"
    known = rules.where(usable).select(F.translate("host", UPPER, LOWER).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict")
    by_rule = known.select(F.concat("h", "p").alias("entry"), F.size(F.split("h", r"\.")).alias("labels"), F.length("p").alias("long"), F.length("h").alias("wide"), "verdict")
    by_url = listed.select(canonical(F.col("url")).alias("entry")).where("entry IS NOT NULL").distinct()
    by_url = by_url.select("entry", F.lit(0).alias("labels"), F.lit(-1).alias("long"), F.lit(0).alias("wide"), F.lit("block").alias("verdict"))
    entries = written(by_rule.unionByName(by_url).groupBy("entry", "labels", "long", "wide").agg(F.max("verdict").alias("verdict")))
    count = entries.count()
    sizes = F.array_sort(F.collect_set(F.struct("labels", "long")))  # as many as there are shapes of rules
    shapes = [(r["labels"], r["long"]) for r in entries.where("labels > 0").agg(sizes.alias("x")).first()["x"]]

    rows = pages.select("page_id", "url").select("page_id", "url", host(F.col("url")).alias("h"), path(F.col("url")).alias("p"), F.split(host(F.col("url")), r"\.").alias("parts"))
    fits = [
        F.when((F.size("parts") >= labels) & (F.length("p") >= long), F.concat(F.array_join(F.slice("parts", -labels, labels), "."), F.substring("p", 1, long))) for labels, long in shapes
    ]
    tried = rows.select("page_id", "url", F.explode(F.array(canonical(F.col("url")), *fits)).alias("entry")).where("entry IS NOT NULL")
    exact = entries.select("entry", F.struct((F.col("long") >= 0).alias("by_rule"), (F.col("wide") + F.col("long")).alias("size"), "wide", "verdict", "entry").alias("best"))
    hits = possible(tried, entries, count).join(F.broadcast(exact) if count * 2 <= BROADCAST_ROWS else exact, "entry").select("page_id", "url", F.lit(0).cast("long").alias("n"), "best")
    every = pages.select("page_id", "url", F.lit(1).cast("long").alias("n"), F.lit(None).cast(dict(hits.dtypes)["best"]).alias("best")).unionByName(hits)
    once = every.groupBy("page_id", "url").agg(F.sum("n").alias("n"), F.max("best").alias("best")).where("n > 0")
    once = once.select("page_id", "url", "best", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    rule = F.when(F.col("best.by_rule"), F.col("best.entry"))
    listing = F.coalesce(~F.col("best.by_rule"), F.lit(False))
    return once.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), rule.alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), listing.alias("listed"))

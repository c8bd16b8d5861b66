"""Groups of linked sets from candidate buckets, at a cost that follows the rows and not the square of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import components, dropped, written

#: Members of a bucket that are paired directly; larger buckets go through pivot rounds and their members' items.
SMALL = 24
#: Pivot rounds go on while one lessens the rows of large buckets that hold several components by at least this share.
PROGRESS = 0.2
#: Words of 64 bits in a parity sketch.
SKETCH = 4
#: Sets of a component that stand together in one row of an item, about.
TOGETHER = 64
#: Pairs that are shuffled at once, about, each counted once for every item that gives it; one of so many items tells how many there are.
PAIRS_AT_ONCE, TRIAL = 40_000_000, 32


def prefix_pairs(items: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may reach the similarity, by prefix, length and position bounds; none is missed.

    Each set (id, item, n) is put in the order of its items' frequency, rarest first. Two sets x, y (y no larger) with
    100 * both >= percent * union share an item among the first n - ceil(percent n) + 1 of x and the first
    n - ceil(2 percent / (1 + percent) n) + 1 of y, and at their first shared item enough must be left of either to reach the overlap.
    Members of one component are never paired. Edited copies put what they alone hold first, so they share few prefix items.
    A sketch holds the parity of the number of items in each of 64 * SKETCH buckets: where two sketches differ, an item is in one set alone,
    so the bits that differ bound the symmetric difference from below, and a pair beyond what the similarity allows is no candidate.
    The same bounds, by the extremes of an item's sets in a part of a component (and by the sketch where it is one set), first leave out pairs of parts.
    A row holds the sets of a part, so what is shuffled before the bounds follows the sets' items. Only pairs that pass are shuffled, which a pair does for each item
    it shares; so items take turns if there are many: a share of them gives its pairs, each pair is kept once, then the next share follows.
    """
    sizes = labels.groupBy("c").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    labels = labels.join(sizes, "c").select("id", "c", F.pmod(F.xxhash64("id"), "parts").alias("part"))
    rows = items.join(items.groupBy("item").agg(F.count("*").alias("df")), "item")
    at = F.row_number().over(W.partitionBy("id").orderBy("df", "item"))
    p = F.lit(percent)
    probe = F.col("n") - F.ceil(p * F.col("n") / 100) + 1
    index = F.col("n") - F.ceil(2 * p * F.col("n") / (100 + p)) + 1
    spot = F.xxhash64("item")
    for k in range(SKETCH):
        bit = F.when(F.pmod(F.shiftright(spot, 6), F.lit(SKETCH)) == k, F.expr("shiftleft(1L, int(xxhash64(item) & 63))")).otherwise(F.lit(0).cast("long"))
        rows = rows.withColumn(f"s{k}", F.bit_xor(bit).over(W.partitionBy("id")))
    rows = written(rows.withColumn("at", at).where(F.col("at") <= probe).withColumn("indexed", F.col("at") <= index).drop("df").join(labels, "id"))

    def spans(side: DataFrame, v: str, i: str) -> DataFrame:
        """Of each item and part of a component the extremes of its sets, and the sets themselves as ``v``s."""
        alone = [F.when(F.count("*") == 1, F.min(f"s{k}")).alias(f"s{v}{k}") for k in range(SKETCH)]
        one = F.struct(F.col("id").alias(v), F.col("n").alias(f"n{v}"), F.col("at").alias(i), *[F.col(f"s{k}").alias(f"s{v}{k}") for k in range(SKETCH)])
        extremes = F.min("n").alias(f"low{v}"), F.max("n").alias(f"high{v}"), F.max(F.col("n") - F.col("at")).alias(f"room{v}")
        return side.groupBy("item", F.col("c").alias(f"c{v}"), "part").agg(*extremes, *alone, F.collect_list(one).alias(f"{v}s")).drop("part")

    most_apart = sum((F.coalesce(F.bit_count(F.col(f"sx{k}").bitwiseXOR(F.col(f"sy{k}"))), F.lit(0)) for k in range(SKETCH)), F.lit(0))
    may = (
        (F.col("cx") != F.col("cy")) & (F.col("lowy") <= F.col("highx")) & (100 * F.col("highy") >= percent * F.col("lowx"))
        & ((100 + percent) * (F.lit(1) + F.least("roomx", "roomy")) >= percent * (F.col("lowx") + F.col("lowy")))
        & ((100 + percent) * most_apart <= (100 - percent) * (F.col("highx") + F.col("highy")))
    )
    left = F.lit(1) + F.least(F.col("nx") - F.col("i"), F.col("ny") - F.col("j"))
    apart = sum((F.bit_count(F.col(f"sx{k}").bitwiseXOR(F.col(f"sy{k}"))) for k in range(SKETCH)), F.lit(0))
    fits = (
        ((F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x"))))
        & (100 * F.col("ny") >= percent * F.col("nx")) & ((100 + percent) * left >= percent * (F.col("nx") + F.col("ny")))
        & ((100 + percent) * apart <= (100 - percent) * (F.col("nx") + F.col("ny")))
    )

    def passing(rows: DataFrame) -> DataFrame:
        parts = spans(rows, "x", "i").join(spans(rows.where("indexed"), "y", "j"), "item").where(may).select("xs", "ys")
        sets = parts.select("xs", F.inline("ys")).select(F.inline("xs"), "y", "ny", "j", *[f"sy{k}" for k in range(SKETCH)])
        return sets.where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    turns = max(1, -(-passing(rows.where(F.pmod(spot, F.lit(TRIAL)) == 0)).count() * TRIAL // PAIRS_AT_ONCE))
    pairs = written(passing(rows.where(F.pmod(F.xxhash64("item", F.lit(1)), F.lit(turns)) == 0)).distinct())
    for turn in range(1, turns):
        older, more = pairs, passing(rows.where(F.pmod(F.xxhash64("item", F.lit(1)), F.lit(turns)) == turn))
        pairs = written(older.unionByName(more).distinct())
        dropped(older)
    dropped(rows)
    return pairs


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after further links (a, b): only the components that these join are worked on."""
    ends = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    ends = written(ends)
    edges = links.join(ends.select(F.col("id").alias("a"), F.col("component").alias("x")), "a").join(ends.select(F.col("id").alias("b"), F.col("component").alias("y")), "b")
    joined = written(components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct()))
    every = labels.unionByName(ends.join(labels, "id", "left_anti"))
    lower = joined.select(F.col("component").alias("low"), F.col("id").alias("component"))
    out = written(every.join(lower, "component", "left").select("id", F.coalesce("low", "component").alias("component")))
    dropped(ends, joined)
    return out


def linked_groups(buckets: DataFrame, confirm, items, percent: int) -> DataFrame:
    """(id, component) over the links that ``confirm`` finds among candidates that share a bucket (key, id).

    ``buckets`` may hold a weight ``w`` for each id. First every member of a bucket is held against the bucket's heaviest id (of equals the smallest), which
    then leaves the bucket: a line or text that stands many times unchanged is the one that its edited copies are near to. Where what is left still holds several
    components, buckets of at most SMALL members give their pairs of different components. In larger ones pivot rounds hold the members of the other
    components against one drawn member, which leaves too, as long as that gets ahead; of the rest pairs are found by the members' items
    (from ``items(ids, count)``). Pairs inside a component cannot change it, so a group of copies costs its size, not its square, and no link
    that could join two components is lost.
    """
    buckets = buckets if "w" in buckets.columns else buckets.withColumn("w", F.lit(0).cast("long"))
    best = F.struct("w", (-F.col("id")).alias("i"))
    heads = buckets.groupBy("key").agg(F.max(best)["i"].alias("i"), F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    heads = written(heads.select("key", (-F.col("i")).alias("head")))  # written, so that the join shuffles both sides and a large bucket can be split
    rest = written(buckets.join(heads, "key").where("id <> head").distinct())
    dropped(heads)
    tried = written(rest.select(F.col("head").alias("a"), F.col("id").alias("b")).distinct())
    links = confirm(tried)
    labels = written(components(links))
    dropped(links)
    before, turn = None, 0

    def untried(pairs: DataFrame) -> DataFrame:
        """Pairs that no round had yet, and from now on has."""
        nonlocal tried
        new = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
        older, tried = tried, written(tried.unionByName(new))
        dropped(older)
        return new

    def linked(pairs: DataFrame) -> None:
        nonlocal labels
        links = confirm(pairs)
        if not links.isEmpty():
            older, labels = labels, merged(labels, links)
            dropped(older)
        dropped(links, pairs)

    while True:
        label = written(rest.select("key", "id", "w").join(labels, "id", "left").select("key", "id", "w", F.coalesce("component", "id").alias("c")))
        mixed = label.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
        open_ = written(label.join(mixed, "key"))
        dropped(label, rest)
        small = open_.where(F.col("n") <= SMALL)
        x, y = (small.select("key", F.col("id").alias(i), F.col("c").alias(c)) for i, c in (("a", "ca"), ("b", "cb")))
        linked(untried(x.join(y, "key").where("a < b AND ca <> cb").select("a", "b")))
        rows = open_.where(F.col("n") > SMALL).count()
        if not rows or (before is not None and rows > before * (1 - PROGRESS)):
            break
        before, turn = rows, turn + 1
        large = open_.where(F.col("n") > SMALL).select("key", "id", "w", "c")
        pivots = large.groupBy("key").agg(F.max_by(F.struct("id", "c"), F.struct("w", F.xxhash64("id", F.lit(turn)))).alias("pivot"))
        held = written(large.join(pivots, "key").where("id <> pivot.id"))
        linked(untried(held.where("c <> pivot.c").select(F.col("id").alias("a"), F.col("pivot.id").alias("b"))))
        rest = written(held.select("key", "id", "w"))
        dropped(open_, held)
    if rows:
        left = written(open_.where(F.col("n") > SMALL).select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("c")))
        sets = written(items(left.select("id"), left.count()))
        likely = prefix_pairs(sets, left, percent)
        linked(untried(likely))
        dropped(sets, likely, left)
    dropped(open_, tried)
    return labels

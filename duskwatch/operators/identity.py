"""Merging identities with a log from which a wrong merge is undone, and the merge of their metadata in one aggregation.

Every merge and split writes its tables anew, so that a chain of versions is no chain of plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import written

#: Addresses that a merged identity keeps, newest first.
MOST_ADDRESSES = 8
#: Columns of an identity: two written first by the device seen first, one by the device seen last, numbers that add up, and addresses with the time each was first seen.
PROFILE = "id long, first_seen double, last_seen double, mac string, host string, kind string, counters map<string,bigint>, addresses array<struct<since: double, address: string>>"


def merge_metadata(rows: DataFrame, key: str, most: int = MOST_ADDRESSES) -> DataFrame:
    """One profile (PROFILE) for each ``key`` of the profiles ``rows``, in one aggregation.

    The times span all; ``mac`` and ``host`` are the first ones known (by first_seen, then id), ``kind`` the last known (by last_seen, then id); counters add up name by name; addresses are
    united with the earliest time each was seen, and the ``most`` newest stay, newest first, of equal times the smaller. Unknown values (null, empty) give way to known ones.
    """
    first = F.struct("first_seen", "id")

    def known(c: str):
        return F.col(c).isNotNull() & (F.col(c) != "")

    counters = F.transform(F.map_entries("counters"), lambda e: F.struct(F.lit(0).alias("sort"), e["key"].alias("name"), e["value"].cast("double").alias("x")))
    places = F.transform("addresses", lambda a: F.struct(F.lit(1).alias("sort"), a["address"].alias("name"), a["since"].alias("x")))
    items = F.filter(F.concat(F.coalesce(counters, F.array()), F.coalesce(places, F.array())), lambda x: x["name"].isNotNull())
    base = rows.groupBy(key).agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min_by("mac", F.when(known("mac"), first)).alias("mac"),
        F.min_by("host", F.when(known("host"), first)).alias("host"), F.max_by("kind", F.when(known("kind"), F.struct("last_seen", (-F.col("id")).alias("i")))).alias("kind"))
    parts = rows.select(key, F.explode(items).alias("e")).groupBy(key, "e.sort", "e.name").agg(F.sum("e.x").alias("total"), F.min("e.x").alias("since"))  # a name's rows meet before the profile's
    newest = F.array_sort(F.collect_list(F.when(F.col("sort") == 1, F.struct((-F.col("since")).alias("age"), "name"))))
    named = F.array_sort(F.collect_list(F.when(F.col("sort") == 0, F.struct("name", F.col("total").cast("long").alias("n")))))
    lists = parts.groupBy(key).agg(F.map_from_entries(named).alias("counters"), F.transform(F.slice(newest, 1, most), lambda a: F.struct((-a["age"]).alias("since"), a["name"].alias("address"))).alias("addresses"))
    return base.join(lists, key, "left").withColumnRenamed(key, "id").selectExpr(
        "id", "first_seen", "last_seen", "mac", "host", "kind", "coalesce(counters, cast(map() as map<string,bigint>)) AS counters", "coalesce(addresses, array()) AS addresses")


def merge(profiles: DataFrame, log: DataFrame, groups: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """(profiles, log) after the identities of each group (id, canonical) became one; ids without a group, or alone in it, stay as they are.

    The log (version, id, canonical, profile) has for each member of a merge the profile that it brought, the canonical one's too, and what earlier merges pointed at a
    member points at the new canonical from this version on: redirects stay flat. Versions must rise; ``groups`` names ids of ``profiles``.
    """
    several = groups.groupBy("canonical").agg(F.count("*").alias("n")).where("n > 1").select("canonical")
    moved = groups.join(several, "canonical", "left_semi")
    member = profiles.join(moved, "id")
    taken = member.select(F.lit(version).alias("version"), "id", "canonical", F.struct(*profiles.columns).alias("profile"))
    now = redirects(log)
    pointed = now.withColumnRenamed("canonical", "via").join(moved.withColumnRenamed("id", "via"), "via").where("id <> via AND via <> canonical")
    pointed = pointed.select(F.lit(version).alias("version"), "id", "canonical", F.lit(None).cast(dict(log.dtypes)["profile"]).alias("profile"))
    merged = merge_metadata(member, "canonical")
    return written(profiles.join(moved, "id", "left_anti").unionByName(merged)), written(log.unionByName(taken).unionByName(pointed))


def redirects(log: DataFrame) -> DataFrame:
    """(id, canonical) as of the newest version: where each id that a merge took, or a split freed, now stands."""
    newest = log.groupBy("id").agg(F.max_by("canonical", "version").alias("canonical"))
    return newest.where("canonical IS NOT NULL")


def split(profiles: DataFrame, log: DataFrame, ids: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """(profiles, log) after the merges of ``ids`` (id) were found wrong: each is its own identity again with the profile that it brought.

    The others of its group are merged again from the profiles that they brought when they were first taken since they were last free. Splitting the canonical id frees all others of
    its group too. If every other member is split, or the canonical one is, the profiles are those before the merge, value for value. The log gets a row without canonical for each freed id
    and is otherwise kept. Ids that no merge took are ignored. A group's profile is what its members brought: later observations are profiles of their own until a later merge takes them.
    """
    now = written(redirects(log))
    wrong = ids.select("id").distinct().join(now, "id")
    touched = wrong.select("canonical").distinct()
    heads = wrong.where("id = canonical").select("canonical")
    member = now.join(touched, "canonical", "left_semi")
    freed = member.join(wrong.select("id"), "id", "left_semi").unionByName(member.join(heads, "canonical", "left_semi")).distinct()
    kept = member.join(freed, ["id", "canonical"], "left_anti")
    alone = kept.groupBy("canonical").agg(F.count("*").alias("n")).where("n = 1").select("canonical")
    freed = written(freed.unionByName(kept.join(alone, "canonical", "left_semi")))
    kept = written(kept.join(alone, "canonical", "left_anti"))
    free = log.where("canonical IS NULL").groupBy("id").agg(F.max("version").alias("freed_at"))
    brought = log.where("profile IS NOT NULL").join(free, "id", "left").where("freed_at IS NULL OR version > freed_at").groupBy("id").agg(F.min_by("profile", "version").alias("profile"))
    own = freed.join(brought, "id").select("profile.*")
    again = kept.join(brought, "id").select("canonical", "profile.*")
    rest = profiles.join(touched.withColumnRenamed("canonical", "id"), "id", "left_anti")
    gone = freed.select(F.lit(version).alias("version"), "id", F.lit(None).cast(dict(log.dtypes)["canonical"]).alias("canonical"), F.lit(None).cast(dict(log.dtypes)["profile"]).alias("profile"))
    return written(rest.unionByName(own).unionByName(merge_metadata(again, "canonical"))), written(log.unionByName(gone))


def empty_log(profiles: DataFrame) -> DataFrame:
    """A log before the first merge of ``profiles``."""
    spark = profiles.sparkSession
    kind = dict(profiles.dtypes)["id"]
    return spark.createDataFrame([], f"version int, id {kind}, canonical {kind}").withColumn("profile", F.lit(None).cast(profiles.select(F.struct("*").alias("p")).schema["p"].dataType))

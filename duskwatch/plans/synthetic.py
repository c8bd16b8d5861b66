"""Seeded attack episodes as event streams, injected into clones of the devices' own events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes with the number of their events, and SQL of each event's type, destination, value and second within the week; ``i`` counts events, ``r`` and ``q`` are random whole numbers.
CLASSES = [
    ("port_scan", 24, "'error'", "CASE WHEN i % 2 = 0 THEN 41 + (i * 2 + r) % 59 ELSE (r + i * 3) % 99 END", "5.0", "r % 80000 + i * 60"),
    ("dga_dns_tunnel", 30, "CASE WHEN i % 3 = 0 THEN 'view' ELSE 'error' END", "70 + (r + i * 7) % 30", "2.0", "r % 80000 + i * 45"),
    ("c2_beaconing", 36, "'view'", "63 + q % 3", "3.0 + r % 5", "i * 14400 + r % 60"),
    ("exfiltration", 12, "'purchase'", "45 + q % 2 * 6", "150.0 + r % 200", "r % 400000 + i * 600"),
    ("credential_stuffing", 40, "'error'", "40 + (i % 8) * 7", "1.0", "r % 90000 + i * 5"),
    ("lateral_movement", 8, "'purchase'", "20 + (q + i * 3) % 20", "4.0", "r % 90000 + i * 900"),
    ("decoy_touch", 1, "'view'", "13", "1.0", "r % 600000"),
    ("benign_drift", 3, "'view'", "CASE q % 3 WHEN 0 THEN 42 WHEN 1 THEN 48 ELSE 49 END", "6.0", "(r + i * 170000) % 600000"),
]
#: Clones' ids begin here; an episode's clone keeps its device's kind and is no safe device.
FIRST_CLONE, APART = 1_000_000_000, 90
#: Modulus and multiplier of a Lehmer generator.
MODULUS, MULTIPLIER = 2_147_483_647, 48_271


def random_of(seed: int, *parts: str) -> Column:
    """A whole number below MODULUS that depends on the seed and the columns alone, alike on every engine with 64-bit integers."""
    mixed = " + ".join([f"{seed} * 15485863L", *(f"CAST({c} AS BIGINT) * {p}" for c, p in zip(parts, (7919, 104_729, 1_299_709)))])
    return F.expr(f"({mixed}) % {MODULUS} * {MULTIPLIER} % {MODULUS} * {MULTIPLIER} % {MODULUS}")


def episodes(events: DataFrame, seed: int = 1, last_week: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events of all clones, episodes) for every device of ``events`` and every class: a clone repeats the device's events and, in the device's last week, has the class's events besides.

    Episodes are rows (user_id of the clone, week, device, attack). The same seed gives the same rows, wherever and however often they are made.
    With ``last_week`` a clone repeats only the events of that week: the rest is its device's own, which :func:`counted` marks."""
    week = F.floor(F.col("day") / 7).cast("long")
    device = events.groupBy(F.col("user_id").alias("device")).agg(F.max(week).alias("week"))
    shapes = F.array(*[F.struct(F.lit(n).alias("c"), F.lit(name).alias("attack"), F.lit(count).alias("count")) for n, (name, count, *_) in enumerate(CLASSES)])
    cases = device.select("device", "week", F.inline(shapes))
    clone = (F.lit(FIRST_CLONE) + (F.col("device") * len(CLASSES) + F.col("c")) * APART + F.col("device") % 5).alias("user_id")
    cases = cases.select("*", clone)
    rows = cases.select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("i")).withColumn("q", random_of(seed, "device", "c")).withColumn("r", random_of(seed + 1, "device", "c", "i"))

    def by_class(at: int, kind: str) -> Column:
        return F.expr("CASE c " + " ".join(f"WHEN {n} THEN CAST({shape[at]} AS {kind})" for n, shape in enumerate(CLASSES)) + " END")

    t = (F.col("week") * 604_800).cast("double") + by_class(5, "DOUBLE") % 604_800
    new = rows.select((F.lit(-1) - F.col("i")).cast("long").alias("event_id"), "user_id", by_class(2, "STRING").alias("event_type"), by_class(4, "DOUBLE").alias("value"), t.alias("t"), by_class(3, "INT").alias("k"))
    new = new.withColumn("day", F.floor(F.col("t") / 86_400).cast("long")).withColumn("hour", F.floor(F.col("t") / 3600).cast("long") % 24)
    same = ["device", "week"] if last_week else ["device"]
    own = events.withColumnRenamed("user_id", "device").withColumn("week", week).join(cases.select(*same, "user_id"), same).select(*new.columns)
    return own.unionByName(new), cases.select("user_id", "week", "device", "attack")


def counted(events: DataFrame) -> DataFrame:
    """The devices' own events and those of their clones' last weeks together, with ``device`` (whose earlier weeks are theirs) and ``copies``.

    An event before its device's last week stands for itself and for every clone, so a clone's earlier weeks are counted without being made."""
    clones, cases = episodes(events, last_week=True)
    week = F.floor(F.col("day") / 7).cast("long")
    last = cases.select("device", F.col("week").alias("last")).distinct()
    own = events.select(*clones.columns, F.col("user_id").alias("device")).join(last, "device", "left")
    own = own.select(*clones.columns, "device", F.when(week < F.col("last"), 1 + len(CLASSES)).otherwise(1).cast("long").alias("copies"))
    device = F.floor((F.col("user_id") - FIRST_CLONE) / APART / len(CLASSES)).cast("long")
    return own.unionByName(clones.select("*", device.alias("device"), F.lit(1).cast("long").alias("copies")))

"""Queries against their SQL on small tables made to be odd: repeated keys, large ids, values on a limit."""

import contextlib
import datetime
import hashlib
import io
import random
import shutil

import pytest
from pyspark.sql import functions as F

from duskwatch import cycle_queries, entity_queries, lifecycle_queries, model_queries  # noqa: F401  (registers their queries)
from duskwatch import queries as library

from .compare import differences, duck

SF = "/root/testdata/sf0.001"
CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@pytest.fixture
def against_sql(spark, tmp_path):
    """What a query over sf0.001 with one table replaced differs in from its SQL."""

    def run(name, table, rows):
        for f in ("customer", "events", "nation", "pages"):
            if f != table:
                shutil.copy(f"{SF}/{f}.parquet", tmp_path)
        rows.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        return differences(library.QUERIES[name](spark, str(tmp_path)), duck(str(tmp_path)), library.SQL[name])

    return run


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", ["match_confidence", "entity_links"])
def test_pairs_leave_the_join_without_a_shuffle(spark, name):
    text = plan(library.QUERIES[name](spark, SF))
    assert "Aggregate" not in text and text.count("Join") == 2, text


@pytest.mark.parametrize("name", ["match_confidence", "entity_links"])
def test_pairs_of_repeated_devices(spark, against_sql, name):
    """Rows that repeat a device's id, alike or with another fingerprint, count in each of their pairs."""
    rows = [(k, f"c{k}", k % 25, k * 0.5, ("A", "B", None)[k % 3]) for k in range(0, 1301 * 3, 13)] + [(26, "c", 1, 3.0, "A"), (26, "c", 1, 3.0, "B"), (39, "c39", 14, 19.5, "A")]
    assert against_sql(name, "customer", spark.createDataFrame(rows, CUSTOMER)) == ""


def test_owner_by_large_ids(spark, against_sql):
    """Ids that differ by more than a hundredth's weight decide against the time last seen."""
    rows = [(211 * k + r, "c", 1, 10.0 + (k * 7 % 5) / 100, "A") for k in range(0, 900, 60) for r in (0, 3)] + [(5, "c", 1, None, "A"), (216, "c", 1, 1.0, "A"), (7, "c", 1, None, "A")]
    assert against_sql("addr_owner", "customer", spark.createDataFrame(rows, CUSTOMER)) == ""


def test_digests_that_look_like_interface_ids(spark, against_sql):
    """A digest that happens to hold ff:fe in its middle is no interface id."""
    chance = [k for k in range(400_000) if k % 3 and hashlib.md5(str(k).encode()).hexdigest()[6:10] == "fffe"]
    assert chance
    rows = [(k, "c", 1, 1.0, "A") for k in [*chance, 0, 3, 4, 300_000]]
    assert against_sql("eui64", "customer", spark.createDataFrame(rows, CUSTOMER)) == ""


def test_sessions_end_at_exactly_half_a_day(spark, against_sql):
    rows, begin = [], datetime.datetime(2024, 1, 1)
    for user, gap in enumerate((43_199.0, 43_199.999999, 43_200.0, 43_200.5, 43_201.0)):
        for part in (0.0, 0.25):
            rows += [(len(rows) + k, begin + datetime.timedelta(seconds=part + k * gap), 2 * user + (part > 0), "view", 1.0, '{"k": 1}') for k in range(4)]
    types = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    assert against_sql("session_gap", "events", spark.createDataFrame(rows, types)) == ""


def test_reidentified_by_large_ids_ties_and_shared_addresses(spark, against_sql):
    """Few names with many devices, few times and addresses; ids beyond a fingerprint's weight of a million; a device that stands several times."""
    draw = random.Random(7)
    keys = [907 * draw.randrange(1, 4000) + r for r in (1, 2, 3) for _ in range(150)] + [907 * 211 * k + 4 for k in range(40)]
    rows = [(k, "c", 1, draw.choice([1.0, 2.0, 2.5, 3.25, 9.0, None]), draw.choice(["A", "B", None])) for k in keys + keys[::9]]
    assert against_sql("reidentify", "customer", spark.createDataFrame(rows, CUSTOMER)) == ""


def test_reidentify_pairs_no_devices(spark):
    assert "Join" not in plan(library.QUERIES["reidentify"](spark, SF))


def test_trust_reads_events_as_often_as_decisions(spark):
    """Alerts and their trust come from one pass over the decisions, and decisions from four over the events (destinations, gaps, sizes, shared destinations) and one over the names."""
    scans = lambda name: plan(library.QUERIES[name](spark, SF)).split("== Initial Plan ==")[0].count("FileScan parquet")
    assert scans("trust_cache") == scans("cycle_features") <= 5


def test_counted_clones_have_the_features_of_whole_ones(spark):
    """Clones made of their last week alone, with earlier weeks counted by their devices, against clones made of all their events."""
    from duskwatch.plans import cycles, synthetic
    from duskwatch.sources.tables import events, hosts

    real, names = events(spark, SF), hosts(spark, SF)
    whole, cases = synthetic.episodes(real)
    counted = synthetic.counted(real)
    every = whole.unionByName(real.select(*whole.columns))
    assert counted.count() < 0.6 * every.count()
    keys = cases.select("user_id", "week").union(cases.select(F.col("device"), "week")).distinct()
    expected = cycles.features(every, names).join(keys, ["user_id", "week"])
    found = cycles.features(counted, names).join(keys, ["user_id", "week"])
    columns = sorted(expected.columns)
    a, b = (sorted((tuple(r) for r in df.select("user_id", "week", *columns).collect()), key=lambda r: r[:2]) for df in (expected, found))
    assert len(a) == keys.count() and a == b

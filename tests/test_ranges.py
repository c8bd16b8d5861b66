"""Range files: what is read, when they count as sorted, and overlaps against a plain sweep."""

import gzip
import random

from pyspark.sql import functions as F

from duskwatch.sources import ranges

LINES = ["# list", "1.0.0.0\t1.0.0.255\tAS10\tDE\tone", "16777472\t16777727\t11\tFR\ttwo", "x\ty\t1\tDE\tbad", "9\t3\t1\tDE\tback", "5\t6", "5\t6\tnone\tDE\tbad", "0\t4294967296\t1\tDE\ttoo far", "4294967295\t4294967295\t12\t\tlast"]


def written(tmp_path, lines, name="r.tsv.gz"):
    with gzip.open(tmp_path / name, "wt") as f:
        f.write("\n".join(lines))
    return f"file://{tmp_path}/{name}"


def test_a_sorted_file_is_taken_as_it_is(spark, tmp_path):
    rows = ranges.read_ranges(spark, written(tmp_path, LINES))
    assert [tuple(r) for r in rows.collect()] == [(16777216, 16777471, 10, "DE", "one"), (16777472, 16777727, 11, "FR", "two"), (4294967295, 4294967295, 12, None, "last")]
    assert ranges.in_order(rows) and ranges.in_order(rows.limit(0))
    assert not ranges.in_order(ranges.read_ranges(spark, written(tmp_path, ["5\t9\t1\tx\ta", "1\t2\t1\tx\tb"], "b.gz"))) and not ranges.in_order(ranges.read_ranges(spark, written(tmp_path, ["1\t9\t1\tx\ta", "9\t12\t1\tx\tb"], "c.gz")))


def test_overlaps_equal_a_plain_sweep(spark):
    rng = random.Random(3)
    rows = [(lo, lo + rng.choice([0, 3, 10, 200]), rng.randrange(4), "c", None) for lo in (rng.randrange(400) for _ in range(60))] + [(0, 650, 9, "c", "wide"), (0, 650, 8, "c", "wide"), (5, 9, 1, "c", None), (5, 9, 1, "c", None)]
    got = ranges.disjoint(spark.createDataFrame(rows, "lo long, hi long, asn long, country string, org string"), cell=64).collect()
    said = {}
    for r in got:
        for x in range(r["lo"], r["hi"] + 1):
            assert x not in said
            said[x] = (r["asn"], r["org"])
    want = {}
    for x in range(0, 651):
        want[x] = min((hi - lo, lo, asn, o or "") for lo, hi, asn, _, o in rows if lo <= x <= hi)[2:]
    assert {x: (a, o or "") for x, (a, o) in said.items()} == want
    ordered = sorted((r["lo"], r["hi"], r["asn"], r["org"]) for r in got)
    assert all(not (a[1] + 1 == b[0] and a[2:] == b[2:]) for a, b in zip(ordered, ordered[1:]))


def test_a_saved_table_is_bucketed_by_cell(spark, tmp_path):
    rows = ranges.load_ranges(spark, written(tmp_path, ["0\t200000\t7\tx\tA", "10\t20\t8\tx\tB"]), "range_cells")
    assert rows.where((F.col("cell") == 0) & F.lit(15).between(F.col("lo"), F.col("hi"))).first()["asn"] == 8
    assert rows.select("lo", "hi", "asn").distinct().count() == 3 and rows.where("asn = 7 AND lo = 21").count() == 4
    spark.sql("DROP TABLE range_cells")

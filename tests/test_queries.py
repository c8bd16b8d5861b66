import pytest

from duskwatch import cycle_queries, entity_queries, identity_queries, lifecycle_queries, model_queries  # noqa: F401  (registers their queries)
from duskwatch import queries as library

from .compare import differences, duck

SF = "/root/testdata/sf0.001"
#: Queries without SQL that may have several rows of a device, time and destination.
MANY = {"beacon_fold"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_equals_sql(spark, con, name):
    assert differences(library.QUERIES[name](spark, SF), con, library.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.SQL)))
def test_runs(spark, name):
    rows = library.QUERIES[name](spark, SF).collect()
    keys = [c for c in ("user_id", "week", "day", "event_id", "k") if rows and c in rows[0].asDict()]
    assert rows and all(any(v is not None for v in r) for r in rows) and (name in MANY or len({tuple(r[c] for c in keys) for r in rows}) == len(rows))

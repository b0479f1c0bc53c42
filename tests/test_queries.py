import pytest

from tests.compare import same
from wayfold.registry import ORACLES, QUERIES

SLOW = {"tl09", "tl20"}  # tests/test_merging.py runs what they call


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_place_on_the_border_of_a_visit_is_where_sql_has_it(spark, tmp_path):
    import duckdb

    # a device whose sample 804141 lies, by the last digit of the radius, outside of the visit that its place makes
    ids = [
        800431, 801919, 804141, 809231, 809738, 810170, 810302, 811481, 811585, 812875, 813887, 818695, 827792, 830209, 830891, 833665, 834272, 834882, 835530, 836008,
        836155, 837804, 838904, 847422, 850912, 852593, 853100, 854020, 855483, 856036, 858167, 859059, 863330, 863658, 865114, 866386, 866966, 867939, 868236, 870155,
    ]
    rows = [(e, 12354, 1.0 * k, k) for k, e in enumerate(ids)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double, k long").selectExpr("event_id", "user_id", "value", "timestamp_seconds(1704067200 + 60 * k) AS ts")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("jn15", "jn16"):
        want = sorted(con.execute(ORACLES[name]).fetchall())
        assert sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()) == want
        assert (804141 in {w[0] for w in want}) == (name == "jn16")

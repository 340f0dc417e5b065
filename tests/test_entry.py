"""The registry: what is installed is registered, and a broken installation is not taken for an absent one."""

import __spark_entry__ as entry_point
from parterre.operators.skew import heavy_keys
from parterre.session import HEAVY_KEY_ROWS, single_task_bytes


def test_absent_modules():
    assert entry_point.installed("parterre.plans.queries")
    assert not entry_point.installed("parterre.nothing.queries") and not entry_point.installed("parterre.nothing")


def test_every_sql_has_its_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_the_size_check_follows_the_rows_of_a_heavy_key(spark):
    assert single_task_bytes(spark) == 4 * HEAVY_KEY_ROWS[1]
    spark.conf.set(HEAVY_KEY_ROWS[0], "3")
    try:
        assert single_task_bytes(spark) == 12
        frame = spark.createDataFrame([(k // 8,) for k in range(16)], "k int")
        assert heavy_keys(frame, ["k"]).count() == 2
    finally:
        spark.conf.unset(HEAVY_KEY_ROWS[0])

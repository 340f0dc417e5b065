"""Nothing changes its result, or falls back, with the size of the input."""

import random

import pytest

from parterre.operators import allocate as A
from parterre.operators import reports as G
from parterre.schemas import COMMAND, SECTION_STATUS
from parterre.session import FOLD_TASK_BYTES, HEAVY_KEY_ROWS, MOST_FOLD_TASKS, SINGLE_TASK_BYTES, int_setting
from parterre.sources.files import avro_schema, read_table
from tests.conftest import make_commands, make_inits


def test_partitions_grow_up_to_the_limit(spark):
    rows = A.command_rows(make_commands(spark, [("r1", 1, "A", 1)]))
    sizes = [10**k for k in range(6, 16)] + [30 * 10**12, 100 * 10**12]
    asked = [A.fold_partitions(rows, size) or 0 for size in sorted(sizes)]
    assert asked == sorted(asked) and asked[-1] == MOST_FOLD_TASKS[1]
    assert A.fold_partitions(rows, 100 * FOLD_TASK_BYTES[1]) == 100


def test_the_heavy_key_gate_is_a_number_of_rows(spark):
    assert int_setting(spark, SINGLE_TASK_BYTES) <= 4 * int_setting(spark, HEAVY_KEY_ROWS)


def test_a_stored_status_table_does_not_swell_the_fold(spark, tmp_path):
    from parterre.operators import route as RT

    commands = make_commands(spark, [(f"r{i}", 1, "A", 1) for i in range(2000)])
    commands.write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([(1, s, 5) for s in "ABCDEFGH" * 500], "event_id bigint, section string, available_count int").write.parquet(str(tmp_path / "s"))
    kept, _ = RT.prefilter(spark.read.parquet(str(tmp_path / "c")), spark.read.parquet(str(tmp_path / "s")))
    before = A.estimated_bytes(spark.read.parquet(str(tmp_path / "c")))
    assert A.fold_partitions(A.command_rows(kept), before) is None


@pytest.mark.parametrize("flags", [{}, {"with_status": True, "with_states": True}])
def test_replay_gives_the_same_rows_in_both_forms(spark, flags):
    rng = random.Random(5)
    inits = make_inits(spark, [(1, "HOT", 2, 6, []), (1, "HOT", 1, 9, [], 40), (1, "B", 1, 3, [])])
    commands = make_commands(spark, [(f"r{i:03}", 1, rng.choice(["HOT"] * 8 + ["B", "X"]), rng.randrange(0, 5)) for i in range(40)])

    def rows():
        df = A.replay(commands, inits, **flags)
        return sorted(map(str, df.select(*sorted(df.columns)).collect()))

    plain = rows()
    spark.conf.set(HEAVY_KEY_ROWS[0], "10")
    spark.conf.set(SINGLE_TASK_BYTES[0], "0")
    try:
        assert rows() == plain
    finally:
        spark.conf.unset(HEAVY_KEY_ROWS[0])
        spark.conf.unset(SINGLE_TASK_BYTES[0])


def test_percentiles_of_few_far_apart_values(spark):
    values = [0, 1, 5, 10**12, 10**15, 10**15 + 1, 7]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    found = {r.point: r.milliseconds for r in G.exact_percentiles(df, ["v"], [0.0, 0.5, 0.9, 1.0]).collect()}
    assert (found[0.0], found[0.5], found[1.0]) == (0, 7, 10**15 + 1)
    assert found[0.9] == pytest.approx(10**15 + 0.4)


def test_percentiles_leave_errors_out(spark):
    log = spark.createDataFrame([(1, 1, 2, True), (1000, 1000, 2000, False)], "post_ms bigint, get_ms bigint, latency_ms bigint, ok boolean")
    assert {r.milliseconds for r in G.latency_percentiles(log).collect()} == {2}


def test_layouts_have_schemas_and_jdbc_asks_for_bounds(spark):
    for record in (COMMAND, SECTION_STATUS):
        assert '"local-timestamp-micros"' in avro_schema(record, "r")
    with pytest.raises(ValueError, match="bounds"):
        read_table(spark, "t", COMMAND, jdbc_url="jdbc:none")

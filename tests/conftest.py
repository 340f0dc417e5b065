import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parterre import schemas  # noqa: E402
from parterre.session import HEAVY_KEY_ROWS, SINGLE_TASK_BYTES, local_session  # noqa: E402

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "parterre-tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture
def tiny_tasks(spark):
    """Settings under which a key of six rows is already too large for one task."""
    spark.conf.set(HEAVY_KEY_ROWS[0], "5")
    spark.conf.set(SINGLE_TASK_BYTES[0], "0")
    yield
    spark.conf.unset(HEAVY_KEY_ROWS[0])
    spark.conf.unset(SINGLE_TASK_BYTES[0])


def make_inits(spark, rows):
    """``rows`` are (event, section, rows, seats_per_row, reserved[, second])."""
    data = [(e, s, r, c, res, START + dt.timedelta(seconds=rest[0] if rest else -1))
            for e, s, r, c, res, *rest in rows]
    return spark.createDataFrame(data, schemas.SECTION_INIT)


def make_commands(spark, rows):
    """``rows`` are (id, event, section, n[, second]), by default one second apart."""
    data = [(i, e, s, n, "u", START + dt.timedelta(seconds=rest[0] if rest else at))
            for at, (i, e, s, n, *rest) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.COMMAND)

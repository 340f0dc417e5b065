"""Session settings and durable intermediate tables."""

from __future__ import annotations

import contextlib
import contextvars
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# A key with more rows than this is spread over several tasks.
HEAVY_KEY_ROWS = ("parterre.heavyKeyRows", 4_000_000)
# Inputs that Catalyst estimates below this can have no heavy key: estimates are of compressed files, and a row takes
# four bytes of them at least. Unless it is set, it follows the rows of a heavy key.
SINGLE_TASK_BYTES = ("parterre.singleTaskBytes", 4 * HEAVY_KEY_ROWS[1])
# Estimated bytes that one fold task is meant to take, and the most tasks planned for a fold; beyond, tasks grow.
FOLD_TASK_BYTES = ("parterre.foldTaskBytes", 32 * 1024 * 1024)
MOST_FOLD_TASKS = ("parterre.mostFoldTasks", 200_000)


def int_setting(spark: SparkSession, setting: tuple[str, int]) -> int:
    name, default = setting
    return int(spark.conf.get(name, str(default)))


def single_task_bytes(spark: SparkSession) -> int:
    name, _ = SINGLE_TASK_BYTES
    return int(spark.conf.get(name, str(4 * int_setting(spark, HEAVY_KEY_ROWS))))


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates: ``spark.checkpoint.dir``.

    A local session without that setting gets a folder on its default file
    system. On a cluster the setting is required, since nothing else is known
    to be visible to all executors.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local($|\[)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"/tmp/parterre-{context.applicationId}")
    return hadoop.FileSystem.get(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/parterre/{name}-{uuid.uuid4().hex}"


_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


def materialize(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once and continue from the written table, in ``spark`` if given.

    Cuts the lineage so that a lost executor costs a re-read, and gives every
    later use of the rows the same partition-dependent columns. The table stays
    in the shared folder, unless made inside :func:`scratch`.
    """
    spark = spark or df.sparkSession
    path = fresh_path(spark, name)
    if (written := _written.get()) is not None:
        written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the tables :func:`materialize` writes in between."""
    token = _written.set([])
    try:
        yield
    finally:
        paths = _written.get() or []
        _written.reset(token)
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def local_session(cores: str = "8", app: str = "parterre", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores if cores != "*" else 8))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

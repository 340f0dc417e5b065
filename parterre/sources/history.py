"""History of completed reservations: appended by day, old days moved to an archive.

Days are folders, so a question about some days reads those alone, and moving a
day to the archive renames a folder instead of rewriting rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How long a completed reservation stays outside the archive.
KEEP_DAYS = 90
DAY, BATCH, PLACE = "day", "batch", "place"
LIVE, ARCHIVE = "live", "archive"


class History:
    """Rows of ``schema`` below ``folder``, by the day of ``time``."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, time: str = "completed_ts") -> None:
        self.spark, self.folder, self.schema, self.time = spark, folder, schema, time

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add ``rows`` as ``batch``. Adding a batch again replaces its rows in the days that it has, also in archived ones."""
        archived = [F.lit(d) for d in self._days(ARCHIVE)]
        day = F.to_date(self.time)
        place = F.when(day.isin(archived), F.lit(ARCHIVE)).otherwise(F.lit(LIVE)) if archived else F.lit(LIVE)
        rows.select(*self.schema.fieldNames()).withColumns({PLACE: place, DAY: day, BATCH: F.lit(batch)}).repartition(DAY).write.mode(
            "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PLACE, DAY, BATCH).parquet(self.folder)

    def archive(self, today: dt.date, keep_days: int = KEEP_DAYS) -> list[dt.date]:
        """Move the days more than ``keep_days`` before ``today`` to the archive; which they were.

        Each day moves by itself, so a run that was cut short is finished by the next.
        """
        moved = []
        for day in self._days(LIVE):
            if day < today - dt.timedelta(days=keep_days):
                source, files = self._at(LIVE, day)
                target, _ = self._at(ARCHIVE, day)
                files.mkdirs(target.getParent())
                if not files.rename(source, target):
                    raise OSError(f"{day} could not be archived")
                moved.append(day)
        return moved

    def read(self, first: dt.date | None = None, last: dt.date | None = None, archived: bool = True) -> DataFrame:
        """Rows of the days from ``first`` to ``last``, with ``archived``; other days and, if not wanted, the archive are not read."""
        schema = T.StructType([*self.schema, T.StructField(PLACE, T.StringType()), T.StructField(DAY, T.DateType()), T.StructField(BATCH, T.StringType())])
        found = self.spark.read.schema(schema).parquet(self.folder)
        if first is not None:
            found = found.where(F.col(DAY) >= F.lit(first))
        if last is not None:
            found = found.where(F.col(DAY) <= F.lit(last))
        if not archived:
            found = found.where(F.col(PLACE) == LIVE)
        return found.select(*self.schema.fieldNames(), (F.col(PLACE) == ARCHIVE).alias("archived"))

    def _at(self, place: str, day: dt.date | str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{PLACE}={place}/{DAY}={day}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _days(self, place: str) -> list[dt.date]:
        pattern, files = self._at(place, "*")
        names = [status.getPath().getName() for status in files.globStatus(pattern) or []]
        return sorted(dt.date.fromisoformat(name.removeprefix(f"{DAY}=")) for name in names if "__" not in name)

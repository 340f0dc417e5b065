"""Small committed records by batch number, beside the data they speak for."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class Commits:
    """One JSON record a batch below ``path``; a record appears whole or not at all.

    It is written under another name and moved into place, so that a reader never meets half of it. What a batch has
    written counts from then on; without it, the batch is as if it had not run.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _at(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, batch: int, record: dict) -> None:
        target, files = self._at(f"{batch}.json")
        draft, _ = self._at(f".{batch}.json.draft")
        stream = files.create(draft, True)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        if not files.rename(draft, target) and not files.exists(target):
            raise OSError(f"batch {batch} could not be committed in {self.path}")

    def has(self, batch: int) -> bool:
        return exists(self.spark, f"{self.path}/{batch}.json")

    def get(self, batch: int) -> dict:
        path, files = self._at(f"{batch}.json")
        size = files.getFileStatus(path).getLen()
        stream = files.open(path)
        try:
            return json.loads(bytes(stream.readNBytes(size)))
        finally:
            stream.close()

    def drop(self, batch: int) -> None:
        path, files = self._at(f"{batch}.json")
        files.delete(path, False)

    def batches(self) -> list[int]:
        """All committed batches in order, from the names alone."""
        pattern, files = self._at("*.json")
        names = [status.getPath().getName() for status in files.globStatus(pattern) or []]
        return sorted(int(name.removesuffix(".json")) for name in names if not name.startswith("."))

    def newest(self, before: int | None = None) -> int:
        """The highest committed batch (below ``before``); -1 if there is none."""
        return max((n for n in self.batches() if before is None or n < before), default=-1)

"""A table of the latest row per key that grows by merging batches into hash buckets.

Keys are spread over a fixed number of buckets. A batch reads and writes the
buckets that hold its keys and no others; a manifest says which batch wrote each
bucket last. Earlier versions stay readable until :meth:`BucketedTable.vacuum`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parterre.operators.tables import latest_by_key
from parterre.session import materialize, scratch
from parterre.streaming.commits import Commits

BUCKET = "bucket"


class BucketedTable:
    """Latest rows by ``keys`` below ``path``; the last in ``order`` stays.

    ``buckets`` bounds what a batch with one key rewrites (the table's size divided by it) and the manifest's length. It
    is fixed for the life of a table, and should grow with the size expected.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.keys, self.order, self.buckets = keys, order, buckets
        self.commits = Commits(spark, f"{path}/manifest")

    def bucket(self, *values: Column) -> Column:
        """The bucket of the key columns, or of given values of their types."""
        typed = [v.cast(self.schema[k].dataType) for k, v in zip(self.keys, values)] or [F.col(k) for k in self.keys]
        return F.pmod(F.xxhash64(*typed), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, batch: int, stored: bool = False) -> None:
        """Merge ``rows`` as batch number ``batch``; a committed batch is left as it is.

        The rows are gone through twice, so they are written first unless they are ``stored`` already.
        """
        if self.commits.has(batch):
            return
        with scratch(self.spark):
            arrived = rows.select(*self.schema.fieldNames()).withColumn(BUCKET, self.bucket())
            if not stored:
                arrived = materialize(latest_by_key(arrived, [BUCKET, *self.keys], self.order), "upsert", self.spark)
            touched = [r[0] for r in arrived.select(BUCKET).distinct().collect()]  # at most ``buckets``
            before = self._manifest(self.commits.newest(before=batch))
            earlier = self._read({b: before[b] for b in touched if b in before})
            merged = latest_by_key(earlier.unionByName(arrived), [BUCKET, *self.keys], self.order)
            merged.repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").parquet(f"{self.path}/data/batch={batch}")
        self.commits.put(batch, {str(b): n for b, n in (before | dict.fromkeys(touched, batch)).items()})

    def _manifest(self, batch: int) -> dict[int, int]:
        return {} if batch < 0 else {int(b): n for b, n in self.commits.get(batch).items()}

    def _read(self, manifest: dict[int, int]) -> DataFrame:
        schema = T.StructType([*self.schema, T.StructField(BUCKET, T.IntegerType())])
        if not manifest:
            return self.spark.createDataFrame([], schema)
        by_batch: dict[int, list[str]] = {}
        for bucket, batch in manifest.items():
            by_batch.setdefault(batch, []).append(f"{self.path}/data/batch={batch}/{BUCKET}={bucket}")
        parts = [self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths) for paths in by_batch.values()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.select(*self.schema.fieldNames(), BUCKET)

    def read(self) -> DataFrame:
        return self.as_of(self.commits.newest())

    def as_of(self, batch: int) -> DataFrame:
        """The table after ``batch``; empty before the first."""
        return self._read(self._manifest(self.commits.newest(before=batch + 1))).drop(BUCKET)

    def find(self, *key: object) -> DataFrame:
        """The row of one key: only its bucket is read."""
        values = [F.lit(v) for v in key]
        number = self.spark.range(1).select(self.bucket(*values)).first()[0]
        manifest = self._manifest(self.commits.newest())
        rows = self._read({number: manifest[number]} if number in manifest else {})
        for name, value in zip(self.keys, values):
            rows = rows.where(F.col(name) == value)
        return rows.drop(BUCKET)

    def match(self, wanted: DataFrame, before: int | None = None) -> DataFrame:
        """Rows whose keys occur in ``wanted`` (as they were ``before`` a batch); only the buckets of its keys are read."""
        buckets = [r[0] for r in wanted.select(self.bucket()).distinct().collect()]
        manifest = self._manifest(self.commits.newest(before))
        rows = self._read({b: manifest[b] for b in buckets if b in manifest})
        return rows.join(wanted.select(*self.keys).distinct(), self.keys, "left_semi").drop(BUCKET)

    def vacuum(self, keep: int = 2) -> None:
        """Remove what only versions before the last ``keep`` refer to."""
        batches = self.commits.batches()
        held = {(n, b) for version in batches[-keep:] for b, n in self._manifest(version).items()}
        files = self.spark._jvm.org.apache.hadoop.fs
        for version in batches[:-keep]:
            for bucket, batch in self._manifest(version).items():
                if (batch, bucket) not in held:
                    path = files.Path(f"{self.path}/data/batch={batch}/{BUCKET}={bucket}")
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.commits.drop(version)

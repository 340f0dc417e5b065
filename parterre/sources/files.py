"""Reading and writing the reservation log, in batch and as streams.

File formats (parquet, JSON, CSV, ORC) are read with the fixed schemas, never
inferred. A message broker is a further source where its connector is on the
class path.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parterre.functions.seats import section_key
from parterre.functions.time import from_millis
from parterre.schemas import COMMAND


def read_log(
    spark: SparkSession, path: str, schema: T.StructType, *, fmt: str = "parquet", stream: bool = False, **options: str
) -> DataFrame:
    """A log folder in ``fmt``. Streams list it from the start and keep their
    place in the checkpoint; ``maxFilesPerTrigger`` / ``maxBytesPerTrigger`` bound a micro-batch."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).format(fmt).options(**options).load(path)


def read_table(spark: SparkSession, name: str, schema: T.StructType, *, folder: str | None = None,
               jdbc_url: str | None = None, bounds: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A relational table, from a parquet folder or over JDBC; filters reach either.

    JDBC needs ``bounds`` (a numeric column, its least and greatest value, and how
    many parts to read it in), as a read without them is a single task.
    """
    if jdbc_url:
        if bounds is None:
            raise ValueError("JDBC needs bounds, else one task reads the whole table")
        column, low, high, parts = bounds
        split = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
        return spark.read.format("jdbc").options(url=jdbc_url, dbtable=name, **split, **options).load().to(schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")


def read_broker(spark: SparkSession, servers: str, topic: str, schema: T.StructType, *, stream: bool = True) -> DataFrame:
    """JSON records of a topic, from the earliest offset. Needs the Kafka connector."""
    reader = spark.readStream if stream else spark.read
    raw = reader.format("kafka").options(
        **{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"}).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


# A registry's wire format puts one magic byte and a four-byte id before each record.
REGISTRY_HEADER_BYTES = 5
_AVRO_TYPES = {"string": "string", "bigint": "long", "int": "int", "boolean": "boolean", "double": "double",
               "timestamp_ntz": {"type": "long", "logicalType": "local-timestamp-micros"}}


def avro_schema(record: T.StructType, name: str) -> str:
    """The Avro schema of one of the wire layouts."""

    def avro_type(kind: T.DataType) -> object:
        if isinstance(kind, T.ArrayType):
            return {"type": "array", "items": avro_type(kind.elementType)}
        if isinstance(kind, T.MapType):
            return {"type": "map", "values": avro_type(kind.valueType)}
        return _AVRO_TYPES[kind.simpleString()]

    fields = [{"name": f.name, "type": avro_type(f.dataType)} for f in record]
    return json.dumps({"type": "record", "name": name, "fields": fields})


def decode_avro(value: Column, record: T.StructType, name: str) -> Column:
    """A record from a registry-framed Avro value. Needs the Avro module."""
    from pyspark.sql.avro.functions import from_avro

    body = F.substring(value, REGISTRY_HEADER_BYTES + 1, F.length(value))
    return from_avro(body, avro_schema(record, name))


def encode_avro(row: Column, record: T.StructType, name: str) -> Column:
    """The Avro value of a record, without a registry header. Needs the Avro module."""
    from pyspark.sql.avro.functions import to_avro

    return to_avro(row, avro_schema(record, name))


def commands_from_wire(records: DataFrame) -> DataFrame:
    """Commands whose time travels as epoch milliseconds."""
    return records.withColumn("ts", from_millis(F.col("timestamp"))).select(*COMMAND.fieldNames())


def commands_from_requests(requests: DataFrame, reservation_id: Column | None = None, ts: Column | None = None) -> DataFrame:
    """Commands for incoming requests (event_id, section, seat_count, user_id).

    Live ingest draws a random id and takes the current time; pass columns for
    both to get repeatable rows.
    """
    now = F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                                           "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return requests.select(
        (F.expr("uuid()") if reservation_id is None else reservation_id).alias("reservation_id"),
        "event_id", "section", "seat_count", "user_id", (now if ts is None else ts).alias("ts"))


def keyed(df: DataFrame, key: Column | None = None) -> DataFrame:
    """Text key and JSON value of each record, as a keyed sink takes them.

    The default key is that of a section; pass ``F.col("reservation_id")`` for
    commands and results.
    """
    return df.select((section_key() if key is None else key).alias("key"),
                     F.to_json(F.struct(*df.columns)).alias("value"))


def publish(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append records to a log folder."""
    df.write.mode("append").format(fmt).save(path)


def publish_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Append what has arrived on a stream to a log folder, each record exactly once."""
    stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode(
        "append").trigger(availableNow=True).start().awaitTermination()

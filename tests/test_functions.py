import datetime as dt
import json

from pyspark.sql import functions as F

from parterre import schemas
from parterre.functions import seats as S
from parterre.functions import time as TM
from parterre.operators import compat as C
from parterre.sources import files
from tests.conftest import make_commands


def values(spark, texts, expression):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    return [r[0] for r in df.select(expression(F.col("s")).alias("v")).collect()]


def test_seat_numbers(spark):
    assert values(spark, ["A-1", "A-10", "VIP-A-3", "A", "A-", "A-x", "A-001"], S.seat_number) == [
        1, 10, 3, -1, -1, -1, 1]


def test_names_and_keys(spark):
    assert values(spark, ["A-7", "VIP-A-3", "A"], S.section_of_seat) == ["A", "VIP", "A"]
    assert values(spark, ["A-7", "S0-12", "VIP-A-3", "B"], S.grid_position) == [
        (0, 7), (18, 12), (21, None), (1, None)]
    row = make_commands(spark, [("r1", 7, "VIP-A", 1)]).select(S.section_key().alias("k")).first()
    assert row.k == "7-VIP-A"


def test_time(spark):
    df = spark.createDataFrame([(1704067207179,), (0,), (-1,)], "ms bigint")
    rows = df.select("ms", TM.from_millis(F.col("ms")).alias("at")).withColumn("back", TM.to_millis(F.col("at"))).collect()
    assert [r.back for r in rows] == [r.ms for r in rows]
    assert rows[0]["at"] == dt.datetime(2024, 1, 1, 0, 0, 7, 179000)
    assert values(spark, ["2024-02-29", "soon"], TM.iso_date) == [dt.date(2024, 2, 29), None]


def test_compat(spark):
    df = spark.createDataFrame(
        [("r1", "u", 1, "A", 2, "CONFIRMED", ["A-1", "A-2"]), ("r2", "u", None, "A", 2, "REJECTED", None)],
        "reservation_id string, user_id string, event_id bigint, section string, seat_count int, status string,"
        "allocated_seats array<string>")
    first, second = C.compat_results(df).orderBy("reservation_id").collect()
    assert (first.state, first.event_id, first.seats) == ("RESERVED", "1", [(0, 1), (0, 2)])
    assert (second.state, second.event_id, second.seats) == ("REJECTED", None, [])


def test_names_resolve_to_the_last_registration(spark):
    registered = spark.createDataFrame([("Gala", 1, 1), ("Gala", 2, 2), ("Opera", 3, 1)], "event_name string, event_id bigint, at int")
    asked = spark.createDataFrame([("r1", "Gala"), ("r2", "Ball")], "reservation_id string, event_name string")
    rows = C.resolve_event_names(asked, registered, ["at"]).collect()
    assert {r.reservation_id: r.event_id for r in rows} == {"r1": 2, "r2": None}


def test_wire_commands_and_requests(spark, tmp_path):
    wire = spark.createDataFrame([("r1", 1, "A", 2, "u", 1704067200500)],
                                 "reservation_id string, event_id bigint, section string, seat_count int, user_id string, timestamp bigint")
    for fmt in ["parquet", "json", "orc", "csv"]:
        files.publish(wire, str(tmp_path / fmt), fmt)
        back = files.commands_from_wire(files.read_log(spark, str(tmp_path / fmt), wire.schema, fmt=fmt)).first()
        assert back.ts == dt.datetime(2024, 1, 1, 0, 0, 0, 500000)
    live = files.commands_from_requests(wire).first()
    assert len(live.reservation_id) == 36
    assert abs(live.ts - dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)) < dt.timedelta(minutes=5)
    sent = files.keyed(make_commands(spark, [("r1", 1, "A", 2)])).first()
    assert sent.key == "1-A" and '"reservation_id":"r1"' in sent.value


def test_avro_schema_of_the_wire_layout():
    made = json.loads(files.avro_schema(schemas.COMMAND_WIRE, "ReservationCommand"))
    assert made["name"] == "ReservationCommand"
    assert {f["name"]: f["type"] for f in made["fields"]} == {
        "reservation_id": "string", "event_id": "long", "section": "string", "seat_count": "int", "user_id": "string",
        "timestamp": "long"}

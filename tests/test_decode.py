import base64
import datetime as dt

import pytest

from roadlake.operators import decode


def b64(text: str) -> str:
    return base64.b64encode(text.encode()).decode()


def messages(spark, bodies):
    rows = [(body, "gps", i, dt.datetime(2024, 1, 1)) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, "body string, routing_key string, ingest_seq long, ingest_ts timestamp")


GOOD = "dev123:1617181920.0:55.5:1000.2:True:0:0:0"

GPS_CASES = [
    (b64(GOOD), None),
    (b64('"dev999:1617181920.0:60.0:1234.5:False:0:0:0"'), None),
    ("not-a-valid-base64!", "decode"),
    (b64("a:b:c"), "field_count"),
    (b64(GOOD + ":9"), "field_count"),
    (b64(GOOD + ":9:9:9"), "field_count"),
    (b64("dev:bad_float:55.5:1000.2:True:0:0:0"), "number"),
    (b64("dev:1617181920.0:fast:1000.2:True:0:0:0"), "number"),
    (b64("dev:1617181920.0:55.5:broken:True:0:0:0"), "number"),
    (b64("7:1617181920.0:::True:0:0:0"), "number"),
    (b64("dev:1617181920.0:1.0f:1.0:True:0:0:0"), "number"),
    (b64("dev:1617181920.0:0x1p3:1.0:True:0:0:0"), "number"),
    (b64("dev:1617181920.0:1.0 d:1.0:True:0:0:0"), "number"),
    (b64("dev:1617181920.0:1_0.5: +1e3 :TRUE:.5:-1.:1"), None),
    (b64("dev:1617181920.0:1__0:1:True:0:0:0"), "number"),
    (b64("dev:1617181920.0:-1:1.0:True:0:0:0"), "range"),
    (b64("dev:1617181920.0:nan:1.0:True:0:0:0"), "range"),
    (b64("dev:1617181920.0:inf:1.0:True:-Infinity:nan:0"), None),
    (b64(":1617181920.0:1:1.0:True:0:0:0"), "range"),
    (b64("dev:nan:1:1.0:True:0:0:0"), "number"),
    (b64("dev:1e300:1:1.0:True:0:0:0"), "number"),
    (base64.b64encode(b"\xff\xfe:1:1").decode(), "decode"),
    ("!" + b64(GOOD)[:10] + "\n* " + b64(GOOD)[10:], None),
    (b64(GOOD)[:-1], "decode"),
    (None, "decode"),
]


def test_gps_cases(spark):
    rows = decode.decode_gps(messages(spark, [c[0] for c in GPS_CASES])).orderBy("ingest_seq").collect()
    assert [r.reject_reason for r in rows] == [c[1] for c in GPS_CASES]
    first, quoted = rows[0], rows[1]
    assert (first.device_id, first.speed, first.odometer, first.power_on) == ("dev123", 55.5, 1000.2, True)
    assert first.timestamp == dt.datetime(2021, 3, 31, 9, 12)
    assert (quoted.device_id, quoted.power_on, quoted.fuel_gauge) == ("dev999", False, 0.0)
    odd = rows[13]
    assert (odd.speed, odd.odometer, odd.power_on, odd.latitude, odd.longitude) == (10.5, 1000.0, True, 0.5, -1.0)


FAULT_CASES = [
    ("1:1617181920:10101010:3:2:5", None),
    ("1:1617181920:10101010", "field_count"),
    ("1:1617181920:10101010:3:2:5:6", "field_count"),
    ("1:1617181920:10101010:3:X:5", "number"),
    ("1:1617181920:10101010:3:2:Y", "number"),
    ("1:1617181920:10101010:3:2.0:5", "number"),
    ("1:1617181920:10101010:3:1_0: +5", None),
    ("1:1617181920::3:2:5", "range"),
    ("1:1617181920:1::2:5", "range"),
    ("1:1617181920:1:3:-2:5", "range"),
    ('"1:1617181920:1:3:2:5"', "number"),
]


def test_fault_cases(spark):
    bodies = [b64(c[0]) for c in FAULT_CASES]
    rows = decode.decode_faults(messages(spark, bodies)).orderBy("ingest_seq").collect()
    assert [r.reject_reason for r in rows] == [c[1] for c in FAULT_CASES]
    assert (rows[0].fault_bits, rows[0].fault_code, rows[0].sequence, rows[0].total_number) == ("10101010", "3", 2, 5)
    assert (rows[6].sequence, rows[6].total_number) == (10, 5)


def test_routes(spark):
    rows = [("x", "gps", 1, None), ("x", "fault", 2, None), ("x", "other", 3, None), ("x", None, 4, None)]
    frame = spark.createDataFrame(rows, "body string, routing_key string, ingest_seq long, ingest_ts timestamp")
    assert [r.ingest_seq for r in decode.route(frame, "gps").collect()] == [1]
    assert sorted(r.ingest_seq for r in decode.unrouted(frame).collect()) == [3, 4]


def test_failed_rules(spark):
    frame = decode.decode_gps(messages(spark, [b64(":1617181920.0:-1:nan:True:0:0:0")]))
    broken = frame.select(decode.failed_rules(decode.gps_rules()).alias("r")).first().r
    assert sorted(broken) == ["device_id", "odometer", "speed"]


@pytest.mark.parametrize(
    "value, text",
    [
        (70.0, "70.0"),
        (0.0001, "0.0001"),
        (0.00001, "1e-05"),
        (12345678.5, "12345678.5"),
        (1e7, "10000000.0"),
        (1e16, "1e+16"),
        (1.5e300, "1.5e+300"),
        (-0.0005, "-0.0005"),
    ],
)
def test_float_text(spark, value, text):
    from pyspark.sql import functions as F

    from roadlake.functions.numbers import float_text

    assert spark.range(1).select(float_text(F.lit(value))).first()[0] == text == repr(value)


def test_round_half_even(spark):
    import random

    from pyspark.sql import functions as F

    from roadlake.functions.numbers import round_half_even

    rng = random.Random(5)
    values = [0.295, 0.125, 0.285, 0.005, 0.015, 0.025, 1.0, 0.0, -0.295, -0.125, 0.145]
    values += [rng.randrange(0, 2000) / 2000 for _ in range(500)] + [rng.random() for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in frame.select(round_half_even(F.col("v"), 2)).collect()]
    assert got == [round(v, 2) for v in values]

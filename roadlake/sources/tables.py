"""Telemetry frames derived, row by row, from the given warehouse tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.functions.payload import base64_of
from roadlake.functions.times import MICROS, micros

# How the raw feed is spoiled, by ``ingest_seq % 17``.
BAD_BASE64, MISSING_FIELD, BLANK_SPEED, BAD_NUMBER, NEGATIVE_SPEED, QUOTED = range(6)
BAD_SEQUENCE, EMPTY_BITS = 2, 3


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The given tables hold naive UTC times.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _cents_text(cents: Column) -> Column:
    return _text(F.floor(cents / 100), ".", F.lpad((cents % 100).cast("string"), 2, "0"))


def _gps_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-number parts of each fix, from which both forms are written."""
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    still = F.col("event_type").isin("click", "error")
    return (
        load(spark, sf_dir, "events")
        .withColumn("timestamp", F.col("ts").cast("timestamp"))
        .withColumn("us", micros(F.col("timestamp")))
        .select(
            "event_id",
            "timestamp",
            "us",
            _text("truck_", F.col("user_id") % 50).alias("device_id"),
            F.when(still, F.lit(0)).otherwise(F.rint(F.col("value") * 100).cast("bigint")).alias("speed_cents"),
            ((F.col("user_id") % 50) * 100_000 + F.floor((F.col("us") - start) / (3 * MICROS))).alias(
                "odometer_cents"
            ),
            (F.col("event_type") != "error").alias("power_on"),
            (F.col("event_id") % 600 + 1000).alias("latitude_cents"),
            (F.col("event_id") % 300 + 10_600).alias("longitude_cents"),
        )
        .withColumn("fuel_cents", 10_000 - F.col("odometer_cents") % 10_000)
    )


def gps_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded GPS fixes of 50 trucks, one per row of ``events``."""
    return _gps_parts(spark, sf_dir).select(
        "device_id",
        "timestamp",
        (F.col("speed_cents") / 100.0).alias("speed"),
        (F.col("odometer_cents") / 100.0).alias("odometer"),
        "power_on",
        (F.col("latitude_cents") / 100.0).alias("latitude"),
        (F.col("longitude_cents") / 100.0).alias("longitude"),
        (F.col("fuel_cents") / 100.0).alias("fuel_gauge"),
        F.col("event_id").alias("ingest_seq"),
    )


def raw_gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fixes as base64 messages: a fifth sent twice, some spoiled."""
    copies = F.when(F.col("event_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    parts = (
        _gps_parts(spark, sf_dir)
        .withColumn("copy", F.explode(copies))
        .withColumn("ingest_seq", F.col("event_id") * 2 + F.col("copy"))
        .withColumn("kind", F.col("ingest_seq") % 17)
    )
    kind = F.col("kind")
    speed = (
        F.when(kind == BLANK_SPEED, "")
        .when(kind == BAD_NUMBER, "fast")
        .when(kind == NEGATIVE_SPEED, F.concat(F.lit("-1"), _cents_text(F.col("speed_cents"))))
        .otherwise(_cents_text(F.col("speed_cents")))
    )
    epoch = _text(F.floor(F.col("us") / MICROS), ".", F.lpad((F.col("us") % MICROS).cast("string"), 6, "0"))
    text = F.concat_ws(
        ":",
        F.col("device_id"),
        epoch,
        speed,
        _cents_text(F.col("odometer_cents")),
        F.when(F.col("power_on"), "True").otherwise("False"),
        _cents_text(F.col("latitude_cents")),
        _cents_text(F.col("longitude_cents")),
        F.when(kind != MISSING_FIELD, _cents_text(F.col("fuel_cents"))),
    )
    sent = F.when(kind == QUOTED, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)
    body = F.when(kind == BAD_BASE64, "not-a-valid-base64!").otherwise(base64_of(sent.cast("binary")))
    return parts.select(
        body.alias("body"),
        F.lit("gps").alias("routing_key"),
        "ingest_seq",
        F.col("timestamp").alias("ingest_ts"),
    )


def fault_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fault parts, one per row of ``lineitem``; a line number may come again."""
    order = F.col("l_orderkey")
    first = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    day = F.datediff("l_shipdate", F.lit("1970-01-01").cast("date")).cast("bigint")
    cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    return load(spark, sf_dir, "lineitem").select(
        _text("truck_", order % 100).alias("device_id"),
        F.timestamp_micros(first + order * 5 * MICROS).alias("timestamp"),
        F.lpad(F.bin(F.col("l_quantity").cast("bigint")), 8, "0").alias("fault_bits"),
        (order % 120 + 1).cast("string").alias("fault_code"),
        (F.col("l_linenumber") - 1).alias("sequence"),
        (order % 3 + 2).cast("int").alias("total_number"),
        (day * 10_000_000_000_000 + F.col("l_partkey") % 100_000 * 100_000_000 + cents).alias("ingest_seq"),
    )


def raw_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same parts as base64 messages, some spoiled."""
    parts = fault_segments(spark, sf_dir).withColumn("kind", F.col("ingest_seq") % 17)
    kind = F.col("kind")
    text = F.concat_ws(
        ":",
        "device_id",
        F.floor(micros(F.col("timestamp")) / MICROS).cast("string"),
        F.when(kind == EMPTY_BITS, "").otherwise(F.col("fault_bits")),
        "fault_code",
        F.when(kind == BAD_SEQUENCE, "X").otherwise(F.col("sequence").cast("string")),
        F.when(kind != MISSING_FIELD, F.col("total_number").cast("string")),
    )
    body = F.when(kind == BAD_BASE64, "not-a-valid-base64!").otherwise(base64_of(text.cast("binary")))
    return parts.select(
        body.alias("body"),
        F.lit("fault").alias("routing_key"),
        "ingest_seq",
        F.col("timestamp").alias("ingest_ts"),
    )


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both feeds on one exchange, plus keys nobody consumes."""
    gps, faults = raw_gps(spark, sf_dir), raw_faults(spark, sf_dir)
    key = F.when(F.col("ingest_seq") % 13 == 0, "status").otherwise(F.col("routing_key"))
    return gps.unionByName(faults).withColumn("routing_key", key)


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device names: one market segment is not registered, debtors have no name."""
    name = F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name"))
    return (
        load(spark, sf_dir, "customer")
        .where(F.col("c_mktsegment") != "FURNITURE")
        .select(_text("truck_", F.col("c_custkey")).alias("device_id"), name.alias("device_name"))
    )


def fault_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by code: large parts are not listed, economy parts have no label."""
    label = F.when(F.col("p_type") != "ECONOMY", F.col("p_name"))
    return (
        load(spark, sf_dir, "part")
        .where(F.col("p_size") <= 45)
        .select(F.col("p_partkey").cast("string").alias("fault_code"), label.alias("label"))
    )

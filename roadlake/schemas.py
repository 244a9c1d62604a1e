"""Schemas of the streams and tables (naive timestamps live in the session zone)."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_MESSAGE = T.StructType(
    [
        T.StructField("body", T.StringType()),
        T.StructField("routing_key", T.StringType()),
        T.StructField("ingest_seq", T.LongType()),
        T.StructField("ingest_ts", T.TimestampType()),
    ]
)

GPS_EVENT = T.StructType(
    [
        T.StructField("device_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("speed", T.DoubleType()),
        T.StructField("odometer", T.DoubleType()),
        T.StructField("power_on", T.BooleanType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("fuel_gauge", T.DoubleType()),
        T.StructField("ingest_seq", T.LongType()),
    ]
)

GPS_COLUMNS = [f.name for f in GPS_EVENT.fields]

FAULT_SEGMENT = T.StructType(
    [
        T.StructField("device_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("fault_bits", T.StringType()),
        T.StructField("fault_code", T.StringType()),
        T.StructField("sequence", T.IntegerType()),
        T.StructField("total_number", T.IntegerType()),
        T.StructField("ingest_seq", T.LongType()),
    ]
)

FAULT_COLUMNS = [f.name for f in FAULT_SEGMENT.fields]

DAILY_SUMMARY = T.StructType(
    [
        T.StructField("vehicle_id", T.StringType()),
        T.StructField("summary_date", T.DateType()),
        T.StructField("start_latitude", T.DoubleType()),
        T.StructField("start_longitude", T.DoubleType()),
        T.StructField("end_latitude", T.DoubleType()),
        T.StructField("end_longitude", T.DoubleType()),
        T.StructField("total_distance_km", T.DoubleType()),
        T.StructField("total_operational_hours", T.DoubleType()),
        T.StructField("trip_count", T.LongType()),
        T.StructField("fuel_consumed_liters", T.DoubleType()),
    ]
)

SUMMARY_COLUMNS = [f.name for f in DAILY_SUMMARY.fields]

IDLING = T.StructType(
    [
        T.StructField("asset_id", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("idle_duration_minutes", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
    ]
)

"""Idling episodes: closed runs of fixes with the engine on and no speed.

Each device is cut into slices of a fixed span of time, and a slice folds its fixes to one
row per run. Runs inside a slice are episodes as they are. Those at its edges go on from the
slice before or into the next: per device only these, and what each slice begins with, are
put in order and joined to episodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlake.functions.engine import is_idle
from roadlake.functions.times import MICROS, micros
from roadlake.operators.lookback import SPAN_SECONDS, with_slice

ORDER = ["us", "ingest_seq"]


def _runs(events: DataFrame, span_seconds: int) -> DataFrame:
    """One row per run of idle fixes in a slice, and one for a slice that begins otherwise.

    ``run`` numbers the first fix of a run in its slice; it is null for the other rows.
    """
    rows = events.select(
        "device_id",
        micros(F.col("timestamp")).alias("us"),
        "ingest_seq",
        is_idle(F.col("power_on"), F.col("speed")).alias("idle"),
        "latitude",
        "longitude",
    )
    w = Window.partitionBy("device_id", "slice").orderBy(*ORDER)
    rows = with_slice(rows, "us", span_seconds).withColumns(
        {"rn": F.row_number().over(w), "prev_idle": F.coalesce(F.lag("idle").over(w), F.lit(False))}
    )
    starts = F.col("idle") & ~F.col("prev_idle")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("run", F.last(F.when(starts, F.col("rn")), ignorenulls=True).over(upto))
    closes = ~F.col("idle") & F.col("prev_idle")
    return (
        rows.where(F.col("idle") | closes | (F.col("rn") == 1))
        .groupBy("device_id", "slice", "run")
        .agg(
            F.min("us").alias("start_us"),
            F.max(F.when(F.col("idle"), F.col("us"))).alias("end_us"),
            F.max(F.when(starts, F.col("latitude"))).alias("latitude"),
            F.max(F.when(starts, F.col("longitude"))).alias("longitude"),
            F.max(F.col("rn") == 1).alias("at_head"),
            F.max(closes | F.col("run").isNull()).alias("closed"),
        )
    )


def idling_episodes(events: DataFrame, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """One row per episode that a later non-idle fix has closed.

    Episodes may cross midnight, so they are looked for in the whole device.
    """
    runs = _runs(events, span_seconds)
    inside = F.col("closed") & ~F.col("at_head")
    # What is known to be whole needs no neighbours and stays spread over the slices.
    lane = F.when(inside, F.col("slice"))
    w = Window.partitionBy("device_id", "lane").orderBy("slice", F.coalesce("run", F.lit(0)))
    runs = runs.withColumn("lane", lane).withColumn("after_open", ~F.lag("closed", 1, True).over(w))
    begins = F.col("run").isNotNull() & ~(F.col("at_head") & F.col("after_open"))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.last(F.when(begins, F.struct("slice", "run")), ignorenulls=True).over(upto)
    return (
        runs.withColumn("begins", begins)
        .withColumn("episode", begun)
        .groupBy("device_id", "lane", "episode")
        .agg(
            F.min(F.when(F.col("begins"), F.col("start_us"))).alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.max("closed").alias("closed"),
            F.max(F.when(F.col("begins"), F.col("latitude"))).alias("latitude"),
            F.max(F.when(F.col("begins"), F.col("longitude"))).alias("longitude"),
        )
        .where(F.col("closed") & F.col("episode").isNotNull())
        .select(
            F.col("device_id").alias("asset_id"),
            F.to_date(F.timestamp_micros("start_us")).alias("date"),
            ((F.col("end_us") - F.col("start_us")) / (60.0 * MICROS)).alias("idle_duration_minutes"),
            "latitude",
            "longitude",
            F.timestamp_micros("start_us").alias("start_time"),
            F.timestamp_micros("end_us").alias("end_time"),
        )
    )

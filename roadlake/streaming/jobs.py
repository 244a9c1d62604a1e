"""Streaming forms of the event-driven operators, and the queries that run them.

The session uses the RocksDB state store (``session.SETTINGS``). Checkpoint and
table paths are folders every executor can reach.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadlake.functions.engine import engine_state, is_idle
from roadlake.functions.payload import cooldown_seconds
from roadlake.functions.times import MICROS, micros
from roadlake.operators import alerts, clean, decode, partials, summary
from roadlake.operators.faults import COMPLETE, FOLD_KEY, PENDING, judged, with_fold_key
from roadlake.plans.faults import labelled_faults, rejected_faults
from roadlake.plans.gps import observed
from roadlake.schemas import FAULT_COLUMNS, GPS_COLUMNS, SUMMARY_COLUMNS
from roadlake.session import pin
from roadlake.sources import stores
from roadlake.streaming.processors import (
    DAY_OUTPUT,
    EPISODE_OUTPUT,
    PART_OUTPUT,
    CooldownProcessor,
    DayProcessor,
    IdlingProcessor,
    PartsProcessor,
)

DEDUP_MEMORY = "1 hour"
LATENESS_SECONDS = 600.0
FLUSH_PERIOD = "10 seconds"
LOOKUP_LIFE_SECONDS = 300.0
#: Name of the counts per reason in a batch's progress.
REFUSED = "refused"
#: Why a stored fix is not in the streamed summary of its day.
TOO_LATE = "late"


def snapshot(dimension: DataFrame) -> DataFrame:
    """The rows as they are now, so that batches neither read the source again nor see it change."""
    return pin(dimension, "lookup")


class Lookup:
    """A dimension whose rows are taken again once they are older than their life."""

    def __init__(
        self,
        read: Callable[[], DataFrame],
        life_seconds: float = LOOKUP_LIFE_SECONDS,
        clock: Callable[[], float] = time.monotonic,
        hold: Callable[[DataFrame], DataFrame] = snapshot,
    ) -> None:
        self._read, self._life, self._clock, self._hold = read, life_seconds, clock, hold
        self._frame: DataFrame | None = None
        self._read_at = 0.0

    def get(self) -> DataFrame:
        if self._frame is None or self._clock() - self._read_at >= self._life:
            self._frame, self._read_at = self._hold(self._read()), self._clock()
        return self._frame

    def invalidate(self) -> None:
        self._frame = None


def dedup(events: DataFrame, memory: str = DEDUP_MEMORY) -> DataFrame:
    """First arrival per (device, timestamp), remembered for ``memory`` of wall-clock time.

    The watermark runs on the time of arrival, behind which no event can fall: late
    events stay, however old they are, and only what is remembered goes.
    """
    arrived = events.withColumn("arrived", F.current_timestamp())
    fresh = arrived.withWatermark("arrived", memory).dropDuplicatesWithinWatermark(clean.EVENT_KEY)
    return fresh.drop("arrived")


def daily_summary(
    events: DataFrame,
    lateness_seconds: float = LATENESS_SECONDS,
    idle_threshold: float = 300.0,
    running: DataFrame | None = None,
) -> DataFrame:
    """Summaries that changed in each batch, and fixes too late for one (``DAY_OUTPUT``).

    With ``running`` (``summary.running_days``) a new query goes on with days that a batch
    began; the fixes those have must not come again.
    """
    fixes = events.select(
        "device_id",
        F.to_date("timestamp").alias("summary_date"),
        micros(F.col("timestamp")).alias("us"),
        "ingest_seq",
        engine_state(F.col("power_on"), F.col("speed")).alias("state"),
        "latitude",
        "longitude",
        "odometer",
        "fuel_gauge",
    )
    zone = events.sparkSession.conf.get("spark.sql.session.timeZone")
    processor = DayProcessor(idle_threshold, int(lateness_seconds * MICROS), zone)
    begun = None if running is None else running.groupBy("device_id")
    return fixes.groupBy("device_id").transformWithStateInPandas(
        processor, DAY_OUTPUT, "Update", "None", initialState=begun
    )


def live_state(spark: SparkSession, checkpoint: str, idle_threshold: float = 300.0) -> DataFrame:
    """``summary.daily_state`` of the days that a summary query holds, as of its last batch.

    Read from the state store under the query's checkpoint; the query may be running.
    """

    def held(name: str) -> DataFrame:
        source = spark.read.format("statestore").option("stateVarName", name)
        return source.option("flattenCollectionTypes", True).load(checkpoint)

    device = F.col("key.device_id").alias("device_id")
    days = held("days").select(
        device, F.col("user_map_key.summary_date").alias("summary_date"), "user_map_value.*"
    )
    recent = held("recent").select(device, "list_element.*")
    slices = partials.partial_of_running(days.where("rows > 0")).unionByName(
        partials.partial_days(recent, summary.threshold_of(summary.STRATEGY, idle_threshold))
    )
    return summary.state_of_partials(slices, idle_threshold)


def idling_episodes(events: DataFrame) -> DataFrame:
    """Episodes as they close (append mode)."""
    fixes = events.select(
        "device_id",
        micros(F.col("timestamp")).alias("us"),
        "ingest_seq",
        is_idle(F.col("power_on"), F.col("speed")).alias("idle"),
        "latitude",
        "longitude",
    )
    closed = fixes.groupBy("device_id").transformWithStateInPandas(
        IdlingProcessor(), EPISODE_OUTPUT, "Append", "None"
    )
    return closed.select(
        "asset_id",
        F.to_date(F.timestamp_micros("start_us")).alias("date"),
        ((F.col("end_us") - F.col("start_us")) / (60.0 * MICROS)).alias("idle_duration_minutes"),
        "latitude",
        "longitude",
        F.timestamp_micros("start_us").alias("start_time"),
        F.timestamp_micros("end_us").alias("end_time"),
    )


def fault_status(segments: DataFrame) -> DataFrame:
    """A status row per arriving part (append mode)."""
    parts = with_fold_key(segments)
    return judged(
        parts.groupBy(*FOLD_KEY).transformWithStateInPandas(
            PartsProcessor(), PART_OUTPUT, "Append", "ProcessingTime"
        )
    )


def mark_suppressed(faults: DataFrame, key: str = "fault_code") -> DataFrame:
    """Each fault with its cool-down mark (append mode)."""
    rows = faults.withColumn("us", micros(F.col("timestamp"))).withColumn(
        "cooldown", cooldown_seconds(F.col("payload_bytes"))
    )
    kept = [f for f in rows.schema.fields if f.name not in ("us", "cooldown")]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.groupBy(key).transformWithStateInPandas(
        CooldownProcessor([f.name for f in kept]), f"{shape}, suppressed boolean", "Append", "None"
    )


def _start(
    stream: DataFrame,
    each_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str,
    trigger: dict,
) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(each_batch)
        .start()
    )


def start_gps_ingest(
    messages: DataFrame,
    devices: Lookup,
    events_path: str,
    notifications_path: str,
    unknown_path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Raw messages to stored events and alert notifications.

    Events of unknown devices go to ``unknown_path``. They are not remembered as
    processed anywhere but in the duplicate window. Each batch reports the messages that
    did not decode, per reason, as ``REFUSED`` among its observed metrics.
    """
    decoded = observed(decode.decode_gps(decode.route(messages, "gps")), REFUSED)
    fresh = dedup(decode.good(decoded, GPS_COLUMNS))

    def store(batch: DataFrame, batch_id: int) -> None:
        write = stores.write_of_batch(batch, batch_id)
        batch = batch.persist()
        try:
            named = clean.enrich_device(batch, devices.get())
            stores.append_gps_events(named, events_path, write)
            letters = alerts.notifications(alerts.gps_envelopes(named))
            stores.append_notifications(letters, notifications_path, write)
            stores.append(clean.unknown_devices(batch, devices.get()), unknown_path, write=write)
        finally:
            batch.unpersist()

    return _start(fresh, store, checkpoint, "append", trigger or {"processingTime": FLUSH_PERIOD})


def start_feed(
    messages: DataFrame,
    devices: Lookup,
    events_path: str,
    parts_path: str,
    rejected_path: str,
    seen_path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """The whole feed in one query: every message ends in one table.

    Each batch is decoded once. Events of known devices go to ``events_path``, fault parts to
    ``parts_path``, everything else to ``rejected_path`` with its body and the reason,
    duplicates included. A fix is a duplicate of any earlier one of its device and time: those
    are in ``seen_path``, by day, of which a batch reads the days that it has fixes of.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, write = batch.sparkSession, stores.write_of_batch(batch, batch_id)
        gps = pin(decode.decode_gps(decode.route(batch, "gps")), "feed-gps")
        parts = pin(decode.decode_faults(decode.route(batch, "fault")), "feed-faults")
        passed = decode.good(gps, [*GPS_COLUMNS, "body", "routing_key"])
        known = clean.known_devices(devices.get()).select("device_id", "device_name")
        first = passed.groupBy(*clean.EVENT_KEY).agg(F.min("ingest_seq").alias("first_seq"))
        first = first.withColumn("event_date", F.to_date("timestamp"))
        # What this batch wrote itself, should it be repeated, is not earlier.
        seen = stores.read_writes(spark, seen_path, first.select(*clean.EVENT_KEY, "event_date"))
        earlier = seen.where(F.col(stores.WRITE) != write).drop(stores.WRITE)
        keys = [*clean.EVENT_KEY, "event_date"]
        fresh = first.join(earlier, keys, "left_anti")
        judged = (
            passed.join(fresh.drop("event_date"), clean.EVENT_KEY, "left")
            .join(known, "device_id", "left")
            .withColumn(
                "reject_reason",
                F.when(~F.col("ingest_seq").eqNullSafe(F.col("first_seq")), decode.DUPLICATE).when(
                    F.col("device_name").isNull(), decode.UNKNOWN_DEVICE
                ),
            )
        )
        judged = pin(judged, "feed-judged")
        events = decode.good(judged, [*GPS_COLUMNS, "device_name"])
        stores.append_gps_events(events, events_path, write)
        stores.append_faults(decode.good(parts, FAULT_COLUMNS), parts_path, write)
        lost = decode.unrouted(batch).select(*decode.QUARANTINE)
        for refused in (gps, parts, judged):
            lost = lost.unionByName(decode.refused(refused))
        stores.append(lost, rejected_path, write=write)
        stores.append(fresh.select(*clean.EVENT_KEY), seen_path, day="timestamp", write=write)

    return _start(messages, store, checkpoint, "append", trigger or {"processingTime": FLUSH_PERIOD})


def start_quarantine(
    messages: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Messages no consumer takes and messages that do not decode, with the reason."""
    columns = ["body", "routing_key", "ingest_seq", "reject_reason"]
    gps = decode.refused(decode.decode_gps(decode.route(messages, "gps")))
    faults = decode.refused(decode.decode_faults(decode.route(messages, "fault")))
    lost = decode.unrouted(messages).select(*columns)
    rows = gps.select(*columns).unionByName(faults.select(*columns)).unionByName(lost)
    return (
        rows.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": FLUSH_PERIOD}))
        .format("parquet")
        .start(path)
    )


def start_summary_flush(
    events: DataFrame,
    stored: Callable[[], DataFrame],
    summary_path: str,
    late_path: str,
    checkpoint: str,
    trigger: dict | None = None,
    lateness_seconds: float = LATENESS_SECONDS,
    running: DataFrame | None = None,
) -> StreamingQuery:
    """Every period, upsert the summaries that changed.

    ``events`` is the stream of the table that ``stored`` reads. Fixes too late for the
    stream's summary go to ``late_path`` with a reason; the days that lack them are worked
    out again from the stored events, as often as they change.
    """

    def flush(batch: DataFrame, batch_id: int) -> None:
        write = stores.write_of_batch(batch, batch_id)
        batch = batch.persist()
        try:
            late = batch.where(F.col("fix_us").isNotNull()).select(
                F.col("vehicle_id").alias("device_id"),
                F.timestamp_micros("fix_us").alias("timestamp"),
                F.col("fix_seq").alias("ingest_seq"),
                F.lit(TOO_LATE).alias("reject_reason"),
            )
            stores.append(late, late_path, write=write)
            whole = batch.where("late_fixes = 0").select(*SUMMARY_COLUMNS)
            short = batch.where("late_fixes > 0").select(
                F.col("vehicle_id").alias("device_id"), F.col("summary_date").alias("event_date")
            )
            if not short.isEmpty():
                fixes = stored().join(short.distinct(), ["device_id", "event_date"], "left_semi")
                whole = whole.unionByName(summary.daily_summary(fixes))
            stores.upsert_summary(whole, summary_path, write)
        finally:
            batch.unpersist()

    found = daily_summary(events, lateness_seconds, running=running)
    return _start(found, flush, checkpoint, "update", trigger or {"processingTime": FLUSH_PERIOD})


def start_idling(
    events: DataFrame, idling_path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    def store(batch: DataFrame, batch_id: int) -> None:
        stores.append_idling(batch, idling_path, stores.write_of_batch(batch, batch_id))

    return _start(
        idling_episodes(events), store, checkpoint, "append", trigger or {"processingTime": FLUSH_PERIOD}
    )


def start_fault_ingest(
    messages: DataFrame,
    devices: Lookup,
    labels: Lookup,
    faults_path: str,
    rejected_path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Raw fault messages to stored, named and labelled faults.

    Faults that end otherwise go to ``rejected_path`` with the reason.
    Its processing-time timers ask for a batch at every trigger, so it runs with
    a period; ``availableNow`` would not end.
    """
    decoded = observed(decode.decode_faults(decode.route(messages, "fault")), REFUSED)
    ended = fault_status(decode.good(decoded, FAULT_COLUMNS)).where(F.col("status") != PENDING)

    def store(batch: DataFrame, batch_id: int) -> None:
        write = stores.write_of_batch(batch, batch_id)
        batch = batch.persist()
        try:
            complete = batch.where(F.col("status") == COMPLETE)
            stored = labelled_faults(complete, devices.get(), labels.get())
            stores.append_faults(stored, faults_path, write)
            rejected = rejected_faults(batch, labels.get(), devices.get())
            stores.append(rejected, rejected_path, write=write)
        finally:
            batch.unpersist()

    return _start(ended, store, checkpoint, "append", trigger or {"processingTime": FLUSH_PERIOD})


def start_fault_alerts(
    faults: DataFrame, notifications_path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Stored faults to notifications: cool-down first, rules second."""
    passed = mark_suppressed(faults).where(~F.col("suppressed")).drop("suppressed")

    def store(batch: DataFrame, batch_id: int) -> None:
        letters = alerts.notifications(alerts.fault_envelopes(batch))
        stores.append_notifications(letters, notifications_path, stores.write_of_batch(batch, batch_id))

    return _start(passed, store, checkpoint, "append", trigger or {"processingTime": FLUSH_PERIOD})


def stream_table(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1000) -> DataFrame:
    """A stored table as a stream, with the columns of ``like``."""
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch)
    return stream.parquet(path)

"""Partial days: what a stretch of one device-day adds to its summary.

A stretch is a run of fixes with nothing between them. Its partial has a fixed number of
fields however many fixes it covers, and ``merged_sql`` puts two neighbours together in the same
form, so stretches may be folded in any grouping. The engine's state and the running trip
before a stretch are unknown to it. What depends on them is kept open:

* the *head*, the fixes before the first trip that certainly starts in the stretch. In it the
  engine stops moving at most once, so whether a trip from before ends there hangs on the
  last fix of the head without movement alone;
* whether the first fix starts a trip, which the state before decides;
* whether the second fix does, if it should turn out to be the second of the day: the first
  fix of a day leaves the engine off.

``slice_rows`` cuts device-days into slices of a fixed span of time, the only shuffle of the
fixes, and windows them there; ``partial_days`` folds each slice to one row on that
partitioning; ``merged_days`` brings the slices of a day together, at most as many as spans
of time fit into a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.functions.engine import MOVING, OFF, STATIONARY, engine_state
from roadlake.functions.times import MICROS, micros
from roadlake.operators.lookback import SPAN_SECONDS, with_slice

DAY_KEYS = ["device_id", "summary_date"]
ORDER = ["us", "ingest_seq"]
PLACE = ["latitude", "longitude", "odometer", "fuel_gauge"]
#: The fields of a partial that ``merged_sql`` works out; the others are the first's or the last's.
FIRST = ["first_us", "first_state", *(f"first_{c}" for c in PLACE)]
LAST = ["last_us", "last_state", *(f"last_{c}" for c in PLACE)]
FIELDS = [
    "fixes", *FIRST, "second_us", "second_state", "head_idle_us", "on_us", "trips",
    "open_us", "open_ended", *LAST,
]


def day_rows(events: DataFrame, payload: list[str]) -> DataFrame:
    return events.select(
        "device_id",
        F.to_date("timestamp").alias("summary_date"),
        micros(F.col("timestamp")).alias("us"),
        "ingest_seq",
        engine_state(F.col("power_on"), F.col("speed")).alias("state"),
        *payload,
    )


def waited(since: Column, until: Column, threshold_us: int | None) -> Column:
    """Whether a trip that began at ``since`` ends at a fix without movement at ``until``."""
    if threshold_us is None:
        return F.lit(False)
    return F.coalesce(until - since >= threshold_us, F.lit(False))


def slice_rows(
    rows: DataFrame, threshold_us: int | None, span_seconds: int = SPAN_SECONDS
) -> DataFrame:
    """``day_rows`` with their place in their slice, and the trip that runs since a fix of the slice.

    Adds ``rn``, ``is_last``, ``prev_us``, ``prev_state``, ``trip`` (``us`` and ``rn`` of its
    first fix), and ``ends``: the fix is the first that ends the trip.
    """
    w = Window.partitionBy(*DAY_KEYS, "slice").orderBy(*ORDER)
    rows = with_slice(rows, "us", span_seconds).withColumns(
        {
            "rn": F.row_number().over(w),
            "is_last": F.lead(F.lit(True)).over(w).isNull(),
            "prev_us": F.lag("us").over(w),
            "prev_state": F.lag("state").over(w),
        }
    )
    starts = (F.col("state") == MOVING) & (F.col("prev_state") != MOVING)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.last(F.when(starts, F.struct("us", "rn")), ignorenulls=True).over(upto)
    stopped = (F.col("state") != MOVING) & waited(F.col("trip.us"), F.col("us"), threshold_us)
    # A fix without movement starts nothing, so the fix before it is of the same trip.
    before = (F.col("prev_state") != MOVING) & waited(F.col("trip.us"), F.col("prev_us"), threshold_us)
    return rows.withColumn("trip", running).withColumn("ends", stopped & ~before)


def head_idle() -> Column:
    """Time of a fix without movement in the head of a slice."""
    return F.when(F.col("trip").isNull() & (F.col("state") != MOVING), F.col("us"))


def edges() -> list[Column]:
    """What later steps ask of the first, second and last fix of a slice."""
    nth = [("first", F.col("rn") == 1), ("second", F.col("rn") == 2), ("last", F.col("is_last"))]
    return [
        F.max(F.when(is_it, F.col(c))).alias(f"{side}_{c}") for side, is_it in nth for c in ("us", "state")
    ]


def partial_days(
    rows: DataFrame, threshold_us: int | None, span_seconds: int = SPAN_SECONDS
) -> DataFrame:
    """One row per slice of the device-days of ``day_rows``: ``DAY_KEYS``, ``slice``, ``FIELDS``."""
    rows = slice_rows(rows, threshold_us, span_seconds)
    on = F.col("state").isin(STATIONARY, MOVING)
    started = F.col("trip.rn")
    folded = rows.groupBy(*DAY_KEYS, "slice").agg(
        F.count("*").alias("fixes"),
        *edges(),
        *[F.max(F.when(F.col("rn") == 1, F.col(c))).alias(f"first_{c}") for c in PLACE],
        *[F.max(F.when(F.col("is_last"), F.col(c))).alias(f"last_{c}") for c in PLACE],
        F.max(head_idle()).alias("head_idle_us"),
        F.coalesce(F.sum(F.when(on, F.col("us") - F.col("prev_us"))), F.lit(0)).alias("on_us"),
        F.count_if("ends").alias("trips"),
        F.max(F.col("trip.us")).alias("open_us"),
        F.max(started).alias("open_rn"),
        F.max(F.when(F.col("ends"), started)).alias("ended_rn"),
    )
    ended = F.col("open_rn").eqNullSafe(F.col("ended_rn")) & F.col("open_rn").isNotNull()
    return folded.withColumn("open_ended", ended).select(*DAY_KEYS, "slice", *FIELDS)


def _waited_sql(since: str, until: str, threshold_us: int | None) -> str:
    return "false" if threshold_us is None else f"coalesce({until} - {since} >= {threshold_us}L, false)"


def merged_sql(a: str, b: str, threshold_us: int | None) -> str:
    """The partial of two neighbouring stretches, ``a`` before ``b``.

    As text: built column by column, an expression of this size takes longer to plan than to run.
    """
    starts = f"({b}.first_state = {MOVING} AND {a}.last_state <> {MOVING})"
    of_first = f"({starts} AND {_waited_sql(f'{b}.first_us', f'{b}.head_idle_us', threshold_us)})"
    running = f"{a}.open_us IS NOT NULL AND NOT {a}.open_ended AND NOT {starts}"
    of_open = f"({running} AND {_waited_sql(f'{a}.open_us', f'{b}.head_idle_us', threshold_us)})"
    head_goes_on = f"{a}.open_us IS NULL AND NOT {starts}"
    engine_on = f"{b}.first_state IN ({STATIONARY}, {MOVING})"
    found = {
        "fixes": f"{a}.fixes + {b}.fixes",
        **{c: f"{a}.{c}" for c in FIRST},
        "second_us": f"if({a}.fixes >= 2, {a}.second_us, {b}.first_us)",
        "second_state": f"if({a}.fixes >= 2, {a}.second_state, {b}.first_state)",
        "head_idle_us": f"if({head_goes_on}, greatest({a}.head_idle_us, {b}.head_idle_us), {a}.head_idle_us)",
        "on_us": f"{a}.on_us + {b}.on_us + if({engine_on}, {b}.first_us - {a}.last_us, 0L)",
        "trips": f"{a}.trips + {b}.trips + if({of_first}, 1L, 0L) + if({of_open}, 1L, 0L)",
        "open_us": f"coalesce({b}.open_us, if({starts}, {b}.first_us, NULL), {a}.open_us)",
        "open_ended": f"CASE WHEN {b}.open_us IS NOT NULL THEN {b}.open_ended WHEN {starts} THEN {of_first} "
        f"ELSE {a}.open_ended OR {of_open} END",
        **{c: f"{b}.{c}" for c in LAST},
    }
    return "named_struct(" + ", ".join(f"'{c}', {found[c]}" for c in FIELDS) + ")"


def merged_days(partials: DataFrame, threshold_us: int | None, keys: list[str] = DAY_KEYS) -> DataFrame:
    """One row per day with ``part``, the partial of all its slices.

    ``slice`` orders the partials of a day. Each must cover what the others do not.
    """
    each = partials.select(*keys, F.struct("slice", F.struct(*FIELDS).alias("part")).alias("one"))
    days = each.groupBy(*keys).agg(F.sort_array(F.collect_list("one")).alias("parts"))
    step = f"(a, b) -> {merged_sql('a', 'b.part', threshold_us)}"
    whole = F.expr(f"aggregate(slice(parts, 2, size(parts)), parts[0].part, {step})")
    return days.select(*keys, whole.alias("part"))


def settled(part: Column, threshold_us: int | None) -> dict[str, Column]:
    """What a whole day's partial says: ``trip_count``, ``open_us`` and ``state``.

    The day's first fix only opens it and leaves the engine off, so a moving second one
    starts a trip whatever the first one's state.
    """
    second = F.when(
        (part["first_state"] == MOVING) & (part["second_state"] == MOVING), part["second_us"]
    )
    ended = waited(second, part["head_idle_us"], threshold_us)
    of_second = F.when(~ended, second)
    return {
        "trip_count": part["trips"] + ended.cast("long"),
        "open_us": F.when(part["open_us"].isNull(), of_second).when(~part["open_ended"], part["open_us"]),
        "state": F.when(part["fixes"] == 1, OFF).otherwise(part["last_state"]),
    }


#: What a fold in order of time holds of a day, and the field of the partial that says it.
RUNNING = {
    "start_latitude": "first_latitude",
    "start_longitude": "first_longitude",
    "end_latitude": "last_latitude",
    "end_longitude": "last_longitude",
    "first_odometer": "first_odometer",
    "odometer": "last_odometer",
    "first_fuel": "first_fuel_gauge",
    "fuel": "last_fuel_gauge",
    "on_us": "on_us",
    "last_us": "last_us",
    "rows": "fixes",
}


def running_days(days: DataFrame, threshold_us: int | None) -> DataFrame:
    """The days of ``merged_days`` as a fold that goes on with them holds them."""
    part = F.col("part")
    said = settled(part, threshold_us)
    return days.select(
        *DAY_KEYS,
        *[part[c].alias(name) for name, c in RUNNING.items()],
        said["trip_count"].alias("trip_count"),
        said["state"].cast("int").alias("state"),
        said["open_us"].alias("trip_us"),
    )


def partial_of_running(days: DataFrame) -> DataFrame:
    """Days as such a fold holds them, as partials that stand before all slices."""
    no_trip = F.col("trip_us").isNull()
    found = {
        **{c: F.col(name) for name, c in RUNNING.items()},
        # What the first two fixes mean is settled, and no trip is open before the fold's.
        "first_us": F.col("last_us"),
        "first_state": F.lit(OFF),
        "second_us": F.lit(None).cast("long"),
        "second_state": F.lit(OFF),
        "head_idle_us": F.lit(None).cast("long"),
        "trips": F.col("trip_count"),
        "open_us": F.coalesce("trip_us", "last_us"),
        "open_ended": no_trip,
        "last_state": F.col("state"),
    }
    before = F.lit(-(2**63)).cast("long").alias("slice")
    return days.select(*DAY_KEYS, before, *[found[c].alias(c) for c in FIELDS])


def trips_of_days(events: DataFrame, threshold_us: int, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """Finished trips: ``DAY_KEYS``, ``start_us``, ``end_us``.

    Trips inside one slice are known there. For a trip from before, a slice says at which of
    its head's fixes it would end. A trip from an earlier slice began before this one does, so
    only fixes of the first ``threshold_us`` and the first one after them come into question.
    """
    slice_start = F.col("slice") * (span_seconds * MICROS)
    w = Window.partitionBy(*DAY_KEYS, "slice").orderBy(*ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = slice_rows(day_rows(events, []), threshold_us, span_seconds).withColumns(
        {"us1": F.first("us").over(upto), "us2": F.nth_value("us", 2).over(upto)}
    )
    idle = head_idle()
    inside = F.when(F.col("ends"), F.struct(F.col("trip.us").alias("start_us"), F.col("us").alias("end_us")))
    slices = rows.groupBy(*DAY_KEYS, "slice").agg(
        *edges(),
        F.count("*").alias("fixes"),
        F.collect_list(inside).alias("inside"),
        F.collect_list(F.when(idle < slice_start + threshold_us, idle)).alias("early"),
        F.min(F.when(idle >= slice_start + threshold_us, idle)).alias("late"),
        F.min(F.when(waited(F.col("us1"), idle, threshold_us), idle)).alias("end_of_first"),
        F.min(F.when(waited(F.col("us2"), idle, threshold_us), idle)).alias("end_of_second"),
        F.max("trip.us").alias("open_us"),
        F.max("trip.rn").alias("open_rn"),
        F.max(F.when(F.col("ends"), F.col("trip.rn"))).alias("ended_rn"),
    )
    facts = [c for c in slices.columns if c not in (*DAY_KEYS, "slice")]
    days = slices.groupBy(*DAY_KEYS).agg(
        F.sort_array(F.collect_list(F.struct("slice", F.struct(*facts).alias("of")))).alias("parts")
    )
    since = """CASE WHEN held.fixes = 0 THEN if(of.first_state = {m} AND of.second_state = {m}, of.second_us, NULL)
        WHEN of.first_state = {m} AND held.state <> {m} THEN of.first_us ELSE held.open_us END"""
    since = since.format(m=MOVING).replace("of.", "one.of.")
    end = f"""CASE WHEN held.fixes = 0 THEN if(one.of.first_state = {MOVING} AND one.of.second_state = {MOVING},
            one.of.end_of_second, NULL)
        WHEN one.of.first_state = {MOVING} AND held.state <> {MOVING} THEN one.of.end_of_first
        WHEN held.open_us IS NOT NULL THEN least(one.of.late,
            array_min(filter(one.of.early, us -> us >= held.open_us + {threshold_us}L))) END"""
    ended = "coalesce(one.of.open_rn = one.of.ended_rn, false)"
    fixes = "held.fixes + one.of.fixes"
    pairs = "array<struct<start_us: bigint, end_us: bigint>>"
    follow = f"""named_struct(
        'fixes', {fixes},
        'state', if({fixes} = 1, {OFF}, one.of.last_state),
        'open_us', CASE WHEN {ended} THEN NULL WHEN one.of.open_rn IS NOT NULL THEN one.of.open_us
            WHEN ({end}) IS NULL THEN ({since}) END,
        'done', concat(held.done, if(({end}) IS NULL, CAST(array() AS {pairs}),
            array(named_struct('start_us', ({since}), 'end_us', ({end})))), one.of.inside))"""
    nothing = f"""named_struct('fixes', 0L, 'state', {OFF}, 'open_us', CAST(NULL AS bigint),
        'done', CAST(array() AS {pairs}))"""
    found = F.expr(f"aggregate(parts, {nothing}, (held, one) -> {follow}).done")
    return days.select(*DAY_KEYS, F.inline(found))

"""Trips, operating hours and the daily summary of each vehicle.

The rules of the service fold each slice of a device-day to a partial and merge those
(``partials``). Rules of one's own may look at any earlier fix, so they run on rows that a
look-back (``lookback``) gave the previous fix and the running trip.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.functions.engine import MOVING, OFF, STATIONARY, engine_state, state_name
from roadlake.functions.times import MICROS
from roadlake.operators import partials
from roadlake.operators.lookback import SPAN_SECONDS, look_back
from roadlake.operators.partials import DAY_KEYS, ORDER, day_rows
from roadlake.schemas import SUMMARY_COLUMNS

IDLE_THRESHOLD_SECONDS = 300.0

# A trip rule says when the row ends the running trip; the earliest such row of
# a trip counts. An hours rule says how many microseconds the row adds.
TripRule = Callable[[float], Column]
HoursRule = Callable[[], Column]


def _ends_after_threshold(idle_threshold: float) -> Column:
    waited = F.col("us") - F.col("trip_us")
    return (F.col("state") != MOVING) & (waited >= F.lit(idle_threshold * MICROS))


def _never_ends(idle_threshold: float) -> Column:
    return F.lit(False)


def _gap_while_on() -> Column:
    on = F.col("state").isin(STATIONARY, MOVING)
    return F.when(on, F.col("us") - F.col("prev_us")).otherwise(0)


# "as_run": the state is overwritten before the comparison, so no trip starts.
STRATEGY, AS_RUN, ENGINE_ON = "strategy", "as_run", "engine_on"
TRIP_RULES: dict[str, TripRule] = {STRATEGY: _ends_after_threshold, AS_RUN: _never_ends}
HOURS_RULES: dict[str, HoursRule] = {ENGINE_ON: _gap_while_on}


def register_trip_rule(name: str, rule: TripRule) -> None:
    _check_free(name, (STRATEGY, AS_RUN))
    TRIP_RULES[name] = rule


def register_hours_rule(name: str, rule: HoursRule) -> None:
    _check_free(name, (ENGINE_ON,))
    HOURS_RULES[name] = rule


def _check_free(name: str, taken: tuple[str, ...]) -> None:
    if name in taken:
        raise ValueError(f"{name} is a rule of the service")


def threshold_of(trip_rule: str, idle_threshold: float) -> int | None:
    """Microseconds after which a trip may end; None where it never does."""
    return None if trip_rule == AS_RUN else int(idle_threshold * MICROS)


def with_engine_state(events: DataFrame) -> DataFrame:
    state = engine_state(F.col("power_on"), F.col("speed"))
    return events.withColumn("engine_state", state_name(state))


def _day_rows(events: DataFrame, payload: list[str], span_seconds: int) -> DataFrame:
    """Fixes of each device-day in order, with the running trip's start."""
    rows = day_rows(events, payload)
    # The first fix of a day only opens the summary, and leaves the engine off.
    before = F.when(F.col("rn") == 2, OFF).otherwise(F.col("prev_state"))
    starts = (F.col("rn") > 1) & (F.col("state") == MOVING) & (before != MOVING)
    started = F.when(starts, F.struct(F.col("us"), F.col("ingest_seq").alias("seq")))
    rows = look_back(rows, DAY_KEYS, ORDER, ["us", "state"], started, "trip", span_seconds)
    return rows.withColumn("trip_us", F.col("trip.us")).withColumn("trip_seq", F.col("trip.seq"))


def _per_trip(rows: DataFrame, trip_rule: str, idle_threshold: float, *more: Column) -> DataFrame:
    ends = (F.col("rn") > 1) & TRIP_RULES[trip_rule](idle_threshold)
    return rows.groupBy(*DAY_KEYS, "trip_us", "trip_seq").agg(
        F.min(F.when(ends, F.col("us"))).alias("end_us"), *more
    )


def trips(
    events: DataFrame,
    idle_threshold: float = IDLE_THRESHOLD_SECONDS,
    trip_rule: str = "strategy",
    span_seconds: int = SPAN_SECONDS,
) -> DataFrame:
    """Finished trips of every device-day."""
    if trip_rule == STRATEGY:
        done = partials.trips_of_days(events, threshold_of(trip_rule, idle_threshold), span_seconds)
    else:
        per_trip = _per_trip(_day_rows(events, [], span_seconds), trip_rule, idle_threshold)
        done = per_trip.where(F.col("end_us").isNotNull()).withColumn("start_us", F.col("trip_us"))
    return done.select(
        "device_id",
        "summary_date",
        F.timestamp_micros("start_us").alias("start_time"),
        F.timestamp_micros("end_us").alias("end_time"),
        ((F.col("end_us") - F.col("start_us")) / (3600.0 * MICROS)).alias("operational_hours"),
    )


def state_of_partials(
    slices: DataFrame, idle_threshold: float = IDLE_THRESHOLD_SECONDS, trip_rule: str = STRATEGY
) -> DataFrame:
    """``daily_state`` from partials of slices, which may have been stored."""
    threshold_us = threshold_of(trip_rule, idle_threshold)
    part = F.col("part")
    said = partials.settled(part, threshold_us)
    days = partials.merged_days(slices, threshold_us).select(
        *DAY_KEYS, "part.*", *[c.alias(f"day_{name}") for name, c in said.items()]
    )
    return _day_columns(
        days.withColumn("trip_count", F.col("day_trip_count")).withColumn("last_state", F.col("day_state")),
        F.timestamp_micros("day_open_us"),
    )


def daily_state(
    events: DataFrame,
    idle_threshold: float = IDLE_THRESHOLD_SECONDS,
    trip_rule: str = "strategy",
    hours_rule: str = "engine_on",
    span_seconds: int = SPAN_SECONDS,
) -> DataFrame:
    """The summary of each device-day plus the state a live fold would hold."""
    if trip_rule in (STRATEGY, AS_RUN) and hours_rule == ENGINE_ON:
        rows = day_rows(events, partials.PLACE)
        slices = partials.partial_days(rows, threshold_of(trip_rule, idle_threshold), span_seconds)
        return state_of_partials(slices, idle_threshold, trip_rule)
    first_last = ["latitude", "longitude", "odometer", "fuel_gauge"]
    rows = _day_rows(events, first_last, span_seconds)
    first, last = F.col("rn") == 1, F.col("is_last")
    ends = [("first", first, c) for c in first_last] + [("last", last, c) for c in first_last]
    per_trip = _per_trip(
        rows,
        trip_rule,
        idle_threshold,
        F.sum(F.when(F.col("rn") > 1, HOURS_RULES[hours_rule]())).alias("on_us"),
        *[F.max(F.when(flag, F.col(c))).alias(f"{side}_{c}") for side, flag, c in ends],
        F.max(F.when(last, F.col("us"))).alias("last_us"),
        F.max(F.when(last, F.when(first, OFF).otherwise(F.col("state")))).alias("last_state"),
    )
    started = F.struct("trip_us", "trip_seq")
    days = per_trip.groupBy(*DAY_KEYS).agg(
        F.count("end_us").alias("trip_count"),
        F.coalesce(F.sum("on_us"), F.lit(0)).alias("on_us"),
        *[F.max(f"{side}_{c}").alias(f"{side}_{c}") for side, _, c in ends],
        F.max("last_us").alias("last_us"),
        F.max("last_state").alias("last_state"),
        F.max(F.when(F.col("trip_us").isNotNull(), started)).alias("newest"),
        F.max(F.when(F.col("end_us").isNotNull(), started)).alias("newest_done"),
    )
    running = F.col("newest").isNotNull() & ~F.col("newest").eqNullSafe(F.col("newest_done"))
    return _day_columns(days, F.when(running, F.timestamp_micros("newest.trip_us")))


def _day_columns(days: DataFrame, open_since: Column) -> DataFrame:
    return days.select(
        F.col("device_id").alias("vehicle_id"),
        "summary_date",
        F.col("first_latitude").alias("start_latitude"),
        F.col("first_longitude").alias("start_longitude"),
        F.col("last_latitude").alias("end_latitude"),
        F.col("last_longitude").alias("end_longitude"),
        (F.col("last_odometer") - F.col("first_odometer")).alias("total_distance_km"),
        (F.col("on_us") / (3600.0 * MICROS)).alias("total_operational_hours"),
        "trip_count",
        (F.col("first_fuel_gauge") - F.col("last_fuel_gauge")).alias("fuel_consumed_liters"),
        F.col("last_odometer").alias("odometer"),
        F.col("last_fuel_gauge").alias("fuel_gauge"),
        open_since.alias("last_moving_time"),
        F.timestamp_micros("last_us").alias("last_event_time"),
        state_name(F.col("last_state")).alias("state"),
        F.when(
            open_since.isNotNull(),
            F.struct(
                open_since.alias("start_time"),
                F.lit(None).cast("timestamp").alias("end_time"),
                F.lit(0.0).alias("operational_hours"),
            ),
        ).alias("current_trip"),
    )


def running_days(events: DataFrame, idle_threshold: float = IDLE_THRESHOLD_SECONDS) -> DataFrame:
    """Each device-day as a stream holds it that goes on with it (``jobs.daily_summary``)."""
    threshold_us = threshold_of(STRATEGY, idle_threshold)
    slices = partials.partial_days(day_rows(events, partials.PLACE), threshold_us)
    return partials.running_days(partials.merged_days(slices, threshold_us), threshold_us)


def daily_summary(events: DataFrame, **options: object) -> DataFrame:
    """One row per vehicle and day, as stored in ``daily_vehicle_summary``."""
    return daily_state(events, **options).select(*SUMMARY_COLUMNS)


def trip_counts(events: DataFrame, **options: object) -> DataFrame:
    return daily_state(events, **options).select("vehicle_id", "summary_date", "trip_count")


def merge_summaries(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert on (vehicle, day): the fresh row wins, but a stored start stays."""
    keys = ["vehicle_id", "summary_date"]
    rest = [c for c in SUMMARY_COLUMNS if c not in keys]
    old = stored.select(*keys, F.lit(True).alias("stored"), F.struct(*rest).alias("old"))
    new = fresh.select(*keys, F.lit(True).alias("fresh"), F.struct(*rest).alias("new"))

    def pick(name: str) -> Column:
        first, second = ("old", "new") if name.startswith("start_") else ("new", "old")
        flag = "stored" if first == "old" else "fresh"
        chosen = F.when(F.col(flag), F.col(f"{first}.{name}")).otherwise(F.col(f"{second}.{name}"))
        return chosen.alias(name)

    return old.join(new, keys, "full_outer").select(*keys, *[pick(c) for c in rest])


def newest_of_log(versions: DataFrame) -> DataFrame:
    """Of all ``versions`` of a (vehicle, day) one row: the newest, but with the oldest start.

    The result has the same form, so versions may be folded in any grouping.
    """
    keys = ["vehicle_id", "summary_date"]
    rest = [c for c in SUMMARY_COLUMNS if c not in keys]
    picked = [
        (F.min_by if c.startswith("start_") else F.max_by)(c, "version").alias(c) for c in rest
    ]
    return versions.groupBy(*keys).agg(*picked, F.max("version").alias("version"))


def apply_increments(summary: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add batched changes (``trips``, ``km``, ``seconds``) to existing rows.

    Deltas of unknown keys change nothing. Seconds become hours.
    """
    keys = ["vehicle_id", "summary_date"]
    total = deltas.groupBy(*keys).agg(
        F.sum("trips").alias("trips"), F.sum("km").alias("km"), F.sum("seconds").alias("seconds")
    )

    def plus(name: str, delta: Column) -> Column:
        return (F.col(name) + F.coalesce(delta, F.lit(0))).alias(name)

    changed = {
        "trip_count": plus("trip_count", F.col("trips")),
        "total_distance_km": plus("total_distance_km", F.col("km")),
        "total_operational_hours": plus("total_operational_hours", F.col("seconds") / 3600.0),
    }
    return summary.join(total, keys, "left").select(
        *[changed.get(c, F.col(c)) for c in SUMMARY_COLUMNS]
    )


def summary_by_key(summary: DataFrame, vehicle_id: str, day: object) -> DataFrame:
    return summary.where((F.col("vehicle_id") == vehicle_id) & (F.col("summary_date") == F.lit(day)))

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from roadlake.operators import idling, lookback, partials, summary
from roadlake.sources import tables
from tests.helpers import at, fixes, fold_days, gps_frame


def fix(second, speed, power=True, odometer=1000.0, seq=None, device="d"):
    return (device, at(second), speed, odometer, power, 10.0, 106.0, 100.0, seq or int(second))


def one(spark, rows, **options):
    return summary.daily_state(gps_frame(spark, rows), **options).collect()


def test_first_fix_only_opens_the_day(spark):
    (day,) = one(spark, [fix(0, 50.0)])
    assert (day.trip_count, day.total_distance_km, day.total_operational_hours) == (0, 0.0, 0.0)
    assert day.state == "ENGINE_OFF" and day.current_trip is None and day.last_event_time == at(0)


def test_distance(spark):
    (day,) = one(spark, [fix(0, 0.0, odometer=900.0), fix(10, 0.0, odometer=1000.0)])
    assert day.total_distance_km == 100.0


@pytest.mark.parametrize("stop, trips", [(360, 1), (120, 0)])
def test_trip_ends_after_the_threshold(spark, stop, trips):
    rows = [fix(0, 0.0, power=False), fix(10, 40.0), fix(10 + stop, 0.0)]
    (day,) = one(spark, rows)
    assert day.trip_count == trips
    assert (day.current_trip is None) == bool(trips)
    assert day.last_moving_time == (None if trips else at(10))


def test_as_run_counts_no_trip(spark):
    rows = [fix(0, 0.0, power=False), fix(10, 40.0), fix(700, 0.0)]
    (day,) = one(spark, rows, trip_rule="as_run")
    assert day.trip_count == 0 and day.total_operational_hours > 0


@pytest.mark.parametrize("power, hours", [(True, 1.0), (False, 0.0)])
def test_hours(spark, power, hours):
    (day,) = one(spark, [fix(0, 0.0), fix(3600, 30.0, power=power)])
    assert day.total_operational_hours == hours


def check_against_fold(spark, rows, **options):
    frame = gps_frame(spark, rows)
    expected = fold_days(frame.collect())
    got = {(r.vehicle_id, r.summary_date): r for r in summary.daily_state(frame, **options).collect()}
    assert got.keys() == expected["days"].keys()
    for key, day in expected["days"].items():
        row = got[key]
        assert (row.start_latitude, row.start_longitude) == day["start"]
        assert (row.end_latitude, row.end_longitude) == day["end"]
        assert row.total_distance_km == pytest.approx(day["km"])
        assert row.fuel_consumed_liters == pytest.approx(day["fuel"])
        assert row.total_operational_hours == pytest.approx(day["seconds"] / 3600)
        assert row.trip_count == day["trips"]
        assert row.last_moving_time == day["began"]
        assert row.last_event_time == day["last"]
    done = sorted((r.device_id, r.summary_date, r.start_time, r.end_time) for r in summary.trips(frame, **options).collect())
    assert done == expected["trips"]


@pytest.mark.parametrize("seed", range(3))
def test_fold(spark, seed):
    check_against_fold(spark, fixes(random.Random(seed), 4, 60, 40 * 3600))


@pytest.mark.parametrize("seed, size", [(11, 1), (12, 60), (13, 900), (14, 86_400)])
def test_fold_on_hot_days(spark, seed, size):
    rng = random.Random(seed)
    rows = fixes(rng, 1, 900, 20 * 3600) + [(f"x{r[0]}", *r[1:]) for r in fixes(rng, 3, 20, 40 * 3600)]
    check_against_fold(spark, rows, span_seconds=size)


def test_no_slice_holds_a_hot_day(spark):
    """A day with most rows is spread over the day's hours."""
    rows = fixes(random.Random(1), 1, 5000, 24 * 3600)
    rows += [(f"x{r[0]}", *r[1:]) for r in fixes(random.Random(2), 1, 30, 3600)]
    frame = gps_frame(spark, rows).withColumn("us", F.unix_micros("timestamp"))
    sizes = lookback.with_slice(frame, "us", 3600).groupBy("device_id", "slice").count().collect()
    hot = [r["count"] for r in sizes if r.device_id == "dev0"]
    assert sum(hot) == 5000 and max(hot) < 2 * 5000 / 24
    check_against_fold(spark, rows)


@pytest.mark.parametrize("seed", range(4))
def test_partials_merge_in_any_grouping(spark, seed):
    """Stretches of a day merged two by two from either end, and all at once."""
    rng = random.Random(seed)
    rows = fixes(rng, 3, 40, 9 * 3600)
    frame = gps_frame(spark, rows)
    threshold_us = summary.threshold_of(summary.STRATEGY, 300.0)
    slices = partials.partial_days(partials.day_rows(frame, partials.PLACE), threshold_us, 1800)
    slices = slices.withColumn("place", F.row_number().over(Window.partitionBy(*partials.DAY_KEYS).orderBy("slice")))
    expected = {r.device_id: r.part for r in partials.merged_days(slices, threshold_us).collect()}
    for size in (2, 3, 7):
        groups = slices.withColumn("slice", F.floor(F.col("place") / size) * 1000 + F.col("place") % size)
        groups = groups.withColumn("part_of", F.floor(F.col("place") / size))
        inner = partials.merged_days(groups, threshold_us, [*partials.DAY_KEYS, "part_of"])
        outer = inner.select(*partials.DAY_KEYS, F.col("part_of").alias("slice"), "part.*")
        found = {r.device_id: r.part for r in partials.merged_days(outer, threshold_us).collect()}
        assert found == expected


def test_two_exchanges_fold_a_day(spark, given):
    events = tables.gps_events(spark, given)
    for operator in (summary.daily_summary, summary.trips, idling.idling_episodes):
        plan = operator(events)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 2


def jobs_started(spark, build):
    group = f"building-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, "building")
    frame = build()
    started = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return frame, len(started)


def test_building_a_plan_starts_no_job(spark, given):
    events = tables.gps_events(spark, given)
    for operator in (summary.daily_summary, summary.trips, summary.daily_state, idling.idling_episodes):
        _, started = jobs_started(spark, lambda: operator(events))
        assert started == 0


def test_a_lookup_reads_its_vehicle_only(spark, tmp_path):
    """The key's filter goes through the look-back to the scan, on rows and seams alike."""
    path = f"{tmp_path}/events"
    gps_frame(spark, fixes(random.Random(3), 3, 50, 3600)).write.parquet(path)
    events = spark.read.parquet(path)
    found = summary.summary_by_key(summary.daily_summary(events), "dev1", dt.date(2024, 1, 1))
    scans = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert scans and all("EqualTo(device_id,dev1)" in x for x in scans)


def test_merge_keeps_the_stored_start(spark):
    def row(vehicle, day, start, end):
        return (vehicle, dt.date(2024, 1, day), start, start, end, end, 1.0, 1.0, 1, 1.0)

    from roadlake.schemas import DAILY_SUMMARY

    stored = spark.createDataFrame([row("a", 1, 1.0, 2.0), row("b", 1, 5.0, 6.0)], DAILY_SUMMARY)
    fresh = spark.createDataFrame([row("a", 1, 3.0, 4.0), row("c", 2, 7.0, 8.0)], DAILY_SUMMARY)
    got = {r.vehicle_id: (r.start_latitude, r.end_latitude) for r in summary.merge_summaries(stored, fresh).collect()}
    assert got == {"a": (1.0, 4.0), "b": (5.0, 6.0), "c": (7.0, 8.0)}


def test_increments(spark):
    from roadlake.schemas import DAILY_SUMMARY

    day = dt.date(2024, 1, 1)
    stored = spark.createDataFrame([("a", day, 0.0, 0.0, 0.0, 0.0, 10.0, 2.0, 3, 0.0)], DAILY_SUMMARY)
    deltas = spark.createDataFrame(
        [("a", day, 1, 2.5, 1800.0), ("a", day, 1, 0.5, 1800.0), ("z", day, 1, 1.0, 1.0)],
        "vehicle_id string, summary_date date, trips int, km double, seconds double",
    )
    (row,) = summary.apply_increments(stored, deltas).collect()
    assert (row.trip_count, row.total_distance_km, row.total_operational_hours) == (5, 13.0, 3.0)


def test_own_rules(spark):
    summary.register_trip_rule("at_once", lambda threshold: F.col("state") != 3)
    summary.register_hours_rule("always", lambda: F.col("us") - F.col("prev_us"))
    rows = [fix(0, 0.0, power=False), fix(10, 40.0), fix(3600, 0.0, power=False)]
    (day,) = one(spark, rows, trip_rule="at_once", hours_rule="always")
    assert (day.trip_count, day.total_operational_hours) == (1, 1.0)

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roadlake.operators import hotspots, paging, reports
from roadlake.schemas import DAILY_SUMMARY, GPS_EVENT, IDLING

DAY = dt.date(2024, 12, 30)


def summaries(spark, rows):
    """(vehicle, day offset, km, hours, fuel)"""
    data = [
        (v, DAY + dt.timedelta(days=d), 0.0, 0.0, 0.0, 0.0, km, hours, 1, fuel) for v, d, km, hours, fuel in rows
    ]
    return spark.createDataFrame(data, DAILY_SUMMARY)


def test_device_day(spark):
    def fix(hour, odometer, speed):
        return ("d", dt.datetime(2025, 5, 6, hour), speed, odometer, True, 0.0, 0.0, 0.0, hour)

    events = spark.createDataFrame([fix(1, 100.0, 20.0), fix(0, 0.0, 10.0)], GPS_EVENT)
    (row,) = reports.device_day_report(events, "d", "2025-05-06").collect()
    assert (row.total_distance_km, row.average_speed) == (100.0, 15.0)
    assert row.total_distance_miles == pytest.approx(62.1371)
    with pytest.raises(reports.NotFound):
        reports.device_day_report(events, "x", "2025-05-06")
    with pytest.raises(reports.NotFound):
        reports.device_day_report(events, "d", "2025-05-07")
    for bad in ("2025-5-6", "2025-13-01", "today"):
        with pytest.raises(ValueError):
            reports.device_day_report(events, "d", bad)


def test_utilization(spark):
    frame = summaries(spark, [("a", 0, 73.75, 0.0, 0.0), ("b", 0, 300.0, 0.0, 0.0), ("c", 0, 0.0, 0.0, 0.0), ("d", 0, None, 0.0, 0.0)])
    got = {r.asset_id: r for r in reports.utilization_distance(frame, 250.0).collect()}
    assert got["a"].utilization_score_primary == round(73.75 / 250, 2) == 0.29
    assert (got["b"].utilization_score_primary, got["b"].target_km_met) == (1.0, True)
    assert (got["c"].utilization_score_primary, got["c"].target_km_met) == (0.0, False)
    assert got["d"].utilization_score_primary == 0.0
    for target in (0, None):
        with pytest.raises(ValueError):
            reports.utilization_hours(frame, target)


def test_utilization_report(spark):
    frame = summaries(spark, [("a", 0, 5.0, 1.0, 1.0), ("b", 0, None, 1.0, 1.0), ("c", 1, 7.0, 1.0, 1.0), ("e", 9, 9.0, 1.0, 1.0)])
    ask = dict(report_by="distance", start=DAY, end=DAY + dt.timedelta(days=1), target=10.0)
    by_score = dict(sort_by="utilization_score_primary")
    down, counts = reports.utilization_report(frame, **ask, **by_score, direction="desc", page_size=2)
    assert [r.asset_id for r in down.collect()] == ["b", "c"]
    assert tuple(counts.first()) == (3, 2)
    up, _ = reports.utilization_report(frame, **ask, **by_score, direction="upwards", page=2, page_size=2)
    assert [r.asset_id for r in up.collect()] == ["b"]
    with pytest.raises(ValueError):
        reports.utilization_report(frame, **ask, sort_by="nothing")
    with pytest.raises(ValueError):
        reports.utilization_report(frame, **{**ask, "report_by": "fuel"})
    with pytest.raises(ValueError):
        reports.utilization_report(frame, **{**ask, "end": DAY - dt.timedelta(days=1)})


def test_daily_efficiency(spark):
    frame = summaries(spark, [("a", 0, 10.0, 1.0, 4.0), ("b", 0, 10.0, 1.0, 0.0), ("c", 0, 10.0, 1.0, -3.0), ("d", 0, None, None, None)])
    got = {r.asset_id: r for r in reports.efficiency_daily(frame).collect()}
    assert [got[v].km_per_liter for v in "abcd"] == [2.5, 0.0, 0.0, 0.0]
    assert (got["c"].fuel_consumed_liters, got["d"].traveled_km) == (-3.0, 0.0)


def test_weeks_and_months(spark):
    rows = [("a", 0, 10.0, 7.0, 2.0), ("a", 3, 10.0, 7.0, 2.0), ("b", 6, 5.0, 14.0, 1.0), ("b", 7, 1.0, 1.0, 0.0)]
    frame = summaries(spark, rows)
    weeks = {r.period_start: r for r in reports.efficiency_weekly(frame).collect()}
    first = weeks[dt.date(2024, 12, 30)]
    assert first.period_end == dt.date(2025, 1, 5)
    assert (first.total_traveled_km_fleet, first.overall_km_per_liter_fleet) == (25.0, 5.0)
    assert first.average_operational_hours_per_asset_per_day == 28.0 / (7 * 2)
    assert weeks[dt.date(2025, 1, 6)].overall_km_per_liter_fleet is None
    months = {r.period_start: r for r in reports.efficiency_monthly(frame).collect()}
    assert months[dt.date(2024, 12, 1)].period_end == dt.date(2024, 12, 31)
    assert months[dt.date(2024, 12, 1)].average_operational_hours_per_asset_per_day == 7.0 / 31
    only_b, counts = reports.efficiency_report(frame, "monthly", DAY, DAY + dt.timedelta(days=30), ["b"])
    (row,) = only_b.collect()
    assert (row.asset_id, row.total_traveled_km, row.km_per_liter) == ("b", 6.0, 6.0)
    assert counts.first().total_records == 2
    paged, counts = reports.efficiency_report(frame, "weekly", DAY, DAY + dt.timedelta(days=30), None, (1, 2))
    assert paged.first().total_traveled_km_fleet == 20.0 and tuple(counts.first()) == (4, 2)
    with pytest.raises(ValueError):
        reports.efficiency_report(frame, "hourly", DAY, DAY)


def test_long_asset_list(spark):
    frame = summaries(spark, [("a", 0, 1.0, 1.0, 1.0), ("b", 0, 1.0, 1.0, 1.0)])
    many = [f"v{i}" for i in range(1500)] + ["b"]
    assert [r.vehicle_id for r in reports.of_assets(frame, "vehicle_id", many).collect()] == ["b"]
    assert reports.of_assets(frame, "vehicle_id", []).count() == 2


def test_pages(spark):
    frame = spark.range(10)
    assert [r.id for r in paging.page_of(frame, ["id"], 3, 4).collect()] == [8, 9]
    assert [r.id for r in paging.page_after(frame, ["id"], (7,), 4).collect()] == [8, 9]
    assert [r.id for r in paging.page_after(frame, ["id"], None, 2).collect()] == [0, 1]
    for page, size in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            paging.page_of(frame, ["id"], page, size)


def test_next_page_with_nulls_and_directions(spark):
    rows = [(i, float(i // 3) if i % 4 else None) for i in range(12)]
    frame = spark.createDataFrame(rows, "id long, km double")
    for order in (["km", "id"], ["-km", "id"], ["-km", "-id"]):
        whole = paging.page_after(frame, order, None, 12).collect()
        last, seen = None, []
        while page := paging.page_after(frame, order, last, 5).collect():
            seen += page
            last = (page[-1].km, page[-1].id)
        assert seen == whole and len(seen) == 12


def test_own_reports_plug_in(spark, monkeypatch):
    day = dt.date(2024, 5, 1)
    rows = [("a", day, 1.0, 2.0, 1.0, 2.0, 100.0, 5.0, 2, 10.0), ("b", day, 1.0, 2.0, 1.0, 2.0, 60.0, 3.0, 1, 4.0)]
    frame = spark.createDataFrame(rows, DAILY_SUMMARY)
    monkeypatch.setattr(reports, "UTILIZATION", dict(reports.UTILIZATION))
    reports.register_utilization(
        "trips", "trip_count", lambda df, target: df.selectExpr("vehicle_id", f"trip_count / {target} AS score")
    )
    by = {"sort_by": "utilization_score_primary", "direction": "desc"}
    found, _ = reports.utilization_report(frame, "trips", day, day, 4.0, **by)
    assert [tuple(r) for r in found.collect()] == [("a", 0.5), ("b", 0.25)]
    monkeypatch.setattr(reports, "GRANULARITIES", dict(reports.GRANULARITIES))
    listed = lambda df, ids: reports.of_assets(df, "vehicle_id", ids)
    reports.register_granularity("all", lambda df, ids: listed(df, ids).selectExpr("sum(trip_count) AS trips"))
    found, _ = reports.efficiency_report(frame, "all", day, day, ["a"])
    assert found.first().trips == 2
    monkeypatch.setattr(hotspots, "GROUPERS", dict(hotspots.GROUPERS))
    hotspots.register_grouper("half_", lambda level: (F.when(F.col("latitude") < 0, "south").otherwise("north"), None))
    rows = [("a", 1, 5.0, -1.0, 9.0), ("b", 1, 2.0, 1.0, 9.0), ("c", 1, 3.0, 2.0, 9.0)]
    found = hotspots.hotspots(episodes(spark, rows), "half_globe").collect()
    assert sorted(tuple(r) for r in found) == [("north", 2, 5.0, ["b", "c"]), ("south", 1, 5.0, ["a"])]


def bisected(lat, lon, precision):
    letters, spans, bits = "0123456789bcdefghjkmnpqrstuvwxyz", [[-180.0, 180.0], [-90.0, 90.0]], ""
    for i in range(5 * precision):
        span, value = spans[i % 2], (lon, lat)[i % 2]
        middle = (span[0] + span[1]) / 2
        bits += "1" if value > middle else "0"
        span[0 if value > middle else 1] = middle
    return "".join(letters[int(bits[i : i + 5], 2)] for i in range(0, len(bits), 5))


def test_geohash(spark):
    import random

    from pyspark.sql import functions as F

    from roadlake.functions.geo import geohash

    rng = random.Random(3)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)]
    points += [(0.0, 0.0), (45.0, 90.0), (-90.0, -180.0), (90.0, 180.0), (10.7769, 106.6959)]
    frame = spark.createDataFrame(points, "lat double, lon double")
    for precision in (1, 5, 7, 12):
        got = [r[0] for r in frame.select(geohash(F.col("lat"), F.col("lon"), precision)).collect()]
        assert got == [bisected(lat, lon, precision) for lat, lon in points]


def episodes(spark, rows):
    start = dt.datetime(2024, 1, 1)
    data = [(a, dt.date(2024, 1, d), m, lat, lon, start, start) for a, d, m, lat, lon in rows]
    return spark.createDataFrame(data, IDLING)


def test_grid(spark):
    rows = [("b", 1, 5.0, 10.004, 106.0), ("a", 1, 6.0, 9.996, 106.0), ("a", 2, 1.0, 10.004, 106.0), ("c", 1, 1.0, -0.004, 0.0)]
    got = {r[0]: tuple(r[1:]) for r in hotspots.hotspots(episodes(spark, rows), "rounded_lat_lon_0.01").collect()}
    assert got == {"10.00_106.00": (3, 12.0, ["a", "b"]), "0.00_0.00": (1, 1.0, ["c"])}
    half = hotspots.hotspots(episodes(spark, [("a", 1, 1.0, 0.5, 1.5)]), "rounded_lat_lon_1").first()
    assert half.location_identifier == "0.0_2.0"


def test_geohash_shows_five(spark):
    rows = [(f"v{i:02}", 1, 1.0, 10.0, 106.0) for i in range(200)]
    row = hotspots.hotspots(episodes(spark, rows), "geohash_level_5").first()
    assert row.total_idle_incidents == 200
    assert row.contributing_asset_ids_sample == sorted(f"v{i:02}" for i in range(200))[:5]


def test_levels_and_pages(spark):
    for bad in ("geohash_level_x", "rounded_lat_lon_x", "hexagons_5"):
        with pytest.raises(ValueError):
            hotspots.grouping(bad)
    frame = episodes(spark, [("a", d, float(d), 10.0, 106.0) for d in range(1, 10)])
    report, counts = hotspots.hotspot_report(frame, dt.date(2024, 1, 2), dt.date(2024, 1, 8), 3, page=(2, 4))
    assert tuple(report.first())[1:3] == (2, 15.0) and tuple(counts.first()) == (6, 2)
    with pytest.raises(ValueError):
        hotspots.hotspot_report(frame, DAY, DAY, 1, page=(1, 101))

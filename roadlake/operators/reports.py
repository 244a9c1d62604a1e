"""Reports on stored fixes and daily summaries."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.functions.numbers import round_half_even
from roadlake.operators.paging import check_dates, page_counts, page_of
from roadlake.schemas import SUMMARY_COLUMNS

# Fixed value: miles in a kilometre.
MILES_PER_KM = 0.621371


class NotFound(LookupError):
    """The device, or its data on the day, does not exist."""


def parse_day(text: str) -> dt.date:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"not a YYYY-MM-DD date: {text}")
    return dt.date.fromisoformat(text)


# Device-day statistics


def fixes_of_day(events: DataFrame, device_id: str, day: dt.date) -> DataFrame:
    """Fixes of one device in the half-open day, pruned by day where stored so."""
    start = F.lit(day).cast("timestamp")
    rows = events.where(
        (F.col("device_id") == device_id)
        & (F.col("timestamp") >= start)
        & (F.col("timestamp") < F.lit(day + dt.timedelta(days=1)).cast("timestamp"))
    )
    return rows.where(F.col("event_date") == F.lit(day)) if "event_date" in events.columns else rows


def device_day_stats(events: DataFrame) -> DataFrame:
    """Distance and mean speed of every device-day.

    Stored fixes differ in (device, timestamp), so time alone orders them and
    the aggregate is hashed and combined map-side.
    """
    km = F.max_by("odometer", "timestamp") - F.min_by("odometer", "timestamp")
    return events.groupBy("device_id", F.to_date("timestamp").alias("date")).agg(
        km.alias("total_distance_km"),
        (km * F.lit(MILES_PER_KM)).alias("total_distance_miles"),
        F.avg("speed").alias("average_speed"),
    )


def device_day_report(events: DataFrame, device_id: str, day: str) -> DataFrame:
    """The statistics of one device on one day, or ``NotFound``."""
    date = parse_day(day)
    if events.where(F.col("device_id") == device_id).limit(1).isEmpty():
        raise NotFound(f"device {device_id} not found")
    report = device_day_stats(fixes_of_day(events, device_id, date))
    if report.isEmpty():
        raise NotFound(f"no data for device {device_id} on {day}")
    return report


# Filters on the daily summary


def in_dates(df: DataFrame, column: str, start: dt.date, end: dt.date) -> DataFrame:
    check_dates(start, end)
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def of_assets(df: DataFrame, column: str, asset_ids: list[str] | None) -> DataFrame:
    """Rows of the listed assets; no list, or an empty one, means all."""
    if not asset_ids:
        return df
    return df.where(F.col(column).isin(asset_ids))


# Utilization


def _checked_target(target: float | None, name: str) -> float:
    if target is None:
        raise ValueError(f"give {name}: utilization is measured against it")
    if target == 0:
        raise ValueError(f"{name} is 0; nothing can be measured against it")
    return float(target)


def _utilization(summary: DataFrame, actual: str, target: float, shown: str, met: str) -> DataFrame:
    value = F.coalesce(F.col(actual), F.lit(0.0))
    score = F.when(value == 0, 0.0).otherwise(value / F.lit(target))
    return summary.withColumn("score", score).select(
        F.col("vehicle_id").alias("asset_id"),
        "summary_date",
        F.col(actual).alias(shown),
        (F.col("score") >= 1.0).alias(met),
        round_half_even(F.least("score", F.lit(1.0)), 2).alias("utilization_score_primary"),
    )


def utilization_distance(summary: DataFrame, target_km_per_day: float | None) -> DataFrame:
    target = _checked_target(target_km_per_day, "target_km_per_day")
    return _utilization(summary, "total_distance_km", target, "actual_traveled_km", "target_km_met")


def utilization_hours(summary: DataFrame, target_hours_per_day: float | None) -> DataFrame:
    target = _checked_target(target_hours_per_day, "target_hours_per_day")
    return _utilization(
        summary, "total_operational_hours", target, "actual_operational_hours", "target_hours_met"
    )


# report_by -> (column behind "utilization_score_primary", calculation)
UTILIZATION: dict[str, tuple[str, Callable[[DataFrame, float | None], DataFrame]]] = {
    "distance": ("total_distance_km", utilization_distance),
    "hours": ("total_operational_hours", utilization_hours),
}


def register_utilization(name: str, sort_column: str, calculate: Callable) -> None:
    UTILIZATION[name] = (sort_column, calculate)


def sort_order(report_by: str, sort_by: str, direction: str) -> list[Column]:
    """Requested column first, NULLs where the store puts them, keys as tie-break."""
    if sort_by == "utilization_score_primary":
        sort_by = UTILIZATION[report_by][0]
    if sort_by not in SUMMARY_COLUMNS:
        raise ValueError(f"no column {sort_by!r} to sort by; the columns are {', '.join(SUMMARY_COLUMNS)}")
    column = F.col(sort_by)
    down = direction.lower() == "desc"
    first = column.desc_nulls_first() if down else column.asc_nulls_last()
    return [first, F.col("vehicle_id"), F.col("summary_date")]


def utilization_report(
    summary: DataFrame,
    report_by: str,
    start: dt.date,
    end: dt.date,
    target: float | None,
    page: int = 1,
    page_size: int = 20,
    sort_by: str = "vehicle_id",
    direction: str = "asc",
) -> tuple[DataFrame, DataFrame]:
    """A sorted page of scores, and the counts of the whole selection."""
    if report_by not in UTILIZATION:
        raise ValueError(f"no utilization is registered as {report_by!r}; there are {sorted(UTILIZATION)}")
    chosen = in_dates(summary, "summary_date", start, end)
    rows = page_of(chosen, sort_order(report_by, sort_by, direction), page, page_size)
    return UTILIZATION[report_by][1](rows, target), page_counts(chosen, page_size)


# Fleet efficiency


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def _km_per_liter(km: Column, fuel: Column) -> Column:
    return F.when(fuel > 0, km / fuel)


def efficiency_daily(summary: DataFrame, asset_ids: list[str] | None = None) -> DataFrame:
    km, fuel = F.col("total_distance_km"), _or_zero("fuel_consumed_liters")
    return summary.select(
        F.col("vehicle_id").alias("asset_id"),
        "summary_date",
        _or_zero("total_distance_km").alias("traveled_km"),
        _or_zero("total_operational_hours").alias("operational_hours"),
        fuel.alias("fuel_consumed_liters"),
        F.coalesce(_km_per_liter(km, fuel), F.lit(0.0)).alias("km_per_liter"),
    )


def _per_asset(summary: DataFrame, period_start: Column) -> DataFrame:
    return summary.groupBy("vehicle_id", period_start.alias("period_start")).agg(
        F.sum(_or_zero("total_distance_km")).alias("km"),
        F.sum(_or_zero("total_operational_hours")).alias("hours"),
        F.sum(_or_zero("fuel_consumed_liters")).alias("fuel"),
    )


def _by_period(
    summary: DataFrame,
    asset_ids: list[str] | None,
    period_start: Column,
    period_end: Column,
    days: Column,
) -> DataFrame:
    """Per asset when assets are listed, else for the fleet.

    The fleet figures add up the per-asset rows, so assets are counted by
    counting rows and nothing is made distinct.
    """
    assets = _per_asset(summary, period_start)
    if asset_ids:
        return assets.select(
            "period_start",
            period_end.alias("period_end"),
            F.col("vehicle_id").alias("asset_id"),
            F.col("km").alias("total_traveled_km"),
            F.col("hours").alias("total_operational_hours"),
            _km_per_liter(F.col("km"), F.col("fuel")).alias("km_per_liter"),
        )
    fleet = assets.groupBy("period_start").agg(
        F.sum("km").alias("km"),
        F.sum("hours").alias("hours"),
        F.sum("fuel").alias("fuel"),
        F.count("*").alias("assets"),
    )
    return fleet.select(
        "period_start",
        period_end.alias("period_end"),
        F.col("km").alias("total_traveled_km_fleet"),
        (F.col("hours") / (days * F.col("assets"))).alias("average_operational_hours_per_asset_per_day"),
        _km_per_liter(F.col("km"), F.col("fuel")).alias("overall_km_per_liter_fleet"),
    )


def efficiency_weekly(summary: DataFrame, asset_ids: list[str] | None = None) -> DataFrame:
    """Weeks run Monday to Sunday; a part of a week still counts seven days."""
    start = F.to_date(F.date_trunc("week", "summary_date"))
    return _by_period(summary, asset_ids, start, F.date_add("period_start", 6), F.lit(7))


def efficiency_monthly(summary: DataFrame, asset_ids: list[str] | None = None) -> DataFrame:
    last = F.last_day("period_start")
    return _by_period(summary, asset_ids, F.trunc("summary_date", "month"), last, F.day(last))


GRANULARITIES: dict[str, Callable[[DataFrame, list[str] | None], DataFrame]] = {
    "daily": efficiency_daily,
    "weekly": efficiency_weekly,
    "monthly": efficiency_monthly,
}


def register_granularity(name: str, aggregate: Callable) -> None:
    GRANULARITIES[name] = aggregate


def efficiency_report(
    summary: DataFrame,
    granularity: str,
    start: dt.date,
    end: dt.date,
    asset_ids: list[str] | None = None,
    page: tuple[int, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The report and the counts of the selected summary rows.

    Without ``page`` the whole selection is aggregated. With ``(page, size)`` the
    selection is paged first and only that page is aggregated.
    """
    if granularity not in GRANULARITIES:
        raise ValueError(f"unknown period {granularity!r}; reports are made for {sorted(GRANULARITIES)}")
    chosen = of_assets(in_dates(summary, "summary_date", start, end), "vehicle_id", asset_ids)
    rows = page_of(chosen, ["summary_date", "vehicle_id"], *page) if page else chosen
    counts = page_counts(chosen, page[1] if page else 20)
    return GRANULARITIES[granularity](rows, asset_ids), counts

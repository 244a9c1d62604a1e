"""Where vehicles idle: episodes grouped by grid point or geohash."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.functions.geo import geohash, grid_key
from roadlake.operators.paging import check_page, page_counts, page_of
from roadlake.operators.reports import in_dates

LARGEST_PAGE = 100
# The prefixes of the two kinds of level.
GRID, GEOHASH = "rounded_lat_lon_", "geohash_level_"

Grouper = Callable[[str], tuple[Column, int | None]]


def _size(level: str, prefix: str, number: Callable[[str], float]) -> float:
    """What stands behind a level's prefix."""
    try:
        return number(level.removeprefix(prefix))
    except ValueError:
        raise ValueError(f"{level!r}: expected a number after {prefix!r}") from None


def _grid(level: str) -> tuple[Column, int | None]:
    step = _size(level, GRID, float)
    return grid_key(F.col("latitude"), F.col("longitude"), step), None


def _geohash(level: str) -> tuple[Column, int | None]:
    precision = int(_size(level, GEOHASH, int))
    return geohash(F.col("latitude"), F.col("longitude"), precision), 5


# Prefix of a level -> its location key and how many asset ids are shown.
GROUPERS: dict[str, Grouper] = {GRID: _grid, GEOHASH: _geohash}


def register_grouper(prefix: str, grouper: Grouper) -> None:
    GROUPERS[prefix] = grouper


def grouping(level: str) -> tuple[Column, int | None]:
    own = next((prefix for prefix in GROUPERS if level.startswith(prefix)), None)
    if own is None:
        raise ValueError(f"no grouper for {level!r}; known prefixes: {', '.join(GROUPERS)}")
    return GROUPERS[own](level)


def idling_filter(episodes: DataFrame, start: dt.date, end: dt.date, min_minutes: int) -> DataFrame:
    return in_dates(episodes, "date", start, end).where(F.col("idle_duration_minutes") >= min_minutes)


def asset_shares(episodes: DataFrame, level: str) -> DataFrame:
    """Incidents and minutes of every asset at every location, one row each."""
    key, _ = grouping(level)
    return episodes.groupBy(key.alias("location_identifier"), "asset_id").agg(
        F.count("*").alias("incidents"), F.sum("idle_duration_minutes").alias("minutes")
    )


def hotspots(episodes: DataFrame, level: str) -> DataFrame:
    """Incidents, minutes and asset ids by location.

    Episodes are first folded per (location, asset), so a busy location never
    meets one task as single episodes. Where a level shows a few ids, those are
    ranked before any is collected: a location is spread over as many parts as
    a shuffle has, and each part gives no more ids than are shown. The grid lists
    every asset of a location once, as the report asks; ``asset_shares`` has the
    same facts as rows, for locations with more assets than a row can hold.
    """
    _, shown = grouping(level)
    shares = asset_shares(episodes, level)
    totals = [
        F.sum("incidents").alias("total_idle_incidents"),
        F.sum("minutes").alias("total_idle_duration_minutes"),
    ]
    ids = F.array_sort(F.collect_list("asset_id")).alias("contributing_asset_ids_sample")
    if shown is None:
        return shares.groupBy("location_identifier").agg(*totals, ids)
    parts = int(episodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = shares.withColumn("part", F.pmod(F.xxhash64("asset_id"), F.lit(parts)))
    by_id = Window.partitionBy("location_identifier", "part").orderBy("asset_id")
    early = F.when(F.row_number().over(by_id) <= shown, F.col("asset_id"))
    first = F.slice(F.array_sort(F.collect_list("early")), 1, shown)
    return (
        spread.withColumn("early", early)
        .groupBy("location_identifier")
        .agg(*totals, first.alias("contributing_asset_ids_sample"))
    )


def hotspot_report(
    episodes: DataFrame,
    start: dt.date,
    end: dt.date,
    min_minutes: int,
    level: str = "rounded_lat_lon_0.01",
    page: tuple[int, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Hotspots and the counts of the selected episodes.

    With ``(page, size)`` the episodes are paged first and only that page is grouped.
    """
    if page:
        check_page(*page, largest=LARGEST_PAGE)
    chosen = idling_filter(episodes, start, end, min_minutes)
    rows = page_of(chosen, ["date", "asset_id", "start_time"], *page) if page else chosen
    return hotspots(rows, level), page_counts(chosen, page[1] if page else 20)

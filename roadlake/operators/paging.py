"""Sorted pages and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_page(page: int, page_size: int, largest: int | None = None) -> None:
    if page < 1 or page_size < 1 or (largest is not None and page_size > largest):
        raise ValueError("page and page_size must be at least 1 and within the limit")


def check_dates(start: object, end: object) -> None:
    if end < start:
        raise ValueError(f"the dates run backwards: {start} to {end}")


def page_of(df: DataFrame, order: list[Column | str], page: int, page_size: int) -> DataFrame:
    """One page; ``order`` must name every row uniquely.

    Each task keeps at most offset + size rows. ``page_after`` costs the same on
    every page and suits deep paging.
    """
    check_page(page, page_size)
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def _beyond(name: str, value: object) -> Column:
    """Rows behind ``value`` in the order of one key; NULL counts as the largest value."""
    down, key = name.startswith("-"), F.col(name.removeprefix("-"))
    if value is None:
        return key.isNotNull() if down else F.lit(False)
    return key < F.lit(value) if down else key.isNull() | (key > F.lit(value))


def page_after(df: DataFrame, order: list[str], last: tuple | None, page_size: int) -> DataFrame:
    """The page that follows the row whose ``order`` values are ``last``.

    A key with a minus in front runs downwards. NULL counts as the largest value:
    last going up, first going down, as in the sorted reports.
    """
    check_page(1, page_size)
    if last is not None:
        behind, alike = F.lit(False), F.lit(True)
        for name, value in zip(order, last, strict=True):
            behind = behind | (alike & F.coalesce(_beyond(name, value), F.lit(False)))
            alike = alike & F.col(name.removeprefix("-")).eqNullSafe(F.lit(value))
        df = df.where(behind)
    keys = [
        F.col(name[1:]).desc_nulls_first() if name.startswith("-") else F.col(name).asc_nulls_last()
        for name in order
    ]
    return df.orderBy(*keys).limit(page_size)


def page_counts(df: DataFrame, page_size: int) -> DataFrame:
    check_page(1, page_size)
    n = F.count("*")
    return df.agg(
        n.alias("total_records"),
        F.ceil(n / F.lit(page_size)).cast("bigint").alias("total_pages"),
    )

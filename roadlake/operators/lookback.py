"""Ordered look-back (previous row, last seen value) over keys of any size.

A plain window sends a whole key to one task, and one device may hold a third of all
rows. So each key is cut into *slices* of a fixed span of time: a slice is windowed on
its own, and the few facts it needs from earlier slices (their last row, their row
count, their last non-null value) come from one small row per key and slice. The answer
is that of the plain window, whatever the span.

A slice is a plain function of its row. So there is one plan for every size, nothing
runs while it is built, filters on the keys reach the scan, and the rows are shuffled
once: seams and rows meet on the partitioning that the window has already made.

Rows of one key must differ in the order columns, of which the first is in
microseconds; copies are removed first (``clean.dedup``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.functions.times import MICROS

SPAN_SECONDS = 3600


def with_slice(df: DataFrame, at: str, span_seconds: int) -> DataFrame:
    """Add ``slice``: which span of time the row lies in."""
    return df.withColumn("slice", F.floor(F.col(at) / F.lit(span_seconds * MICROS)))


def _seams(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], value: Column) -> DataFrame:
    """What each slice needs from the slices of its key before it.

    ``rows`` are windowed inside their slices. Their first rows lack a predecessor, so
    ``value`` is left out there, and worked out again on the one-row-per-slice table,
    where the predecessor is the end of the slice before. The row number inside a slice
    is true in a key's first slice; in a later one any row but the first has at least
    two before it. Both answers are kept until it is known which slice is the first.
    """
    not_first = F.col("rn") > 1
    here = F.struct(*order)
    facts = list(dict.fromkeys([*order, *columns]))

    def latest(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), here)).alias(name)

    per_slice = (
        rows.withColumn("inner_first", F.when(not_first, value))
        .withColumn("not_first", not_first)
        .withColumn("rn", F.col("rn") + 1)
        .withColumn("inner_later", F.when(F.col("not_first"), value))
        .groupBy(*keys, "slice")
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct(*facts)).alias("head"),
            F.max(F.struct(*facts)).alias("tail"),
            latest("inner_first"),
            latest("inner_later"),
        )
    )
    by_slice = Window.partitionBy(*keys).orderBy("slice")
    earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    heads = per_slice.select(
        *keys,
        "slice",
        "inner_first",
        "inner_later",
        "head.*",
        *[F.lag(F.col(f"tail.{c}")).over(by_slice).alias(f"prev_{c}") for c in columns],
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + 1).alias("rn"),
        F.lead(F.lit(True)).over(by_slice).isNotNull().alias("seam_more"),
    )
    inner = F.when(F.col("rn") == 1, F.col("inner_first")).otherwise(F.col("inner_later"))
    return heads.withColumn("left", F.coalesce(inner, value)).select(
        *keys,
        "slice",
        *[F.col(f"prev_{c}").alias(f"seam_{c}") for c in columns],
        (F.col("rn") - 1).alias("seam_rows"),
        "seam_more",
        F.last("left", ignorenulls=True).over(earlier).alias("seam_value"),
    )


def look_back(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: list[str],
    value: Column,
    name: str,
    span_seconds: int = SPAN_SECONDS,
) -> DataFrame:
    """Look at the rows before each row of its key.

    Adds ``prev_<column>`` (one row back), ``rn``, ``is_last``, and ``name``: the last
    non-null ``value`` up to and including the row. ``value`` may use the order columns,
    ``columns``, and what is added before it.
    """
    w = Window.partitionBy(*keys, "slice").orderBy(*order)
    rows = with_slice(df, order[0], span_seconds).withColumns(
        {
            **{f"prev_{c}": F.lag(c).over(w) for c in columns},
            "rn": F.row_number().over(w),
            "is_last": F.lead(F.lit(True)).over(w).isNull(),
        }
    )
    seams = _seams(rows, keys, order, columns, value)
    first = F.col("rn") == 1
    joined = rows.join(seams, [*keys, "slice"]).withColumns(
        {
            **{
                f"prev_{c}": F.when(first, F.col(f"seam_{c}")).otherwise(F.col(f"prev_{c}"))
                for c in columns
            },
            "rn": F.col("rn") + F.col("seam_rows"),
            "is_last": F.col("is_last") & ~F.col("seam_more"),
        }
    )
    latest = F.last(value, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return joined.withColumn(name, F.coalesce(latest, "seam_value")).drop(
        "slice", "seam_rows", "seam_more", "seam_value", *[f"seam_{c}" for c in columns]
    )

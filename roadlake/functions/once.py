"""Columns that later filters refer to but must not re-evaluate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator.

    Filters are pushed through a projection by copying its expressions into the
    predicate; a chain of costly ones then grows with every step. They are not
    pushed through a generator, so each column here is computed once per row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))

"""Text-to-number columns that accept and refuse what the raw feed's decoder does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings of a decimal number and of an integer.
FLOAT_PATTERN = (
    r"(?i)^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?"
    r"|inf|infinity|nan)\s*$"
)
INT_PATTERN = r"^\s*[+-]?\d+(_\d+)*\s*$"


def to_float(text: Column) -> Column:
    """DOUBLE, or NULL where the text is not a number. ``1.0f`` is not one.

    The plain cast differs only on texts with a type suffix, a hex prefix, an
    underscore or a name (inf, nan); only those are held against the pattern.
    """
    odd = text.rlike("[dDfFxXnN_]")
    plain = F.regexp_replace(text, r"(?i)[_\s]|[+-](?=nan)", "")
    by_pattern = F.when(text.rlike(FLOAT_PATTERN), plain.try_cast("double"))
    return F.when(odd, by_pattern).otherwise(text.try_cast("double"))


def to_int(text: Column) -> Column:
    """INT, or NULL where the text is not a whole number."""
    plain = F.regexp_replace(text, r"[_\s]", "")
    by_pattern = F.when(text.rlike(INT_PATTERN), plain.try_cast("int"))
    return F.when(text.contains("_"), by_pattern).otherwise(text.try_cast("int"))


def float_text(value: Column) -> Column:
    """A DOUBLE the way the alert texts spell it: plain up to 1e16, then 1e+16."""
    size = F.abs(value)
    java = value.cast("string")
    exact = F.regexp_replace(java.try_cast("decimal(38,18)").cast("string"), r"0+$", "")
    plain = F.when(exact.endswith("."), F.concat(exact, F.lit("0"))).otherwise(exact)
    mantissa = F.regexp_replace(F.split_part(java, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(java, F.lit("E"), F.lit(2)).try_cast("int")
    sign = F.when(power < 0, "-").otherwise("+")
    digits = F.lpad(F.abs(power).cast("string"), 2, "0")
    wide = F.when(F.abs(power) > 99, F.abs(power).cast("string")).otherwise(digits)
    return (
        F.when(F.isnan(value), "nan")
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), sign, wide))
    )


def round_half_even(value: Column, digits: int) -> Column:
    """Nearest decimal of the exact binary value, ties to even (0.295 gives 0.29).

    ``bround`` looks at the shortest decimal text instead (0.30). The scaled
    value is kept as a sum of two doubles, so a tie is seen for what it is.
    """
    scale = F.lit(float(10**digits))
    # Fixed value: 2**27 + 1 splits a double into two halves of 26 bits.
    wide = value * F.lit(134217729.0)
    high = wide - (wide - value)
    low = value - high
    scaled = high * scale + low * scale
    rest = (high * scale - scaled) + low * scale
    down = F.floor(scaled).cast("double")
    tie = scaled - down == 0.5
    nearest = (
        F.when(tie & (rest > 0), down + 1).when(tie & (rest < 0), down).otherwise(F.rint(scaled))
    )
    return nearest / scale

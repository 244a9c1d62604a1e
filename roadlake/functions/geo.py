"""Geohash and rounded-grid keys as plain column arithmetic."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the geohash alphabet.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _axis_cell(value: Column, low: float, span: float, bits: int) -> Column:
    """Index of the half-interval after ``bits`` bisections; a midpoint goes low."""
    cells = 1 << bits
    index = F.ceil((value - F.lit(low)) / F.lit(span) * F.lit(float(cells))).cast("bigint") - 1
    return F.least(F.greatest(index, F.lit(0)), F.lit(cells - 1)).cast("bigint")


def geohash(latitude: Column, longitude: Column, precision: int) -> Column:
    """Geohash of ``precision`` characters (1 to 12): bits alternate, longitude first."""
    total = 5 * precision
    lon_bits, lat_bits = (total + 1) // 2, total // 2
    lon = _axis_cell(longitude, -180.0, 360.0, lon_bits)
    lat = _axis_cell(latitude, -90.0, 180.0, lat_bits)

    def bit(position: int) -> Column:
        if position % 2 == 0:
            return F.shiftright(lon, lon_bits - 1 - position // 2).bitwiseAND(F.lit(1))
        return F.shiftright(lat, lat_bits - 1 - position // 2).bitwiseAND(F.lit(1))

    chars = []
    for c in range(precision):
        index = sum((bit(5 * c + i) * F.lit(1 << (4 - i)) for i in range(5)), F.lit(0))
        chars.append(F.substring(F.lit(GEOHASH_ALPHABET), (index + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def grid_decimals(step: float) -> int:
    """Digits after the point in plain notation: 1.0 -> 1, 0.01 -> 2, 5e-05 -> 5."""
    return len(f"{Decimal(repr(step)):f}".partition(".")[2])


def grid_key(latitude: Column, longitude: Column, step: float) -> Column:
    """``lat_lon`` of the nearest grid point, halves to the even neighbour."""
    shown = f"%.{grid_decimals(step)}f"

    def nearest(value: Column) -> Column:
        return F.rint(value / F.lit(step)).cast("bigint") * F.lit(step)

    return F.format_string(f"{shown}_{shown}", nearest(latitude), nearest(longitude))

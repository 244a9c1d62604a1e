"""Byte strings carried in messages: base64 text in, packed fault bytes out."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def base64_bytes(body: Column) -> Column:
    """Bytes of a base64 body, NULL when it does not decode.

    Foreign characters are skipped, and padding must be complete. A body without
    any (nearly all are) decodes as it stands and never meets the regex.
    """

    def decoded(text: Column) -> Column:
        return F.when(F.length(text) % 4 == 0, F.try_to_binary(text, F.lit("base64")))

    spaced = reduce(or_, [body.contains(c) for c in " \t\n\r\v\f"])
    clean = F.regexp_replace(body, "[^A-Za-z0-9+/=]", "")
    return F.coalesce(F.when(~spaced, decoded(body)), decoded(clean))


def base64_of(data: Column) -> Column:
    """Base64 text on one line; Spark's own breaks after 76 characters."""
    return F.translate(F.base64(data), "\r\n", "")


def utf8_text(data: Column) -> Column:
    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def unquoted(text: Column) -> Column:
    """Drop one pair of surrounding double quotes."""
    quoted = text.startswith('"') & text.endswith('"')
    inner = F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))
    return F.when(quoted, inner).otherwise(text)


def is_byte_bits(bits: Column) -> Column:
    """Binary digits whose value fits one byte."""
    return bits.rlike("^0*[01]{1,8}$")


def pack_bytes(parts: Column) -> Column:
    """One byte per bit-string of an array."""
    as_hex = F.transform(parts, lambda bits: F.lpad(F.conv(bits, 2, 16), 2, "0"))
    return F.unhex(F.array_join(as_hex, ""))


def cooldown_seconds(payload: Column) -> Column:
    """The last two bytes, big-endian, as seconds; an empty payload gives 0."""
    tail = F.substring(payload, F.lit(-2), F.lit(2))
    return F.coalesce(F.conv(F.hex(tail), 16, 10).cast("int"), F.lit(0))

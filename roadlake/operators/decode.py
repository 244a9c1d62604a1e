"""Raw messages to typed events, with a reason for every message refused.

All of it is column arithmetic on one row: no shuffle, no Python.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.functions.numbers import to_float, to_int
from roadlake.functions.once import once
from roadlake.functions.payload import base64_bytes, unquoted, utf8_text
from roadlake.functions.times import from_epoch
from roadlake.schemas import FAULT_COLUMNS, GPS_COLUMNS

# Reasons in the order in which a message meets them.
DECODE, FIELD_COUNT, NUMBER, RANGE = "decode", "field_count", "number", "range"
EARLY_REASONS = (DECODE, FIELD_COUNT, NUMBER, RANGE)
UNKNOWN_DEVICE, DUPLICATE, UNKNOWN_ROUTE = "unknown_device", "duplicate", "unknown_route"

ROUTES = ("gps", "fault")
MAX_FIELDS = 9
QUARANTINE = ["body", "routing_key", "ingest_seq", "reject_reason"]


def route(messages: DataFrame, key: str) -> DataFrame:
    return messages.where(F.col("routing_key") == key)


def unrouted(messages: DataFrame) -> DataFrame:
    known = F.coalesce(F.col("routing_key").isin(*ROUTES), F.lit(False))
    return messages.where(~known).withColumn("reject_reason", F.lit(UNKNOWN_ROUTE))


def gps_rules() -> dict[str, Column]:
    """Validation rules of a decoded fix: name to condition of a *valid* row."""
    rules = {
        "device_id": F.length("device_id") >= 1,
        "timestamp": F.col("timestamp").isNotNull(),
        "power_on": F.col("power_on").isNotNull(),
    }
    for name in ("speed", "odometer"):
        rules[name] = (F.col(name) >= 0) & ~F.isnan(name)
    for name in ("latitude", "longitude", "fuel_gauge"):
        rules[name] = F.col(name).isNotNull()
    return rules


def fault_rules() -> dict[str, Column]:
    rules = {name: F.length(name) >= 1 for name in ("device_id", "fault_bits", "fault_code")}
    rules["timestamp"] = F.col("timestamp").isNotNull()
    for name in ("sequence", "total_number"):
        rules[name] = F.col(name) >= 0
    return rules


def failed_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks; a NULL breaks its rule."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]
    return F.array_compact(F.array(*broken))


def _fields(messages: DataFrame, unquote: bool) -> DataFrame:
    """Add the message text and its fields; one more than allowed shows excess."""
    data = once(messages, data=base64_bytes(F.col("body")))
    text = once(data, text=utf8_text(F.col("data")))
    whole = unquoted(F.col("text")) if unquote else F.col("text")
    return once(text, f=F.split(whole, ":", MAX_FIELDS))


def _any_broken(rules: dict[str, Column]) -> Column:
    return ~reduce(and_, [F.coalesce(ok, F.lit(False)) for ok in rules.values()])


def _judged(typed: DataFrame, count: int, numbers: list[str], rules: dict[str, Column]) -> DataFrame:
    unreadable = F.lit(False)
    for name in numbers:
        unreadable = unreadable | F.col(name).isNull()
    reason = (
        F.when(F.col("text").isNull(), DECODE)
        .when(F.size("f") != count, FIELD_COUNT)
        .when(unreadable, NUMBER)
        .when(_any_broken(rules), RANGE)
    )
    return once(typed, reject_reason=reason)


def decode_gps(messages: DataFrame) -> DataFrame:
    """Add the fields of a fix and ``reject_reason`` (NULL for a good message)."""
    names = ["epoch", "speed", "odometer", "latitude", "longitude", "fuel_gauge"]
    places = [1, 2, 3, 5, 6, 7]
    texts = F.array(*[F.get("f", F.lit(at)) for at in places])
    # One lambda for all numbers: six copies of it make a method too long to compile.
    parsed = once(_fields(messages, unquote=True), n=F.transform(texts, to_float))
    timed = once(
        parsed,
        device_id=F.get("f", F.lit(0)),
        timestamp=from_epoch(F.get("n", F.lit(0))),
        power_on=F.lower(F.get("f", F.lit(4))) == "true",
        **{name: F.get("n", F.lit(i)) for i, name in enumerate(names) if i},
    )
    judged = _judged(timed, 8, ["timestamp", *names[1:]], gps_rules())
    keep = [c for c in messages.columns if c != "ingest_seq"]
    return judged.select(*keep, *GPS_COLUMNS, "reject_reason")


def decode_faults(messages: DataFrame) -> DataFrame:
    """Add the fields of a fault part and ``reject_reason``."""
    typed = once(
        _fields(messages, unquote=False),
        device_id=F.get("f", F.lit(0)),
        epoch=to_float(F.get("f", F.lit(1))),
        fault_bits=F.get("f", F.lit(2)),
        fault_code=F.get("f", F.lit(3)),
        sequence=to_int(F.get("f", F.lit(4))),
        total_number=to_int(F.get("f", F.lit(5))),
    )
    timed = once(typed, timestamp=from_epoch(F.col("epoch")))
    judged = _judged(timed, 6, ["timestamp", "sequence", "total_number"], fault_rules())
    keep = [c for c in messages.columns if c != "ingest_seq"]
    return judged.select(*keep, *FAULT_COLUMNS, "reject_reason")


def good(decoded: DataFrame, columns: list[str]) -> DataFrame:
    return decoded.where(F.col("reject_reason").isNull()).select(*columns)


def refused(decoded: DataFrame) -> DataFrame:
    """Quarantine rows: the message as it came, and why it was refused."""
    return decoded.where(F.col("reject_reason").isNotNull()).select(*QUARANTINE)

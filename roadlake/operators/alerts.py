"""Alert envelopes, rules and notifications.

Rules compile to column predicates. On typed envelopes they reduce to plain
comparisons (``speed >= 70.0``) that reach the scan; texts are only built for
events that match. On envelopes parsed from JSON the data is a VARIANT and the
same rules look at the type each value arrived with.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlake.functions.numbers import float_text, to_float
from roadlake.functions.once import once
from roadlake.functions.payload import base64_of
from roadlake.functions.times import iso_text

#: A value of an event: its text or number, the number a lower bound sees, and what is shown.
VALUE = "struct<key: string, is_text: boolean, text: string, plain: double, number: double, shown: string>"
ENVELOPE = ["event_type", "device_id", "device_name", "timestamp"]


@dataclass(frozen=True)
class AlertRule:
    """Numbers are lower bounds, lists are memberships, anything else must be equal."""

    email: str
    event_types: tuple[str, ...]
    thresholds: dict[str, Any]


# The built-in rules.
RULES = (
    AlertRule("example@gmail.com", ("fault",), {"fault_code": [str(i) for i in range(1, 101)]}),
    AlertRule("example@gmail.com", ("gps",), {"speed": 70.0}),
)


def gps_envelopes(events: DataFrame) -> DataFrame:
    """Named fixes as typed envelopes."""
    data = [
        "device_id",
        iso_text(F.col("timestamp")).alias("timestamp"),
        *["speed", "odometer", "power_on", "latitude", "longitude", "fuel_gauge", "device_name"],
    ]
    return _envelopes(events, "gps", data)


def fault_envelopes(faults: DataFrame) -> DataFrame:
    """Named, labelled faults as typed envelopes; the payload travels as base64."""
    data = [
        "device_id",
        "device_name",
        iso_text(F.col("timestamp")).alias("timestamp"),
        base64_of(F.col("payload_bytes")).alias("fault_payload"),
        "fault_code",
        "fault_label",
    ]
    return _envelopes(faults, "fault", data)


def _envelopes(df: DataFrame, event_type: str, data: list) -> DataFrame:
    return df.select(
        F.lit(event_type).alias("event_type"),
        "device_id",
        "device_name",
        iso_text(F.col("timestamp")).alias("timestamp"),
        F.struct(*data).alias("data"),
    )


def to_messages(envelopes: DataFrame) -> DataFrame:
    """The JSON text of each envelope."""
    return envelopes.select(F.to_json(F.struct(*ENVELOPE, "data")).alias("message"))


def fan_in(gps: DataFrame, faults: DataFrame) -> DataFrame:
    """Both feeds in one envelope shape, with the data as JSON text."""

    def shaped(envelopes: DataFrame) -> DataFrame:
        return envelopes.select(*ENVELOPE, F.to_json("data").alias("data"))

    return shaped(gps_envelopes(gps)).unionByName(shaped(fault_envelopes(faults)))


def parse_messages(messages: DataFrame) -> DataFrame:
    """Envelopes from JSON text; ``error`` says why a message is not one."""
    parsed = once(messages, v=F.try_parse_json("message"))

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("v", path, "variant"))

    wrong = [F.when(~kind(f"$.{c}").eqNullSafe("STRING"), c) for c in ENVELOPE]
    is_map = F.coalesce(kind("$.data").startswith("OBJECT"), F.lit(False))
    fields = F.array_compact(F.array(*wrong, F.when(~is_map, "data")))
    error = F.when(F.col("v").isNull(), "not json").when(
        F.size(fields) > 0, F.concat(F.lit("bad field: "), F.array_join(fields, ", "))
    )
    judged = once(parsed, error=error)
    good = F.col("error").isNull()
    return judged.select(
        "message",
        "error",
        *[F.when(good, F.try_variant_get("v", f"$.{c}", "string")).alias(c) for c in ENVELOPE],
        F.when(good, F.try_variant_get("v", "$.data", "variant")).alias("data"),
    )


class _Typed:
    """Values of a data struct, whose types are known when the plan is built."""

    def __init__(self, data: T.StructType) -> None:
        self.types = {f.name: f.dataType for f in data.fields}

    def number(self, key: str) -> Column:
        if key not in self.types:
            return F.lit(None).cast("double")
        value = F.col(f"data.`{key}`")
        return to_float(value) if self._is_text(key) else value.cast("double")

    def is_one_of(self, key: str, options: list) -> Column:
        if key not in self.types:
            return F.lit(False)
        wanted = [o for o in options if isinstance(o, str) == self._is_text(key)]
        return F.col(f"data.`{key}`").isin(wanted) if wanted else F.lit(False)

    def text(self, key: str) -> Column:
        if key not in self.types:
            return F.lit(None).cast("string")
        value = F.col(f"data.`{key}`")
        if isinstance(self.types[key], T.DoubleType):
            return float_text(value)
        if isinstance(self.types[key], T.BooleanType):
            return F.when(value, "True").otherwise("False")
        return value.cast("string")

    def option(self, key: str) -> tuple[Column, Column]:
        """The text or the number that options are held against; the other is null."""
        none = F.lit(None)
        own = F.col(f"data.`{key}`") if key in self.types else none
        text, plain = (own, none) if key in self.types and self._is_text(key) else (none, own)
        return text.cast("string"), plain.cast("double")

    def value(self, key: str) -> Column:
        """What a rule of a table (``rule_table``) asks of a key; null where it is missing."""
        if key not in self.types:
            return F.lit(None).cast(VALUE)
        text, plain = self.option(key)
        return F.when(
            F.col(f"data.`{key}`").isNotNull(),
            F.struct(
                F.lit(key).alias("key"),
                F.lit(self._is_text(key)).alias("is_text"),
                text.alias("text"),
                plain.alias("plain"),
                self.number(key).alias("number"),
                self.text(key).alias("shown"),
            ),
        )

    def _is_text(self, key: str) -> bool:
        return isinstance(self.types[key], T.StringType)


class _Variant:
    """Values of a parsed data map, whose types differ by row."""

    def _value(self, key: str) -> Column:
        return F.try_variant_get("data", f"$['{key}']", "variant")

    def _kind(self, key: str) -> Column:
        return F.schema_of_variant(self._value(key))

    def number(self, key: str) -> Column:
        text = to_float(F.try_variant_get("data", f"$['{key}']", "string"))
        plain = F.try_variant_get("data", f"$['{key}']", "double")
        return F.when(self._kind(key) == "STRING", text).otherwise(plain)

    def is_one_of(self, key: str, options: list) -> Column:
        texts = [o for o in options if isinstance(o, str)]
        numbers = [float(o) for o in options if isinstance(o, (int, float))]
        is_text = self._kind(key) == "STRING"
        found = F.lit(False)
        if texts:
            found = found | (is_text & F.try_variant_get("data", f"$['{key}']", "string").isin(texts))
        if numbers:
            value = F.try_variant_get("data", f"$['{key}']", "double")
            found = found | (~is_text & value.isin(numbers))
        return found

    def option(self, key: str) -> tuple[Column, Column]:
        own = F.try_variant_get("data", f"$['{key}']", "string")
        is_text = self._kind(key) == "STRING"
        plain = F.try_variant_get("data", f"$['{key}']", "double")
        return F.when(is_text, own), F.when(~is_text, plain)

    def value(self, key: str) -> Column:
        text, plain = self.option(key)
        return F.when(
            self._value(key).isNotNull() & (self._kind(key) != "VOID"),
            F.struct(
                F.lit(key).alias("key"),
                (self._kind(key) == "STRING").alias("is_text"),
                text.alias("text"),
                plain.alias("plain"),
                self.number(key).alias("number"),
                self.text(key).alias("shown"),
            ),
        )

    def text(self, key: str) -> Column:
        kind = self._kind(key)
        plain = F.try_variant_get("data", f"$['{key}']", "string")
        shown = F.when(kind == "BOOLEAN", F.initcap(plain)).when(kind == "VOID", "None")
        fraction = kind.startswith("DECIMAL") | (kind == "DOUBLE")
        return shown.when(
            fraction, float_text(F.try_variant_get("data", f"$['{key}']", "double"))
        ).otherwise(plain)


def reader(envelopes: DataFrame) -> _Typed | _Variant:
    data = envelopes.schema["data"].dataType
    return _Typed(data) if isinstance(data, T.StructType) else _Variant()


def _matches(rule: AlertRule, data: _Typed | _Variant) -> Column:
    tests = [F.col("event_type").isin(list(rule.event_types))]
    for key, threshold in rule.thresholds.items():
        if isinstance(threshold, (int, float)):
            # NaN passes: it is not below the bound, and Spark sorts it above all numbers.
            tests.append(data.number(key) >= float(threshold))
        elif isinstance(threshold, list):
            tests.append(data.is_one_of(key, threshold))
        else:
            tests.append(data.is_one_of(key, [threshold]))
    return reduce(and_, tests)


def _subject(rule: AlertRule, data: _Typed | _Variant) -> Column:
    """The wording of a subject line."""
    parts = [
        F.concat(F.lit(f"{key}="), data.text(key), F.lit(f" (threshold={threshold})"))
        for key, threshold in rule.thresholds.items()
    ]
    detail = F.array_join(F.array_compact(F.array(*parts)), ", ") if parts else F.lit("")
    shown = F.when(detail == "", "no matching thresholds").otherwise(detail)
    return F.concat(F.lit("Alert: "), F.col("event_type"), F.lit(" ["), shown, F.lit("]"))


def match_any(envelopes: DataFrame, rules: tuple[AlertRule, ...] = RULES) -> DataFrame:
    """Envelopes that at least one rule matches; a test on a missing value is NULL, which fails."""
    data = reader(envelopes)
    return envelopes.where(reduce(or_, [_matches(r, data) for r in rules], F.lit(False)))


def notifications(envelopes: DataFrame, rules: tuple[AlertRule, ...] = RULES) -> DataFrame:
    """One row (``to``, ``subject``, ``body``) per event and matching rule."""
    data = reader(envelopes)
    letters = [
        F.when(_matches(rule, data), F.struct(F.lit(rule.email).alias("to"), _subject(rule, data).alias("subject")))
        for rule in rules
    ]
    return (
        match_any(envelopes, rules)
        .withColumn("letter", F.explode(F.array_compact(F.array(*letters))))
        .select("letter.to", "letter.subject", F.to_json(F.struct(*ENVELOPE, "data")).alias("body"))
    )

"""Duplicates, device names and fault labels.

Dimension joins carry no hint: Spark broadcasts the dimension when its size is
under ``autoBroadcastJoinThreshold``; past that it shuffles, and adaptive
execution splits the partitions of hot devices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.operators.decode import DUPLICATE, UNKNOWN_DEVICE

EVENT_KEY = ["device_id", "timestamp"]
UNKNOWN_LABEL = "unknown_label"


def dedup(events: DataFrame, keys: list[str] = EVENT_KEY, seq: str = "ingest_seq") -> DataFrame:
    """The first arrival of every key.

    An aggregate rather than a ranking: copies are folded before the shuffle, so
    even a key with a third of all rows sends one row per map task.
    """
    rest = [c for c in events.columns if c not in keys]
    return (
        events.groupBy(*keys)
        .agg(*[F.min_by(c, seq).alias(c) for c in rest])
        .select(*events.columns)
    )


def duplicates(events: DataFrame, keys: list[str] = EVENT_KEY, seq: str = "ingest_seq") -> DataFrame:
    """The later arrivals, to be refused. ``seq`` is unique per message."""
    kept = events.groupBy(*keys).agg(F.min(seq).alias(seq))
    return events.join(kept, [*keys, seq], "left_anti").withColumn("reject_reason", F.lit(DUPLICATE))


def known_devices(devices: DataFrame) -> DataFrame:
    return devices.where(F.length("device_name") > 0)


def enrich_device(events: DataFrame, devices: DataFrame) -> DataFrame:
    """Add ``device_name``; events of unknown or nameless devices drop out."""
    return events.join(known_devices(devices), "device_id")


def of_known_devices(events: DataFrame, devices: DataFrame) -> DataFrame:
    return events.join(known_devices(devices), "device_id", "left_semi")


def unknown_devices(events: DataFrame, devices: DataFrame) -> DataFrame:
    return events.join(known_devices(devices), "device_id", "left_anti").withColumn(
        "reject_reason", F.lit(UNKNOWN_DEVICE)
    )


def enrich_label(faults: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``fault_label``: "Unknown" where a code has none; unlisted codes drop out."""
    listed = labels.select("fault_code", F.coalesce("label", F.lit("Unknown")).alias("fault_label"))
    return faults.join(listed, "fault_code")


def unlabelled(faults: DataFrame, labels: DataFrame) -> DataFrame:
    return faults.join(labels, "fault_code", "left_anti").withColumn(
        "reject_reason", F.lit(UNKNOWN_LABEL)
    )


def _text_member(body: Column, path: str) -> Column:
    """A string member of a JSON text; NULL for a member of another type."""
    member = F.try_variant_get(F.try_parse_json(body), path, "variant")
    is_text = F.schema_of_variant(member) == "STRING"
    return F.when(is_text, F.variant_get(member, "$", "string"))


def labels_from_responses(responses: DataFrame) -> DataFrame:
    """Label dimension from lookup answers (``fault_code``, ``status``, ``body``).

    An object, or the first of a list, may name a text label; anything else that
    was answered gives a NULL label, and failed lookups give no row.
    """
    shape = F.substring(F.ltrim("body"), 1, 1)
    label = F.when(shape == "{", _text_member(F.col("body"), "$.label")).when(
        shape == "[", _text_member(F.col("body"), "$[0].label")
    )
    return responses.where(F.col("status") == 200).select("fault_code", label.alias("label"))


def devices_from_responses(responses: DataFrame) -> DataFrame:
    """Device dimension from lookup answers (``device_id``, ``status``, ``body``)."""
    name = F.try_variant_get(F.try_parse_json("body"), "$.name", "string")
    return responses.where(F.col("status") == 200).select(
        "device_id", F.coalesce(name, F.lit("")).alias("device_name")
    )


def device_exists(events: DataFrame, device_ids: DataFrame) -> DataFrame:
    """Those of ``device_ids`` that have at least one event.

    The larger side is cut to its distinct ids map-side before the join.
    """
    return device_ids.join(events.select("device_id").distinct(), "device_id", "left_semi")

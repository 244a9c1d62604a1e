"""From raw fault messages to stored faults and their alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlake.operators import alerts, clean, decode, faults, suppression
from roadlake.schemas import FAULT_COLUMNS
from roadlake.session import pin
from roadlake.sources import stores


# Reasons why the parts of a fault made no event.
ASSEMBLY = "assembly"


@dataclass(frozen=True)
class FaultOutputs:
    faults: DataFrame
    status: DataFrame
    quarantine: DataFrame
    rejected: DataFrame
    notifications: DataFrame


def judged_messages(messages: DataFrame, devices: DataFrame) -> DataFrame:
    """Decoded fault messages; those of unknown devices are refused as well."""
    decoded = decode.decode_faults(decode.route(messages, "fault"))
    known = clean.known_devices(devices).select("device_id", F.lit(True).alias("known"))
    nameless = F.when(F.col("known").isNull(), decode.UNKNOWN_DEVICE)
    return (
        decoded.join(known, "device_id", "left")
        .withColumn("reject_reason", F.coalesce("reject_reason", nameless))
        .drop("known")
    )


def quarantine_faults(messages: DataFrame, devices: DataFrame) -> DataFrame:
    """Every fault message that is no part of a fault, as it came, with the reason."""
    return decode.refused(judged_messages(messages, devices))


def rejected_faults(status: DataFrame, labels: DataFrame, devices: DataFrame) -> DataFrame:
    """Faults that were not stored: of unknown devices, not to be put together, or of an unlisted code."""
    known = clean.known_devices(devices).select("device_id", F.lit(True).alias("known"))
    listed = labels.select("fault_code", F.lit(True).alias("listed"))
    reason = (
        F.when(F.col("known").isNull(), decode.UNKNOWN_DEVICE)
        .when(F.col("status") == faults.ERROR, ASSEMBLY)
        .when(F.col("listed").isNull(), clean.UNKNOWN_LABEL)
    )
    ended = status.where(F.col("status") != faults.PENDING)
    named = ended.join(known, "device_id", "left").join(listed, "fault_code", "left")
    judged = named.withColumn("reject_reason", reason)
    return judged.where(F.col("reject_reason").isNotNull()).select(
        *faults.FAULT_KEY, "received", "total", "reject_reason"
    )


def reject_counts(quarantine: DataFrame, rejected: DataFrame) -> DataFrame:
    """Messages, and faults put together from them, per reason."""
    early = quarantine.groupBy("reject_reason").agg(F.count("*").alias("refused"))
    late = rejected.groupBy("reject_reason").agg(F.count("*").alias("refused"))
    return early.unionByName(late)


def known_segments(messages: DataFrame, devices: DataFrame) -> DataFrame:
    """Decoded parts of named devices; the name itself joins the finished fault."""
    decoded = decode.decode_faults(decode.route(messages, "fault"))
    return clean.of_known_devices(decode.good(decoded, FAULT_COLUMNS), devices)


def labelled_faults(complete: DataFrame, devices: DataFrame, labels: DataFrame) -> DataFrame:
    named = clean.enrich_device(complete, devices)
    return clean.enrich_label(named, labels).select(
        "device_id", "device_name", "timestamp", "fault_payload", "fault_code", "fault_label",
        "payload_bytes", "ended_seq",
    )


def fault_alerts(stored: DataFrame, **options: object) -> DataFrame:
    """Notifications: cool-down first, rules second."""
    return alerts.notifications(alerts.fault_envelopes(suppression.unsuppressed(stored, **options)))


def fault_path(
    messages: DataFrame, devices: DataFrame, labels: DataFrame, faults_path: str | None = None
) -> FaultOutputs:
    status = pin(faults.fault_status(known_segments(messages, devices)), "fault-status")
    complete = status.where(F.col("status") == faults.COMPLETE)
    stored = labelled_faults(complete, devices, labels)
    if faults_path is None:
        stored = pin(stored, "fault-events")
    else:
        stores.append_faults(stored, faults_path)
        stored = stores.read_days(faults_path, stored)
    return FaultOutputs(
        faults=stored,
        status=status,
        quarantine=quarantine_faults(messages, devices),
        rejected=rejected_faults(status, labels, devices),
        notifications=fault_alerts(stored),
    )

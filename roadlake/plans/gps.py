"""From raw GPS messages to events, quarantine, summaries, episodes and alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from roadlake.operators import alerts, clean, decode, idling, summary
from roadlake.schemas import GPS_COLUMNS
from roadlake.session import pin
from roadlake.sources import stores


def gps_decoded(messages: DataFrame) -> DataFrame:
    return decode.decode_gps(decode.route(messages, "gps"))


def stored_decoded(messages: DataFrame) -> DataFrame:
    """The decoded feed, written once for the several readers of it."""
    kept = [*GPS_COLUMNS, "routing_key", "body", "reject_reason"]
    return pin(gps_decoded(messages).select(*kept), "gps-decoded")


def clean_gps(decoded: DataFrame, devices: DataFrame) -> DataFrame:
    """Good messages, first arrivals only, with the device name."""
    return clean.enrich_device(clean.dedup(decode.good(decoded, GPS_COLUMNS)), devices)


def quarantine_gps(decoded: DataFrame, devices: DataFrame) -> DataFrame:
    """Every GPS message that made no event, as it came, with the reason.

    Read several times, so ``decoded`` should be a stored table.
    """
    passed = decode.good(decoded, [*clean.EVENT_KEY, "ingest_seq", "routing_key", "body"])
    nameless = clean.dedup(clean.unknown_devices(passed, devices))
    found = decode.refused(decoded)
    for later in (clean.duplicates(passed), nameless):
        found = found.unionByName(later.select(*decode.QUARANTINE))
    return found


def reject_counts(decoded: DataFrame, devices: DataFrame) -> DataFrame:
    """Messages per reason.

    Duplicates and unknown devices come from one count per event key, so copies
    fold map-side and no message is joined.
    """
    keyed = decode.good(decoded, GPS_COLUMNS).groupBy(*clean.EVENT_KEY).agg(F.count("*").alias("n"))
    known = clean.known_devices(devices).select("device_id", F.lit(True).alias("known"))
    counted = keyed.join(known, "device_id", "left").agg(
        F.sum(F.col("n") - 1).alias(decode.DUPLICATE),
        F.count_if(F.col("known").isNull()).alias(decode.UNKNOWN_DEVICE),
    )
    late = counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(r).alias("reject_reason"), F.coalesce(r, F.lit(0)).alias("messages"))
                    for r in (decode.DUPLICATE, decode.UNKNOWN_DEVICE)
                ]
            )
        )
    )
    early = decode.refused(decoded).groupBy("reject_reason").agg(F.count("*").alias("messages"))
    return early.unionByName(late.where(F.col("messages") > 0))


def observed(decoded: DataFrame, name: str | Observation) -> DataFrame:
    """``decoded`` with the number of messages per reason, counted as they pass.

    With a name, each batch of a stream reports them in its progress.
    """
    reason = F.col("reject_reason")
    kinds = [F.count_if(reason == r).alias(r) for r in decode.EARLY_REASONS]
    return decoded.observe(name, F.count_if(reason.isNull()).alias("good"), *kinds)


def store_events(
    messages: DataFrame, devices: DataFrame, path: str, write: str | None = None
) -> dict[str, int]:
    """Decode, clean and store the events in one pass; returns the refused messages per reason.

    What is lost from step to step is counted as it passes. Work that is done again after an
    executor was lost may count twice; ``reject_counts`` does not.
    """
    seen, unique, named = Observation(), Observation(), Observation()
    events = clean.dedup(decode.good(observed(gps_decoded(messages), seen), GPS_COLUMNS))
    events = events.observe(unique, F.count("*").alias("n"))
    events = clean.enrich_device(events, devices).observe(named, F.count("*").alias("n"))
    stores.append_gps_events(events, path, write)
    counts = seen.get
    counts[decode.DUPLICATE] = counts.pop("good") - unique.get["n"]
    counts[decode.UNKNOWN_DEVICE] = unique.get["n"] - named.get["n"]
    return {reason: n for reason, n in counts.items() if n}


@dataclass(frozen=True)
class GpsOutputs:
    events: DataFrame
    quarantine: DataFrame
    summaries: DataFrame
    episodes: DataFrame
    notifications: DataFrame


def gps_path(messages: DataFrame, devices: DataFrame, events_path: str | None = None) -> GpsOutputs:
    """The whole GPS path.

    Decoding and cleaning run once: the events are stored (at ``events_path``, or
    in the shared folder) and everything after reads the stored columns it needs.
    """
    decoded = stored_decoded(messages)
    events = clean_gps(decoded, devices)
    if events_path is None:
        events = pin(events, "gps-events")
    else:
        stores.append_gps_events(events, events_path)
        events = stores.read_days(events_path, events)
    return GpsOutputs(
        events=events,
        quarantine=quarantine_gps(decoded, devices),
        summaries=summary.daily_summary(events),
        episodes=idling.idling_episodes(events),
        notifications=alerts.notifications(alerts.gps_envelopes(events)),
    )

"""Multi-part faults: collect, count, put together, pack.

Parts are judged as they arrive: a part with a number already held replaces the one before,
and as soon as as many are held as the arrival announces, the fault is put together, or
spoiled, and its parts are forgotten. Parts sent again afterwards begin anew, so one fault
may end several times. That is a fold in order of arrival. Tasks read the parts of a fault in
that order and hold those of one fault at a time, at most as many as it announces, however
often they are sent; the parts are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlake.functions.once import once
from roadlake.functions.payload import is_byte_bits, pack_bytes
from roadlake.functions.times import micros

FAULT_KEY = ["device_id", "fault_code", "timestamp"]
#: Of a fault in the folds, with its time in microseconds.
FOLD_KEY = ["device_id", "fault_code", "fault_us"]
# Fixed value: characters of the payload column. Each part has at least one, so a
# complete fault has at most as many parts.
MAX_PAYLOAD = 100
PENDING, COMPLETE, ERROR = "pending", "complete", "error"
FOLDED = "ended_seq long, received long, ignored long, total int, bits array<string>"


class Arrivals:
    """The parts of one fault that are held."""

    def __init__(self, max_payload: int = MAX_PAYLOAD, bits: dict[int, str] | None = None) -> None:
        self.max_payload = max_payload
        self.bits: dict[int, str | None] = bits or {}

    def add(self, sequence: int, bits: str, total: int, arrival: int) -> tuple:
        """What ``FOLDED`` says after this arrival; without ``bits`` while parts are missing."""
        # A part past the payload counts, but no payload can hold it.
        self.bits[sequence] = bits if sequence < self.max_payload else None
        received = len(self.bits)
        ignored = sum(s >= self.max_payload for s in self.bits) if received >= total else 0
        used = None
        if received >= total:
            used = [self.bits[s] for s in sorted(self.bits) if s < total and s < self.max_payload]
            self.bits = {}
        return arrival, received, ignored, total, used

    def pending(self, last: tuple) -> tuple:
        """``last`` as the fault stands in the end."""
        return (*last[:2], sum(s >= self.max_payload for s in self.bits), *last[3:])


def _fold(max_payload: int, schema: pa.Schema):
    names = [*FOLD_KEY, "sequence", "fault_bits", "total_number", "ingest_seq"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, last = None, Arrivals(max_payload), None

        def rest() -> list[tuple]:
            return [(*now, *held.pending(last))] if held.bits else []

        def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                columns = zip(*found, strict=True)
                arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in names]
            for *key, sequence, bits, total, arrival in zip(*columns, strict=True):
                if key != now:
                    found += rest()
                    now, held = key, Arrivals(max_payload)
                last = held.add(sequence, bits, total, arrival)
                if last[-1] is not None:
                    found.append((*key, *last))
            yield from rows(found)
        yield from rows(rest())

    return fold


def judged(folded: DataFrame, max_payload: int = MAX_PAYLOAD) -> DataFrame:
    """Rows of ``FOLD_KEY`` and ``FOLDED`` with their status, and the payload when complete."""
    joined = once(folded, joined=F.array_join("bits", ""))
    whole = (
        (F.size("bits") == F.col("total"))
        & F.forall("bits", is_byte_bits)
        & (F.length("joined") <= max_payload)
    )
    status = F.when(F.col("bits").isNull(), PENDING).when(whole, COMPLETE).otherwise(ERROR)
    done = F.col("status") == COMPLETE
    return once(joined, status=status).select(
        "device_id",
        "fault_code",
        F.timestamp_micros("fault_us").alias("timestamp"),
        "ended_seq",
        "received",
        "ignored",
        "total",
        "status",
        F.when(done, F.col("joined")).alias("fault_payload"),
        F.when(done, pack_bytes(F.col("bits"))).alias("payload_bytes"),
    )


def with_fold_key(segments: DataFrame) -> DataFrame:
    return segments.select(
        "device_id",
        "fault_code",
        micros(F.col("timestamp")).alias("fault_us"),
        "sequence",
        "fault_bits",
        "total_number",
        "ingest_seq",
    )


def fault_status(segments: DataFrame, max_payload: int = MAX_PAYLOAD) -> DataFrame:
    """One row per time a fault ended, and one for each that has parts left over.

    ``ended_seq`` is the arrival that decided. ``received`` counts parts of any number,
    ``ignored`` those of them that no payload can hold.
    """
    parts = with_fold_key(segments)
    key = [f for f in parts.schema.fields if f.name in FOLD_KEY]
    schema = T.StructType([*key, *T.StructType.fromDDL(FOLDED).fields])
    arrow = pa.schema(
        [
            *((c, pa.string()) for c in FOLD_KEY[:2]),
            ("fault_us", pa.int64()),
            *((c, pa.int64()) for c in ("ended_seq", "received", "ignored")),
            ("total", pa.int32()),
            ("bits", pa.list_(pa.string())),
        ]
    )
    ordered = parts.repartition(*FOLD_KEY).sortWithinPartitions(
        *FOLD_KEY, "ingest_seq", "sequence", "fault_bits"
    )
    return judged(ordered.mapInArrow(_fold(max_payload, arrow), schema), max_payload)


def fault_events(segments: DataFrame) -> DataFrame:
    """Complete faults with their bit-string and packed bytes."""
    return (
        fault_status(segments)
        .where(F.col("status") == COMPLETE)
        .select(*FAULT_KEY, "ended_seq", "fault_payload", "payload_bytes")
    )

import datetime as dt
import random

import pytest

from roadlake.operators import faults
from roadlake.schemas import FAULT_SEGMENT
from tests.helpers import at


def status(spark, parts):
    rows = [("d", at(0), bits, "7", seq, total, i) for i, (seq, bits, total) in enumerate(parts)]
    (row,) = faults.fault_status(spark.createDataFrame(rows, FAULT_SEGMENT)).collect()
    return row


@pytest.mark.parametrize(
    "parts, state, received, payload, packed",
    [
        ([(1, "10101010", 2), (0, "01010101", 2)], "complete", 2, "0101010110101010", b"\x55\xaa"),
        ([(1, "10101010", 3)], "pending", 1, None, None),
        ([(0, "1", 2), (5, "1", 2)], "error", 2, None, None),
        ([(0, "1", 2), (0, "0", 2)], "pending", 1, None, None),
        ([(0, "1", 2), (0, "11", 2), (1, "1", 2)], "complete", 2, "111", b"\x03\x01"),
        ([(0, "1", 3), (1, "1", 3), (1, "1", 2)], "complete", 2, "11", b"\x01\x01"),
        ([(3, "1", 0)], "complete", 1, "", b""),
        ([(0, "100000000", 1)], "error", 1, None, None),
        ([(0, "0000000011111111", 1)], "complete", 1, "0000000011111111", b"\xff"),
        ([(0, "12", 1)], "error", 1, None, None),
        ([(0, "0" * 101, 1)], "error", 1, None, None),
        ([(i, "00000001", 13) for i in range(13)], "error", 13, None, None),
        ([(i, "1", 101) for i in range(101)], "error", 101, None, None),
        ([(i, "1", 100) for i in range(100)], "complete", 100, "1" * 100, b"\x01" * 100),
    ],
)
def test_status(spark, parts, state, received, payload, packed):
    row = status(spark, parts)
    assert (row.status, row.received, row.fault_payload) == (state, received, payload)
    assert (None if row.payload_bytes is None else bytes(row.payload_bytes)) == packed


def test_key_includes_time_and_code(spark):
    rows = [
        ("d", at(0), "1", "7", 0, 1, 1),
        ("d", at(1), "1", "7", 0, 1, 2),
        ("d", at(0), "1", "8", 0, 1, 3),
        ("e", at(0), "1", "7", 0, 1, 4),
    ]
    found = faults.fault_events(spark.createDataFrame(rows, FAULT_SEGMENT)).collect()
    assert len(found) == 4 and all(isinstance(r.timestamp, dt.datetime) for r in found)


def test_parts_past_the_payload_are_counted(spark):
    row = status(spark, [(100, "1", 4), (250, "1", 4), (0, "1", 4)])
    assert (row.status, row.received, row.ignored) == ("pending", 3, 2)
    row = status(spark, [(100, "1", 3), (250, "1", 3), (0, "1", 3)])
    assert (row.status, row.received, row.ignored) == ("error", 3, 2)
    rows = [("d", at(0), "1", "7", i, 3, i) for i in range(3)]
    (row,) = faults.fault_status(spark.createDataFrame(rows, FAULT_SEGMENT), max_payload=2).collect()
    assert (row.status, row.ignored) == ("error", 1)


def plain_fold(rows):
    """Arrival by arrival: (key, arrival, received, total, status, payload)."""
    held, last, out = {}, {}, []
    for device, time, bits, code, sequence, total, arrival in sorted(rows, key=lambda r: r[-1]):
        key = (device, code, time)
        parts = held.setdefault(key, {})
        parts[sequence] = bits
        last[key] = (arrival, len(parts), total)
        if len(parts) >= total:
            payload = None
            if all(k in parts for k in range(total)):
                payload = "".join(parts[k] for k in range(total))
            out.append((*key, *last[key], "error" if payload is None else "complete", payload))
            del held[key]
    out += [(*key, *last[key], "pending", None) for key in held]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, faults_seen, parts", [(1, 40, 600), (2, 1, 3000), (3, 900, 1000)])
def test_parts_sent_again_begin_anew(spark, seed, faults_seen, parts):
    rng = random.Random(seed)
    rows = []
    for arrival in range(parts):
        fault = rng.randrange(faults_seen)
        total = 1 + fault % 4 if rng.random() < 0.9 else rng.randrange(1, 5)
        bits = format(rng.randrange(256), "08b")
        rows.append((f"d{fault % 3}", at(fault // 6), bits, str(fault % 2), rng.randrange(5), total, arrival))
    rng.shuffle(rows)
    found = faults.fault_status(spark.createDataFrame(rows, FAULT_SEGMENT).repartition(4)).collect()
    columns = ("device_id", "fault_code", "timestamp", "ended_seq", "received", "total", "status", "fault_payload")
    assert sorted((tuple(r[c] for c in columns) for r in found), key=str) == plain_fold(rows)


def test_the_parts_are_shuffled_once(spark):
    segments = spark.createDataFrame([("d", at(0), "1", "7", 0, 1, 1)], FAULT_SEGMENT)
    plan = faults.fault_events(segments)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1

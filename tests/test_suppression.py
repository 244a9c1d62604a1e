import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlake.operators import suppression
from tests.helpers import at, fold_cooldown

SHAPE = "device_id string, fault_code string, timestamp timestamp, payload_bytes binary"


def frame_of(spark, rows):
    data = [(dev, code, time, bytearray(b"xyz" + secs.to_bytes(2, "big"))) for code, dev, time, secs in rows]
    return spark.createDataFrame(data, SHAPE)


def suppressed(frame, **options):
    return {
        (r.fault_code, r.device_id, r.timestamp)
        for r in suppression.mark_suppressed(frame, **options).collect()
        if r.suppressed
    }


def test_window_from_the_payload(spark):
    rows = [("1", "a", at(0), 5), ("1", "b", at(4), 60), ("1", "a", at(5), 0), ("1", "c", at(5), 9), ("2", "a", at(1), 0)]
    assert suppressed(frame_of(spark, rows)) == {("1", "b", at(4))}


def test_short_payloads(spark):
    data = [("a", "1", at(0), bytearray(b"")), ("b", "1", at(1), bytearray(b"\x05")), ("c", "1", at(3), bytearray(b"\x05"))]
    assert suppressed(spark.createDataFrame(data, SHAPE)) == {("1", "c", at(3))}


@pytest.mark.parametrize(
    "seed, longest, step, size",
    [(1, 50, 9, 10**6), (2, 50, 9, 100), (3, 60_000, 9, 100), (4, 400, 1, 7), (5, 0, 5, 60), (6, 3000, 2, 20)],
)
def test_fold(spark, seed, longest, step, size):
    rng = random.Random(seed)
    rows = {}
    for code, count in (("hot", 1500), ("warm", 300), ("cold", 20)):
        second = 0
        for _ in range(count):
            second += rng.randrange(step + 1)
            key = (code, f"dev{rng.randrange(5)}", at(second))
            rows[key] = (*key, rng.choice([0, rng.randrange(longest + 1)]))
    frame = frame_of(spark, list(rows.values()))
    assert suppressed(frame, span_seconds=size) == fold_cooldown(rows.values())


def test_a_regular_train_takes_as_many_jobs_for_any_number_of_slices(spark):
    jobs = []
    for seconds in (64, 2_000):
        rows = [("1", "a", at(k), 7) for k in range(seconds)]
        group = f"train-{seconds}"
        spark.sparkContext.setJobGroup(group, "train")
        assert suppressed(frame_of(spark, rows), span_seconds=32) == fold_cooldown(rows)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_steps_lead_where_a_walk_does():
    rng = np.random.default_rng(5)
    for _ in range(100):
        sizes = rng.integers(1, 12, 4)
        new = np.concatenate([np.arange(n) == 0 for n in sizes])
        parts = [np.sort(rng.integers(0, 60, n)) + 60 * k for k, n in enumerate(sizes)]
        us = np.concatenate(parts).astype(np.int64) * 10**6
        cooldown = rng.integers(0, 9, len(us)).astype(np.int32)
        cooldown[0] = 60_000
        slices = suppression.Slices(new, us, cooldown)
        of, times, until = slices.steps()
        for entry in range(-1, 250, 3):
            marks = slices.suppressed(np.full(4, entry * 10**6))
            for part in range(4):
                left, rows = entry * 10**6, np.flatnonzero(slices.number == part)
                for row in rows:
                    assert marks[row] == (us[row] < left)
                    if us[row] >= left and cooldown[row]:
                        left = int(us[row]) + int(cooldown[row]) * 10**6
                own, leave = times[of == part], until[of == part]
                step = int(np.searchsorted(own, entry * 10**6))
                assert left == (leave[step] if step < len(own) else entry * 10**6)


def leave(steps, entry):
    times, until = steps
    at = int(np.searchsorted(times, entry))
    return int(until[at]) if at < len(times) else entry


def test_composed_steps_lead_where_the_neighbours_do():
    rng = np.random.default_rng(6)
    for _ in range(200):
        edges, parts = np.cumsum(rng.integers(5, 30, 6)), []
        for start, end in zip(edges, edges[1:]):
            times = np.unique(rng.integers(start, end, rng.integers(0, 8)))
            until = times + rng.integers(1, 40, len(times))
            parts.append((times, np.maximum.accumulate(until)))
        whole, latest = (np.zeros(0, np.int64), np.zeros(0, np.int64)), int(edges[0]) + 40
        for part in parts:
            whole = suppression.within_reach(suppression.compose(whole, part), latest)
        for entry in range(int(edges[0]) - 2, latest + 1):
            expected = entry
            for part in parts:
                expected = leave(part, expected)
            assert leave(whole, entry) == expected


@pytest.mark.parametrize("fan_in", [2, 5])
def test_blocks_of_slices(spark, monkeypatch, fan_in):
    monkeypatch.setattr(suppression, "FAN_IN", fan_in)
    test_fold(spark, 3, 60_000, 9, 100)
    test_fold(spark, 4, 400, 1, 7)


def test_a_long_regular_train(spark):
    """Two faults in each of 10^5 slices of one code; no step function grows with the train."""
    slices, span = 100_000, 20
    seconds = F.col("id") * 10 + F.lit(1_700_000_000)
    train = spark.range(2 * slices).select(
        F.lit("d").alias("device_id"),
        F.lit("1").alias("fault_code"),
        F.timestamp_seconds(seconds).alias("timestamp"),
        F.unhex(F.lit("000019")).alias("payload_bytes"),
        "id",
    )
    marked = suppression.mark_suppressed(train, span_seconds=span)
    # A window of 25 s hides the two faults after the one that opens it.
    wrong = marked.where(F.col("suppressed") == (F.col("id") % 3 == 0)).count()
    assert (marked.count(), wrong) == (2 * slices, 0)
    blocks = [(np.arange(0, 50, 10), np.arange(25, 75, 10))] * 3
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for k, (times, until) in enumerate(blocks * 300):
        held = suppression.within_reach(suppression.compose(held, (times + 50 * k, until + 50 * k)), 25)
        assert len(held[0]) <= 4

"""Replaying stored files gives what the batch operators give."""

import datetime as dt
import itertools
import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roadlake.operators import clean, decode, faults, idling, summary, suppression
from roadlake.plans import faults as fault_plan
from roadlake.schemas import FAULT_COLUMNS, FAULT_SEGMENT, GPS_COLUMNS
from roadlake.sources import stores, tables
from roadlake.streaming import jobs
from tests.helpers import at, fixes, gps_frame

NOW = {"availableNow": True}
SOON = {"processingTime": "0 seconds"}
numbers = itertools.count()


@pytest.fixture(autouse=True)
def two_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def write_in_order(frame, path, order, files):
    """``files`` parquet files whose modification times follow ``order``."""
    rows = frame.orderBy(order).collect()
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        frame.sparkSession.createDataFrame(part, frame.schema).coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            if name.startswith("part-") and os.path.getmtime(f"{path}/{name}") > 1e9:
                os.utime(f"{path}/{name}", (1000 + i, 1000 + i))


def collected(stream, checkpoint):
    name = f"seen{next(numbers)}"
    query = (
        stream.writeStream.format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(**NOW)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.table(name)


def until_read(query, rows):
    """Stop ``query`` once it has taken ``rows`` rows.

    Processing-time timers ask for a batch at every trigger, so a query with
    them does not end by itself when its files are read.
    """
    taken, deadline = {}, time.monotonic() + 100
    while sum(taken.values()) < rows and time.monotonic() < deadline:
        time.sleep(0.5)
        assert query.exception() is None
        taken.update({p["batchId"]: p["numInputRows"] for p in query.recentProgress})
    query.stop()
    assert sum(taken.values()) >= rows


def collected_timed(stream, checkpoint, rows):
    name = f"seen{next(numbers)}"
    query = (
        stream.writeStream.format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(**SOON)
        .start()
    )
    until_read(query, rows)
    return stream.sparkSession.table(name)


def same(left, right):
    assert left.count() == right.count()
    assert left.select(*right.columns).exceptAll(right).count() == 0


def flushed(spark, tmp_path, stream, stored, **options):
    """The summaries that the stream leaves, with ``stored`` as its table."""
    table, late = str(tmp_path / "summary"), str(tmp_path / "late")
    dated = stored.withColumn("event_date", F.to_date("timestamp"))
    jobs.start_summary_flush(
        stream, lambda: dated, table, late, str(tmp_path / "flush"), NOW, **options
    ).awaitTermination()
    return stores.read_summary(spark, table)


def test_summary_and_idling(spark, tmp_path):
    events = gps_frame(spark, fixes(random.Random(21), 4, 120, 50 * 3600))
    path = str(tmp_path / "fixes")
    write_in_order(events, path, "timestamp", 3)
    stream = jobs.stream_table(spark, path, events, files_per_batch=1)
    same(collected(jobs.idling_episodes(stream), str(tmp_path / "c1")), idling.idling_episodes(events))
    stored = flushed(spark, tmp_path, stream, events)
    expected = summary.daily_summary(events)
    assert stored.count() == expected.count()
    kept = {(r.vehicle_id, r.summary_date): r for r in stored.collect()}
    for row in expected.collect():
        got = kept[(row.vehicle_id, row.summary_date)]
        assert [getattr(got, c) for c in expected.columns] == pytest.approx(list(row))


def test_duplicates_go_and_late_fixes_stay(spark, tmp_path):
    def fix(hour, seq):
        return ("d", dt.datetime(2024, 5, 1, hour), 10.0, 1.0, True, 1.0, 2.0, 3.0, seq)

    path = str(tmp_path / "fixes")
    for i, rows in enumerate([[fix(12, 1)], [fix(13, 2)], [fix(13, 3)], [fix(9, 4)], [fix(12, 5), fix(2, 6)]]):
        gps_frame(spark, rows).coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            if name.startswith("part-") and os.path.getmtime(f"{path}/{name}") > 10_000:
                os.utime(f"{path}/{name}", (2000 + i, 2000 + i))
    stream = jobs.stream_table(spark, path, gps_frame(spark, []), files_per_batch=1)
    kept = collected(jobs.dedup(stream), str(tmp_path / "c")).collect()
    assert sorted(r.timestamp.hour for r in kept) == [2, 9, 12, 13]


def test_disorder_within_the_lateness_is_as_in_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = sorted(fixes(rng, 2, 150, 6 * 3600), key=lambda r: r[1])
    arrivals = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(580)))
    path = str(tmp_path / "fixes")
    for i in range(6):
        part = arrivals[i * len(rows) // 6 : (i + 1) * len(rows) // 6]
        gps_frame(spark, part).coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            if name.startswith("part-") and os.path.getmtime(f"{path}/{name}") > 10_000:
                os.utime(f"{path}/{name}", (2000 + i, 2000 + i))
    events = gps_frame(spark, rows)
    stream = jobs.stream_table(spark, path, events, files_per_batch=1)
    got = {r.vehicle_id: r.asDict() for r in flushed(spark, tmp_path, stream, events).collect()}
    for row in summary.daily_summary(events).collect():
        assert got[row.vehicle_id] == pytest.approx(row.asDict())


def test_late_fixes_are_set_aside_and_their_days_worked_out_again(spark, tmp_path):
    """One device uploads a buffered morning after its evening and after the next day."""
    rows = sorted(fixes(random.Random(31), 3, 120, 40 * 3600), key=lambda r: r[1])
    other = [r for r in rows if r[0] != "dev0"]
    own = [r for r in rows if r[0] == "dev0"]
    morning, evening = own[10:40], own[:10] + own[40:70]
    batches = [evening, other[:100], morning[:15], own[70:], morning[15:], other[100:]]
    path = str(tmp_path / "fixes")
    for i, part in enumerate(batches):
        gps_frame(spark, part).coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            if name.startswith("part-") and os.path.getmtime(f"{path}/{name}") > 10_000:
                os.utime(f"{path}/{name}", (2000 + i, 2000 + i))
    events = gps_frame(spark, rows)
    stream = jobs.stream_table(spark, path, events, files_per_batch=1)
    found = flushed(spark, tmp_path, stream, events)
    got = {(r.vehicle_id, r.summary_date): r.asDict() for r in found.collect()}
    expected = summary.daily_summary(events).collect()
    assert len(got) == len(expected)
    for row in expected:
        mine = {**got[row.vehicle_id, row.summary_date]}
        if row.vehicle_id == "dev0":
            # The start is that of the first flush, as in any upsert.
            mine.update(start_latitude=row.start_latitude, start_longitude=row.start_longitude)
        assert mine == pytest.approx(row.asDict())
    late = stores.read_table(spark, str(tmp_path / "late")).collect()
    assert {(r.device_id, r.ingest_seq) for r in late} == {(r[0], r[-1]) for r in morning}
    assert {r.reject_reason for r in late} == {"late"}


def test_a_stream_goes_on_with_a_running_day_and_shows_its_state(spark, tmp_path):
    """Batch until noon, stream after; then the whole state is read from the checkpoint."""
    rows = fixes(random.Random(41), 5, 150, 12 * 3600) + fixes(random.Random(42), 2, 2, 12 * 3600)[:1]
    events = gps_frame(spark, [r for r in rows if r[1].hour < 12])
    rest = gps_frame(spark, [r for r in rows if r[1].hour >= 12])
    whole = events.unionByName(rest)
    path = str(tmp_path / "fixes")
    write_in_order(rest, path, "timestamp", 3)
    stream = jobs.stream_table(spark, path, rest, files_per_batch=1)
    running = summary.running_days(events)
    found = flushed(spark, tmp_path, stream, whole, running=running)
    got = {(r.vehicle_id, r.summary_date): r.asDict() for r in found.collect()}
    touched = {(r.device_id, r.timestamp.date()) for r in rest.collect()}
    for row in summary.daily_summary(whole).collect():
        if (row.vehicle_id, row.summary_date) in touched:
            assert got.pop((row.vehicle_id, row.summary_date)) == pytest.approx(row.asDict())
    assert not got
    live = jobs.live_state(spark, str(tmp_path / "flush")).collect()
    expected = {(r.vehicle_id, r.summary_date): r.asDict(True) for r in summary.daily_state(whole).collect()}
    assert len(live) == len({r.vehicle_id for r in live}) == 5
    for row in live:
        mine, wanted = row.asDict(True), expected[row.vehicle_id, row.summary_date]
        for name, value in wanted.items():
            assert mine[name] == (pytest.approx(value) if isinstance(value, float) else value), name


def test_a_table_takes_batches_streams_and_new_checkpoints(spark, tmp_path):
    """Every writer adds; a batch that is repeated replaces itself."""
    events = gps_frame(spark, fixes(random.Random(5), 2, 40, 30 * 3600))
    source, path = str(tmp_path / "fixes"), str(tmp_path / "events")
    write_in_order(events, source, "timestamp", 2)
    stream = jobs.stream_table(spark, source, events, files_per_batch=1)
    seen = []

    def store(batch, batch_id):
        write = stores.write_of_batch(batch, batch_id)
        seen.append(write)
        for _ in range(2):
            stores.append_gps_events(batch, path, write)

    def run(checkpoint):
        jobs._start(stream, store, str(tmp_path / checkpoint), "append", NOW).awaitTermination()

    run("c1")
    run("c1")
    assert len(seen) == len(set(seen)) == 2
    assert stores.read_days(path, events).count() == events.count()
    stores.append_gps_events(events, path)
    run("c2")
    assert len(set(seen)) == 4
    stored = stores.read_table(spark, path)
    assert stored.count() == 3 * events.count()
    assert set(stored.columns) == {*events.columns, "event_date"}
    assert stores.read_days(path, events).distinct().count() == events.count()


def test_parts_and_cooldown(spark, tmp_path):
    rng = random.Random(4)
    rows, seq = [], 0
    for fault in range(60):
        total = rng.randrange(1, 4)
        parts = list(range(total))[: total - (fault % 5 == 0)]
        for part in rng.sample(parts, len(parts)):
            bits = format(0 if part < total - 1 else rng.randrange(60), "08b")
            rows.append((f"d{fault % 3}", at(fault * 7), bits, str(fault % 4), part, total, seq))
            seq += 1
    segments = spark.createDataFrame(rows, FAULT_SEGMENT)
    path = str(tmp_path / "parts")
    write_in_order(segments, path, "ingest_seq", 3)
    stream = jobs.stream_table(spark, path, segments, files_per_batch=1)
    seen = collected_timed(jobs.fault_status(stream), str(tmp_path / "c1"), len(rows))
    done = seen.where(F.col("status") == "complete")
    expected = faults.fault_events(segments)
    same(done.select(*expected.columns), expected)
    assert seen.where(F.col("status") == "pending").count() > 0

    stored = str(tmp_path / "faults")
    write_in_order(expected, stored, "timestamp", 3)
    marked = jobs.mark_suppressed(jobs.stream_table(spark, stored, expected, files_per_batch=1))
    batch = suppression.mark_suppressed(expected)
    same(collected(marked, str(tmp_path / "c2")), batch)
    assert batch.where("suppressed").count() > 0


def test_resent_parts_start_anew(spark, tmp_path):
    rows = [("d", at(0), "1", "7", 0, 2, 1), ("d", at(0), "0", "7", 1, 2, 2), ("d", at(0), "0", "7", 1, 2, 3)]
    segments = spark.createDataFrame(rows, FAULT_SEGMENT)
    path = str(tmp_path / "parts")
    write_in_order(segments, path, "ingest_seq", 3)
    stream = jobs.stream_table(spark, path, segments, files_per_batch=1)
    seen = collected_timed(jobs.fault_status(stream), str(tmp_path / "c"), 3)
    assert sorted((r.status, r.received) for r in seen.collect()) == [("complete", 2), ("pending", 1), ("pending", 1)]


def fold_parts(rows):
    """Faults completed in arrival order; a failed assembly also drops the parts."""
    held, done = {}, []
    for r in sorted(rows, key=lambda r: r.ingest_seq):
        key = (r.device_id, r.fault_code, r.timestamp)
        parts = held.setdefault(key, {})
        parts[r.sequence] = r.fault_bits
        if len(parts) >= r.total_number:
            if all(i in parts for i in range(r.total_number)):
                done.append((*key, "".join(parts[i] for i in range(r.total_number))))
            del held[key]
    return done


def test_ingest(spark, given, tmp_path):
    """Raw messages to stored events, faults and notifications, against the batch paths."""
    raw = tables.raw_gps(spark, given).unionByName(tables.raw_faults(spark, given))
    path = str(tmp_path / "raw")
    raw.coalesce(2).write.json(path)
    messages = stores.stream_messages(spark, path)
    reads = []

    def read_devices():
        reads.append(1)
        return tables.devices(spark, given)

    devices = jobs.Lookup(read_devices)
    labels = jobs.Lookup(lambda: tables.fault_labels(spark, given))
    events, letters = str(tmp_path / "events"), str(tmp_path / "letters")
    strange = str(tmp_path / "strange")
    ingest = jobs.start_gps_ingest(
        messages, devices, events, letters, strange, str(tmp_path / "c1"), NOW
    )
    ingest.awaitTermination()
    decoded = decode.decode_gps(tables.raw_gps(spark, given))
    expected = clean.enrich_device(clean.dedup(decode.good(decoded, GPS_COLUMNS)), tables.devices(spark, given))
    stored = stores.read_table(spark, events)
    key = ["device_id", "timestamp", "device_name"]
    same(stored.select(*key), expected.select(*key))
    assert spark.read.parquet(letters).count() == expected.where("speed >= 70").count()

    unknown = clean.unknown_devices(clean.dedup(decode.good(decoded, GPS_COLUMNS)), tables.devices(spark, given))
    same(spark.read.parquet(strange).select("device_id", "timestamp"), unknown.select("device_id", "timestamp"))

    refused = str(tmp_path / "refused")
    jobs.start_quarantine(messages, refused, str(tmp_path / "c2"), NOW).awaitTermination()
    counted = Counter()
    for progress in ingest.recentProgress:
        counted.update(progress.observedMetrics[jobs.REFUSED].asDict())
    by_reason = dict(decode.refused(decoded).groupBy("reject_reason").count().collect())
    assert {k: n for k, n in counted.items() if k != "good" and n} == by_reason
    bad = decode.decode_faults(tables.raw_faults(spark, given))
    assert spark.read.parquet(refused).count() == decode.refused(decoded).count() + decode.refused(bad).count()

    table = str(tmp_path / "faults")
    until_read(
        jobs.start_fault_ingest(
            messages, devices, labels, table, str(tmp_path / "rejected"), str(tmp_path / "c3"), SOON
        ),
        raw.where("routing_key = 'fault'").count(),
    )
    assert len(reads) == 1
    stored = stores.read_table(spark, table)
    alerts = str(tmp_path / "alerts")
    jobs.start_fault_alerts(
        jobs.stream_table(spark, table, stored), alerts, str(tmp_path / "c4"), NOW
    ).awaitTermination()
    wanted = fault_plan.fault_alerts(stored)
    same(spark.read.parquet(alerts).select("to", "subject", "body"), wanted)
    got = sorted((r.device_id, r.fault_code, r.timestamp, r.fault_payload) for r in stored.collect())
    names = {r.device_id for r in clean.known_devices(tables.devices(spark, given)).collect()}
    codes = {r.fault_code for r in tables.fault_labels(spark, given).collect()}
    complete = fold_parts(decode.good(bad, FAULT_COLUMNS).collect())
    assert got == sorted(c for c in complete if c[0] in names and c[1] in codes)
    lost = spark.read.parquet(str(tmp_path / "rejected")).where("reject_reason <> 'assembly'").collect()
    unnamed = [c[:3] for c in complete if c[0] not in names or c[1] not in codes]
    assert len(unnamed) > 0
    left_out = [(r.device_id, r.fault_code, r.timestamp) for r in lost if r.device_id in names]
    assert sorted(left_out) == sorted(c for c in unnamed if c[0] in names)
    assert {c for c in unnamed if c[0] not in names} <= {(r.device_id, r.fault_code, r.timestamp) for r in lost}


def test_one_query_takes_the_whole_feed(spark, given, tmp_path):
    """Every message in one table, as in batch; a repeated batch changes nothing."""
    raw = tables.raw_messages(spark, given).where("floor(ingest_seq / 2) % 3 = 0").orderBy("ingest_seq").cache()
    path, places = str(tmp_path / "raw"), [str(tmp_path / name) for name in ("events", "parts", "lost", "seen")]
    for k in range(3):
        raw.where(F.col("ingest_seq") % 5 % 3 == k).coalesce(1).write.mode("append").json(path)
    messages = stores.stream_messages(spark, path, files_per_batch=1)
    devices = jobs.Lookup(lambda: tables.devices(spark, given))

    def run(checkpoint):
        jobs.start_feed(messages, devices, *places, checkpoint, NOW).awaitTermination()

    run(str(tmp_path / "c"))
    events, parts, lost = (stores.read_table(spark, p) for p in places[:3])
    gps = decode.decode_gps(decode.route(raw, "gps"))
    good = decode.good(gps, GPS_COLUMNS)
    expected = clean.enrich_device(clean.dedup(good), tables.devices(spark, given))
    key = ["device_id", "timestamp", "device_name"]
    same(events.select(*key), expected.select(*key))
    bad = decode.decode_faults(decode.route(raw, "fault"))
    same(parts.select(*FAULT_COLUMNS), decode.good(bad, FAULT_COLUMNS))
    assert events.count() + parts.count() + lost.count() == raw.count()
    reasons = dict(lost.groupBy("reject_reason").count().collect())
    copies = good.count() - clean.dedup(good).count()
    unknown = clean.unknown_devices(clean.dedup(good), tables.devices(spark, given)).count()
    assert copies > 0 and reasons["duplicate"] == copies and reasons["unknown_device"] == unknown
    assert reasons["unknown_route"] == decode.unrouted(raw).count()
    assert lost.where("body is null or reject_reason is null").count() == 0
    # The last batch again, as after a crash before it was marked as done.
    before = [stores.read_table(spark, p).count() for p in places]
    last = max(int(n) for n in os.listdir(tmp_path / "c" / "commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "c" / "commits" / name).unlink()
    run(str(tmp_path / "c"))
    assert [stores.read_table(spark, p).count() for p in places] == before
    # A new query finds all of it done.
    run(str(tmp_path / "c2"))
    assert stores.read_table(spark, places[0]).count() == before[0]
    assert stores.read_table(spark, places[3]).count() == before[3]


def test_lookup_life():
    now, reads = [0.0], []
    lookup = jobs.Lookup(lambda: reads.append(1) or len(reads), 300.0, lambda: now[0], hold=lambda n: n)
    assert [lookup.get(), lookup.get()] == [1, 1]
    now[0] = 299.0
    assert lookup.get() == 1
    now[0] = 300.0
    assert lookup.get() == 2
    lookup.invalidate()
    assert lookup.get() == 3


def test_dedup(spark, tmp_path):
    rows = [("a", at(s), 1.0, 1.0, True, 0.0, 0.0, 0.0, i) for i, s in enumerate([0, 0, 10, 0, 10, 20])]
    events = gps_frame(spark, rows)
    path = str(tmp_path / "fixes")
    write_in_order(events, path, "ingest_seq", 3)
    stream = jobs.stream_table(spark, path, events, files_per_batch=1)
    seen = collected(jobs.dedup(stream), str(tmp_path / "c"))
    assert sorted(r.timestamp for r in seen.collect()) == [at(0), at(10), at(20)]

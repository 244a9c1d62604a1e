import datetime as dt
import os
import random
import shutil
import threading

from pyspark.sql import functions as F

from roadlake.operators import reports, summary
from roadlake.schemas import SUMMARY_COLUMNS
from roadlake.session import shared_dir
from roadlake.sources import stores
from tests.helpers import fixes, gps_frame


def by_key(frame):
    return {(r.vehicle_id, r.summary_date): r.asDict() for r in frame.collect()}


def written_bytes(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_newest_version_wins_and_the_first_start_stays(spark):
    path = shared_dir(spark, "summaries")
    events = gps_frame(spark, fixes(random.Random(8), 3, 80, 60 * 3600))
    whole = summary.daily_summary(events)
    early = summary.daily_summary(events.where(F.col("ingest_seq") % 2 == 0))
    stores.upsert_summary(early, path)
    stores.upsert_summary(whole, path)
    found, starts, ends = by_key(stores.read_summary(spark, path)), by_key(early), by_key(whole)
    assert found.keys() == ends.keys() and len({day for _, day in found}) > 1
    for key, row in found.items():
        first = starts.get(key, ends[key])
        kept = {c: first[c] for c in ("start_latitude", "start_longitude")}
        assert row == {**ends[key], **kept}


def test_a_flush_writes_what_has_changed(spark):
    path = shared_dir(spark, "summaries")
    number = F.col("id").cast("double")
    whole = spark.range(40_000).select(
        F.concat(F.lit("dev"), "id").alias("vehicle_id"),
        F.lit(dt.date(2024, 5, 20)).alias("summary_date"),
        *[F.rand(k).alias(c) for k, c in enumerate(SUMMARY_COLUMNS[2:8])],
        F.col("id").alias("trip_count"),
        number.alias("fuel_consumed_liters"),
    )
    stores.upsert_summary(whole, path)
    all_rows = written_bytes(path)
    stores.upsert_summary(whole.where("trip_count % 40 = 0"), path)
    assert written_bytes(path) - all_rows < all_rows / 20
    assert spark.read.parquet(f"{path}/log").count() == 41_000
    assert stores.read_summary(spark, path).count() == 40_000


def test_two_writers_and_a_repeated_write(spark):
    path = shared_dir(spark, "summaries")
    events = gps_frame(spark, fixes(random.Random(8), 4, 30, 20 * 3600))
    whole = summary.daily_summary(events)
    mine, yours = whole.where("vehicle_id <= 'dev2'"), whole.where("vehicle_id >= 'dev1'")
    barrier = threading.Barrier(2)

    def write(rows, name):
        barrier.wait()
        stores.upsert_summary(rows, path, name)

    writers = [threading.Thread(target=write, args=a) for a in ((mine, "a"), (yours, "b"))]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    before = written_bytes(path)
    stores.upsert_summary(yours, path, "b")
    log = spark.read.parquet(f"{path}/log")
    assert log.count() == mine.count() + yours.count() and written_bytes(path) == before
    assert by_key(stores.read_summary(spark, path)) == by_key(whole)


def test_a_folded_log_reads_the_same(spark):
    path = shared_dir(spark, "summaries")
    events = gps_frame(spark, fixes(random.Random(8), 3, 80, 60 * 3600))
    whole = summary.daily_summary(events)
    later = dt.datetime.now() + dt.timedelta(hours=2)
    stores.fold_summary(spark, path, later)
    stores.upsert_summary(summary.daily_summary(events.where(F.hour("timestamp") >= 12)), path)
    first = by_key(stores.read_summary(spark, path))
    stores.fold_summary(spark, path)
    assert stores._folded_upto(spark, path) == -1
    stores.fold_summary(spark, path, later)
    assert stores._folded_upto(spark, path) > 0
    assert by_key(stores.read_summary(spark, path)) == first
    assert stores._versions(spark, path)[1].count() == 0
    # A fold whose last step was lost leaves versions in both places.
    shutil.rmtree(f"{path.removeprefix('file:')}/folded")
    assert by_key(stores.read_summary(spark, path)) == first
    stores.upsert_summary(whole, path)
    expected = by_key(stores.read_summary(spark, path))
    stores.fold_summary(spark, path, later)
    assert by_key(stores.read_summary(spark, path)) == expected != first


def test_upsert_of_nothing(spark):
    path = shared_dir(spark, "summaries")
    events = gps_frame(spark, fixes(random.Random(9), 1, 5, 3600))
    assert stores.read_summary(spark, path).count() == 0
    stores.upsert_summary(summary.daily_summary(events.limit(0)), path)
    stores.upsert_summary(summary.daily_summary(events), path)
    stores.upsert_summary(summary.daily_summary(events.limit(0)), path)
    assert stores.read_summary(spark, path).count() == 1


def test_events_are_pruned_by_day(spark):
    path = shared_dir(spark, "events")
    events = gps_frame(spark, fixes(random.Random(8), 2, 50, 60 * 3600))
    stores.append_gps_events(events, path)
    stores.append_gps_events(events.limit(0), path)
    stored = stores.read_table(spark, path)
    assert stored.count() == events.count()
    day = dt.date(2024, 5, 21)
    found = reports.fixes_of_day(stored, "dev1", day)
    assert found.count() == events.where((F.col("device_id") == "dev1") & (F.to_date("timestamp") == F.lit(day))).count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def scanned_rows(frame):
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    nodes, rows = [plan], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan parquet"):
            rows += node.metrics().apply("numOutputRows").value()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
    return rows


def test_a_lookup_of_one_device_reads_few_rows_of_its_day(spark):
    """Days are sorted by device, so most row groups are skipped by their statistics."""
    path = shared_dir(spark, "events")
    events = gps_frame(spark, fixes(random.Random(8), 50, 400, 17 * 3600))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.setInt("parquet.block.size", 4096)
    try:
        stores.append_gps_events(events.repartition(4), path)
    finally:
        hadoop.unset("parquet.block.size")
    stored = stores.read_table(spark, path)
    found = reports.fixes_of_day(stored, "dev7", dt.date(2024, 5, 20))
    assert scanned_rows(stored) == events.count()
    assert found.count() <= scanned_rows(found) < events.count() / 5


def test_messages(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"body":"YQ==","routing_key":"gps","ingest_seq":1,"ingest_ts":"2024-01-01T00:00:00Z"}\n')
    (row,) = stores.read_messages(spark, str(tmp_path)).collect()
    assert (row.body, row.routing_key, row.ingest_seq) == ("YQ==", "gps", 1)

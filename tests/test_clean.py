import json

from roadlake.operators import clean
from tests.helpers import at, gps_frame


def fix(device, second, seq, speed=1.0):
    return (device, at(second), speed, 1.0, True, 0.0, 0.0, 0.0, seq)


def test_first_arrival_wins(spark):
    rows = [fix("a", 0, 3, 3.0), fix("a", 0, 1, 1.0), fix("a", 0, 2, 2.0), fix("b", 0, 9), fix("a", 5, 4)]
    frame = gps_frame(spark, rows)
    kept = clean.dedup(frame)
    assert sorted((r.device_id, r.ingest_seq, r.speed) for r in kept.collect()) == [
        ("a", 1, 1.0),
        ("a", 4, 1.0),
        ("b", 9, 1.0),
    ]
    assert sorted(r.ingest_seq for r in clean.duplicates(frame).collect()) == [2, 3]
    assert kept.columns == frame.columns


def test_copies_fold_before_the_shuffle(spark):
    plan = clean.dedup(gps_frame(spark, [fix("a", 0, 1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("partial_min_by") > plan.index("Exchange")
    assert "SortAggregate" not in plan


def test_devices(spark):
    events = gps_frame(spark, [fix("a", 0, 1), fix("b", 0, 2), fix("c", 0, 3)])
    devices = spark.createDataFrame([("a", "Truck A"), ("b", "")], "device_id string, device_name string")
    assert [(r.device_id, r.device_name) for r in clean.enrich_device(events, devices).collect()] == [("a", "Truck A")]
    assert sorted(r.device_id for r in clean.unknown_devices(events, devices).collect()) == ["b", "c"]
    ids = spark.createDataFrame([("a",), ("z",)], "device_id string")
    assert [r.device_id for r in clean.device_exists(events, ids).collect()] == ["a"]


def test_label_answers(spark):
    answers = [
        ("1", 200, json.dumps({"label": "Overheat"})),
        ("2", 200, json.dumps([{"label": "Overheat"}, {"label": "x"}])),
        ("3", 200, json.dumps({"label": 1234})),
        ("4", 200, json.dumps("Overheat")),
        ("5", 429, ""),
        ("6", 500, ""),
        ("7", 404, ""),
        ("8", 200, "[]"),
        ("9", 200, json.dumps({"name": "x"})),
    ]
    responses = spark.createDataFrame(answers, "fault_code string, status int, body string")
    labels = clean.labels_from_responses(responses)
    faults = spark.createDataFrame([(str(i),) for i in range(1, 10)], "fault_code string")
    got = {r.fault_code: r.fault_label for r in clean.enrich_label(faults, labels).collect()}
    assert got == {"1": "Overheat", "2": "Overheat", "3": "Unknown", "4": "Unknown", "8": "Unknown", "9": "Unknown"}
    assert sorted(r.fault_code for r in clean.unlabelled(faults, labels).collect()) == ["5", "6", "7"]


def test_device_answers(spark):
    answers = [("a", 200, '{"name": "Truck A"}'), ("b", 200, "{}"), ("c", 500, "")]
    responses = spark.createDataFrame(answers, "device_id string, status int, body string")
    got = {r.device_id: r.device_name for r in clean.devices_from_responses(responses).collect()}
    assert got == {"a": "Truck A", "b": ""}

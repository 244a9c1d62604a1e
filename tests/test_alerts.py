import bisect
import itertools
import json
import random
import threading
from collections import Counter

import pytest

from roadlake import queries
from roadlake.operators import alerts, rule_table
from roadlake.operators.alerts import AlertRule
from tests.helpers import at

GPS = ("gps",)
CASES = [
    ("gps", {"anything": 1}, GPS, {}, True),
    ("gps", {"odometer": 12.5, "speed": None}, GPS, {"odometer": 12.5}, True),
    ("gps", {"odometer": 12.4}, GPS, {"odometer": 12.5}, False),
    ("gps", {"speed": None}, GPS, {"speed": 10.0}, False),
    ("gps", {"odometer": 3.0}, GPS, {"speed": 10.0}, False),
    ("gps", {"speed": "11.5"}, GPS, {"speed": 11.0}, True),
    ("gps", {"speed": "quick"}, GPS, {"speed": 11.0}, False),
    ("gps", {"speed": True}, GPS, {"speed": 1}, True),
    ("gps", {"speed": 31, "zone": "north"}, GPS, {"speed": 30.0, "zone": "south"}, False),
    ("gps", {"speed": 31, "zone": "north"}, GPS, {"speed": 30.0, "zone": "north"}, True),
    ("fault", {"fault_code": "41"}, ("fault", "gps"), {"fault_code": ["40", "41"]}, True),
    ("fault", {"fault_code": "42"}, ("fault", "gps"), {"fault_code": ["40", "41"]}, False),
    ("fault", {"fault_code": 41}, ("fault",), {"fault_code": ["41"]}, False),
    ("fault", {"fault_code": 41}, ("fault",), {"fault_code": [40, 41]}, True),
    ("door", {"side": "left"}, ("fault",), {"side": "left"}, False),
    ("door", {"side": "left"}, ("door",), {"side": "left"}, True),
    ("door", {"side": "right"}, ("door",), {"side": "left"}, False),
]


def envelope(event_type, data):
    return json.dumps(
        {"event_type": event_type, "device_id": "d", "device_name": "n", "timestamp": "2024-01-01T00:00:00", "data": data}
    )


def parsed(spark, *texts):
    return alerts.parse_messages(spark.createDataFrame([(t,) for t in texts], "message string"))


@pytest.mark.parametrize("event_type, data, types, thresholds, matches", CASES)
def test_rules_on_parsed_envelopes(spark, event_type, data, types, thresholds, matches):
    rules = (AlertRule("x@example.com", types, thresholds),)
    assert alerts.match_any(parsed(spark, envelope(event_type, data)), rules).count() == int(matches)


def test_bad_envelopes(spark):
    missing = json.loads(envelope("gps", {}))
    del missing["device_id"]
    typed = {**json.loads(envelope("gps", {})), "device_name": 7, "data": [1]}
    rows = parsed(spark, "not json", json.dumps(missing), json.dumps(typed), envelope("gps", {"a": 1})).collect()
    assert [r.error for r in rows] == ["not json", "bad field: device_id", "bad field: device_name, data", None]
    assert rows[3].device_id == "d" and rows[1].device_name is None


def named_fixes(spark):
    rows = [
        ("d", "Truck", at(0), 70.0, 1.0, True, 1.0, 2.0, 3.0),
        ("d", "Truck", at(0.5), 69.9, 1.0, True, 1.0, 2.0, 3.0),
    ]
    shape = """device_id string, device_name string, timestamp timestamp, speed double, odometer double,
    power_on boolean, latitude double, longitude double, fuel_gauge double"""
    return spark.createDataFrame(rows, shape)


def test_built_in_rules_and_letter(spark):
    (letter,) = alerts.notifications(alerts.gps_envelopes(named_fixes(spark))).collect()
    assert letter.to == "example@gmail.com"
    assert letter.subject == "Alert: gps [speed=70.0 (threshold=70.0)]"
    body = json.loads(letter.body)
    assert list(body) == ["event_type", "device_id", "device_name", "timestamp", "data"]
    assert body["timestamp"] == "2024-05-20T06:00:00" and body["data"]["speed"] == 70.0
    assert list(body["data"])[-1] == "device_name"


def test_fault_letter(spark):
    rows = [("d", "Truck", at(0), bytearray(b"\x55\xaa"), c, "Overheat") for c in ("1", "100", "101", "0")]
    shape = "device_id string, device_name string, timestamp timestamp, payload_bytes binary, fault_code string, fault_label string"
    letters = alerts.notifications(alerts.fault_envelopes(spark.createDataFrame(rows, shape))).collect()
    codes = [str(i) for i in range(1, 101)]
    assert sorted(r.subject for r in letters) == sorted(
        f"Alert: fault [fault_code={c} (threshold={codes})]" for c in ("1", "100")
    )
    assert json.loads(letters[0].body)["data"]["fault_payload"] == "Vao="


def test_long_payload_is_one_line(spark):
    import base64

    rows = [("d", "Truck", at(0), bytearray(range(100)), "1", "Overheat")]
    shape = "device_id string, device_name string, timestamp timestamp, payload_bytes binary, fault_code string, fault_label string"
    (row,) = alerts.fault_envelopes(spark.createDataFrame(rows, shape)).select("data.fault_payload").collect()
    assert row[0] == base64.b64encode(bytes(range(100))).decode()


def test_no_shared_key(spark):
    rules = (AlertRule("x@example.com", GPS, {}),)
    letters = alerts.notifications(alerts.gps_envelopes(named_fixes(spark)), rules).collect()
    assert {r.subject for r in letters} == {"Alert: gps [no matching thresholds]"}


def test_one_letter_per_rule(spark):
    rules = (
        AlertRule("a@example.com", GPS, {"speed": 70}),
        AlertRule("b@example.com", ("gps", "fault"), {"power_on": True, "device_id": "d"}),
        AlertRule("c@example.com", GPS, {"device_name": ["Truck", 5], "missing": 1}),
    )
    letters = alerts.notifications(alerts.gps_envelopes(named_fixes(spark)), rules).collect()
    assert sorted((r.to, r.subject) for r in letters) == [
        ("a@example.com", "Alert: gps [speed=70.0 (threshold=70)]"),
        ("b@example.com", "Alert: gps [power_on=True (threshold=True), device_id=d (threshold=d)]"),
        ("b@example.com", "Alert: gps [power_on=True (threshold=True), device_id=d (threshold=d)]"),
    ]


def test_typed_and_parsed_letters_agree(spark):
    typed = alerts.gps_envelopes(named_fixes(spark))
    again = alerts.parse_messages(alerts.to_messages(typed))
    left = sorted((r.to, r.subject) for r in alerts.notifications(typed).collect())
    right = sorted((r.to, r.subject) for r in alerts.notifications(again).collect())
    assert left == right and len(left) == 1


def test_speed_rule_reaches_the_scan(spark, tmp_path):
    named_fixes(spark).write.parquet(str(tmp_path / "fixes"))
    stored = spark.read.parquet(str(tmp_path / "fixes"))
    plan = alerts.notifications(alerts.gps_envelopes(stored))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(speed,70.0)" in plan


def as_letters(frame):
    return Counter((r["to"], r["subject"], r["body"]) for r in frame.collect())


def test_a_table_of_rules_says_what_the_rules_say(spark):
    """All cases on all rules at once, on both forms of envelopes."""
    rules = tuple(
        AlertRule(f"{k}@example.com", types, thresholds) for k, (_, _, types, thresholds, _) in enumerate(CASES)
    ) + (AlertRule("any@example.com", ("gps", "door", "gps"), {}), *alerts.RULES)
    table = rule_table.rules_frame(spark, rules)
    read = parsed(spark, *[envelope(kind, data) for kind, data, *_ in CASES]).where("error is null")
    found = as_letters(rule_table.notifications(read, table))
    assert found == as_letters(alerts.notifications(read, rules)) and found.total() > len(CASES)
    typed = alerts.gps_envelopes(named_fixes(spark))
    found = as_letters(rule_table.notifications(typed, table))
    assert found == as_letters(alerts.notifications(typed, rules)) and found.total() > 2
    none = rule_table.rules_frame(spark, ())
    assert rule_table.notifications(typed, none).count() == 0
    assert rule_table.notifications(typed.limit(0), table).count() == 0


def test_ten_thousand_rules(spark):
    rng = random.Random(3)
    rules = []
    for k in range(10_000):
        kind = k % 4
        tests = {"speed": float(rng.randrange(300))} if kind else {}
        if kind != 1:
            tests["device_id"] = rng.sample([f"d{n}" for n in range(300)], rng.randrange(1, 4))
        if kind == 3:
            tests["power_on"] = True
        rules.append(AlertRule(f"{k}@example.com", GPS if k % 9 else ("fault",), tests))
    rows = [
        (f"d{rng.randrange(300)}", "n", at(k), rng.choice([float("nan"), *map(float, range(0, 300, 7))]), 1.0,
         rng.random() < 0.5, 1.0, 2.0, 3.0)
        for k in range(60)
    ]
    shape = named_fixes(spark).schema
    envelopes = alerts.gps_envelopes(spark.createDataFrame(rows, shape))
    wanted = Counter()
    for device, _, time, speed, _, power, *_ in rows:
        for rule in rules:
            passes = "gps" in rule.event_types
            for key, threshold in rule.thresholds.items():
                if key == "device_id":
                    passes &= device in threshold
                else:
                    passes &= not (speed if key == "speed" else float(power)) < float(threshold)
            wanted[rule.email, at_text(time)] += passes
    found = rule_table.notifications(envelopes, rule_table.rules_frame(spark, rules)).collect()
    assert Counter((r["to"], json.loads(r["body"])["timestamp"]) for r in found) == +wanted
    parsed_again = alerts.parse_messages(alerts.to_messages(envelopes.where("not isnan(data.speed)")))
    again = rule_table.notifications(parsed_again, rule_table.rules_frame(spark, rules)).collect()
    slow = {at_text(r[2]) for r in rows if r[3] == r[3]}
    assert Counter((r["to"], json.loads(r["body"])["timestamp"]) for r in again) == Counter(
        {k: n for k, n in wanted.items() if n and k[1] in slow}
    )


def at_text(time):
    return time.isoformat()


def tallied(frame):
    return sorted((str(r["to"]), r["letters"], r["first_body"]) for r in frame.collect())


def counted(letters):
    bodies = {}
    for r in letters.collect():
        bodies.setdefault(str(r["to"]), []).append(r["body"])
    return sorted((to, len(of), min(of)) for to, of in bodies.items())


def test_tallies_are_the_letters_counted(spark):
    """Of all cases, and of bounds and options on one key, in numbers, on one address, in rows that repeat."""
    thresholds = [t for _, _, _, t, _ in CASES] + [
        {"speed": float("-inf")}, {"speed": float("nan")}, {"speed": -0.0}, {"speed": 0.0}, {"odometer": 1},
        {"speed": 11.0, "odometer": 1.0}, {"device_id": ["d", "e"], "power_on": True}, {"power_on": [True, 0]},
        {"power_on": [1, True], "speed": 69.9}, {"device_id": ["d", "d"], "speed": 70}, {"device_name": "Truck"}, {},
    ]
    rules = tuple(
        AlertRule(f"{k % 9}@example.com", ("gps", "fault", "gps")[: 1 + k % 3], t) for k, t in enumerate(thresholds)
    ) + alerts.RULES
    table = rule_table.rules_frame(spark, rules)
    table = table.unionByName(table.where("rule_id % 4 = 0").limit(5))
    strange = spark.createDataFrame(
        [
            (None, "a", ["gps"], []), (90, None, ["gps"], []), (91, "b", None, []), (92, "c", ["gps"], None),
            (94, "f", ["gps"], [("speed", None, None, None, "-")]),
            (95, "g", ["gps", None], [("device_id", None, ["d", None], [], "-")]),
        ],
        table.schema,
    )
    table = table.unionByName(strange)
    slow = named_fixes(spark)
    rows = slow.union(slow.selectExpr("'e'", "'Van'", "timestamp", "-0.0D", "odometer", "false", *slow.columns[6:]))
    rows = rows.union(slow.selectExpr("'e'", "null", "timestamp", "double('nan')", *slow.columns[4:]))
    typed = alerts.gps_envelopes(rows.union(slow.selectExpr("'e'", "'Van'", "timestamp", "null", *slow.columns[4:])))
    read = parsed(spark, *[envelope(kind, data) for kind, data, *_ in CASES]).where("error is null")
    for envelopes in (typed, read):
        found = tallied(rule_table.tallies(envelopes, table))
        assert found == counted(rule_table.notifications(envelopes, table)) and len(found) > 6
    assert rule_table.tallies(typed, table.limit(0)).count() == 0
    assert rule_table.tallies(typed.limit(0), table).count() == 0


def test_a_rule_per_customer_at_size(spark, tmp_path):
    """Some 60 million letters are counted, not written."""
    customers = spark.range(60_000).selectExpr(
        "id AS c_custkey", "'Customer ' || id AS c_name", "0.0D AS c_acctbal", "'MACHINERY' AS c_mktsegment"
    )
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(60_000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-02 00:00:00' + make_dt_interval(0, 0, 0, id * 7919 % 60000) AS ts",
        "id % 3 AS user_id", "'view' AS event_type", "id * 37 % 20000 / 100.0D AS value",
    ).write.parquet(str(tmp_path / "events.parquet"))
    seen = queries._named_gps(spark, str(tmp_path))
    pairs = [(json.loads(m)["data"], m) for (m,) in alerts.to_messages(alerts.gps_envelopes(seen)).collect()]
    ladders = {}
    for device in ("truck_0", "truck_1", "truck_2", None):
        of = sorted((d["speed"], m) for d, m in pairs if device in (None, d["device_id"]))
        least = list(itertools.accumulate((m for _, m in reversed(of)), min))
        ladders[device] = [speed for speed, _ in of], least
    wanted = []
    for k in range(60_000):
        speeds, least = ladders.get(None if k % 50 == 0 else f"truck_{k % 100}", ([], []))
        n = len(speeds) - bisect.bisect_left(speeds, k % 83 + (40.0 if k % 50 == 0 else 0.0))
        if n:
            wanted.append((f"{k}@example.com", n, least[n - 1]))
    stop = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        found = tallied(queries.alert_rule_table(spark, str(tmp_path)))
    finally:
        stop.cancel()
    assert found == sorted(wanted) and sum(n for _, n, _ in found) > 60_000_000

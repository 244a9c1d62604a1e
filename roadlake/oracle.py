"""The same queries as plain SQL over the given tables."""

from __future__ import annotations

# The selections and targets that the queries ask for.
ASSETS = ["truck_1", "truck_2", "truck_3", "truck_5", "truck_8"]
TARGET_KM, TARGET_HOURS = 250.0, 6.0
DATES = "BETWEEN DATE '2024-01-04' AND DATE '2024-01-24'"
EPOCH = "epoch_us(TIMESTAMP '2024-01-01 00:00:00')"

# Named subqueries, each with the ones it reads.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: tuple[str, ...], sql: str) -> None:
    PARTS[name] = (needs, sql)


def build(sql: str, *needs: str) -> str:
    """``sql`` with the named subqueries it needs in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for inner in PARTS[name][0]:
            add(inner)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    if not order:
        return sql
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order) + "\n" + sql


def iso(us: str) -> str:
    return (
        f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {us} % 1000000 = 0 THEN '' "
        f"ELSE '.' || lpad(CAST({us} % 1000000 AS VARCHAR), 6, '0') END"
    )


def cents(c: str) -> str:
    return f"({c} // 100) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0')"


# Adapters

part(
    "gps_parts",
    (),
    f"""
SELECT event_id, ts, epoch_us(ts) AS us, 'truck_' || (user_id % 50) AS device_id,
  CASE WHEN event_type IN ('click', 'error') THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS speed_c,
  (user_id % 50) * 100000 + (epoch_us(ts) - {EPOCH}) // 3000000 AS odo_c,
  event_type <> 'error' AS power_on, event_id % 600 + 1000 AS lat_c, event_id % 300 + 10600 AS lon_c,
  10000 - ((user_id % 50) * 100000 + (epoch_us(ts) - {EPOCH}) // 3000000) % 10000 AS fuel_c
FROM events""",
)
GPS_FIELDS = """device_id, ts AS timestamp, speed_c / 1e2 AS speed, odo_c / 1e2 AS odometer, power_on,
  lat_c / 1e2 AS latitude, lon_c / 1e2 AS longitude, fuel_c / 1e2 AS fuel_gauge"""
part("gps", ("gps_parts",), f"SELECT {GPS_FIELDS}, event_id AS ingest_seq FROM gps_parts")
part(
    "raw_gps",
    ("gps_parts",),
    f"""
SELECT CASE WHEN kind = 0 THEN 'not-a-valid-base64!' ELSE to_base64(encode(
    CASE WHEN kind = 5 THEN '"' || body || '"' ELSE body END)) END AS body, ingest_seq
FROM (SELECT *, ingest_seq % 17 AS kind, concat_ws(':', device_id,
    (us // 1000000) || '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0'),
    CASE ingest_seq % 17 WHEN 2 THEN '' WHEN 3 THEN 'fast' WHEN 4 THEN '-1' || {cents('speed_c')} ELSE {cents('speed_c')} END,
    {cents('odo_c')}, CASE WHEN power_on THEN 'True' ELSE 'False' END, {cents('lat_c')}, {cents('lon_c')},
    CASE WHEN ingest_seq % 17 <> 1 THEN {cents('fuel_c')} END) AS body
  FROM (SELECT *, event_id * 2 + copy AS ingest_seq FROM gps_parts, (VALUES (0), (1)) c(copy)
        WHERE copy = 0 OR event_id % 5 = 0))""",
)
part(
    "faults",
    (),
    f"""
SELECT 'truck_' || (l_orderkey % 100) AS device_id,
  make_timestamp({EPOCH} + l_orderkey * 5000000) AS timestamp,
  lpad(bin(CAST(l_quantity AS BIGINT)), 8, '0') AS fault_bits,
  CAST(l_orderkey % 120 + 1 AS VARCHAR) AS fault_code,
  l_linenumber - 1 AS sequence, CAST(l_orderkey % 3 + 2 AS INTEGER) AS total_number,
  date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) * 10000000000000
    + l_partkey % 100000 * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS ingest_seq
FROM lineitem""",
)
part(
    "raw_faults",
    ("faults",),
    """
SELECT CASE WHEN ingest_seq % 17 = 0 THEN 'not-a-valid-base64!' ELSE to_base64(encode(concat_ws(':', device_id,
    CAST(epoch_us(timestamp) // 1000000 AS VARCHAR), CASE WHEN ingest_seq % 17 = 3 THEN '' ELSE fault_bits END,
    fault_code, CASE WHEN ingest_seq % 17 = 2 THEN 'X' ELSE CAST(sequence AS VARCHAR) END,
    CASE WHEN ingest_seq % 17 <> 1 THEN CAST(total_number AS VARCHAR) END))) END AS body, ingest_seq
FROM faults""",
)
part(
    "devices",
    (),
    """
SELECT 'truck_' || c_custkey AS device_id, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS device_name
FROM customer WHERE c_mktsegment <> 'FURNITURE'""",
)
part("known", ("devices",), "SELECT * FROM devices WHERE device_name <> ''")
part(
    "code_labels",
    (),
    """
SELECT CAST(p_partkey AS VARCHAR) AS fault_code, coalesce(CASE WHEN p_type <> 'ECONOMY' THEN p_name END, 'Unknown') AS fault_label
FROM part WHERE p_size <= 45""",
)

# Decoding

TEXT = """
SELECT *, CASE WHEN length(clean) % 4 = 0 THEN TRY(decode(from_base64(clean))) END AS t
FROM (SELECT *, regexp_replace(body, '[^A-Za-z0-9+/=]', '', 'g') AS clean FROM {raw})"""
part(
    "gps_decoded",
    ("raw_gps",),
    f"""
SELECT *, CASE WHEN t IS NULL THEN 'decode' WHEN len(f) <> 8 THEN 'field_count'
    WHEN timestamp IS NULL OR speed IS NULL OR odometer IS NULL OR latitude IS NULL OR longitude IS NULL
      OR fuel_gauge IS NULL THEN 'number'
    WHEN length(device_id) < 1 OR speed < 0 OR odometer < 0 THEN 'range' END AS reject_reason
FROM (SELECT ingest_seq, t, f, f[1] AS device_id,
    make_timestamp(CAST(round(TRY_CAST(f[2] AS DOUBLE) * 1000000) AS BIGINT)) AS timestamp,
    TRY_CAST(f[3] AS DOUBLE) AS speed, TRY_CAST(f[4] AS DOUBLE) AS odometer, lower(f[5]) = 'true' AS power_on,
    TRY_CAST(f[6] AS DOUBLE) AS latitude, TRY_CAST(f[7] AS DOUBLE) AS longitude, TRY_CAST(f[8] AS DOUBLE) AS fuel_gauge
  FROM (SELECT *, string_split(CASE WHEN starts_with(t, '"') AND ends_with(t, '"') THEN substr(t, 2, length(t) - 2)
      ELSE t END, ':') AS f FROM ({TEXT.format(raw='raw_gps')})))""",
)
part(
    "gps_good",
    ("gps_decoded",),
    """
SELECT device_id, timestamp, speed, odometer, power_on, latitude, longitude, fuel_gauge, ingest_seq
FROM gps_decoded WHERE reject_reason IS NULL""",
)
part(
    "gps_ranked",
    ("gps_good",),
    "SELECT *, row_number() OVER (PARTITION BY device_id, timestamp ORDER BY ingest_seq) AS arrival FROM gps_good",
)
part("gps_first", ("gps_ranked",), "SELECT * EXCLUDE (arrival) FROM gps_ranked WHERE arrival = 1")
part("gps_clean", ("gps_first", "known"), "SELECT * FROM gps_first JOIN known USING (device_id)")
part(
    "faults_decoded",
    ("raw_faults",),
    f"""
SELECT *, CASE WHEN t IS NULL THEN 'decode' WHEN len(f) <> 6 THEN 'field_count'
    WHEN timestamp IS NULL OR sequence IS NULL OR total_number IS NULL THEN 'number'
    WHEN length(device_id) < 1 OR length(fault_bits) < 1 OR length(fault_code) < 1 OR sequence < 0
      OR total_number < 0 THEN 'range' END AS reject_reason
FROM (SELECT ingest_seq, body, t, f, f[1] AS device_id, make_timestamp(CAST(round(TRY_CAST(f[2] AS DOUBLE) * 1000000) AS BIGINT)) AS timestamp,
    f[3] AS fault_bits, f[4] AS fault_code, TRY_CAST(f[5] AS INTEGER) AS sequence, TRY_CAST(f[6] AS INTEGER) AS total_number
  FROM (SELECT *, string_split(t, ':') AS f FROM ({TEXT.format(raw='raw_faults')})))""",
)
part(
    "faults_good",
    ("faults_decoded",),
    "SELECT device_id, timestamp, fault_bits, fault_code, sequence, total_number, ingest_seq FROM faults_decoded WHERE reject_reason IS NULL",
)
part(
    "faults_named",
    ("faults_good", "known"),
    "SELECT * FROM faults_good SEMI JOIN known USING (device_id)",
)

# Daily summary: one chain of subqueries per source of fixes


def summary_parts(tag: str, source: str) -> None:
    part(
        f"day{tag}",
        (source,),
        f"""
SELECT *, row_number() OVER p AS rn, lag(us) OVER p AS prev_us, lag(st) OVER p AS prev_st,
  row_number() OVER (PARTITION BY device_id, day ORDER BY us DESC, ingest_seq DESC) AS back
FROM (SELECT *, CAST(timestamp AS DATE) AS day, epoch_us(timestamp) AS us,
        CASE WHEN NOT power_on THEN 1 WHEN speed = 0 THEN 2 ELSE 3 END AS st FROM {source})
WINDOW p AS (PARTITION BY device_id, day ORDER BY us, ingest_seq)""",
    )
    part(
        f"trip_rows{tag}",
        (f"day{tag}",),
        f"""
SELECT *, max(CASE WHEN starts THEN rn END) OVER q AS trip_rn, max(CASE WHEN starts THEN us END) OVER q AS trip_us
FROM (SELECT *, rn > 1 AND st = 3 AND (CASE WHEN rn = 2 THEN 1 ELSE prev_st END) <> 3 AS starts FROM day{tag})
WINDOW q AS (PARTITION BY device_id, day ORDER BY rn ROWS UNBOUNDED PRECEDING)""",
    )
    part(
        f"trips{tag}",
        (f"trip_rows{tag}",),
        f"""
SELECT device_id, day, trip_rn, trip_us,
  min(CASE WHEN rn > 1 AND st <> 3 AND us - trip_us >= 300000000 THEN us END) AS end_us
FROM trip_rows{tag} GROUP BY ALL""",
    )
    part(
        f"summary{tag}",
        (f"day{tag}", f"trips{tag}"),
        f"""
SELECT d.device_id AS vehicle_id, d.day AS summary_date,
  max(CASE WHEN rn = 1 THEN latitude END) AS start_latitude, max(CASE WHEN rn = 1 THEN longitude END) AS start_longitude,
  max(CASE WHEN back = 1 THEN latitude END) AS end_latitude, max(CASE WHEN back = 1 THEN longitude END) AS end_longitude,
  max(CASE WHEN back = 1 THEN odometer END) - max(CASE WHEN rn = 1 THEN odometer END) AS total_distance_km,
  CAST(sum(CASE WHEN rn > 1 AND st IN (2, 3) THEN us - prev_us ELSE 0 END) AS DOUBLE) / 3.6e9 AS total_operational_hours,
  any_value(t.n) AS trip_count,
  max(CASE WHEN rn = 1 THEN fuel_gauge END) - max(CASE WHEN back = 1 THEN fuel_gauge END) AS fuel_consumed_liters
FROM day{tag} d JOIN (SELECT device_id, day, count(end_us) AS n FROM trips{tag} GROUP BY ALL) t USING (device_id, day)
GROUP BY d.device_id, d.day""",
    )


summary_parts("", "gps")
summary_parts("_raw", "gps_clean")
part("gps_afternoon", ("gps",), "SELECT * FROM gps WHERE hour(timestamp) >= 12")
summary_parts("_afternoon", "gps_afternoon")

# Idling



def episode_part(tag: str, source: str) -> None:
    part(
        f"episodes{tag}",
        (source,),
        f"""
SELECT asset_id, CAST(make_timestamp(start_us) AS DATE) AS date, (end_us - start_us) / 6e7 AS minutes,
  latitude, longitude, make_timestamp(start_us) AS start_time, make_timestamp(end_us) AS end_time
FROM (SELECT device_id AS asset_id, run, min(us) AS start_us, max(us) AS end_us,
    arg_min(latitude, rn) AS latitude, arg_min(longitude, rn) AS longitude, max(rn) AS last_rn, any_value(newest) AS newest
  FROM (SELECT *, max(CASE WHEN NOT idle THEN rn END) OVER (PARTITION BY device_id) AS newest,
          coalesce(max(CASE WHEN NOT idle THEN rn END) OVER (PARTITION BY device_id ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS run
        FROM (SELECT *, power_on AND speed = 0 AS idle, epoch_us(timestamp) AS us,
                row_number() OVER (PARTITION BY device_id ORDER BY timestamp, ingest_seq) AS rn FROM {source}))
  WHERE idle GROUP BY device_id, run)
WHERE newest > last_rn""",
    )


episode_part("", "gps")
episode_part("_raw", "gps_clean")
EPISODE = "SELECT asset_id, date, minutes AS idle_duration_minutes, latitude, longitude, start_time, end_time FROM episodes"


def geohash_sql(precision: int) -> str:
    lon_bits, lat_bits = (5 * precision + 1) // 2, 5 * precision // 2

    def cell(value: str, low: str, span: str, bits: int) -> str:
        return f"least(greatest(CAST(ceil(({value} - ({low})) / {span} * {float(1 << bits)}e0) AS BIGINT) - 1, 0), {(1 << bits) - 1})"

    lon, lat = cell("longitude", "-180e0", "360e0", lon_bits), cell("latitude", "-90e0", "180e0", lat_bits)
    letters = []
    for c in range(precision):
        bits = []
        for i in range(5):
            at = 5 * c + i
            axis, left = (lon, lon_bits) if at % 2 == 0 else (lat, lat_bits)
            bits.append(f"((({axis}) >> {left - 1 - at // 2}) & 1) * {1 << (4 - i)}")
        letters.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST({' + '.join(bits)} + 1 AS INTEGER), 1)")
    return " || ".join(letters)


def grid_sql(step: str, decimals: int) -> str:
    def near(value: str) -> str:
        return f"printf('%.{decimals}f', CAST(round_even({value} / {step}, 0) AS BIGINT) * {step})"

    return f"{near('latitude')} || '_' || {near('longitude')}"


def hotspot_sql(key: str, source: str, shown: int | None = None) -> str:
    ids = "list_sort(list(DISTINCT asset_id))"
    ids = f"{ids}[1:{shown}]" if shown else ids
    return f"""
SELECT {key} AS location_identifier, count(*) AS total_idle_incidents, round(sum(minutes), 9) AS total_idle_duration_minutes,
  array_to_string({ids}, ',') AS contributing_asset_ids_sample
FROM {source} GROUP BY 1"""


# Faults


def fault_parts(tag: str, source: str) -> None:
    # Part by part in order of arrival; whatever ends a fault, its parts are forgotten.
    part(
        f"fault_arrivals{tag}",
        (source,),
        f"""
SELECT *, row_number() OVER (PARTITION BY device_id, fault_code, timestamp ORDER BY ingest_seq, sequence, fault_bits) AS rn,
  {{'s': sequence, 'b': fault_bits}} AS one
FROM {source}""",
    )
    part(
        f"fault_fold{tag}",
        (f"fault_arrivals{tag}",),
        f"""
SELECT device_id, fault_code, timestamp, rn, ingest_seq, total_number AS total, [one] AS held, 1 >= total_number AS ended
FROM fault_arrivals{tag} WHERE rn = 1
UNION ALL
SELECT device_id, fault_code, timestamp, rn, ingest_seq, total_number, held, len(held) >= total_number
FROM (SELECT a.device_id, a.fault_code, a.timestamp, a.rn, a.ingest_seq, a.total_number,
        list_append(CASE WHEN f.ended THEN [] ELSE [p for p in f.held if p.s <> a.sequence] END, a.one) AS held
      FROM fault_fold{tag} f JOIN fault_arrivals{tag} a ON a.device_id = f.device_id AND a.fault_code = f.fault_code
        AND a.timestamp = f.timestamp AND a.rn = f.rn + 1)""",
    )
    part(
        f"fault_all{tag}",
        (f"fault_fold{tag}",),
        f"""
SELECT device_id, fault_code, timestamp, ingest_seq AS ended_seq, len(held) AS received,
  len([p for p in held if p.s >= 100]) AS ignored, total,
  CASE WHEN NOT ended THEN 'pending' WHEN len(used) = total THEN 'complete' ELSE 'error' END AS status,
  array_to_string([p.b for p in used], '') AS fault_payload,
  array_to_string([printf('%02X', CAST('0b' || p.b AS INTEGER)) for p in used], '') AS payload_hex
FROM (SELECT *, list_sort([p for p in held if p.s < total]) AS used,
        row_number() OVER (PARTITION BY device_id, fault_code, timestamp ORDER BY rn DESC) = 1 AS newest
      FROM fault_fold{tag})
WHERE ended OR newest""",
    )
    part(
        f"fault_done{tag}",
        (f"fault_all{tag}",),
        f"SELECT device_id, fault_code, timestamp, ended_seq, fault_payload, payload_hex FROM fault_all{tag} WHERE status = 'complete'",
    )
    part(
        f"fault_stored{tag}",
        (f"fault_done{tag}", "known", "code_labels"),
        f"SELECT * FROM fault_done{tag} JOIN known USING (device_id) JOIN code_labels USING (fault_code)",
    )
    for kind in ("done", "stored"):
        part(
            f"fault_order_{kind}{tag}",
            (f"fault_{kind}{tag}",),
            f"""
SELECT *, epoch_us(timestamp) AS us, CAST('0x' || right(payload_hex, 4) AS BIGINT) * 1000000 AS cooldown,
  row_number() OVER (PARTITION BY fault_code ORDER BY timestamp, device_id, ended_seq) AS rn FROM fault_{kind}{tag}""",
        )
        part(
            f"fault_walk_{kind}{tag}",
            (f"fault_order_{kind}{tag}",),
            f"""
SELECT fault_code, rn, FALSE AS suppressed, CASE WHEN cooldown > 0 THEN us + cooldown ELSE 0 END AS until
FROM fault_order_{kind}{tag} WHERE rn = 1
UNION ALL
SELECT o.fault_code, o.rn, o.us < w.until, CASE WHEN o.us >= w.until AND o.cooldown > 0 THEN o.us + o.cooldown ELSE w.until END
FROM fault_walk_{kind}{tag} w JOIN fault_order_{kind}{tag} o ON o.fault_code = w.fault_code AND o.rn = w.rn + 1""",
        )
        part(
            f"fault_marked_{kind}{tag}",
            (f"fault_order_{kind}{tag}", f"fault_walk_{kind}{tag}"),
            f"SELECT o.*, w.suppressed FROM fault_order_{kind}{tag} o JOIN fault_walk_{kind}{tag} w USING (fault_code, rn)",
        )


fault_parts("", "faults")
fault_parts("_raw", "faults_named")

# Alerts

part("named_gps", ("gps", "known"), "SELECT * FROM gps JOIN known USING (device_id)")
GPS_DATA = f"""'{{"device_id":"' || device_id || '","timestamp":"' || {iso('epoch_us(timestamp)')} || '","speed":' || CAST(speed AS VARCHAR)
  || ',"odometer":' || CAST(odometer AS VARCHAR) || ',"power_on":' || CAST(power_on AS VARCHAR) || ',"latitude":' || CAST(latitude AS VARCHAR)
  || ',"longitude":' || CAST(longitude AS VARCHAR) || ',"fuel_gauge":' || CAST(fuel_gauge AS VARCHAR)
  || ',"device_name":"' || device_name || '"}}'"""
FAULT_DATA = f"""'{{"device_id":"' || device_id || '","device_name":"' || device_name || '","timestamp":"' || {iso('epoch_us(timestamp)')}
  || '","fault_payload":"' || to_base64(unhex(payload_hex)) || '","fault_code":"' || fault_code || '","fault_label":"' || fault_label || '"}}'"""


def body_sql(event_type: str, data: str) -> str:
    return f"""'{{"event_type":"{event_type}","device_id":"' || device_id || '","device_name":"' || device_name
  || '","timestamp":"' || {iso('epoch_us(timestamp)')} || '","data":' || {data} || '}}'"""


CODES = str([str(code) for code in range(1, 101)])
CODES_SQL = CODES.replace("'", "''")
FAULT_MATCH = "TRY_CAST(fault_code AS INTEGER) BETWEEN 1 AND 100"
FAULT_LETTER = f"""'example@gmail.com' AS "to", 'Alert: fault [fault_code=' || fault_code || ' (threshold={CODES_SQL})]' AS subject,
  {body_sql('fault', FAULT_DATA)} AS body"""
GPS_LETTER = f"""'example@gmail.com' AS "to", 'Alert: gps [speed=' || CAST(speed AS VARCHAR) || ' (threshold=70.0)]' AS subject,
  {body_sql('gps', GPS_DATA)} AS body"""
ENVELOPE_TIME = iso("epoch_us(timestamp)")


def half_even(x: str) -> str:
    """Round to two decimals by the exact value of the double, ties to even."""
    exact = f"""CASE WHEN s - floor(s) = 0.5 AND r > 0 THEN floor(s) + 1 WHEN s - floor(s) = 0.5 AND r < 0 THEN floor(s)
    ELSE round_even(s, 0) END / 1e2"""
    return f"""(SELECT {exact} FROM (SELECT hi * 1e2 + lo * 1e2 AS s, (hi * 1e2 - (hi * 1e2 + lo * 1e2)) + lo * 1e2 AS r
    FROM (SELECT hi, x - hi AS lo FROM (SELECT x, x * 134217729e0 - (x * 134217729e0 - x) AS hi FROM (SELECT {x} AS x)))))"""


def utilization_sql(actual: str, target: float, shown: str, met: str, source: str = "summary") -> str:
    score = f"(CASE WHEN {actual} = 0 THEN 0e0 ELSE {actual} / {target}e0 END)"
    return f"""SELECT vehicle_id AS asset_id, summary_date, {actual} AS {shown}, {score} >= 1e0 AS {met},
  {half_even(f'least({score}, 1e0)')} AS utilization_score_primary FROM {source}"""


def period_sql(kind: str, source: str, per_asset: bool) -> str:
    start = f"CAST(date_trunc('{kind}', summary_date) AS DATE)"
    end = "period_start + 6" if kind == "week" else "last_day(period_start)"
    days = "7" if kind == "week" else "day(last_day(period_start))"
    ratio = "CASE WHEN sum(fuel) > 0 THEN round(sum(km) / sum(fuel), 6) END"
    rows = f"""(SELECT vehicle_id, {start} AS period_start, total_distance_km AS km, total_operational_hours AS hours,
    fuel_consumed_liters AS fuel FROM {source})"""
    if per_asset:
        return f"""SELECT period_start, CAST({end} AS DATE) AS period_end, vehicle_id AS asset_id, round(sum(km), 6) AS total_traveled_km,
  round(sum(hours), 10) AS total_operational_hours, {ratio} AS km_per_liter FROM {rows} GROUP BY period_start, vehicle_id"""
    return f"""SELECT period_start, CAST({end} AS DATE) AS period_end, round(sum(km), 6) AS total_traveled_km_fleet,
  round(sum(hours) / ({days} * count(DISTINCT vehicle_id)), 6) AS average_operational_hours_per_asset_per_day,
  {ratio} AS overall_km_per_liter_fleet FROM {rows} GROUP BY period_start"""


LISTED = ", ".join(f"'{a}'" for a in ASSETS)
part("chosen", ("summary",), f"SELECT * FROM summary WHERE summary_date {DATES}")
part("chosen_assets", ("chosen",), f"SELECT * FROM chosen WHERE vehicle_id IN ({LISTED})")
part("chosen_page", ("chosen",), "SELECT * FROM chosen ORDER BY summary_date, vehicle_id LIMIT 200 OFFSET 400")
part(
    "utilization_page",
    ("chosen",),
    "SELECT * FROM chosen ORDER BY total_distance_km DESC NULLS FIRST, vehicle_id, summary_date LIMIT 50 OFFSET 50",
)
part(
    "episode_page",
    ("episodes",),
    f"SELECT * FROM episodes WHERE date {DATES} AND minutes >= 1 ORDER BY date, asset_id, start_time LIMIT 100 OFFSET 100",
)
part(
    "changes",
    ("gps",),
    """
SELECT device_id AS vehicle_id, CAST(timestamp AS DATE) AS summary_date, count(*) AS n, sum(speed) AS km
FROM gps WHERE speed > 50 GROUP BY ALL""",
)
part(
    "rejected",
    ("raw_gps", "gps_decoded", "gps_ranked", "gps_first", "known"),
    """
SELECT body, ingest_seq, 'gps' AS routing_key, reject_reason FROM raw_gps JOIN (
  SELECT ingest_seq, reject_reason FROM gps_decoded WHERE reject_reason IS NOT NULL
  UNION ALL SELECT ingest_seq, 'duplicate' FROM gps_ranked WHERE arrival > 1
  UNION ALL SELECT ingest_seq, 'unknown_device' FROM gps_first ANTI JOIN known USING (device_id)) USING (ingest_seq)""",
)
part(
    "faults_refused",
    ("faults_decoded", "known"),
    """
SELECT body, ingest_seq, 'fault' AS routing_key, coalesce(reject_reason, 'unknown_device') AS reject_reason
FROM faults_decoded d LEFT JOIN known k USING (device_id) WHERE reject_reason IS NOT NULL OR k.device_name IS NULL""",
)
part(
    "faults_rejected",
    ("fault_all_raw", "code_labels"),
    """
SELECT device_id, fault_code, timestamp, received, total,
  CASE WHEN status = 'error' THEN 'assembly' ELSE 'unknown_label' END AS reject_reason
FROM fault_all_raw LEFT JOIN code_labels USING (fault_code)
WHERE status = 'error' OR (status = 'complete' AND fault_label IS NULL)""",
)
part(
    "routed",
    ("raw_gps", "raw_faults"),
    """
SELECT ingest_seq, CASE WHEN ingest_seq % 13 = 0 THEN 'status' ELSE k END AS routing_key
FROM (SELECT ingest_seq, 'gps' AS k FROM raw_gps UNION ALL SELECT ingest_seq, 'fault' FROM raw_faults)""",
)

SUMMARY_COLUMNS = """vehicle_id, summary_date, start_latitude, start_longitude, end_latitude, end_longitude,
  total_distance_km, total_operational_hours, trip_count, fuel_consumed_liters"""
RULE_TESTS = {
    "device_id": "length(device_id) >= 1",
    "timestamp": "timestamp IS NOT NULL",
    "power_on": "power_on IS NOT NULL",
    "speed": "speed >= 0",
    "odometer": "odometer >= 0",
    "latitude": "latitude IS NOT NULL",
    "longitude": "longitude IS NOT NULL",
    "fuel_gauge": "fuel_gauge IS NOT NULL",
}
BROKEN = " UNION ALL ".join(
    f"SELECT '{name}' AS rule FROM gps_decoded WHERE NOT coalesce({ok}, FALSE)" for name, ok in RULE_TESTS.items()
)

ORACLE: dict[str, str] = {
    "src_gps_decode": build("SELECT * FROM gps_good", "gps_good"),
    "src_fault_decode": build("SELECT * FROM faults_good", "faults_good"),
    "route_events": build(
        """SELECT CASE WHEN routing_key IN ('gps', 'fault') THEN routing_key ELSE 'unknown_route' END AS route, count(*) AS messages
FROM routed GROUP BY 1""",
        "routed",
    ),
    "unrouted_events": build(
        "SELECT ingest_seq, routing_key, 'unknown_route' AS reject_reason FROM routed WHERE routing_key = 'status'", "routed"
    ),
    "sink_gps_events": build("SELECT *, CAST(timestamp AS DATE) AS event_date FROM named_gps", "named_gps"),
    "sink_fault_events": build("SELECT *, CAST(timestamp AS DATE) AS event_date FROM fault_stored", "fault_stored"),
    "sink_idling": build(EPISODE, "episodes"),
    "upsert_daily_summary": build(
        """SELECT vehicle_id, summary_date, coalesce(e.start_latitude, s.start_latitude) AS start_latitude,
  coalesce(e.start_longitude, s.start_longitude) AS start_longitude, s.end_latitude, s.end_longitude, s.total_distance_km,
  s.total_operational_hours, s.trip_count, s.fuel_consumed_liters
FROM summary s LEFT JOIN summary_afternoon e USING (vehicle_id, summary_date)""",
        "summary",
        "summary_afternoon",
    ),
    "validate_events": build(f"SELECT rule, count(*) AS messages FROM ({BROKEN}) GROUP BY rule", "gps_decoded"),
    "reject_counts": build("SELECT reject_reason, count(*) AS messages FROM rejected GROUP BY reject_reason", "rejected"),
    "reject_counts_in_passing": build(
        "SELECT reject_reason, count(*) AS messages FROM rejected GROUP BY reject_reason", "rejected"
    ),
    "quarantine": build("SELECT * FROM rejected", "rejected"),
    "fault_quarantine": build("SELECT * FROM faults_refused", "faults_refused"),
    "fault_reject_counts": build(
        """SELECT reject_reason, count(*) AS refused FROM (SELECT reject_reason FROM faults_refused
UNION ALL SELECT reject_reason FROM faults_rejected) GROUP BY reject_reason""",
        "faults_refused",
        "faults_rejected",
    ),
    "alert_envelope_parse": build(
        f"""SELECT CASE WHEN bad THEN 'bad field: device_name' END AS error, CASE WHEN NOT bad THEN 'gps' END AS event_type,
  CASE WHEN NOT bad THEN device_id END AS device_id, CASE WHEN NOT bad THEN device_name END AS device_name,
  CASE WHEN NOT bad THEN {ENVELOPE_TIME} END AS timestamp, CASE WHEN NOT bad THEN speed END AS speed,
  CASE WHEN NOT bad THEN power_on END AS power_on
FROM (SELECT *, floor(odometer) % 10 = 7 AS bad FROM named_gps)""",
        "named_gps",
    ),
    "enrich_device": build("SELECT * FROM named_gps", "named_gps"),
    "unknown_devices": build(
        "SELECT device_id, timestamp, ingest_seq, 'unknown_device' AS reject_reason FROM gps ANTI JOIN known USING (device_id)",
        "gps",
        "known",
    ),
    "device_exists": build("SELECT device_id FROM devices SEMI JOIN gps USING (device_id)", "devices", "gps"),
    "enrich_fault_label": build(
        "SELECT device_id, fault_code, timestamp, fault_payload, fault_label FROM fault_done JOIN code_labels USING (fault_code)",
        "fault_done",
        "code_labels",
    ),
    "unlabelled_faults": build(
        """SELECT device_id, fault_code, timestamp, fault_payload, 'unknown_label' AS reject_reason
FROM fault_done ANTI JOIN code_labels USING (fault_code)""",
        "fault_done",
        "code_labels",
    ),
    "dedup_gps": build("SELECT * FROM gps_first", "gps_first"),
    "gps_by_day": build(
        """SELECT * FROM gps WHERE device_id = 'truck_7' AND timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-11'""",
        "gps",
    ),
    "engine_state": build(
        """SELECT device_id, timestamp, CASE WHEN NOT power_on THEN 'ENGINE_OFF' WHEN speed = 0 THEN 'ENGINE_ON_STATIONARY'
  ELSE 'ENGINE_MOVING' END AS engine_state FROM gps""",
        "gps",
    ),
    "trips": build(
        """SELECT device_id, day AS summary_date, make_timestamp(trip_us) AS start_time, make_timestamp(end_us) AS end_time,
  (end_us - trip_us) / 3.6e9 AS operational_hours FROM trips WHERE end_us IS NOT NULL""",
        "trips",
    ),
    "trip_counts": build("SELECT vehicle_id, summary_date, trip_count FROM summary", "summary"),
    "trip_counts_as_run": build("SELECT vehicle_id, summary_date, CAST(0 AS BIGINT) AS trip_count FROM summary", "summary"),
    "daily_summary": build("SELECT * FROM summary", "summary"),
    "daily_summary_sliced": build("SELECT * FROM summary", "summary"),
    "daily_state": build(
        """SELECT device_id AS vehicle_id, day AS summary_date, odometer, fuel_gauge,
  CASE WHEN rn = 1 OR st = 1 THEN 'ENGINE_OFF' WHEN st = 2 THEN 'ENGINE_ON_STATIONARY' ELSE 'ENGINE_MOVING' END AS state,
  CASE WHEN t.end_us IS NULL THEN make_timestamp(r.trip_us) END AS last_moving_time, timestamp AS last_event_time,
  CASE WHEN t.end_us IS NULL THEN make_timestamp(r.trip_us) END AS trip_start_time
FROM trip_rows r LEFT JOIN trips t USING (device_id, day, trip_rn) WHERE back = 1""",
        "trip_rows",
        "trips",
    ),
    "summary_by_key": build(
        "SELECT * FROM summary WHERE vehicle_id = 'truck_7' AND summary_date = DATE '2024-01-10'", "summary"
    ),
    "apply_increments": build(
        """SELECT vehicle_id, summary_date, start_latitude, start_longitude, end_latitude, end_longitude,
  round(total_distance_km + coalesce(km, 0), 6) AS total_distance_km,
  total_operational_hours + coalesce(n * 10 / 3.6e3, 0) AS total_operational_hours,
  trip_count + coalesce(n, 0) AS trip_count, fuel_consumed_liters
FROM summary LEFT JOIN changes USING (vehicle_id, summary_date)""",
        "summary",
        "changes",
    ),
    "idling_episodes": build(EPISODE, "episodes"),
    "idling_episodes_sliced": build(EPISODE, "episodes"),
    "idling_filter": build(f"{EPISODE} WHERE date {DATES} AND minutes >= 10", "episodes"),
    "hotspots_rounded": build(hotspot_sql(grid_sql("0.01e0", 2), "episodes"), "episodes"),
    "hotspots_geohash": build(hotspot_sql(geohash_sql(5), "episodes", 5), "episodes"),
    "hotspots_paged": build(hotspot_sql(grid_sql("0.1e0", 1), "episode_page"), "episode_page"),
    "hotspot_shares": build(
        f"""SELECT {grid_sql('0.25e0', 2)} AS location_identifier, asset_id, count(*) AS incidents, round(sum(minutes), 9) AS minutes
FROM episodes GROUP BY 1, 2""",
        "episodes",
    ),
    "device_day_stats": build(
        """SELECT device_id, CAST(timestamp AS DATE) AS date, arg_max(odometer, timestamp) - arg_min(odometer, timestamp) AS total_distance_km,
  (arg_max(odometer, timestamp) - arg_min(odometer, timestamp)) * 0.621371e0 AS total_distance_miles,
  round(avg(speed), 9) AS average_speed FROM gps GROUP BY 1, 2""",
        "gps",
    ),
    "utilization_distance": build(
        utilization_sql("total_distance_km", TARGET_KM, "actual_traveled_km", "target_km_met"), "summary"
    ),
    "utilization_hours": build(
        utilization_sql("total_operational_hours", TARGET_HOURS, "actual_operational_hours", "target_hours_met"), "summary"
    ),
    "utilization_sorted_page": build(
        utilization_sql("total_distance_km", TARGET_KM, "actual_traveled_km", "target_km_met", "utilization_page"),
        "utilization_page",
    ),
    "summary_next_page": build(
        """SELECT * FROM summary WHERE total_distance_km < 150 OR (total_distance_km = 150 AND
  (vehicle_id > 'truck_5' OR (vehicle_id = 'truck_5' AND summary_date > DATE '2024-01-10')))
ORDER BY total_distance_km DESC NULLS FIRST, vehicle_id, summary_date LIMIT 50""",
        "summary",
    ),
    "page_counts": build(
        "SELECT count(*) AS total_records, CAST(ceil(count(*) / 2e1) AS BIGINT) AS total_pages FROM chosen", "chosen"
    ),
    "efficiency_daily": build(
        """SELECT vehicle_id AS asset_id, summary_date, total_distance_km AS traveled_km,
  total_operational_hours AS operational_hours, fuel_consumed_liters,
  CASE WHEN fuel_consumed_liters > 0 THEN total_distance_km / fuel_consumed_liters ELSE 0e0 END AS km_per_liter FROM chosen""",
        "chosen",
    ),
    "efficiency_weekly_fleet": build(period_sql("week", "chosen", False), "chosen"),
    "efficiency_weekly_asset": build(period_sql("week", "chosen_assets", True), "chosen_assets"),
    "efficiency_monthly_fleet": build(period_sql("month", "chosen", False), "chosen"),
    "efficiency_monthly_asset": build(period_sql("month", "chosen_assets", True), "chosen_assets"),
    "efficiency_paged": build(period_sql("week", "chosen_page", False), "chosen_page"),
    "fault_status": build(
        "SELECT device_id, fault_code, timestamp, ended_seq, received, ignored, total, status FROM fault_all", "fault_all"
    ),
    "fault_events": build("SELECT * FROM fault_done", "fault_done"),
    "fault_suppression": build(
        "SELECT device_id, fault_code, timestamp, suppressed FROM fault_marked_done", "fault_marked_done"
    ),
    "fault_suppression_sliced": build(
        "SELECT device_id, fault_code, timestamp, suppressed FROM fault_marked_done", "fault_marked_done"
    ),
    "alert_fan_in": build(
        f"""SELECT 'gps' AS event_type, device_id, device_name, {ENVELOPE_TIME} AS timestamp, {GPS_DATA} AS data FROM named_gps
UNION ALL SELECT 'fault', device_id, device_name, {ENVELOPE_TIME}, {FAULT_DATA} FROM fault_stored""",
        "named_gps",
        "fault_stored",
    ),
    "alert_matches": build(
        f"""SELECT 'gps' AS event_type, device_id, device_name, {ENVELOPE_TIME} AS timestamp FROM named_gps WHERE speed >= 70
UNION ALL SELECT 'fault', device_id, device_name, {ENVELOPE_TIME} FROM fault_stored WHERE {FAULT_MATCH}""",
        "named_gps",
        "fault_stored",
    ),
    "alert_matches_parsed": build(
        """SELECT 'night@example.com' AS "to", 'Alert: gps [speed=' || CAST(speed AS VARCHAR) || ' (threshold=20.0), power_on=True (threshold=True)]' AS subject
FROM named_gps WHERE speed >= 20 AND power_on
UNION ALL SELECT 'yard@example.com', 'Alert: ' || kind || ' [device_id=' || device_id || ' (threshold=[''truck_1'', ''truck_2''])]'
FROM (SELECT 'gps' AS kind, device_id FROM named_gps UNION ALL SELECT 'fault', device_id FROM fault_stored)
WHERE device_id IN ('truck_1', 'truck_2')
UNION ALL SELECT 'code@example.com', 'Alert: fault [fault_code=5 (threshold=5)]' FROM fault_stored WHERE fault_code = '5'""",
        "named_gps",
        "fault_stored",
    ),
    "alert_notifications": build(
        f"SELECT {GPS_LETTER} FROM named_gps WHERE speed >= 70", "named_gps"
    ),
    "alert_rule_table": build(
        f"""SELECT "to", count(*) AS letters, min(body) AS first_body FROM (
  SELECT CAST(c_custkey AS VARCHAR) || '@example.com' AS "to", {body_sql('gps', GPS_DATA)} AS body
  FROM named_gps JOIN customer ON
    (c_custkey % 50 = 0 AND speed >= c_custkey % 83 + 40)
    OR (c_custkey % 50 <> 0 AND speed >= c_custkey % 83 AND device_id = 'truck_' || (c_custkey % 100)))
GROUP BY "to\"""",
        "named_gps",
    ),
    "alert_path": build(
        f"SELECT {FAULT_LETTER} FROM fault_marked_stored WHERE NOT suppressed AND {FAULT_MATCH}", "fault_marked_stored"
    ),
    "gps_path": build(f"SELECT {SUMMARY_COLUMNS} FROM summary_raw", "summary_raw"),
    "gps_path_events": build("SELECT * FROM gps_clean", "gps_clean"),
    "gps_path_quarantine": build("SELECT * FROM rejected", "rejected"),
    "gps_path_episodes": build(EPISODE + "_raw", "episodes_raw"),
    "gps_path_notifications": build(f"SELECT {GPS_LETTER} FROM gps_clean WHERE speed >= 70", "gps_clean"),
    "fault_path_events": build("SELECT *, CAST(timestamp AS DATE) AS event_date FROM fault_stored_raw", "fault_stored_raw"),
    "fault_path_status": build(
        "SELECT device_id, fault_code, timestamp, ended_seq, received, ignored, total, status FROM fault_all_raw", "fault_all_raw"
    ),
    "fault_path_rejected": build("SELECT * FROM faults_rejected", "faults_rejected"),
    "fault_path": build(
        f"SELECT {FAULT_LETTER} FROM fault_marked_stored_raw WHERE NOT suppressed AND {FAULT_MATCH}",
        "fault_marked_stored_raw",
    ),
}

"""Small random inputs and step-by-step folds to compare against."""

from __future__ import annotations

import datetime as dt
import random

from roadlake.schemas import GPS_EVENT

START = dt.datetime(2024, 5, 20, 6, 0)


def at(seconds: float) -> dt.datetime:
    return START + dt.timedelta(seconds=seconds)


def fixes(rng: random.Random, devices: int, count: int, span: int) -> list[tuple]:
    """Random fixes: distinct seconds per device, long runs of one state."""
    rows = []
    for d in range(devices):
        moving = 0.0
        for i, second in enumerate(sorted(rng.sample(range(span), count))):
            if rng.random() < 0.35:
                moving = rng.choice([0.0, 0.0, 12.5, 80.0])
            power = rng.random() < 0.85
            fuel = 100.0 - (i * 7) % 60
            rows.append((f"dev{d}", at(second), moving, 1000.0 + i, power, 10.0 + i, 100.0 + i, fuel, second))
    rng.shuffle(rows)
    return rows


def gps_frame(spark, rows):
    return spark.createDataFrame(rows, GPS_EVENT)


def state_of(row) -> str:
    if not row.power_on:
        return "OFF"
    return "STATIONARY" if row.speed == 0 else "MOVING"


def fold_days(rows) -> dict:
    """Fix by fix: trips, hours, distance, fuel and positions per (device, day)."""
    days: dict = {}
    trips = []
    for r in sorted(rows, key=lambda r: (r.device_id, r.timestamp, r.ingest_seq)):
        key = (r.device_id, r.timestamp.date())
        if key not in days:
            days[key] = dict(
                start=(r.latitude, r.longitude), end=(r.latitude, r.longitude), km=0.0, fuel=0.0, seconds=0.0,
                trips=0, odometer=r.odometer, gauge=r.fuel_gauge, last=r.timestamp, state="OFF", began=None,
            )
            continue
        day = days[key]
        day["end"] = (r.latitude, r.longitude)
        day["km"] += r.odometer - day["odometer"]
        day["fuel"] += day["gauge"] - r.fuel_gauge
        new = state_of(r)
        if new != day["state"] and new == "MOVING":
            day["began"] = r.timestamp
        if new != "MOVING" and day["began"] and (r.timestamp - day["began"]).total_seconds() >= 300:
            day["trips"] += 1
            trips.append((r.device_id, key[1], day["began"], r.timestamp))
            day["began"] = None
        if new != "OFF":
            day["seconds"] += (r.timestamp - day["last"]).total_seconds()
        day.update(odometer=r.odometer, gauge=r.fuel_gauge, last=r.timestamp, state=new)
    return {"days": days, "trips": sorted(trips)}


def fold_idling(rows) -> list[tuple]:
    held, closed = {}, []
    for r in sorted(rows, key=lambda r: (r.device_id, r.timestamp, r.ingest_seq)):
        if r.power_on and r.speed == 0:
            start = held.get(r.device_id, (r.timestamp, r.latitude, r.longitude))[:3]
            held[r.device_id] = (*start, r.timestamp)
        elif r.device_id in held:
            began, lat, lon, ended = held.pop(r.device_id)
            minutes = (ended - began).total_seconds() / 60
            closed.append((r.device_id, began.date(), minutes, lat, lon, began, ended))
    return sorted(closed)


def fold_cooldown(rows) -> set:
    """Keys of the suppressed rows; rows are (code, device, time, seconds)."""
    until, hidden = {}, set()
    for code, device, time, seconds in sorted(rows, key=lambda r: (r[2], r[1])):
        if code in until and time < until[code]:
            hidden.add((code, device, time))
        elif seconds > 0:
            until[code] = time + dt.timedelta(seconds=seconds)
    return hidden

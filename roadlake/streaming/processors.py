"""State kept per key between micro-batches.

Each processor holds a few numbers per key and walks only the new rows of the
micro-batch, in time order; how many those are is set by the trigger (files or
rates per batch). Times cross into Python as microseconds.
"""

from __future__ import annotations

import datetime as dt
from collections import namedtuple
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roadlake.functions.engine import MOVING, OFF, STATIONARY
from roadlake.functions.times import MICROS
from roadlake.operators.faults import FOLDED, Arrivals
from roadlake.operators.suppression import NEVER, ORDER, walk

DAY_STATE = """
    start_latitude double, start_longitude double, end_latitude double, end_longitude double,
    first_odometer double, odometer double, first_fuel double, fuel double,
    on_us long, trip_count long, last_us long, state int, trip_us long, rows long
"""
SUMMARY_OUTPUT = """
    vehicle_id string, summary_date date, start_latitude double, start_longitude double,
    end_latitude double, end_longitude double, total_distance_km double,
    total_operational_hours double, trip_count long, fuel_consumed_liters double
"""
#: A row is a summary, or, with ``fix_us``, a fix that came too late for one. A summary whose
#: day has late fixes is short of them.
DAY_OUTPUT = f"{SUMMARY_OUTPUT}, late_fixes long, fix_us long, fix_seq long"
FIX_STATE = """
    us long, ingest_seq long, summary_date date, state int, latitude double, longitude double,
    odometer double, fuel_gauge double
"""
Fix = namedtuple("Fix", [field.split()[0] for field in FIX_STATE.split(",")])
DAY_FIELDS = [field.split()[0] for field in DAY_STATE.replace("\n", " ").split(",")]

EPISODE_STATE = "start_us long, end_us long, latitude double, longitude double"
EPISODE_OUTPUT = "asset_id string, start_us long, end_us long, latitude double, longitude double"

PART_OUTPUT = f"device_id string, fault_code string, fault_us long, {FOLDED}"
PART_LIFE_MS = 3600 * 1000


def in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(list(by), kind="stable")


def add_fix(day: dict, fix: object, idle_threshold_us: int) -> None:
    """Fold one fix into the running day; ``day`` already has its first fix."""
    before, day["state"] = day["state"], fix.state
    if fix.state == MOVING and before != MOVING:
        day["trip_us"] = fix.us
    waited = day["trip_us"] is not None and fix.us - day["trip_us"] >= idle_threshold_us
    if fix.state != MOVING and waited:
        day["trip_count"] += 1
        day["trip_us"] = None
    if fix.state in (STATIONARY, MOVING):
        day["on_us"] += fix.us - day["last_us"]
    day.update(end_latitude=fix.latitude, end_longitude=fix.longitude, last_us=fix.us)
    day.update(odometer=fix.odometer, fuel=fix.fuel_gauge, rows=day["rows"] + 1)


def first_fix(fix: object) -> dict:
    return {
        "start_latitude": fix.latitude,
        "start_longitude": fix.longitude,
        "end_latitude": fix.latitude,
        "end_longitude": fix.longitude,
        "first_odometer": fix.odometer,
        "odometer": fix.odometer,
        "first_fuel": fix.fuel_gauge,
        "fuel": fix.fuel_gauge,
        "on_us": 0,
        "trip_count": 0,
        "last_us": fix.us,
        "state": OFF,
        "trip_us": None,
        "rows": 1,
    }


class DayProcessor(StatefulProcessor):
    """Running summaries of one device's days; emits those that a batch changed.

    Fixes are folded in the order of their times. Those younger than ``lateness`` before the
    device's newest fix may still be preceded by others, so they are kept as rows and folded
    into what is emitted, but not into the state. A fix older than that has come too late to
    be folded: it is emitted itself, and its day says from then on how many it lacks. A
    device's days are kept until its fixes have left them behind; no other device's times
    matter, so one that was out of reach loses nothing.
    """

    def __init__(self, idle_threshold: float, lateness_us: int, zone: str) -> None:
        self.idle_threshold_us = int(idle_threshold * MICROS)
        self.lateness_us = lateness_us
        self.zone = zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.settled = handle.getValueState("settled", "us long")
        self.days = handle.getMapState("days", "summary_date date", f"{DAY_STATE}, late long")
        self.recent = handle.getListState("recent", FIX_STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Days that a batch has folded so far (``summary.running_days``)."""
        for day in initialState.to_dict("records"):
            numbers = [None if pd.isna(day[f]) else day[f] for f in DAY_FIELDS]
            whole = {"on_us", "trip_count", "last_us", "state", "trip_us", "rows"}
            numbers = [int(n) if f in whole and n is not None else n for f, n in zip(DAY_FIELDS, numbers)]
            self.days.updateValue((day["summary_date"],), (*numbers, 0))
            held = self.settled.get()
            passed = int(day["last_us"]) + 1
            self.settled.update((passed if held is None else max(passed, held[0]),))

    def _fold(self, day: dict | None, fix: Fix) -> dict:
        if day is None:
            return first_fix(fix)
        add_fix(day, fix, self.idle_threshold_us)
        return day

    def _date_of(self, us: int) -> dt.date:
        return dt.datetime.fromtimestamp(us // MICROS, ZoneInfo(self.zone)).date()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.settled.get()
        passed = None if held is None else held[0]
        days, late = {}, {}
        for (date,), values in self.days.iterator():
            *numbers, late[date] = values
            days[date] = None if numbers[-1] == 0 else dict(zip(DAY_FIELDS, numbers))
        known = set(late)
        fresh = pd.concat(list(rows), ignore_index=True)[list(Fix._fields)]
        fresh = list(fresh.itertuples(index=False, name="Fix"))
        too_late = [f for f in fresh if passed is not None and f.us < passed]
        for fix in too_late:
            late[fix.summary_date] = late.get(fix.summary_date, 0) + 1
        in_time = [f for f in fresh if passed is None or f.us >= passed]
        fixes = sorted([*(Fix(*row) for row in self.recent.get()), *in_time], key=lambda f: f[:2])
        if fixes:
            newest = max(f.us for f in fixes) - self.lateness_us
            passed = newest if passed is None else max(passed, newest)
            self.settled.update((passed,))
        open_fixes = [f for f in fixes if f.us >= passed]
        for fix in fixes[: len(fixes) - len(open_fixes)]:
            days[fix.summary_date] = self._fold(days.get(fix.summary_date), fix)
        running = self._date_of(passed)
        for date in {*days, *late}:
            if date >= running:
                day = days.get(date) or dict.fromkeys(DAY_FIELDS, 0)
                numbers = tuple(day[f] for f in DAY_FIELDS)
                self.days.updateValue((date,), (*numbers, late.get(date, 0)))
            elif date in known:
                self.days.removeKey((date,))
        self.recent.put([tuple(f) for f in open_fixes])
        for fix in open_fixes:
            days[fix.summary_date] = self._fold(days.get(fix.summary_date), fix)
        changed = {f.summary_date for f in fresh}
        found = [self._row(key[0], date, days[date], late.get(date, 0)) for date in changed if days.get(date)]
        found += [self._late_row(key[0], fix) for fix in too_late]
        yield pd.DataFrame(found, columns=[f.split()[0] for f in DAY_OUTPUT.split(",")])

    def _row(self, vehicle: str, date: dt.date, day: dict, late: int) -> tuple:
        return (
            vehicle,
            date,
            *(day[c] for c in DAY_FIELDS[:4]),
            day["odometer"] - day["first_odometer"],
            day["on_us"] / (3600.0 * MICROS),
            day["trip_count"],
            day["first_fuel"] - day["fuel"],
            late,
            None,
            None,
        )

    def _late_row(self, vehicle: str, fix: Fix) -> tuple:
        return (vehicle, fix.summary_date, *[None] * 8, 1, fix.us, fix.ingest_seq)

    def close(self) -> None:
        pass


class IdlingProcessor(StatefulProcessor):
    """The open idling episode of one device; emits it when it closes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", EPISODE_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        episode, closed = self.open.get(), []
        for fix in in_order(rows, "us", "ingest_seq").itertuples():
            if fix.idle:
                start = episode or (fix.us, fix.us, fix.latitude, fix.longitude)
                episode = (start[0], fix.us, start[2], start[3])
            elif episode:
                closed.append((key[0], *episode))
                episode = None
        if episode:
            self.open.update(tuple(episode))
        else:
            self.open.clear()
        if closed:
            yield pd.DataFrame(closed, columns=["asset_id", "start_us", "end_us", "latitude", "longitude"])

    def close(self) -> None:
        pass


class PartsProcessor(StatefulProcessor):
    """Received parts of one fault; emits a row per arrival.

    With fewer parts than the arrival announces, the row has no bits. Otherwise
    it has those numbered below the total, and the parts are forgotten. Parts
    also go an hour after the last arrival.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "sequence int", "bits string")

    def _stop_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = Arrivals(bits={k[0]: v[0] for k, v in self.parts.iterator()})
        fresh, out = {}, []
        for part in in_order(rows, "ingest_seq").itertuples():
            sequence = int(part.sequence)
            said = held.add(sequence, part.fault_bits, int(part.total_number), int(part.ingest_seq))
            fresh[sequence] = held.bits.get(sequence)
            if said[-1] is not None:
                self.parts.clear()
                fresh = {}
            out.append((*key, *said))
        for sequence, text in fresh.items():
            self.parts.updateValue((sequence,), (text,))
        # A new timer does not replace the old one.
        self._stop_timers()
        if held.bits:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + PART_LIFE_MS)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in PART_OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.parts.clear()
        return iter([])

    def close(self) -> None:
        pass


class CooldownProcessor(StatefulProcessor):
    """Until when one fault code is suppressed; emits each fault with its mark."""

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        order = [c for c in ORDER if c in ("us", *self.columns)]
        table = in_order(rows, *order)
        held = self.until.get()
        entry = NEVER if held is None else held[0]
        suppressed, leaving = walk(table["us"].to_numpy(), table["cooldown"].to_numpy(), entry)
        if leaving != NEVER:
            self.until.update((leaving,))
        yield table[self.columns].assign(suppressed=suppressed)

    def close(self) -> None:
        pass

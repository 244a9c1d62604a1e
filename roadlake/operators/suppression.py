"""Cool-down of repeated faults.

The first fault of a code opens a window as long as its payload says; faults inside it
are suppressed and do not extend it. That is a walk in time order per code, and a
handful of codes may hold most faults. So a code is cut into slices of a fixed span of
time, and only the moment up to which a slice is entered suppressed has to be known:

1. a slice, walked once backwards, gives its step function from entry to exit: the first
   fault that is free again decides when the slice is left, and neighbours that leave at the
   same moment are one step;
2. the step functions of ``FAN_IN`` neighbouring slices are composed to that of a block, and
   those of ``FAN_IN`` blocks once more. A block is entered no later than the longest
   cool-down after its start, so steps beyond that are left out, exactly;
3. the few blocks of a code are followed in order; then the entry of each block is followed
   through what it was made of, down to the slices;
4. each slice marks its rows from its entry.

Steps 2 to 4 work on (code, block) or (code, slice) groups, so the largest task holds rows of
one code in one span, or ``FAN_IN`` step functions, whatever the train of faults. Tasks read
in order and hold one batch and the slice it cuts. The number of rounds is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlake.functions.payload import cooldown_seconds
from roadlake.functions.times import MICROS, micros
from roadlake.operators.lookback import with_slice
from roadlake.session import pin

SPAN_SECONDS = 600
ORDER = ("us", "device_id", "fault_code", "ended_seq")
NEVER = np.iinfo(np.int64).min
#: Neighbours that become one block, and how often.
FAN_IN = 256
ROUNDS = 2

Steps = tuple[np.ndarray, np.ndarray]


def walk(us: np.ndarray, cooldown: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
    """Which of the time-ordered rows are suppressed, and until when the last window runs.

    Only rows with a cool-down can open a window, and the row that opens the
    next one is found by bisection, so the loop runs once per opened window.
    """
    able = np.flatnonzero(cooldown > 0)
    times = us[able]
    opened, until = [], [entry]
    at = int(np.searchsorted(times, entry))
    while at < len(able):
        row = able[at]
        opened.append(row)
        until.append(int(us[row]) + int(cooldown[row]) * MICROS)
        at = int(np.searchsorted(times, until[-1]))
    windows_before = np.searchsorted(np.array(opened, dtype=np.int64), np.arange(len(us)))
    return us < np.array(until, dtype=np.int64)[windows_before], until[-1]


@dataclass
class Slices:
    """Whole slices, one after the other, their rows in order."""

    new: np.ndarray
    us: np.ndarray
    cooldown: np.ndarray

    def __post_init__(self) -> None:
        self.number = np.cumsum(self.new) - 1
        self.able = np.flatnonzero(self.cooldown > 0)
        self.times = self.us[self.able]
        self.until = self.times + self.cooldown[self.able].astype(np.int64) * MICROS
        of = self.number[self.able]
        self.ends = np.searchsorted(of, np.arange(self.number[-1] + 1), side="right")
        self.next = self.first_free(of, self.until)

    def first_free(self, slices: np.ndarray, moments: np.ndarray) -> np.ndarray:
        """First row with a cool-down at or after a moment, or the end of its slice's rows."""
        # One line for all slices: each is as long as its longest stay on it.
        starts = self.us[self.new]
        width = max(int((self.us - starts[self.number]).max()), 0) + 2
        of = self.number[self.able]
        places = of * width + (self.times - starts[of])
        asked = slices * width + np.minimum(np.maximum(moments, starts[slices]) - starts[slices], width - 1)
        return np.minimum(np.searchsorted(places, asked), self.ends[slices])

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slice, last entry and moment of leaving of each step.

        An entry after the last of a slice's steps leaves the slice as it came.
        """
        of = self.number[self.able]
        end = self.ends[of]
        ahead, until = self.next, self.until
        # Windows lead to the row that opens the next one; jumps double until none is left.
        while (open_ := ahead < end).any():
            at = np.where(open_, ahead, 0)
            until = np.where(open_, until[at], until)
            ahead = np.where(open_, ahead[at], ahead)
        last = np.ones(len(of), bool)
        last[:-1] = (until[1:] != until[:-1]) | (of[1:] != of[:-1])
        return of[last], self.times[last], until[last]

    def suppressed(self, entries: np.ndarray) -> np.ndarray:
        """Rows inside a window, with the entry of each slice given."""
        opened = np.zeros(len(self.able), bool)
        slices = np.arange(len(entries))
        at = self.first_free(slices, entries)
        while len(at):
            inside = at < self.ends[slices]
            slices, at = slices[inside], at[inside]
            opened[at] = True
            at = self.next[at]
        rows = np.zeros(len(self.us), np.int64)
        rows[self.able[opened]] = np.flatnonzero(opened) + 1
        before = np.concatenate([[0], np.maximum.accumulate(rows)[:-1]]) - 1
        in_slice = (before >= 0) & (self.number[self.able[before]] == self.number) if len(self.able) else before >= 0
        until = entries[self.number]
        until[in_slice] = self.until[before[in_slice]]
        return self.us < until


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    encoded = column.combine_chunks().dictionary_encode()
    return encoded.indices.fill_null(-1).to_numpy()


def _starts(table: pa.Table, key: str) -> np.ndarray:
    new = np.ones(table.num_rows, bool)
    codes, slices = _codes(table[key]), _codes(table["slice"])
    new[1:] = (np.diff(codes) != 0) | (np.diff(slices) != 0)
    return new


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, Slices]]:
    """Tables of whole slices, from rows that come in order."""
    held = None

    def done(table: pa.Table, new: np.ndarray) -> tuple[pa.Table, Slices]:
        return table, Slices(new, table["us"].to_numpy(), table["cooldown"].to_numpy())

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        new = _starts(table, key)
        last = int(np.flatnonzero(new)[-1]) if len(new) else 0
        if last:
            yield done(table.slice(0, last), new[:last])
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield done(held, _starts(held, key))


def compose(first: Steps, second: Steps) -> Steps:
    """Last entry and exit of each step through two neighbours, ``first`` before ``second``."""
    (times, until), (later, leave) = first, second
    at = np.searchsorted(later, until)
    goes_on = at < len(later)
    until = until.copy()
    until[goes_on] = leave[at[goes_on]]
    # Entries after the last step of the first pass it as they came.
    rest = later > times[-1] if len(times) else np.ones(len(later), bool)
    return np.concatenate([times, later[rest]]), np.concatenate([until, leave[rest]])


def within_reach(steps: Steps, latest: int) -> Steps:
    """The steps for entries up to ``latest``, neighbours with one exit as one."""
    times, until = steps
    kept = int(np.searchsorted(times, latest)) + 1
    times, until = times[:kept], until[:kept]
    last = np.ones(len(times), bool)
    last[:-1] = until[1:] != until[:-1]
    return times[last], until[last]


def _step_lists(rows: list[Steps]) -> list[pa.Array]:
    lengths = [len(times) for times, _ in rows]
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    columns = (np.concatenate([r[k] for r in rows] or [np.zeros(0, np.int64)]) for k in range(2))
    return [pa.ListArray.from_arrays(offsets, pa.array(c, pa.int64())) for c in columns]


def _find_steps(key: str):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, slices in _whole(batches, key):
            of, times, until = slices.steps()
            cuts = np.searchsorted(of, np.arange(1, slices.number[-1] + 1))
            steps = list(zip(np.split(times, cuts), np.split(until, cuts), strict=True))
            rows = table.select([key, "slice"]).filter(pa.array(slices.new))
            longest = np.zeros(len(steps), np.int64)
            np.maximum.at(longest, slices.number, slices.cooldown.astype(np.int64) * MICROS)
            for name, values in zip(("times", "until"), _step_lists(steps), strict=True):
                rows = rows.append_column(name, values)
            yield from rows.append_column("longest", pa.array(longest)).to_batches()

    return find


def _steps_of(batch: pa.RecordBatch, row: int) -> Steps:
    return tuple(batch.column(c)[row].values.to_numpy() for c in ("times", "until"))


def _compose_blocks(key: str, span_us: int):
    """Rows (key, block, slice, times, until, longest) in order; one row per block."""

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, steps, longest = None, [], [], []
        for batch in batches:
            keys, blocks, most = (batch.column(c).to_pylist() for c in (key, "block", "longest"))
            for row, name in enumerate(zip(keys, blocks, strict=True)):
                if not names or name != names[-1]:
                    names.append(name)
                    longest.append(most[row])
                    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    steps.append(held)
                latest = name[1] * span_us + most[row]
                steps[-1] = within_reach(compose(steps[-1], _steps_of(batch, row)), latest)
        if names:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([n[0] for n in names], batch.schema.field(key).type),
                    pa.array([n[1] for n in names], pa.int64()),
                    *_step_lists(steps),
                    pa.array(longest, pa.int64()),
                ],
                names=[key, "slice", "times", "until", "longest"],
            )

    return put_together


def _follow(key: str):
    """Entry of each slice; rows come by key, block and slice, with the entry of the block."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entry = None, NEVER
        for batch in batches:
            keys, blocks, starts = (batch.column(c).to_pylist() for c in (key, "block", "start"))
            entries = []
            for row, name in enumerate(zip(keys, blocks, strict=True)):
                if name != now:
                    now, entry = name, starts[row]
                entries.append(entry)
                times, until = _steps_of(batch, row)
                step = int(np.searchsorted(times, entry))
                if step < len(times):
                    entry = int(until[step])
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("slice"), pa.array(entries, pa.int64())],
                names=[key, "slice", "entry"],
            )

    return follow


def _mark(key: str):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, slices in _whole(batches, key):
            entries = table["entry"].to_numpy()[slices.new]
            kept = table.drop_columns(["us", "cooldown", "slice", "entry"])
            marked = kept.append_column("suppressed", pa.array(slices.suppressed(entries)))
            yield from marked.combine_chunks().to_batches()

    return mark


def mark_suppressed(
    faults: DataFrame, key: str = "fault_code", span_seconds: int = SPAN_SECONDS
) -> DataFrame:
    """Add ``suppressed`` to assembled faults (``timestamp``, ``payload_bytes``, ``key``).

    The faults are read twice, so costly ones are better stored first. The step functions,
    one row per slice, are written to the shared folder.
    """
    rows = faults.withColumn("us", micros(F.col("timestamp"))).withColumn(
        "cooldown", cooldown_seconds(F.col("payload_bytes"))
    )
    rows = with_slice(rows, "us", span_seconds)
    slice_key = [rows.schema[key], T.StructField("slice", T.LongType())]
    longs = T.ArrayType(T.LongType())
    functions = [T.StructField("times", longs), T.StructField("until", longs)]
    step_schema = T.StructType([*slice_key, *functions, T.StructField("longest", T.LongType())])
    entry_schema = T.StructType([*slice_key, T.StructField("entry", T.LongType())])
    order = list(dict.fromkeys([key, "slice", *(c for c in ORDER if c in rows.columns)]))

    def in_blocks(table: DataFrame, block: Column) -> DataFrame:
        ordered = table.withColumn("block", block).repartition(key, "block")
        return ordered.sortWithinPartitions(key, "block", "slice")

    def meet(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
        """``left`` with the columns of ``right``, which has one row per ``names``."""
        renamed = right.withColumnsRenamed({c: f"own_{c}" for c in names})
        same = [left[c].eqNullSafe(renamed[f"own_{c}"]) for c in names]
        return left.join(renamed, same).drop(*(f"own_{c}" for c in names))

    ordered = rows.select(*order, "cooldown").repartition(key, "slice").sortWithinPartitions(*order)
    steps = pin(ordered.mapInArrow(_find_steps(key), step_schema), "steps")
    longest = steps.groupBy(key).agg(F.max("longest").alias("longest"))
    levels = [meet(steps.drop("longest"), longest, [key])]
    above = F.floor(F.col("slice") / FAN_IN)
    span_us = span_seconds * MICROS
    for _ in range(ROUNDS):
        span_us *= FAN_IN
        blocks = in_blocks(levels[-1], above).mapInArrow(_compose_blocks(key, span_us), step_schema)
        levels.append(pin(blocks, "steps"))
    # Of a code's last blocks, each longer than a year, there are a few.
    top = in_blocks(levels.pop(), F.lit(0).cast("long")).withColumn("start", F.lit(int(NEVER)))
    entries = top.mapInArrow(_follow(key), entry_schema)
    while levels:
        starts = entries.withColumnsRenamed({"slice": "block", "entry": "start"})
        inside = meet(levels.pop().withColumn("block", above), starts, [key, "block"])
        entries = in_blocks(inside, F.col("block")).mapInArrow(_follow(key), entry_schema)
    entered = meet(rows, entries, [key, "slice"])
    entered = entered.select(*faults.columns, "us", "cooldown", "slice", "entry")
    schema = T.StructType([*faults.schema.fields, T.StructField("suppressed", T.BooleanType())])
    ordered = entered.repartition(key, "slice").sortWithinPartitions(*order)
    return ordered.mapInArrow(_mark(key), schema)


def unsuppressed(faults: DataFrame, **options: object) -> DataFrame:
    return mark_suppressed(faults, **options).where(~F.col("suppressed")).drop("suppressed")

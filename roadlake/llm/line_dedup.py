"""Drop repeated lines by probing perfect-hashed arrays.

The distinct line hashes are dealt to shards of bounded size. A shard is a minimal
perfect hash with three compact arrays by slot: fingerprint, number of documents,
smallest document. Documents send blocks of line hashes, never lines, to the shards
and get back the positions to drop; a line is never joined with a line.

Lines so frequent that they hold more than ``1 / HOT_PARTS`` of all lines are fewer
than ``HOT_PARTS``; every task gets them in one such table of its own, with whole
hashes for fingerprints as every line asks it. Of a shard that is asked for more than
``SHARD_PROBES`` lines there are as many copies as it takes, which share the asking.

Nulls and ties: a null or empty text is one empty line. Rows with one document id
are one document; a null id counts as a document after all others. Repeated rows
give repeated results. An empty table gives an empty result. Other columns of the
input are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.llm import perfect_hash
from roadlake.llm.text import slices, text_bytes
from roadlake.session import pin

BLANKS = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
#: Mean number of distinct lines in a shard.
SHARD_LINES = 65_536
#: Lines for which a copy of a shard is asked, about. There are fewer shards with more than
#: one copy than all lines make up such parts, and every task has their numbers.
SHARD_PROBES = 4_000_000
#: A line with more than one such part of all lines is hot.
HOT_PARTS = 4_096
#: Lines that a task gathers before it sends them on in blocks by shard.
BLOCK_LINES = 400_000
LAST = 2**63 - 1

LINES = "doc long, text_hash long, pos int, h1 long, h2 long, fresh int"
MESSAGES = "shard long, copy int, kind int, a binary, b binary, c binary, d binary, e binary"
DROPS = "doc long, text_hash long, pos int"
_DROPS = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32())])


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    if len(key) < min_chars or len(key) >= 4 * min_chars:
        return len(key) >= min_chars
    return len(key.decode("utf-8", "replace")) >= min_chars


def _read_lines(min_chars: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows, places, fresh, digests = [], [], [], bytearray()
            for row, text in enumerate(part.column(2).to_pylist()):
                seen = set()
                for pos, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if _long_enough(key, min_chars):
                        digest = xxhash.xxh3_128_digest(key)
                        rows.append(row)
                        places.append(pos)
                        fresh.append(int(digest not in seen))
                        seen.add(digest)
                        digests += digest
            at = np.array(rows, np.int64)
            keys = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part.column(0).to_numpy()[at], pa.int64()),
                    pa.array(part.column(1).to_numpy()[at], pa.int64()),
                    pa.array(places, pa.int32()),
                    pa.array(keys[:, 0], pa.int64()),
                    pa.array(keys[:, 1], pa.int64()),
                    pa.array(fresh, pa.int32()),
                ],
                names=["doc", "text_hash", "pos", "h1", "h2", "fresh"],
            )

    return read


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return h1 % np.int64(shards)


def _print(h2: np.ndarray, kind: type) -> np.ndarray:
    """The upper bits of a hash."""
    return (h2.view(np.uint64) >> np.uint64(64 - 8 * np.dtype(kind).itemsize)).astype(kind)


def _index(
    h1: np.ndarray, h2: np.ndarray, docs: np.ndarray, first: np.ndarray, kind: type = np.uint32
) -> list[bytes]:
    """The arrays of one shard: level sizes, bits, fingerprints, counts, first documents."""
    sizes, bits = perfect_hash.build(h1.view(np.uint64), h2.view(np.uint64))
    slot = perfect_hash.Slots(sizes, bits).find(h1.view(np.uint64), h2.view(np.uint64))
    prints, counts = np.empty(len(h1), kind), np.empty(len(h1), np.uint32)
    firsts = np.empty(len(h1), np.int64)
    prints[slot] = _print(h2, kind)
    counts[slot] = np.minimum(docs, 2**32 - 1)
    firsts[slot] = first
    return [x.tobytes() for x in (sizes, bits, prints, counts, firsts)]


class _Shard:
    def __init__(self, arrays: list[bytes], kind: type = np.uint32) -> None:
        types = (np.int64, np.uint8, kind, np.uint32, np.int64)
        sizes, bits, *rest = (np.frombuffer(x, t) for x, t in zip(arrays, types, strict=True))
        self.slots = perfect_hash.Slots(sizes, bits)
        self.prints, self.counts, self.firsts = rest

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known or not, number of documents, smallest document."""
        if not len(self.prints):
            none = np.zeros(len(h1), np.int64)
            return none.astype(bool), none, none
        slot = self.slots.find(h1.view(np.uint64), h2.view(np.uint64))
        known = slot >= 0
        slot = np.where(known, slot, 0)
        known &= self.prints[slot] == _print(h2, self.prints.dtype.type)
        return known, self.counts[slot], self.firsts[slot]


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    arrays = _index(*(table.column(c).to_numpy() for c in ("h1", "h2", "docs", "first")))
    return pa.table(
        [pa.array([key[0].as_py()], pa.int64()), *[pa.array([0], pa.int32())] * 2]
        + [pa.array([x], pa.binary()) for x in arrays],
        names=["shard", "copy", "kind", "a", "b", "c", "d", "e"],
    )


def _drop_batch(doc, text_hash, pos, keep) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[keep]), pa.array(text_hash[keep]), pa.array(pos[keep], pa.int32())],
        schema=_DROPS,
    )


def _send(shards: int, shared):
    """Blocks by shard of a task's lines; hot lines are decided here, as kind 2."""

    def copy_of(shard: int, turn: int, asked: np.ndarray, copies: np.ndarray) -> int:
        at = int(np.searchsorted(asked, shard))
        return turn % int(copies[at]) if at < len(asked) and asked[at] == shard else 0

    def blocks(rows: list[np.ndarray], table: _Shard, turn: int) -> Iterator[pa.RecordBatch]:
        _, asked, copies = shared.value
        doc, text_hash, pos, h1, h2 = rows
        known, counts, firsts = table.probe(h1, h2)
        gone = known & (counts > 1) & (firsts != doc)
        out = [[] for _ in range(8)]
        # Blocks of different tasks begin with different documents.
        turn += int(text_hash[0] % 1009)

        def add(shard, kind, at):
            copy = copy_of(shard, turn, asked, copies)
            values = (shard, copy, kind, doc[at], text_hash[at], pos[at], h1[at], h2[at])
            for column, value in zip(out, values, strict=True):
                column.append(value if isinstance(value, int) else value.tobytes())

        if gone.any():
            add(int(doc[gone][0] % shards), 2, np.flatnonzero(gone))
        left = np.flatnonzero(~known)
        shard = _shard_of(h1[left], shards)
        order = np.argsort(shard, kind="stable")
        left, shard = left[order], shard[order]
        for at in np.split(np.arange(len(left)), np.flatnonzero(np.diff(shard)) + 1):
            if len(at):
                add(int(shard[at[0]]), 1, left[at])
        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, types, strict=True)],
            names=["shard", "copy", "kind", "a", "b", "c", "d", "e"],
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, n, turn = _Shard(shared.value[0], np.uint64), [], 0, 0
        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(5)])
            n += batch.num_rows
            if n >= BLOCK_LINES:
                yield from blocks([np.concatenate(c) for c in zip(*held, strict=True)], table, turn)
                held, n, turn = [], 0, turn + 1
        if n:
            yield from blocks([np.concatenate(c) for c in zip(*held, strict=True)], table, turn)

    return send


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard and copy, its arrays first and then the blocks that ask it."""
    now, table = None, None
    for batch in batches:
        for row in range(batch.num_rows):
            *shard, kind = (batch.column(k)[row].as_py() for k in range(3))
            arrays = [batch.column(k)[row].as_py() for k in range(3, 8)]
            if kind == 0:
                now, table = shard, _Shard(arrays)
                continue
            types = (np.int64, np.int64, np.int32, np.int64, np.int64)
            doc, text_hash, pos, h1, h2 = (
                np.frombuffer(x, t) for x, t in zip(arrays, types, strict=True)
            )
            gone = np.ones(len(doc), bool)
            if kind == 1:
                if now != shard:
                    raise RuntimeError(f"shard {shard} has no arrays")
                known, counts, firsts = table.probe(h1, h2)
                gone = known & (counts > 1) & (firsts != doc)
            yield _drop_batch(doc, text_hash, pos, gone)


def _rebuild(text: pd.Series, drops: pd.Series) -> pd.DataFrame:
    lines, dropped, kept = [], [], []
    for content, gone in zip(text, drops, strict=True):
        rows = content.split(b"\n")
        out = set(gone) if gone is not None else ()
        lines.append(len(rows))
        dropped.append(len(out))
        rest = rows if not out else [x for k, x in enumerate(rows) if k not in out]
        kept.append(b"\n".join(rest).decode("utf-8", "replace"))
    return pd.DataFrame({"n_lines": lines, "n_dropped": dropped, "kept_text": kept})


def _lines(docs: DataFrame, doc: Column, content: Column, min_chars: int) -> DataFrame:
    rows = docs.select(doc.alias("doc"), F.xxhash64(content).alias("h"), content.alias("t"))
    return rows.mapInArrow(_read_lines(min_chars), LINES)


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """Per row: the id, ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at
    least ``min_chars`` characters in two documents or more keep only the lines of
    the smallest document that holds them.
    """
    spark = docs.sparkSession
    content = text_bytes(F.col(f"`{text_col}`"))
    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST))
    lines = pin(_lines(docs, doc, content, min_chars), "lines")
    total = lines.count()
    shards = max(1, -(-total // SHARD_LINES))
    found = lines.groupBy("h1", "h2").agg(
        F.count("*").alias("n"),
        F.sum("fresh").alias("docs"),
        F.min("doc").alias("first"),
        F.max("doc").alias("last"),
    )
    one = F.when(F.col("first") == F.col("last"), 1).otherwise(F.col("docs"))
    counts = pin(found.select("h1", "h2", "n", one.alias("docs"), "first"), "line-counts")
    is_hot = F.col("n") > total / HOT_PARTS
    rows = counts.where(is_hot).select("h1", "h2", "docs", "first").collect()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    hot = _index(*(np.ascontiguousarray(c) for c in columns), np.uint64)
    cold = counts.where(~is_hot).withColumn("shard", F.pmod("h1", F.lit(shards)))
    probes = cold.groupBy("shard").agg(F.sum("n").alias("probes")).where(F.col("probes") > SHARD_PROBES)
    copies = F.ceil(F.col("probes") / SHARD_PROBES).cast("int").alias("copies")
    many = sorted(map(tuple, probes.select("shard", copies).collect()))
    many = np.array(many, np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((hot, many[:, 0].copy(), many[:, 1].copy()))
    index = cold.groupBy("shard").applyInArrow(_build, MESSAGES)
    if len(many):
        last = F.coalesce("copies", F.lit(1)) - 1
        index = (
            index.join(probes.select("shard", copies), "shard", "left")
            .withColumn("copy", F.explode(F.sequence(F.lit(0), last)))
            .drop("copies")
        )
    asked = lines.mapInArrow(_send(shards, shared), MESSAGES)
    drops = (
        index.unionByName(asked)
        .repartition("shard", "copy")
        .sortWithinPartitions("shard", "copy", "kind")
        .mapInArrow(_probe, DROPS)
        .groupBy("doc", "text_hash")
        .agg(F.collect_set("pos").alias("drops"))
    )
    rows = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        doc.alias("doc"),
        F.xxhash64(content).alias("text_hash"),
        content.alias("_text"),
    )
    rebuild = F.pandas_udf(_rebuild, "n_lines long, n_dropped long, kept_text string")
    rebuilt = rows.join(drops, ["doc", "text_hash"], "left").select(
        "_id", rebuild("_text", "drops").alias("r")
    )
    return rebuilt.select(
        F.col("_id").alias(id_col), "r.n_lines", "r.n_dropped", "r.kept_text"
    )

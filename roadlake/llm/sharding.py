"""Sharding by sampled splitters, in DataFrame functions alone.

Records have the hash of their text as key, so that equal texts lie side by side. A
sample of keys, each drawn with a chance in proportion to its record's size, gives
quantile boundaries that cut the keys into many narrow ranges. Their true sizes are
then counted, overfull ranges are subdivided, and runs of neighbouring ranges are put
into shards of near equal size.

A text with so many copies that they overfill a range by themselves is a range of its
own. It stays whole in one shard unless it is larger than a shard's fair share; only
then it is subdivided, by a number that each row has. There are fewer such texts than
ranges.

Slots are numbered on keys, sizes and row numbers alone; whole records meet their shard by
row number.

Nulls and ties: a null text is empty and equals an empty one. A row's slot follows
(range, key, id); rows alike may stand in either order, and copies of one text are told
apart by their row, whether or not they share an id. An empty table gives an empty
result. Columns of the input stay; where one is named like an output, the output wins.
"""

from __future__ import annotations

import json
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadlake.session import pin

RANGES_PER_SHARD = 64
SAMPLE_PER_RANGE = 8
ROW_BYTES = 16
#: A range with more than this part of a shard's fair share is placed by itself.
LARGE_PART = 1 / 16
OUTPUTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _draw(rows: DataFrame, total: int, keys: int) -> list[int]:
    """About ``keys`` keys in order, drawn with a chance in proportion to the size."""
    chance = F.col("size") * (keys / max(total, 1))
    dice = F.pmod(F.xxhash64("key", "id", F.lit("draw")), F.lit(2**40)) / 2**40
    drawn = rows.withColumn("times", F.floor(chance) + (dice < chance - F.floor(chance)).cast("int"))
    return sorted(
        r["key"]
        for r in drawn.where("times > 0").groupBy("key").agg(F.sum("times").alias("n")).collect()
        for _ in range(min(r["n"], keys))
    )


def _splitters(sample: list[int], ranges: int) -> list[int]:
    cuts = {sample[len(sample) * k // ranges] for k in range(1, ranges)} if sample else set()
    return sorted(cuts)


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below the key, looked up in two steps of about their root."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[k : k + step] for k in range(0, len(cuts), step)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda cut: cut <= key))

    block = below(F.array(*(F.lit(b[0]) for b in blocks)))
    rows = F.array(*(F.array(*map(F.lit, b)) for b in blocks))
    inside = below(F.element_at(rows, F.greatest(block, F.lit(1))))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inside)


def _sizes(rows: DataFrame, cuts: list[int]) -> dict[int, int]:
    counted = rows.groupBy(_range_of(F.col("key"), cuts).alias("r")).agg(F.sum("size").alias("s"))
    return {r["r"]: r["s"] for r in counted.collect()}


def _subdivide(cuts: list[int], sizes: dict[int, int], limit: int) -> list[int]:
    """Cut ranges of more than two limits evenly; keys are hashes, so this halves them well."""
    more = set(cuts)
    for number, size in sizes.items():
        if size > 2 * limit:
            start = cuts[number - 1] if number else -(2**63)
            end = cuts[number] if number < len(cuts) else 2**63
            n = -(-size // limit)
            more.update(start + (end - start) * k // n for k in range(1, n))
    return sorted(more)


def _pack(
    sizes: dict[int, int], heavy: dict[int, int], shards: int, limit: int
) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Shard of each range, and of each part of a heavy key (parts of about a limit).

    Heavy keys and ranges that no cut makes small (a very long text) go first, each to
    the emptiest shard; the other ranges then fill up the shards in order, so that a
    shard has one run of neighbouring ranges beside them.
    """
    fair = max(1.0, (sum(sizes.values()) + sum(heavy.values())) / shards)
    load, parts, at = [0.0] * shards, {}, {}
    large = [(size, True, key) for key, size in heavy.items()]
    large += [(size, False, k) for k, size in sizes.items() if size > LARGE_PART * fair]
    for size, is_key, name in sorted(large, reverse=True):
        n = max(1, -int(-size // fair)) if is_key else 1
        chosen = []
        for _ in range(n):
            shard = min(range(shards), key=lambda s: (load[s], s))
            load[shard] += size / n
            chosen.append(shard)
        if is_key:
            parts[name] = [chosen[k % n] for k in range(max(n, -(-size // limit)))]
        else:
            at[name] = chosen[0]
    sizes = {k: size for k, size in sizes.items() if k not in at}
    ends, done = [], 0.0
    for x in load:
        done += max(0.0, fair - x)
        ends.append(done)
    scale = done / max(1, sum(sizes.values()))
    upto = 0
    for number, size in sorted(sizes.items()):
        at[number] = min(bisect_right(ends, (upto + size / 2) * scale), shards - 1)
        upto += size
    return at, parts


def _small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver has, at most some per range, as one constant."""
    names = [c.split()[0] for c in schema.split(", ")]
    shape = "array<struct<" + ", ".join(c.replace(" ", ":") for c in schema.split(", ")) + ">>"
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), shape)))


def assign_shards(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = True,
) -> DataFrame:
    """The rows with ``size`` (bytes of the text and ``ROW_BYTES``), ``text_crc32``,
    ``law``, ``shard``, ``slot`` and ``grown_shard``; only the id and these without
    ``carry``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    measures = [
        F.xxhash64(text).alias("key"),
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
    ]
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in OUTPUTS]).alias("record")]
    keyed = docs.select(
        F.monotonically_increasing_id().alias("row"), *measures, *(kept if carry else [])
    )
    records = pin(keyed, "records")
    slim = records.drop("record")
    total = slim.agg(F.sum("size")).first()[0] or 0
    ranges = shards * RANGES_PER_SHARD
    limit = max(1, total // ranges)
    keys = slim.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    # Fewer than half as many keys as ranges can each hold two ranges' bytes.
    is_heavy = (F.col("size") > 2 * limit) & (F.col("n") > 1)
    heavy = {r["key"]: r["size"] for r in keys.where(is_heavy).collect()}
    heavy_keys = F.broadcast(_small_table(spark, [(k,) for k in sorted(heavy)], "key bigint"))
    light = slim.join(heavy_keys, "key", "left_anti")
    cuts = _splitters(_draw(light, total, ranges * SAMPLE_PER_RANGE), ranges)
    sizes = _sizes(light, cuts)
    more = _subdivide(cuts, sizes, limit)
    if more != cuts:
        cuts, sizes = more, _sizes(light, more)
    at, parts = _pack(sizes, heavy, shards, limit)
    places = [at.get(k, 0) for k in range(len(cuts) + 1)]
    first, rows = len(places), []
    for key, of_key in sorted(parts.items()):
        rows.append((key, of_key, first))
        first += len(of_key)
        places += of_key
    heavy_parts = F.broadcast(_small_table(spark, rows, "key bigint, parts array<int>, first int"))

    def numbered(rows: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("row", F.lit("part")), F.size("parts")).cast("int")
        number = F.coalesce(F.col("first") + part, _range_of(F.col("key"), cuts))
        joined = rows.join(heavy_parts, "key", "left")
        return joined.withColumn("number", number).drop("parts", "first")

    counts = numbered(slim).groupBy("number").agg(F.count("*").alias("n"))
    counted = {r["number"]: r["n"] for r in counts.collect()}
    starts, filled = [], [0] * shards
    for number, shard in enumerate(places):
        starts.append(filled[shard])
        filled[shard] += counted.get(number, 0)
    in_range = Window.partitionBy("number").orderBy("key", "id", "row")
    place = F.col("number") + 1
    shard = F.element_at(F.array(*map(F.lit, places)), place)
    slot = F.element_at(F.array(*map(F.lit, starts)), place) + F.row_number().over(in_range) - 1
    placed = numbered(slim).select(
        "row",
        *([] if carry else [F.col("id").alias(id_col)]),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        shard.cast("int").alias("shard"),
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    if not carry:
        return placed.drop("row")
    return records.select("row", "record").join(placed, "row").select("record.*", *OUTPUTS)

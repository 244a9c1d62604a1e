"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions.

Each source is a queue of its documents in shuffled order, run through up to
``MOST_COPIES`` times. A copy finishes at the words of its source up to and with it,
divided by the source's target. All copies are range-sorted by finish time and taken
until the total budget is reached, so that the sources advance side by side.

Nulls and ties: sources count by code point, null last and as one source. A null text
has no words. Every row is an entry of its own, so the cut may fall between rows alike.
Reruns agree, since the shuffle is a hash of the id and ties go by source, id and size;
which of several rows alike in all of these is taken is left open. An empty table gives
an empty result; other columns are not looked at.

Per-source windows run over the table of sources alone, one row of some 100 bytes each, in
one task: sources may be sites, but no more than fit a task, some millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.llm.running import with_running_total
from roadlake.session import pin

MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """Per source: ``source_size`` and ``target``, which stops at ``most`` times the size.

    With sources by size over weight, the first k stop at their limit; the others get
    their weight's share of the rest. k is the least that leaves none above its limit,
    and of all k that do so it has the highest level.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    each = each.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, later = (
        by_level.rowsBetween(Window.unboundedPreceding, -1),
        by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing),
    )
    whole = Window.partitionBy(F.lit(0))
    each = each.withColumns(
        {
            "budget": F.sum("source_size").over(whole),
            "stopped": F.coalesce(F.sum("limit").over(earlier), F.lit(0)),
            "open": F.sum("weight").over(later),
        }
    )
    level = (F.col("budget") - F.col("stopped")) / F.col("open")
    fits = level * F.col("weight") <= F.col("limit")
    each = each.withColumn("level", F.max(F.when(fits, level)).over(whole))
    target = F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight"))
    return each.select("source", "source_size", target.alias("target"), "budget")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    row: Column | None = None,
) -> DataFrame:
    """Per row: ``row``, ``id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``
    (how often the mix takes it).

    ``row`` tells rows apart and must be the same each time ``docs`` is read; if it is not
    given the rows are numbered here, and the numbers mean nothing outside.
    """
    sized = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        n_words(F.col(f"`{text_col}`").cast("string")).alias("size"),
    )
    sized = pin(sized, "sizes")
    sources = pin(source_targets(sized, weights, most), "targets")
    # "s" before each name and "t" for null: a key without nulls in the same order.
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t"))
    named = sized.withColumns({"shuffled": F.xxhash64(F.col("id"), F.lit("mix")), "key": key})
    order = [F.col(c) for c in ("key", "shuffled", "id", "size", "row")]
    queued = with_running_total(named, order, "size", "upto")
    before = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    starts = sources.select(
        key.alias("key"), "source_size", "target", "budget"
    ).withColumn("start", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    queued = pin(queued.join(starts, "key"), "queues")
    copies = queued.where((F.col("size") > 0) & (F.col("target") > 0)).select(
        "key", "row", "id", "size", "source_size", "target", "budget",
        (F.col("upto") - F.col("start")).alias("done"),
        F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("copy"),
    )
    finish = (F.col("copy") * F.col("source_size") + F.col("done")) / F.col("target")
    copies = copies.withColumn("finish", finish)
    order = [F.col(c) for c in ("finish", "key", "copy", "id", "size", "row")]
    taken = with_running_total(copies, order, "size", "total").where("total <= budget")
    counts = taken.groupBy("row").agg(F.count("*").alias("copies"))
    return queued.join(counts, "row", "left").select(
        "row", "id", "source", "size", "source_size", "target",
        F.coalesce("copies", F.lit(0)).alias("copies"),
    )

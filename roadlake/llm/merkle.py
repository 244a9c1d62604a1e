"""Merkle manifest of a dataset: a content-addressed DAG and the proofs read from it.

Every row is a leaf. Per source the leaves, in order of their ids, are a tree in which each
run of ``FAN`` nodes has one parent; the trees' tops are the leaves of a tree of their own,
whose top is the root of the manifest.

``build`` stores what leads from digests to children. A record is a page: the digest of a
node and, for it and the ``LEVELS - 1`` levels below it, a map from digest to children.
Equal subtrees have one record. ``prove`` answers requests for leaves. A request descends
from the root by the base-``FAN`` digits of its rank, page by page; each step takes one child
and collects the others. Requests with a common prefix visit a page once. What was collected
on the way down, turned around, is the proof from the leaf up.

Rows meet by (tree, page) or by digest; a page has ``FAN ** LEVELS`` nodes below it at most,
so no source, however large, comes together in one task. Rounds grow with the logarithm of
the largest source.

Nulls and ties: a null field has the mark ``-``; a null source is a source, before all
others; null ids come before all others. Rows of one id go by their leaf digests; rows alike
in all fields are leaves of their own with one digest. A null id is never tampered with. An
empty table has no root and gives an empty result; columns other than the five are not
looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.functions.once import once
from roadlake.session import pin

FAN = 3
#: Levels of nodes in one record.
LEVELS = 4
PAGE = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Number of the nodes below one node, by level, as far as a 64-bit rank goes.
POWERS = [FAN**k for k in range(40)]
STEPS = "array<struct<left:string,right:string>>"


def tagged(value: Column) -> Column:
    """``-`` for null, else byte count, colon and text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def without_newlines(row_id: Column, text: Column) -> Column:
    """The text as tampering leaves it: of every other id (by crc32) without its newlines."""
    chosen = F.crc32(row_id.cast("string").cast("binary")) % 2 == 0
    return F.when(chosen & F.contains(text, F.lit("\n")), F.replace(text, F.lit("\n"), F.lit("")))


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with ``position``, their place in the whole order, from 0.

    The rows are range-partitioned once and written with their place in their partition;
    the places before a partition are added from one row per partition.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = pin(ranged.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    counts = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # One row of two numbers per shuffle partition.
    joined = ranged.withColumn("part", part).join(F.broadcast(starts), "part")
    place = F.col("at").bitwiseAND(F.lit(2**33 - 1)) + F.col("start")
    return joined.withColumn("position", place).drop("at", "part", "start")


def _height(nodes: Column) -> Column:
    """Levels above ``nodes`` leaves."""
    return F.size(F.filter(F.array(*map(F.lit, POWERS)), lambda power: power < nodes))


def _parents(level: Column) -> Column:
    last = F.floor((F.size(level) - 1) / FAN).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda run: F.sha2(F.array_join(F.slice(level, run * FAN + 1, FAN), "").cast("binary"), 256),
    )


def _children(parents: Column, level: Column) -> Column:
    return F.transform(
        parents,
        lambda at, run: F.struct(
            at.alias("digest"), F.slice(level, run * FAN + 1, FAN).alias("children")
        ),
    )


def _pages(nodes: DataFrame, below: int) -> DataFrame:
    """Nodes (tree, height, rank, digest) of level ``below`` folded up to ``LEVELS`` levels."""
    page = F.floor(F.col("rank") / PAGE).alias("page")
    rows = nodes.groupBy("tree", "height", page).agg(
        F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("nodes")
    )
    rows = once(rows, level0=F.col("nodes.digest"))
    for k in range(LEVELS):
        level = F.col(f"level{k}")
        higher = F.col("height") > below + k
        rows = once(rows, **{f"level{k + 1}": F.when(higher, _parents(level)).otherwise(level)})
        entries = F.when(higher, _children(F.col(f"level{k + 1}"), level))
        rows = rows.withColumn(f"entries{k}", F.coalesce(entries, F.array_repeat(_no_entry(), 0)))
    records = F.flatten(F.array(*(f"entries{k}" for k in range(LEVELS))))
    return rows.select(
        "tree",
        "height",
        "page",
        F.element_at(f"level{LEVELS}", 1).alias("digest"),
        F.map_from_entries(F.array_distinct(records)).alias("children"),
    )


def _no_entry() -> Column:
    return F.struct(F.lit("").alias("digest"), F.array(F.lit("")).alias("children"))


@dataclass(frozen=True)
class Forest:
    """Trees of one kind: their records by round from the leaves up, and their tops."""

    records: list[DataFrame]
    #: tree, height, digest
    tops: DataFrame
    tallest: int


def _forest(nodes: DataFrame, tallest: int, name: str) -> Forest:
    """Trees over nodes (tree, height, rank, digest), none higher than ``tallest``."""
    records, tops = [], nodes.where("height = 0").select("tree", "height", "digest")
    for below in range(0, tallest, LEVELS):
        pages = pin(_pages(nodes.where(F.col("height") > below), below), f"{name}-pages")
        records.append(pages.groupBy("digest").agg(F.first("children").alias("children")))
        done = F.col("height") <= below + LEVELS
        tops = tops.unionByName(pages.where(done).select("tree", "height", "digest"))
        nodes = pages.where(~done).select("tree", "height", F.col("page").alias("rank"), "digest")
    return Forest(records, tops, tallest)


@dataclass(frozen=True)
class Manifest:
    #: tree, height, rank, id, digest, told (the tampered leaf, where it differs)
    leaves: DataFrame
    #: tree, source_key, subroot
    sources: DataFrame
    within: Forest
    above: Forest
    root: str | None


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> Manifest:
    """The manifest of ``docs``; ``fields`` names id, source, language, length and text."""
    row_id, source, lang, n_chars, text = (F.col(f"`{c}`") for c in fields)
    before = [tagged(c) for c in (row_id, source, lang, n_chars)]
    changed = without_newlines(row_id, text)
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")).alias("source_key"),
        row_id.alias("id"),
        digest(*before, tagged(text)).alias("digest"),
        F.when(changed.isNotNull(), digest(*before, tagged(changed))).alias("told"),
    )
    # The number tells alike rows apart, so that many of them still spread over partitions.
    leaves = pin(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    leaves = _numbered(leaves, ["source_key", "id", "digest", "row"], "ordered-leaves")
    each = leaves.groupBy("source_key").agg(
        F.min("position").alias("first"), F.count("*").alias("n")
    )
    sources = _numbered(each, ["source_key"], "ordered-sources")
    sources = sources.select(
        F.col("position").alias("tree"), "source_key", "first", _height(F.col("n")).alias("height")
    )
    sources = pin(sources, "sources")
    rank = (F.col("position") - F.col("first")).alias("rank")
    leaves = leaves.join(sources, "source_key").select(
        "tree", "height", rank, "id", "digest", "told"
    )
    leaves = pin(leaves, "ranked-leaves")
    tallest = sources.agg(F.max("height")).first()[0] or 0
    within = _forest(leaves.select("tree", "height", "rank", "digest"), tallest, "within")
    subroots = pin(within.tops.select("tree", F.col("digest").alias("subroot")), "subroots")
    n = sources.count()
    height = sum(power < n for power in POWERS)
    tops = subroots.select(
        F.lit(0).cast("long").alias("tree"),
        F.lit(height).alias("height"),
        F.col("tree").alias("rank"),
        F.col("subroot").alias("digest"),
    )
    above = _forest(tops, height, "above")
    top = above.tops.first()
    sources = sources.join(subroots, "tree").select("tree", "height", "source_key", "subroot")
    return Manifest(leaves, pin(sources, "trees"), within, above, top and top["digest"])


def _walk(levels: Column, place: Column) -> Column:
    """From a page's digest down to ``place``: the node there and what was left aside."""
    powers = F.array(*map(F.lit, POWERS[:LEVELS]))
    digits = F.transform(
        F.sequence(levels, F.lit(1), F.lit(-1)),
        lambda k: F.pmod(F.floor(place / F.element_at(powers, k)), F.lit(FAN)).cast("int"),
    )
    start = F.struct(F.col("digest").alias("at"), F.array().cast(STEPS).alias("path"))

    def step(reached: Column, digit: Column) -> Column:
        children = F.element_at("children", reached["at"])
        aside = F.struct(
            F.array_join(F.slice(children, 1, digit), "").alias("left"),
            F.array_join(F.slice(children, digit + 2, FAN), "").alias("right"),
        )
        return F.struct(
            F.get(children, digit).alias("at"),
            F.concat(reached["path"], F.array(aside)).alias("path"),
        )

    return F.aggregate(digits, start, step)


def _descend(forest: Forest, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (tree, height, rank, carried) with ``digest`` and ``path``, top first.

    ``starts`` has, per tree, the digest of its top and the path that leads there.
    """

    def by_page(rows: DataFrame, *more: str) -> DataFrame:
        place = F.pmod("rank", F.lit(PAGE)).cast("int").alias("place")
        return rows.groupBy("tree", "height", F.floor(F.col("rank") / PAGE).alias("page")).agg(
            F.collect_list(F.struct(place, *more)).alias("asked")
        )

    asked = [pin(by_page(requests, "carried"), "requests")]
    for _ in forest.records[1:]:
        pages = asked[-1].select("tree", "height", F.col("page").alias("rank"))
        asked.append(by_page(pages))
    rounds = len(forest.records)
    start_round = F.ceil(F.col("height") / LEVELS) - 1
    arrived = None
    for turn in reversed(range(rounds)):
        visits = starts.where(start_round == turn).select(
            "tree", F.lit(0).cast("long").alias("page"), "digest", "path"
        )
        if arrived is not None:
            visits = visits.unionByName(arrived)
        opened = visits.join(asked[turn], ["tree", "page"]).join(forest.records[turn], "digest")
        levels = F.least(F.lit(LEVELS), F.col("height") - turn * LEVELS)
        each = opened.select("*", F.explode("asked").alias("one"))
        each = once(each, reached=_walk(levels, F.col("one.place")))
        arrived = each.select(
            "tree",
            (F.col("page") * PAGE + F.col("one.place")).alias("page" if turn else "rank"),
            F.col("reached.at").alias("digest"),
            F.concat("path", "reached.path").alias("path"),
            *([] if turn else ["one.carried"]),
        )
    alone = starts.where("height = 0").join(
        asked[0].where("height = 0").select("tree", F.inline("asked")), "tree"
    )
    alone = alone.select("tree", F.lit(0).cast("long").alias("rank"), "digest", "path", "carried")
    return alone if arrived is None else alone.unionByName(arrived)


def prove(manifest: Manifest, leaves: DataFrame | None = None) -> DataFrame:
    """Per requested leaf: ``id``, ``told``, ``leaf``, ``subroot``, and ``path``, the digests
    beside it on each level from the leaf up (``left``, ``right``).

    ``leaves`` are rows of ``manifest.leaves``; all of them if not given.
    """
    leaves = manifest.leaves if leaves is None else leaves
    tops = manifest.above.tops.select(
        "tree", "height", "digest", F.array().cast(STEPS).alias("path")
    )
    carried = F.struct("tree", F.col("height").alias("of_height"))
    wanted = manifest.sources.join(leaves.select("tree").distinct(), "tree", "left_semi")
    sources = wanted.select(
        F.lit(0).cast("long").alias("tree"),
        F.lit(manifest.above.tallest).alias("height"),
        F.col("tree").alias("rank"),
        carried.alias("carried"),
    )
    reached = _descend(manifest.above, tops, sources).select(
        F.col("carried.tree").alias("tree"),
        F.col("carried.of_height").alias("height"),
        "digest",
        "path",
    )
    starts = pin(reached, "starts")
    requests = leaves.select("tree", "height", "rank", F.struct("id", "told").alias("carried"))
    found = _descend(manifest.within, starts, requests)
    subroots = starts.select("tree", F.col("digest").alias("subroot"))
    return found.join(subroots, "tree").select(
        "carried.id",
        "carried.told",
        F.col("digest").alias("leaf"),
        "subroot",
        F.reverse("path").alias("path"),
    )


def verified_leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Every row with its proof, held against the tampered leaf.

    ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` (from the
    tampered leaf, else the original, up the proof), ``verified``.
    """
    manifest = build(docs, fields)
    beside = F.transform("path", lambda step: F.concat(step["left"], step["right"]))
    folded = F.aggregate(
        "path",
        F.coalesce("told", "leaf"),
        lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]).cast("binary"), 256),
    )
    root = F.lit(manifest.root).cast("string")
    proved = once(prove(manifest), root=root, folded_root=folded)
    return proved.select(
        F.col("id").alias(fields[0]),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(beside, "").cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )

"""MinHash near-duplicates with sequential Bayesian verification.

A document's set has the hashes of its distinct word shingles; its signature has the
least value of each of ``bands * rows`` hash functions. Documents with equal sets are
one class with a number of its own. Classes that agree on a band are candidates;
chains of candidates form clusters, and a cluster is where the comparing is done:

1. signatures of a banded candidate pair are compared batch by batch; with a uniform
   prior the similarity given m matches in n has a Beta(m + 1, n - m + 1) posterior,
   and the pair is dropped once that leaves the threshold less than ``miss``;
2. survivors are verified on their whole sets, unless other links already join them.

Clusters too large for one task are cut by set size into steps that each end where sets are too large to be
linked with the step's smallest, so that a class meets those of its own step and of the
next alone. Steps are cut into blocks, by their number of classes and by the size of their
sets together, which are compared block against block, each in a task of its own; a task
gives back only links that join something. So no task holds an unbounded group and no
pairs within a group are listed.

With 20 bands of 5 rows a pair at similarity 0.85 shares no band once in 100,000, at
0.8 once in 2,500.

Ids only name the result: a component has the smallest id of its rows, and one row of a
class, found by its id and two hashes of its text, brings the text to be compared.

Nulls and ties: a null or empty text, or one without words, has an empty set and is
linked with nothing. With fewer words than a shingle the whole sequence is the one
shingle. Each row is judged by its own text; a null id counts as after all others.
Repeated rows give repeated results. An empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.llm.components import components
from roadlake.llm.text import WordHashes, mix, shingle_hashes, slices, text_bytes
from roadlake.session import pin

LAST = 2**63 - 1
#: Classes of a cluster's step that one block has on average, and shingles of their sets.
BLOCK = 1_000
BLOCK_SHINGLES = 2_000_000
#: Values of a signature compared at once.
BATCH = 20

#: What tells rows apart: the id, and two hashes of the text.
ROW = ["doc", "h1", "h2"]
SKETCH = "doc long, h1 long, h2 long, n_shingles long, d1 long, d2 long, signature binary"
LINKS = "a long, b long"


@dataclass(frozen=True)
class NearDuplicates:
    shingle_words: int = 5
    percent: int = 80
    bands: int = 20
    rows: int = 5
    miss: float = 1e-4

    @property
    def values(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> list[tuple[int, int]]:
        """After each batch: values compared, and matches needed to go on.

        P(similarity >= t | m of n match) is the chance of at most m successes in
        n + 1 trials of chance t.
        """
        t, out = self.percent / 100, []
        for n in range(BATCH, self.values + 1, BATCH):
            below, need = 0.0, n + 1
            for m in range(n + 1):
                below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if below >= self.miss:
                    need = m
                    break
            out.append((n, need))
        return out

    def shingles(self, text: bytes, hashes: WordHashes) -> np.ndarray:
        return np.unique(shingle_hashes(hashes.of(text.lower().split()), self.shingle_words))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        seeds = np.arange(2 * self.values, dtype=np.uint64)
        factors, shifts = mix(seeds[: self.values], 1) | np.uint64(1), mix(seeds[self.values :], 2)
        found = np.full(self.values, 2**32 - 1, np.uint64)
        for start in range(0, len(shingles), 256):
            block = shingles[start : start + 256, None] * factors
            block += shifts
            block >>= np.uint64(32)
            np.minimum(found, block.min(axis=0), out=found)
        return found.astype(np.uint32)


def _sketch(how: NearDuplicates):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            sizes, sums, signatures = [], [], []
            for text in part.column(3).to_pylist():
                found = how.shingles(text, hashes)
                sizes.append(len(found))
                sums.append((mix(found, 3).sum(), mix(found, 4).sum()))
                signatures.append(how.signature(found).tobytes() if len(found) else b"")
            digests = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(k) for k in range(3)),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests[:, 0]),
                    pa.array(digests[:, 1]),
                    pa.array(signatures, pa.binary()),
                ],
                names=[*ROW, "n_shingles", "d1", "d2", "signature"],
            )

    return sketch


class _Members:
    """The classes of one task: sets as ranges of one array, signatures, bands."""

    def __init__(self, how: NearDuplicates, texts: list[bytes], hashes: WordHashes) -> None:
        sets = [how.shingles(t, hashes) for t in texts]
        self.sizes = np.array([len(s) for s in sets])
        self.signatures = np.array([how.signature(s) for s in sets])
        self.bands = mix_rows(self.signatures.reshape(len(sets), how.bands, how.rows))
        values, places = np.unique(np.concatenate(sets), return_inverse=True)
        self.sets = np.split(places, np.cumsum(self.sizes)[:-1])
        self.marks = np.zeros(len(values), bool)
        self.labels = np.arange(len(sets))

    def links(self, how: NearDuplicates, own: np.ndarray, other: np.ndarray | None):
        """Pairs that join two components, among ``own`` or of it with ``other``."""
        steps = how.least_matches()
        for at, row in enumerate(own):
            rest = own[at + 1 :] if other is None else other
            rest = rest[self.labels[rest] != self.labels[row]]
            rest = rest[(self.bands[rest] == self.bands[row]).any(axis=1)]
            matches, done = np.zeros(len(rest), np.int64), 0
            for n, need in steps:
                columns = slice(done, n)
                same = self.signatures[rest, columns] == self.signatures[row, columns]
                matches += same.sum(axis=1)
                stay = matches >= need
                rest, matches, done = rest[stay], matches[stay], n
            if not len(rest):
                continue
            self.marks[self.sets[row]] = True
            common = np.add.reduceat(
                self.marks[np.concatenate([self.sets[k] for k in rest])].astype(np.int64),
                np.concatenate([[0], np.cumsum(self.sizes[rest])[:-1]]),
            )
            self.marks[self.sets[row]] = False
            either = self.sizes[rest] + self.sizes[row] - common
            for k in rest[100 * common >= how.percent * either]:
                if self.labels[k] != self.labels[row]:
                    self.labels[self.labels == self.labels[k]] = self.labels[row]
                    yield row, k


def mix_rows(values: np.ndarray) -> np.ndarray:
    """One 64-bit hash of the last axis."""
    found = np.zeros(values.shape[:-1], np.uint64)
    for k in range(values.shape[-1]):
        found = mix(found ^ values[..., k].astype(np.uint64), k)
    return found


def _verify(how: NearDuplicates):
    hashes = WordHashes()

    def verify(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        left, right = (k.as_py() for k in key[-2:])
        nodes = table.column("node").to_numpy()
        blocks = table.column("block").to_numpy()
        order = np.argsort(nodes, kind="stable")
        members = _Members(how, table.column("text").to_pylist(), hashes)
        own = order[blocks[order] == left]
        other = None if left == right else order[blocks[order] == right]
        found = list(members.links(how, own, other))
        rows = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[rows[:, 0]], "b": nodes[rows[:, 1]]})

    return verify


def _bands(classes: DataFrame, how: NearDuplicates) -> DataFrame:
    width = 4 * how.rows
    keys = [
        F.xxhash64(F.lit(k), F.substring("signature", 1 + k * width, width))
        for k in range(how.bands)
    ]
    return classes.select("node", F.explode(F.array(*keys)).alias("band"))


def _clusters(classes: DataFrame, how: NearDuplicates) -> DataFrame:
    """(node, component) of the classes that share a band with another.

    A class is linked with the least class of each of its bands. Of these it keeps the least;
    that one is linked with the others in its place, which says the same with far fewer
    links, as the classes of a large group have few least ones.
    """
    bands = _bands(classes, how)
    shared = bands.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("most"))
    shared = shared.where("b <> most").select("band", "b")
    meets = bands.join(shared, "band").groupBy("node").agg(F.collect_set("b").alias("least"))
    meets = meets.select("node", "least", F.array_min("least").alias("to"))
    meets = pin(meets, "meets")
    others = meets.select(F.explode("least").alias("a"), F.col("to").alias("b"))
    among = components(others.where("a <> b")).withColumnRenamed("node", "to")
    joined = meets.select("node", "to").join(among, "to", "left")
    return joined.select("node", F.coalesce("component", "to").alias("component"))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """The columns ``ROW`` of a document."""
    content = text_bytes(F.col(f"`{text_col}`"))
    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST))
    return [doc.alias("doc"), F.xxhash64(content).alias("h1"), F.xxhash64(F.lit(1), content).alias("h2")]


def judged(docs: DataFrame, how: NearDuplicates, id_col: str, text_col: str) -> DataFrame:
    """Per row: ``ROW``, ``n_shingles``, and ``least``, the smallest id of its component."""
    content = text_bytes(F.col(f"`{text_col}`")).alias("text")
    rows = docs.select(*row_key(id_col, text_col), content)
    sketches = pin(rows.mapInArrow(_sketch(how), SKETCH), "sketches")
    classes = (
        sketches.where("n_shingles > 0")
        .groupBy("d1", "d2", "n_shingles")
        .agg(F.min(F.struct(*ROW)).alias("rep"), F.first("signature").alias("signature"))
        .select("d1", "d2", "n_shingles", "rep.*", "signature")
    )
    # Numbers rise with the ids, so the bands of one cluster mostly link to the same class.
    classes = classes.orderBy(*ROW).withColumn("node", F.monotonically_increasing_id())
    classes = pin(classes, "classes")
    clusters = _clusters(classes, how)
    members = clusters.join(classes.select("node", "n_shingles", *ROW), "node")
    # Sizes of linked sets differ by the threshold at most, so by one step.
    width = -math.log(how.percent / 100) + 1e-9
    filled = F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)
    fill = members.groupBy("component").agg(filled.alias("fill"))
    step = F.when(F.col("fill") > 1, F.floor(F.log("n_shingles") / width)).otherwise(0)
    members = members.join(fill, "component").withColumn("step", step.cast("int"))
    blocks = members.groupBy("component", "step").agg(
        F.least(F.ceil(filled), F.count("*")).cast("int").alias("blocks")
    )
    higher = blocks.select("component", (F.col("step") - 1).alias("step"), F.col("blocks").alias("above"))
    lower = blocks.select("component", (F.col("step") + 1).alias("step"), F.col("blocks").alias("under"))
    blocks = blocks.join(higher, ["component", "step"], "left").join(lower, ["component", "step"], "left")
    members = members.join(blocks, ["component", "step"])
    # Repeated rows are folded before they meet; of each class one text goes on. The table of
    # members grows with the input, so no size of it is broadcast.
    each = rows.groupBy(*ROW).agg(F.first("text").alias("text"))
    texts = each.join(members.hint("merge"), ROW)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    texts = texts.withColumn("block", F.col("step") * F.lit(2**32) + block)

    def meets(step: Column, number: Column) -> Column:
        last = F.coalesce(number, F.lit(0)) - 1
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda k: step * F.lit(2**32) + k)

    step = F.col("step")
    others = F.concat(meets(step, F.col("blocks")), meets(step + 1, F.col("above")), meets(step - 1, F.col("under")))
    spread = texts.select("component", "node", "text", "block", F.explode(others).alias("other"))
    task = [
        F.col("component"),
        F.least("block", "other").alias("left"),
        F.greatest("block", "other").alias("right"),
    ]
    links = spread.groupBy(*task).applyInArrow(_verify(how), LINKS)
    found = components(links)
    ids = found.join(classes.select("node", F.col("doc").alias("rep")), "node")
    least = ids.groupBy("component").agg(F.min("rep").alias("least"))
    found = found.join(least, "component").select("node", "least")
    of = classes.join(found, "node", "left").select(
        "d1", "d2", "n_shingles", F.coalesce("least", "doc").alias("least")
    )
    return sketches.join(of, ["d1", "d2", "n_shingles"], "left").select(
        *ROW, "n_shingles", F.coalesce("least", "doc").alias("least")
    )


def near_duplicates(
    docs: DataFrame,
    how: NearDuplicates | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: the id, ``n_shingles``, ``component_id``, ``kept``."""
    return judged(docs, how or NearDuplicates(), id_col, text_col).select(
        F.nullif("doc", F.lit(LAST)).alias(id_col),
        "n_shingles",
        F.nullif("least", F.lit(LAST)).alias("component_id"),
        (F.col("doc") == F.col("least")).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame,
    how: NearDuplicates | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` calls kept, each by its own text.

    Of rows that share id and text one stays, chosen by a hash of its columns.
    """
    found = judged(docs, how or NearDuplicates(), id_col, text_col)
    kept = found.where("doc = least").select(*ROW).distinct()
    # The input's columns travel inside one, so that no name of theirs can clash.
    rows = docs.select(*row_key(id_col, text_col), F.struct("*").alias("row"))
    simple = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    picked = F.xxhash64(*(F.col("row").getField(c) for c in simple))
    rows = rows.groupBy(*ROW).agg(F.min_by("row", picked).alias("row"))
    return rows.join(kept, ROW, "left_semi").select("row.*")

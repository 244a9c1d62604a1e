"""Near-duplicate vectors by cosine: int8 tile products with error bounds, exact where in doubt.

Vectors of equal entries are one class. Each class's vector is scaled to length 1 and
quantised to int8 with a scale of its own, x = s q + e; the length of e is at most the class's
error. For two of them

    x.y = s s' q.q' + (rest),  |rest| <= error (1 + error') + error'

so products of int8 tiles, whole numbers and exact, show which pairs can reach the threshold.
Only those are worked out in double precision.

The classes are dealt into groups of about ``GROUP``, and each pair of groups is a task of its
own. A task gives back a number of links per class and such links only as join something, so
pairs within a large group of near copies are counted but never listed. All vectors are
compared: the work grows with the square of their number, the copies that the shuffle makes
of a class with the number of groups.

Nulls and ties: a vector that is null, empty or zero, or holds a null, infinite or undefined
entry, links with nothing. Missing entries of shorter vectors count as 0. Each row is judged
by its own vector: rows of one id are vectors of their own, equal rows are linked with each
other, and a null id counts as after all others. An empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.llm.components import components
from roadlake.session import pin

LAST = 2**63 - 1
THRESHOLD = 0.9
#: Classes of a group; a task holds two groups.
GROUP = 4096
#: Classes along a side of a tile.
TILE = 1024
#: int8 products of so many entries are exact in single precision.
EXACT_ENTRIES = 1024
#: Pairs worked out in double precision at once.
PAIRS = 65_536
#: More than all the rounding in a bound.
SLACK = 1e-9
FOUND = "a long, b long, links long"


def comparable(vector: Column) -> Column:
    """The entries as doubles without trailing zeros; null if it links with nothing."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    numbers = F.transform(vector, lambda c: c.cast("double") + F.lit(0.0))  # no -0.0
    used = F.array_max(
        F.transform(numbers, lambda c, place: F.when(c != 0, place + 1).otherwise(0))
    )
    return F.when(~bad & (used > 0), F.slice(numbers, 1, used))


class _Members:
    """The classes of one task: unit vectors, their int8 form, scales and errors."""

    def __init__(self, vectors: list[list[float]]) -> None:
        size = max(map(len, vectors))
        self.vectors = np.zeros((len(vectors), size))
        for row, vector in enumerate(vectors):
            self.vectors[row, : len(vector)] = vector
        # Scaled by the largest entry first, so that no square leaves the range of a double.
        self.vectors /= np.abs(self.vectors).max(axis=1, keepdims=True)
        self.vectors /= np.linalg.norm(self.vectors, axis=1, keepdims=True)
        self.scales = np.abs(self.vectors).max(axis=1) / 127
        self.small = np.rint(self.vectors / self.scales[:, None]).astype(np.int8)
        off = self.vectors - self.small * self.scales[:, None]
        self.errors = np.linalg.norm(off, axis=1) + SLACK
        self.labels = np.arange(len(vectors))

    def products(self, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        total = None
        for start in range(0, self.small.shape[1], EXACT_ENTRIES):
            part = slice(start, start + EXACT_ENTRIES)
            found = self.small[own, part].astype(np.float32) @ self.small[other, part].astype(
                np.float32
            ).T
            total = found if total is None else total.astype(float) + found
        return total

    def pairs(self, own: np.ndarray, other: np.ndarray, threshold: float):
        """Pairs of a tile with a cosine of the threshold or more, as places of rows."""
        products = self.products(own, other)
        # First one bound for each row of the tile: the largest scale and error it may meet.
        widest, worst = self.scales[other].max(), self.errors[other].max()
        needed = (threshold + 1 - (1 + self.errors[own]) * (1 + worst)) / self.scales[own] / widest
        # A bound of 0 or less rules nothing out, whatever the scales.
        needed = np.where(needed > 0, needed - 1, -np.inf)
        a, b = np.nonzero(products >= needed[:, None].astype(products.dtype))
        near = products[a, b].astype(float)
        a, b = own[a], other[b]
        rest = (1 + self.errors[a]) * (1 + self.errors[b]) - 1
        maybe = near * self.scales[a] * self.scales[b] + rest >= threshold
        a, b = a[maybe], b[maybe]
        found = [
            np.einsum("ij,ij->i", self.vectors[a[k : k + PAIRS]], self.vectors[b[k : k + PAIRS]])
            for k in range(0, len(a), PAIRS)
        ]
        linked = np.concatenate([*found, []]) >= threshold
        return a[linked], b[linked]

    def joins(self, a: np.ndarray, b: np.ndarray):
        """Of the links (a, b), those that join what no earlier link has joined."""
        apart = self.labels[a] != self.labels[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        rows, starts = np.unique(a, return_index=True)
        for row, others in zip(rows, np.split(b, starts[1:]), strict=True):
            labels, first = np.unique(self.labels[others], return_index=True)
            new = labels != self.labels[row]
            for at in first[new]:
                yield row, others[at]
            if new.any():
                self.labels[np.isin(self.labels, labels[new])] = self.labels[row]


def _compare(threshold: float, tile: int):
    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        left, right = (k.as_py() for k in key)
        table = table.sort_by("node")
        nodes, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        groups = table.column("block").to_numpy()
        members = _Members(table.column("vector").to_pylist())
        own, other = np.flatnonzero(groups == left), np.flatnonzero(groups == right)
        links, joins = np.zeros(len(nodes), np.int64), []
        for start in range(0, len(own), tile):
            rows = own[start : start + tile]
            for at in range(start if left == right else 0, len(other), tile):
                a, b = members.pairs(rows, other[at : at + tile], threshold)
                if left == right and at == start:
                    a, b = a[a < b], b[a < b]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                joins += members.joins(a, b)
        rows = np.array(joins, np.int64).reshape(-1, 2)
        counted = np.flatnonzero(links)
        none = pa.nulls(len(rows), pa.int64())
        return pa.table(
            {
                "a": np.concatenate([nodes[rows[:, 0]], nodes[counted]]),
                "b": pa.chunked_array(
                    [pa.array(nodes[rows[:, 1]]), pa.nulls(len(counted), pa.int64())], pa.int64()
                ),
                "links": pa.chunked_array([none, pa.array(links[counted])], pa.int64()),
            }
        )

    return compare


def near_duplicate_vectors(
    embeddings: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    group: int = GROUP,
    tile: int = TILE,
) -> DataFrame:
    """Per row: the id, ``n_links``, ``component_id`` and ``kept``; ``threshold`` is above 0."""
    vector = comparable(F.col(f"`{vector_col}`"))
    rows = embeddings.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("doc"),
        F.col(f"`{id_col}`").isNull().alias("nameless"),
        vector.alias("vector"),
    )
    digests = [F.xxhash64("vector").alias("d1"), F.xxhash64(F.lit(1), "vector").alias("d2")]
    of_class = [F.when(F.col("vector").isNotNull(), d) for d in digests]
    rows = pin(rows.withColumns({"d1": of_class[0], "d2": of_class[1]}), "vectors")
    classes = (
        rows.where("vector is not null")
        .groupBy("d1", "d2")
        .agg(
            F.min("doc").alias("rep"),
            F.count("*").alias("copies"),
            F.first("vector").alias("vector"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = pin(classes, "vector-classes")
    groups = max(1, -(-classes.count() // group))
    block = F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    spread = classes.select("node", "copies", "vector", block.alias("block"), other.alias("other"))
    task = [F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")]
    found = pin(spread.groupBy(*task).applyInArrow(_compare(threshold, tile), FOUND), "vector-links")
    links = found.where("links is not null").groupBy(F.col("a").alias("node")).agg(
        F.sum("links").alias("links")
    )
    joined = components(found.where("b is not null").select("a", "b"))
    ids = joined.join(classes.select("node", "rep"), "node")
    least = ids.groupBy("component").agg(F.min("rep").alias("least"))
    of = (
        classes.select("node", "d1", "d2", "rep", "copies")
        .join(links, "node", "left")
        .join(joined.join(least, "component").select("node", "least"), "node", "left")
        .select(
            "d1",
            "d2",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("least", "rep").alias("least"),
        )
    )
    least = F.coalesce("least", "doc")
    judged = rows.drop("vector").join(of, ["d1", "d2"], "left")
    return judged.select(
        F.when(~F.col("nameless"), F.col("doc")).alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(~(F.col("nameless") & (least == LAST)), least).alias("component_id"),
        (F.col("doc") == least).alias("kept"),
    )

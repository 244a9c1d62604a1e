"""Exact top-k inner products by block-at-a-time pruning.

The dimensions are the terms. Vectors lie in blocks by range of their id; a block is one
row with its ids, its vectors (the block forward index) and the largest and smallest
value of each term. The bound of a query in a block is the sum over terms of its largest
possible product. Each task takes the stated queries in portions of ``QUERIES``, looks at
its blocks for each query from the highest bound down, and stops once the bound is below
the k-th score so far. Equal bounds are still scored, since ties go to the smaller id.

Values are whole numbers, ``floor(256 * x)``; scores are exact while the sum of the
absolute products stays below 2^53, computed with Python integers beyond, and stop at
the ends of a 64-bit number.

Nulls and ties: vectors that are null or hold a null, infinite or undefined component,
and rows without an id, take no part. Missing components of shorter vectors count as 0.
Rows with one id are rows of their own; a query never meets its own row. An empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.llm.text import slices
from roadlake.session import pin

K = 5
SCALE = 256
BLOCK = 128
QUERIES = 2_048
#: Blocks that are ordered by bound together.
TOGETHER = 256
EXACT = 2.0**53
LAST = 2**63 - 1

BLOCKS = "block long, size int, terms int, ids binary, vectors binary"
HITS = "query_block long, query_row int, query_id long, vec_id long, score long"


def whole_numbers(vector: Column) -> Column:
    """floor(256 * x) of each component; null if the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of up to BLOCK neighbours; their number continues the task's."""
    task, made = None, 0
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            task = part.column(0)[0].as_py()
            vectors = part.column(2).to_pylist()
            terms = max(map(len, vectors))
            values = np.zeros((len(vectors), terms), np.int64)
            for row, vector in enumerate(vectors):
                values[row, : len(vector)] = vector
            ids = part.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task * 2**32 + made], pa.int64()),
                    pa.array([len(vectors)], pa.int32()),
                    pa.array([terms], pa.int32()),
                    pa.array([ids.tobytes()], pa.binary()),
                    pa.array([values.tobytes()], pa.binary()),
                ],
                names=["block", "size", "terms", "ids", "vectors"],
            )
            made += 1


class _Block:
    def __init__(self, row: dict) -> None:
        self.number = row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.values = np.frombuffer(row["vectors"], np.int64).reshape(row["size"], row["terms"])

    def widened(self, terms: int) -> np.ndarray:
        return np.pad(self.values, ((0, 0), (0, terms - self.values.shape[1])))


def _rows(batch: pa.RecordBatch) -> list[_Block]:
    return [_Block(r) for r in batch.to_pylist()]


def _queries(every: int):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (b.number, row, int(b.ids[row]), b.values[row].tolist())
                for b in _rows(batch)
                for row in np.flatnonzero(b.ids % every == 0).tolist()
            ]
            names = ["block", "row", "id", "vector"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names
            )

    return pick


class _Best:
    """The k best rows of each query so far: by score, then by smaller id."""

    def __init__(self, queries: int, k: int, kind) -> None:
        self.scores = np.full((queries, k), -np.inf, kind)
        self.ids = np.full((queries, k), LAST, np.int64)

    def add(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate([self.scores[query], scores], axis=1)
        ids = np.concatenate([self.ids[query], np.broadcast_to(ids, (len(query), len(ids)))], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.ids.shape[1]]
        self.scores[query] = np.take_along_axis(scores, order, axis=1)
        self.ids[query] = np.take_along_axis(ids, order, axis=1)


def _search(shared, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_block, q_row, q_id, vectors = shared.value
        best = None
        for part in slices(batches, TOGETHER):
            blocks = _rows(part)
            terms = max(vectors.shape[1], *(b.values.shape[1] for b in blocks))
            asked = np.pad(vectors, ((0, 0), (0, terms - vectors.shape[1])))
            stored = [b.widened(terms) for b in blocks]
            top = np.array([v.max(axis=0) for v in stored])
            low = np.array([v.min(axis=0) for v in stored])
            size = np.maximum(np.abs(top.astype(float)), np.abs(low.astype(float))).max(axis=0)
            reach = (np.abs(asked.astype(float)) @ size).max(initial=0)
            kind = float if reach < EXACT else object
            asked, top, low, stored = (
                asked.astype(kind), top.astype(kind), low.astype(kind), [v.astype(kind) for v in stored]
            )
            if best is None:
                best = _Best(len(asked), k, kind)
            elif kind is object and best.scores.dtype != object:
                best.scores = best.scores.astype(object)
            positive, negative = np.maximum(asked, 0), np.minimum(asked, 0)
            bounds = positive @ top.T + negative @ low.T
            order = np.argsort(-bounds, axis=1, kind="stable")
            live = np.arange(len(asked))
            for step in range(len(blocks)):
                at = order[live, step]
                live = live[bounds[live, at] >= best.scores[live, -1]]
                at = order[live, step]
                for number in np.unique(at):
                    query = live[at == number]
                    scores = asked[query] @ stored[number].T
                    own = np.flatnonzero(q_block[query] == blocks[number].number)
                    scores[own, q_row[query[own]]] = -np.inf
                    best.add(query, scores, blocks[number].ids)
                if not len(live):
                    break
        if best is not None:
            query, place = np.nonzero(best.scores != -np.inf)
            scores = [max(-LAST, min(LAST, int(x))) for x in best.scores[query, place]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(q_block[query], pa.int64()),
                    pa.array(q_row[query], pa.int32()),
                    pa.array(q_id[query], pa.int64()),
                    pa.array(best.ids[query, place], pa.int64()),
                    pa.array(scores, pa.int64()),
                ],
                names=["query_block", "query_row", "query_id", "vec_id", "score"],
            )

    return search


def top_products(
    vectors: DataFrame,
    every: int = 50,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k best rows of each query.

    Queries are the rows whose id is divisible by ``every``.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        whole_numbers(F.col(f"`{vector_col}`")).alias("vector"),
    ).where("id is not null and vector is not null")
    rows = rows.repartitionByRange("id").sortWithinPartitions("id")
    blocks = rows.select(F.spark_partition_id().cast("long").alias("task"), "id", "vector")
    blocks = pin(blocks.mapInArrow(_pack, BLOCKS), "blocks")
    queries = blocks.mapInArrow(_queries(every), "block long, row int, id long, vector array<long>")
    queries = pin(queries, "queries")
    portions = max(1, -(-queries.count() // QUERIES))
    found = None
    for portion in range(portions):
        in_portion = F.pmod(F.xxhash64("block", "row"), F.lit(portions)) == portion
        asked = queries.where(in_portion).orderBy("block", "row").collect()
        terms = max((len(r["vector"]) for r in asked), default=0)
        values = np.zeros((len(asked), terms), np.int64)
        for row, query in enumerate(asked):
            values[row, : len(query["vector"])] = query["vector"]
        columns = [np.array([r[c] for r in asked], np.int64) for c in ("block", "row", "id")]
        shared = spark.sparkContext.broadcast((*columns, values))
        hits = blocks.mapInArrow(_search(shared, k), HITS)
        found = hits if found is None else found.unionByName(hits)
    best = Window.partitionBy("query_block", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

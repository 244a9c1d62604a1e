"""Whitening of embeddings: pivoted Cholesky, then one-sided Jacobi on the triangular factor.

Components are scaled to whole numbers, ``floor(1024 * c) + 100000``. One pass over the
vectors sums them; a second adds up, task by task, the products of what is left after the
mean is taken away. The sum over tasks is the centred scatter, a matrix of the number of
dimensions squared (``MOST_DIMENSIONS`` bounds it), which the driver factors:

1. Cholesky with the largest remaining diagonal element as pivot gives P' S P = L L', and
   stops where what remains is rounding;
2. plane rotations make the columns of L orthogonal. Their squared norms are the eigenvalues
   of S, the normalised columns, put back into the order of the dimensions, its eigenvectors.
   S is never rotated itself, so small eigenvalues keep their digits.

A third pass measures the covariance of the whitened vectors.

Nulls and ties: a vector that is null or holds a null, infinite or undefined entry takes no
part. Missing entries of shorter vectors count as 0; an empty vector is all missing. Rows
alike, or alike in id, are rows of their own; a null id stays null. A component of no
variance cannot be whitened and is not returned, so vectors that are all alike, like an empty
table, give an empty result. Components of equal eigenvalue may come in any order, the same
for all rows. Whole numbers stop at the ends of a long, and so does the deviation. Other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.llm.text import slices

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: The driver and each task hold matrices of this many dimensions squared (8 bytes each).
MOST_DIMENSIONS = 4096
LAST = 2**63 - 1
EPS = np.finfo(float).eps
SUMS = "place int, other int, total double"
WHITENED = (
    "id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double"
)


def whole_numbers(vector: Column) -> Column:
    """floor(1024 * c) + 100000 of each entry; null if the vector takes no part."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))

    def scaled(c: Column) -> Column:
        return F.least(F.floor(c.cast("double") * SCALE), F.lit(LAST - OFFSET)) + OFFSET

    return F.when(~bad, F.transform(vector, scaled))


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """The factor F of matrix = F F', rows in the matrix's order, as many columns as its rank.

    F is triangular but for the order of its rows, which is that of the pivots.
    """
    rest = matrix.diagonal().copy()
    size = len(rest)
    factor = np.zeros((size, size))
    least = size * EPS * max(rest.max(initial=0), 0)
    order = np.arange(size)
    for k in range(size):
        at = k + int(np.argmax(rest[order[k:]]))
        pivot = order[at]
        if rest[pivot] <= least:
            return factor[:, :k]
        order[[k, at]] = order[[at, k]]
        below = order[k + 1 :]
        factor[pivot, k] = np.sqrt(rest[pivot])
        left = matrix[below, pivot] - factor[below, :k] @ factor[pivot, :k]
        factor[below, k] = left / factor[pivot, k]
        rest[below] -= factor[below, k] ** 2
    return factor


def _rounds(size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of ``size`` columns once, in rounds of disjoint pairs."""
    players = np.arange(size + size % 2)
    for _ in range(len(players) - 1):
        half = len(players) // 2
        left, right = players[:half], players[half:][::-1]
        real = (left < size) & (right < size)
        yield left[real], right[real]
        players = np.concatenate([players[:1], np.roll(players[1:], 1)])


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` rotated from the right until its columns are orthogonal, longest first."""
    columns = factor.copy()
    for _ in range(sweeps):
        turned = False
        for left, right in _rounds(columns.shape[1]):
            a, b = columns[:, left], columns[:, right]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            open_ = np.abs(ab) > EPS * np.sqrt(aa * bb)
            if not open_.any():
                continue
            turned = True
            a, b, left, right = a[:, open_], b[:, open_], left[open_], right[open_]
            zeta = (bb[open_] - aa[open_]) / (2 * ab[open_])
            tangent = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            cosine = 1 / np.hypot(1, tangent)
            sine = cosine * tangent
            columns[:, left], columns[:, right] = cosine * a - sine * b, sine * a + cosine * b
        if not turned:
            break
    norms = np.linalg.norm(columns, axis=0)
    return columns[:, np.argsort(-norms, kind="stable")]


@dataclass(frozen=True)
class Whitening:
    n: int
    #: Exact sum per dimension.
    sums: tuple[int, ...]
    #: dimensions x components; columns are unit eigenvectors of the covariance.
    components: np.ndarray
    #: Eigenvalues of the covariance (divisor n), falling.
    values: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace

    def deviations(self, numbers: np.ndarray) -> np.ndarray:
        """n * x - S of each row of whole numbers."""
        exact = self.n * max(int(np.abs(numbers).max(initial=0)), 1) < 2**62
        kind = np.int64 if exact else object
        return self.n * numbers.astype(kind) - np.array(self.sums, kind)

    def whiten(self, deviations: np.ndarray) -> np.ndarray:
        centred = deviations.astype(float) / self.n
        return centred @ self.components / np.sqrt(self.values)


def _numbers(part: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    """The vectors of a batch as rows of whole numbers; missing entries are those of 0."""
    lists = part.column(column)
    found = np.full((part.num_rows, size), OFFSET, np.int64)
    lengths = np.diff(lists.offsets.to_numpy())
    if len(lengths) and (lengths == size).all():
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(found.shape)
    for row, vector in enumerate(lists.to_pylist()):
        found[row, : len(vector)] = vector
    return found


def _products(size: int, rows_of: Callable[[pa.RecordBatch], np.ndarray]):
    """One task's sum of products of every two columns, and of single ones (other = -1)."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products, met = np.zeros(size), np.zeros((size, size)), False
        for part in slices(batches, 4096):
            rows, met = rows_of(part), True
            total += rows.sum(axis=0)
            products += rows.T @ rows
        if met:
            place, other = np.divmod(np.arange(size * size, dtype=np.int32), np.int32(size))
            single = np.arange(size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([place, single])),
                    pa.array(np.concatenate([other, np.full(size, -1, np.int32)])),
                    pa.array(np.concatenate([products.ravel(), total])),
                ],
                names=["place", "other", "total"],
            )

    return add_up


def _covariance(vectors: DataFrame, n: int, size: int, rows_of) -> np.ndarray:
    """Covariance of what ``rows_of`` makes of the vectors, whose columns are about centred."""
    parts = vectors.mapInArrow(_products(size, rows_of), SUMS)
    totals = parts.groupBy("place", "other").agg(F.sum("total").alias("total"))
    found, means = np.zeros((size, size)), np.zeros(size)
    for row in totals.collect():
        if row["other"] < 0:
            means[row["place"]] = row["total"] / n
        else:
            found[row["place"], row["other"]] = row["total"] / n
    # The columns have means of rounding size; what that adds to the products goes again.
    return found - np.outer(means, means)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all ``vectors`` (column ``vector`` of whole numbers); None if none."""
    each = vectors.select(F.posexplode(F.concat(F.array(F.lit(None).cast("long")), "vector")))
    sums = each.groupBy("pos").agg(
        F.count("*").alias("rows"), F.sum(F.col("col").cast("decimal(38,0)")).alias("total")
    )
    found = {r["pos"] - 1: r for r in sums.limit(MOST_DIMENSIONS + 2).collect()}
    if not found:
        return None
    n, size = found.pop(-1)["rows"], len(found)
    if size > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")
    of = [found[k] for k in range(size)]
    totals = tuple(int(r["total"]) + (n - r["rows"]) * OFFSET for r in of)
    first = Whitening(n, totals, np.zeros((size, 0)), np.zeros(0), 1.0)

    def centred(part: pa.RecordBatch) -> np.ndarray:
        return first.deviations(_numbers(part, 0, size)).astype(float) / n

    covariance = _covariance(vectors.select("vector"), n, size, centred)
    rotated = one_sided_jacobi(pivoted_cholesky(covariance))[:, :components]
    norms = np.linalg.norm(rotated, axis=0)
    real = norms > 0
    rotated, norms = rotated[:, real], norms[real]
    trace = float(covariance.trace())
    return Whitening(n, totals, rotated / norms, norms**2, trace)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity."""
    size = len(model.sums)

    def whitened(part: pa.RecordBatch) -> np.ndarray:
        return model.whiten(model.deviations(_numbers(part, 0, size)))

    kept = len(model.values)
    covariance = _covariance(vectors.select("vector"), model.n, kept, whitened)
    return float(np.abs(covariance - np.eye(kept)).max(initial=0))


def _whitened(model: Whitening, error: float):
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, kept = len(model.sums), len(model.values)
        for part in slices(batches, 4096):
            far = model.deviations(_numbers(part, 1, size))
            most = int(np.abs(far).max(initial=0))
            exact = far if most**2 * size < 2**63 else far.astype(object)
            squares = [min(LAST, int(x)) for x in (exact * exact).sum(axis=1)]
            rows = np.repeat(np.arange(part.num_rows), kept)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), part.num_rows)),
                    pa.array(np.full(len(rows), model.n)),
                    pa.array(np.array(squares, np.int64)[rows]),
                    pa.array(model.whiten(far).ravel()),
                    pa.array(np.tile(model.explained, part.num_rows)),
                    pa.array(np.full(len(rows), error)),
                ],
                names=[c.split()[0] for c in WHITENED.split(", ")],
            )

    return whiten


def whiten_embeddings(
    embeddings: DataFrame,
    components: int = COMPONENTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Per vector and component: the id, ``component``, ``n``, ``deviation``, ``whitened``,
    ``explained`` and the fit's ``identity_error``."""
    vectors = embeddings.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        whole_numbers(F.col(f"`{vector_col}`")).alias("vector"),
    ).where("vector is not null")
    model = fit(vectors, components)
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], WHITENED).withColumnRenamed("id", id_col)
    found = vectors.mapInArrow(_whitened(model, identity_error(vectors, model)), WHITENED)
    return found.withColumnRenamed("id", id_col)

"""Merkle manifest, whitening and near-duplicate vectors, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlake.llm import merkle, vector_dedup, whitening
from tests.llm.fixtures import ODD_COLUMNS, ODD_VALUES

LAST = 2**63 - 1


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


# Merkle manifest


def hashed(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(row: tuple) -> str:
    """Of (doc_id, source, lang, n_chars, text)."""
    return hashed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hashed(*below[k : k + 3]) for k in range(0, len(below), 3)])
    return levels


def beside(levels: list[list[str]], at: int) -> list[tuple[list[str], list[str]]]:
    path = []
    for level in levels[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        path.append((run[: at % 3], run[at % 3 + 1 :]))
        at //= 3
    return path


def plain_manifest(rows: list[tuple]) -> Counter:
    by_source: dict = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for of_source in by_source.values():
        of_source.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = [levels_of([leaf_of(r) for r in by_source[s]]) for s in names]
    top = levels_of([t[-1][0] for t in trees])
    out = Counter()
    for at, name in enumerate(names):
        for place, row in enumerate(by_source[name]):
            path = beside(trees[at], place) + beside(top, at)
            doc, *middle, text = row
            if doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf_of((doc, *middle, text))
            for left, right in path:
                folded = hashed(*left, folded, *right)
            proof = hashed(*(d for left, right in path for d in left + right))
            root = top[-1][0]
            out[doc, leaf_of(row), trees[at][-1][0], root, proof, folded, folded == root] += 1
    return out


def manifest_rows(n: int) -> list[tuple]:
    rng, rows = random.Random(n), []
    for k in range(n):
        source = "a" if k % 2 else rng.choice(["b", "é", "Z", "", f"rare{k}", None])
        doc = rng.choice([None, k, k, k, 7, -k])
        text = rng.choice([None, "", "one\ntwo\n", "É\n" * 3, f"text {k}"])
        rows.append((doc, source, rng.choice([None, "en"]), rng.choice([None, 5, 0]), text))
    # Rows alike in everything, more than a page holds.
    return rows + rows[:1] * (n // 3)


def manifest_table(spark, rows):
    columns = "doc_id long, source string, lang string, n_chars long, text string"
    odd = "tree int, digest string, rank string, children long, at int, row string"
    data = [(*r, 1, "d", "r", 5, 2, "x") for r in rows]
    return spark.createDataFrame(data, f"{columns}, {odd}").repartition(3)


@pytest.mark.parametrize("n", [0, 1, 4, 700])
def test_manifest(spark, n):
    rows = manifest_rows(n)
    assert as_rows(merkle.verified_leaves(manifest_table(spark, rows))) == plain_manifest(rows)


def test_manifest_of_one_source(spark):
    for n in (3, 82):
        rows = [(k, "only", None, None, "a\nb") for k in range(n)]
        assert as_rows(merkle.verified_leaves(manifest_table(spark, rows))) == plain_manifest(rows)


def test_each_leaf_is_found_on_request_alone(spark):
    rows = manifest_rows(200)
    manifest = merkle.build(manifest_table(spark, rows))
    some = manifest.leaves.where("id % 5 = 0")
    every = Counter((r["id"], r["leaf"], str(r["path"])) for r in merkle.prove(manifest).collect())
    found = Counter((r["id"], r["leaf"], str(r["path"])) for r in merkle.prove(manifest, some).collect())
    assert found.total() == some.count() > 10 and found <= every


def test_records_lead_from_the_root_to_every_leaf(spark):
    rows = [(k, f"s{k % 3}", None, None, "same") for k in range(300)]
    manifest = merkle.build(manifest_table(spark, rows))
    children: dict[str, list[str]] = {}
    for records in [*manifest.within.records, *manifest.above.records]:
        for record in records.collect():
            children.update(record["children"])
    for at, below in children.items():
        assert hashed(*below) == at
    reached, level = set(), [manifest.root]
    while level:
        reached.update(d for d in level if d not in children)
        level = [c for d in level for c in children.get(d, [])]
    assert reached == {leaf_of(r) for r in rows}


def test_equal_pages_have_one_record(spark):
    rows = [(None, "s", None, None, "same")] * (merkle.PAGE * 5)
    manifest = merkle.build(manifest_table(spark, rows))
    assert manifest.within.records[0].count() == 1
    assert as_rows(merkle.verified_leaves(manifest_table(spark, rows))) == plain_manifest(rows)


# Whitening


def whitening_rows(n: int, size: int, seed: int = 2) -> list[tuple]:
    rng = np.random.default_rng(seed)
    turn = rng.normal(size=(size, size))
    values = (rng.normal(size=(n, size)) * np.linspace(2, 0.1, size)) @ turn + 5
    rows = [(k if k % 7 else 0, [float(np.float32(c)) for c in v]) for k, v in enumerate(values)]
    rows += [rows[3], rows[3], (None, rows[4][1])]
    rows += [(-1, None), (-2, [None] * size), (-3, [math.nan] * size), (-4, [math.inf] * size)]
    return rows


def vector_table(spark, rows):
    schema = f"vec_id long, embedding array<float>, {ODD_COLUMNS}, vector int, node long"
    return spark.createDataFrame([(*r, *ODD_VALUES, 3, 4) for r in rows], schema).repartition(3)


def whole(rows: list[tuple], size: int) -> np.ndarray:
    good = [v for _, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    padded = [v + [0.0] * (size - len(v)) for v in good]
    return np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in padded])


def check_whitening(spark, rows, size, kept=8):
    x = whole(rows, size)
    n = len(x)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(kept, int((values > 1e-9 * values[0]).sum()))
    expected = centred @ vectors[:, :kept] / np.sqrt(values[:kept])
    sums = x.sum(axis=0)
    found = whitening.whiten_embeddings(vector_table(spark, rows)).collect()
    assert len(found) == n * kept
    by_component = {k: [r for r in found if r["component"] == k] for k in range(1, kept + 1)}
    for k, of in by_component.items():
        assert all(r["n"] == n and abs(r["identity_error"]) <= 1e-9 for r in of)
        assert all(abs(r["explained"] / (values[k - 1] / values.sum()) - 1) <= 1e-9 for r in of)
        plain = np.sort(expected[:, k - 1])
        whitened = np.sort([r["whitened"] for r in of])
        either = min(np.abs(whitened - plain).max(), np.abs(np.sort(-whitened) - plain).max())
        assert either <= 1e-8
        exact = sorted(sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, sums)) for row in x)
        assert sorted(r["deviation"] for r in of) == exact


def test_whitening(spark):
    check_whitening(spark, whitening_rows(300, 12), 12)


def test_whitening_of_few_or_short_vectors(spark):
    rows = whitening_rows(300, 12)
    short = [(900 + k, v[: 3 + k % 9]) for k, (_, v) in enumerate(rows[:40])] + [(999, [])]
    check_whitening(spark, rows + short, 12)
    # Four vectors span three dimensions at most.
    check_whitening(spark, rows[:4], 12)


def test_signs_and_figures_are_the_same_for_all_rows(spark):
    rows = whitening_rows(200, 10)
    found = whitening.whiten_embeddings(vector_table(spark, rows)).toPandas()
    assert found.groupby("component")["explained"].nunique().eq(1).all()
    assert found["identity_error"].nunique() == 1
    alike = found[found["vec_id"] == rows[3][0]].groupby("component")["whitened"].nunique()
    assert alike.eq(1).all()


def test_vectors_without_variance_have_no_components(spark):
    table = vector_table(spark, [(k, [1.0, 2.0]) for k in range(5)])
    for rows in (table, table.where("false")):
        found = whitening.whiten_embeddings(rows)
        assert found.collect() == []
        assert [f.split()[1] for f in whitening.WHITENED.split(", ")] == [
            {"bigint": "long"}.get(t, t) for _, t in found.dtypes
        ]


def test_deviations_stop_at_the_end_of_a_long(spark):
    rows = [(k, [float(k % 2) * 3e12, 1.0]) for k in range(10)]
    found = whitening.whiten_embeddings(vector_table(spark, rows)).collect()
    assert {r["deviation"] for r in found} == {LAST}
    assert {round(abs(r["whitened"]), 9) for r in found} == {1.0}
    rows = [(k, [1e30 if k % 2 else -1e38, float(k % 3)]) for k in range(12)]
    found = whitening.whiten_embeddings(vector_table(spark, rows)).collect()
    assert {r["deviation"] for r in found} == {LAST} and len(found) >= 12


def test_cholesky_and_jacobi_factor_any_rank():
    rng = np.random.default_rng(1)
    for size, rank in ((1, 1), (7, 7), (12, 5), (30, 30)):
        base = rng.normal(size=(size, rank)) * 10.0 ** rng.integers(-3, 3, rank)
        matrix = base @ base.T
        factor = whitening.pivoted_cholesky(matrix)
        assert factor.shape == (size, rank)
        assert np.abs(factor @ factor.T - matrix).max() <= 1e-12 * np.abs(matrix).max()
        # In the order of the pivots the rows end on the diagonal.
        lasts = {int(np.flatnonzero(row)[-1]) for row in factor}
        assert lasts == set(range(rank))
        rotated = whitening.one_sided_jacobi(factor)
        norms = np.linalg.norm(rotated, axis=0)
        values = np.linalg.eigvalsh(matrix)[::-1][:rank]
        assert np.abs(norms**2 - values).max() <= 1e-12 * values[0]
        inner = (rotated / norms).T @ (rotated / norms)
        assert np.abs(inner - np.eye(rank)).max() <= 1e-10


# Near-duplicate vectors


def plain_links(rows: list[tuple], threshold: float = 0.9) -> Counter:
    def fits(v):
        return v and all(c is not None and math.isfinite(c) for c in v) and any(v)

    size = max((len(v) for _, v in rows if fits(v)), default=1)
    x = np.zeros((len(rows), size))
    good = np.array([bool(fits(v)) for _, v in rows], bool)
    for k in np.flatnonzero(good):
        x[k, : len(rows[k][1])] = rows[k][1]
        x[k] /= np.linalg.norm(x[k])
    linked = (x @ x.T >= threshold) & good & good[:, None]
    np.fill_diagonal(linked, False)
    least = np.array([LAST if i is None else i for i, _ in rows], dtype=np.int64)
    ids = least.copy()
    while True:
        near = np.where(linked, least, LAST).min(axis=1, initial=LAST)
        if (near >= least).all():
            break
        least = np.minimum(near, least)
    out = Counter()
    for k, (doc, _) in enumerate(rows):
        component = None if least[k] == LAST else int(least[k])
        out[doc, int(linked[k].sum()), component, bool(ids[k] == least[k])] += 1
    return out


def near_rows(seed: int = 3) -> list[tuple]:
    rng = np.random.default_rng(seed)
    bases = rng.normal(size=(25, 16))
    rows = []
    for k in range(350):
        v = bases[k % 25] * rng.choice([1e-3, 1, 50]) if k % 3 else rng.normal(size=16)
        v = v + np.linalg.norm(v) / 4 * rng.normal(size=16) * rng.choice([0.1, 0.4, 0.5])
        rows.append((None if k % 60 == 0 else k * 2 // 3, [float(np.float32(c)) for c in v]))
    rows += [(5000 + k, rows[5][1]) for k in range(30)] + [(9, None), (10, [0.0] * 16)]
    rows += [(11, [math.nan] * 16), (12, [None] * 16), (13, []), (14, [1.0, 0.0]), (15, [2.0])]
    return rows + [(None, [3.0, -0.0, 0.0]), (16, [math.inf] + [0.0] * 15), (17, [1e30] * 16)]


@pytest.mark.parametrize("group,tile", [(10_000, 1024), (60, 17), (1, 1)])
def test_near_duplicate_vectors(spark, group, tile):
    rows = near_rows()[:: 12 if group == 1 else 1]
    table = vector_table(spark, rows)
    found = vector_dedup.near_duplicate_vectors(table, group=group, tile=tile)
    assert as_rows(found) == plain_links(rows)


def test_near_duplicate_vectors_of_an_empty_table(spark):
    table = vector_table(spark, near_rows()[:3]).where("false")
    found = vector_dedup.near_duplicate_vectors(table)
    assert found.dtypes == [
        ("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")
    ]
    assert found.collect() == []


def test_a_large_group_is_counted_but_not_listed(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(k, (base + rng.normal(size=8) * 1e-3).tolist()) for k in range(400)]
    found = vector_dedup.near_duplicate_vectors(vector_table(spark, rows)).collect()
    assert {(r["n_links"], r["component_id"]) for r in found} == {(399, 0)}
    members = vector_dedup._Members([v for _, v in rows])
    a, b = members.pairs(np.arange(400), np.arange(400), 0.9)
    assert len(list(members.joins(a, b))) == 399


def test_bounds_hold_and_rule_most_pairs_out():
    rng = np.random.default_rng(5)
    for size in (2, 64, 1500):
        members = vector_dedup._Members(rng.normal(size=(200, size)).tolist())
        places = np.arange(200)
        near = members.products(places, places) * np.outer(members.scales, members.scales)
        rest = np.outer(1 + members.errors, 1 + members.errors) - 1
        exact = members.vectors @ members.vectors.T
        assert (np.abs(near - exact) <= rest).all()
        if size == 64:
            assert (near + rest >= 0.9).sum() == 200


def test_cosines_at_the_threshold(spark):
    near, far = 0.9, np.nextafter(0.9, 0)
    rows = [(1, [1.0, 0.0]), (2, [near, math.sqrt(1 - near**2)]), (3, [far * 3, -3 * math.sqrt(1 - far**2) * 1.000001])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["component_id"] for r in vector_dedup.near_duplicate_vectors(table).collect()}
    assert found[3] == 3
    assert table.select(F.max("vec_id")).first()[0] == 3

"""Small tables with nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

ODD_COLUMNS = "doc long, text_hash string, size string, shard long, row string, n string"
ODD_VALUES = (1, "x", "y", 7, "z", "w")


def words(rng: random.Random, n: int, names: int = 400) -> list[str]:
    return [f"w{rng.randrange(names)}" for _ in range(n)]


def edited(rng: random.Random, base: list[str], edits: int) -> list[str]:
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def texts(seed: int = 5) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    bases = [words(rng, 60) for _ in range(6)]
    common = "This Line Is In Many Texts"
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, "   \t "), (4, "two words"), (5, "Two  WORDS"), (6, "two words"),
        (6, "two words"), (None, "text without an id " + common), (None, None), (7, "É\n\nÉ\x0b\n"),
        (8, "\n".join([common] * 3)), (9, " ".join(words(rng, 30_000))),
    ]
    for k in range(10, 130):
        body = edited(rng, bases[k % 6], rng.randrange(0, 5))
        lines = [" ".join(body[j : j + 15]) for j in range(0, 60, 15)]
        lines += [f"  {common.upper() if k % 2 else common}\t"] * (k % 3)
        rows.append((k, "\n".join(lines)))
    rows.append(rows[-1])
    return rows


def documents(spark, rows=None):
    """The texts with source and columns named like the operators' own."""
    rows = texts() if rows is None else rows
    sources = ["b", "a", None, "c"]
    data = [(i, t, sources[k % 4] if k % 3 else "a", *ODD_VALUES) for k, (i, t) in enumerate(rows)]
    schema = f"doc_id long, text string, source string, {ODD_COLUMNS}"
    return spark.createDataFrame(data, schema).repartition(3)

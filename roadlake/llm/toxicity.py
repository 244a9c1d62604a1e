"""Toxicity by logistic regression, trained with FTRL-proximal on hashed features.

Features of a text are its distinct words, pairs of neighbours and pairs that skip one
word, hashed to ``2 ** BITS`` places. Training takes at most ``TRAIN_ROWS`` labelled
rows, those with the least hash of the id; they are dealt to tasks of about
``WORKER_ROWS``, each of which runs FTRL-proximal with per-coordinate rates over its
rows, and the weights are averaged. L1 leaves few weights, which are broadcast; their
number is bounded by the number of places.

Scores use the text alone. Nulls and ties: a null or empty text has no features and gets
the score of the bias. Rows of labels without an id or a label are left out; of several
labels of one id the highest counts, of several texts of a labelled id the one with the
least hash. Without labelled rows nothing is learned:
all scores are 0.5. Repeated rows get the same score; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.llm.text import WordHashes, mix, text_bytes

BITS = 20
#: Bound of the sample that the classifier is fitted on.
TRAIN_ROWS = 16_384
WORKER_ROWS = 8_192
EPOCHS = 5
#: L1 is above what one text can add to a feature in all epochs, so that a weight needs
#: the evidence of several texts.
ALPHA, BETA, L1, L2 = 1.5, 1.0, 8.0, 0.05
MARKS = b".,;:!?\"'()[]{}<>*_-"
WEIGHTS = "place long, weight double"


def _bare(word: bytes) -> bytes:
    return word.strip(MARKS)


def _places(words: np.ndarray) -> np.ndarray:
    pairs = mix(words[:-1] * np.uint64(3) + mix(words[1:], 1), 2)
    skips = mix(words[:-2] * np.uint64(5) + mix(words[2:], 3), 4)
    every = np.concatenate([mix(words, 5), pairs, skips])
    return (every >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal; the last place is the bias."""

    def __init__(self) -> None:
        self.z = np.zeros(2**BITS + 1)
        self.n = np.zeros(2**BITS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        rate = (BETA + np.sqrt(n)) / ALPHA + L2
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / rate)

    def learn(self, places: np.ndarray, label: int) -> None:
        at = np.append(places, 2**BITS)
        weights, n = self.weights(at), self.n[at]
        slope = 1 / (1 + np.exp(-np.clip(weights.sum(), -35, 35))) - label
        self.z[at] += slope - (np.sqrt(n + slope**2) - np.sqrt(n)) / ALPHA * weights
        self.n[at] = n + slope**2


def _train(table: pa.Table) -> pa.Table:
    hashes, model = WordHashes(_bare), Ftrl()
    order = np.argsort(table.column("dice").to_numpy(), kind="stable")
    labels = table.column("toxic").to_numpy()
    texts = table.column("text").to_pylist()
    rows = [np.unique(_places(hashes.of(t.lower().split()))) for t in texts]
    for _ in range(EPOCHS):
        for k in order:
            model.learn(rows[k], int(labels[k]))
    places = np.arange(2**BITS + 1)
    weights = model.weights(places)
    kept = np.flatnonzero(weights)
    return pa.table({"place": places[kept], "weight": weights[kept]})


def held_out(doc: Column, parts: int = 5) -> Column:
    text = F.coalesce(doc.cast("string"), F.lit("")).cast("binary")
    return F.pmod(F.crc32(text), F.lit(parts)) == 0


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Broadcast:
    """Weights learned from the labelled rows that are not held out."""
    doc = F.col(f"`{id_col}`").cast("long")
    label = F.col(f"`{label_col}`").cast("int")
    known = labels.where(doc.isNotNull() & label.isNotNull() & ~held_out(doc))
    known = known.groupBy(doc.alias("doc")).agg(F.max(label).alias("toxic"))
    known = known.withColumn("dice", F.xxhash64("doc", F.lit("train")))
    sample = known.orderBy("dice", "doc").limit(TRAIN_ROWS)
    texts = docs.select(doc.alias("text_doc"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    # At most TRAIN_ROWS rows of three numbers.
    rows = texts.join(F.broadcast(sample), F.col("text_doc") == F.col("doc"))
    # Texts of one id fold before they meet, so a task has one for each of its ids.
    least = F.min_by("text", F.xxhash64("text")).alias("text")
    rows = rows.groupBy("doc", "dice", "toxic").agg(least)
    workers = max(1, -(-sample.count() // WORKER_ROWS))
    worker = F.pmod("dice", F.lit(workers))
    weights = (
        rows.select(worker.alias("worker"), "dice", "toxic", "text")
        .groupBy("worker")
        .applyInArrow(_train, WEIGHTS)
        .groupBy("place")
        .agg((F.sum("weight") / workers).alias("weight"))
        .orderBy("place")
        .collect()
    )
    places = np.array([r["place"] for r in weights], np.int64)
    values = np.array([r["weight"] for r in weights], np.float32)
    return docs.sparkSession.sparkContext.broadcast((places, values))


def score(model: Broadcast, text: Column) -> Column:
    """Chance that a text is toxic, from 0 to 1."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places, values = model.value
        weights = np.zeros(2**BITS + 1, np.float32)
        weights[places] = values
        hashes = WordHashes(_bare)
        for texts in batches:
            out = np.full(len(texts), float(weights[2**BITS]))
            for k, content in enumerate(texts):
                found = _places(hashes.of(content.lower().split()))
                found = np.unique(found[weights[found] != 0])
                out[k] += weights[found].sum(dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -700, 700))))

    return run(text_bytes(text))


def score_documents(
    docs: DataFrame, model: Broadcast, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: the id, ``held_out``, ``score`` and ``predicted``."""
    doc = F.col(f"`{id_col}`")
    scored = docs.select(doc.alias(id_col), score(model, F.col(f"`{text_col}`")).alias("score"))
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select(id_col, held_out(doc).alias("held_out"), "score", predicted.alias("predicted"))

"""Words and hashes that several operators on texts share.

A word is a run of bytes other than ``\\x20`` and ``\\x09-\\x0D``; ``bytes.split``
cuts at exactly these, and ``bytes.lower`` changes A-Z alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words remembered with their hash in one Python worker.
CACHED_WORDS = 200_000
#: Rows of a batch that are worked on together.
SLICE_ROWS = 500


def text_bytes(column: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class WordHashes(dict):
    """64-bit hash of each word, remembered for the words met lately."""

    def __init__(self, clean: Callable[[bytes], bytes] = bytes) -> None:
        super().__init__()
        self._clean = clean

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(self._clean(word))
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values evenly (the finisher of splitmix64)."""
    x = values + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` word hashes; of the whole if there are fewer."""
    if not len(words):
        return words
    length = min(length, len(words))
    runs = len(words) - length + 1
    found = np.full(runs, length, np.uint64)
    for k in range(length):
        found = mix(found * np.uint64(0x9E3779B97F4A7C15) + words[k : k + runs], k)
    return found

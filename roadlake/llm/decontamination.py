"""Benchmark decontamination by greedy string tiling.

Texts are cut into lower-cased words of letters, digits and underscores. Seeds are the
runs of ``min_words`` words that a text and a benchmark item share, found by comparing
running Karp-Rabin hashes of the text's words with those of the items. Seeds on one
diagonal are parts of one match, which is listed once, where it begins; the longest match
is marked first, then the longest among what is left unmarked on both sides, until none
of ``min_words`` is left. Tiles
may lie in any order, so a passage whose parts were moved about is found all the same.
An item is in a text if its tiles cover at least ``percent`` of the item's words.

Every task compares its texts with the benchmark, a stated set that is read in portions
of at most ``SEEDS`` seeds, one pass over the texts each; so what is broadcast is bounded
and nothing is shuffled.

Nulls and ties: null or empty texts and items share nothing. Items with fewer words than
``min_words`` must occur whole. Items without an id are left out; repeated items count
once each. Repeated rows give repeated results; an empty table on either side gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.llm.text import mix

WORD = re.compile(r"\w+")
MIN_WORDS = 5
PERCENT = 80
SEEDS = 1_000_000
BASE = 0x9E3779B97F4A7C15 | 1

FOUND = "item_id long, words long, covered long, tiles int"


def _running_product(factor: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, factor, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def running_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words, each got from the last by one step.

    The hash of words w is the sum of w[i] * BASE^i, modulo 2^64; a run's sum is the
    difference of two running sums, brought to one place by the inverse of its power.
    """
    if len(words) < length:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _running_product(BASE, len(words) - 1))])
    inverse = _running_product(pow(BASE, -1, 2**64), len(words) - length)
    return (sums[length:] - sums[:-length]) * inverse


def _powers(n: int) -> np.ndarray:
    """The inverse of BASE to the powers up to ``n``."""
    return _running_product(pow(BASE, -1, 2**64), n)


def _sums(words: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _running_product(BASE, len(words) - 1))])


def _pairs(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One hash of a run and the word before it."""
    return mix(hashes ^ mix(before, 1), 2)


@dataclass
class Seeds:
    """The runs of one length of all items, in order of their hash and the word before."""

    length: int
    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray
    #: Hashes of run and word before, in order, with where theirs begin and end.
    pairs: np.ndarray
    begin: np.ndarray
    end: np.ndarray


#: Stand for the word before an item and before a text.
BEFORE_ITEM, BEFORE_TEXT = np.uint64(1), np.uint64(2)


@dataclass
class Benchmark:
    """A portion of the items as word hashes."""

    ids: list[int] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    names: dict[str, int] = field(default_factory=dict)
    size: int = 0

    def add(self, item_id: int, text: str | None) -> None:
        words = WORD.findall((text or "").lower())
        if words:
            for word in words:
                self.names.setdefault(word, xxhash.xxh3_64_intdigest(word.encode()))
            self.ids.append(item_id)
            self.words.append(np.array([self.names[w] for w in words], np.uint64))
            self.size += len(words)

    def seeds(self, min_words: int) -> list[Seeds]:
        by_length: dict[int, list] = {}
        for item, words in enumerate(self.words):
            length = min(min_words, len(words))
            hashes = running_hashes(words, length)
            before = np.concatenate([[BEFORE_ITEM], words])[: len(hashes)]
            places = np.arange(len(hashes))
            by_length.setdefault(length, []).append((hashes, before, np.full(len(hashes), item), places))
        out = []
        for length, rows in by_length.items():
            hashes, before, items, places = (np.concatenate(c) for c in zip(*rows, strict=True))
            order = np.lexsort((before, hashes))
            hashes, before, items, places = (c[order] for c in (hashes, before, items, places))
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (before[1:] != before[:-1])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(hashes))
            pairs = _pairs(hashes[begin], before[begin])
            by_pair = np.argsort(pairs)
            out.append(Seeds(length, hashes, items, places, pairs[by_pair], begin[by_pair], end[by_pair]))
        return out


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is of."""
    counts = high - low
    of = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + low[of], of


def tile(matches: list[tuple[int, int, int]], words: int, spots: int, least: int) -> tuple[int, int]:
    """Words of the item covered, and number of tiles.

    ``matches`` are (length, place in the item, spot in the text), each as long as it can be;
    item and text have ``words`` and ``spots`` words.
    """
    by_length: dict[int, list[tuple[int, int]]] = {}
    for length, place, spot in matches:
        by_length.setdefault(length, []).append((place, spot))
    in_item, in_text, covered, tiles = np.zeros(words, bool), np.zeros(spots, bool), 0, 0
    while by_length and words - covered >= least:
        length = max(by_length)
        for place, spot in sorted(by_length.pop(length)):
            marked = in_item[place : place + length] | in_text[spot : spot + length]
            if not marked.any():
                in_item[place : place + length] = in_text[spot : spot + length] = True
                covered, tiles = covered + length, tiles + 1
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[True], marked, [True]]).astype(np.int8)))
            for start, end in zip(edges[::2], edges[1::2], strict=True):
                if end - start >= least:
                    by_length.setdefault(int(end - start), []).append((place + int(start), spot + int(start)))
    return covered, tiles


class Finder:
    """Finds items in texts.

    A match is listed once, where it begins: where the words before a shared run differ. Its
    length is found by halving, comparing hashes of ever longer runs. So what is held of a
    text follows its matches, not the pairs of places that share a run.
    """

    def __init__(self, benchmark: Benchmark, min_words: int, percent: int) -> None:
        self.benchmark, self.percent = benchmark, percent
        self.seeds = benchmark.seeds(min_words)
        self.sizes = np.array([len(w) for w in benchmark.words])
        sums = [_sums(w) for w in benchmark.words]
        self.sums = np.concatenate(sums) if sums else np.zeros(0, np.uint64)
        self.starts = np.cumsum([0, *map(len, sums)])[:-1]
        self.longest = int(self.sizes.max(initial=0))

    def _lengths(self, sums, powers, items, places, spots, least: int) -> np.ndarray:
        """How long the matches are, of which ``least`` words are known to agree."""
        low = np.full(len(items), least)
        high = np.minimum(self.sizes[items] - places, len(sums) - 1 - spots)
        base = self.starts[items] + places
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            own = (self.sums[base + middle] - self.sums[base]) * powers[places]
            other = (sums[spots + middle] - sums[spots]) * powers[spots]
            same = own == other
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, its words, words covered, tiles) of the items in a text."""
        names = self.benchmark.names
        found = [names.get(w, 0) for w in WORD.findall(text.lower())]
        words = np.array(found, np.uint64)
        out, sums, powers = [], None, None
        for seeds in self.seeds:
            runs = running_hashes(words, seeds.length)
            first = np.minimum(np.searchsorted(seeds.hashes, runs), len(seeds.hashes) - 1)
            spots = np.flatnonzero(seeds.hashes[first] == runs)
            if not len(spots):
                continue
            if sums is None:
                sums, powers = _sums(words), _powers(max(len(words), self.longest))
            low, high = first[spots], np.searchsorted(seeds.hashes, runs[spots], side="right")
            before = np.concatenate([[BEFORE_TEXT], words])[spots]
            pairs = _pairs(runs[spots], before)
            at = np.minimum(np.searchsorted(seeds.pairs, pairs), len(seeds.pairs) - 1)
            goes_on = seeds.pairs[at] == pairs
            begin, end = np.where(goes_on, seeds.begin[at], high), np.where(goes_on, seeds.end[at], high)
            one, of_one = _ranges(low, begin)
            two, of_two = _ranges(end, high)
            which = np.concatenate([one, two])
            spots = spots[np.concatenate([of_one, of_two])]
            items, places = seeds.items[which], seeds.places[which]
            lengths = self._lengths(sums, powers, items, places, spots, seeds.length)
            order = np.argsort(items, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(items[order])) + 1):
                item = items[own[0]]
                size = int(self.sizes[item])
                matches = zip(*(c[own].tolist() for c in (lengths, places, spots)), strict=True)
                covered, tiles = tile(list(matches), size, len(words), seeds.length)
                if 100 * covered >= self.percent * size:
                    out.append((self.benchmark.ids[item], size, covered, tiles))
        return out


def portions(benchmark: DataFrame, id_col: str, text_col: str, seeds: int) -> Iterator[Benchmark]:
    """The benchmark in pieces of about ``seeds`` words; one is held at a time."""
    rows = benchmark.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    now = Benchmark()
    for row in rows.where("id is not null").orderBy("id", "text").toLocalIterator():
        now.add(row["id"], row["text"])
        if now.size >= seeds:
            yield now
            now = Benchmark()
    if now.size:
        yield now


def found_items(
    docs: DataFrame, benchmark: Benchmark, text: Column, min_words: int, percent: int
) -> Column:
    """The items of a portion that are in a text, as an array."""
    shared = docs.sparkSession.sparkContext.broadcast(benchmark)

    @F.pandas_udf(f"array<struct<{FOUND.replace(' ', ':').replace(',:', ',')}>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(shared.value, min_words, percent)
        keys = [c.split(" ")[0] for c in FOUND.split(", ")]
        for texts in batches:
            yield pd.Series(
                [[dict(zip(keys, x, strict=True)) for x in finder.find(t)] for t in texts], dtype=object
            )

    return run(F.coalesce(text.cast("string"), F.lit("")))


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """A row per text and item that is in it: the id, ``item_id``, ``words`` of the item,
    ``covered`` words and number of ``tiles``."""
    out = None
    for portion in portions(benchmark, item_col, item_text_col, SEEDS):
        items = found_items(docs, portion, F.col(f"`{text_col}`"), min_words, percent)
        hits = docs.select(F.col(f"`{id_col}`").alias("_id"), F.explode(items).alias("hit"))
        hits = hits.select(F.col("_id").alias(id_col), "hit.*")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        none = docs.select(F.col(f"`{id_col}`").alias("_id"), F.lit(None).cast(f"struct<{FOUND.replace(' ', ':').replace(',:', ',')}>").alias("hit"))
        out = none.where(F.lit(False)).select(F.col("_id").alias(id_col), "hit.*")
    return out


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """The rows without any item in their text, with all their columns."""
    for portion in portions(benchmark, item_col, item_text_col, SEEDS):
        items = found_items(docs, portion, F.col(f"`{text_col}`"), min_words, percent)
        docs = docs.where(F.size(items) == 0)
    return docs

"""Language-model scores: prediction by partial matching over bytes, and a word baseline.

The model has every byte context of up to ``ORDER`` bytes that the training texts have, so
it grows with them. Its counts are a table in shards by the last three bytes of the
context. Every task has the contexts of up to ``SHORT`` bytes, which are at most 256^2
with 256 symbols each however large the corpus is, and a trie of those met in more than
one ``HOT_CONTEXT_PARTS``-th of all places. Where the trie has the whole context of a place,
it has the answer; documents send blocks of the other places to copies of the shards, as many as
the places need, and get back sums by document. With ``CONTEXT_PARTS`` set, contexts met in no more than such a part of
all places are left out of the model; by default none is.

A symbol seen in a context has probability n / (T + D), with T its count and D its
distinct symbols; D / (T + D) is left to the next shorter context, where the symbols
already offered are excluded. Below the empty context all symbols left are alike. A text
is coded with its end as a last symbol, so the probabilities of all texts sum to one.
Byte 255 stands for the end and, in contexts, for what is before the start; UTF-8 has no
such byte.

The baseline needs the training count of every word. Words that make up more than one
``HOT_PARTS``-th of all tokens are fewer than ``HOT_PARTS`` and every task has them. For
the others, documents send blocks of word hashes to shards of the counts and get back
sums by document. Words count by 64-bit hash.

Nulls and ties: a null text is empty: one token, the end. A null id counts as the empty
text in the training split. Rows alike in id and text each get the same result. Without
training texts every symbol is alike and N is 0. An empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.llm.text import WordHashes, slices, text_bytes
from roadlake.session import pin

ORDER = 4
SHORT = 2
CONTEXT_PARTS: int | None = None
HOT_CONTEXT_PARTS = 8_192
HOT_PARTS = 65_536
SHARD_WORDS = 262_144
#: Grams of a shard, and places of the corpus for which a task has a copy of it. A document
#: gets a sum from each shard that it asks, so shards grow with the grams alone.
SHARD_GRAMS = 262_144
SHARD_PLACES = 32_000_000
#: Words of rare tokens, places of rare contexts, or bytes, that a task works on at once.
BLOCK_WORDS = 500_000
BLOCK_PLACES = 1_000_000
BLOCK_BYTES = 2_000_000
COUNTED_WORDS = 300_000
END = 255
#: Odd, near 2^32 over the golden ratio.
SPREAD = 0x9E3779B1

COUNTS = "hash long, n long"
GRAMS = "code long, n long"
MESSAGES = "shard long, kind int, a binary, b binary, c binary, d binary, e binary, f binary"
_MESSAGES = pa.schema(
    [("shard", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcdef")]
)
SUMS = "doc long, text_hash long, m long, logs double, known long, n_tokens long, score double"


def training(doc: Column, parts: int) -> Column:
    """Documents whose id, as text, has a CRC-32 that ``parts`` does not divide."""
    return F.pmod(F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) != 0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()

    def emit(found: Counter) -> pa.RecordBatch:
        keys = hashes.of(list(found)).view(np.int64)
        counts = np.fromiter(found.values(), np.int64, len(found))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["hash", "n"])

    found: Counter = Counter()
    for part in slices(batches):
        for text in part.column(0).to_pylist():
            found.update(text.lower().split())
            if len(found) >= COUNTED_WORDS:
                yield emit(found)
                found = Counter()
    yield emit(found)


def _streams(part: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of the texts of a batch: bytes, and the row that each byte from ORDER on codes.

    Before a text stand ORDER marks, after it one. A piece starts with the ORDER bytes
    before its first coded one; row -1 marks the bytes between texts.
    """
    mark = bytes([END])
    texts = part.column(column).to_pylist()
    joined = b"".join(mark * ORDER + t + mark for t in texts)
    stream = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes + ORDER)
    for start in range(ORDER, len(stream), BLOCK_BYTES):
        stop = min(start + BLOCK_BYTES, len(stream))
        at = np.arange(start, stop)
        row = np.searchsorted(ends, at, side="right")
        row[at - (ends - sizes)[row] < 0] = -1
        yield stream[start - ORDER : stop], row


def _codes(stream: np.ndarray) -> np.ndarray:
    """Each byte from ORDER on with the ORDER bytes before it, as one number."""
    wide = stream.astype(np.int64)
    code = np.zeros(len(wide) - ORDER, np.int64)
    for back in range(ORDER, -1, -1):
        code <<= 8
        code |= wide[ORDER - back : len(wide) - back]
    return code


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, places = np.unique(np.concatenate(codes), return_inverse=True)
        return values, np.bincount(places, np.concatenate(counts)).astype(np.int64)

    codes, counts = [], []
    for part in slices(batches, 200):
        for stream, row in _streams(part, 0):
            found = np.unique(_codes(stream)[row >= 0], return_counts=True)
            codes.append(found[0])
            counts.append(found[1])
            if len(codes) > 16:
                both = merged(codes, counts)
                codes, counts = [both[0]], [both[1]]
            if sum(map(len, codes)) > 3_000_000:
                values, n = merged(codes, counts)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["code", "n"])
                codes, counts = [], []
    if codes:
        values, n = merged(codes, counts)
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["code", "n"])


def gram_counts(texts: DataFrame) -> DataFrame:
    grams = texts.select("text").mapInArrow(_count_grams, GRAMS)
    return pin(grams.groupBy("code").agg(F.sum("n").alias("n")), "grams")


def frequent_contexts(grams: DataFrame, least: float) -> list[tuple]:
    """(length, context, symbols with counts) of the contexts met in more than ``least`` places."""
    contexts = F.array(
        *(
            F.struct(F.lit(k).alias("k"), F.shiftright("code", 8).bitwiseAND(2 ** (8 * k) - 1).alias("context"))
            for k in range(ORDER + 1)
        )
    )
    found = (
        grams.select(F.explode(contexts).alias("c"), F.col("code").bitwiseAND(255).alias("symbol"), "n")
        .groupBy("c.k", "c.context", "symbol")
        .agg(F.sum("n").alias("n"))
        .groupBy("k", "context")
        .agg(F.sum("n").alias("places"), F.collect_list(F.struct("symbol", "n")).alias("symbols"))
        .where((F.col("places") > least) | (F.col("k") == 0))
    )
    return [(r["k"], r["context"], r["symbols"]) for r in found.orderBy("k", "context").collect()]


class Trie:
    """Contexts as states: ``child`` by the next byte back, and log10 of each symbol."""

    def __init__(self, contexts: list[tuple]) -> None:
        if not contexts:
            contexts = [(0, 0, [])]
        self.dead = len(contexts)
        self.child = np.full((self.dead + 1, 256), self.dead, np.uint16)
        number = {(k, context): state for state, (k, context, _) in enumerate(contexts)}
        counts = np.zeros((self.dead, 256))
        lower = np.zeros((self.dead, 256))
        chance = np.zeros((self.dead, 256))
        for state, (k, context, symbols) in enumerate(contexts):
            for symbol, n in symbols:
                counts[state, symbol] = n
            own = counts[state]
            new = own == 0
            if k == 0:
                lower[state, new] = 1 / max(1, new.sum())
            else:
                up = number[k - 1, context & (2 ** (8 * (k - 1)) - 1)]
                self.child[up, context >> (8 * (k - 1))] = state
                left = np.where(new, counts[up], 0)
                total, kinds = left.sum(), (left > 0).sum()
                escape = kinds / (total + kinds) if kinds else 1.0
                unseen = np.where(counts[up] == 0, lower[up] * escape, 0)
                lower[state] = np.where(left > 0, left / max(1, total + kinds), unseen)
            total, kinds = own.sum(), (own > 0).sum()
            if kinds == 256:
                chance[state] = own / total
            else:
                escape = kinds / (total + kinds) if kinds else 1.0
                chance[state] = np.where(new, lower[state] * escape, own / max(1, total + kinds))
        self.log10 = np.log10(chance).astype(np.float32)

    def score(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each byte from ORDER on, where the trie has the whole context; and where."""
        state = np.zeros(len(stream) - ORDER, np.uint16)
        for back in range(1, ORDER + 1):
            state = self.child[state, stream[ORDER - back : len(stream) - back]]
        whole = state != self.dead
        return self.log10[np.where(whole, state, 0), stream[ORDER:]], whole


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Value of each wanted key (keys sorted), 0 where it has none."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class Level:
    """Contexts of ``k`` bytes: their grams with counts, sorted; places and kinds of each,
    and the places in which the next shorter context has one of its symbols."""

    def __init__(self, k: int, codes: np.ndarray, n: np.ndarray, least: float, shorter: Level | None) -> None:
        grams, at = np.unique(codes & (2 ** (8 * k + 8) - 1), return_inverse=True)
        counts = np.bincount(at, n, len(grams)).astype(np.int64)
        _, of = np.unique(grams >> 8, return_inverse=True)
        kept = np.bincount(of, counts)[of] > (least if k else 0)
        self.grams, self.counts = grams[kept], counts[kept]
        self.contexts, of = np.unique(self.grams >> 8, return_inverse=True)
        size = len(self.contexts)
        self.places = np.bincount(of, self.counts, size).astype(np.int64)
        self.kinds = np.bincount(of, minlength=size)
        self.below = np.zeros(size, np.int64)
        if shorter:
            same = _look_up(shorter.grams, shorter.counts, self.grams & (2 ** (8 * k) - 1))
            self.below = np.bincount(of, same, size).astype(np.int64)


def grow(levels: list[Level], codes: np.ndarray, n: np.ndarray, upto: int, least: float) -> list[Level]:
    """``levels`` and the longer ones up to ``upto``, of the places in ``codes``."""
    out = list(levels)
    for k in range(len(levels), upto + 1):
        out.append(Level(k, codes, n, least, out[-1] if out else None))
    return out


def log10_of(levels: list[Level], codes: np.ndarray) -> np.ndarray:
    """log10 of the last byte of each code, given those before it."""
    logs, left = np.zeros(len(codes)), np.ones(len(codes), bool)
    offered = below = np.zeros(len(codes), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level, grams = levels[k], codes & (2 ** (8 * k + 8) - 1)
        places, all_kinds, next_below = (
            _look_up(level.contexts, x, grams >> 8) for x in (level.places, level.kinds, level.below)
        )
        counts = _look_up(level.grams, level.counts, grams)
        kinds = all_kinds - offered
        whole = places - below + np.where(all_kinds < 256, kinds, 0)
        here = left & (kinds > 0)
        logs[here] += np.log10(np.where(counts > 0, counts, kinds)[here] / whole[here])
        left &= counts == 0
        offered, below = all_kinds, next_below
    logs[left] -= np.log10(256 - offered[left])
    return logs


def _word_shard(shards: int):
    return lambda words: (words % np.uint64(shards)).astype(np.int64)


def _gram_shard(shards: int):
    """By the last three bytes of the context, so a shard has all of its two longest levels."""
    return lambda codes: ((((codes >> 8) & 0xFFFFFF) * SPREAD & 0xFFFFFFFF) >> 8) % shards


def _ask(model, shards: int, gram_shards: int, copies: int):
    """Per document what hot contexts and hot words say; blocks of rare ones by shard."""
    word_shard, most = _word_shard(shards), max(shards, gram_shards * copies)

    def places_block(held: list[tuple], number: int) -> pa.RecordBatch:
        copy = (int(held[0][1][0]) + number) % copies
        return _block(held, 3, lambda codes: _gram_shard(gram_shards)(codes) * copies + copy)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, _, hot, hot_counts, ends, _ = model.value
        hashes = WordHashes()
        hot_logs = np.log10(hot_counts + 0.1)
        held: list[tuple] = []
        held_places: list[tuple] = []
        size = n_places = sent = 0
        for part in slices(batches, 200):
            texts = part.column(2).to_pylist()
            docs, text_hashes = part.column(0).to_numpy(), part.column(1).to_numpy()
            words = [t.lower().split() for t in texts]
            tokens = np.array([len(w) + 1 for w in words])
            row = np.repeat(np.arange(len(texts)), tokens - 1)
            found = hashes.of([x for w in words for x in w])
            logs = np.full(len(texts), np.log10(ends + 0.1))
            known = np.full(len(texts), int(ends > 0))
            log = _look_up(hot, hot_logs, found)
            is_hot = _look_up(hot, np.ones(len(hot), bool), found).astype(bool)
            logs += np.bincount(row, log, len(texts))
            known += np.bincount(row[is_hot], minlength=len(texts))
            score = np.zeros(len(texts))
            for stream, of in _streams(part, 2):
                log, whole = trie.score(stream)
                keep, rare = whole & (of >= 0), ~whole & (of >= 0)
                score += np.bincount(of[keep], log[keep], len(texts))
                held_places.append((docs, text_hashes, of[rare], _codes(stream)[rare]))
                n_places += len(held_places[-1][2])
                if n_places >= BLOCK_PLACES:
                    yield places_block(held_places, sent)
                    held_places, n_places, sent = [], 0, sent + 1
            arrays = [docs, text_hashes, logs, known, tokens, score]
            shard = int(docs[0] % most) if len(docs) else 0
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "kind": 4, **dict(zip("abcdef", (x.tobytes() for x in arrays), strict=True))}],
                _MESSAGES,
            )
            held.append((docs, text_hashes, row[~is_hot], found[~is_hot]))
            size += len(held[-1][2])
            if size >= BLOCK_WORDS:
                yield _block(held, 2, word_shard)
                held, size = [], 0
        if held:
            yield _block(held, 2, word_shard)
        if held_places:
            yield places_block(held_places, sent)

    return ask


def _place_type(docs: int) -> type:
    return np.uint16 if docs <= 2**16 else np.uint32


def _block(held: list[tuple], kind: int, shard_of) -> pa.RecordBatch:
    """One message per shard: documents, distinct words or grams, and who has each how often."""
    starts = np.cumsum([0] + [len(h[0]) for h in held])
    docs, text_hashes = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    row = np.concatenate([h[2] + s for h, s in zip(held, starts, strict=False)])
    words = np.concatenate([h[3] for h in held])
    shard = shard_of(words)
    order = np.lexsort((words, shard))
    row, words, shard = row[order], words[order], shard[order]
    out = []
    for at in np.split(np.arange(len(words)), np.flatnonzero(np.diff(shard)) + 1):
        if len(at):
            distinct, counts = np.unique(words[at], return_counts=True)
            used = np.flatnonzero(np.bincount(row[at], minlength=len(docs)))
            places = np.searchsorted(used, row[at]).astype(_place_type(len(used)))
            arrays = (docs[used], text_hashes[used], distinct, counts.astype(np.uint32), places)
            message = dict(zip("abcde", (x.tobytes() for x in arrays), strict=True))
            out.append({"shard": int(shard[at[0]]), "kind": kind, **message, "f": b""})
    return pa.RecordBatch.from_pylist(out, _MESSAGES)


def _pack_counts(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    hashes = table.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    counts = table.column("n").to_numpy()[order]
    message = {"a": hashes[order].tobytes(), "b": counts.tobytes()}
    row = {"shard": key[0].as_py(), "kind": 0, **dict.fromkeys("cdef", b""), **message}
    return pa.Table.from_pylist([row], _MESSAGES)


def _pack_grams(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    message = {"a": table.column("code").to_numpy().tobytes(), "b": table.column("n").to_numpy().tobytes()}
    row = {"shard": key[0].as_py(), "kind": 1, **dict.fromkeys("cdef", b""), **message}
    return pa.Table.from_pylist([row], _MESSAGES)


def _answer(model):
    """Rows come by shard, its counts first; sums by document go out."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _answers(batches, *model.value)

    return answer


def _answers(batches: Iterator[pa.RecordBatch], _, short, *rest) -> Iterator[pa.RecordBatch]:
    now, hashes, counts = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least, nothing = rest[-1], np.zeros(0, np.int64)
    none_met = levels = grow(short, nothing, nothing, ORDER, least)
    levels_of = None
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(i)[k].as_py() for i, c in enumerate(["shard", "kind", *"abcdef"])}
            if row["kind"] == 0:
                now = row["shard"]
                hashes, counts = np.frombuffer(row["a"], np.uint64), np.frombuffer(row["b"], np.int64)
                continue
            if row["kind"] == 1:
                levels_of = row["shard"]
                codes, n_codes = (np.frombuffer(row[c], np.int64) for c in "ab")
                levels = grow(short, codes, n_codes, ORDER, least)
                continue
            docs, text_hashes = np.frombuffer(row["a"], np.int64), np.frombuffer(row["b"], np.int64)
            n, none = len(docs), np.zeros(len(docs), np.int64)
            if row["kind"] == 4:
                logs, known, tokens, score = (
                    np.frombuffer(row[c], t) for c, t in zip("cdef", (float, int, int, float), strict=True)
                )
                own = none + 1
            elif row["kind"] == 3:
                codes = np.frombuffer(row["c"], np.int64)
                found = log10_of(levels if levels_of == row["shard"] else none_met, codes)
                found = np.repeat(found, np.frombuffer(row["d"], np.uint32))
                score = np.bincount(np.frombuffer(row["e"], _place_type(n)), found, n)
                own = known = tokens = none
                logs = np.zeros(n)
            else:
                words = np.frombuffer(row["c"], np.uint64)
                found = _look_up(hashes, counts, words) if now == row["shard"] else np.zeros(len(words), np.int64)
                found = np.repeat(found, np.frombuffer(row["d"], np.uint32))
                places = np.frombuffer(row["e"], _place_type(n))
                logs = np.bincount(places, np.log10(found + 0.1), n)
                known, tokens = np.bincount(places, found > 0, n).astype(np.int64), none
                own, score = none, np.zeros(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (docs, text_hashes, own, logs, known, tokens, score)],
                names=["doc", "text_hash", "m", "logs", "known", "n_tokens", "score"],
            )


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 10
) -> DataFrame:
    """Per row: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``; the training texts are those ``training`` names."""
    spark = docs.sparkSession
    doc, text = F.col(f"`{id_col}`").cast("long"), text_bytes(F.col(f"`{text_col}`"))
    train = docs.where(training(doc, parts)).select(text.alias("text"))
    ends = train.count()
    counts = train.mapInArrow(_count_words, COUNTS).groupBy("hash").agg(F.sum("n").alias("n"))
    counts = pin(counts, "word-counts")
    words, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, distinct = (words or 0) + ends, kinds + (ends > 0)
    is_hot = F.col("n") > tokens / HOT_PARTS
    hot = np.array([tuple(r) for r in counts.where(is_hot).collect()], np.int64).reshape(-1, 2)
    hot = hot[np.argsort(hot[:, 0].copy().view(np.uint64))]
    grams = gram_counts(train)
    places, gram_kinds = grams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = places / CONTEXT_PARTS if CONTEXT_PARTS else 0
    trie = Trie(frequent_contexts(grams, max(least, places / HOT_CONTEXT_PARTS)))
    short_code = F.col("code").bitwiseAND(2 ** (8 * SHORT + 8) - 1).alias("code")
    short = grams.groupBy(short_code).agg(F.sum("n").alias("n")).toArrow()
    short = grow([], short.column("code").to_numpy(), short.column("n").to_numpy(), SHORT, least)
    parts_of = (trie, short, hot[:, 0].copy().view(np.uint64), hot[:, 1].copy(), ends, least)
    model = spark.sparkContext.broadcast(parts_of)
    shards = max(1, -(-kinds // SHARD_WORDS))
    shard = F.pmod(F.col("hash"), F.lit(shards))
    # As unsigned numbers, hashes below zero are 2^64 more.
    shift = 2**64 % shards
    shard = F.pmod(shard + F.when(F.col("hash") < 0, shift).otherwise(0), F.lit(shards))
    packed = (
        counts.where(~is_hot).withColumn("shard", shard).groupBy("shard").applyInArrow(_pack_counts, MESSAGES)
    )
    gram_shards = max(1, -(-gram_kinds // SHARD_GRAMS))
    copies = max(1, -(-places // (SHARD_PLACES * gram_shards)))
    spread = (F.shiftright("code", 8).bitwiseAND(0xFFFFFF) * F.lit(SPREAD)).bitwiseAND(0xFFFFFFFF)
    packed_grams = (
        grams.withColumn("shard", F.pmod(F.shiftright(spread, 8), F.lit(gram_shards)))
        .groupBy("shard")
        .applyInArrow(_pack_grams, MESSAGES)
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .withColumn("shard", F.col("shard") * copies + F.col("copy"))
        .drop("copy")
    )
    rows = docs.select(
        F.coalesce(doc, F.lit(2**63 - 1)).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text")
    )
    sums = (
        packed.unionByName(packed_grams)
        .unionByName(rows.mapInArrow(_ask(model, shards, gram_shards, copies), MESSAGES))
        .repartition("shard")
        .sortWithinPartitions("shard", "kind")
        .mapInArrow(_answer(model), SUMS)
        .groupBy("doc", "text_hash")
        .agg(
            F.sum("m").alias("m"),
            F.sum("logs").alias("logs"),
            F.sum("known").alias("known"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum("score").alias("score"),
        )
    )
    whole = F.col("n_tokens") * F.log10(F.lit(tokens + 0.1 * (distinct + 1)))
    id_of = F.nullif("doc", F.lit(2**63 - 1))
    return sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m")))).select(
        id_of.alias(id_col),
        (~training(id_of, parts)).alias("held_out"),
        "n_tokens",
        (F.col("known") / F.col("m")).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") / F.col("m") - whole).alias("base_score"),
        (F.col("score") / F.col("m")).alias("score"),
    )

"""Operators on documents against brute force, on odd rows, empty tables and held-out rows."""

from __future__ import annotations

import hashlib
import math
import random
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roadlake.llm import (
    decontamination,
    line_dedup,
    mixing,
    near_dedup,
    perfect_hash,
    ppm,
    sharding,
    toxicity,
)
from tests.llm.fixtures import documents, edited, texts, words

LAST = 2**63 - 1


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


def crc(doc) -> int:
    return zlib.crc32(("" if doc is None else str(doc)).encode())


def kept_lines(rows, least=10):
    blanks = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(blanks).translate(lower)
            if len(key) >= least:
                holders[key].add(LAST if doc is None else doc)
    out = Counter()
    for doc, text in rows:
        lines = (text or "").split("\n")
        keys = [x.strip(blanks).translate(lower) for x in lines]
        own = LAST if doc is None else doc
        kept = [x for x, k in zip(lines, keys) if len(holders[k]) < 2 or own == min(holders[k])]
        out[doc, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("hot_parts, probes", [(4_096, 4_000_000), (3, 4_000_000), (4_096, 20)])
def test_line_dedup(spark, monkeypatch, hot_parts, probes):
    monkeypatch.setattr(line_dedup, "HOT_PARTS", hot_parts)
    monkeypatch.setattr(line_dedup, "SHARD_PROBES", probes)
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 20)
    assert as_rows(line_dedup.drop_repeated_lines(documents(spark))) == kept_lines(texts())
    assert line_dedup.drop_repeated_lines(documents(spark, [])).collect() == []


def test_perfect_hash_has_each_slot_once():
    keys = np.random.default_rng(1).integers(0, 2**64, (2, 5_000), np.uint64)
    slots = perfect_hash.Slots(*perfect_hash.build(*keys))
    assert sorted(slots.find(*keys)) == list(range(5_000))


def shingles(text, k):
    found = (text or "").encode().lower().split()
    if len(found) < k:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)}


def linked(rows, k, percent):
    sets = [(LAST if d is None else d, shingles(t, k)) for d, t in rows]
    least = [d for d, _ in sets]
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(sets):
            for j, (_, b) in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b) and least[i] < least[j]:
                    least[j], changed = least[i], True
    out = Counter()
    for (d, s), c in zip(sets, least):
        own, component = (None if x == LAST else x for x in (d, c))
        out[own, len(s), component, d == c] += 1
    return out


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 1_000), (5, 80, 7), (3, 60, 5)])
def test_near_duplicates(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    how = near_dedup.NearDuplicates(k, percent, bands=40, rows=3)
    found = near_dedup.near_duplicates(documents(spark), how)
    assert as_rows(found) == linked(texts(), k, percent)
    assert near_dedup.near_duplicates(documents(spark, []), how).collect() == []


def test_near_duplicates_tells_texts_of_one_id_apart(spark):
    rng = random.Random(12)
    near, own, again = (words(rng, 60, 10**6) for _ in range(3))
    rows = [(7, " ".join(near)), (None, " ".join([*near, "more"])), (None, " ".join(own))]
    rows += [(None, " ".join(own)), (9, " ".join([*near, "end"])), (9, " ".join(again))]
    how = near_dedup.NearDuplicates(3, 85, bands=40, rows=3)
    found = near_dedup.near_duplicates(documents(spark, rows), how)
    assert as_rows(found) == linked(rows, 3, 85)
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "")
    wanted = {rows[0], rows[2], rows[5]}
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(wanted)
    assert kept.columns == documents(spark, rows).columns


def test_stages_keep_one_of_equal_rows_and_every_column(spark):
    rng = random.Random(13)
    text, other = (" ".join(words(rng, 60, 10**6)) for _ in range(2))
    rows = [(None, text)] * 3 + [(5, other)] * 2 + [(6, "")] * 2 + [(None, None)] * 2
    names = ["_row", "_kept", "_copy", "row", "copies", "record", "doc", "h1", "node"]
    docs = spark.createDataFrame(
        [(i, t, "a", *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(rows)],
        "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names),
    )
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(set(rows))
    for r in kept.collect():
        assert len({r[n][len(n):] for n in names}) == 1
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns
    taken = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert taken == 60 * 5
    for r in mixed.collect():
        assert len({r[n][len(n):] for n in names}) == 1
    placed = corpus_pipeline.shard(spark, docs, "")
    assert set(docs.columns) < set(placed.columns) and placed.count() == len(rows)


def test_registered_near_duplicates_on_given_documents(spark, given):
    """The setting of the query against brute force over pairs that share a shingle."""
    docs = spark.read.parquet(f"{given.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [shingles(text, 3) for _, text in rows]
    holders = defaultdict(list)
    for k, found in enumerate(sets):
        for shingle in found:
            holders[shingle].append(k)
    pairs = {(a, b) for ks in holders.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}
    least = list(range(len(rows)))
    for _ in rows:
        before = list(least)
        for a, b in pairs:
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    wanted = {rows[k][0]: rows[least[k]][0] for k in range(len(rows))}
    assert len(set(wanted.values())) < len(rows)
    how = near_dedup.NearDuplicates(3, 85)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, how).collect()}
    assert found == wanted


@pytest.mark.parametrize("block_shingles", [40, 10**6])
def test_large_clusters_are_compared_in_steps_of_size(spark, monkeypatch, block_shingles):
    """One chain of texts, each a little longer than the one before."""
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block_shingles)
    base = words(random.Random(14), 400, 10**6)
    rows = [(k, " ".join(base[: 40 + 6 * k])) for k in range(50)]
    how = near_dedup.NearDuplicates(3, 85, bands=40, rows=3)
    assert as_rows(near_dedup.near_duplicates(documents(spark, rows), how)) == linked(rows, 3, 85)


def test_posterior_needs_more_matches_for_a_higher_threshold():
    low, high = (near_dedup.NearDuplicates(percent=p).least_matches() for p in (60, 90))
    assert all(a[1] < b[1] for a, b in zip(low, high))


def baseline(rows):
    counts, n = Counter(), 0
    for doc, text in rows:
        if crc(doc) % 10:
            counts.update((text or "").encode().lower().split())
            n += 1
    total, kinds = sum(counts.values()) + n, len(counts) + (n > 0)
    out = []
    for doc, text in rows:
        found = (text or "").encode().lower().split()
        each = [counts.get(w, 0) for w in found] + [n]
        score = sum(math.log10((c + 0.1) / (total + 0.1 * (kinds + 1))) for c in each)
        known = sum(c > 0 for c in each)
        out.append((doc, crc(doc) % 10 == 0, len(each), known, total, pytest.approx(score)))
    return out


def id_first(row):
    return (row[0] is None, row[0] or 0, row[2])


@pytest.mark.parametrize("hot_parts", [65_536, 5])
def test_base_scores(spark, monkeypatch, hot_parts):
    monkeypatch.setattr(ppm, "HOT_PARTS", hot_parts)
    monkeypatch.setattr(ppm, "SHARD_WORDS", 50)
    monkeypatch.setattr(ppm, "BLOCK_WORDS", 100)
    found = [tuple(r) for r in ppm.score_documents(documents(spark)).collect()]
    wanted = sorted(baseline(texts()), key=id_first)
    assert sorted((r[:6] for r in found), key=id_first) == wanted
    assert all(r[6] < 0 for r in found)
    assert ppm.score_documents(documents(spark, [])).collect() == []


def plain_ppm(train, text, order, parts):
    """log10 of a text, symbol by symbol, by the definition."""
    mark = bytes([ppm.END])
    counts = defaultdict(Counter)
    for t in train:
        stream = mark * order + t + mark
        for i in range(order, len(stream)):
            for k in range(order + 1):
                counts[stream[i - k : i]][stream[i]] += 1
    places = sum(counts[b""].values())
    stream, total = mark * order + text + mark, 0.0
    for i in range(order, len(stream)):
        lengths = range(order, -1, -1)
        kept = [k for k in lengths if sum(counts[stream[i - k : i]].values()) > places / parts or not k]
        offered: set[int] = set()
        for k in kept:
            found = {s: n for s, n in counts[stream[i - k : i]].items() if s not in offered}
            if not found:
                continue
            whole = sum(found.values()) + (len(found) if len(offered) + len(found) < 256 else 0)
            if stream[i] in found:
                total += math.log10(found[stream[i]] / whole)
                break
            total += math.log10(len(found) / whole)
            offered |= set(found)
        else:
            total -= math.log10(256 - len(offered))
    return total


def test_scores_follow_the_definition(spark, monkeypatch):
    monkeypatch.setattr(ppm, "CONTEXT_PARTS", 60)
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 50)
    rows = [(k, t) for k, (_, t) in enumerate(texts()[10:40]) if len(t or "") < 2_000] + [(99, "")]
    train = [(t or "").encode() for d, t in rows if crc(d) % 10]
    for row in ppm.score_documents(documents(spark, rows)).collect():
        text = dict(rows)[row["doc_id"]].encode()
        wanted = plain_ppm(train, text, ppm.ORDER, 60)
        assert row["score"] == pytest.approx(wanted, rel=1e-5)


@pytest.mark.parametrize("hot_context_parts", [8_192, 60, 1])
def test_scores_use_every_context_of_the_training_texts(spark, monkeypatch, hot_context_parts):
    monkeypatch.setattr(ppm, "HOT_CONTEXT_PARTS", hot_context_parts)
    monkeypatch.setattr(ppm, "SHARD_GRAMS", 1_000)
    monkeypatch.setattr(ppm, "SHARD_PLACES", 1_500)
    monkeypatch.setattr(ppm, "BLOCK_PLACES", 300)
    rng = random.Random(11)
    rows = [(k, " ".join(words(rng, 200, 9_000))) for k in range(40)] + [(99, ""), (100, "Ünlike «all»")]
    rows += [(5, rows[5][1]), (101, "w1 w2 w3" * 3)]
    train = [t.encode() for d, t in rows if crc(d) % 10]
    found = ppm.score_documents(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    for row in found:
        wanted = plain_ppm(train, dict(rows)[row["doc_id"]].encode(), ppm.ORDER, math.inf)
        assert row["score"] == pytest.approx(wanted, rel=1e-5)


def test_scores_without_training_texts_make_every_symbol_alike(spark):
    rows = [(k, "some text") for k in range(60) if crc(k) % 10 == 0]
    for row in ppm.score_documents(documents(spark, rows)).collect():
        assert row["score"] == pytest.approx(-10 * math.log10(256))


def test_probabilities_of_each_context_sum_to_one():
    contexts = [(0, 0, [(97, 5), (98, 3), (255, 2)]), (1, 97, [(98, 3), (97, 2)]), (1, 98, [(255, 3)])]
    assert (10.0 ** ppm.Trie(contexts).log10.astype(float)).sum(axis=1) == pytest.approx(1)


def test_toxicity_learns_words(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        rows.append((k, " ".join(words(rng, 80) + ["nastyword,"] * bad + words(rng, 20))))
        labels.append((k, int(bad)))
    rows += [(1_000, None), (None, "w1 w2"), (3, "w1")]
    labels += [(None, 1), (2_000, None), (5, None)]
    docs = documents(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = toxicity.score_documents(docs, model).collect()
    assert len(found) == len(rows)
    bad = {k for k, y in labels if y and k is not None}
    for row in found:
        assert row["held_out"] == (crc(row["doc_id"]) % 5 == 0)
        if row["doc_id"] != 3:
            assert row["predicted"] == int(row["doc_id"] in bad) == int(row["score"] >= 0.5)
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score_documents(docs, nothing).collect()} == {0.5}
    assert toxicity.score_documents(documents(spark, []), model).collect() == []


def plain_ftrl(rows):
    """FTRL-proximal, feature by feature, as the method says."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return (sign * toxicity.L1 - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for features, label in rows:
            weights = {i: weight(i) for i in features}
            slope = 1 / (1 + math.exp(-sum(weights.values()))) - label
            for i in features:
                sigma = (math.sqrt(n[i] + slope**2) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += slope - sigma * weights[i]
                n[i] += slope**2
    return {i: weight(i) for i in list(z) if weight(i)}


def test_toxicity_follows_the_method(spark):
    """One text per id, however often the id comes; weights as plain FTRL learns them."""
    rng = random.Random(33)
    rows = [(k, " ".join(words(rng, 30, 60) + ["bad", "thing"] * (k % 3 == 0))) for k in range(120)]
    docs = documents(spark, rows + [rows[3]] * 50 + [(k, "zz other text") for k in range(0, 120, 9)])
    labels = [(k, int(k % 3 == 0)) for k in range(120)]
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = dict(zip(*(x.tolist() for x in model.value), strict=True))
    pick = docs.groupBy("doc_id").agg(F.min_by("text", F.xxhash64(F.col("text").cast("binary"))).alias("text"))
    pick = pick.withColumn("dice", F.xxhash64("doc_id", F.lit("train"))).orderBy("dice").collect()
    hashes = toxicity.WordHashes(toxicity._bare)
    learned = []
    for r in pick:
        if r["doc_id"] is not None and crc(r["doc_id"]) % 5:
            places = toxicity._places(hashes.of(r["text"].encode().lower().split()))
            learned.append(([*sorted(set(places.tolist())), 2**toxicity.BITS], int(r["doc_id"] % 3 == 0)))
    assert found == pytest.approx(plain_ftrl(learned), rel=1e-4)


def targets(sizes, weights=(1, 2, 3), most=3):
    """Reshare the excess again and again until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * level > most * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def plain_mix(spark, rows):
    """Rows (id, source, size) with how often the queues give them, one after the other."""
    sizes = Counter()
    for _, source, size in rows:
        sizes[source] += size
    wanted, budget = targets(sizes), sum(sizes.values())
    ids = spark.createDataFrame([(i,) for i in {r[0] for r in rows}], "id long")
    chance = dict(ids.select("id", F.xxhash64("id", F.lit("mix"))).collect())

    def id_order(i):
        return (i is not None, i or 0)

    def source_order(source):
        return (source is None, (source or "").encode())

    queue = []
    for source in sizes:
        own = [k for k, r in enumerate(rows) if r[1] == source and r[2]]
        own.sort(key=lambda k: (chance[rows[k][0]], id_order(rows[k][0]), rows[k][2], k))
        upto = 0
        for k in own:
            upto += rows[k][2]
            for copy in range(3):
                finish = (copy * sizes[source] + upto) / wanted[source]
                queue.append((finish, source_order(source), copy, id_order(rows[k][0]), rows[k][2], k))
    copies, total = Counter(), 0
    for *_, size, k in sorted(queue):
        total += size
        copies[k] += total <= budget
    return Counter((*r, copies[k]) for k, r in enumerate(rows))


def mix_rows(docs):
    return [(r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in docs.collect()]


def test_mixing(spark):
    docs = documents(spark)
    found = mixing.mix_sources(docs).collect()
    rows = mix_rows(docs)
    sizes = Counter()
    for _, source, n in rows:
        sizes[source] += n
    wanted = targets(sizes)
    assert Counter((r["id"], r["source"], r["size"], r["copies"]) for r in found) == plain_mix(spark, rows)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]])
        assert 0 <= r["copies"] <= 3
    assert sum(r["size"] * r["copies"] for r in found) <= sum(sizes.values())
    again = mixing.mix_sources(docs.repartition(5)).drop("row").collect()
    assert Counter(tuple(r)[1:] for r in found) == Counter(map(tuple, again))
    assert mixing.mix_sources(documents(spark, [])).collect() == []


def test_mixing_takes_near_the_targets(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(words(rng, rng.randrange(1, 30)))) for k in range(4_000)]
    # Rows alike, and rows without an id, fall apart at the cut as others do.
    for alike in (rows, [(7, "w " * 50)] * 3_000, [(None, "w " * 50)] * 3_000):
        docs = documents(spark, alike)
        found = mixing.mix_sources(docs).collect()
        taken = Counter()
        for r in found:
            taken[r["source"], r["target"]] += r["size"] * r["copies"]
        for (_, target), words_taken in taken.items():
            assert words_taken == pytest.approx(target, rel=0.01)
        assert Counter((r["id"], r["source"], r["size"], r["copies"]) for r in found) == plain_mix(
            spark, mix_rows(docs)
        )


@pytest.mark.parametrize("copies", [0, 900])
def test_sharding(spark, copies):
    rng = random.Random(6)
    rows = [(k, " ".join(words(rng, rng.randrange(1, 60)))) for k in range(3_000)]
    rows += [(10_000 + k, "the same text") for k in range(copies)]
    rows += [(20_000 + k, "w " * 400) for k in range(5)] + [(None, None), (1, ""), (1, "")]
    found = sharding.assign_shards(documents(spark, rows), 8).collect()
    assert len(found) == len(rows)
    load, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "bytes")
        assert (r["row"], r["n"], r["grown_shard"]) == ("z", "w", None)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[data].add(r["shard"])
    fair = sum(load.values()) / 8
    assert len(load) == 8 and max(load.values()) < 1.1 * fair and min(load.values()) > 0.9 * fair
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for t, g in groups.items() if t != b"the same text")
    slim = sharding.assign_shards(documents(spark, rows), 8, carry=False)
    assert Counter(r["shard"] for r in slim.collect()) == Counter(r["shard"] for r in found)


@pytest.mark.parametrize("one_id", ["", 7, None])
def test_sharding_splits_a_text_that_no_shard_can_hold(spark, one_id):
    rows = [(k if one_id == "" else one_id, "again and again") for k in range(2_000)]
    rows += [(5_000 + k, f"t{k}") for k in range(500)]
    load = Counter(r["shard"] for r in sharding.assign_shards(documents(spark, rows), 4).collect())
    assert len(load) == 4 and max(load.values()) < 800
    assert sharding.assign_shards(documents(spark, [])).collect() == []


def test_tiles_cover_moved_passages():
    rng = random.Random(7)
    item = [f"b{k}" for k in range(30)]
    cases = {
        "whole": words(rng, 40) + item + words(rng, 9),
        "halves": item[15:] + words(rng, 50) + item[:15],
        "twice": item * 2,
        "half": words(rng, 40) + item[:15],
        "pieces": [w for k in range(0, 30, 3) for w in [*item[k : k + 3], "x"]],
    }
    benchmark = decontamination.Benchmark()
    benchmark.add(4, " ".join(item).upper())
    finder = decontamination.Finder(benchmark, 5, 80)
    found = {name: finder.find(" ".join(case) + ".") for name, case in cases.items()}
    assert found == {
        "whole": [(4, 30, 30, 1)], "halves": [(4, 30, 30, 2)], "twice": [(4, 30, 30, 1)],
        "half": [], "pieces": [],
    }


def plain_tiles(item, text, least):
    """Greedy string tiling by comparing every pair of places."""
    a, b, covered, tiles = [False] * len(item), [False] * len(text), 0, 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while (
                    i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k]
                    and not a[i + k] and not b[j + k]
                ):
                    k += 1
                best = max(best, (k, -i, -j))
        if best[0] < least:
            return covered, tiles
        for k in range(best[0]):
            a[k - best[1]] = b[k - best[2]] = True
        covered, tiles = covered + best[0], tiles + 1


def test_tiles_equal_plain_tiling():
    rng = random.Random(8)
    for _ in range(60):
        item = words(rng, 25, 12)
        text = words(rng, 20, 12) + edited(rng, item, 2) + item[10:] + item[:10]
        benchmark = decontamination.Benchmark()
        benchmark.add(1, " ".join(item))
        found = decontamination.Finder(benchmark, 3, 0).find(" ".join(text))
        covered, tiles = plain_tiles(item, text, 3)
        assert [(f[2], f[3]) for f in found] == [(covered, tiles)]


def test_tiles_of_repeated_words_take_little_room():
    """Twenty million pairs of places share a run; the matches begin in a few thousand."""
    for text, item in (("a " * 20_000, "a " * 1_000), ("a b " * 10_000, "b a " * 500)):
        benchmark = decontamination.Benchmark()
        benchmark.add(1, item)
        finder = decontamination.Finder(benchmark, 5, 80)
        tracemalloc.start()
        start = time.monotonic()
        found = finder.find(text)
        seconds, (_, peak) = time.monotonic() - start, tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert found == [(1, 1_000, 1_000, 1)]
        assert seconds < 5 and peak < 100e6


def test_tiles_of_few_words_equal_plain_tiling():
    rng = random.Random(18)
    for _ in range(60):
        item, text = (words(rng, n, 2) for n in (30, 40))
        benchmark = decontamination.Benchmark()
        benchmark.add(1, " ".join(item))
        benchmark.add(2, " ".join(words(rng, 30, 2)))
        found = decontamination.Finder(benchmark, 3, 0).find(" ".join(text))
        assert [f[2:] for f in found if f[0] == 1] == [plain_tiles(item, text, 3)]


def test_contaminations(spark, monkeypatch):
    rng = random.Random(9)
    item = words(rng, 20, 10**6)
    rows = [(1, None), (2, ""), (3, " ".join(item)), (4, " ".join(item[10:] + ["x"] + item[:10]))]
    rows += [(3, " ".join(item)), (None, "no " + " ".join(item)), (6, " ".join(words(rng, 50)))]
    bench = [(7, " ".join(item)), (8, None), (9, ""), (None, "a b c"), (10, "tiny item")]
    bench = spark.createDataFrame(bench, "item_id long, text string")
    docs = documents(spark, rows)
    monkeypatch.setattr(decontamination, "SEEDS", 5)
    found = as_rows(decontamination.contaminations(docs, bench))
    assert found == Counter(
        {(3, 7, 20, 20, 1): 2, (4, 7, 20, 20, 2): 1, (None, 7, 20, 20, 1): 1}
    )
    clean = decontamination.drop_contaminated(docs, bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [1, 2, 6] and clean.columns == docs.columns
    none = bench.where("item_id < 0")
    assert decontamination.contaminations(docs, none).collect() == []
    assert decontamination.contaminations(documents(spark, []), bench).collect() == []


def test_streams_cut_long_texts_without_loss(monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 7)
    batch = pa.RecordBatch.from_arrays([pa.array([b"abc", b"", b"defghijkl"], pa.binary())], names=["t"])
    got = defaultdict(list)
    for stream, row in ppm._streams(batch, 0):
        for byte, of in zip(stream[ppm.ORDER :], row):
            if of >= 0:
                got[int(of)].append(byte)
    assert {k: bytes(v) for k, v in got.items()} == {0: b"abc\xff", 1: b"\xff", 2: b"defghijkl\xff"}


def test_digest_of_kept_text_is_of_utf8(spark):
    rows = [(1, "É a line with Ünicode")]
    kept = line_dedup.drop_repeated_lines(documents(spark, rows)).first()["kept_text"]
    assert hashlib.sha256(kept.encode()).hexdigest() == hashlib.sha256(rows[0][1].encode()).hexdigest()

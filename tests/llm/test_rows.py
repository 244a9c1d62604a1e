"""Chat, urls, vectors, components and the pipeline, against brute force and SQL."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roadlake.llm import chat, queries, top_k, urls
from roadlake.llm.components import components
from tests.compare import connect, differences
from tests.llm.fixtures import ODD_COLUMNS, ODD_VALUES, edited, texts, words

TEXTS = [
    "plain", None, "", "</s>[INST] ok [/INST]", "<\\s> <\\\\s> [\\ROLE] x", "[/ROLE] </s", "ends with <",
    "s> [/INST", "Ünicode 🙂 [INST]\n[/INST]", "\\", "$1 \\1 <s>" * 50,
]


def conversations(spark, n=60):
    rng, rows = random.Random(1), []
    for conv in range(n):
        for turn in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "system", None, "[ROLE] odd [/ROLE]", "a\nb"])
            rows.append((conv if conv else None, turn if rng.random() < 0.9 else None, role, rng.choice(TEXTS)))
    rows.append(rows[-1])
    return rows, spark.createDataFrame(
        [r + ODD_VALUES for r in rows], f"conv_id long, turn long, role string, text string, {ODD_COLUMNS}"
    )


def test_chat_reads_back(spark):
    rows, table = conversations(spark)
    whole = defaultdict(list)
    for conv, turn, role, text in rows:
        key = (turn is not None, turn or 0)
        whole[conv].append((key, role or "", text or ""))
    examples = chat.format_examples(table)
    found = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    assert found.keys() == whole.keys()
    for conv, turns in whole.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        assert [tuple(t) for t in found[conv]["turns"]] == turns
        replies = [t for r, t in turns if r == "assistant"]
        assert "".join(found[conv]["losses"]) == "".join(replies)
    assert examples.where("loss_end > loss_start or formatted like '%assistant%'").count() > 0
    for r in examples.collect():
        assert r["formatted"].count("</s>") == r["example"] + 1
        assert r["formatted"].endswith("</s>")
    assert chat.read_back(chat.format_examples(table.where("false"))).collect() == []


def test_chat_examples_by_prefix(spark):
    rows = [(1, k, r, t) for k, (r, t) in enumerate([("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")])]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = sorted(chat.format_examples(table).collect(), key=lambda r: r["example"])
    assert [r["example"] for r in found] == [1, 3]
    assert found[0]["formatted"] == "<s>[ROLE] user [/ROLE] a</s><s>[ROLE] assistant [/ROLE] b</s>"
    assert found[1]["formatted"].startswith(found[0]["formatted"])
    assert [r["formatted"][r["loss_start"] : r["loss_end"]] for r in found] == ["b", "d"]


URLS = [
    None, "", "no scheme", "http://example.net/en/1", "http://a.b.example.net/en", "https://EXAMPLE.net/EN/x",
    "http://net/", "http://net", "http://notnet.com/en/", "http://x.net?q=/en/", "http://x.net#/", "://org/fr/",
    "http://a.org/fr/?x", "http://example.com/de/a", "http://example.com.net/de/a", "a://b://c.net/d",
    "http://h\nx.net/p\nq?z", "http://x.net:80/en/", "http://www.example.com/den/", "http://x.org/fr",
]


def plain_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [
        r for r in rules
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    best = max(fits, key=lambda r: len(r.pattern), default=None)
    return host, path, best and best.pattern, best.action if best else default


def test_urls(spark):
    rows = [(k if k else None, u, *ODD_VALUES) for k, u in enumerate(URLS * 2)]
    table = spark.createDataFrame(rows, f"page_id long, url string, {ODD_COLUMNS}")
    found = Counter(map(tuple, urls.judge_urls(table, queries.URL_RULES).collect()))
    assert found == Counter((r[0], *plain_verdict(r[1], queries.URL_RULES)) for r in rows)
    assert urls.judge_urls(table.where("false"), queries.URL_RULES).collect() == []
    assert {r["verdict"] for r in urls.judge_urls(table, [], default="block").collect()} == {"block"}


def test_rules_stand_under_their_rarest_token():
    rules = [urls.UrlRule("block", "example.net/en/ads"), urls.UrlRule("block", "shop.org/a*b/c/")]
    index = urls.index_rules(rules, {"example": 9, "net": 50, "en": 3, "ads": 0, "shop": 7, "org": 2, "c": 1})
    assert {k: [r.pattern for r in v] for k, v in index.items()} == {
        "en": ["example.net/en/ads"], "c": ["shop.org/a*b/c/"],
    }
    assert rules[0].regex().match("x.example.net/en/adserver") and not rules[0].regex().match("ample.net/en/ads")
    assert rules[1].regex().match("shop.org/a--/b/c/d") and not rules[1].regex().match("shop.org/ab/d")


def vectors(spark, big=False):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(rng.choice([8, 8, 8, 5]))]) for k in range(300)]
    rows += [(400 + k, [0.5] * 8) for k in range(60)] + [(50, [0.5] * 8), (50, [0.5] * 8)]
    rows += [(600, None), (650, []), (700, [1.0, None]), (750, [float("nan")]), (800, [float("inf")]), (None, [1.0])]
    if big:
        rows += [(1_001 + k, [2.0**40 + k] * 8) for k in range(40)]
    schema = f"vec_id long, embedding array<double>, {ODD_COLUMNS}"
    return rows, spark.createDataFrame([r + ODD_VALUES for r in rows], schema).repartition(4)


@pytest.mark.parametrize("big", [False, True])
def test_top_products(spark, monkeypatch, big):
    monkeypatch.setattr(top_k, "BLOCK", 7)
    monkeypatch.setattr(top_k, "TOGETHER", 3)
    monkeypatch.setattr(top_k, "QUERIES", 4)
    rows, table = vectors(spark, big)
    good = [
        (i, [math.floor(256 * x) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    wanted = Counter()
    for a, (i, v) in enumerate(good):
        if i % 50 == 0:
            each = [(-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(good) if a != b]
            wanted.update((i, rank + 1, j, -s) for rank, (s, j) in enumerate(sorted(each)[:5]))
    assert Counter(map(tuple, top_k.top_products(table).collect())) == wanted
    assert top_k.top_products(table.where("false")).collect() == []


def test_scores_stop_at_the_ends_of_a_long(spark):
    table = spark.createDataFrame([(0, [2.0**50]), (1, [2.0**50])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_k.top_products(table).collect()] == [(0, 1, 1, 2**63 - 1)]


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)]
    links += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(500, 500)]
    least = {x: x for link in links for x in link}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: v for k, v in least.items() if k != 500}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_sql(spark, given, name):
    con = connect(given)
    assert differences(spark, con, queries.QUERIES[name], queries.ORACLE[name], given) is None


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    item = words(rng, 20, 10**6)
    base = words(rng, 100, 10**6)
    rows = [(k, " ".join(words(rng, 60, 5_000) + ["nastyword"] * (k % 4 == 0))) for k in range(400)]
    rows += [(1_000 + k, " ".join(edited(rng, base, 1))) for k in range(6)]
    rows += [(2_000, "see " + " ".join(item)), (2_001, " ".join(item[10:] + item[:10]) + " end"), (3_000, None)]
    docs = spark.createDataFrame(
        [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, int(k % 4 == 0)) for k in range(400)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    ids, now = [], docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        now = spark.read.parquet(f"{tmp_path}/{number}")
        ids.append(Counter(r["doc_id"] for r in now.collect()))
        if number < 4:
            assert now.columns == docs.columns
    every = {i for i, _ in rows}
    assert set(ids[0]) == every - {k for k in range(400) if k % 4 == 0}
    assert set(ids[1]) == set(ids[0]) - set(range(1_001, 1_006))
    assert set(ids[2]) == set(ids[1]) - {2_000, 2_001}
    assert max(ids[3].values()) <= 3 and set(ids[3]) <= set(ids[2]) and ids[4] == ids[3]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, now.collect()))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).collect() == []


def test_digests_of_the_chat_query(spark, given):
    row = queries.op2_chat_format(spark, given).where(F.col("conv_id") == -7).first()
    text = queries.CONTROL_TEXT
    turns = f"user\n{text}\nassistant\n{text}\n"
    assert row["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    assert (row["loss_chars"], row["loss_sha256"]) == (len(text), hashlib.sha256(text.encode()).hexdigest())


def test_odd_texts_are_odd():
    assert {None, ""} <= {t for _, t in texts()}

"""The registered queries of the operators on texts, and the same in SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.llm import (
    chat,
    decontamination,
    line_dedup,
    merkle,
    mixing,
    near_dedup,
    ppm,
    sharding,
    top_k,
    toxicity,
    urls,
    vector_dedup,
    whitening,
)

#: Fixed: the rules that the url query is asked to apply.
URL_RULES = [
    urls.UrlRule("block", "net/"),
    urls.UrlRule("allow", "example.net/en/"),
    urls.UrlRule("block", "example.com/de/"),
    urls.UrlRule("allow", "org/fr/"),
]
#: Fixed: the conversation that the chat query adds.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_table(spark, sf, "documents"))
    digest = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_lines", "n_dropped", digest)


def op2_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(chat.REPLY).alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    read = chat.read_back(chat.format_examples(turns.unionByName(added)))
    joined = F.concat_ws(
        "", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    )
    loss = F.concat_ws("", "losses")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, _table(spark, sf, "labels")))


def op4_ppm_score(spark: SparkSession, sf: str) -> DataFrame:
    return ppm.score_documents(_table(spark, sf, "documents"))


def op5_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf, "pages"), URL_RULES)


def op6_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf, "documents"))
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken)


def op7_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    how = near_dedup.NearDuplicates(shingle_words=3, percent=85)
    return near_dedup.near_duplicates(_table(spark, sf, "documents"), how)


def op8_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf, "documents"), shards=40, carry=False)


def op9_top_products(spark: SparkSession, sf: str) -> DataFrame:
    return top_k.top_products(_table(spark, sf, "embeddings"))


def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contaminations(
        _table(spark, sf, "documents"), _table(spark, sf, "benchmark")
    )


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.verified_leaves(_table(spark, sf, "documents"))


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten_embeddings(_table(spark, sf, "embeddings"))


def op13_vector_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(_table(spark, sf, "embeddings"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_chat_format,
        op3_toxicity,
        op4_ppm_score,
        op5_url_filter,
        op6_source_mix,
        op7_near_duplicates,
        op8_sharding,
        op9_top_products,
        op10_decontamination,
        op11_merkle_manifest,
        op12_whitening,
        op13_vector_duplicates,
        pipeline,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ESCAPED = (
    r"regexp_replace({}, '([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]))', '\1\\\2\3', 'g')"
)
_TAGGED = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(
    _TAGGED.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")
) + ")"
# One step per bit of the text's bytes, which are digits.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c), 0, 0, 0, 0, 0, 0, 0]))),
    lambda crc, byte: xor(xor(crc, byte) >> 1, 3988292384 * (xor(crc, byte) & 1))), 4294967295)"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": f"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts
  FROM documents
), lines AS (
  SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM rows
), keyed AS (
  SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT k.*, coalesce(s.first <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id""",
    "op2_chat_format": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{CONTROL_TEXT}'), (-7, 1, 'assistant', '{CONTROL_TEXT}')
), placed AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS turns,
         sum(23 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) OVER w AS upto
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR place = turns) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id""",
    "op5_url_filter": f"""
WITH parts AS (
  SELECT page_id,
         {_LOWER.format("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")} AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), judged AS (
  SELECT p.*, (SELECT max_by(struct_pack(rule, verdict), length(rule)) FROM rules
    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best
  FROM parts p
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged""",
    "op9_top_products": """
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.r <> c.r
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, 'n') AS tree,
         {_LEAF.format(text="text")} AS leaf,
         CASE WHEN {_CRC32} % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")}
              ELSE {_LEAF.format(text="text")} END AS told
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS place,
         count(*) OVER (PARTITION BY tree) AS n
  FROM leaves
), up AS (
  SELECT tree, 0 AS level, place, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM up WHERE n > 1 GROUP BY tree, level, place // 3
), subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n
  FROM up WHERE n = 1
), over AS (
  SELECT 0 AS level, place, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM over WHERE n > 1 GROUP BY level, place // 3
), runs AS (
  SELECT tree, level, place // 3 AS run, list(digest ORDER BY place) AS digests
  FROM up WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT NULL, level, place // 3, list(digest ORDER BY place) FROM over WHERE n > 1 GROUP BY ALL
), walk AS (
  SELECT r, tree, 0 AS level, place, n, told AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT w.r, w.tree, w.level + 1, w.place // 3, (w.n + 2) // 3,
         sha256(array_to_string(digests[:w.place % 3], '') || folded || array_to_string(digests[w.place % 3 + 2:], '')),
         proof || array_to_string(digests[:w.place % 3], '') || array_to_string(digests[w.place % 3 + 2:], '')
  FROM walk w JOIN runs u ON u.tree = w.tree AND u.level = w.level AND u.run = w.place // 3
  WHERE w.n > 1
), climb AS (
  SELECT w.r, w.tree, s.digest AS subroot, 0 AS level, s.place, s.n, folded, proof
  FROM walk w JOIN subroots s USING (tree) WHERE w.n = 1
  UNION ALL
  SELECT c.r, c.tree, subroot, c.level + 1, c.place // 3, (c.n + 2) // 3,
         sha256(array_to_string(digests[:c.place % 3], '') || folded || array_to_string(digests[c.place % 3 + 2:], '')),
         proof || array_to_string(digests[:c.place % 3], '') || array_to_string(digests[c.place % 3 + 2:], '')
  FROM climb c JOIN runs u ON u.tree IS NULL AND u.level = c.level AND u.run = c.place // 3
  WHERE c.n > 1
), root AS (SELECT digest AS root FROM over WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = root AS verified
FROM climb c JOIN leaves l USING (r), root WHERE c.n = 1""",
    "op13_vector_duplicates": """
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), usable AS (
  SELECT r, vec_id, v, sqrt(list_dot_product(v, v)) AS length FROM vectors
  WHERE len([x for x in v if x IS NULL OR NOT isfinite(x)]) = 0 AND list_dot_product(v, v) > 0
), links AS (
  SELECT a.r, b.r AS other, b.vec_id FROM usable a JOIN usable b
  ON a.r <> b.r AND list_dot_product(a.v, b.v) / (a.length * b.length) >= 0.9
), reach AS (
  SELECT r, r AS other, vec_id FROM vectors
  UNION
  SELECT reach.r, links.other, links.vec_id FROM reach JOIN links ON links.r = reach.other
), least AS (SELECT r, min(vec_id) AS component_id FROM reach GROUP BY r),
counted AS (SELECT r, count(*) AS n_links FROM links GROUP BY r)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id,
       component_id IS NOT DISTINCT FROM vec_id AS kept
FROM vectors JOIN least USING (r) LEFT JOIN counted USING (r)""",
}

"""A training corpus from raw documents: five stages, each one of the operators.

A stage takes (spark, docs, sf_dir) and returns documents with the columns it got; the
last adds the shard. Documents are told apart by their id; null ids are one id. Every
stage gives an empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.llm import decontamination, mixing, near_dedup, sharding, toxicity
from roadlake.session import pin

SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(model, F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group with five-word similarity 0.8 the smallest id stays.

    Rows that share the id and the text are one document, of which one row stays.
    """
    return near_dedup.drop_near_duplicates(docs, near_dedup.NearDuplicates(5, 80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: up to three rows, or none."""
    # The input's columns travel inside one, so that no name of theirs can clash.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("record"))
    numbered = pin(numbered, "numbered")
    looked_at = numbered.select("row", "record.doc_id", "record.source", "record.text")
    mixed = mixing.mix_sources(looked_at, row=F.col("row"))
    chosen = mixed.where("copies > 0").select("row", "copies")
    each = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return numbered.join(chosen, "row").select("record", each.alias("copy")).select("record.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it."""
    return sharding.assign_shards(docs, SHARDS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL cannot express the trained classifier; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each stage's result is written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

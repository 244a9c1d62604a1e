"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.session import pin


def _first(node: Column) -> Column:
    """Nodes in an order of chance, so that rounds are few whatever the numbering."""
    return F.struct(F.xxhash64(node).alias("chance"), node.alias("node"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b): its smallest reachable node.

    Each round a node takes the label of the first among itself and its neighbours, and
    links are replaced by links of the labels of their ends, each once and without loops.
    The last of a component's nodes is nobody's label, so links run out; on average a good
    part of the nodes goes in each round, and a group of many links shrinks to a few in the
    first. The labels of the rounds, one row per node left in it, are put together in the
    end. A round's tables are written to the shared folder, so the next round's plan starts
    from a scan.
    """

    def each_once(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return pin(ends.where("a <> b").distinct(), "links")

    left, rounds = each_once(links), []
    while not rounds or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = F.least(F.min(_first(F.col("b"))), _first(F.col("a")))
        labels = both.groupBy("a").agg(nearest["node"].alias("label"))
        labels = pin(labels.withColumnRenamed("a", "node"), "labels")
        rounds.append(labels)
        of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
        moved = left.join(of_a, "a").join(of_b, "b")
        left = each_once(moved.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("node").alias("label"), F.col("label").alias("end"))
        found = rounds.pop().join(later, "label", "left").select(
            "node", F.coalesce("end", "label").alias("label")
        )
    found = pin(found, "ends")
    least = found.groupBy("label").agg(F.min("node").alias("component"))
    return found.join(least, "label").select("node", "component")

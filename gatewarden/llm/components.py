"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewarden.session import cut_lineage


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``); the label is the least node.

    Each round takes the least label among a node and its neighbours and then follows
    the label of that label, so that long chains halve. Every round is written to the
    shared folder; it moves one row per node and link.
    """
    ends = links.select("a", "b")
    both = ends.unionByName(ends.selectExpr("b AS a", "a AS b"))
    both = cut_lineage(both.unionByName(both.selectExpr("a", "a AS b")).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
    for _ in range(most_rounds):
        own = F.max(F.when(F.col("a") == F.col("b"), F.col("label")))
        low = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("low"), own.alias("own"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        step = cut_lineage(low.join(jump, "low").select(
            F.col("a").alias("node"), F.least("low", "far").alias("label"), (F.least("low", "far") < F.col("own")).alias("moved")))
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further ``links``: only labels that these join are looked at again."""
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
    name = lambda end: F.coalesce(f"label_{end}", end)
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(name("a").alias("a"), name("b").alias("b"))
    new = components(between)
    old = labels.join(new.select(F.col("node").alias("label"), F.col("label").alias("better")), "label", "left").select(
        "node", F.coalesce("better", "label").alias("label"))
    return cut_lineage(old.unionByName(new.join(labels, "node", "left_anti")))

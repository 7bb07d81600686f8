"""Connected components of a large edge list: smallest label of the neighbours, and of the label's own label, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) of every node of edges (a, b), both long; the component is its smallest node. No edges: no rows.

    The result is the scratch's table `name`; each round's labels are dropped when the next ones are written.
    """
    both = scratch.write(f"{name}-edges", edges.select(F.col("a"), F.col("b")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.write(f"{name}-0", both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    moved, no = True, 0
    while moved:
        near = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        told = labels.join(near, "a").select("a", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("further"))
        told = told.join(jump, "label", "left").select("a", "old", F.least("label", "further").alias("label"))
        after = scratch.write(f"{name}-{no + 1}", told.select("a", "label", (F.col("old") != F.col("label")).alias("moved")))
        scratch.drop(f"{name}-{no}")
        moved, no = not after.where("moved").isEmpty(), no + 1
        labels = after.select("a", "label")
    scratch.drop(f"{name}-edges")
    return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))

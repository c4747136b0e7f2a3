"""Walks up a graph of what was made from what."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.sources.shared import written


def walk(edges: DataFrame, deepest: int = 10_000) -> DataFrame:
    """(child, parent, depth) of every ancestor of every child of `edges` (child, parent), at its least depth.

    Each turn joins only what the last one found, and leaves out what is known, so it ends on graphs with cycles too (there a node is its own ancestor).
    """
    edges = written(edges.select("child", "parent").distinct(), "edges")
    up = edges.select(F.col("child").alias("_c"), F.col("parent").alias("_p"))
    found = [written(edges.withColumn("depth", F.lit(1)), "walk")]
    for depth in range(2, deepest + 1):
        known = reduce(DataFrame.union, found)
        new = found[-1].join(up, F.col("parent") == F.col("_c")).select("child", F.col("_p").alias("parent")).distinct()
        new = written(new.join(known, ["child", "parent"], "left_anti").withColumn("depth", F.lit(depth)), "walk")
        if new.isEmpty():
            break
        found.append(new)
    return reduce(DataFrame.union, found)


def cycles(walked: DataFrame) -> DataFrame:
    """(node, length) of the nodes that are their own ancestors."""
    return walked.where("child = parent").select(F.col("child").alias("node"), F.col("depth").alias("length"))

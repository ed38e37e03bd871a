"""Connected components by repeated contraction, on tables only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscope.llm import common


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the smallest node of its component.

    In each round every node points to its smallest neighbour (or itself) and the edges are redrawn between what
    their ends point to; edges within one point go. Paths shrink to about half or less in a round and stars in one or
    two. Each round is written, so no lineage builds up; minima are partial before the shuffle, and a hub's rows are
    joined with a written table, which Spark can split.
    """
    edges = common.materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label"))
        points = common.materialise(points, "points")
        of_a = points.withColumnsRenamed({"node": "a", "label": "_a"})
        of_b = points.withColumnsRenamed({"node": "b", "label": "_b"})
        redrawn = edges.join(of_a, "a").join(of_b, "b").filter("_a <> _b").select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).distinct()
        edges = common.materialise(redrawn, "edges")
        levels.append(points)
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))

    def compose(deeper: DataFrame, points: DataFrame) -> DataFrame:
        roots = deeper.select(F.col("node").alias("label"), F.col("label").alias("_root"))
        return points.join(roots, "label", "left").select("node", F.coalesce("_root", "label").alias("label"))

    return common.materialise(reduce(compose, reversed(levels)), "labels") if len(levels) > 1 else levels[0]

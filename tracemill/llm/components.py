"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracemill.llm.scratch import Scratch


def _minimum_neighbour(pairs: DataFrame) -> DataFrame:
    """Each (a, b) with the smallest of a and all its b. The minimum is combined before the shuffle."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m"))
    return pairs.join(least, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u"))
    return _minimum_neighbour(both).where("b > a").select(
        F.col("b").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    joined = _minimum_neighbour(down)
    # Every smaller neighbour and the node itself move below the smallest neighbour.
    return joined.select(F.explode(F.array("a", "b")).alias("u"), F.col("m").alias("v")).where("u != v")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for every node on an edge ``(u, v)`` of long ids; root is the smallest node reached.

    Stars move to smaller and smaller centres until nothing changes, in a number of rounds that
    grows with the logarithm of the graph. Each round is a written table. Self loops and nulls are
    ignored, repeated edges count once, no edges give no rows.
    """
    clean = edges.where("u is not null and v is not null and u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, before = scratch.keep(clean, "edges"), None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if state == before or not state[0]:
            break
        before = state
        stars = _small_star(_large_star(current).distinct()).distinct()
        following = scratch.keep(stars, "stars")
        scratch.drop(current)
        current = following
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())

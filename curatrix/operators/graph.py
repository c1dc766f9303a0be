"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the edge table, both dealt by node and salt, so that a star's centre, however many neighbours
it has, is never one task's work. Nothing but two numbers a round reaches the driver, and the number of rounds grows with the logarithm of
the longest chain. Every round is cut off with a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.session import checkpointed
from curatrix.operators.skew import spread_minimum


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` of every node of ``edges`` (any order, repeats and loops allowed); root is the component's least node."""
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges, before = checkpointed(edges), None
    while True:
        # large star: all larger neighbours of a node go to the least one of its neighbourhood
        both = edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
        rows, least = spread_minimum(both, "u", "v")
        joined = rows.where("v > u").join(least, ["u", "_salt"]).withColumn("m", F.least("u", "_least"))
        large = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of a node, and the node, go to the least of them
        rows, least = spread_minimum(large, "u", "v")
        down = rows.join(least, ["u", "_salt"])
        small = down.select(F.inline(F.array(F.struct(F.col("v").alias("a"), F.col("_least").alias("b")), F.struct(F.col("u").alias("a"), F.col("_least").alias("b")))))
        edges = checkpointed(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())

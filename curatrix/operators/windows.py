"""Ranks, running sums and boundaries over ordered rows without one task for all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.functions.session import checkpointed


def duplicated(df: DataFrame, keys: Sequence[str], name: str = "duplicated") -> DataFrame:
    """``df`` with whether its key occurs more than once: a partial count joined back, so a hot key isn't one task's window."""
    counts = df.groupBy(*keys).agg((F.count("*") > 1).alias(name))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return df.alias("a").join(counts.alias("b"), same).select("a.*", F.col(f"b.{name}"))


def rank_in(partition: Sequence[str], order: Sequence[Column | str]) -> Column:
    return F.row_number().over(W.partitionBy(*partition).orderBy(*order))


def global_row_number(df: DataFrame, order: str, name: str, partitions: int | None = None) -> DataFrame:
    """Row numbers from 0 over a total order, by range partitions: the rows are written once in ranges, each range is counted, and numbers
    within a range start from the sum of the ranges before. ``order`` must be unique for numbers to be determined."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    base = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    return ranged.join(counts.withColumn("_base", base).drop("_n"), "_part").withColumn(name, F.col("_base") + within).drop("_part", "_base")


def by_distinct_score(df: DataFrame, score: str, target: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """``score, n, c0, c1, ...``: the rows of each distinct score, counted by class. Everything about ranks starts from this table."""
    return df.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), *(F.sum((F.col(target) == c).cast("int")).cast("long").alias(f"c{c}") for c in classes))


def running(df: DataFrame, columns: Sequence[str], order: str, descending: bool = False, partition: Sequence[str] = (), blocks: int = 256) -> DataFrame:
    """``df`` (one row a value of ``order``) with ``run_<column>``: inclusive running sums.

    Values are cut into blocks at approximate quantiles; blocks are summed, and sums before a block are added to those within it.
    """
    cuts = df.agg(F.percentile_approx(order, F.lit([i / blocks for i in range(1, blocks)]), 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    block = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<double>"), lambda x: x < F.col(order))) if cuts else F.lit(0)
    rows = df.withColumn("_b", -block if descending else block)
    sums = rows.groupBy(*partition, "_b").agg(*(F.sum(c).alias(f"_s_{c}") for c in columns))
    before = W.partitionBy(*partition).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*partition, "_b", *(F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_base_{c}") for c in columns))
    joined = rows.join(sums, [*partition, "_b"])
    within = W.partitionBy(*partition, "_b").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(W.unboundedPreceding, 0)
    out = joined.withColumns({f"run_{c}": F.sum(c).over(within) + F.col(f"_base_{c}") for c in columns})
    return out.drop("_b", *(f"_base_{c}" for c in columns))

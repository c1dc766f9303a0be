"""Set operations over key columns and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import blank_to_empty, id_set_digest


def keys(df: DataFrame, column: str) -> DataFrame:
    """Distinct stripped non-blank values of a column as ``key``."""
    return df.select(blank_to_empty(F.col(column).cast("string")).alias("key")).where("key <> ''").distinct()


def overlap(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    return keys(left, column).intersect(keys(right, column))


def overlap_audit(reference: DataFrame, candidate: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``column, reference, candidate, overlap, unique``: distinct non-blank values of each column."""
    out = None
    for c in columns:
        both = keys(reference, c).select("key", F.lit(1).alias("r"), F.lit(0).alias("c")).union(keys(candidate, c).select("key", F.lit(0), F.lit(1)))
        one = both.groupBy("key").agg(F.max("r").alias("r"), F.max("c").alias("c"))
        total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
        row = one.agg(total("r").alias("reference"), total("c").alias("candidate"), total(F.col("r") * F.col("c")).alias("overlap"), total((1 - F.col("r")) * F.col("c")).alias("unique"))
        row = row.select(F.lit(c).alias("column"), "*")
        out = row if out is None else out.union(row)
    return out


def set_differences(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """``left_only, right_only, equal`` counts of two key sets."""
    both = keys(left, column).select("key", F.lit(1).alias("l"), F.lit(0).alias("r")).union(keys(right, column).select("key", F.lit(0), F.lit(1)))
    one = both.groupBy("key").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    count = lambda p: F.coalesce(F.sum(p.cast("int")), F.lit(0)).cast("long")
    out = one.agg(count(F.col("r") == 0).alias("left_only"), count(F.col("l") == 0).alias("right_only"))
    return out.withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def complement(everything: DataFrame, held_out: DataFrame, column: str) -> DataFrame:
    return everything.join(held_out.select(column).distinct(), column, "left_anti")


def set_digest(df: DataFrame, column: str) -> DataFrame:
    """``n, sha256`` of the set; for sets of bounded size (the values meet in one row)."""
    return df.agg(F.count_distinct(F.col(column)).alias("n"), id_set_digest(F.col(column).cast("string")).alias("sha256"))

"""Deterministic sampling: quotas per stratum, hard errors, balanced epochs, spaced samples.

Order comes from a hash of seed and key, so samples don't depend on partitioning. Top-k within a stratum is taken in two steps: the
best k of each salt, then the best k of those, so that a stratum with most of the rows isn't sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.functions.text import sha256
from curatrix.operators.expectations import check, enforce

SALTS = 64


def top_per_stratum(df: DataFrame, stratum: Sequence[str], order: Sequence[Column], k: int, rank: str, key: str) -> DataFrame:
    """The first ``k`` rows of each stratum by ``order`` with their rank from 1."""
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS))
    first = df.withColumn("_salt", salt)
    first = first.withColumn("_r", F.row_number().over(W.partitionBy(*stratum, "_salt").orderBy(*order))).where(F.col("_r") <= k).drop("_r", "_salt")
    return first.withColumn(rank, F.row_number().over(W.partitionBy(*stratum).orderBy(*order))).where(F.col(rank) <= k)


def hard_errors(df: DataFrame, low: float, high: float, most: int, *, key: str = "record_id", source: str = "source_id", target: str = "target", score: str = "p") -> DataFrame:
    """Negatives scored high and positives scored low, with hardness and rank, at most ``most`` for each error type and source."""
    kind = F.when((F.col(target) == 0) & (F.col(score) >= high), F.lit("hard_false_positive")).when((F.col(target) == 1) & (F.col(score) < low), F.lit("hard_false_negative"))
    errors = df.withColumn("error_type", kind).where(F.col("error_type").isNotNull())
    hardness = F.when(F.col("error_type") == "hard_false_positive", F.col(score)).otherwise(1.0 - F.col(score))
    errors = errors.withColumn("hardness", hardness)
    return top_per_stratum(errors, ["error_type", source], [F.desc("hardness"), F.asc(key)], most, "source_error_rank", key)


def selection_key(seed: str, key: str) -> Column:
    return sha256(F.lit(f"{seed}:"), F.col(key).cast("string"))


def quota_controls(df: DataFrame, quotas: Mapping[str, int], *, stratum: str, unit: str, key: str, seed: str, excluded: DataFrame | None = None) -> DataFrame:
    """Per stratum, its quota of rows: one row of every unit first, then second rows, each round in hash order. A shortage is an error."""
    rows = df if excluded is None else df.join(excluded.select(key).distinct(), key, "left_anti")
    wanted = df.sparkSession.createDataFrame([(k, int(v)) for k, v in quotas.items()], f"`{stratum}` string, quota int")
    keyed = rows.join(F.broadcast(wanted), stratum).withColumn("selection_key", selection_key(seed, key))  # a row a stratum
    enforce(check(wanted.join(keyed.groupBy(stratum).count(), stratum, "left"), "enough rows for each quota", F.coalesce("count", F.lit(0)) >= F.col("quota"), F.col(stratum)))
    repeat = F.row_number().over(W.partitionBy(stratum, unit).orderBy("selection_key", key)) - 1
    keyed = keyed.withColumn("repeat_rank", repeat)
    most = max(quotas.values())
    order = [F.asc("repeat_rank"), F.asc("selection_key"), F.asc(key)]
    return top_per_stratum(keyed, [stratum], order, most, "pick", key).where(F.col("pick") <= F.col("quota")).drop("quota")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by the order columns (a grouped minimum of a struct, not a sort)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_b"))
    return best.select(*keys, "_b.*").select(*df.columns)


def epoch_sample(df: DataFrame, *, ratio: int, seed: int, epoch: int, key: str = "record_id", target: str = "target", source: str | None = None, forced: DataFrame | None = None, repeats: int = 1) -> DataFrame:
    """A balanced epoch: rows of ``df`` with ``copies``.

    Without ``source``: all positives and ratio times as many negatives, if there are so many. With it: the same numbers from every
    source, those that the poorest one can give. Forced rows stand ``repeats`` times within their class's number. The draw is by the
    rank of a hash of seed + epoch and key.
    """
    if ratio < 1 or repeats < 1:
        raise ValueError("ratio and repeats must be at least 1")
    part = [source] if source else []
    rows = df if forced is None else df.join(forced.select(key, F.lit(True).alias("_forced")).distinct(), key, "left")
    rows = rows.withColumn("_forced", F.coalesce(F.col("_forced"), F.lit(False)) if forced is not None else F.lit(False))
    ones = lambda p: F.sum(p.cast("int")).cast("long")
    count = rows.groupBy(*part).agg(ones(F.col(target) == 1).alias("_p"), ones(F.col(target) == 0).alias("_n"), ones((F.col(target) == 1) & F.col("_forced")).alias("_fp"), ones((F.col(target) == 0) & F.col("_forced")).alias("_fn"))
    least = count.agg(F.min("_p").alias("_lp"), F.min("_n").alias("_ln"))
    quota = count.crossJoin(F.broadcast(least))
    quota = quota.withColumns({"_qp": F.col("_lp"), "_qn": F.least(F.col("_lp") * ratio, F.col("_ln"))})
    enforce(check(quota, "both targets in every source", (F.col("_p") > 0) & (F.col("_n") > 0)))
    enforce(check(quota, "forced rows fit the epoch", (F.col("_fp") * repeats <= F.col("_qp")) & (F.col("_fn") * repeats <= F.col("_qn"))))
    quota = quota.select(*part, (F.col("_qp") - F.col("_fp") * repeats).alias("_free_p"), (F.col("_qn") - F.col("_fn") * repeats).alias("_free_n"))
    free = rows.join(quota, part) if part else rows.crossJoin(F.broadcast(quota))
    draw = sha256(F.lit(f"{seed + epoch}:"), F.col(key).cast("string"))
    # ranks within (source, target) by two steps: counts of hash ranges, then ranks within them
    ranged = free.withColumns({"_draw": F.when(~F.col("_forced"), draw)}).withColumn("_range", F.substring("_draw", 1, 3))
    stratum = [*part, target]
    counts = ranged.where(~F.col("_forced")).groupBy(*stratum, "_range").agg(F.count("*").alias("_c"))
    base = F.coalesce(F.sum("_c").over(W.partitionBy(*stratum).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    drawn = ranged.where(~F.col("_forced")).join(counts.withColumn("_base", base).drop("_c"), [*stratum, "_range"])
    place = F.col("_base") + F.row_number().over(W.partitionBy(*stratum, "_range").orderBy("_draw", key))
    drawn = drawn.withColumn("_place", place).where(F.col("_place") <= F.when(F.col(target) == 1, F.col("_free_p")).otherwise(F.col("_free_n")))
    return drawn.select(*df.columns, F.lit(1).alias("copies")).union(rows.where("_forced").select(*df.columns, F.lit(repeats).alias("copies")))


def repeat_rows(df: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as often as its copies say."""
    return df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col(copies)))).drop("_i", copies)


def collapse_sources(df: DataFrame, source: str, groups: Mapping[str, Sequence[str]] | None) -> DataFrame:
    """Sources replaced by their declared group; a source in no group or in two is an error."""
    if groups is None:
        return df
    pairs = [(s.strip(), g.strip()) for g, members in groups.items() for s in members]
    if not pairs or any(not s or not g for s, g in pairs) or any(not m for m in groups.values()):
        raise ValueError("source groups need names and members")
    if len({s for s, _ in pairs}) != len(pairs):
        raise ValueError("a source belongs to more than one group")
    table = df.sparkSession.createDataFrame(pairs, f"`{source}` string, _group string")
    joined = df.join(F.broadcast(table), source, "left")  # declared sources only
    enforce(check(joined, "every source is grouped", F.col("_group").isNotNull(), F.col(source)))
    return joined.withColumn(source, F.col("_group")).drop("_group")


def spaced_sample(df: DataFrame, k: int, order: str) -> DataFrame:
    """The rows at the truncated places of ``k`` even steps from the first to the last row in order, with ``place`` from 0.

    Rows are numbered by range partitions: a count for each, their running sums, and numbers within.
    """
    from curatrix.operators.windows import global_row_number

    numbered = global_row_number(df, order, "place")
    n = numbered.agg(F.count("*").alias("n")).first()["n"]
    if n == 0:
        return numbered
    places = sorted({int(i * (n - 1) / (k - 1)) if k > 1 else 0 for i in range(min(k, n))})
    return numbered.where(F.col("place").isin(places))


def chosen_scale(key: Column, seed: int, epoch: int, scales: Sequence[float]) -> Column:
    """The scale of a record's view in an epoch: one of ``scales``, by a hash of seed, epoch and key, so that runs repeat."""
    text = F.concat(F.lit(f"{seed}:{epoch}:"), key.cast("string"))
    place = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long") % len(scales)
    return F.element_at(F.array(*map(F.lit, map(float, scales))), (place + 1).cast("int"))


def centre_crop(width: Column, height: Column, scale: Column) -> Column:
    """``left, top, width, height`` of the central part of an image, a pixel at least."""
    w, h = (F.greatest(F.lit(1), F.least(side, F.bround(side * scale).cast("int"))) for side in (width, height))
    half = lambda side, part: F.floor((side - part) / 2).cast("int")
    return F.struct(half(width, w).alias("left"), half(height, h).alias("top"), w.alias("width"), h.alias("height"))

"""Leakage-free splits: hash partitions, stratified group folds, out-of-fold plans, and their audits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.functions.session import checkpointed
from curatrix.functions.text import hash_fold, is_blank, order_key, unit_interval
from curatrix.operators.expectations import check, report, unique_check
from curatrix.operators.windows import global_row_number

PLAN_DOMAIN = "oof-v1"
#: Groups that the greedy k-fold takes to the driver at most (two numbers each); beyond that use ``oof_plan``, which is distributed.
MAX_GREEDY_GROUPS = 20_000_000
#: Groups whose counts or folds travel as one row.
FOLD_BLOCK = 256


def hash_partition(c: str, seed: int, fraction: float, names: tuple[str, str] = ("calibration", "test")) -> Column:
    if not 0 < fraction < 1:
        raise ValueError("the fraction must be between 0 and 1")
    return F.when(unit_interval(c, seed) < fraction, F.lit(names[0])).otherwise(F.lit(names[1]))


def group_summary(df: DataFrame, group: str, source: str, target: str) -> DataFrame:
    """One row a group: sources, source, target (the largest), records."""
    return df.groupBy(group).agg(F.count_distinct(source).alias("source_count"), F.min(source).alias("source_id"), F.max(target).cast("int").alias("group_target"), F.count("*").alias("records"))


def sparse_strata(summary: DataFrame, folds: int) -> DataFrame:
    """Strata with fewer groups than folds."""
    return summary.groupBy("source_id", "group_target").agg(F.count("*").alias("groups")).where(F.col("groups") < folds)


def plan_checks(df: DataFrame, folds: int, *, key: str = "record_id", group: str = "group_id", source: str = "source_id", target: str = "target") -> DataFrame:
    summary = group_summary(df, group, source, target)
    text = lambda c: F.col(c).cast("string")
    return report(
        [
            check(df, "target_binary", F.col(target).isin(0, 1), text(key)),
            *(check(df, f"{c}_not_blank", ~is_blank(text(c)), text(key)) for c in (key, group, source)),
            unique_check(df, "record_unique", key),
            check(summary, "group_in_one_source", F.col("source_count") == 1, text(group)),
            check(sparse_strata(summary, folds), "stratum_has_a_group_per_fold", F.lit(False), F.concat_ws("/", text("source_id"), text("group_target"))),
        ]
    )


def oof_assignment(df: DataFrame, folds: int, seed: int, *, group: str = "group_id", source: str = "source_id", target: str = "target", domain: str = PLAN_DOMAIN) -> DataFrame:
    """``group, oof_fold``: groups of each (source, target) stratum in the order of their hash, dealt round-robin.

    The window runs over groups, not rows. A stratum that holds a third of all groups is ranked in two steps: groups are counted by
    the first 12 bits of their hash, the counts are summed, and ranks are taken within these buckets.
    """
    summary = group_summary(df, group, source, target)
    keyed = summary.withColumn("_key", order_key(F.col(group).cast("string"), seed, domain)).withColumn("_bucket", F.substring("_key", 1, 3))
    stratum = ["source_id", "group_target"]
    counts = keyed.groupBy(*stratum, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*stratum).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = keyed.join(counts, [*stratum, "_bucket"])
    place = F.col("_base") + F.row_number().over(W.partitionBy(*stratum, "_bucket").orderBy("_key", group)) - 1
    return ranked.select(group, F.concat(F.lit("fold_"), (place % folds).cast("string")).alias("oof_fold"))


def oof_plan(df: DataFrame, folds: int, seed: int, *, group: str = "group_id", **names) -> DataFrame:
    """``df`` with ``oof_fold``; check with ``plan_checks`` first (a sparse stratum is an error)."""
    if folds < 2:
        raise ValueError("a plan needs at least two folds")
    return df.join(oof_assignment(df, folds, seed, group=group, **names), group)


def materialize_fold(plan: DataFrame, fold: str, frozen: DataFrame) -> DataFrame:
    """The fold as validation, the other folds as train, and the frozen test rows; the old validation rows are gone."""
    own = plan.withColumn("split", F.when(F.col("oof_fold") == fold, F.lit("validation")).otherwise(F.lit("train")))
    return union_columns([own, frozen.where(F.col("split") == "test")])


def union_columns(frames: list[DataFrame]) -> DataFrame:
    """Union over the sorted union of columns, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*(F.col(f"`{c}`") for c in sorted(out.columns)))


def fold_complements(plan: DataFrame, group: str = "group_id") -> DataFrame:
    """``fold, n_held_out, n_train``: groups in and outside each fold."""
    groups = plan.select(group, "oof_fold").distinct()
    total = groups.agg(F.count_distinct(group).alias("_all"))
    held = groups.groupBy("oof_fold").agg(F.count("*").alias("n_held_out"))
    return held.crossJoin(F.broadcast(total)).select(F.col("oof_fold").alias("fold"), "n_held_out", (F.col("_all") - F.col("n_held_out")).alias("n_train"))


def leaking_groups(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups in more than one split."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def split_target_counts(df: DataFrame, splits: list[str], split: str = "split", target: str = "target") -> DataFrame:
    """``split, n_targets`` for every required split, absent ones too."""
    wanted = df.sparkSession.createDataFrame([(s,) for s in splits], f"{split} string")
    got = df.groupBy(split).agg(F.count_distinct(target).alias("_n"))
    return wanted.join(got, split, "left").select(split, F.coalesce("_n", F.lit(0)).alias("n_targets"))


def split_summary(df: DataFrame, split: str = "split", group: str = "group_id", target: str = "target") -> DataFrame:
    """``split, images, groups, target_0, target_1`` in one pass."""
    count = lambda y: F.sum((F.col(target) == y).cast("int")).cast("long")
    return df.groupBy(split).agg(F.count("*").alias("images"), F.count_distinct(group).alias("groups"), count(0).alias("target_0"), count(1).alias("target_1"))


def folds_to_splits(fold: Column) -> Column:
    return F.when(fold == 0, F.lit("test")).when(fold == 1, F.lit("validation")).otherwise(F.lit("train"))


def greedy_group_folds(counts: np.ndarray, folds: int, seed: int) -> np.ndarray:
    """Fold of each group (rows of class counts): groups in shuffled order, then by falling spread of their counts, each go to the fold
    that leaves the least mean spread of class shares; among folds as good, to the one with the fewest records."""
    order = np.random.RandomState(seed).permutation(len(counts))
    order = order[np.argsort(-counts[order].std(axis=1), kind="mergesort")]
    total = np.maximum(counts.sum(axis=0), 1)
    held = np.zeros((folds, counts.shape[1]))
    out = np.empty(len(counts), np.int64)
    for g in order:
        spread = np.empty(folds)
        for f in range(folds):
            held[f] += counts[g]
            spread[f] = (held / total).std(axis=0).mean()
            held[f] -= counts[g]
        best = np.flatnonzero(np.isclose(spread, spread.min()))
        f = int(best[np.argmin(held[best].sum(axis=1))])
        held[f] += counts[g]
        out[g] = f
    return out


def stratified_group_folds(df: DataFrame, folds: int, seed: int, *, group: str = "group_id", target: str = "target") -> DataFrame:
    """``df`` with ``fold``. The greedy step is sequential over groups: two counts a group go to the driver, packed, up to a checked bound.

    Groups are numbered on the executors; counts come in blocks of ``FOLD_BLOCK`` groups, one partition after the other, and the folds go back
    as a byte or more a group. Group names never reach the driver.
    """
    summary = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("_g")).agg(*(F.sum((F.col(target) == y).cast("int")).cast("long").alias(f"y{y}") for y in (0, 1)))
    numbered = checkpointed(global_row_number(summary, "_g", "_j").withColumn("_block", F.expr(f"_j div {FOLD_BLOCK}")))
    n = numbered.count()
    if n > MAX_GREEDY_GROUPS:
        raise ValueError(f"more than {MAX_GREEDY_GROUPS} groups: use oof_plan")
    counts = np.zeros((n, 2))
    texts = lambda y: F.concat_ws(",", F.transform("a", lambda x: F.coalesce(x[y], F.lit(0)).cast("string"))).alias(y)
    packed = numbered.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("_j", "y0", "y1"))).alias("a")).select("_block", texts("y0"), texts("y1"))
    for row in packed.toLocalIterator():
        at = row["_block"] * FOLD_BLOCK
        for k, y in enumerate(("y0", "y1")):
            got = np.array(row[y].split(","), np.float64)
            counts[at : at + len(got), k] = got
    out = greedy_group_folds(counts, folds, seed) if n else np.empty(0, np.int64)
    kind = np.dtype(">u4")
    blocks = ((i, bytearray(out[i * FOLD_BLOCK : (i + 1) * FOLD_BLOCK].astype(kind).tobytes())) for i in range(-(-n // FOLD_BLOCK)))
    assigned = df.sparkSession.createDataFrame(list(blocks), "_block long, _folds binary")
    place = (F.col("_j") % FOLD_BLOCK * kind.itemsize + 1).cast("int")
    fold = F.conv(F.hex(F.col("_folds").substr(place, F.lit(kind.itemsize))), 16, 10).cast("int")
    named = numbered.join(assigned, "_block").select(F.col("_g").alias(group), fold.alias("fold"))
    return df.join(named, group)


def patient_folds(df: DataFrame, c: str, seed: int, folds: int) -> DataFrame:
    return df.withColumn("fold", hash_fold(c, seed, folds))

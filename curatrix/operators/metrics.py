"""Evaluation metrics as aggregates over distinct scores.

Rows are first counted by distinct score and class (a map-side combine), then ranked with block-wise running sums: nothing sorts all
rows in one task. Any metric can be taken by group columns in the same pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.numeric import is_probability, next_up, sigmoid
from curatrix.functions.session import checkpointed
from curatrix.operators.expectations import expect
from curatrix.operators.windows import running

EPS = 2.220446049250313e-16


def _at_least_one(c: Column) -> Column:
    return F.greatest(c, F.lit(1))


def score_table(df: DataFrame, target: str, score: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``by, score, n, pos, neg``: (weighted) rows of each distinct score."""
    w = F.col(weight) if weight else F.lit(1)
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(w).cast("long").alias("n"), F.sum(w * (F.col(target) == 1).cast("int")).cast("long").alias("pos"), F.sum(w * (F.col(target) == 0).cast("int")).cast("long").alias("neg"))


def ranked_scores(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The score table with running sums from the highest score down, and totals ``tot_pos, tot_neg``."""
    ranked = running(table, ["n", "pos", "neg"], "score", descending=True, partition=by)
    totals = table.groupBy(*by).agg(F.sum("pos").alias("tot_pos"), F.sum("neg").alias("tot_neg"))
    return ranked.join(totals, list(by)) if by else ranked.crossJoin(F.broadcast(totals))


def ranking_metrics(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, roc_auc, pr_auc``: ties count half; precision steps over distinct scores without interpolation. Null where a class lacks."""
    ranked = ranked_scores(table, by)
    auc = F.try_divide(F.sum(F.col("neg") * (F.col("run_pos") - F.col("pos") / 2)), F.max("tot_pos") * F.max("tot_neg"))
    ap = F.sum(F.try_divide("pos", "tot_pos") * (F.col("run_pos") / F.col("run_n")))
    both = (F.max("tot_pos") > 0) & (F.max("tot_neg") > 0)
    return ranked.groupBy(*by).agg(F.when(both, auc).alias("roc_auc"), F.when(F.max("tot_pos") > 0, ap).alias("pr_auc"))


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Zero-safe rates of a confusion table."""
    sensitivity, specificity = tp / _at_least_one(tp + fn), tn / _at_least_one(tn + fp)
    precision = tp / _at_least_one(tp + fp)
    return {
        "sensitivity": sensitivity,
        "specificity": specificity,
        "precision": precision,
        "negative_predictive_value": tn / _at_least_one(tn + fn),
        "f1_score": 2 * precision * sensitivity / F.greatest(precision + sensitivity, F.lit(EPS)),
        # the mean recall of the classes that there are
        "balanced_accuracy": (sensitivity + specificity) / _at_least_one((tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")),
    }


def confusion(df: DataFrame, target: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """``by, tp, fp, fn, tn`` of a row-level decision."""
    count = lambda y, p: F.sum(((F.col(target) == y) & (positive if p else ~positive)).cast("int")).cast("long")
    return df.groupBy(*by).agg(count(1, True).alias("tp"), count(0, True).alias("fp"), count(1, False).alias("fn"), count(0, False).alias("tn"))


def calibration_error(df: DataFrame, target: str, score: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """``by, expected_calibration_error``: bins of equal width, the last one closed."""
    if bins < 2:
        raise ValueError("at least two bins")
    number = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    binned = df.groupBy(*by, number.alias("_bin")).agg(F.avg(score).alias("_p"), F.avg(F.col(target).cast("double")).alias("_y"), F.count("*").alias("_n"))
    return binned.groupBy(*by).agg((F.sum(F.abs(F.col("_p") - F.col("_y")) * F.col("_n")) / F.sum("_n")).alias("expected_calibration_error"))


def log_loss(p: Column, target: Column) -> Column:
    """Row loss with probabilities kept off 0 and 1."""
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return -F.when(target == 1, F.log(q)).otherwise(F.log(1 - q))


def binary_metrics(df: DataFrame, *, target: str = "target", score: str = "p", threshold: float = 0.5, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """One row (a group): ranking, threshold and probability metrics, counts and rates.

    The rows are read once, into the table of distinct scores; all metrics are sums over that table, which is written to the
    checkpoint folder because several of them read it.
    """
    if bins < 2:
        raise ValueError("at least two bins")
    by = list(by)
    table = checkpointed(score_table(expect(df, "scores are probabilities", is_probability(F.col(score))), target, score, by))
    s, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    hit = s >= threshold
    cell = lambda c, test: F.sum(F.when(test, F.col(c)).otherwise(0)).cast("long")
    labelled = F.sum(pos + neg)
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), s))
    sums = table.groupBy(*by).agg(
        cell("pos", hit).alias("tp"),
        cell("neg", hit).alias("fp"),
        cell("pos", ~hit).alias("fn"),
        cell("neg", ~hit).alias("tn"),
        (F.sum(pos * F.pow(1 - s, 2) + neg * F.pow(s, 2)) / labelled).alias("brier_score"),
        (F.sum(pos) / labelled).alias("prevalence"),
        F.sum("n").cast("long").alias("n"),
        F.sum("pos").cast("long").alias("positive_n"),
        (-F.sum(pos * F.log(q) + neg * F.log(1 - q)) / labelled).alias("log_loss"),
    )
    number = F.least(F.floor(s * bins), F.lit(bins - 1))
    binned = table.groupBy(*by, number.alias("_bin")).agg((F.sum(s * (pos + neg)) - F.sum("pos")).alias("_gap"), labelled.alias("_n"))
    ece = binned.groupBy(*by).agg((F.sum(F.abs("_gap")) / F.sum("_n")).alias("expected_calibration_error"))
    join = (lambda a, b: a.join(b, by)) if by else (lambda a, b: a.crossJoin(F.broadcast(b)))
    out = join(join(ranking_metrics(table, by), sums), ece)
    return out.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def with_derived(metrics: DataFrame) -> DataFrame:
    """``pr_auc_lift, false_positive_rate, false_negative_rate`` beside the metrics they come from."""
    return metrics.withColumns({"pr_auc_lift": F.col("pr_auc") / F.col("prevalence"), "false_positive_rate": 1 - F.col("specificity"), "false_negative_rate": 1 - F.col("sensitivity")})


def threshold_for_sensitivity(df: DataFrame, minimum: float, *, target: str = "target", score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """``by, threshold``: the highest score that keeps the sensitivity."""
    if not 0 < minimum <= 1:
        raise ValueError("the minimum must be in (0, 1]")
    ranked = ranked_scores(checkpointed(score_table(df, target, score, by)), by)
    return ranked.where(F.col("run_pos") / F.col("tot_pos") >= minimum).groupBy(*by).agg(F.max("score").alias("threshold"))


def threshold_for_specificity(df: DataFrame, minimum: float, *, target: str = "target", score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """``by, threshold``: the smallest of the scores and their next larger doubles that keeps the specificity."""
    if not 0 < minimum <= 1:
        raise ValueError("the minimum must be in (0, 1]")
    table = checkpointed(score_table(df, target, score, by))
    up = running(table, ["neg"], "score", partition=by)
    totals = table.groupBy(*by).agg(F.sum("neg").alias("tot_neg"))
    joined = up.join(totals, list(by)) if by else up.crossJoin(F.broadcast(totals))
    # negatives below a score are refused at that score; those up to it at the next double
    at = joined.select(*by, F.col("score").alias("candidate"), ((F.col("run_neg") - F.col("neg")) / F.col("tot_neg")).alias("specificity"))
    above = joined.select(*by, next_up(F.col("score")).alias("candidate"), (F.col("run_neg") / F.col("tot_neg")).alias("specificity"))
    return at.union(above).where(F.col("specificity") >= minimum).groupBy(*by).agg(F.min("candidate").alias("threshold"))


# ---- three classes


def three_class_decision(score: Column, low: Column, high: Column) -> Column:
    return F.when(score < low, 0).when(score < high, 1).otherwise(2)


def three_class_metrics(df: DataFrame, predicted: Column, target: str = "target", by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts ``c<target><prediction>``, recalls, precisions, accuracy, macro and worst recall and their range."""
    cell = lambda t, p: F.sum(((F.col(target) == t) & (predicted == p)).cast("int")).cast("long").alias(f"c{t}{p}")
    counts = df.groupBy(*by).agg(F.count("*").alias("records"), *(cell(t, p) for t in range(3) for p in range(3)))
    row = lambda t: sum((F.col(f"c{t}{p}") for p in range(3)), F.lit(0))
    column = lambda p: sum((F.col(f"c{t}{p}") for t in range(3)), F.lit(0))
    out = counts.withColumns({f"recall_{t}": F.when(row(t) > 0, F.col(f"c{t}{t}") / row(t)) for t in range(3)})
    out = out.withColumns({f"precision_{p}": F.when(column(p) > 0, F.col(f"c{p}{p}") / column(p)).otherwise(0.0) for p in range(3)})
    recalls = [F.col(f"recall_{t}") for t in range(3)]
    return out.withColumns(
        {
            "accuracy": sum((F.col(f"c{t}{t}") for t in range(3)), F.lit(0)) / F.col("records"),
            "macro_recall": (recalls[0] + recalls[1] + recalls[2]) / 3,
            "worst_class_recall": F.least(*recalls),
            "recall_range": F.greatest(*recalls) - F.least(*recalls),
        }
    )


#: Ranges of boundaries that the threshold search compares at first, and parts of a range in each later step.
RANGES, PARTS = 256, 16


def best_three_zone_thresholds(df: DataFrame, *, target: str = "target", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """``by, low_threshold, high_threshold`` and the recalls there: worst recall, mean recall, small range, outer recalls, low places.

    Boundaries lie between neighbouring distinct scores. Pairs of boundaries are searched by branch and bound: pairs of ranges of boundaries
    get an upper bound of (worst recall, mean recall), since counts below a boundary only grow with it; pairs of ranges whose bound stays
    below what a pair of boundaries reaches are dropped, the others are cut further, down to single boundaries. Exact for any number of
    scores; a step's work follows the number of ranges that are left, not the square of the boundaries.
    """
    by = list(by)
    table = df.groupBy(*by, F.col(score).alias("score")).agg(F.count("*").alias("n"), *(F.sum((F.col(target) == t).cast("int")).cast("long").alias(f"c{t}") for t in range(3)))
    table = checkpointed(table.withColumn("one", F.lit(1).cast("long")))
    totals = table.groupBy(*by).agg(*(F.sum(f"c{t}").alias(f"t{t}") for t in range(3)), F.sum("one").alias("scores")).withColumn("boundaries", F.col("scores") - 1)
    totals = checkpointed(totals)
    up = running(table, ["n", "c0", "c1", "c2", "one"], "score", partition=by)
    down = running(table, ["one"], "score", descending=True, partition=by).select(*by, (F.col("run_one") - 1).alias("_above"), F.col("score").alias("_next"))
    # the boundary above the i-th score lies halfway to the next one
    marks = up.withColumnRenamed("run_one", "place").join(totals, by) if by else up.withColumnRenamed("run_one", "place").crossJoin(F.broadcast(totals))
    marks = marks.where("place < scores").withColumn("_above", F.col("scores") - 1 - F.col("place"))
    marks = marks.join(down, [*by, "_above"]).select(*by, "place", "score", ((F.col("score") + F.col("_next")) / 2.0).alias("threshold"), "run_n", "run_c0", "run_c1", "run_c2")
    marks = checkpointed(marks)
    most = totals.agg(F.max("boundaries")).first()[0] or 0
    width = 1
    while width * RANGES < most:
        width *= PARTS

    def ranges(width: int, side: str) -> DataFrame:
        """Ranges of ``width`` places: their first and last counts, and those of the ends."""
        ends = lambda c: (F.min(c).alias(f"{side}_{c}_min"), F.max(c).alias(f"{side}_{c}_max"))
        cut = marks.groupBy(*by, F.floor((F.col("place") - 1) / width).alias(side))
        return cut.agg(*(e for c in ("place", "run_n", "run_c0", "run_c1", "run_c2", "threshold") for e in ends(c)))

    def with_totals(pairs: DataFrame) -> DataFrame:
        return pairs.join(F.broadcast(totals), by) if by else pairs.crossJoin(F.broadcast(totals))  # a row a group

    def recalls(low: str, high: str, high2: str, low1: str) -> list[Column]:
        return [
            F.try_divide(F.col(f"low_run_c0_{low}"), F.col("t0")),
            F.try_divide(F.col(f"high_run_c1_{high}") - F.col(f"low_run_c1_{low1}"), F.col("t1")),
            F.try_divide(F.col("t2") - F.col(f"high_run_c2_{high2}"), F.col("t2")),
        ]

    def bound(r: list[Column]) -> Column:
        # a class without rows has recalls of null, which least() leaves out here as in the key of a pair
        return F.struct(F.least(*r).alias("a"), ((r[0] + r[1] + r[2]) / 3).alias("b"))

    low, high = ranges(width, "low"), ranges(width, "high")
    pairs = low.join(high, by) if by else low.crossJoin(F.broadcast(high))  # RANGES rows a side and group
    while True:
        pairs = with_totals(pairs.where("low_place_min < high_place_max"))
        if width == 1:
            break
        # the greatest bound of the pairs in two ranges, and what their outermost boundaries reach
        pairs = pairs.withColumns({"_bound": bound(recalls("max", "max", "min", "min")), "_reached": bound(recalls("min", "max", "max", "min"))})
        pairs = checkpointed(pairs.select(*by, "low", "high", "_bound", "_reached"))
        reached = pairs.groupBy(*by).agg(F.max("_reached").alias("_best"))
        left = pairs.join(F.broadcast(reached), by) if by else pairs.crossJoin(F.broadcast(reached))
        left = left.where(F.col("_bound") >= F.col("_best")).select(*by, *((F.col(s) * PARTS).alias(s) for s in ("low", "high")))
        width //= PARTS
        for s in ("low", "high"):
            left = left.withColumn(s, F.explode(F.sequence(F.col(s), F.col(s) + (PARTS - 1))))
        left = left.where("low <= high")
        pairs = left.join(ranges(width, "low"), [*by, "low"]).join(ranges(width, "high"), [*by, "high"])
    r = recalls("min", "min", "min", "min")
    key = F.struct(F.least(*r).alias("a"), ((r[0] + r[1] + r[2]) / 3).alias("b"), (-(F.greatest(*r) - F.least(*r))).alias("c"), (r[0] + r[2]).alias("d"), (-F.col("low_run_n_min")).alias("e"), (-F.col("high_run_n_min")).alias("f"))
    value = F.struct(F.col("low_threshold_min").alias("low_threshold"), F.col("high_threshold_min").alias("high_threshold"), *(x.alias(f"r{i}") for i, x in enumerate(r)), "boundaries")
    best = pairs.groupBy(*by).agg(F.max_by(value, key).alias("_b"))
    worst, boundaries = F.least("_b.r0", "_b.r1", "_b.r2"), F.col("_b.boundaries")
    return best.select(
        *by,
        "_b.low_threshold",
        "_b.high_threshold",
        worst.alias("worst_class_recall"),
        ((F.col("_b.r0") + F.col("_b.r1") + F.col("_b.r2")) / 3).alias("macro_recall"),
        (boundaries * (boundaries - 1) / 2).cast("long").alias("candidate_pairs"),
    )


def cross_validated_three_zone(df: DataFrame, folds: int, *, fold: str = "fold", target: str = "target", score: str = "score") -> DataFrame:
    """One row a fold: thresholds from the other folds and metrics on the fold, then pooled metrics as fold null."""
    others = df.select(target, score, F.col(fold).alias("_own")).withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("_f <> _own")
    chosen = best_three_zone_thresholds(others, target=target, score=score, by=["_f"]).select(F.col("_f").alias(fold), "low_threshold", "high_threshold")
    held = df.join(F.broadcast(chosen), fold)  # a row a fold
    predicted = three_class_decision(F.col(score), F.col("low_threshold"), F.col("high_threshold"))
    per = three_class_metrics(held, predicted, target, [fold]).join(chosen, fold)
    pooled = three_class_metrics(held, predicted, target).withColumns({fold: F.lit(None).cast("int"), "low_threshold": F.lit(None).cast("double"), "high_threshold": F.lit(None).cast("double")})
    return per.unionByName(pooled)


# ---- ensembles


def normalization(long: DataFrame, member: str = "member", value: str = "logit") -> DataFrame:
    """``member, mean, deviation`` (population)."""
    return long.groupBy(member).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def standardized_average(long: DataFrame, norms: DataFrame, sets: DataFrame, *, key: str = "record_id", target: str = "target", member: str = "member", value: str = "logit") -> DataFrame:
    """``set_name, key, target, score``: the mean of members' z-scores, for every candidate set of ``set_name, member``."""
    scaled = long.join(F.broadcast(norms), member)  # a row a member
    z = (F.col(value) - F.col("mean")) / F.col("deviation")
    return scaled.withColumn("_z", z).join(F.broadcast(sets), member).groupBy("set_name", key, target).agg(F.avg("_z").alias("score"))


def select_ensemble(scored: DataFrame, sets: DataFrame, target: str = "target") -> DataFrame:
    """Candidate sets with their metrics and ``place``: by PR-AUC, ROC-AUC, few members, name (descending)."""
    from pyspark.sql import Window as W

    metrics = ranking_metrics(score_table(scored.withColumn("_p", sigmoid(F.col("score"))), target, "_p", ["set_name"]), ["set_name"])
    sized = metrics.join(sets.groupBy("set_name").agg(F.count("*").alias("model_count")), "set_name")
    order = W.orderBy(F.desc("pr_auc"), F.desc("roc_auc"), F.asc("model_count"), F.desc("set_name"))  # a row a candidate set
    return sized.withColumn("place", F.row_number().over(order))


def weight_grid(df: DataFrame, first: str, second: str, steps: int, target: str = "target") -> DataFrame:
    """``weight, pr_auc, roc_auc, place`` of blends of two logits over an even grid; ties go to the larger weight of ``first``."""
    from pyspark.sql import Window as W

    if steps < 1:
        raise ValueError("the step must divide one")
    blended = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("weight", F.col("_i") / float(steps))
    blended = blended.withColumn("_p", sigmoid(F.col("weight") * F.col(first) + (1.0 - F.col("weight")) * F.col(second)))
    metrics = ranking_metrics(score_table(blended, target, "_p", ["weight"]), ["weight"])
    return metrics.withColumn("place", F.row_number().over(W.orderBy(F.desc("pr_auc"), F.desc("roc_auc"), F.desc("weight"))))


# ---- summaries


def error_summary(df: DataFrame, left: str, right: str, tolerance: float) -> DataFrame:
    """``n, max_absolute_error, mean_absolute_error, passed``."""
    error = F.abs(F.col(left) - F.col(right))
    return df.agg(F.count("*").alias("n"), F.max(error).alias("max_absolute_error"), F.avg(error).alias("mean_absolute_error"), (F.max(error) <= tolerance).alias("passed"))


def class_weight_ratio(df: DataFrame, mode: str, target: str = "target") -> DataFrame:
    """``positive_weight``: 1, the negatives for each positive, or the root of that."""
    ratio = F.sum((F.col(target) == 0).cast("int")) / F.sum((F.col(target) == 1).cast("int"))
    value = {"none": F.lit(1.0), "sqrt": F.sqrt(ratio), "balanced": ratio}
    if mode not in value:
        raise ValueError(f"no such weighting: {mode!r}")
    return df.agg(value[mode].cast("double").alias("positive_weight"))


def class_breakdown(df: DataFrame, cls: str, score: str, low: float, high: float) -> DataFrame:
    return df.groupBy(cls).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.sum((F.col(score) >= low).cast("int")).cast("long").alias("at_least_low"), F.sum((F.col(score) >= high).cast("int")).cast("long").alias("at_least_high"))


def level_counts(df: DataFrame, level: str, vocabulary: Sequence[str]) -> DataFrame:
    """Counts of every level of the vocabulary, absent ones as 0."""
    words = df.sparkSession.createDataFrame([(v,) for v in vocabulary], f"`{level}` string")
    return words.join(df.groupBy(level).count(), level, "left").select(level, F.coalesce("count", F.lit(0)).alias("n"))


def across_sources(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """``metric, macro_mean, worst, best, gap`` over one row a source."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names))
    long = metrics.select(F.inline(pairs))
    return long.groupBy("metric").agg(F.avg("value").alias("macro_mean"), F.min("value").alias("worst"), F.max("value").alias("best"), (F.max("value") - F.min("value")).alias("gap"))


def throughput(df: DataFrame, seconds: str, images: int) -> DataFrame:
    mean = F.avg(seconds)
    return df.agg(mean.alias("mean_seconds"), F.min(seconds).alias("min_seconds"), F.max(seconds).alias("max_seconds"), (F.lit(float(images)) / mean).alias("images_per_second"))


def metric_delta(base: DataFrame, other: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """One row: other less base for each metric of two one-row tables."""
    b = base.select(*(F.col(c).alias(f"_b_{c}") for c in names))
    o = other.select(*(F.col(c).alias(f"_o_{c}") for c in names))
    return b.crossJoin(F.broadcast(o)).select(*((F.col(f"_o_{c}") - F.col(f"_b_{c}")).alias(alias) for c, alias in names.items()))

"""Row-level decision policies and the gates over their metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.numeric import calibrated
from curatrix.operators.classify import chain
from curatrix.operators.metrics import confusion, rates

#: Fixed value: the six views in order and the three named policies over them.
VIEWS = ("original", "horizontal_flip", "vertical_flip", "rotation_180", "center_crop_90", "center_crop_80")
POLICIES = {"orientation4_consensus": (0, 1, 2, 3), "center_scale3_consensus": (0, 4, 5), "combined6_consensus": (0, 1, 2, 3, 4, 5)}


def _ordered(low: float, high: float) -> None:
    if not 0 <= low < high <= 1:
        raise ValueError("thresholds must be ordered in [0, 1]")


def level(score: Column, low: float, high: float, middle: str = "inconclusive") -> Column:
    _ordered(low, high)
    return F.when(score < low, F.lit("low")).when(score >= high, F.lit("high")).otherwise(F.lit(middle))


def worker_decision(score: Column, low: float, high: float, margin: float) -> dict[str, Column]:
    """``attention_level, abstained, abstention_reason``: between the thresholds, or too near one half, nothing is said."""
    _ordered(low, high)
    gap, near = (score >= low) & (score < high), F.abs(score - 0.5) < margin
    return {
        "attention_level": F.when(gap | near, F.lit("uncertain")).when(score < low, F.lit("low")).otherwise(F.lit("high")),
        "abstained": gap | near,
        "abstention_reason": F.when(gap, F.lit("threshold_gap")).when(near, F.lit("configured_margin")),
    }


def chosen_views(views: Column, policy: str) -> Column:
    if policy not in POLICIES:
        raise ValueError(f"no such policy: {policy!r}")
    return F.array(*(F.element_at(views, i + 1) for i in POLICIES[policy]))


def consensus(views: Column, low: float, high: float, middle: str = "inconclusive") -> dict[str, Column]:
    """``level, minimum, maximum`` of an array of scores: low if all are below low, high if none is below high."""
    _ordered(low, high)
    least, most = F.array_min(views), F.array_max(views)
    return {"level": F.when(most < low, F.lit("low")).when(least >= high, F.lit("high")).otherwise(F.lit(middle)), "minimum": least, "maximum": most}


def dual_policy(first: Column, second: Column, *, first_low: float, first_high: float, second_low: float, second_high: float, confirmation: float) -> Column:
    """Two consensus levels; a high one needs the second model's minimum at the confirmation threshold."""
    if not second_high <= confirmation <= 1:
        raise ValueError("the confirmation threshold lies between the second high threshold and 1")
    a, b = consensus(first, first_low, first_high, "uncertain"), consensus(second, second_low, second_high, "uncertain")
    confirmed = (a["level"] == "high") & (b["level"] == "high") & (b["minimum"] >= confirmation)
    return F.when(confirmed, F.lit("high_confirmed")).when((a["level"] == "low") & (b["level"] == "low"), F.lit("no_elevated_signal")).otherwise(F.lit("review"))


def high_confirmation_metrics(df: DataFrame, level_column: str, target: str = "target") -> DataFrame:
    cells = confusion(df, target, F.col(level_column) == "high_confirmed")
    all_ = rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return cells.withColumns({k: all_[k] for k in ("sensitivity", "specificity", "precision")})


def policy_delta(df: DataFrame, base: Column, other: Column, target: str = "target") -> DataFrame:
    """One row: true and false positives of two decisions, their differences and the share of false positives that go."""
    a, b = confusion(df.withColumn("_d", base), target, F.col("_d")), confusion(df.withColumn("_d", other), target, F.col("_d"))
    joined = a.toDF(*(f"base_{c}" for c in a.columns)).crossJoin(F.broadcast(b.toDF(*(f"policy_{c}" for c in b.columns))))
    return joined.withColumns(
        {
            "false_positive_delta": F.col("policy_fp") - F.col("base_fp"),
            "true_positive_delta": F.col("policy_tp") - F.col("base_tp"),
            "false_positive_reduction": F.when(F.col("base_fp") > 0, (F.col("base_fp") - F.col("policy_fp")) / F.col("base_fp")).otherwise(0.0),
        }
    )


def research_gate(evaluations: DataFrame, *, minimum_datasets: int, minimum_held_out: int, worst: Mapping[str, float], gaps: Mapping[str, float]) -> DataFrame:
    """Blockers ``criterion, required, observed`` over one row a dataset (with ``evaluation_protocol`` and metric columns)."""
    held = F.sum((F.col("evaluation_protocol") == "leave_one_source_out").cast("int")).cast("double")
    rows = [("minimum_datasets", minimum_datasets, F.count("*").cast("double"), True), ("minimum_leave_one_source_out_datasets", minimum_held_out, held, True)]
    rows += [(f"minimum_worst_source.{m}", v, F.min(m), True) for m, v in worst.items()]
    rows += [(f"maximum_source_gap.{m}", v, F.max(m) - F.min(m), False) for m, v in gaps.items()]
    seen = evaluations.agg(*(o.cast("double").alias(f"o{i}") for i, (_, _, o, _) in enumerate(rows)))
    table = F.array(*(F.struct(F.lit(c).alias("criterion"), F.lit(float(r)).alias("required"), F.col(f"o{i}").alias("observed"), F.lit(least).alias("least")) for i, (c, r, _, least) in enumerate(rows)))
    return seen.select(F.inline(table)).where(F.when(F.col("least"), F.col("observed") < F.col("required")).otherwise(F.col("observed") > F.col("required"))).drop("least")


def gate_status(blockers: DataFrame) -> DataFrame:
    names = F.array_sort(F.collect_list("criterion"))
    return blockers.agg(F.when(F.count("*") == 0, F.lit("pass")).otherwise(F.lit("fail")).alias("status"), F.count("*").alias("n_blockers"), F.array_join(names, ",").alias("criteria"))


def dataset_eligibility(protocol: Column, source_in_training: Column, training_authorized: Column) -> Column:
    """Null for a dataset that may be evaluated, else why not."""
    return chain(
        [
            (~protocol.isin("leave_one_source_out", "within_source_test"), F.lit("unsupported_protocol")),
            (F.coalesce(training_authorized, F.lit(True)), F.lit("training_not_forbidden")),
            ((protocol == "leave_one_source_out") & source_in_training, F.lit("held_out_source_in_training")),
            ((protocol == "within_source_test") & ~source_in_training, F.lit("source_not_in_training")),
        ]
    ).cast("string")


#: A request's most bytes and its schema; a field of another type reads as null.
MAX_REQUEST_BYTES = 1 << 20
REQUEST = "ipc_version int, request_id string, operation string, expected_model string, input struct<quality_status:string, microscope_source_confirmed:boolean, acquisition_protocol_status:string, observation_id:bigint, raw_output:double>"


def request_error(payload: Column, request: Column, version: int, model: str) -> Column:
    """The first error code of a request (parsed as ``REQUEST``), or null."""
    invalid = F.lit("INVALID_REQUEST")
    own = request["input"]
    status = request["operation"] == "status"
    return chain(
        [
            (F.octet_length(payload) > MAX_REQUEST_BYTES, F.lit("REQUEST_TOO_LARGE")),
            (request.isNull(), invalid),
            (~F.coalesce(request["ipc_version"] == version, F.lit(False)), invalid),
            (~F.coalesce(request["request_id"].rlike("^[0-9a-f]{32}$"), F.lit(False)), invalid),
            (request["operation"].isNull() | ~request["operation"].isin("status", "predict"), invalid),
            (~status & ~F.coalesce(request["expected_model"] == model, F.lit(False)), F.lit("MODEL_IDENTITY_MISMATCH")),
            (~status & (own.isNull() | own["quality_status"].isNull() | own["microscope_source_confirmed"].isNull() | own["acquisition_protocol_status"].isNull()), invalid),
            (~status & ~F.coalesce(own["observation_id"] > 0, F.lit(False)), invalid),
            (~status & ~((own["quality_status"] == "accepted") & own["microscope_source_confirmed"]), F.lit("INELIGIBLE_OBSERVATION")),
        ]
    ).cast("string")


def respond(requests: DataFrame, payload: str, *, version: int, model: str, calibration: Mapping[str, object], low: float, high: float, margin: float) -> DataFrame:
    """Stateless scoring of JSON requests: error code, or score and decision. Works on static tables and on streams alike."""
    parsed = requests.withColumn("_r", F.from_json(F.col(payload), REQUEST))
    parsed = parsed.withColumn("error_code", request_error(F.col(payload), F.col("_r"), version, model))
    score = F.when(F.col("error_code").isNull() & (F.col("_r.operation") == "predict"), calibrated(F.col("_r.input.raw_output"), calibration))
    scored = parsed.withColumns({"request_id": F.col("_r.request_id"), "ok": F.col("error_code").isNull(), "score": score})
    decision = worker_decision(F.col("score"), low, high, margin)
    return scored.withColumns({k: F.when(F.col("score").isNotNull(), v) for k, v in decision.items()}).drop("_r")


def ranked_candidates(candidates: DataFrame, keys: Sequence[tuple[str, bool]], name: str = "candidate") -> DataFrame:
    """Candidates with ``place`` by the keys in order (column, whether higher is better), then by name. A row a candidate."""
    from pyspark.sql import Window as W

    order = [F.desc(c) if higher else F.asc(c) for c, higher in keys]
    return candidates.withColumn("place", F.row_number().over(W.orderBy(*order, F.asc(name))))


def best_by(df: DataFrame, group: Sequence[str], keys: Sequence[tuple[str, bool]], value: Sequence[str]) -> DataFrame:
    """The value columns of each group's lexicographically best row: one grouped maximum of a struct of (negated) numbers."""
    key = F.struct(*((F.col(c) if higher else -F.col(c)).alias(f"k{i}") for i, (c, higher) in enumerate(keys)))
    return df.groupBy(*group).agg(F.max_by(F.struct(*value), key).alias("_b")).select(*group, "_b.*")

"""Column helpers for scores: squashing, calibration, scaling, neighbours and rounding."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clipped(x, -50, 50)))


def logit(p: Column, margin: float = 1e-8) -> Column:
    q = clipped(p, margin, 1 - margin)
    return F.log(q / (1.0 - q))


#: Calibration methods: (parameter, must be positive) in order, and the calibrated logit of a raw score.
CALIBRATIONS = {
    "temperature_scaling": ((("temperature", True),), lambda raw, t: raw / t),
    "affine_logistic_scaling": ((("logit_scale", True), ("logit_bias", False)), lambda raw, scale, bias: raw * scale + bias),
}


def calibrated(raw: Column, calibration: Mapping[str, object]) -> Column:
    """Probability of a raw score under one of ``CALIBRATIONS``; parameters must be finite numbers."""
    parameters, logit_of = CALIBRATIONS.get(calibration.get("method"), (None, None))
    if parameters is None:
        raise ValueError(f"method must be one of {sorted(CALIBRATIONS)}")
    values = {name: float(calibration[name]) for name, _ in parameters}
    if wrong := [name for name, positive in parameters if not math.isfinite(values[name]) or positive and values[name] <= 0]:
        raise ValueError(f"{', '.join(wrong)}: not in range")
    return sigmoid(logit_of(raw, *values.values()))


def affine(x: Column, scale: float, bias: float) -> Column:
    return x * float(scale) + float(bias)


def inverse_affine(x: Column, scale: float, bias: float) -> Column:
    if scale <= 0:
        raise ValueError("scale must be positive")
    return (x - float(bias)) / float(scale)


def z_score(x: Column, mean: Column, deviation: Column) -> Column:
    return (x - mean) / deviation


def quadratic_features(columns: list[Column]) -> list[Column]:
    """The columns, then the products of each with itself and with those after it."""
    return [*columns, *(a * b for i, a in enumerate(columns) for b in columns[i:])]


def next_up(x: Column) -> Column:
    """The next larger double, bit for bit."""
    return F.java_method(F.lit("java.lang.Math"), F.lit("nextUp"), x.cast("double")).cast("double")


def round_half_even(x: Column) -> Column:
    return F.bround(x).cast("long")


def round_half_away(x: Column) -> Column:
    return F.round(x).cast("long")


def is_probability(x: Column) -> Column:
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1), F.lit(False))


def is_finite(x: Column) -> Column:
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def binary_cross_entropy(z: Column, target: Column) -> Column:
    """Stable cross entropy of a logit against a target in [0, 1]."""
    return F.greatest(z, F.lit(0.0)) - z * target + F.log1p(F.exp(-F.abs(z)))


def distillation_loss(z: Column, target: Column, teacher: Column, *, hard_weight: float, soft_weight: float, temperature: float = 1.0, kind: str = "logit_mse") -> dict[str, Column]:
    """Row losses ``hard``, ``soft`` and their blend ``total``; the weights sum to 1."""
    if abs(hard_weight + soft_weight - 1) > 1e-9 or min(hard_weight, soft_weight) < 0:
        raise ValueError("the weights must be non-negative and sum to 1")
    if not temperature > 0:
        raise ValueError("temperature must be positive")
    hard = binary_cross_entropy(z, target.cast("double"))
    if kind == "logit_mse":
        soft = F.pow(z - teacher, 2)
    elif kind == "temperature_bce":
        soft = binary_cross_entropy(z / temperature, sigmoid(teacher / temperature)) * temperature**2
    else:
        raise ValueError(f"no such soft loss: {kind!r}")
    return {"hard": hard, "soft": soft, "total": hard * hard_weight + soft * soft_weight}

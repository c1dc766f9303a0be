import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import numeric
from curatrix.operators import calibration, metrics, policies

#: Published counts and the rates that follow from them: TP, FP, P, N, sensitivity, specificity, precision.
GOLDENS = [
    (56, 244, 115, 6423, 0.4870, 0.9620, 0.1867),
    (75, 507, 115, 6423, 0.6522, 0.9211, 0.1289),
    (18, 36, 115, 6423, 0.1565, 0.9944, 0.3333),
    (1488, 565, 3754, 1477, 0.3964, 0.6175, 0.7248),
    (3393, 659, 3754, 1477, 0.9038, 0.5538, 0.8374),
    (893, 82, 3754, 1477, 0.2379, 0.9445, 0.9159),
    (16, 64, 117, 6415, 0.13675, 0.99002, 0.2),
]


def test_rates_of_published_counts(spark):
    rows = [(tp, fp, p - tp, n - fp, *rest) for tp, fp, p, n, *rest in GOLDENS]
    df = spark.createDataFrame(rows, "tp long, fp long, fn long, tn long, a double, b double, c double")
    got = metrics.rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    off = df.select(*(F.max(F.abs(got[n] - F.col(c))) for n, c in (("sensitivity", "a"), ("specificity", "b"), ("precision", "c")))).first()
    assert max(off) < 6e-5


def scores(spark, n=400, seed=1, levels=40):
    r = random.Random(seed)
    rows = [(i, f"g{i % 57}", y, round(min(0.999, max(0.001, r.random() * 0.7 + 0.25 * y)) * levels) / levels) for i in range(n) for y in [int(r.random() < 0.3)]]
    return rows, spark.createDataFrame(rows, "record_id long, group_id string, target int, p double")


def brute_auc_ap(y, p):
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    ap, before = 0.0, 0.0
    for t in np.unique(p)[::-1]:
        hit = p >= t
        recall = (hit & (y == 1)).sum() / (y == 1).sum()
        ap += (recall - before) * (hit & (y == 1)).sum() / hit.sum()
        before = recall
    return auc, ap


def test_binary_metrics_equal_brute_force(spark):
    rows, df = scores(spark)
    y, p = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    got = metrics.binary_metrics(df, threshold=0.4).first()
    auc, ap = brute_auc_ap(y, p)
    assert got["roc_auc"] == pytest.approx(auc) and got["pr_auc"] == pytest.approx(ap)
    assert got["brier_score"] == pytest.approx(((p - y) ** 2).mean())
    bins = np.minimum((p * 10).astype(int), 9)
    ece = sum(abs(p[bins == b].mean() - y[bins == b].mean()) * (bins == b).mean() for b in range(10) if (bins == b).any())
    assert got["expected_calibration_error"] == pytest.approx(ece)
    assert got["tp"] == ((p >= 0.4) & (y == 1)).sum() and got["n"] == len(y)
    halves = metrics.binary_metrics(df.withColumn("half", F.col("record_id") % 2), threshold=0.4, by=["half"]).collect()
    for row in halves:
        part = np.array([r[0] % 2 for r in rows]) == row["half"]
        assert row["roc_auc"] == pytest.approx(brute_auc_ap(y[part], p[part])[0])


def test_thresholds_equal_brute_force(spark):
    rows, df = scores(spark, 200, 5)
    y, p = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    for s in (0.5, 0.9, 1.0):
        best = max(t for t in np.unique(p) if (p[y == 1] >= t).mean() >= s)
        assert metrics.threshold_for_sensitivity(df, s).first()["threshold"] == best
        candidates = np.unique(np.concatenate([p, np.nextafter(p, np.inf)]))
        low = min(t for t in candidates if (p[y == 0] < t).mean() >= s)
        assert metrics.threshold_for_specificity(df, s).first()["threshold"] == low


def test_one_class_gives_null_ranks(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.6)], "target int, p double")
    assert metrics.binary_metrics(df).first()["roc_auc"] is None


def test_three_zone_search(spark):
    rows = list(zip([0, 0, 0, 1, 1, 1, 2, 2, 2], [0.01, 0.02, 0.03, 0.4, 0.5, 0.6, 0.9, 0.95, 0.99]))
    df = spark.createDataFrame(rows, "target int, score double")
    best = metrics.best_three_zone_thresholds(df).first()
    assert best["worst_class_recall"] == 1.0 and best["low_threshold"] == pytest.approx(0.215) and best["high_threshold"] == pytest.approx(0.75)
    decided = metrics.three_class_decision(F.col("score"), F.lit(best["low_threshold"]), F.lit(best["high_threshold"]))
    assert metrics.three_class_metrics(df, decided).first()["accuracy"] == 1.0


def test_z_scores_and_ensembles(spark):
    rows = [(i, 0, m, v) for m, values in (("a", [-2.0, 0.0, 2.0]), ("b", [-20.0, 0.0, 20.0])) for i, v in enumerate(values)]
    long = spark.createDataFrame(rows, "record_id int, target int, member string, logit double")
    norms = spark.createDataFrame([("a", 0.0, 2.0), ("b", 0.0, 20.0)], "member string, mean double, deviation double")
    sets = spark.createDataFrame([("both", "a"), ("both", "b")], "set_name string, member string")
    got = metrics.standardized_average(long, norms, sets).orderBy("record_id").collect()
    assert [r["score"] for r in got] == [-1.0, 0.0, 1.0]


def test_weight_grid_prefers_the_informative_logit(spark):
    df = spark.createDataFrame([(0, -2.0, 1.0), (0, -1.0, -1.0), (1, 1.0, 1.0), (1, 2.0, -1.0)], "target int, a double, b double")
    best = metrics.weight_grid(df, "a", "b", 2).where("place = 1").first()
    assert best["weight"] == 1.0 and best["roc_auc"] == 1.0


def test_class_weights_and_parity(spark):
    df = spark.createDataFrame([(0,)] * 99 + [(1,)], "target int")
    assert [round(metrics.class_weight_ratio(df, m).first()[0], 6) for m in ("none", "sqrt", "balanced")] == [1.0, round(math.sqrt(99), 6), 99.0]
    pair = spark.createDataFrame([(0.0, 0.0), (1.0, 1.00001)], "a double, b double")
    row = metrics.error_summary(pair, "a", "b", 1e-4).first()
    assert row["passed"] and row["max_absolute_error"] == pytest.approx(1e-5)


def test_distillation_and_inverse(spark):
    df = spark.createDataFrame([(-0.5, -1.0, 0), (0.5, 1.0, 1)], "z double, t double, y int")
    loss = numeric.distillation_loss(F.col("z"), F.col("y"), F.col("t"), hard_weight=0.5, soft_weight=0.5)
    assert df.agg(F.avg(loss["soft"])).first()[0] == 0.25
    x = spark.createDataFrame([(-2.0,), (0.0,), (3.0,)], "x double")
    back = numeric.inverse_affine(numeric.affine(F.col("x"), 1.75, -2.5), 1.75, -2.5)
    assert [r[0] for r in x.select(back).collect()] == [-2.0, 0.0, 3.0]
    assert x.select(numeric.next_up(F.col("x"))).first()[0] == np.nextafter(-2.0, np.inf)


def test_consensus_and_dual_policy(spark):
    rows = [([0.9, 0.8, 0.7, 0.6, 0.9, 0.9],), ([0.9, 0.8, 0.1, 0.6, 0.9, 0.9],), ([0.1] * 6,)]
    df = spark.createDataFrame(rows, "v array<double>")
    got = policies.consensus(policies.chosen_views(F.col("v"), "orientation4_consensus"), 0.2, 0.5)
    assert [tuple(r) for r in df.select(got["level"], got["minimum"], got["maximum"]).collect()] == [("high", 0.6, 0.9), ("inconclusive", 0.1, 0.9), ("low", 0.1, 0.1)]
    first = [[0.9, 0.85, 0.8], [0.9, 0.85, 0.8], [0.05, 0.04, 0.03], [0.05, 0.9, 0.5]]
    second = [[0.9, 0.85, 0.8], [0.9, 0.85, 0.75], [0.05, 0.04, 0.03], [0.9, 0.9, 0.9]]
    both = spark.createDataFrame(list(zip(range(4), first, second, [1, 1, 0, 0])), "i int, a array<double>, b array<double>, target int")
    level = policies.dual_policy(F.col("a"), F.col("b"), first_low=0.1, first_high=0.8, second_low=0.1, second_high=0.7, confirmation=0.8)
    assert [r[0] for r in both.orderBy("i").select(level).collect()] == ["high_confirmed", "review", "no_elevated_signal", "review"]
    levels = spark.createDataFrame([(1, "high_confirmed"), (1, "review"), (0, "high_confirmed"), (0, "review")], "target int, level string")
    row = policies.high_confirmation_metrics(levels, "level").first()
    assert (row["tp"], row["fp"], row["sensitivity"], row["specificity"]) == (1, 1, 0.5, 0.5)


def test_worker_decision_at_the_thresholds(spark):
    df = spark.createDataFrame([(0.2,), (0.3,), (0.7,), (0.69999,)], "s double")
    got = policies.worker_decision(F.col("s"), 0.3, 0.7, 0.21)
    assert [r[0] for r in df.select(got["attention_level"]).collect()] == ["low", "uncertain", "uncertain", "uncertain"]


def test_gate(spark):
    df = spark.createDataFrame([("leave_one_source_out", 0.7, 0.6), ("within_source_test", 0.9, 0.8)], "evaluation_protocol string, roc_auc double, specificity double")
    blockers = policies.research_gate(df, minimum_datasets=2, minimum_held_out=1, worst={"specificity": 0.75}, gaps={"roc_auc": 0.3})
    assert [r["criterion"] for r in blockers.collect()] == ["minimum_worst_source.specificity"]
    assert policies.gate_status(blockers).first()["status"] == "fail"
    assert policies.gate_status(blockers.where("false")).first()["status"] == "pass"


def test_calibration(spark):
    r = random.Random(7)
    rows = []
    for _ in range(1000):
        z = r.gauss(0, 2)
        rows.append((round(z, 2) + 4.0, int(r.random() < 1 / (1 + math.exp(-z)))))
    df = spark.createDataFrame(rows, "logit double, target int")
    got = calibration.development_calibration(df, sensitivity=0.95, specificity=0.95)
    assert got["low_threshold"] < got["high_threshold"]
    assert got["after"]["log_loss"] <= got["before"]["log_loss"]
    assert got["after"]["expected_calibration_error"] < got["before"]["expected_calibration_error"]
    assert got["logit_scale"] == pytest.approx(1.0, abs=0.2) and got["logit_bias"] == pytest.approx(-4.0, abs=0.8)
    hot = spark.createDataFrame([(3 * (z - 4.0), y) for z, y in rows], "logit double, target int")
    assert calibration.fit_temperature(hot) == pytest.approx(3.0, abs=0.6)
    with pytest.raises(ValueError):
        calibration.fit_temperature(df.where("target = 1"))


def test_bootstrap_equals_numpy(spark):
    rows, df = scores(spark, 120, 9, 20)
    got = {r["metric"]: (r["low"], r["high"]) for r in calibration.bootstrap_intervals(df, threshold=0.5, samples=100, seed=9).collect()}
    groups = sorted({g for _, g, _, _ in rows})
    by = {g: [(y, p) for _, h, y, p in rows if h == g] for g in groups}
    strata = [np.array([g for g in groups if max(y for y, _ in by[g]) == v]) for v in (1, 0)]
    draw, values = np.random.default_rng(9), []
    for _ in range(100):
        chosen = np.concatenate([draw.choice(s, size=len(s), replace=True) for s in strata])
        data = np.array([v for g in chosen for v in by[g]])
        y, p = data[:, 0].astype(int), data[:, 1]
        values.append((*brute_auc_ap(y, p), (p[y == 1] >= 0.5).mean()))
    for i, name in enumerate(("roc_auc", "pr_auc", "sensitivity")):
        column = [v[i] for v in values]
        assert got[name] == pytest.approx((np.quantile(column, 0.025), np.quantile(column, 0.975)))


def test_bootstrap_by_hashes_needs_both_strata(spark, monkeypatch):
    df = scores(spark, 60, 9, 20)[1].where("target = 1")
    monkeypatch.setattr(calibration, "MAX_DRIVER_DRAWS", 0)
    with pytest.raises(ValueError):
        calibration.bootstrap_intervals(df, threshold=0.5, samples=100)


def test_bootstrap_query_takes_the_default_replicates(spark, monkeypatch):
    from curatrix.plans import queries_metrics

    asked = []
    draws = calibration.bootstrap_draws
    monkeypatch.setattr(calibration, "bootstrap_draws", lambda df, samples, *rest: asked.append(samples) or draws(df, samples, *rest))
    assert queries_metrics.bootstrap_intervals(spark, "/root/testdata/sf0.001").count() == 5 and asked == [2000]


def test_stacker_places_settings(spark):
    r = random.Random(4)
    rows = [(i % 2, y, y + r.gauss(0, 1.0), r.gauss(0, 1.0)) for i in range(120) for y in [r.randrange(2)]]
    got = calibration.fit_stacker(spark.createDataFrame(rows, "fold int, target int, a double, b double"), ["a", "b"], strengths=(1.0,), kinds=("linear",)).collect()
    assert len(got) == 1 and got[0]["roc_auc"] > 0.65

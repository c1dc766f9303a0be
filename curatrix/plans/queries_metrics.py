"""Queries about metrics, thresholds, calibration, ensembles and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import numeric
from curatrix.functions.session import checkpointed
from curatrix.operators import calibration, metrics, policies
from curatrix.operators.split import patient_folds
from curatrix.plans.bridge import MEMBERS, halves, members, predictions, table, three, with_views
from curatrix.plans.catalogue import query


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to nine digits: engines add in different orders."""
    return df.select(*(F.round(c, 9).alias(c) if kind == "double" and c not in keep else F.col(c) for c, kind in df.dtypes))


def _ranks(source: str, score: str = "p", by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    comma = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""t AS (SELECT {comma}{score} AS s, count(*) AS n, count(*) FILTER (target = 1) AS pos, count(*) FILTER (target = 0) AS neg FROM {source} GROUP BY ALL),
r AS (SELECT *, sum(n) OVER ({part} ORDER BY s DESC)::DOUBLE AS rn, sum(pos) OVER ({part} ORDER BY s DESC)::DOUBLE AS rp, (sum(pos) OVER ({part}))::DOUBLE AS tp_, (sum(neg) OVER ({part}))::DOUBLE AS tn_ FROM t),
ranks AS (SELECT {comma}sum(neg * (rp - pos / 2.0::DOUBLE)) / (max(tp_) * max(tn_)) AS roc_auc, sum(pos / tp_ * (rp / rn)) AS pr_auc FROM r {group})"""


_CONFUSION = "count(*) FILTER (target = 1 AND p >= 0.5) AS tp, count(*) FILTER (target = 0 AND p >= 0.5) AS fp, count(*) FILTER (target = 1 AND p < 0.5) AS fn, count(*) FILTER (target = 0 AND p < 0.5) AS tn"
_RATES = "tp / greatest(tp + fn, 1) AS sensitivity, tn / greatest(tn + fp, 1) AS specificity, tp / greatest(tp + fp, 1) AS precision, tn / greatest(tn + fn, 1) AS negative_predictive_value"


def _bundle(by: str = "") -> str:
    comma, group, join = (f"{by}, ", f"GROUP BY {by}", f"JOIN ranks USING ({by}) JOIN ece USING ({by})") if by else ("", "", ", ranks, ece")
    return (
        with_views("b_pred")
        + ", "
        + _ranks("b_pred", by=by)
        + f""", c AS (SELECT {comma}{_CONFUSION}, avg(pow(p - target, 2)) AS brier_score, avg(target::DOUBLE) AS prevalence, count(*) AS n, sum(target)::BIGINT AS positive_n,
    avg(CASE WHEN target = 1 THEN -ln(greatest(1e-12, least(1 - 1e-12, p))) ELSE -ln(1 - greatest(1e-12, least(1 - 1e-12, p))) END) AS log_loss FROM b_pred {group}),
  ece AS (SELECT {comma}sum(abs(mp - my) * m) / sum(m) AS expected_calibration_error FROM (SELECT {comma}least(floor(p * 10), 9) AS b, avg(p) AS mp, avg(target::DOUBLE) AS my, count(*) AS m FROM b_pred GROUP BY ALL) {group}),
  x AS (SELECT *, {_RATES} FROM c {join}),
  y AS (SELECT *, 2 * precision * sensitivity / greatest(precision + sensitivity, 2.220446049250313e-16) AS f1_score, (sensitivity + specificity) / 2 AS balanced_accuracy FROM x)
  SELECT {comma}tp, fp, fn, tn, n, positive_n, {', '.join(f'round({c}, 9) AS {c}' for c in ('roc_auc', 'pr_auc', 'brier_score', 'prevalence', 'log_loss', 'expected_calibration_error', 'sensitivity', 'specificity', 'precision', 'negative_predictive_value', 'f1_score', 'balanced_accuracy'))} FROM y"""
    )


@query(_bundle())
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.binary_metrics(predictions(spark, sf_dir)))


@query(_bundle("source_id"))
def binary_metrics_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.binary_metrics(predictions(spark, sf_dir), by=["source_id"]))


@query(f"WITH b AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS target, l_extendedprice / 200000.0::DOUBLE AS p FROM lineitem), {_ranks('b')} SELECT round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc FROM ranks")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking metrics over a fact table with many distinct scores."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("target"), (F.col("l_extendedprice") / 200000.0).alias("p"))
    return rounded(metrics.ranking_metrics(checkpointed(metrics.score_table(li, "target", "p"))))


@query(with_views("b_pred") + ", " + _ranks("b_pred") + " SELECT round(max(s), 9) AS threshold FROM r WHERE rp / tp_ >= 0.9")
def threshold_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.threshold_for_sensitivity(predictions(spark, sf_dir), 0.9))


@query(with_views("b_pred") + """, t AS (SELECT p AS s, count(*) FILTER (target = 0) AS neg FROM b_pred GROUP BY 1), r AS (SELECT s, neg, sum(neg) OVER (ORDER BY s) AS rn, sum(neg) OVER () AS tn FROM t)
  SELECT round(min(c), 9) AS threshold FROM (SELECT s AS c, (rn - neg) / tn AS spec FROM r UNION ALL SELECT nextafter(s, 'infinity'::DOUBLE), rn / tn FROM r) WHERE spec >= 0.8""")
def threshold_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.threshold_for_specificity(predictions(spark, sf_dir), 0.8))


def _three(predicted: str, source: str) -> str:
    cells = ", ".join(f"count(*) FILTER (target = {t} AND d = {p}) AS c{t}{p}" for t in range(3) for p in range(3))
    recall = ", ".join(f"c{t}{t} / (c{t}0 + c{t}1 + c{t}2) AS recall_{t}" for t in range(3))
    precision = ", ".join(f"CASE WHEN c0{p} + c1{p} + c2{p} > 0 THEN c{p}{p} / (c0{p} + c1{p} + c2{p}) ELSE 0 END AS precision_{p}" for p in range(3))
    values = ", ".join(f"round({c}, 9) AS {c}" for c in (*(f"recall_{t}" for t in range(3)), *(f"precision_{t}" for t in range(3)), "accuracy", "macro_recall", "worst_class_recall", "recall_range"))
    return f"""c AS (SELECT count(*) AS records, {cells} FROM (SELECT target, {predicted} AS d FROM {source})), m AS (SELECT *, {recall}, {precision} FROM c),
  z AS (SELECT *, (c00 + c11 + c22) / records AS accuracy, (recall_0 + recall_1 + recall_2) / 3 AS macro_recall, least(recall_0, recall_1, recall_2) AS worst_class_recall, greatest(recall_0, recall_1, recall_2) - least(recall_0, recall_1, recall_2) AS recall_range FROM m)
  SELECT records, {', '.join(f'c{t}{p}' for t in range(3) for p in range(3))}, {values} FROM z"""


@query(with_views("b_three") + ", " + _three("CASE WHEN score < 0.33 THEN 0 WHEN score < 0.67 THEN 1 ELSE 2 END", "b_three"))
def three_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = metrics.three_class_decision(F.col("score"), F.lit(0.33), F.lit(0.67))
    return rounded(metrics.three_class_metrics(three(spark, sf_dir), decision))


def _search(by: str = "", source: str = "b_three") -> str:
    comma, part, on = (f"{by}, ", f"PARTITION BY {by}", f"l.{by} = h.{by} AND ") if by else ("", "", "")
    chosen = f"l.{by} AS {by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""t AS (SELECT {comma}score, count(*) AS n, count(*) FILTER (target = 0) AS c0, count(*) FILTER (target = 1) AS c1, count(*) FILTER (target = 2) AS c2 FROM {source} GROUP BY ALL),
  r AS (SELECT {comma}score, lead(score) OVER ({part} ORDER BY score) AS nx, sum(n) OVER ({part} ORDER BY score) AS n, sum(c0) OVER ({part} ORDER BY score) AS c0, sum(c1) OVER ({part} ORDER BY score) AS c1, sum(c2) OVER ({part} ORDER BY score) AS c2,
    sum(c0) OVER ({part}) AS t0, sum(c1) OVER ({part}) AS t1, sum(c2) OVER ({part}) AS t2 FROM t),
  p AS (SELECT {chosen}(l.score + l.nx) / 2 AS low_threshold, (h.score + h.nx) / 2 AS high_threshold, l.n AS ln, h.n AS hn, l.c0 / l.t0 AS r0, (h.c1 - l.c1) / l.t1 AS r1, (l.t2 - h.c2) / l.t2 AS r2 FROM r l JOIN r h ON {on}l.score < h.score WHERE l.nx IS NOT NULL AND h.nx IS NOT NULL),
  best AS (SELECT * FROM (SELECT *, count(*) OVER ({part}) AS candidate_pairs, row_number() OVER ({part} ORDER BY least(r0, r1, r2) DESC, (r0 + r1 + r2) / 3 DESC, greatest(r0, r1, r2) - least(r0, r1, r2), r0 + r2 DESC, ln, hn) AS k FROM p) WHERE k = 1)"""


@query(with_views("b_three") + ", " + _search() + " SELECT round(low_threshold, 9) AS low_threshold, round(high_threshold, 9) AS high_threshold, round(least(r0, r1, r2), 9) AS worst_class_recall, round((r0 + r1 + r2) / 3, 9) AS macro_recall, candidate_pairs FROM best")
def three_zone_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.best_three_zone_thresholds(three(spark, sf_dir)))


@query(
    with_views("b_three")
    + ", f AS (SELECT *, (('0x' || substr(sha256('9:cv:' || l_orderkey), 1, 16))::UBIGINT % 3)::INTEGER AS fold FROM b_three), o AS (SELECT target, score, g.fold AS g FROM f JOIN (SELECT unnest(range(3))::INTEGER AS fold) g ON f.fold <> g.fold), "
    + _search("g", "o")
    + ", d AS (SELECT fold, target, CASE WHEN score < low_threshold THEN 0 WHEN score < high_threshold THEN 1 ELSE 2 END AS d, low_threshold, high_threshold FROM f JOIN best ON fold = g) SELECT fold, round(max(low_threshold), 9) AS low_threshold, round(max(high_threshold), 9) AS high_threshold, count(*) AS records, count(*) FILTER (target = d) AS correct FROM d GROUP BY fold"
    + " UNION ALL SELECT NULL, NULL, NULL, count(*), count(*) FILTER (target = d) FROM d"
)
def three_zone_cross_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.cross_validated_three_zone(patient_folds(three(spark, sf_dir), "l_orderkey", 9, 3), 3)
    return rounded(got.select("fold", "low_threshold", "high_threshold", "records", (F.col("c00") + F.col("c11") + F.col("c22")).alias("correct")))


_SETS = [("all", f"m{i}") for i in range(MEMBERS)] + [("first_two", "m0"), ("first_two", "m1"), ("last", "m3")]
_SETS_SQL = ", ".join(f"('{a}', '{b}')" for a, b in _SETS)


@query(with_views("b_members") + f""", n AS (SELECT member, avg(logit) AS mean, stddev_pop(logit) AS deviation FROM b_members GROUP BY member), s AS (SELECT * FROM (VALUES {_SETS_SQL}) t(set_name, member))
  SELECT set_name, record_id, round(avg((logit - mean) / deviation), 6) AS score FROM b_members JOIN n USING (member) JOIN s USING (member) GROUP BY set_name, record_id""")
def standardized_ensembles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir)
    sets = spark.createDataFrame(_SETS, "set_name string, member string")
    return metrics.standardized_average(m, metrics.normalization(m), sets).select("set_name", "record_id", F.round("score", 6).alias("score"))


@query(with_views("b_members") + f""", nn AS (SELECT member, avg(logit) AS mean, stddev_pop(logit) AS deviation FROM b_members GROUP BY member), ss AS (SELECT * FROM (VALUES {_SETS_SQL}) t(set_name, member)),
  z AS (SELECT set_name, record_id, target, 1 / (1 + exp(-avg((logit - mean) / deviation))) AS p FROM b_members JOIN nn USING (member) JOIN ss USING (member) GROUP BY ALL), {_ranks('z', by='set_name')}
  SELECT set_name, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, k AS model_count, row_number() OVER (ORDER BY pr_auc DESC, roc_auc DESC, k, set_name DESC)::INTEGER AS place FROM ranks JOIN (SELECT set_name, count(*) AS k FROM ss GROUP BY 1) USING (set_name)""")
def ensemble_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir)
    sets = spark.createDataFrame(_SETS, "set_name string, member string")
    got = metrics.select_ensemble(metrics.standardized_average(m, metrics.normalization(m), sets), sets)
    return got.select("set_name", F.round("pr_auc", 6).alias("pr_auc"), F.round("roc_auc", 6).alias("roc_auc"), "model_count", "place")


@query(with_views("b_halves") + f""", w AS (SELECT i, (label < 3)::INTEGER AS target, 1 / (1 + exp(-greatest(-50, least(50, (i / 10.0::DOUBLE) * a + (1.0::DOUBLE - i / 10.0::DOUBLE) * b)))) AS p FROM b_halves, range(11) r(i)), {_ranks('w', by='i')}
  SELECT round(i / 10.0::DOUBLE, 9) AS weight, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc FROM ranks""")
def weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = halves(spark, sf_dir).withColumn("target", (F.col("label") < 3).cast("int"))
    return metrics.weight_grid(e, "a", "b", 10).select(F.round("weight", 9).alias("weight"), F.round("pr_auc", 6).alias("pr_auc"), F.round("roc_auc", 6).alias("roc_auc"))


@query(with_views("b_pred") + " SELECT source_id, count(*) AS n, round(avg(p), 9) AS mean_score, count(*) FILTER (p >= 0.3) AS at_least_low, count(*) FILTER (p >= 0.7) AS at_least_high FROM b_pred GROUP BY source_id")
def class_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_breakdown(predictions(spark, sf_dir), "source_id", "p", 0.3, 0.7))


@query(with_views("b_pred") + " SELECT level, count(p) AS n FROM (SELECT unnest(['low', 'inconclusive', 'high', 'never']) AS level) LEFT JOIN (SELECT p, CASE WHEN p < 0.3 THEN 'low' WHEN p >= 0.7 THEN 'high' ELSE 'inconclusive' END AS level FROM b_pred) USING (level) GROUP BY level")
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("level", policies.level(F.col("p"), 0.3, 0.7))
    return metrics.level_counts(p, "level", ["low", "inconclusive", "high", "never"])


_SOURCES = f", {_ranks('b_pred', by='source_id')}, c AS (SELECT source_id, {_CONFUSION} FROM b_pred GROUP BY source_id), e AS (SELECT *, {_RATES} FROM c JOIN ranks USING (source_id))"


@query(with_views("b_pred") + _SOURCES + ", l AS (SELECT unnest(['roc_auc', 'pr_auc', 'sensitivity', 'specificity']) AS metric, unnest([roc_auc, pr_auc, sensitivity, specificity]) AS v FROM e) SELECT metric, round(avg(v), 9) AS macro_mean, round(min(v), 9) AS worst, round(max(v), 9) AS best, round(max(v) - min(v), 9) AS gap FROM l GROUP BY metric")
def across_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = metrics.binary_metrics(predictions(spark, sf_dir), by=["source_id"])
    return rounded(metrics.across_sources(by, ["roc_auc", "pr_auc", "sensitivity", "specificity"]))


@query(with_views("b_pred") + _SOURCES + """, o AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (source_id >= 3)::DOUBLE AS h, min(roc_auc) AS a, min(precision) AS q, max(sensitivity) - min(sensitivity) AS g, max(roc_auc) - min(roc_auc) AS ga FROM e)
  SELECT criterion, required, round(observed, 9) AS observed FROM (SELECT 'minimum_datasets' AS criterion, 6.0::DOUBLE AS required, n AS observed, n < 6 AS bad FROM o UNION ALL SELECT 'minimum_leave_one_source_out_datasets', 1, h, h < 1 FROM o UNION ALL SELECT 'minimum_worst_source.roc_auc', 0.7, a, a < 0.7 FROM o
    UNION ALL SELECT 'minimum_worst_source.precision', 0.9, q, q < 0.9 FROM o UNION ALL SELECT 'maximum_source_gap.sensitivity', 0.0001, g, g > 0.0001 FROM o UNION ALL SELECT 'maximum_source_gap.roc_auc', 0.9, ga, ga > 0.9 FROM o) WHERE bad""")
def research_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blockers of a research gate with one dataset a source."""
    by = metrics.binary_metrics(predictions(spark, sf_dir), by=["source_id"])
    by = by.withColumn("evaluation_protocol", F.when(F.col("source_id") >= 3, F.lit("leave_one_source_out")).otherwise(F.lit("within_source_test")))
    return rounded(policies.research_gate(by, minimum_datasets=6, minimum_held_out=1, worst={"roc_auc": 0.7, "precision": 0.9}, gaps={"sensitivity": 0.0001, "roc_auc": 0.9}))


@query(with_views("b_orders") + " SELECT round(sqrt(count(*) FILTER (target = 0) / count(*) FILTER (target = 1)), 9) AS positive_weight FROM b_orders")
def class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_weight_ratio(predictions(spark, sf_dir), "sqrt"))


@query(with_views("b_halves") + " SELECT count(*) AS n, round(max(abs(a - b)), 9) AS max_absolute_error, round(avg(abs(a - b)), 9) AS mean_absolute_error, max(abs(a - b)) <= 1e-4 AS passed FROM b_halves")
def parity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.error_summary(halves(spark, sf_dir), "a", "b", 1e-4))


@query("SELECT round(avg(value), 9) AS mean_seconds, round(min(value), 9) AS min_seconds, round(max(value), 9) AS max_seconds, round(1000.0 / avg(value), 9) AS images_per_second FROM events")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.throughput(table(spark, sf_dir, "events"), "value", 1000))


@query(with_views("b_halves") + """ SELECT vec_id, round(hard, 9) AS hard, round(soft, 9) AS soft, round(0.4::DOUBLE * hard + 0.6::DOUBLE * soft, 9) AS total FROM (SELECT vec_id, greatest(z, 0) - z * y + ln(1 + exp(-abs(z))) AS hard,
  (greatest(z / 2, 0) - z / 2 * q + ln(1 + exp(-abs(z / 2)))) * 4 AS soft FROM (SELECT vec_id, a AS z, (label < 3)::INT AS y, 1 / (1 + exp(-b / 2)) AS q FROM b_halves))""")
def distillation_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = halves(spark, sf_dir).select("vec_id", (F.col("label") < 3).cast("int").alias("y"), F.col("a").alias("z"), F.col("b").alias("t"))
    loss = numeric.distillation_loss(F.col("z"), F.col("y"), F.col("t"), hard_weight=0.4, soft_weight=0.6, temperature=2.0, kind="temperature_bce")
    return rounded(e.select("vec_id", *(v.alias(k) for k, v in loss.items())))


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.round(F.col("p"), 3)
    return predictions(spark, sf_dir).withColumn("logit", 2.5 * numeric.logit(F.greatest(F.lit(0.01), F.least(F.lit(0.99), p))) + 4.0)


_CLIPPED = "ln(greatest(0.01::DOUBLE, least(0.99::DOUBLE, round(p, 3))) / (1 - greatest(0.01::DOUBLE, least(0.99::DOUBLE, round(p, 3)))))"


def _newton(shift: float) -> str:
    """Logits and, by Newton steps on the mean log loss, scale and bias in ``fit``."""
    return f""", x AS (SELECT target AS y, 2.5::DOUBLE * {_CLIPPED} + {shift}::DOUBLE AS z, p FROM b_pred), w AS (SELECT y, z, count(*)::DOUBLE AS n FROM x GROUP BY y, z),
  it(k, a, b) AS (SELECT 0, 1.0::DOUBLE, (SELECT ln(count(*) FILTER (target = 1) / count(*) FILTER (target = 0)) FROM b_pred) - (SELECT quantile_cont(z, 0.5) FROM x) UNION ALL
    SELECT k + 1, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (
      SELECT k, a, b, sum(n * (q - y) * z) AS g1, sum(n * (q - y)) AS g2, sum(n * q * (1 - q) * z * z) AS h11, sum(n * q * (1 - q) * z) AS h12, sum(n * q * (1 - q)) AS h22
      FROM (SELECT k, a, b, n, y, z, 1 / (1 + exp(-(a * z + b))) AS q FROM it, w WHERE k < 40) GROUP BY k, a, b)),
  fit AS (SELECT a AS scale, b AS bias FROM it WHERE k = 40)"""


_LOSS = "avg(-ln(greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, CASE WHEN y = 1 THEN {0} ELSE 1 - {0} END))))"


@query(with_views("b_pred", recursive=True) + _newton(4.0) + f" SELECT round(max(scale), 6) AS scale, round(max(bias), 6) AS bias, round({_LOSS.format('(1 / (1 + exp(-z)))')}, 6) AS loss_before, round({_LOSS.format('(1 / (1 + exp(-(scale * z + bias))))')}, 6) AS loss_after FROM x, fit")
def affine_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale and bias that calibrate shifted logits, with the log loss before and after."""
    z = checkpointed(_logits(spark, sf_dir))
    scale, bias = calibration.fit_affine(z)
    loss = lambda x: F.round(F.avg(metrics.log_loss(numeric.sigmoid(x), F.col("target"))), 6)
    return z.agg(F.round(F.lit(scale), 6).alias("scale"), F.round(F.lit(bias), 6).alias("bias"), loss(F.col("logit")).alias("loss_before"), loss(F.col("logit") * scale + bias).alias("loss_after"))


@query(
    with_views("b_pred", recursive=True)
    + f""", x AS (SELECT target AS y, 2.5::DOUBLE * {_CLIPPED} AS z FROM b_pred), it(k, s) AS (SELECT 0, 1.0::DOUBLE UNION ALL
    SELECT k + 1, s - sum((q - y) * z) / sum(q * (1 - q) * z * z) FROM (SELECT k, s, y, z, 1 / (1 + exp(-s * z)) AS q FROM it, x WHERE k < 40) GROUP BY k, s)
  SELECT round(1 / max(s), 5) AS temperature, round({_LOSS.format('(1 / (1 + exp(-s * z)))')}, 6) AS loss FROM x, (SELECT s FROM it WHERE k = 40)"""
)
def temperature_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = checkpointed(_logits(spark, sf_dir).withColumn("logit", F.col("logit") - 4.0))
    t = calibration.fit_temperature(z)
    return z.agg(F.round(F.lit(t), 5).alias("temperature"), F.round(F.avg(metrics.log_loss(numeric.sigmoid(F.col("logit") / t), F.col("target"))), 6).alias("loss"))


def _gap(p: str) -> str:
    return f"(SELECT sum(abs(mp - my) * m) / sum(m) FROM (SELECT least(floor({p} * 10), 9) AS b, avg({p}) AS mp, avg(y::DOUBLE) AS my, count(*) AS m FROM d GROUP BY 1))"


@query(
    with_views("b_pred", recursive=True)
    + _newton(4.0)
    + f""", d AS (SELECT y, 1 / (1 + exp(-z)) AS raw, 1 / (1 + exp(-(scale * z + bias))) AS q FROM x, fit),
  pos AS (SELECT q, sum(count(*) FILTER (y = 1)) OVER (ORDER BY q DESC) / sum(count(*) FILTER (y = 1)) OVER () AS s FROM d GROUP BY q), neg AS (SELECT q, sum(c) OVER (ORDER BY q) - c AS below, sum(c) OVER (ORDER BY q) AS upto, sum(c) OVER () AS n FROM (SELECT q, count(*) FILTER (y = 0) AS c FROM d GROUP BY q)),
  t AS (SELECT (SELECT max(q) FROM pos WHERE s >= 0.95) AS a, (SELECT min(c) FROM (SELECT q AS c, below / n AS s FROM neg UNION ALL SELECT nextafter(q, 'infinity'::DOUBLE), upto / n FROM neg) WHERE s >= 0.9) AS b)
  SELECT round(scale, 6) AS logit_scale, round(bias, 6) AS logit_bias, round(least(a, b), 6) AS low_threshold, round(greatest(a, b), 6) AS high_threshold, round((SELECT {_LOSS.format('raw')} FROM d), 6) AS before_log_loss, round({_gap('raw')}, 6) AS before_expected_calibration_error,
    round((SELECT {_LOSS.format('q')} FROM d), 6) AS after_log_loss, round({_gap('q')}, 6) AS after_expected_calibration_error FROM fit, t"""
)
def development_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = calibration.development_calibration(checkpointed(_logits(spark, sf_dir)), sensitivity=0.95, specificity=0.9)
    row = {k: float(got[k]) for k in ("logit_scale", "logit_bias", "low_threshold", "high_threshold")} | {f"{w}_{m}": float(got[w][m]) for w in ("before", "after") for m in ("log_loss", "expected_calibration_error")}
    return spark.createDataFrame([tuple(round(v, 6) for v in row.values())], ", ".join(f"{k} double" for k in row))


_BOOTSTRAP = """, x AS (SELECT record_id, group_id::VARCHAR AS g, target, round(p, 3) AS p FROM b_pred),
  g AS (SELECT g, max(target) AS y FROM x GROUP BY g), j AS (SELECT g, y, row_number() OVER (PARTITION BY y ORDER BY g) - 1 AS j, count(*) OVER (PARTITION BY y) AS size FROM g),
  d AS (SELECT y, i, ('0x' || substr(sha256('2026:' || i || ':' || y || ':' || j), 1, 15))::BIGINT % size AS j, count(*) AS times FROM j, range(2000) r(i) GROUP BY ALL),
  slim AS (SELECT g, p, count(*) FILTER (target = 1) AS pos, count(*) FILTER (target = 0) AS neg FROM x GROUP BY g, p),
  t AS (SELECT i, p, sum(pos * times) AS pos, sum(neg * times) AS neg FROM d JOIN j USING (y, j) JOIN slim USING (g) GROUP BY i, p),
  r AS (SELECT *, (sum(pos) OVER w)::DOUBLE AS rp, (sum(pos + neg) OVER w)::DOUBLE AS rn, (sum(pos) OVER (PARTITION BY i))::DOUBLE AS tp, (sum(neg) OVER (PARTITION BY i))::DOUBLE AS tn FROM t WINDOW w AS (PARTITION BY i ORDER BY p DESC)),
  m AS (SELECT i, sum(neg * (rp - pos / 2.0::DOUBLE)) / (max(tp) * max(tn)) AS roc_auc, sum(pos / tp * (rp / rn)) AS pr_auc, coalesce(sum(pos) FILTER (p >= 0.5), 0) / max(tp) AS sensitivity,
    coalesce(sum(neg) FILTER (p < 0.5), 0) / max(tn) AS specificity, coalesce(sum(pos) FILTER (p >= 0.5), 0) / greatest(coalesce(sum(pos + neg) FILTER (p >= 0.5), 0), 1) AS precision FROM r GROUP BY i),
  l AS (SELECT unnest(['roc_auc', 'pr_auc', 'sensitivity', 'specificity', 'precision']) AS metric, unnest([roc_auc, pr_auc, sensitivity, specificity, precision]) AS v FROM m)
  SELECT metric, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM l GROUP BY metric"""


@query(with_views("b_pred") + _BOOTSTRAP)
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of five metrics over 2000 replicates that draw groups by hash."""
    p = predictions(spark, sf_dir).withColumn("p", F.round("p", 3))
    return rounded(calibration.bootstrap_intervals(p, threshold=0.5, draws="hash"))


@query()
def logistic_stacker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a stacker over two logits, by out-of-fold ranking."""
    e = halves(spark, sf_dir).select("vec_id", (F.col("label") < 3).cast("int").alias("target"), F.col("a").alias("m0"), F.col("b").alias("m1"))
    folded = checkpointed(patient_folds(e, "vec_id", 3, 2))
    return rounded(calibration.fit_stacker(folded, ["m0", "m1"], strengths=(0.1, 1.0)))


@query(with_views("b_pred") + _SOURCES + " SELECT source_id, round(pr_auc, 9) AS pr_auc, row_number() OVER (ORDER BY pr_auc DESC, roc_auc DESC, fp, source_id)::INTEGER AS place FROM e")
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by PR-AUC, ROC-AUC and few false positives."""
    by = metrics.binary_metrics(predictions(spark, sf_dir), by=["source_id"])
    ranked = policies.ranked_candidates(by, [("pr_auc", True), ("roc_auc", True), ("fp", False)], "source_id")
    return rounded(ranked.select("source_id", "pr_auc", "place"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest order of each customer, the first one among equals."""
    return policies.best_by(table(spark, sf_dir, "orders"), ["o_custkey"], [("o_totalprice", True), ("o_orderkey", False)], ["o_orderkey", "o_totalprice"])


@query(with_views("b_pred") + _SOURCES + ", p AS (SELECT source_id, avg(target::DOUBLE) AS prevalence FROM b_pred GROUP BY 1) SELECT source_id, round(pr_auc / prevalence, 9) AS pr_auc_lift, round(1 - specificity, 9) AS false_positive_rate, round(1 - sensitivity, 9) AS false_negative_rate FROM e JOIN p USING (source_id)")
def derived_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = metrics.with_derived(metrics.binary_metrics(predictions(spark, sf_dir), by=["source_id"]))
    return rounded(by.select("source_id", "pr_auc_lift", "false_positive_rate", "false_negative_rate"))


@query(with_views("b_pred") + f""", c AS (SELECT {_CONFUSION} FROM b_pred), d AS (SELECT {_CONFUSION.replace('0.5', '0.7')} FROM b_pred), e AS (SELECT {_RATES} FROM c), f AS (SELECT {_RATES} FROM d)
  SELECT round(f.sensitivity - e.sensitivity, 9) AS sensitivity_delta, round(f.specificity - e.specificity, 9) AS specificity_delta FROM e, f""")
def metric_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a higher threshold changes."""
    p = predictions(spark, sf_dir)
    low, high = (metrics.binary_metrics(p, threshold=t).select("sensitivity", "specificity") for t in (0.5, 0.7))
    return rounded(metrics.metric_delta(low, high, {"sensitivity": "sensitivity_delta", "specificity": "specificity_delta"}))

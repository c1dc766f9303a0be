"""Queries about splits, folds and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.session import checkpointed
from curatrix.operators import curation, sample, split
from curatrix.plans.bridge import manifest, orders, predictions, table, with_views
from curatrix.plans.catalogue import query

FOLDS, SEED = 5, 2026

_PLAN = f"""g AS (SELECT group_id, min(source_id) AS source_id, max(target) AS y FROM b_orders GROUP BY group_id),
a AS (SELECT group_id, 'fold_' || ((row_number() OVER (PARTITION BY source_id, y ORDER BY sha256('oof-v1' || chr(0) || '{SEED}' || chr(0) || group_id)) - 1) % {FOLDS}) AS oof_fold FROM g)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.oof_plan(orders(spark, sf_dir), FOLDS, SEED)


@query(with_views("b_orders") + "," + _PLAN + " SELECT record_id, group_id, source_id, target, oof_fold FROM b_orders JOIN a USING (group_id)")
def oof_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("record_id", "group_id", "source_id", "target", "oof_fold")


@query(with_views("b_orders") + f""", s AS (SELECT source_id, y, count(*) AS n FROM (SELECT group_id, min(source_id) AS source_id, max(target) AS y FROM b_orders GROUP BY group_id) GROUP BY ALL), few AS (SELECT count(*) AS n FROM s WHERE n < {FOLDS})
  SELECT "check", n = 0 AS ok, n::BIGINT AS n_bad FROM (SELECT unnest(['target_binary', 'record_id_not_blank', 'group_id_not_blank', 'source_id_not_blank', 'record_unique', 'group_in_one_source']) AS "check", 0 AS n UNION ALL SELECT 'stratum_has_a_group_per_fold', n FROM few)""")
def oof_plan_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.plan_checks(orders(spark, sf_dir), FOLDS).drop("examples")


@query(with_views("b_orders") + "," + _PLAN + """, p AS (SELECT * FROM b_orders JOIN a USING (group_id) WHERE record_id % 10 <> 0)
  SELECT group_id, oof_fold, record_id, source_id, CASE WHEN oof_fold = 'fold_0' THEN 'validation' ELSE 'train' END AS split, target FROM p UNION ALL SELECT group_id, NULL, record_id, source_id, 'test', target FROM b_orders WHERE record_id % 20 = 0""")
def oof_materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fold as validation, the others as train, old validation rows gone, test rows frozen."""
    plan = _plan(spark, sf_dir).where("record_id % 10 <> 0")
    frozen = orders(spark, sf_dir).where("record_id % 10 = 0").withColumn("split", F.when(F.col("record_id") % 20 == 0, F.lit("test")).otherwise(F.lit("validation")))
    return split.materialize_fold(plan, "fold_0", frozen)


@query(with_views("b_orders") + "," + _PLAN + " SELECT oof_fold AS fold, count(*) AS n_held_out, (SELECT count(*) FROM a) - count(*) AS n_train FROM a GROUP BY oof_fold")
def fold_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.fold_complements(_plan(spark, sf_dir))


@query(with_views("b_pred") + "," + _PLAN + " SELECT record_id, oof_fold AS fold_id, round(p, 9) AS p FROM b_pred JOIN a USING (group_id)")
def oof_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of five runs, one for each fold, proven to cover each record once."""
    plan = checkpointed(_plan(spark, sf_dir))
    scores = predictions(spark, sf_dir).select("record_id", "p")
    runs = split.union_columns([plan.where(F.col("oof_fold") == f"fold_{i}").select("record_id", F.col("oof_fold").alias("fold_id")).join(scores, "record_id") for i in range(FOLDS)])
    return curation.collect_oof(plan, runs).select("record_id", "fold_id", F.round("p", 9).alias("p"))


@query(with_views("b_orders") + """, d AS (SELECT *, CASE (('0x' || substr(sha256('5:cv:' || group_id), 1, 16))::UBIGINT % 5) WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM b_orders)
  SELECT split, count(*) AS images, count(DISTINCT group_id) AS groups, count(*) FILTER (target = 0) AS target_0, count(*) FILTER (target = 1) AS target_1 FROM d GROUP BY split""")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = split.patient_folds(orders(spark, sf_dir), "group_id", 5, 5)
    return split.split_summary(o.withColumn("split", split.folds_to_splits(F.col("fold"))))


@query("SELECT * FROM (VALUES ('A', (SELECT count(DISTINCT l_linestatus) FROM lineitem WHERE l_returnflag = 'A')), ('N', (SELECT count(DISTINCT l_linestatus) FROM lineitem WHERE l_returnflag = 'N')), ('Z', 0)) t(split, n_targets)")
def split_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("split"), F.col("l_linestatus").alias("target"))
    return split.split_target_counts(li, ["A", "N", "Z"])


@query(with_views("b_orders") + " SELECT count(DISTINCT group_id) AS groups, 0::BIGINT AS leaking, 5::BIGINT AS folds, count(*) AS records, true AS balanced FROM b_orders")
def group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified group folds: no group in two of them, and target shares near the whole's in each."""
    o = checkpointed(split.stratified_group_folds(orders(spark, sf_dir), FOLDS, SEED))
    leaking = split.leaking_groups(o, "group_id", "fold").agg(F.count("*").alias("leaking"))
    share = F.avg(F.col("target").cast("double"))
    by_fold = o.groupBy("fold").agg(share.alias("s")).crossJoin(F.broadcast(o.agg(share.alias("all")))).agg((F.max(F.abs(F.col("s") - F.col("all"))) < 0.02).alias("balanced"))
    return o.agg(F.count_distinct("group_id").alias("groups"), F.count_distinct("fold").alias("folds"), F.count("*").alias("records")).crossJoin(F.broadcast(leaking)).crossJoin(F.broadcast(by_fold))


@query(with_views("b_pred") + """, e AS (SELECT *, CASE WHEN target = 0 AND p >= 0.5 THEN 'hard_false_positive' WHEN target = 1 AND p < 0.5 THEN 'hard_false_negative' END AS error_type FROM b_pred), h AS (SELECT *, CASE WHEN error_type = 'hard_false_positive' THEN p ELSE 1 - p END AS hardness FROM e WHERE error_type IS NOT NULL)
  SELECT record_id, source_id, error_type, round(hardness, 9) AS hardness, source_error_rank FROM (SELECT *, row_number() OVER (PARTITION BY error_type, source_id ORDER BY hardness DESC, record_id)::INTEGER AS source_error_rank FROM h) WHERE source_error_rank <= 20""")
def hard_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sample.hard_errors(predictions(spark, sf_dir), 0.5, 0.5, 20)
    return got.select("record_id", "source_id", "error_type", F.round("hardness", 9).alias("hardness"), "source_error_rank")


_QUOTAS = {"1-URGENT": 30, "2-HIGH": 20, "5-LOW": 10}


@query(f"""WITH q AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in _QUOTAS.items())}) t(p, quota)), c AS (SELECT o_orderkey, o_custkey, o_orderpriority, quota, sha256('pick-1:' || o_orderkey) AS k FROM orders JOIN q ON p = o_orderpriority WHERE o_custkey % 7 <> 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY k, o_orderkey) - 1 AS repeat_rank FROM c)
  SELECT o_orderkey, o_orderpriority, repeat_rank::INTEGER AS repeat_rank, pick FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY repeat_rank, k, o_orderkey)::INTEGER AS pick FROM r) WHERE pick <= quota""")
def quota_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    excluded = o.where("o_custkey % 7 = 0").select("o_orderkey")
    got = sample.quota_controls(o, _QUOTAS, stratum="o_orderpriority", unit="o_custkey", key="o_orderkey", seed="pick-1", excluded=excluded)
    return got.select("o_orderkey", "o_orderpriority", F.col("repeat_rank").cast("int").alias("repeat_rank"), "pick")


_EPOCH = """, f AS (SELECT *, record_id % 997 = 0 AS forced, sha256('14:' || record_id) AS k FROM b_orders),
  n AS (SELECT {by} min_p, least({ratio} * min_p, min_n) AS max_n, fp, fn FROM (SELECT {by} count(*) FILTER (target = 1 AND forced) AS fp, count(*) FILTER (target = 0 AND forced) AS fn FROM f {group}) x, (SELECT min(p) AS min_p, min(c) AS min_n FROM (SELECT count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS c FROM f {group}) y) z),
  r AS (SELECT f.*, row_number() OVER (PARTITION BY {by} target ORDER BY k, record_id) AS place FROM f WHERE NOT forced)
  SELECT record_id, 1 AS copies FROM r JOIN n ON {join} WHERE place <= CASE WHEN target = 1 THEN min_p - 2 * fp ELSE max_n - 2 * fn END UNION ALL SELECT record_id, 2 FROM f WHERE forced"""


@query(with_views("b_orders") + _EPOCH.format(by="", ratio=2, group="", join="true"))
def balanced_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positives and twice as many negatives, forced records twice within these numbers; seed 7 and epoch 7."""
    o = orders(spark, sf_dir)
    return sample.epoch_sample(o, ratio=2, seed=7, epoch=7, forced=o.where("record_id % 997 = 0"), repeats=2).select("record_id", "copies")


@query(with_views("b_orders") + _EPOCH.format(by="source_id, ", ratio=3, group="GROUP BY source_id", join="n.source_id = r.source_id"))
def source_balanced_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    return sample.epoch_sample(o, ratio=3, seed=7, epoch=7, source="source_id", forced=o.where("record_id % 997 = 0"), repeats=2).select("record_id", "copies")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'soon' ELSE 'late' END AS o_orderpriority FROM orders")
def collapsed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {"soon": ["1-URGENT", "2-HIGH"], "late": ["3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}
    return sample.collapse_sources(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", groups)


@query("SELECT n_nationkey, n_regionkey FROM nation, range(n_regionkey + 1)")
def repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").withColumn("copies", F.col("n_regionkey") + 1)
    return sample.repeat_rows(n)


@query(with_views("b_manifest") + """ SELECT "check", n = 0 AS ok, n::BIGINT AS n_bad FROM (SELECT unnest(['image_name_unique', 'image_path_safe', 'group_not_blank', 'sha256_valid', 'hash_valid', 'groups_per_target']) AS "check", 0 AS n
  UNION ALL SELECT 'target_binary', count(*) FILTER (target IS NULL) FROM b_manifest UNION ALL SELECT 'no_exact_duplicates', count(*) FROM b_manifest WHERE sha256 IN (SELECT sha256 FROM b_manifest GROUP BY sha256 HAVING count(*) > 1))""")
def split_preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.split_preconditions(checkpointed(manifest(spark, sf_dir))).drop("examples")


@query(with_views("b_manifest") + """, k AS (SELECT * FROM b_manifest WHERE source_label IS NOT NULL AND ord % 31 <> 0 AND ord % 41 <> 0), g AS (SELECT sha256, min(image_name) AS f FROM k GROUP BY sha256 HAVING count(DISTINCT source_label) = 1)
  SELECT image_name, CASE source_label WHEN '1' THEN 'good' ELSE 'poor' END AS curated_label FROM k JOIN g USING (sha256) WHERE image_name = f""")
def curated_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of curation: labels, files, reasons, exact duplicates; digests with two labels are left out beforehand."""
    m = checkpointed(manifest(spark, sf_dir, fingerprint=False))
    rows = m.where("source_label is not null and ord % 31 <> 0 and ord % 41 <> 0")
    clear = rows.groupBy("sha256").agg(F.count_distinct("source_label").alias("n")).where("n = 1").select("sha256")
    doubtful = rows.join(clear, "sha256", "left_anti").select("image_name")
    metadata = m.join(doubtful, "image_name", "left_anti").select("image_name", F.lit("all").alias("group_id"), "source_label")
    files = m.where("ord % 41 <> 0").select("image_name", "sha256", (F.col("ord") % 31 != 0).alias("valid"))
    labels = spark.createDataFrame([("1", 1, "good"), ("0", 0, "poor")], "raw_label string, target int, curated_label string")
    kept, _ = curation.curate(metadata, files, labels)
    return kept.select("image_name", "curated_label")


@query("""WITH e AS (SELECT event_id, user_id, event_type FROM events WHERE event_id % 50 = 0), bad AS (SELECT count(*) FILTER (event_id % 100 = 0) AS g, count(*) FILTER (event_id % 350 = 0) AS t, count(*) FILTER (event_id % 550 = 0) AS m FROM e)
  SELECT "check", n = 0 AS ok, n::BIGINT AS n_bad FROM (SELECT unnest(['priority_unique', 'training_unique', 'sha256_matches', 'collection_id_matches', 'target_matches']) AS "check", 0 AS n
    UNION ALL SELECT 'priority_in_training', m FROM bad UNION ALL SELECT 'group_id_matches', (SELECT count(*) FROM e WHERE event_id % 100 = 0 AND event_id % 550 <> 0) FROM bad UNION ALL SELECT 'error_type_matches_target', t FROM bad)""")
def priority_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority records of every fiftieth event: some not in the training split, some of another group, some of the wrong error type."""
    n = F.col("event_id")
    e = table(spark, sf_dir, "events").select(n.alias("image_name"), F.sha2(n.cast("string"), 256).alias("sha256"), F.col("user_id").alias("group_id"), F.col("event_type").alias("collection_id"), (n % 2).cast("int").alias("target"))
    k = F.col("image_name")
    right = F.when(F.col("target") == 0, F.lit("hard_false_positive")).otherwise(F.lit("hard_false_negative"))
    other = F.when(F.col("target") == 1, F.lit("hard_false_positive")).otherwise(F.lit("hard_false_negative"))
    priority = e.where(k % 50 == 0).withColumns({"group_id": F.when(k % 100 == 0, -1).otherwise(F.col("group_id")), "error_type": F.when(k % 350 == 0, other).otherwise(right)})
    return curation.priority_checks(priority, e.where(k % 550 != 0)).drop("examples")


@query("SELECT o_orderkey, o_orderstatus, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey HAVING count(*) = 1)")
def superset_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines aligned with their orders, which are a superset."""
    from curatrix.operators.joins import align

    first = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    single = first.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min("l_quantity").alias("l_quantity")).where("n = 1").drop("n")
    return align(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), single, "o_orderkey", allow_superset=True).select("o_orderkey", "o_orderstatus", "l_quantity")


@query("""WITH g AS (SELECT p_partkey, p_size * 13 + 7 AS w, p_partkey % 97 * 5 + 3 AS h FROM part), s AS (SELECT *, least(224.0::DOUBLE / w, 224.0::DOUBLE / h) AS k FROM g),
  t AS (SELECT p_partkey, greatest(1, least(224, round_even(w * k, 0)))::BIGINT AS target_width, greatest(1, least(224, round_even(h * k, 0)))::BIGINT AS target_height FROM s)
  SELECT *, (224 - target_width) // 2 AS left_, (224 - target_height) // 2 AS top_ FROM t""")
def letterbox_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.functions.images import letterbox_geometry as geometry

    sized = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 13 + 7).alias("w"), (F.col("p_partkey") % 97 * 5 + 3).alias("h"))
    got = geometry(F.col("w"), F.col("h"), 224)
    return sized.select("p_partkey", got["target_width"].alias("target_width"), got["target_height"].alias("target_height"), got["left"].alias("left_"), got["top"].alias("top_"))


@query(with_views("b_manifest") + " SELECT count(*) AS images, count(DISTINCT group_id) AS groups, count(DISTINCT sha256) AS distinct_contents, count(*) FILTER (target = 1) AS positives, count(DISTINCT collection_id) AS collections FROM b_manifest")
def dataset_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a dataset card, as a row."""
    from curatrix.operators.provenance import dataset_card as card

    made = card(manifest(spark, sf_dir, fingerprint=False), {"id": "documents"})
    row = (made["images"], made["groups"], made["distinct_contents"], made["target_counts"].get("1", 0), len(made["collection_counts"]))
    return spark.createDataFrame([row], "images long, groups long, distinct_contents long, positives long, collections long")

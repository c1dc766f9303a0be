import pytest
from pyspark.sql import functions as F

from curatrix.functions import text
from curatrix.operators import curation, sample, sets, split, windows
from curatrix.operators.expectations import ExpectationFailed, enforce


def records(spark, per=2, groups=2):
    rows = [(f"r{s}{t}{g}{i}", f"g{s}{t}{g}", s, t) for s in (0, 1) for t in (0, 1) for g in range(groups) for i in range(per)]
    return spark.createDataFrame(rows, "record_id string, group_id string, source_id int, target int")


def test_oof_plan_keeps_groups_and_strata(spark):
    df = records(spark, groups=6)
    plan = split.oof_plan(df, 3, 11).cache()
    assert split.leaking_groups(plan, "group_id", "oof_fold").count() == 0
    per = plan.groupBy("source_id", "target", "oof_fold").agg(F.count_distinct("group_id").alias("n")).collect()
    assert len(per) == 12 and {r["n"] for r in per} == {2}
    shuffled = split.oof_plan(df.repartition(7).orderBy(F.rand(3)), 3, 11)
    assert {tuple(r) for r in plan.collect()} == {tuple(r) for r in shuffled.collect()}
    with pytest.raises(ExpectationFailed, match="stratum"):
        enforce(split.plan_checks(df, 7))


def test_fold_materialisation_drops_old_validation(spark):
    plan = split.oof_plan(records(spark), 2, 1)
    frozen = spark.createDataFrame([("v", "validation"), ("t", "test")], "record_id string, split string")
    got = split.materialize_fold(plan, "fold_0", frozen).collect()
    assert {r["record_id"] for r in got if r["split"] == "test"} == {"t"} and "v" not in {r["record_id"] for r in got}
    assert {r["split"] for r in got if r["oof_fold"] == "fold_0"} == {"validation"}


def test_oof_collection_fails_closed(spark):
    plan = split.oof_plan(records(spark), 2, 1)
    right = plan.select("record_id", F.col("oof_fold").alias("fold_id"))
    assert curation.collect_oof(plan, right).count() == plan.count()
    with pytest.raises(ExpectationFailed):
        curation.collect_oof(plan, right.limit(3))
    with pytest.raises(ExpectationFailed):
        curation.collect_oof(plan, right.withColumn("fold_id", F.lit("fold_0")))


def test_group_folds_are_balanced_and_repeatable(spark):
    rows = [(f"r{g}-{i}", f"g{g:02d}", int((g + i) % 4 == 0)) for g in range(40) for i in range(1 + g % 5)]
    df = spark.createDataFrame(rows, "record_id string, group_id string, target int")
    a = split.stratified_group_folds(df, 5, 3)
    b = split.stratified_group_folds(df.orderBy(F.rand(1)).repartition(5), 5, 3)
    assert {tuple(r) for r in a.select("record_id", "fold").collect()} == {tuple(r) for r in b.select("record_id", "fold").collect()}
    assert split.leaking_groups(a, "group_id", "fold").count() == 0
    sizes = [r["count"] for r in a.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 6
    assert split.stratified_group_folds(df.where("false"), 5, 3).count() == 0


def test_group_folds_by_blocks_equal_the_greedy_step(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(split, "FOLD_BLOCK", 7)
    rows = [(f"r{g}-{i}", f"g{g:02d}", int((g + i) % 4 == 0)) for g in range(40) for i in range(1 + g % 5)]
    df = spark.createDataFrame(rows, "record_id string, group_id string, target int")
    counts = np.array([[sum(t == y for _, n, t in rows if n == f"g{g:02d}") for y in (0, 1)] for g in range(40)], float)
    want = {f"g{g:02d}": int(f) for g, f in enumerate(split.greedy_group_folds(counts, 5, 3))}
    got = split.stratified_group_folds(df, 5, 3)
    assert {r["group_id"]: r["fold"] for r in got.collect()} == want and got.count() == len(rows)
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()


def test_hash_partition_is_that_of_sha256(spark):
    import hashlib

    names = [f"p{i}" for i in range(50)]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r["p"]: (r["s"], r["f"]) for r in df.select("p", split.hash_partition("p", 7, 0.4).alias("s"), text.hash_fold("p", 7, 5).alias("f")).collect()}
    for n in names:
        unit = int.from_bytes(hashlib.sha256(f"7:{n}".encode()).digest()[:8], "big") / 2**64
        fold = int.from_bytes(hashlib.sha256(f"7:cv:{n}".encode()).digest()[:8], "big") % 5
        assert got[n] == ("calibration" if unit < 0.4 else "test", fold)


def test_id_set_digest_is_canonical(spark):
    import hashlib

    df = spark.createDataFrame([(" b ",), ("a",), ("é",), ("a",)], "v string")
    want = hashlib.sha256("".join(f"{len(v)}:{v}\n" for v in sorted({"a", "b", "é"})).encode()).hexdigest()
    assert df.agg(text.id_set_digest("v")).first()[0] == want


def test_hard_errors(spark):
    df = spark.createDataFrame([(f"r{i}", i % 2, y, p) for i, (y, p) in enumerate([(0, 0.9), (0, 0.95), (0, 0.9), (0, 0.7), (1, 0.1), (1, 0.05), (1, 0.1), (1, 0.9)])], "record_id string, source_id int, target int, p double")
    got = sample.hard_errors(df, 0.2, 0.8, 1).collect()
    assert sorted((r["error_type"], r["source_id"], r["record_id"]) for r in got) == [("hard_false_negative", 0, "r4"), ("hard_false_negative", 1, "r5"), ("hard_false_positive", 0, "r0"), ("hard_false_positive", 1, "r1")]


def test_balanced_epoch(spark):
    df = spark.createDataFrame([(i, int(i in (3, 11))) for i in range(22)], "record_id int, target int")
    forced = df.where("record_id in (2, 7)")
    one = sample.epoch_sample(df, ratio=3, seed=5, epoch=0, forced=forced, repeats=2)
    rows = sample.repeat_rows(one).collect()
    assert len(rows) == 8 and sum(r["target"] for r in rows) == 2
    assert [sum(r["record_id"] == k for r in rows) for k in (2, 7)] == [2, 2]
    again = sample.repeat_rows(sample.epoch_sample(df.repartition(3), ratio=3, seed=5, epoch=0, forced=forced, repeats=2)).collect()
    assert sorted(r["record_id"] for r in rows) == sorted(r["record_id"] for r in again)
    epochs = {tuple(sorted(r["record_id"] for r in sample.epoch_sample(df, ratio=3, seed=5, epoch=e).collect())) for e in range(4)}
    assert len(epochs) > 1
    with pytest.raises(ExpectationFailed):
        sample.epoch_sample(df, ratio=1, seed=5, epoch=0, forced=df.where("target = 0"), repeats=1)


def test_source_balanced_epoch(spark):
    rows = [(s * 100 + i, s, int(i < 2 + s)) for s in range(3) for i in range(12)]
    df = spark.createDataFrame(rows, "record_id int, source_id int, target int")
    got = sample.epoch_sample(df, ratio=2, seed=1, epoch=2, source="source_id").groupBy("source_id", "target").count().collect()
    assert {(r["target"], r["count"]) for r in got} == {(1, 2), (0, 4)} and len(got) == 6


def test_quotas_take_new_units_first(spark):
    df = spark.createDataFrame([(f"i{n}", "nv", f"l{n % 3}") for n in range(9)], "image string, cls string, lesion string")
    got = sample.quota_controls(df, {"nv": 4}, stratum="cls", unit="lesion", key="image", seed="s")
    assert got.select("lesion").distinct().count() == 3 and got.count() == 4
    with pytest.raises(ExpectationFailed):
        sample.quota_controls(df, {"nv": 10}, stratum="cls", unit="lesion", key="image", seed="s")


def test_collapse_sources(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    assert {r["s"] for r in sample.collapse_sources(df, "s", {"g": ["a", "b"]}).collect()} == {"g"}
    with pytest.raises(ExpectationFailed):
        sample.collapse_sources(df, "s", {"g": ["a"]})
    with pytest.raises(ValueError):
        sample.collapse_sources(df, "s", {"g": ["a"], "h": ["a", "b"]})


def test_running_sums_and_row_numbers(spark):
    df = spark.createDataFrame([(float(i % 97) + i / 1e6, i % 3, 1) for i in range(1000)], "x double, g int, n int")
    got = windows.running(df, ["n"], "x", blocks=16).orderBy("x").collect()
    assert [r["run_n"] for r in got] == list(range(1, 1001))
    down = windows.running(df, ["n"], "x", descending=True, partition=["g"], blocks=7).where("g = 1").orderBy(F.desc("x")).collect()
    assert [r["run_n"] for r in down] == list(range(1, len(down) + 1))
    numbered = windows.global_row_number(df, "x", "k").orderBy("x").collect()
    assert [r["k"] for r in numbered] == list(range(1000))
    assert windows.running(df.where("false"), ["n"], "x").count() == 0


def test_spaced_sample(spark):
    df = spark.range(11)
    assert sorted(r["id"] for r in sample.spaced_sample(df, 4, "id").collect()) == [0, 3, 6, 10]


def test_overlap_audit(spark):
    a = spark.createDataFrame([("x", "p1"), ("y", " ")], "image_name string, patient_id string")
    b = spark.createDataFrame([("z", "p1"), ("w", "p2"), ("v", None)], "image_name string, patient_id string")
    row = sets.overlap_audit(a, b, ("patient_id",)).first()
    assert (row["reference"], row["candidate"], row["overlap"], row["unique"]) == (1, 2, 1, 1)

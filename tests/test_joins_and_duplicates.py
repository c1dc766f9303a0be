import random

import pytest
from pyspark.sql import functions as F

from curatrix.operators import dedup, joins
from curatrix.operators.expectations import ExpectationFailed, check, enforce, expect
from curatrix.operators.graph import connected_components


def near(spark, hashes, **options):
    df = spark.createDataFrame([(f"i{n}", h, f"g{n % 3}", n) for n, h in enumerate(hashes)], "image_name string, perceptual_hash string, group_id string, ord long")
    return df, options


def brute(hashes, threshold):
    return {(f"i{a}", f"i{b}", bin(int(x, 16) ^ int(y, 16)).count("1")) for a, x in enumerate(hashes) for b, y in enumerate(hashes) if a < b and bin(int(x, 16) ^ int(y, 16)).count("1") <= threshold}


@pytest.mark.parametrize("digits,threshold,agree", [(16, 6, None), (16, 6, 1), (64, 16, None), (16, 0, None), (16, 15, None)])
def test_hamming_join_equals_brute_force(spark, digits, threshold, agree):
    r = random.Random(digits + threshold)
    hashes = []
    for _ in range(20):
        x = r.getrandbits(4 * digits)
        for _ in range(r.choice([1, 2, 4])):
            y = x
            for _ in range(r.randint(0, threshold + 2)):
                y ^= 1 << r.randrange(4 * digits)
            hashes.append(f"{y:0{digits}x}")
    df = spark.createDataFrame([(f"i{n}", h, n) for n, h in enumerate(hashes)], "image_name string, perceptual_hash string, ord long")
    found = joins.hamming_pairs(df, "perceptual_hash", threshold, digits, agree)
    assert found.count() == found.distinct().count()
    pairs = joins.near_duplicate_pairs(df, threshold, extra=(), digits=digits).repartition(3)
    got = {(p["left_image_name"], p["right_image_name"], p["hamming_distance"]) for p in pairs.collect()}
    assert got == brute(hashes, threshold)


def test_hamming_join_is_never_a_nested_loop(spark):
    df = spark.createDataFrame([("0" * 16,)], "h string")
    plan = joins.hamming_pairs(df, "h", 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_null_hashes_take_no_part(spark):
    df = spark.createDataFrame([("a", None, 0), ("b", None, 1), ("c", "0" * 16, 2)], "image_name string, perceptual_hash string, ord long")
    assert joins.near_duplicate_pairs(df, 6, extra=()).count() == 0


def test_components_equal_union_find(spark):
    r = random.Random(3)
    edges = [(f"n{r.randrange(60):02d}", f"n{r.randrange(60):02d}") for _ in range(40)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {n: find(n) for n in parent}
    want = {n: min(m for m in want if want[m] == want[n]) for n in want}
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    loops = {a for a, b in edges if a == b}
    assert got == {n: v for n, v in want.items() if n in got} and set(want) - set(got) <= loops


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_component_policies(spark):
    """Two components: conflicting labels go, else the best confirmed stays."""
    pairs = spark.createDataFrame([("A", "B"), ("C", "D")], "l string, r string")
    members = dedup.components(pairs, "l", "r")
    assert {(m["node"], m["component_no"]) for m in members.collect()} == {("A", 1), ("B", 1), ("C", 2), ("D", 2)}
    info = spark.createDataFrame([("A", "nevus", 2), ("B", "nevus", 0), ("C", "nevus", 0), ("D", "melanoma", 0)], "node string, label string, confirmation int")
    got = {r["node"]: (r["retained"], r["reason"]) for r in dedup.component_survivors(members.join(info, "node"), "label", [F.col("confirmation")]).collect()}
    assert got["B"] == ("B", None) and got["A"] == ("B", "near_duplicate_component_redundant")
    assert got["C"][1] == got["D"][1] == "near_duplicate_component_conflicting_labels" and got["C"][0] is None
    guarded = dedup.component_survivors(members.join(info, "node"), "label", [F.col("confirmation")], protected=F.col("node") == "A")
    assert {r["node"]: r["reason"] for r in guarded.collect()}["B"] == "near_duplicate_of_protected"


def test_exact_duplicate_exclusions(spark):
    rows = [("0001", "x", "g", "l"), ("0000", "x", "g", "l"), ("0002", "y", "g", "l"), ("0003", None, "g", "l"), ("0004", None, "g", "l"), ("0005", "x", None, "l"), ("0006", "x", None, "l")]
    df = spark.createDataFrame(rows, "image_name string, sha256 string, group_id string, source_label string")
    got = {(r["image_name"], r["reason"]) for r in dedup.exact_duplicate_exclusions(df).collect()}
    assert got == {("0001", "exact_duplicate_of:0000"), ("0006", "exact_duplicate_of:0005")}
    assert dedup.conflicting_duplicates(df.fillna({"group_id": "other"}), ("group_id",)).count() == 1


def test_official_pairs(spark):
    meta = spark.createDataFrame([("0000", "g", "Nevus"), ("0001", "g", " nevus "), ("0002", "h", "nevus")], "image_name string, group_id string, source_label string")
    ok = spark.createDataFrame([("0000", "0001")], "image_name_1 string, image_name_2 string")
    enforce(dedup.official_pair_checks(ok, meta))
    assert dedup.official_pair_exclusions(ok).first()["reason"] == "source_duplicate_of:0000"
    for bad in ([("0000", "0002")], [("0000", "9")], [("0000", "0001"), ("0001", "0000")], [("0000", " ")]):
        with pytest.raises(ExpectationFailed):
            enforce(dedup.official_pair_checks(spark.createDataFrame(bad, "image_name_1 string, image_name_2 string"), meta))


def test_checked_and_reconciling_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k int, v string, w int")
    assert joins.reconcile_join(a, b, ["k"], ["v"]).count() == 2
    with pytest.raises(ValueError):
        joins.reconcile_join(a, b.where("k = 1"), ["k"], ["v"])
    with pytest.raises(ExpectationFailed):
        joins.checked_join(a.union(a), b, ["k"])
    assert joins.checked_join(a.union(a), b, ["k"], cardinality="n:1").count() == 4


def test_expectations(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    row = check(df, "small", F.col("x") < 3, F.col("x").cast("string")).first()
    assert (row["ok"], row["n_bad"]) == (False, 2)
    with pytest.raises(ExpectationFailed, match="small"):
        enforce(check(df, "small", F.col("x") < 3))
    with pytest.raises(Exception, match="expectation failed"):
        expect(df, "not null", F.col("x").isNotNull()).count()
    assert expect(df.na.drop(), "not null", F.col("x").isNotNull()).count() == 2

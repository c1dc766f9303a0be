"""Searches and draws that work at any size, against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import calibration, joins, metrics
from tests.test_metrics_and_policies import brute_auc_ap, scores


def plain_search(rows):
    """All pairs of boundaries."""
    values = sorted({s for _, s in rows})
    total = [sum(t == k for t, _ in rows) for k in range(3)]
    count = lambda k, s: sum(t == k and x <= s for t, x in rows)
    best = None
    for i, a in enumerate(values[:-1]):
        for j in range(i + 1, len(values) - 1):
            b = values[j]
            r = [count(0, a) / total[0], (count(1, b) - count(1, a)) / total[1], (total[2] - count(2, b)) / total[2]]
            key = (min(r), sum(r) / 3, -(max(r) - min(r)), r[0] + r[2], -sum(x <= a for _, x in rows), -sum(x <= b for _, x in rows))
            if best is None or key > best[0]:
                best = key, (a + values[i + 1]) / 2, (b + values[j + 1]) / 2
    return best


@pytest.mark.parametrize("seed, levels", [(1, 10_000), (2, 60), (3, 25)])
def test_search_by_branch_and_bound_equals_all_pairs(spark, monkeypatch, seed, levels):
    monkeypatch.setattr(metrics, "RANGES", 4)
    monkeypatch.setattr(metrics, "PARTS", 3)
    r = random.Random(seed)
    rows = [(t, round(min(1, max(0, r.gauss(0.25 + 0.25 * t, 0.25))) * levels) / levels) for t in (r.randrange(3) for _ in range(90))]
    df = spark.createDataFrame([(t, s, g) for g in (0, 1) for t, s in rows[g * 20 :]], "target int, score double, g int")
    for g, row in ((x["g"], x) for x in metrics.best_three_zone_thresholds(df, by=["g"]).collect()):
        key, low, high = plain_search(rows[g * 20 :])
        assert (row["worst_class_recall"], row["macro_recall"]) == pytest.approx(key[:2]) and (row["low_threshold"], row["high_threshold"]) == pytest.approx((low, high))
        n = len({s for _, s in rows[g * 20 :]}) - 1
        assert row["candidate_pairs"] == n * (n - 1) // 2


def test_bootstrap_by_hash_equals_plain_draws(spark):
    rows, df = scores(spark, 120, 9, 20)
    got = {x["metric"]: (x["low"], x["high"]) for x in calibration.bootstrap_intervals(df, threshold=0.5, samples=100, seed=9, draws="hash").collect()}
    by = {}
    for _, g, y, p in rows:
        by.setdefault(g, []).append((y, p))
    strata = {v: sorted(g for g in by if max(y for y, _ in by[g]) == v) for v in (1, 0)}
    values = []
    for i in range(100):
        data = []
        for y, names in strata.items():
            for j in range(len(names)):
                data += by[names[int(hashlib.sha256(f"9:{i}:{y}:{j}".encode()).hexdigest()[:15], 16) % len(names)]]
        y, p = np.array([a for a, _ in data]), np.array([b for _, b in data])
        values.append((*brute_auc_ap(y, p), (p[y == 1] >= 0.5).mean()))
    for k, name in enumerate(("roc_auc", "pr_auc", "sensitivity")):
        column = [v[k] for v in values]
        assert got[name] == pytest.approx((np.quantile(column, 0.025), np.quantile(column, 0.975)))


@pytest.mark.parametrize("block, drawn, digests", [(1 << 16, 1 << 22, 1 << 16), (7, 11, 4), (3, 5, 100)])
def test_hash_draws_in_small_pieces_count_every_draw(spark, monkeypatch, block, drawn, digests):
    for name, value in (("GROUP_BLOCK", block), ("DRAWN", drawn), ("DIGESTS", digests)):
        monkeypatch.setattr(calibration, name, value)
    r = random.Random(5)
    rows = [(f"g{r.randrange(40):02d}", r.choice([0, 0, 1, None]), r.choice([None, 0.25, 0.5, 0.75])) for _ in range(200)]
    df = spark.createDataFrame(rows, "group_id string, target int, p double")
    drawn = calibration.bootstrap_draws(df, 6, 3, "group_id", "target", "hash")
    # what tasks hand on is packed: a row a replicate, block and portion, not a row a draw
    assert drawn.columns == ["_y", "_block", "replicate", "times"]
    got = {(x["replicate"], x["score"]): (x["n"], x["pos"], x["neg"]) for x in calibration.drawn_scores(df, drawn, "group_id", "target", "p").collect()}
    by = {}
    for g, y, p in rows:
        by.setdefault(g, []).append((y, p))
    want = {}
    for v in (1, 0):
        names = sorted(g for g in by if max((y for y, _ in by[g] if y is not None), default=None) == v)
        for i in range(6):
            for j in range(len(names)):
                for y, p in by[names[int(hashlib.sha256(f"3:{i}:{v}:{j}".encode()).hexdigest()[:15], 16) % len(names)]]:
                    n = want.setdefault((i, p), [0, 0, 0])
                    n[0] += 1
                    n[1] += y == 1
                    n[2] += y == 0
    assert got == {k: tuple(v) for k, v in want.items()}


def test_too_many_draws_for_the_driver_say_so(spark, monkeypatch):
    monkeypatch.setattr(calibration, "MAX_DRIVER_DRAWS", 10)
    with pytest.raises(ValueError, match="hash"):
        calibration.bootstrap_intervals(scores(spark, 60, 9, 20)[1], threshold=0.5, samples=100)


def test_links_count_all_pairs(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(12)]
    rows = []
    for n in range(150):
        h = r.choice(base)
        for _ in range(r.choice([0, 0, 1, 3])):
            h ^= 1 << r.randrange(64)
        rows.append((f"i{n:03d}", f"{h:016x}" if n % 17 else None, r.choice(["a", "b", None])))
    df = spark.createDataFrame(rows, "image_name string, perceptual_hash string, split string")
    got = {tuple(x) for x in joins.near_duplicate_links(df, 4, ("split",)).collect()}
    known = [x for x in rows if x[1]]
    first = {}
    for name, h, _ in known:
        first[h] = min(first.get(h, name), name)
    want = {}
    for i, (_, h, s) in enumerate(known):
        for _, g, t in known[i + 1 :]:
            d = bin(int(h, 16) ^ int(g, 16)).count("1")
            if d <= 4:
                key = (*sorted((first[h], first[g])), d)
                n = want.setdefault(key, [0, 0, 0])
                n[0] += 1
                n[1] += s is not None and s == t
                n[2] += s is not None and t is not None and s != t
    assert got == {(*k, *n) for k, n in want.items()}


def test_a_balanced_accuracy_of_one_class_is_its_recall(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.2), (1, 0.7)], "target int, p double")
    assert metrics.binary_metrics(df).first()["balanced_accuracy"] == 0.75
    assert metrics.binary_metrics(df.withColumn("target", F.lit(0))).first()["balanced_accuracy"] == 0.25

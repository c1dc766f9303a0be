"""Near hashes by blocks: pairs, counts and components against plain versions, with small and dealt groups."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curatrix.functions.session import checkpointed
from curatrix.operators import dedup, hamming, joins
from curatrix.operators.graph import connected_components


def rows_of(seed, digits=16, n=160):
    """Rows near a few centres, with copies, in hashes that share most segments."""
    r = random.Random(seed)
    base = [r.getrandbits(4 * digits) for _ in range(3)]
    rows = []
    for k in range(n):
        h = r.choice(base)
        for _ in range(r.choice([0, 1, 2, 4, 6])):
            h ^= 1 << r.randrange(4 * digits)
        rows.append((f"i{k:03d}", f"{h:0{digits}x}" if k % 19 else None, r.choice(["a", "b", "c", None]), f"g{r.randrange(30)}"))
    return rows


def plain_links(rows, threshold):
    known = [x for x in rows if x[1]]
    first = {}
    for name, h, *_ in known:
        first[h] = min(first.get(h, name), name)
    want = {}
    for (_, h, s, g), (_, k, t, f) in combinations(known, 2):
        d = (int(h, 16) ^ int(k, 16)).bit_count()
        if d <= threshold:
            n = want.setdefault((*sorted((first[h], first[k])), d), [0] * 5)
            both = s is not None and t is not None
            for place, x in enumerate((1, both and s == t, both and s != t, g == f, g != f)):
                n[place] += x
    return {(*k, *n) for k, n in want.items()}


@pytest.mark.parametrize("hot, n, digits, threshold", [(1 << 15, 200, 16, 6), (5, 160, 16, 6), (20, 280, 16, 4), (20, 280, 32, 8), (6, 160, 16, 15)])
def test_links_of_dealt_groups_equal_all_pairs(spark, monkeypatch, hot, n, digits, threshold):
    monkeypatch.setattr(hamming, "HOT_KEY", hot)  # on the driver; tiles of two blocks of 20 are compared as large groups, of 5 as small ones
    rows = rows_of(threshold, digits, n)
    df = spark.createDataFrame(rows, "image_name string, perceptual_hash string, split string, group_id string").repartition(3)
    got = joins.near_duplicate_links(df, threshold, ("split", "group_id"), digits=digits)
    want = plain_links(rows, threshold)
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    sums = joins.near_duplicate_links(df, threshold, ("split", "group_id"), digits=digits, totals=True)
    assert tuple(sums.agg(*(F.sum(c) for c in sums.columns)).first()) == tuple(sum(x[k] for x in want) for k in range(3, 8))
    some = {x[0] for x in rows if x[3] > "g2"}
    ends = spark.createDataFrame([(x,) for x in some], "image_name string")
    assert {tuple(x) for x in joins.near_duplicate_links(df, threshold, digits=digits, ends=ends).collect()} == {x[:4] for x in want if x[0] in some and x[1] in some}


def test_links_are_neither_shuffled_nor_joined(spark):
    df = spark.createDataFrame(rows_of(1), "image_name string, perceptual_hash string, split string, group_id string")
    plan = joins.near_duplicate_links(df, 6, ("split",))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in above and "Join" not in above


def test_a_forest_has_fewer_links_than_roots_and_connects_all():
    r = np.random.RandomState(3)
    h = np.unique(np.uint64(2**40) + r.randint(0, 1 << 12, 300).astype(np.uint64))
    table = pa.table({"lane0": h.view(np.int64)})
    for roots in (np.arange(len(h)), np.arange(len(h)) % 7):
        links = [(int(a), int(b)) for i, j in hamming.forest(table, np.array([0]), 2, roots) for a, b in zip(i, j)]
        assert len(links) < len(set(roots.tolist())) and all(int(h[a] ^ h[b]).bit_count() <= 2 for a, b in links)

        def classes(edges):
            parent = {int(x): int(x) for x in roots}
            find = lambda x: x if parent[x] == x else find(parent[x])
            for a, b in edges:
                parent[find(int(roots[a]))] = find(int(roots[b]))
            return {frozenset(x for x in parent if find(x) == find(y)) for y in parent}

        assert classes(links) == classes((a, b) for a, b in combinations(range(len(h)), 2) if int(h[a] ^ h[b]).bit_count() <= 2)


@pytest.mark.parametrize("hot", [1 << 15, 20])
def test_components_of_dealt_groups_equal_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(hamming, "HOT_KEY", hot)
    rows = [x for x in rows_of(8, n=240) if x[1]]
    parent = {x[0]: x[0] for x in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(rows, 2):
        if (int(a[1], 16) ^ int(b[1], 16)).bit_count() <= 4:
            x, y = sorted((find(a[0]), find(b[0])))
            parent[y] = x
    members = {}
    for x in parent:
        members.setdefault(find(x), []).append(x)
    several = {k: v for k, v in members.items() if len(v) > 1}
    want = {(n, k, no, len(v)) for no, (k, v) in enumerate(sorted(several.items()), 1) for n in v}
    df = spark.createDataFrame([x[:2] for x in rows], "image_name string, perceptual_hash string")
    assert {tuple(x) for x in dedup.near_duplicate_components(df, 4).collect()} == want


def estimate(df):
    """Bits of the size that Spark expects."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_estimates_do_not_grow_with_rounds(spark):
    rows = spark.range(40).selectExpr("id", "id % 7 AS k")
    for _ in range(5):
        rows = checkpointed(rows.join(rows.selectExpr("id", "k AS l"), "id").join(rows.selectExpr("id", "k AS n"), "id").selectExpr("id", "k + l - n AS k"))
    assert estimate(rows) <= 63 and {tuple(x) for x in rows.collect()} == {(i, i % 7) for i in range(40)}
    chain = spark.range(90).selectExpr("format_string('n%03d', id) AS a", "format_string('n%03d', id + 1) AS b")
    roots = connected_components(chain)
    assert estimate(roots) < 500 and {tuple(x) for x in roots.collect()} == {(f"n{i:03d}", "n000") for i in range(91)}
    df = spark.createDataFrame([x[:2] for x in rows_of(8, n=240)], "image_name string, perceptual_hash string")
    assert estimate(dedup.near_duplicate_components(df, 4)) < 1000

"""Joins with proven cardinality, reconciling joins and Hamming-distance joins.

Physical algorithms are left to the optimizer. The Hamming join turns a distance predicate into equi-joins on segments, so that it
never becomes a nested loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.session import checkpointed
from curatrix.functions.text import hex_lane
from curatrix.operators import hamming
from curatrix.operators.expectations import check, enforce, report, unique_check
from curatrix.operators.windows import global_row_number


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", cardinality: str = "1:1") -> DataFrame:
    """An equi-join whose declared sides ('1:1', '1:n', 'n:1', 'n:m') are proven to have unique keys first."""
    sides = cardinality.split(":")
    if len(sides) != 2 or not set(sides) <= {"1", "n", "m"}:
        raise ValueError(f"no such cardinality: {cardinality!r}")
    checks = [unique_check(df, f"{name} keys {keys} are unique", *keys) for df, name, side in ((left, "left", sides[0]), (right, "right", sides[1])) if side == "1"]
    if checks:
        enforce(report(checks))
    return left.join(right, keys, how)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Every disagreement: keys, ``problem`` ('left_only', 'right_only' or a column's name). Equal nulls agree."""
    l = left.select(*keys, *(F.col(c).alias(f"_l_{c}") for c in compared), F.lit(True).alias("_l"))
    r = right.select(*keys, *(F.col(c).alias(f"_r_{c}") for c in compared), F.lit(True).alias("_r"))
    joined = l.join(r, keys, "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    problems = [F.when(F.col("_r").isNull(), F.lit("left_only")), F.when(F.col("_l").isNull(), F.lit("right_only"))]
    problems += [F.when(both & ~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")), F.lit(c)) for c in compared]
    return joined.select(*keys, F.explode(F.filter(F.array(*problems), lambda p: p.isNotNull())).alias("problem"))


def reconcile_join(left: DataFrame, right: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """The 1:1 join of two tables that agree on the compared columns; raises otherwise."""
    bad = reconcile(left, right, keys, compared).groupBy("problem").count().orderBy("problem").collect()
    if bad:
        raise ValueError("tables don't reconcile: " + ", ".join(f"{r['problem']} {r['count']}" for r in bad))
    return checked_join(left, right.drop(*compared), keys)


def lookup_both_ends(pairs: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """Pairs with ``left_<value>`` and ``right_<value>`` looked up by ``left_<key>`` and ``right_<key>``."""
    for side in ("left", "right"):
        pairs = pairs.join(values.select(F.col(key).alias(f"{side}_{key}"), F.col(value).alias(f"{side}_{value}")), f"{side}_{key}", "left")
    return pairs


def both_ends_in(pairs: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Pairs whose two ends are both in ``kept``."""
    for side in ("left", "right"):
        pairs = pairs.join(kept.select(F.col(key).alias(f"{side}_{key}")).distinct(), f"{side}_{key}", "left_semi")
    return pairs


def _segments(digits: int, n: int) -> list[tuple[int, int]]:
    """(first digit, digits) of ``n`` segments of a hex string, as even as can be."""
    if n > digits:
        raise ValueError("the threshold needs a segment for each allowed difference; use more digits")
    cuts = [i * digits // n for i in range(n + 1)]
    return [(a + 1, b - a) for a, b in zip(cuts, cuts[1:])]


def hamming_pairs(hashes: DataFrame, hash_col: str, threshold: int, digits: int = 16, agree: int | None = None) -> DataFrame:
    """``left, right, hamming_distance`` over distinct hex hashes with left < right and 1 to ``threshold`` differing bits.

    Exact by the pigeonhole principle: of threshold + ``agree`` segments at least ``agree`` are equal within the threshold. Hashes meet
    on each combination of ``agree`` segments; two (the default, where the hash has digits enough) make keys twice as long as
    one, and so candidates fewer by orders of magnitude in large tables. A pair is kept at its lowest equal combination only, so that
    no distinct is needed after the join. Equal hashes stand once, so copies don't multiply.
    """
    agree = agree or (2 if threshold + 2 <= digits else 1)
    keys = list(combinations(_segments(digits, threshold + agree), agree))
    lanes = range(-(-digits // 16))
    distinct = hashes.select(F.col(hash_col).alias("h")).where(F.col("h").isNotNull()).distinct()
    distinct = distinct.select("h", *(hex_lane("h", i).alias(f"lane{i}") for i in lanes))
    parts = F.array(*(F.struct(F.lit(i).alias("no"), F.concat(*(F.substring("h", a, n) for a, n in key)).alias("value")) for i, key in enumerate(keys)))
    pieces = distinct.select("*", F.explode(parts).alias("s")).select("h", *(f"lane{i}" for i in lanes), "s.no", "s.value")
    l, r = pieces.alias("l"), pieces.alias("r")
    joined = l.join(r, (F.col("l.no") == F.col("r.no")) & (F.col("l.value") == F.col("r.value")) & (F.col("l.h") < F.col("r.h")))
    differ = [F.col(f"l.lane{i}").bitwiseXOR(F.col(f"r.lane{i}")) for i in lanes]
    distance = sum((F.bit_count(x) for x in differ), F.lit(0))

    def equal(key: tuple[tuple[int, int], ...]) -> Column:
        """No bit differs in the key's digits; a segment may lie in two lanes."""
        places = {d - 1 for a, n in key for d in range(a, a + n)}
        out = F.lit(True)
        for i in lanes:
            width = min(16, digits - 16 * i)
            mask = sum(0xF << 4 * (width - 1 - (d - 16 * i)) for d in places if 0 <= d - 16 * i < width)
            if mask:
                out = out & (differ[i].bitwiseAND(F.lit(mask - 2**64 if mask >= 2**63 else mask)) == 0)
        return out

    lowest = F.lit(len(keys))
    for i, key in reversed(list(enumerate(keys))):
        lowest = F.when(equal(key), F.lit(i)).otherwise(lowest)
    return joined.where((distance <= threshold) & (F.col("l.no") == lowest)).select(F.col("l.h").alias("left"), F.col("r.h").alias("right"), distance.cast("int").alias("hamming_distance"))


def near_duplicate_pairs(df: DataFrame, threshold: int, *, key: str = "image_name", hash_col: str = "perceptual_hash", ord_col: str = "ord", extra: tuple[str, ...] = ("group_id",), digits: int = 16, across: str | None = None) -> DataFrame:
    """All pairs of rows within the threshold: ``left_*`` and ``right_*`` of key and extra columns, and the distance.

    Left is the row of smaller ``ord_col``. ``across`` names a column whose two values must differ (a bipartite join). The hash pairs
    are found on distinct hashes and then expanded; use ``hamming_pairs`` with the membership where classes are enough.
    """
    carried = list(dict.fromkeys((key, *extra, *([across] if across else []))))
    rows = df.where(F.col(hash_col).isNotNull()).select(F.col(hash_col).alias("_h"), F.col(ord_col).alias("_o"), F.struct(*carried).alias("_row"))
    near = hamming_pairs(df, hash_col, threshold, digits)
    same = df.where(F.col(hash_col).isNotNull()).select(F.col(hash_col).alias("left")).distinct().select("left", F.col("left").alias("right"), F.lit(0).alias("hamming_distance"))
    pairs = near.union(same)
    l = rows.select(F.col("_h").alias("left"), F.col("_o").alias("_lo"), F.col("_row").alias("_l"))
    r = rows.select(F.col("_h").alias("right"), F.col("_o").alias("_ro"), F.col("_row").alias("_r"))
    joined = pairs.join(l, "left").join(r, "right")
    joined = joined.where((F.col("left") != F.col("right")) | (F.col("_lo") < F.col("_ro")))
    if across:
        joined = joined.where(F.col(f"_l.{across}") != F.col(f"_r.{across}"))
    first = F.col("_lo") < F.col("_ro")
    sides = [F.when(first, F.col(f"_{a}.{c}")).otherwise(F.col(f"_{b}.{c}")).alias(f"{side}_{c}") for side, a, b in (("left", "l", "r"), ("right", "r", "l")) for c in carried]
    return joined.select(*sides, "hamming_distance")


def hash_classes(df: DataFrame, key: str, hash_col: str) -> DataFrame:
    """``hash, first, records``: each distinct hash with its smallest record and their number."""
    return df.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("hash")).agg(F.min(key).alias("first"), F.count("*").alias("records"))


def _class_values(rows: DataFrame, c: str) -> DataFrame:
    """``hash, <c>_one, <c>_known, <c>_more``: a class's records that have a value, the value if it is one, else values with their numbers."""
    counted = rows.where(F.col(c).isNotNull()).groupBy("hash", F.col(c).alias("value")).agg(F.count("*").alias("n"))
    got = counted.groupBy("hash").agg(F.sum("n").alias(f"{c}_known"), F.min("value").alias("_v"), F.count("*").alias("_k"), F.collect_list(F.struct("value", "n")).alias("_all"))
    return got.select("hash", f"{c}_known", F.when(F.col("_k") == 1, F.col("_v")).alias(f"{c}_one"), F.when(F.col("_k") > 1, F.col("_all")).alias(f"{c}_more"))


def near_duplicate_links(df: DataFrame, threshold: int, by: tuple[str, ...] = (), *, key: str = "image_name", hash_col: str = "perceptual_hash", digits: int = 16, ends: DataFrame | None = None, totals: bool = False) -> DataFrame:
    """All near-duplicate pairs of records, counted between classes of equal hash instead of listed.

    ``left_<key>, right_<key>`` (the smallest records of the two hashes), ``hamming_distance, pairs`` and, for each column of ``by``,
    ``<column>_same`` and ``<column>_differ``: the pairs whose two values, neither null, are equal or not. Counts of a hash's values are
    multiplied, so copies, however many, cost a row a hash and value. What a class needs travels with its hash, so links are made where hashes
    meet and are never written or shuffled here. ``ends`` (column ``key``): only classes whose smallest record is in it. ``totals``: rows
    whose sums are those of the links' counts, far fewer than links.
    """
    rows = df.where(F.col(hash_col).isNotNull()).select(F.col(hash_col).alias("hash"), *dict.fromkeys((key, *by)))
    classes = hash_classes(rows, key, "hash")
    if ends is not None:
        classes = classes.join(ends.select(F.col(key).alias("first")).distinct(), "first", "left_semi")
    for c in by:
        classes = classes.join(_class_values(rows, c), "hash", "left").withColumn(f"{c}_known", F.coalesce(f"{c}_known", F.lit(0)))
    classes = checkpointed(classes)
    counts = ["pairs", *(f"{c}_{k}" for c in by for k in ("same", "differ"))]

    def work(table: pa.Table, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        names, records = table.column("first").combine_chunks(), table.column("records").to_numpy()
        values = [hamming.Values(table, c) for c in by]
        for i, j, d in found:
            numbers = [records[i] * records[j]]
            for v in values:
                same = v.same(i, j)
                numbers += [same, v.known[i] * v.known[j] - same]
            if totals:
                yield pa.RecordBatch.from_arrays([pa.array([int(x.sum())]) for x in numbers], counts)
            else:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), names.take(pa.array(j)), pa.array(d.astype(np.int32)), *map(pa.array, numbers)], ["a", "b", "hamming_distance", *counts])

    longs = ", ".join(f"`{c}` long" for c in counts)
    kind = df.schema[key].dataType.simpleString()
    two = lambda n: F.shiftright(n * (n - 1), 1)
    own = [two(F.col("records")).alias("pairs")]
    for c in by:
        known = F.col(f"{c}_known")
        same = F.when(F.col(f"{c}_more").isNull(), two(known)).otherwise(F.aggregate(f"{c}_more", F.lit(0).cast("long"), lambda s, x: s + two(x["n"])))
        own += [same.alias(f"{c}_same"), (two(known) - same).alias(f"{c}_differ")]
    copies = classes.where("records > 1").select(F.col("first").alias("a"), F.col("first").alias("b"), F.lit(0).alias("hamming_distance"), *own)
    if totals:
        return hamming.near(classes, threshold, digits, work, longs).union(copies.select(*counts))
    links = hamming.near(classes, threshold, digits, work, f"a {kind}, b {kind}, hamming_distance int, {longs}").union(copies)
    return links.select(F.least("a", "b").alias(f"left_{key}"), F.greatest("a", "b").alias(f"right_{key}"), "hamming_distance", *counts)


def flag_same(pairs: DataFrame, column: str, name: str) -> DataFrame:
    return pairs.withColumn(name, F.col(f"left_{column}") == F.col(f"right_{column}"))


def cross_namespace(pairs: DataFrame, key: str, mark: str = ":") -> DataFrame:
    """Pairs whose two namespaced keys have different namespaces."""
    part = lambda c: F.split_part(F.col(c), F.lit(mark), F.lit(1))
    return pairs.where(part(f"left_{key}") != part(f"right_{key}"))


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row aggregate."""
    return df.crossJoin(F.broadcast(scalars.limit(1)))  # one row


def positional_mismatches(left: DataFrame, right: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``place`` and ``problem`` of records that differ place by place, each side in its order of ``order`` (unique values).

    Places count from 0; a side that is longer has 'left_only' or 'right_only' rows. Equal nulls agree.
    """
    sides = [global_row_number(df.select(order, *(c for c in columns if c != order)), order, "place") for df in (left, right)]
    return reconcile(*sides, ["place"], columns)


def align(left: DataFrame, right: DataFrame, key: str, allow_superset: bool = False) -> DataFrame:
    """``right``'s records joined to their ``left`` ones, keys unique on both sides. Every right record must be found; without
    ``allow_superset`` the two key sets must be equal."""
    checks = [unique_check(df, f"{name} keys are unique", key) for name, df in (("left", left), ("right", right))]
    checks.append(check(right.join(left.select(key), key, "left_anti"), "every record is found", F.lit(False), F.col(key).cast("string")))
    if not allow_superset:
        checks.append(check(left.join(right.select(key), key, "left_anti"), "no record is left over", F.lit(False), F.col(key).cast("string")))
    enforce(report(checks))
    return right.join(left, key)

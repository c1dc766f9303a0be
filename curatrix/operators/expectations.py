"""Named expectations over rows and tables: each gives check rows, and ``enforce`` raises on those that failed."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLES = 5


class ExpectationFailed(ValueError):
    """One or more named checks failed."""


def check(df: DataFrame, name: str, predicate: Column, example: Column | str = "") -> DataFrame:
    """One row ``check, ok, n_bad, examples``: the rows where ``predicate`` isn't true, and up to five examples of them.

    Examples are the smallest ones (``array_sort`` over at most a bounded slice a task is avoided by taking minima of a set of hashes).
    """
    bad = df.where(~F.coalesce(predicate, F.lit(False)))
    if not isinstance(example, Column):
        return bad.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("check"), (F.col("n_bad") == 0).alias("ok"), "n_bad", F.lit(None).cast("array<string>").alias("examples"))
    few = bad.select(example.cast("string").alias("_e")).distinct().orderBy("_e").limit(EXAMPLES).agg(F.array_sort(F.collect_list("_e")).alias("examples"))
    return bad.agg(F.count("*").alias("n_bad")).crossJoin(few).select(F.lit(name).alias("check"), (F.col("n_bad") == 0).alias("ok"), "n_bad", "examples")


def row_checks(df: DataFrame, predicates: Mapping[str, Column], example: Column | str) -> DataFrame:
    """``check`` for many predicates over the same rows in one pass; the smallest example of each."""
    shown = example if isinstance(example, Column) else F.col(example)
    bad = {name: ~F.coalesce(p, F.lit(False)) for name, p in predicates.items()}
    one = df.agg(*(x for i, b in enumerate(bad.values()) for x in (F.count_if(b).alias(f"n{i}"), F.min(F.when(b, shown.cast("string"))).alias(f"e{i}"))))
    rows = F.array(*(F.struct(F.lit(name).alias("check"), (F.col(f"n{i}") == 0).alias("ok"), F.col(f"n{i}").alias("n_bad"), F.array_compact(F.array(f"e{i}")).alias("examples")) for i, name in enumerate(bad)))
    return one.select(F.inline(rows))


def condition(df: DataFrame, name: str, holds: Column, n_bad: Column | None = None) -> DataFrame:
    """One check row from a one-row aggregate ``df``."""
    ok = F.coalesce(holds, F.lit(False))
    bad = n_bad if n_bad is not None else (~ok).cast("long")
    return df.select(F.lit(name).alias("check"), ok.alias("ok"), bad.cast("long").alias("n_bad"), F.lit(None).cast("array<string>").alias("examples"))


def report(checks: Iterable[DataFrame]) -> DataFrame:
    """All check rows as one table."""
    return reduce(DataFrame.unionByName, checks)


def enforce(checks: DataFrame) -> None:
    """Raises with every failed check's name, count and examples (the table has one row a check)."""
    failed = checks.where("not ok").orderBy("check").collect()
    if failed:
        said = "; ".join(f"{r['check']}: {r['n_bad']} bad" + (f", such as {', '.join(r['examples'])}" if r["examples"] else "") for r in failed)
        raise ExpectationFailed(said)


def expect(df: DataFrame, name: str, predicate: Column) -> DataFrame:
    """``df`` unchanged; a row that breaks the predicate aborts the job when it is computed."""
    return df.where(F.when(F.coalesce(predicate, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"expectation failed: {name}")).cast("boolean")))


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """Fails while planning if columns are missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ExpectationFailed(f"{what} lacks columns: {missing}")
    return df


def unique_check(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Rows of repeated keys, by a partial count (no window over the key)."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return repeated.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).select(F.lit(name).alias("check"), (F.col("n") == 0).alias("ok"), F.col("n").cast("long").alias("n_bad"), F.lit(None).cast("array<string>").alias("examples"))


def single_value_check(df: DataFrame, name: str, column: str) -> DataFrame:
    """The column has exactly one distinct value and no null."""
    got = df.agg(F.count_distinct(column).alias("d"), F.count(F.when(F.col(column).isNull(), 1)).alias("nulls"))
    return condition(got, name, (F.col("d") == 1) & (F.col("nulls") == 0), F.greatest(F.col("d") - 1, F.lit(0)) + F.col("nulls"))


def count_check(df: DataFrame, name: str, expected: int) -> DataFrame:
    return condition(df.agg(F.count("*").alias("n")), name, F.col("n") == expected, F.abs(F.col("n") - expected))

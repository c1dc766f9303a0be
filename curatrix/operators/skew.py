"""Joins and minima by keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts into which the rows of any one key are dealt.
SALTS = 64


def salt_of(*columns: str | Column, salts: int = SALTS) -> Column:
    """A number below ``salts`` from a hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def spread_minimum(rows: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``_salt`` and, for each ``key, _salt`` in it, the key's least ``value`` as ``_least``; keys are not null.

    Both sides are dealt by key and salt, so that they join without a key's rows meeting in one task: minima are taken by key and salt, the
    few of a key are put together, and the result goes back to the key's salts.
    """
    dealt = rows.withColumn("_salt", salt_of(value)).repartition(key, "_salt")
    parts = dealt.groupBy(key, "_salt").agg(F.min(value).alias("_least"))
    whole = parts.groupBy(key).agg(F.min("_least").alias("_least"), F.collect_list("_salt").alias("_salts"))
    return dealt, whole.select(key, F.explode("_salts").alias("_salt"), "_least")


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, *by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``lookup`` (one row a key) with the rows of a key dealt by a hash of the columns ``by``.

    The lookup's row goes to those salts only that the key's rows have: never more rows than ``rows`` has.
    """
    salted = rows.withColumn("_salt", salt_of(*by))
    salts = salted.select(key, "_salt").distinct().groupBy(key).agg(F.collect_list("_salt").alias("_salts"))
    spread = lookup.join(salts, key).withColumn("_salt", F.explode("_salts")).drop("_salts")
    return salted.join(spread, [key, "_salt"], how).drop("_salt")

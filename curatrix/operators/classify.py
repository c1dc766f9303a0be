"""Projections and row-level classification: canonical records, exclusion reasons, one-hot classes, text classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import blank_to_empty, default_if_blank, is_blank, normalized_label

#: Fixed value: which confirmation a text class needs, and its tokens by precedence.
CONFIRMED = "histopathology"
HIGH_TOKENS = ("melanoma",)
MIDDLE_TOKENS = ("atyp", "dysplast", "clark")
LOW_TOKENS = ("nevus", "melanocytic")


def chain(cases: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first case that holds."""
    out = F.lit(None) if otherwise is None else otherwise
    for test, value in reversed(list(cases)):
        out = F.when(F.coalesce(test, F.lit(False)), value).otherwise(out)
    return out


def canonical_record(df: DataFrame, columns: Mapping[str, str], constants: Mapping[str, str], defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Roles from source columns, constants from the dataset, and row-or-dataset defaults (a blank cell takes the constant)."""
    chosen = [F.col(f"`{source}`").alias(role) for role, source in columns.items()]
    chosen += [default_if_blank(F.col(f"`{source}`"), F.lit(constants[role])).alias(role) for role, source in (defaults or {}).items()]
    chosen += [F.lit(value).alias(role) for role, value in constants.items() if role not in (defaults or {})]
    return df.select(*chosen)


def map_labels(df: DataFrame, raw: str, mapping: DataFrame) -> DataFrame:
    """``target`` and ``curated_label`` by a small mapping table ``raw_label, target, curated_label``; unmapped rows get nulls."""
    keyed = mapping.select(normalized_label("raw_label").alias("_label"), "target", "curated_label")
    return df.withColumn("_label", normalized_label(F.col(raw).cast("string"))).join(keyed, "_label", "left").drop("_label")


def label_expression(raw: Column, mapping: Mapping[str, object]) -> Column:
    pairs = [F.lit(x) for k, v in mapping.items() for x in (k.strip().lower(), v)]
    return F.element_at(F.create_map(*pairs), normalized_label(raw))


def exclusion_reason(*, name: Column, found: Column, duplicate_of: Column, group: Column, label: Column, mapped: Column, valid: Column) -> Column:
    """The first reason that applies to a row, or null."""
    return chain(
        [
            (is_blank(name), F.lit("missing_image_name")),
            (~found, F.lit("image_not_found")),
            (duplicate_of.isNotNull(), F.concat(F.lit("source_duplicate_of:"), duplicate_of)),
            (is_blank(group), F.lit("missing_group_id")),
            (~mapped, F.concat(F.lit("unmapped_label:"), F.coalesce(F.nullif(normalized_label(label), F.lit("")), F.lit("blank")))),
            (~valid, F.lit("invalid_image")),
        ]
    ).cast("string")


def split_excluded(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def waterfall(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """One row: how many rows satisfy each predicate (not exclusive)."""
    return df.agg(*(F.sum(F.coalesce(p, F.lit(False)).cast("int")).cast("long").alias(n) for n, p in predicates.items()))


def one_hot_valid(columns: Sequence[str]) -> Column:
    """All values are 0 or 1 and they sum to 1."""
    values = F.array(*(F.col(c).cast("double") for c in columns))
    binary = F.forall(values, lambda x: x.isNotNull() & x.isin(0.0, 1.0))
    return F.coalesce(binary & (F.aggregate(values, F.lit(0.0), lambda a, x: a + x) == 1.0), F.lit(False))


def one_hot_class(columns: Mapping[str, str] | Sequence[str]) -> Column:
    """The class of the largest value, the first in order among equals."""
    names = dict(columns) if isinstance(columns, Mapping) else {c: c.lower() for c in columns}
    largest = F.greatest(*(F.col(c) for c in names)) if len(names) > 1 else F.col(next(iter(names)))
    return chain([(F.col(c) == largest, F.lit(v)) for c, v in names.items()])


def derived_targets(class_column: str, sets: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    return {name: F.coalesce(F.col(class_column).isin(*members), F.lit(False)).cast("int") for name, members in sets.items()}


def reference_class(confirmation: Column, fields: Sequence[Column], names: tuple[str, str, str] = ("benign", "atypical", "melanoma")) -> Column:
    """Class of a confirmed record by tokens anywhere in its hierarchy; null for others."""
    text = F.lower(F.concat_ws(" | ", *(F.coalesce(f, F.lit("")) for f in fields)))
    has = lambda tokens: F.greatest(*(text.contains(t) for t in tokens), F.lit(False))
    confirmed = normalized_label(confirmation) == CONFIRMED
    low = (normalized_label(fields[0]) == "benign") & has(LOW_TOKENS)
    return F.when(confirmed, chain([(has(HIGH_TOKENS), F.lit(names[2])), (has(MIDDLE_TOKENS), F.lit(names[1])), (low, F.lit(names[0]))])).cast("string")


def license_url(license_: Column, urls: Mapping[str, str]) -> Column:
    """URL of a licence; an unknown one aborts the job when computed."""
    known = F.element_at(F.create_map(*(F.lit(x) for kv in urls.items() for x in kv)), license_)
    return F.when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown licence: "), F.coalesce(license_, F.lit("null")))).cast("string"))


def to_number(c: Column | str, kind: str = "double") -> Column:
    """Number or null."""
    return F.expr(f"try_cast(`{c}` as {kind})") if isinstance(c, str) else F.try_to_number(c, F.lit("S999999999D999999999"))


def flatten_record(record: Column, fields: Mapping[str, str]) -> list[Column]:
    """Nested fields by path as columns; a missing branch is ''."""
    return [blank_to_empty(record.getField(path.split(".")[0]) if "." not in path else _path(record, path)).alias(name) for name, path in fields.items()]


def _path(record: Column, path: str) -> Column:
    for part in path.split("."):
        record = record.getField(part)
    return record.cast("string")


def explode_arrays(df: DataFrame, arrays: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row an element of equally long arrays."""
    return df.select(*keep, F.inline(F.arrays_zip(*arrays)))


def collect_arrays(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """The inverse: one row with the columns as arrays in the given order. For bundles of bounded size only."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *columns)))
    return df.agg(rows.alias("_r")).select(*(F.transform("_r", lambda x, c=c: x[c]).alias(c) for c in columns))

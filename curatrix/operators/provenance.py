"""Digests, receipts and cards that tie results to their inputs."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable, Mapping
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import row_checksum
from curatrix.operators.windows import global_row_number

SORT_COLUMNS = ("image_name", "image_path", "sha256")


def canonical_value(value: Any) -> Any:
    """Blank and not-a-number become null, finite floats are rounded to 12 digits."""
    if value is None or value == "" or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 12) if isinstance(value, float) and math.isfinite(value) else value


def canonical_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=True, separators=(",", ":"), sort_keys=True)


def manifest_digest(df: DataFrame) -> str:
    """SHA-256 of the canonical JSON of all rows, by columns in order and rows sorted by name, path and content digest.

    The digest depends on the order of all rows, so the sorted rows stream through the driver, one partition at a time. That suits
    manifests; for tables of any size take ``fast_checksum``.
    """
    columns = sorted(df.columns)
    keys = [c for c in SORT_COLUMNS if c in columns]
    rows = df.select(*(F.col(f"`{c}`") for c in columns))
    rows = rows.orderBy(*(F.asc_nulls_last(c) for c in keys)) if keys else rows
    digest = hashlib.sha256(f'{{"columns":{canonical_json(columns)},"records":['.encode())
    first = True
    for row in rows.toLocalIterator():
        record = canonical_json({c: canonical_value(row[c]) for c in columns})
        digest.update((record if first else "," + record).encode())
        first = False
    digest.update(b"]}")
    return digest.hexdigest()


def fast_checksum(df: DataFrame) -> DataFrame:
    """``n, checksum``: independent of order and partitioning, computed in parallel."""
    return df.agg(F.count("*").alias("n"), row_checksum(*sorted(df.columns)).cast("string").alias("checksum"))


def ordered_digest(df: DataFrame, columns: Iterable[str], order: str) -> DataFrame:
    """SHA-256 over NUL-joined lines in order, for evaluation sets of bounded size."""
    return df.select(F.col(order).alias("_o"), _line(columns).alias("_t")).agg(F.sha2(_joined("_o", "_t"), 256).alias("sha256"))


def _line(columns: Iterable[str]) -> Column:
    """The columns as text with NUL between, and a line end."""
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    first, *rest = [F.col(c).cast("string") for c in columns]
    return F.concat(first, *(x for p in rest for x in (nul, p)), F.lit("\n"))


def _joined(order: str, text: str) -> Column:
    """Aggregate: the texts in order, one after the other."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "")


def tree_digest(df: DataFrame, columns: Iterable[str], order: str, chunk: int = 10_000) -> DataFrame:
    """``rows, sha256``: digests of chunks of consecutive lines, and the digest of their digests, for tables of any size.

    Lines are those of ``ordered_digest``, ``order`` is unique, and a chunk is ``chunk`` places of it: chunks are hashed side by side, and one row
    a chunk is left for the last step. The result depends on the rows and on ``chunk`` alone.
    """
    numbered = global_row_number(df.select(F.col(order).alias("_o"), _line(columns).alias("_t")), "_o", "_no")
    parts = numbered.groupBy(F.floor(F.col("_no") / chunk).alias("_c")).agg(F.count("*").alias("n"), F.sha2(_joined("_o", "_t"), 256).alias("_t"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(_joined("_c", "_t"), 256).alias("sha256"))


def receipt(action: str, inputs: Mapping[str, str], at: datetime | None = None) -> dict[str, Any]:
    """What was done, to which digests, and when (UTC, to the second), under a digest of its own."""
    when = (at or datetime.now(UTC)).astimezone(UTC).replace(microsecond=0)
    body = {"action": action, "created_at": when.isoformat().replace("+00:00", "Z"), "inputs": dict(sorted(inputs.items()))}
    return {**body, "sha256": hashlib.sha256(canonical_json(body).encode()).hexdigest()}


def component_set_digest(components: Mapping[str, Mapping[str, Any]]) -> str:
    return hashlib.sha256(canonical_json({k: dict(v) for k, v in sorted(components.items())}).encode()).hexdigest()


def counts_by(df: DataFrame, column: str) -> dict[str, int]:
    """Counts by value, sorted by key. For columns with few values: the result is a document."""
    return {str(r[column]): int(r["count"]) for r in df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(column).collect()}


def dataset_card(manifest: DataFrame, constants: Mapping[str, Any]) -> dict[str, Any]:
    """Counts of a manifest with its constants, as a document."""
    total = manifest.agg(F.count("*").alias("images"), F.count_distinct("group_id").alias("groups"), F.count_distinct("sha256").alias("distinct_contents")).first().asDict()
    return {**dict(constants), **total, "target_counts": counts_by(manifest, "target"), "collection_counts": counts_by(manifest, "collection_id")}


def runtime_manifest(*, model: Mapping[str, Any], calibration: Mapping[str, Any], thresholds: tuple[float, float], preprocessing: Mapping[str, Any]) -> dict[str, Any]:
    """A version 3 document for a scorer; raises unless thresholds are ordered and mean and deviation have three numbers."""
    low, high = thresholds
    if not 0 <= low < high <= 1:
        raise ValueError("thresholds must be ordered in [0, 1]")
    for name in ("mean", "std"):
        values = preprocessing.get(name)
        if not isinstance(values, (list, tuple)) or len(values) != 3 or not all(isinstance(v, (int, float)) and math.isfinite(v) for v in values):
            raise ValueError(f"preprocessing {name} needs three finite numbers")
    return {"schema_version": 3, **dict(model), "calibration": dict(calibration), "low_threshold": float(low), "high_threshold": float(high), "preprocessing": dict(preprocessing)}


def hash_chain_problems(receipts: DataFrame, actual: DataFrame, key: str = "artifact") -> DataFrame:
    """Artifacts whose recorded SHA-256 is missing or differs from the actual one."""
    joined = receipts.select(key, F.col("sha256").alias("recorded")).join(actual.select(key, F.col("sha256").alias("found")), key, "full_outer")
    problem = F.when(F.col("recorded").isNull(), F.lit("not_recorded")).when(F.col("found").isNull(), F.lit("missing")).when(F.col("recorded") != F.col("found"), F.lit("hash_mismatch"))
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull())

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.session import checkpointed, written  # noqa: F401

#: Text bytes that an operator's Python code takes at once; bounds a worker's memory whatever the batch size is.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``limit`` bytes of ``column`` each, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def with_text(df: DataFrame, keep: Sequence[str], text_col: str) -> tuple[DataFrame, str]:
    """The kept columns and the text, once, and the name under which it stands."""
    if text_col in keep:
        return df.select(*(F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in keep)), text_col
    return df.select(*keep, F.col(text_col).cast("string").alias("_text")), "_text"


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named by place, and these names by the old ones: no name can clash with an operator's own."""
    names = {c: f"column{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def map_slices(df: DataFrame, column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema, limit: int = SLICE_BYTES) -> DataFrame:
    """``work`` on bounded slices of every batch, as a narrow (shuffle-free) step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                yield work(part)

    return df.mapInArrow(run, schema)

"""Readers with explicit schemas: identifiers are never inferred."""

from __future__ import annotations

import csv
import io
from collections.abc import Mapping, Sequence

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.operators.expectations import ExpectationFailed

#: Fixed value: manifest columns that are numbers; all others are text.
INTEGERS = ("target", "width", "height", "fold", "perceptual_hash_bits", "near_duplicate_hamming_threshold", "hamming_distance", "row_number", "full_image_size", "source_error_rank")


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The column names of the first line, a byte-order mark taken off. Read by Spark, so any store will do."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ExpectationFailed(f"{path} is empty")
    return next(csv.reader(io.StringIO(first[0][0].lstrip("﻿"))))


def read_csv(spark: SparkSession, path: str, *, types: Mapping[str, str] | None = None, default: str = "string", keep_blanks: bool = False, required: Sequence[str] = (), multi_line: bool = True) -> DataFrame:
    """A CSV table whose schema comes from its header and ``types``. Blanks are null, or '' with ``keep_blanks``.

    Values with line ends need ``multi_line``, which makes each file one task; without it large files are split.
    """
    names = csv_header(spark, path)
    if missing := sorted(set(required) - set(names)):
        raise ExpectationFailed(f"{path} lacks columns: {missing}")
    if len(set(names)) != len(names):
        raise ExpectationFailed(f"{path} repeats columns")
    kinds = types or {}
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(kinds.get(n, default))) for n in names])
    df = spark.read.schema(schema).csv(path, header=True, encoding="UTF-8", multiLine=multi_line, escape='"', mode="FAILFAST")
    return df.na.fill("") if keep_blanks else df


def read_manifest(spark: SparkSession, path: str, additional_integers: Sequence[str] = (), infer: bool = False) -> DataFrame:
    """Listed columns are integers and all others text; with ``infer`` the other ones whose values are all numbers are numbers.

    Identifiers stay text where a value has a leading zero, a sign or more digits than a long.
    """
    known = {c: "int" for c in (*INTEGERS, *additional_integers)}
    df = read_csv(spark, path, types=known)
    others = [c for c in df.columns if c not in known]
    if not infer or not others:
        return df
    shape = {c: F.trim(F.col(f"`{c}`")) for c in others}
    every = lambda c, pattern: F.coalesce(F.min(F.coalesce(c.rlike(pattern), F.lit(True)).cast("int")), F.lit(0)) * (F.count(c) > 0).cast("int")
    got = df.agg(*(every(shape[c], p).alias(f"{k}{i}") for i, c in enumerate(others) for k, p in (("i", r"^(0|[1-9][0-9]{0,17})$"), ("d", r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")))).first()
    found = {c: "long" if got[f"i{i}"] else "double" for i, c in enumerate(others) if got[f"i{i}"] or got[f"d{i}"]}
    return read_csv(spark, path, types=known | found)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType, lines: bool = False) -> DataFrame:
    """One document a file (or an array of documents), or one a line; malformed ones are an error."""
    return spark.read.schema(schema).json(path, multiLine=not lines, mode="FAILFAST")


def read_yaml(text: str) -> dict:
    """A configuration document."""
    got = yaml.safe_load(text)
    if not isinstance(got, dict):
        raise ExpectationFailed("a configuration must be a mapping")
    return got


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, bytes, sha256, md5, crc32`` of files; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), F.crc32("content").alias("crc32"))


def verify_digests(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Expected files that are missing or differ."""
    joined = expected.select(key, F.col("sha256").alias("wanted")).join(found.select(key, F.col("sha256").alias("got")), key, "left")
    return joined.where(~F.coalesce(F.col("wanted") == F.col("got"), F.lit(False)))


#: Fixed value: extensions by preference.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")


def resolve_images(names: DataFrame, listing: DataFrame, name: str = "image_name") -> DataFrame:
    """``names`` with ``image_path`` (or null): the file of that stem with the preferred extension."""
    from curatrix.functions.text import file_stem, file_suffix

    rank = F.array_position(F.array(*map(F.lit, EXTENSIONS)), file_suffix("path"))
    files = listing.select(file_stem("path").alias(name), F.struct(rank.alias("r"), F.col("path").alias("p")).alias("_f")).where("_f.r > 0")
    best = files.groupBy(name).agg(F.min("_f").alias("_f")).select(name, F.col("_f.p").alias("image_path"))
    return names.join(best, name, "left")

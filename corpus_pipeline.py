"""A corpus pipeline over the operators of curatrix.llm.

Every stage takes (spark, docs, sf_dir), works on all of ``docs``, which has the columns of documents, and returns a DataFrame. The driver
of a pipeline writes each stage's result as Parquet and reads it again as the next one's input; ``run`` does so below the checkpoint folder.
Models are fitted on the stage's own input. Empty tables, null columns and repeated rows go through as the operators define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import byte_bpe, language_mixture, mixing, simhash, skip_chain_pii
from curatrix.llm._frames import numbered, written

#: A document is rejected if no language has this share of it (or if it has no letter at all).
MIN_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose main language is found; ``lang`` becomes that language."""
    rows, name = numbered(docs)
    out = language_mixture.held_out(name["doc_id"])
    model = language_mixture.fit(rows.where(~out), name["text"], name["lang"])
    found = language_mixture.predict(rows, model, name["text"], keep=tuple(rows.columns))
    kept = found.where((F.col("lang_pred") != language_mixture.UNKNOWN) & (F.col("score") >= MIN_SHARE))
    return kept.withColumn(name["lang"], F.col("lang_pred")).select(rows.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class."""
    return simhash.keep_one(docs, distinct_ids=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by kind names; ``n_chars`` follows the text."""
    rows, name = numbered(docs)
    masked = skip_chain_pii.mask_pii(rows, skip_chain_pii.train(rows, name["text"]), name["text"])
    return masked.withColumn(name["n_chars"], F.length(name["text"]).cast("long")).toDF(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    rows, name = numbered(docs)
    taken = mixing.systematic_mix(rows, name["doc_id"], name["text"], name["source"]).where("copies > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    return taken.select(*rows.columns, copies.alias("_copy")).drop("_copy").toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` and whether decoding the ids gives the text's bytes."""
    keep = ("doc_id", "lang", "source", "text")
    coded = byte_bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep)
    exact = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: Trained models and the tokenizer's merges are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs

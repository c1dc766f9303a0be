"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words: the weights share ``share`` times all words, no target exceeds ``most`` times its
source's words, and the excess is shared again by weight among the others until none is above. A document's expected copies are
its source's target divided by the source's words. Within a source the documents stand in a fixed order, their expected copies
are prefix-summed, one pseudo-random offset of the source is added, and a document is emitted once for each integer that its
interval of the sum crosses. The order is by size (in bins of at most a tenth), so the words taken stay near the target.

Prefix sums never put a source into one task: a source is cut into blocks by size bin and 256 hash ranges, the blocks' row
counts are summed bin by bin and within a bin (a few hundred rows a window, whatever the input), and only ranks within a block are
counted row by row. All of it is DataFrame code. The sums are integers in units of 2^-28 copies, exact up to 1.7e10 rows a source.

Defined cases: null text has size 0; null source is a source of its own, after the others; a source without words has target 0
and nothing is taken from it; sizes of 0 take part (their copies hold no words); null or repeated doc_ids are rows like others
(they share an order key; rows of one id and size are told apart by a hash of their text, or of all that is carried, so that a recomputed task
takes the same ones, and equal rows are alike); an empty table gives an empty table. Extra
columns are carried, those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.llm._frames import checkpointed, read

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
UNIT_BITS = 28


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """``_source, source_size, target`` from rows of ``_source, size``. One row a source from the start, so windows are small.

    Sources in ascending order of cap by weight are full up to the first whose share of what is left stays below its cap.
    """
    total = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("_source").isNull(), "_source")
    ranked = total.withColumn("_place", (F.row_number().over(by_name) - 1) % len(weights))
    ranked = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.col("_place") + 1).cast("long"))
    up, cap = W.orderBy(F.col("source_size") / F.col("_w"), F.col("_source").isNull(), "_source"), F.col("source_size") * most
    everything = W.partitionBy()
    filled = ranked.withColumns(
        {
            "_before": F.coalesce(F.sum(cap).over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "_weights": F.sum("_w").over(up.rowsBetween(0, W.unboundedFollowing)),
            "_all": F.sum("source_size").over(everything),
        }
    )
    above = F.col("_all") * share[0] - F.col("_before") * share[1]  # of the words left, times share[1]
    filled = filled.withColumns({"_above": above, "_fits": above * F.col("_w") <= cap * F.col("_weights") * share[1]})
    level = lambda c: F.min(F.when(F.col("_fits"), F.struct("_before", c))).over(everything)[c]  # noqa: E731  the first that fits: least _before
    filled = filled.withColumns({"_a": level("_above"), "_b": F.max(F.when(F.col("_fits"), F.col("_weights"))).over(everything)})
    target = F.when(F.col("_fits"), (F.col("_a") * F.col("_w")).cast("double") / (F.col("_b") * share[1]).cast("double")).otherwise(cap.cast("double"))
    return filled.select("_source", "source_size", target.alias("target"))


def digits_bin(size: Column) -> Column:
    text = size.cast("string")
    return F.length(text) * 100 + F.substring(text, 1, 2).cast("int")


def word_count(text_col: str) -> Column:
    return F.when(F.col(text_col).isNull(), 0).otherwise(F.regexp_count(F.col(text_col), F.lit(WORD))).cast("long")


def mix_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """``id_col, size, source_size, target, copies, taken`` of every row, texts left where they are.

    The words are counted once: the narrow rows are written to the checkpoint folder, since three later steps read them.
    """
    rows = df.select(F.col(id_col), word_count(text_col).alias("size"), F.col(source_col).cast("string").alias("_source"), F.xxhash64(text_col).alias("_mark"))
    return copies_of(checkpointed(rows), id_col, seed).drop("_source")


def systematic_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """The rows of ``df`` with ``size, source_size, target, copies`` and ``taken`` (= copies * size)."""
    own = ("size", "source_size", "target", "copies", "taken")
    mark = F.xxhash64(text_col, *(F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind))
    rows = df.withColumns({"_size": word_count(text_col), "_source": F.col(source_col).cast("string"), "_mark": mark}).drop(*own).withColumnRenamed("_size", "size")
    return copies_of(rows, id_col, seed, wide=True).drop("_source")


def copies_of(rows: DataFrame, id_col: str, seed: int, wide: bool = False) -> DataFrame:
    tie = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))
    rows = rows.withColumns({"_key": F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n")), "_bin": digits_bin(F.col("size")), "_tie": tie})
    rows = rows.withColumn("_part", F.substring("_tie", 1, 2))
    narrow = rows.select("_key", "_source", "size", "_bin", "_part")
    if wide:  # two sums read these few bytes a row: texts are not read again for each
        narrow = checkpointed(narrow)
    targets = source_targets(narrow).withColumn("_key", F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n"))).drop("_source")
    blocks = narrow.groupBy("_key", "_bin", "_part").agg(F.count("*").alias("_rows"))
    # sums before a bin (a few hundred rows a source), and before a part within its bin
    sum_before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = blocks.groupBy("_key", "_bin").agg(F.sum("_rows").alias("_in_bin"))
    bins = bins.withColumn("_bin_base", sum_before("_in_bin", W.partitionBy("_key").orderBy("_bin"))).drop("_in_bin")
    blocks = blocks.withColumn("_base", sum_before("_rows", W.partitionBy("_key", "_bin").orderBy("_part"))).join(bins, ["_key", "_bin"])
    blocks = blocks.withColumn("_base", F.col("_base") + F.col("_bin_base")).drop("_bin_base").join(targets, "_key")
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"offset-{seed}"), "_key").cast("binary")), 1, 7), 16, 10).cast("long")
    unit = float(1 << UNIT_BITS)
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * unit)).otherwise(0).cast("long")
    blocks = blocks.withColumns({"_offset": offset, "_step": step}).drop("_rows")
    block = ["_key", "_bin", "_part"]
    rank = F.col("_base") + F.row_number().over(W.partitionBy(*block).orderBy("size", "_tie", "_mark"))
    rows = rows.join(blocks, block).withColumn("_rank", rank.cast("long"))
    crossed = lambda n: F.shiftright(F.col("_offset") + n * F.col("_step"), UNIT_BITS)
    copies = (crossed(F.col("_rank")) - crossed(F.col("_rank") - 1)).cast("long")
    rows = rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.drop(*block, "_tie", "_mark", "_base", "_offset", "_step", "_rank")


def op10_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sizes(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(CASE WHEN doc_id IS NULL THEN '42' ELSE '42:' || doc_id::VARCHAR END) AS tie,
         coalesce('s' || source, 'n') AS k
  FROM documents),
total AS (SELECT k, source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY ALL),
ranked AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1]::BIGINT AS w FROM total),
filled AS (
  SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY source_size::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_,
         (sum(w) OVER (ORDER BY source_size::DOUBLE / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights,
         (sum(source_size) OVER ())::BIGINT AS all_
  FROM ranked),
fits AS (SELECT *, all_ * 3 - before_ * 2 AS above, (all_ * 3 - before_ * 2) * w <= 2 * source_size * weights * 2 AS fits FROM filled),
level AS (SELECT arg_min(above, before_) AS a, max(weights) AS b FROM fits WHERE fits),
targets AS (
  SELECT k, source_size, CASE WHEN fits THEN (a * w)::DOUBLE / (b * 2)::DOUBLE ELSE (2 * source_size)::DOUBLE END AS target
  FROM fits LEFT JOIN level ON true),
placed AS (
  SELECT r.*, t.source_size, t.target,
         row_number() OVER (PARTITION BY k ORDER BY length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT, substr(tie, 1, 2), size, tie) AS place,
         ('0x' || substr(md5('offset-42:' || k), 1, 7))::BIGINT AS off,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * 268435456.0)::BIGINT ELSE 0 END AS step
  FROM rows_ r JOIN targets t USING (k))
SELECT doc_id, size, source_size, target, (((off + place * step) >> 28) - ((off + (place - 1) * step) >> 28)) * size AS taken FROM placed
"""

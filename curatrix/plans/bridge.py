"""The tables that the registered queries work on, as DataFrames and as DuckDB SQL: manifests, predictions, views and requests.

Each view is built from the whole of its tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.simhash import word_fingerprint


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit(key: Column) -> Column:
    """52 bits of a SHA-256 as a double in [0, 1): exact in any engine."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def manifest(spark: SparkSession, sf_dir: str, fingerprint: bool = True) -> DataFrame:
    hashed = word_fingerprint(F.col("text")) if fingerprint else F.lit(None).cast("string")
    # texts are hashed where they are read, so that the join doesn't shuffle them
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("sha256"), hashed.alias("perceptual_hash"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.format_string("doc_%06d", "doc_id").alias("image_name"),
        F.concat(F.lit("img/"), F.format_string("doc_%06d", "doc_id"), F.lit(".txt")).alias("image_path"),
        "sha256",
        "perceptual_hash",
        F.concat(F.col("lang"), F.lit("-g"), (F.col("doc_id") % 23).cast("string")).alias("group_id"),
        F.col("source").alias("collection_id"),
        F.col("quality").cast("string").alias("source_label"),
        F.col("quality").alias("target"),
        F.col("doc_id").alias("ord"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    target = (F.col("o_orderpriority") == "1-URGENT").cast("int")
    return joined.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("group_id"), F.col("n_regionkey").alias("source_id"), target.alias("target"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).withColumn("p", (unit(F.col("record_id")) + 0.6 * F.col("target")) / 1.6)


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.array(*((unit(F.concat(F.col("record_id").cast("string"), F.lit(f":v{i}"))) + 0.6 * F.col("target")) / 1.6 for i in range(6)))
    return orders(spark, sf_dir).select("record_id", "target", scores.alias("views"))


def three(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cls.alias("target"), (F.col("l_quantity") / 50.0).alias("score"))


PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = [(F.col("o_orderpriority") == k).cast("double").alias(v) for k, v in PRIORITIES.items()]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), *hot)


MEMBERS = 64


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, a, b``: half the sums of the first and of the second half of each vector's components, as logits of two models."""
    part = lambda begin: F.aggregate(F.slice("embedding", begin, MEMBERS // 2), F.lit(0.0), lambda s, x: s + x.cast("double")) / 2
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", part(1).alias("a"), part(MEMBERS // 2 + 1).alias("b"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record_id, target, member, logit``: the components of the vectors as models' logits."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), (F.col("label") < 3).cast("int").alias("target"), F.slice("embedding", 1, MEMBERS).alias("v"))
    return e.select("record_id", "target", F.posexplode("v").alias("i", "x")).select("record_id", "target", F.concat(F.lit("m"), F.col("i").cast("string")).alias("member"), (F.col("x").cast("double") * 4).alias("logit"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as JSON text, some of them faulty, by event id and type."""
    e = table(spark, sf_dir, "events")
    rid = F.when(F.col("event_id") % 11 == 0, F.lit("not-an-id")).otherwise(F.md5(F.col("event_id").cast("string")))
    text = F.format_string(
        '{"ipc_version": %d, "request_id": "%s", "operation": "%s", "expected_model": "%s", "input": {"quality_status": "%s", "microscope_source_confirmed": %s, "acquisition_protocol_status": "ok", "observation_id": %d, "raw_output": %s}}',
        F.when(F.col("event_id") % 13 == 0, 2).otherwise(1),
        rid,
        F.when(F.col("event_id") % 7 == 0, F.lit("status")).when(F.col("event_id") % 17 == 0, F.lit("train")).otherwise(F.lit("predict")),
        F.when(F.col("event_id") % 19 == 0, F.lit("other")).otherwise(F.lit("scorer-1")),
        F.when(F.col("event_id") % 5 == 0, F.lit("rejected")).otherwise(F.lit("accepted")),
        F.when(F.col("event_id") % 6 == 0, F.lit("false")).otherwise(F.lit("true")),
        F.col("event_id") % 23,
        ((F.col("event_id") % 64) / 8 - 4).cast("string"),
    )
    return e.select("event_id", text.alias("payload"))


# ---- the same in DuckDB

_UNIT = "('0x' || substr(sha256({0}::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"

_HASH = r"""
b_hash AS (
  WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS t FROM documents),
  cnt AS (SELECT doc_id, t, count(*) AS c FROM tok GROUP BY ALL),
  v AS (SELECT doc_id, c, ('0x' || substr(md5(t), 1, 16))::UBIGINT AS h FROM cnt),
  bits AS (SELECT doc_id, p, sum(CASE WHEN (h >> (63 - p)::UBIGINT) & 1::UBIGINT = 1 THEN c ELSE -c END) AS s FROM v, range(64) r(p) GROUP BY ALL)
  SELECT doc_id, sum(CASE WHEN s > 0 THEN (1::HUGEINT << (63 - p)::INT) ELSE 0::HUGEINT END)::UBIGINT AS h FROM bits GROUP BY doc_id)"""

_MANIFEST = """
b_manifest AS (
  SELECT format('doc_{:06d}', d.doc_id) AS image_name, 'img/' || format('doc_{:06d}', d.doc_id) || '.txt' AS image_path, sha256(text) AS sha256,
         %s AS perceptual_hash, lang || '-g' || (d.doc_id %% 23) AS group_id, source AS collection_id,
         quality::VARCHAR AS source_label, quality AS target, d.doc_id AS ord
  FROM documents d LEFT JOIN labels USING (doc_id) %s)"""

SQL = {
    "b_manifest": _MANIFEST % ("NULL::VARCHAR", ""),
    "b_hashed": _HASH + "," + (_MANIFEST % ("lower(lpad(hex(coalesce(h, 0::UBIGINT)), 16, '0'))", "LEFT JOIN b_hash USING (doc_id)")).replace("b_manifest", "b_hashed"),
    "b_orders": "b_orders AS (SELECT o_orderkey AS record_id, o_custkey AS group_id, n_regionkey AS source_id, (o_orderpriority = '1-URGENT')::INTEGER AS target FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)",
    "b_pred": f"b_pred AS (SELECT *, ({_UNIT.format('record_id')} + 0.6::DOUBLE * target) / 1.6::DOUBLE AS p FROM b_orders)",
    "b_views": "b_views AS (SELECT record_id, target, [" + ", ".join(f"({_UNIT.format(f'(record_id::VARCHAR || chr(58) || {chr(39)}v{i}{chr(39)})')} + 0.6::DOUBLE * target) / 1.6::DOUBLE" for i in range(6)) + "] AS views FROM b_orders)",
    "b_three": "b_three AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS target, l_quantity / 50.0::DOUBLE AS score FROM lineitem)",
    "b_onehot": "b_onehot AS (SELECT o_orderkey AS record_id, " + ", ".join(f"(o_orderpriority = '{k}')::INT::DOUBLE AS {v}" for k, v in PRIORITIES.items()) + " FROM orders)",
    "b_halves": f"b_halves AS (SELECT vec_id, label, list_sum(list_transform(embedding[1:{MEMBERS // 2}], lambda x: x::DOUBLE)) / 2 AS a, list_sum(list_transform(embedding[{MEMBERS // 2 + 1}:{MEMBERS}], lambda x: x::DOUBLE)) / 2 AS b FROM embeddings)",
    "b_members": f"b_members AS (SELECT vec_id AS record_id, (label < 3)::INTEGER AS target, 'm' || (i - 1) AS member, embedding[i]::DOUBLE * 4 AS logit FROM embeddings, range(1, {MEMBERS + 1}) r(i))",
}
NEEDS = {"b_pred": ("b_orders",), "b_views": ("b_orders",)}


def with_views(*names: str, recursive: bool = False) -> str:
    """A WITH clause that defines the views and what they need."""
    wanted: list[str] = []
    for n in names:
        for x in (*NEEDS.get(n, ()), n):
            if x not in wanted:
                wanted.append(x)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in wanted)

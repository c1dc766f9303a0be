"""Queries that write files or bundles below the checkpoint folder and read them again, and those about names of records."""

from __future__ import annotations

import struct
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import text
from curatrix.functions.session import checkpoint_folder
from curatrix.operators import joins, sample
from curatrix.plans.bridge import table
from curatrix.plans.catalogue import query
from curatrix.sources import bundles, sinks, tables


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part")
def inferred_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through a CSV file, its numbers found again."""
    path = _folder(spark, "manifest")
    sinks.write_csv(table(spark, sf_dir, "part"), path)
    return tables.read_manifest(spark, path, infer=True)


@query("SELECT 1000000 + p_partkey AS row_number, 'img' || p_partkey AS image_name, CASE WHEN p_size % 2 = 0 THEN 'even \"size\", ' || p_type ELSE 'odd' END AS reason FROM part")
def written_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exclusion list through its sink; reasons hold commas and quotes."""
    reason = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('even "size", '), "p_type")).otherwise(F.lit("odd"))
    rows = table(spark, sf_dir, "part").select((F.lit(1000000) + F.col("p_partkey")).alias("row_number"), F.concat(F.lit("img"), F.col("p_partkey").cast("string")).alias("image_name"), reason.alias("reason"))
    path = _folder(spark, "exclusions")
    sinks.write_exclusions(rows, path)
    return tables.read_csv(spark, path, types={"row_number": "long"}, multi_line=False)


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def written_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table through the Parquet sink, which never overwrites."""
    path = _folder(spark, "table")
    sinks.write_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), path)
    return spark.read.parquet(path)


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 9) AS total FROM embeddings")
def npz_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors through bundles of arrays."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = bundles.npz_rows(bundles.npz_bundles(e), "vec_id long, embedding array<float>, label int", ("vec_id", "embedding", "label"))
    return rows.select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 9).alias("total"))


@query("SELECT 'page' || page_id || '.html' AS member, octet_length(encode(html)) AS bytes, sha256(html) AS sha256 FROM pages")
def zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through ZIP archives, checked member by member."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html")).alias("member"), F.col("html").cast("binary").alias("content"))
    return bundles.zip_members(bundles.zip_archives(pages)).select("member", "bytes", "sha256")


@query("SELECT 'p' || p_partkey AS path, CASE WHEN p_size % 3 < 2 THEN 'png' END AS format, CASE WHEN p_size % 3 < 2 THEN p_partkey % 5000 + 1 END AS width, CASE WHEN p_size % 3 < 2 THEN p_size::BIGINT END AS height FROM part")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats and sizes from the first bytes of images, a third of which are none."""
    number = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    head = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), number(F.col("p_partkey") % 5000 + 1), number(F.col("p_size").cast("long")), F.unhex(F.lit("08")))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.when(F.col("p_size") % 3 < 2, head).otherwise(F.lit("text").cast("binary")).alias("content"))
    return bundles.image_headers(files)


@query("SELECT n_name AS name, sha256(n_name || '!') AS sha256, CASE WHEN n_regionkey <> 2 THEN sha256(n_name || CASE n_regionkey WHEN 1 THEN '?' ELSE '!' END) END AS got FROM nation WHERE n_regionkey IN (1, 2)")
def digest_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected files that are missing or differ."""
    n = table(spark, sf_dir, "nation")
    digest = lambda mark: F.sha2(F.concat("n_name", mark), 256).alias("sha256")
    expected = n.select(F.col("n_name").alias("name"), digest(F.lit("!")))
    found = n.where("n_regionkey <> 2").select(F.col("n_name").alias("name"), digest(F.when(F.col("n_regionkey") == 1, F.lit("?")).otherwise(F.lit("!"))))
    return tables.verify_digests(found, expected, "name").select("name", F.col("wanted").alias("sha256"), "got")


@query("SELECT 'r' || a.n_regionkey || ':' || a.n_name AS left_id, 'r' || b.n_regionkey || ':' || b.n_name AS right_id, 'r' || a.n_regionkey AS namespace FROM nation a JOIN nation b ON a.n_nationkey + 1 = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey")
def cross_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring nations whose namespaced names have different namespaces."""
    n = table(spark, sf_dir, "nation")
    names = {r: text.namespaced(f"r{r}", "n_name") for r in range(5)}  # fixed value: the regions
    named = n.withColumn("id", F.coalesce(*(F.when(F.col("n_regionkey") == r, c) for r, c in names.items())))
    left, right = (named.select((F.col("n_nationkey") + d).alias("k"), F.col("id").alias(f"{side}_id")) for side, d in (("left", 1), ("right", 0)))
    pairs = joins.cross_namespace(left.join(right, "k"), "id")
    return pairs.select("left_id", "right_id", text.namespace_of("left_id").alias("namespace"))


_SCALES = (1.0, 0.9, 0.75, 0.5)


@query(f"""WITH s AS (SELECT p_partkey, p_size::BIGINT + 100 AS w, 2 * p_size::BIGINT + 51 AS h, [{', '.join(f'{x}::DOUBLE' for x in _SCALES)}][('0x' || substr(sha256('7:3:' || p_partkey), 1, 15))::BIGINT % {len(_SCALES)} + 1] AS scale FROM part),
  c AS (SELECT *, round_even(w * scale, 0)::BIGINT AS cw, round_even(h * scale, 0)::BIGINT AS ch FROM s) SELECT p_partkey, scale, ((w - cw) // 2)::INTEGER AS "left", ((h - ch) // 2)::INTEGER AS top, cw::INTEGER AS width, ch::INTEGER AS height FROM c""")
def view_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's view in epoch 3 under seed 7: a scale by hash, and its central crop."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 100).alias("w"), (2 * F.col("p_size") + 51).alias("h"))
    p = p.withColumn("scale", sample.chosen_scale(F.col("p_partkey"), 7, 3, _SCALES))
    return p.select("p_partkey", "scale", sample.centre_crop(F.col("w"), F.col("h"), F.col("scale")).alias("c")).select("p_partkey", "scale", "c.*")


def _grey_png(width: int, rows: list[bytes]) -> bytes:
    """A PNG of grey rows."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")


@query("SELECT 'p' || p_partkey AS path, CASE p_partkey % 5 WHEN 1 THEN 'cut off' WHEN 2 THEN 'checksum of IDAT' WHEN 3 THEN 'pixels' WHEN 4 THEN 'unknown format' END AS fault FROM part")
def image_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images made of part names, four in five of them faulty in one way or another."""

    def draw(batches):
        for batch in batches:
            out = []
            for key, name in zip(batch["p_partkey"], batch["p_name"]):
                raw, kind = name.encode(), key % 5
                png = _grey_png(len(raw) + (kind == 3), [raw, raw[::-1]])
                at = png.index(b"IDAT") + 6
                out.append(png if kind in (0, 3) else png[:-7] if kind == 1 else png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :] if kind == 2 else raw)
            yield pd.DataFrame({"path": [f"p{k}" for k in batch["p_partkey"]], "content": out})

    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return bundles.image_faults(part.mapInPandas(draw, "path string, content binary"))


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS place, c_nationkey AS n FROM customer), r AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS place, s_nationkey AS n FROM supplier)
  SELECT place, CASE WHEN l.place IS NULL THEN 'right_only' WHEN r.place IS NULL THEN 'left_only' ELSE 'n' END AS problem FROM l FULL JOIN r USING (place) WHERE l.n IS DISTINCT FROM r.n OR l.place IS NULL OR r.place IS NULL""")
def positional_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers, place by place: which nations differ."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    return joins.positional_mismatches(c, s, "k", ["n"])

"""Queries over rows: sources, projections, predicates, joins, aggregates, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import numeric, text
from curatrix.functions.session import checkpoint_folder
from curatrix.operators import classify, joins, sets, split, windows
from curatrix.operators.expectations import check, report, single_value_check, unique_check
from curatrix.plans.bridge import PRIORITIES, manifest, one_hot, orders, table, with_views
from curatrix.plans.catalogue import query
from curatrix.sources.tables import read_csv, read_json


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(with_views("b_hashed") + " SELECT image_name, image_path, sha256, perceptual_hash, group_id, collection_id, source_label, target FROM b_hashed")
def scan_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).drop("ord")


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV and read by its header: identifiers stay text, numbers have their declared type."""
    path = _scratch(spark, "customer-csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").write.csv(path, header=True)
    return read_csv(spark, path, types={"c_nationkey": "int"}, required=("c_custkey", "c_name"))


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k, '' AS missing_branch FROM events")
def scan_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records flattened with defaults: a missing branch is ''."""
    parsed = F.from_json("props", "struct<k:bigint, meta:struct<acquisition:struct<kind:string>>>")
    events = table(spark, sf_dir, "events").withColumn("_r", parsed)
    return events.select("event_id", F.col("_r.k").alias("k"), *classify.flatten_record(F.col("_r"), {"missing_branch": "meta.acquisition.kind"}))


@query("SELECT n_nationkey, n_name FROM nation")
def scan_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "nation-json")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").coalesce(1).write.option("lineSep", "\n").json(path)
    return read_json(spark, path, "n_nationkey int, n_name string", lines=True)


@query(
    with_views("b_manifest")
    + """ SELECT image_name, CASE WHEN ord % 41 = 0 THEN 'image_not_found' WHEN ord % 37 = 0 THEN 'source_duplicate_of:' || format('doc_{:06d}', ord - 1)
      WHEN ord % 29 = 0 THEN 'missing_group_id' WHEN source_label IS NULL THEN 'unmapped_label:blank' WHEN ord % 31 = 0 THEN 'invalid_image' END AS reason FROM b_manifest"""
)
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir, fingerprint=False)
    n = F.col("ord")
    reason = classify.exclusion_reason(
        name=F.col("image_name"),
        found=n % 41 != 0,
        duplicate_of=F.when(n % 37 == 0, F.format_string("doc_%06d", n - 1)),
        group=F.when(n % 29 == 0, F.lit(" \t")).otherwise(F.col("group_id")),
        label=F.col("source_label"),
        mapped=F.col("source_label").isNotNull(),
        valid=n % 31 != 0,
    )
    return m.select("image_name", reason.alias("reason"))


@query("SELECT doc_id, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END AS curated_label, quality::INTEGER AS target FROM documents LEFT JOIN labels USING (doc_id)")
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    raw = F.when(F.col("quality") == 1, F.lit(" High ")).when(F.col("quality") == 0, F.lit("LOW"))
    mapping = spark.createDataFrame([("high", 1, "good"), ("low", 0, "poor")], "raw_label string, target int, curated_label string")
    return classify.map_labels(docs.withColumn("raw", raw), "raw", mapping).select("doc_id", "curated_label", "target")


@query("""SELECT p_partkey::VARCHAR AS image_name, p_brand AS group_id, CASE WHEN p_partkey % 3 = 0 THEN 'set default' ELSE p_type END AS attribution, 'CC-0' AS license,
  'https://creativecommons.org/publicdomain/zero/1.0/' AS license_url FROM part""")
def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumns({"key": F.col("p_partkey").cast("string"), "owner": F.when(F.col("p_partkey") % 3 == 0, F.lit("  ")).otherwise(F.col("p_type"))})
    made = classify.canonical_record(part, {"image_name": "key", "group_id": "p_brand"}, {"license": "CC-0", "attribution": "set default"}, {"attribution": "owner"})
    return made.withColumn("license_url", classify.license_url(F.col("license"), {"CC-0": "https://creativecommons.org/publicdomain/zero/1.0/"}))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def eligibility_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, sf_dir, "customer").where("c_acctbal > 0 and c_mktsegment = 'BUILDING'").join(urgent, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT count(*) FILTER (l_quantity > 25) AS big, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_discount = 0 AND l_tax = 0) AS plain FROM lineitem")
def filter_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return classify.waterfall(table(spark, sf_dir, "lineitem"), {"big": c("l_quantity") > 25, "returned": c("l_returnflag") == "R", "plain": (c("l_discount") == 0) & (c("l_tax") == 0)})


@query(
    with_views("b_onehot")
    + " SELECT record_id, urgent + high + medium + unspecified + low = 1 AS valid, CASE WHEN urgent = 1 THEN 'urgent' WHEN high = 1 THEN 'high' WHEN medium = 1 THEN 'medium' WHEN unspecified = 1 THEN 'unspecified' ELSE 'low' END AS cls FROM b_onehot"
)
def onehot_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = list(PRIORITIES.values())
    return one_hot(spark, sf_dir).select("record_id", classify.one_hot_valid(names).alias("valid"), classify.one_hot_class(names).alias("cls"))


@query("SELECT o_orderkey AS record_id, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INTEGER AS target_soon, (o_orderpriority = '5-LOW')::INTEGER AS target_late FROM orders")
def derived_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = classify.derived_targets("o_orderpriority", {"target_soon": ["1-URGENT", "2-HIGH"], "target_late": ["5-LOW"]})
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), *(v.alias(k) for k, v in made.items()))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_size % 5 = 0 THEN 'melanoma' WHEN p_size % 5 = 1 THEN 'atypical' WHEN p_size % 5 = 2 THEN 'benign' END AS reference FROM part""")
def reference_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 5 == 0, F.lit("Melanoma in situ")).when(F.col("p_size") % 5 == 1, F.lit("Dysplastic nevus")).when(F.col("p_size") % 5 == 2, F.lit("Nevus")).otherwise(F.lit("Cyst"))
    part = table(spark, sf_dir, "part").withColumns({"confirm": F.when(F.col("p_partkey") % 4 == 0, F.lit("consensus")).otherwise(F.lit(" Histopathology ")), "d1": F.lit("Benign"), "d2": kind})
    return part.select("p_partkey", classify.reference_class(F.col("confirm"), [F.col("d1"), F.col("d2")]).alias("reference"))


@query("SELECT page_id, regexp_matches(url, '^https://[^/?#]+/') AS https_allowed, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM pages")
def url_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.url_allowed("url").alias("https_allowed"), F.try_parse_url("url", F.lit("HOST")).alias("host"))


@query("""SELECT p_partkey, p_partkey % 5 NOT IN (1, 2, 3) AS safe, CASE WHEN p_partkey % 5 NOT IN (1, 2, 3) THEN 'base/' || (CASE p_partkey % 5 WHEN 0 THEN 'a/' || p_partkey || '.jpg' ELSE 'b..c/' || p_partkey END) END AS prefixed FROM part""")
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    path = F.when(r == 0, F.concat(F.lit("a/"), k, F.lit(".jpg"))).when(r == 1, F.concat(F.lit("/abs/"), k)).when(r == 2, F.concat(F.lit("source/../"), k)).when(r == 3, F.concat(F.lit("C:\\x\\"), k)).otherwise(F.concat(F.lit("b..c/"), k))
    part = table(spark, sf_dir, "part").withColumn("path", path)
    return part.select("p_partkey", text.is_safe_relative_path("path").alias("safe"), text.prefixed_path("base", "path").alias("prefixed"))


@query("SELECT o_orderkey, try_cast(split_part(o_orderpriority, '-', 1) AS INTEGER) AS priority, try_cast(o_orderstatus AS DOUBLE) AS status, o_totalprice BETWEEN 0 AND 1 AS is_probability FROM orders")
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("head", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)))
    return o.select("o_orderkey", classify.to_number("head", "int").alias("priority"), classify.to_number("o_orderstatus").alias("status"), numeric.is_probability(F.col("o_totalprice")).alias("is_probability"))


@query("""SELECT s_suppkey, trim(s_name) AS stripped, lower(s_name) AS label, CASE WHEN s_suppkey % 2 = 0 THEN 'none' ELSE s_name END AS defaulted, regexp_replace(s_name, '1$', '') AS cut,
  'file' || s_suppkey AS stem, '.jpg' AS suffix, 'fold_' || (s_suppkey % 4) AS fold, lpad(s_suppkey::VARCHAR, 5, '0') AS padded FROM supplier""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        text.strip(F.concat(F.lit("\t "), "s_name", F.lit(" \n"))).alias("stripped"),
        text.normalized_label(F.concat("s_name", F.lit(" "))).alias("label"),
        text.default_if_blank(F.when(F.col("s_suppkey") % 2 == 0, F.lit("\t")).otherwise(F.col("s_name")), F.lit("none")).alias("defaulted"),
        text.without_suffix("s_name", "1").alias("cut"),
        text.file_stem(F.concat(F.lit("a/b.c/file"), k, F.lit(".JPG"))).alias("stem"),
        text.file_suffix(F.concat(F.lit("a/b.c/file"), k, F.lit(".JPG"))).alias("suffix"),
        F.concat(F.lit("fold_"), (F.col("s_suppkey") % 4).cast("string")).alias("fold"),
        F.lpad(k, 5, "0").alias("padded"),
    )


@query("""SELECT c_custkey, sha256('oof-v1' || chr(0) || '2026' || chr(0) || c_custkey) AS order_key,
  CASE WHEN ('0x' || substr(sha256('7:' || c_custkey), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.3 THEN 'calibration' ELSE 'test' END AS partition_name,
  (('0x' || substr(sha256('7:cv:' || c_custkey), 1, 16))::UBIGINT % 5)::INTEGER AS fold FROM customer""")
def hash_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys, hash partitions and hash folds."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        text.order_key(F.col("c_custkey").cast("string"), 2026, split.PLAN_DOMAIN).alias("order_key"),
        split.hash_partition("c_custkey", 7, 0.3).alias("partition_name"),
        text.hash_fold("c_custkey", 7, 5).alias("fold"),
    )


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md5, regexp_matches(sha256(text), '^[0-9a-f]{64}$') AS valid FROM documents")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5(F.col("text").cast("binary")).alias("md5"), text.is_sha256(F.sha2("text", 256)).alias("valid"))


@query("SELECT n_regionkey, count(DISTINCT n_name) AS n, sha256(string_agg(length(n_name) || ':' || n_name || chr(10), '' ORDER BY n_name)) AS digest FROM nation GROUP BY n_regionkey")
def id_set_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count_distinct("n_name").alias("n"), text.id_set_digest("n_name").alias("digest"))


@query("""SELECT vec_id, round(1 / (1 + exp(-greatest(-50, least(50, x)))), 9) AS squashed, round(ln(greatest(1e-8, least(1 - 1e-8, p)) / (1 - greatest(1e-8, least(1 - 1e-8, p)))), 9) AS logit,
  round(1 / (1 + exp(-(1.75 * x - 0.5))), 9) AS affine, round(1 / (1 + exp(-x / 2.0)), 9) AS cooled, round(x * x, 9) AS square, round(x * p, 9) AS product, nextafter(x, 'infinity'::DOUBLE) > x AS next_is_larger,
  round(((x * 1.75 + 0.25) - 0.25) / 1.75, 9) AS restored FROM (SELECT vec_id, embedding[1]::DOUBLE * 4 AS x, embedding[2]::DOUBLE + 0.5 AS p FROM embeddings)""")
def score_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 4).alias("x"), (F.col("embedding")[1].cast("double") + 0.5).alias("p"))
    x, p = F.col("x"), F.col("p")
    features = numeric.quadratic_features([x, p])
    r = lambda c: F.round(c, 9)
    return e.select(
        "vec_id",
        r(numeric.sigmoid(x)).alias("squashed"),
        r(numeric.logit(p)).alias("logit"),
        r(numeric.calibrated(x, {"method": "affine_logistic_scaling", "logit_scale": 1.75, "logit_bias": -0.5})).alias("affine"),
        r(numeric.calibrated(x, {"method": "temperature_scaling", "temperature": 2.0})).alias("cooled"),
        r(features[2]).alias("square"),
        r(features[3]).alias("product"),
        (numeric.next_up(x) > x).alias("next_is_larger"),
        r(numeric.inverse_affine(numeric.affine(x, 1.75, 0.25), 1.75, 0.25)).alias("restored"),
    )


@query("""SELECT l_orderkey, l_linenumber, (CASE WHEN l_quantity::BIGINT % 2 = 0 THEN l_quantity / 2 ELSE (l_quantity - 1) / 2 + ((((l_quantity - 1) / 2)::BIGINT % 2)) END)::BIGINT AS half_even, round(l_quantity / 2)::BIGINT AS half_away FROM lineitem""")
def rounding_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.col("l_quantity") / 2
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numeric.round_half_even(half).alias("half_even"), numeric.round_half_away(half).alias("half_away"))


@query("SELECT vec_id, i, x FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings)")
def explode_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumns({"i": F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")), "x": F.col("embedding")})
    return classify.explode_arrays(e, ["i", "x"], ["vec_id"])


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def collect_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return n.groupBy("n_regionkey").agg(F.array_join(F.transform(rows, lambda x: x["n_name"]), ",").alias("names"))


# ---- joins


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def checked_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.checked_join(table(spark, sf_dir, "nation"), region, ["n_regionkey"], cardinality="n:1").select("n_nationkey", "n_name", "r_name")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def one_to_one_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.repeated_keys(table(spark, sf_dir, "orders"), ["o_custkey"])


@query("""SELECT o_orderkey, problem FROM (
  SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, [CASE WHEN b.o_orderkey IS NULL THEN 'left_only' END, CASE WHEN a.o_orderkey IS NULL THEN 'right_only' END,
    CASE WHEN a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND a.s IS DISTINCT FROM b.s THEN 'o_orderstatus' END] AS ps
  FROM (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 17 <> 0) a
  FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 13 <> 0) b USING (o_orderkey)), unnest(ps) t(problem) WHERE problem IS NOT NULL""")
def reconcile_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    right = o.where("o_orderkey % 13 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 19 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")))
    return joins.reconcile(o.where("o_orderkey % 17 <> 0"), right, ["o_orderkey"], ["o_orderstatus"])


@query("""SELECT l.n_nationkey AS left_id, r.n_nationkey AS right_id, l.n_regionkey AS left_split, r.n_regionkey AS right_split, l.n_regionkey = r.n_regionkey AS same_split
  FROM nation l JOIN nation r ON r.n_nationkey = l.n_nationkey + 1 WHERE l.n_nationkey <> 5 AND r.n_nationkey <> 5""")
def pair_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension values at both ends of pairs, and pairs whose ends are both kept."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("split"))
    pairs = n.select(F.col("id").alias("left_id"), (F.col("id") + 1).alias("right_id"))
    looked = joins.lookup_both_ends(joins.both_ends_in(pairs, n.where("id <> 5"), "id"), n, "id", "split")
    return joins.flag_same(looked, "split", "same_split").select("left_id", "right_id", "left_split", "right_split", "same_split")


@query("SELECT s_suppkey, s_acctbal, round(s_acctbal / total, 9) AS share FROM supplier, (SELECT sum(abs(s_acctbal)) AS total FROM supplier)")
def scalar_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    total = s.agg(F.sum(F.abs("s_acctbal")).alias("total"))
    return joins.with_scalars(s, total).select("s_suppkey", "s_acctbal", F.round(F.col("s_acctbal") / F.col("total"), 9).alias("share"))


# ---- aggregates and windows


@query("SELECT o_custkey AS group_id, count(DISTINCT o_orderstatus) AS n_splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def group_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.leaking_groups(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderstatus").alias("split")), "group_id")


@query(with_views("b_orders") + " SELECT group_id, count(DISTINCT source_id) AS source_count, min(source_id) AS source_id, max(target) AS group_target, count(*) AS records FROM b_orders GROUP BY group_id")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.group_summary(orders(spark, sf_dir), "group_id", "source_id", "target")


@query("SELECT l_returnflag, l_linestatus, l_returnflag || '|' || l_linestatus AS key, count(*) AS n FROM lineitem GROUP BY ALL")
def multi_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return li.withColumn("key", F.concat_ws("|", "l_returnflag", "l_linestatus"))


@query("SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source is not null").groupBy(F.col("source").alias("value")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END) AS urgent_customers, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS finished, round(quantile_cont(o_totalprice, 0.5), 6) AS median_price FROM orders")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), F.col
    return o.agg(
        F.count_distinct(F.when(c("o_orderpriority") == "1-URGENT", c("o_custkey"))).alias("urgent_customers"),
        F.sum((c("o_orderstatus") == "F").cast("int")).cast("long").alias("finished"),
        F.round(F.percentile("o_totalprice", F.lit(0.5)), 6).alias("median_price"),
    )


@query("""SELECT * FROM (VALUES ('single_region', (SELECT count(DISTINCT n_regionkey) = 1 FROM nation), (SELECT count(DISTINCT n_regionkey) - 1 FROM nation)),
  ('unique_name', true, 0), ('known_region', true, 0)) t("check", ok, n_bad)""")
def expectation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return report([single_value_check(n, "single_region", "n_regionkey"), unique_check(n, "unique_name", "n_name"), check(n, "known_region", F.col("n_regionkey").between(0, 4), "n_name")]).drop("examples")


@query("SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) > 1 AS duplicated FROM documents")
def duplicated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return windows.duplicated(docs, ["sha"]).select("doc_id", "duplicated")


@query("""SELECT score, n, sum(n) OVER (ORDER BY score)::BIGINT AS run_n, sum(c0) OVER (ORDER BY score)::BIGINT AS run_c0 FROM (
  SELECT l_quantity AS score, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS c0 FROM lineitem GROUP BY 1)""")
def running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("t", F.when(F.col("l_returnflag") == "A", 0).otherwise(1))
    scores = windows.by_distinct_score(li, "l_quantity", "t")
    return windows.running(scores, ["n", "c0"], "score").select("score", "n", "run_n", "run_c0")


@query("SELECT user_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.operators.sample import first_per_key as first

    return first(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"])


@query("SELECT o_orderkey, place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders) WHERE place IN (SELECT floor(i * (n - 1) / 9.0)::BIGINT FROM range(10) r(i), (SELECT count(*) AS n FROM orders))")
def spaced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curatrix.operators.sample import spaced_sample as spaced

    return spaced(table(spark, sf_dir, "orders").select("o_orderkey"), 10, "o_orderkey").select("o_orderkey", F.col("place").cast("long").alias("place"))


# ---- sets


@query("""SELECT 'lang' AS "column", (SELECT count(DISTINCT lang) FROM documents) AS reference, 1::BIGINT AS candidate, 1::BIGINT AS overlap, 0::BIGINT AS "unique"
  UNION ALL SELECT 'source', (SELECT count(DISTINCT source) FROM documents), (SELECT count(DISTINCT source) FROM documents WHERE lang = 'en'), (SELECT count(DISTINCT source) FROM documents WHERE lang = 'en'), 0""")
def overlap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "source")
    return sets.overlap_audit(docs, docs.where("lang = 'en'"), ("lang", "source"))


@query("""SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS left_only, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS right_only,
  (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AND (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AS equal""")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return sets.set_differences(left, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def set_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return sets.complement(table(spark, sf_dir, "customer").select("c_custkey"), urgent, "c_custkey").distinct()


@query("SELECT NULL::DOUBLE AS balance, n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT s_acctbal, NULL, s_name FROM supplier")
def union_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union over the sorted union of columns."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return split.union_columns([n, s])


@query("SELECT count(*) AS n FROM lineitem")
def row_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table; its checksum (beside it in the operator) is the same for any order of rows."""
    from curatrix.operators.provenance import fast_checksum

    li = table(spark, sf_dir, "lineitem")
    one, other = fast_checksum(li), fast_checksum(li.orderBy(F.desc("l_quantity")))
    return one.join(other, ["n", "checksum"]).select("n")

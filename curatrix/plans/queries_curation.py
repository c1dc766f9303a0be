"""Queries about duplicates, components, gates, provenance and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import text
from curatrix.functions.session import checkpointed
from curatrix.operators import curation, dedup, joins, policies, provenance, split
from curatrix.operators.skew import spread_join
from curatrix.plans.bridge import manifest, orders, predictions, requests, table, views, with_views
from curatrix.plans.catalogue import query

#: Bits that near-duplicate records may differ in.
NEAR = 6

_PAIRS = f"""
pairs AS (SELECT l.image_name AS left_image_name, r.image_name AS right_image_name, l.group_id AS left_group_id, r.group_id AS right_group_id, l.collection_id AS left_collection_id, r.collection_id AS right_collection_id,
    bit_count(xor(('0x' || l.perceptual_hash)::UBIGINT, ('0x' || r.perceptual_hash)::UBIGINT))::INTEGER AS hamming_distance
  FROM b_hashed l JOIN b_hashed r ON l.ord < r.ord AND bit_count(xor(('0x' || l.perceptual_hash)::UBIGINT, ('0x' || r.perceptual_hash)::UBIGINT)) <= {NEAR})"""


#: Pairs of records, counted between the smallest records of their hashes.
_LINKS = """, f AS (SELECT perceptual_hash, min(image_name) AS first FROM b_hashed GROUP BY 1), w AS (SELECT image_name, first FROM b_hashed JOIN f USING (perceptual_hash)),
  s AS (SELECT group_id, CASE ('0x' || substr(sha256('11:cv:' || group_id), 1, 16))::UBIGINT % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM (SELECT DISTINCT group_id FROM b_hashed)),
  k AS (SELECT least(a.first, b.first) AS left_image_name, greatest(a.first, b.first) AS right_image_name, hamming_distance, count(*) AS pairs, count(*) FILTER (left_group_id = right_group_id) AS group_id_same,
      count(*) FILTER (l.split <> r.split) AS split_differ, count(*) FILTER (left_collection_id <> right_collection_id) AS collection_id_differ
    FROM pairs JOIN w a ON a.image_name = left_image_name JOIN w b ON b.image_name = right_image_name JOIN s l ON l.group_id = left_group_id JOIN s r ON r.group_id = right_group_id GROUP BY ALL)"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest with a hash split by group."""
    return manifest(spark, sf_dir).withColumn("split", split.folds_to_splits(text.hash_fold("group_id", 11, 5)))


@query(with_views("b_hashed") + "," + _PAIRS + _LINKS + " SELECT left_image_name, right_image_name, hamming_distance, pairs, group_id_same, split_differ FROM k")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate records between the smallest records of their hashes: how many pairs, in one group, and parted by a hash split."""
    m = checkpointed(_split(spark, sf_dir).select("image_name", "perceptual_hash", "group_id", "split"))
    links = joins.near_duplicate_links(m, NEAR, ("group_id", "split"))
    return links.select("left_image_name", "right_image_name", "hamming_distance", "pairs", "group_id_same", "split_differ")


@query(with_views("b_hashed") + ", f AS (SELECT perceptual_hash, min(image_name) AS first, count(*) AS records FROM b_hashed GROUP BY 1) SELECT image_name, first, records FROM b_hashed JOIN f USING (perceptual_hash)")
def near_dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class (smallest record of the hash) that each record belongs to in ``near_dup_pairs``."""
    m = checkpointed(manifest(spark, sf_dir).select("image_name", "perceptual_hash"))
    classes = joins.hash_classes(m, "image_name", "perceptual_hash").withColumnRenamed("hash", "perceptual_hash")
    return spread_join(m, classes, "perceptual_hash", "image_name").select("image_name", "first", "records")


@query(with_views("b_hashed") + "," + _PAIRS + _LINKS + " SELECT left_image_name, right_image_name, hamming_distance, collection_id_differ FROM k WHERE collection_id_differ > 0")
def cross_source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate records of different sources, counted between the smallest records of their hashes."""
    m = checkpointed(manifest(spark, sf_dir).select("image_name", "perceptual_hash", "collection_id"))
    links = joins.near_duplicate_links(m, NEAR, ("collection_id",))
    return links.where("collection_id_differ > 0").select("left_image_name", "right_image_name", "hamming_distance", "collection_id_differ")


@query(with_views("b_manifest") + " SELECT image_name, sha256 FROM b_manifest WHERE sha256 IN (SELECT sha256 FROM b_manifest GROUP BY sha256 HAVING count(*) > 1)")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(manifest(spark, sf_dir, fingerprint=False)).select("image_name", "sha256")


@query(with_views("b_manifest") + """ SELECT sha256, count(*) AS records, count(DISTINCT group_id) AS n_group_id, count(DISTINCT collection_id) AS n_collection_id FROM b_manifest GROUP BY sha256
  HAVING count(*) > 1 AND (count(DISTINCT group_id) > 1 OR count(DISTINCT collection_id) > 1)""")
def conflicting_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.conflicting_duplicates(manifest(spark, sf_dir, fingerprint=False), ("group_id", "collection_id"))


@query(with_views("b_manifest") + """ SELECT image_name, survivor, 'exact_duplicate_of:' || survivor AS reason FROM (
  SELECT image_name, min(image_name) OVER (PARTITION BY sha256, collection_id) AS survivor FROM b_manifest) WHERE image_name <> survivor""")
def exact_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicate_exclusions(manifest(spark, sf_dir, fingerprint=False), ("collection_id",))


_PROTECTED = """, p AS (SELECT * FROM b_manifest WHERE ord % 3 = 0), n AS (SELECT * FROM b_manifest WHERE ord % 3 <> 0), rest AS (SELECT * FROM n WHERE sha256 NOT IN (SELECT sha256 FROM p)),
  g AS (SELECT sha256, count(DISTINCT target) AS t, min(image_name) AS f FROM rest GROUP BY sha256 HAVING count(*) > 1)
  SELECT image_name, 'exact_duplicate_of_protected' AS reason FROM n WHERE sha256 IN (SELECT sha256 FROM p)
  UNION ALL SELECT image_name, 'exact_duplicate_conflicting_labels' FROM rest JOIN g USING (sha256) WHERE t > 1
  UNION ALL SELECT image_name, 'exact_duplicate_redundant' FROM rest JOIN g USING (sha256) WHERE t <= 1 AND image_name <> f"""


@query(with_views("b_manifest") + _PROTECTED)
def protected_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir, fingerprint=False)
    return dedup.protected_exclusions(m.where("ord % 3 <> 0"), m.where("ord % 3 = 0"))


@query("""WITH p AS (SELECT n_nationkey AS a, n_nationkey + 1 AS b FROM nation WHERE n_nationkey % 2 = 0), e AS (SELECT p.*, x.n_regionkey AS ga, y.n_regionkey AS gb, lower(trim(x.n_name)) AS ya, lower(trim(y.n_name)) AS yb
    FROM p LEFT JOIN nation x ON x.n_nationkey = a LEFT JOIN nation y ON y.n_nationkey = b),
  c AS (SELECT (SELECT count(*) FROM (SELECT a FROM p GROUP BY a HAVING count(*) > 1)) AS c0, (SELECT count(*) FROM (SELECT b FROM p GROUP BY b HAVING count(*) > 1)) AS c1, (SELECT count(*) FROM p WHERE a IS NULL OR b IS NULL) AS c2,
    (SELECT count(*) FROM (SELECT a FROM p INTERSECT SELECT b FROM p)) AS c3, (SELECT count(*) FROM e WHERE ga IS NULL OR gb IS NULL) AS c4, (SELECT count(*) FROM e WHERE NOT coalesce(ga = gb, false)) AS c5, (SELECT count(*) FROM e WHERE NOT coalesce(ya = yb, false)) AS c6)
  SELECT "check", n_bad = 0 AS ok, n_bad FROM (SELECT unnest(['first_names_disjoint', 'second_names_disjoint', 'pair_names_not_blank', 'pairs_not_chained', 'pair_names_known', 'pair_in_one_group', 'pair_has_one_label']) AS "check",
    unnest([c0, c1, c2, c3, c4, c5, c6]) AS n_bad FROM c)""")
def official_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given pairs of neighbouring nations (the last one's neighbour is unknown), checked against region and name."""
    nation = table(spark, sf_dir, "nation")
    n = nation.select(F.col("n_nationkey").cast("string").alias("image_name"), F.col("n_regionkey").alias("group_id"), F.col("n_name").alias("source_label"))
    pairs = nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("image_name_1"), (F.col("n_nationkey") + 1).cast("string").alias("image_name_2"))
    return dedup.official_pair_checks(pairs, n).drop("examples")


_COMPONENTS = """, e AS (SELECT left_image_name AS a, right_image_name AS b FROM pairs UNION SELECT right_image_name, left_image_name FROM pairs),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
stars AS (SELECT a AS node, least(a, min(b)) AS root FROM reach GROUP BY a),
sizes AS (SELECT root, count(*) AS size, row_number() OVER (ORDER BY root) AS component_no FROM stars GROUP BY root)"""


@query(with_views("b_hashed", recursive=True) + "," + _PAIRS + _COMPONENTS + " SELECT node, root, component_no, size FROM stars JOIN sizes USING (root)")
def near_dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate records: hash links, each hash standing for its copies, then copies joined."""
    return _members(spark, sf_dir)


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = checkpointed(manifest(spark, sf_dir).select("image_name", "perceptual_hash"))
    return dedup.near_duplicate_components(m, NEAR)


_SURVIVORS = """, mm AS (SELECT stars.*, target, collection_id, length(collection_id) AS rank FROM stars JOIN b_hashed ON node = image_name),
  s AS (SELECT root, count(DISTINCT target) AS t, arg_min(node, struct_pack(r := rank, n := node)) AS best FROM mm GROUP BY root)
  SELECT node, CASE WHEN t = 1 THEN best END AS retained, CASE WHEN t <> 1 THEN 'near_duplicate_component_conflicting_labels' WHEN node <> best THEN 'near_duplicate_component_redundant' END AS reason FROM mm JOIN s USING (root)"""


@query(with_views("b_hashed", recursive=True) + "," + _PAIRS + _COMPONENTS + _SURVIVORS)
def component_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir, fingerprint=False).select(F.col("image_name").alias("node"), "target", "collection_id")
    members = _members(spark, sf_dir).join(m, "node")
    return dedup.component_survivors(members, "target", [F.length("collection_id")]).select("node", "retained", "reason")


_GUARDED = """, mm AS (SELECT stars.*, target, collection_id, length(collection_id) AS rank, collection_id = 'src0' AS guard FROM stars JOIN b_hashed ON node = image_name),
  s AS (SELECT root, count(DISTINCT CASE WHEN NOT guard THEN coalesce(target, 2) END) AS t, bool_or(guard) AS any_, min(CASE WHEN guard THEN node END) AS g, arg_min(node, struct_pack(r := rank, n := node)) FILTER (NOT guard) AS best FROM mm GROUP BY root)
  SELECT node, CASE WHEN any_ THEN g WHEN t = 1 THEN best END AS retained, CASE WHEN guard THEN NULL WHEN any_ THEN 'near_duplicate_of_protected' WHEN t <> 1 THEN 'near_duplicate_component_conflicting_labels' WHEN node <> best THEN 'near_duplicate_component_redundant' END AS reason FROM mm JOIN s USING (root)"""


@query(with_views("b_hashed", recursive=True) + "," + _PAIRS + _COMPONENTS + _GUARDED)
def protected_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors of components in which the records of one source are protected."""
    m = manifest(spark, sf_dir, fingerprint=False).select(F.col("image_name").alias("node"), F.coalesce("target", F.lit(2)).alias("target"), "collection_id")
    members = _members(spark, sf_dir).join(m, "node")
    return dedup.component_survivors(members, "target", [F.length("collection_id")], protected=F.col("collection_id") == "src0").select("node", "retained", "reason")


@query(with_views("b_hashed") + "," + _PAIRS + _LINKS + ", q AS (SELECT image_name FROM b_hashed WHERE target = 1) SELECT left_image_name, right_image_name, pairs FROM k WHERE left_image_name IN (FROM q) AND right_image_name IN (FROM q)")
def remaining_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes both of whose smallest records have the target 1."""
    m = checkpointed(manifest(spark, sf_dir).select("image_name", "perceptual_hash", "target"))
    return joins.near_duplicate_links(m, NEAR, ends=m.where("target = 1")).select("left_image_name", "right_image_name", "pairs")


@query(with_views("b_hashed") + "," + _PAIRS + """, x AS (SELECT CASE WHEN left_collection_id = 'src0' THEN right_image_name ELSE left_image_name END AS image_name FROM pairs WHERE (left_collection_id = 'src0') <> (right_collection_id = 'src0'))
  SELECT image_name FROM b_hashed WHERE collection_id <> 'src0' AND image_name NOT IN (SELECT image_name FROM x)""")
def decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of other sources that are near no record of the reference source."""
    m = checkpointed(manifest(spark, sf_dir).select("image_name", "perceptual_hash", "collection_id"))
    return dedup.decontaminated(m.where("collection_id <> 'src0'"), m.where("collection_id = 'src0'"), NEAR).select("image_name")


_PRE = """, d AS (SELECT *, CASE ('0x' || substr(sha256('11:cv:' || group_id), 1, 16))::UBIGINT % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM b_hashed),
  dup AS (SELECT count(*) AS n FROM d WHERE sha256 IN (SELECT sha256 FROM d GROUP BY sha256 HAVING count(*) > 1)),
  crossing AS (SELECT count(*) AS n FROM pairs JOIN d l ON l.image_name = left_image_name JOIN d r ON r.image_name = right_image_name WHERE l.split <> r.split),
  bad AS (SELECT count(*) FILTER (target IS NULL) AS n FROM d),
  missing AS (SELECT 3 - count(*) AS n FROM (SELECT split FROM d GROUP BY split HAVING count(DISTINCT target) = 2))
  SELECT "check", n = 0 AS ok, n::BIGINT AS n_bad FROM (
    SELECT unnest(['not_empty', 'image_name_unique', 'image_path_safe', 'sha256_valid', 'hash_valid', 'split_known', 'group_not_blank', 'group_in_one_split']) AS "check", 0 AS n
    UNION ALL SELECT 'target_binary', n FROM bad UNION ALL SELECT 'both_targets_in_split', n FROM missing UNION ALL SELECT 'no_exact_duplicates', n FROM dup UNION ALL SELECT 'no_near_duplicates_across_splits', n FROM crossing)"""


@query(with_views("b_hashed") + "," + _PAIRS + _PRE)
def preflight_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All preflight checks of a hash-split manifest: some hold, some fail."""
    m = checkpointed(_split(spark, sf_dir))
    return curation.preflight(m, joins.near_duplicate_links(m, NEAR, ("split",), totals=True)).drop("examples")


@query(with_views("b_manifest") + """, e AS (SELECT count(*) AS n, count(DISTINCT group_id) AS g FROM b_manifest)
  SELECT name, expected, observed, expected = observed AS ok FROM (SELECT unnest(['groups', 'images']) AS name, unnest([5::BIGINT, 1000]) AS expected, unnest([g, n]) AS observed FROM e)""")
def expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir, fingerprint=False)
    return curation.expected_counts(m, {"groups": 5, "images": 1000}, {"groups": F.count_distinct("group_id"), "images": F.count("*")})


_SHARED = " UNION ALL ".join(f"SELECT '{c}_disjoint' AS c, (SELECT count(*) FROM (SELECT {c} FROM b WHERE trim({c}) <> '' INTERSECT SELECT {c} FROM e)) AS n" for c in ("image_name", "group_id", "patient_id", "sha256"))
_SINGLE = " UNION ALL ".join(f"SELECT 'single_{c}', (SELECT count(DISTINCT {c}) - 1 FROM n)" for c in ("perceptual_hash_algorithm", "perceptual_hash_bits", "near_duplicate_hamming_threshold"))


@query(f"""WITH n AS (SELECT n_nationkey AS k, 'img' || n_nationkey AS image_name, 'g' || n_nationkey AS group_id, CASE n_nationkey WHEN 13 THEN ' ' WHEN 14 THEN 'p3' ELSE 'p' || n_nationkey END AS patient_id, sha256(n_name) AS sha256,
    'phash' AS perceptual_hash_algorithm, 64 AS perceptual_hash_bits, CASE WHEN n_nationkey < 12 THEN 6 ELSE 8 END AS near_duplicate_hamming_threshold FROM nation), b AS (SELECT * FROM n WHERE k < 12), e AS (SELECT * FROM n WHERE k >= 12),
  c AS ({_SHARED} UNION ALL SELECT 'blank_patient_declared', (SELECT count(*) FROM e WHERE trim(patient_id) = '') UNION ALL {_SINGLE}) SELECT c AS "check", n = 0 AS ok, n AS n_bad FROM c""")
def augmentation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("img"), F.col("n_nationkey").cast("string")).alias("image_name"),
        F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("group_id"),
        F.when(F.col("n_nationkey") == 13, F.lit(" ")).otherwise(F.concat(F.lit("p"), (F.when(F.col("n_nationkey") == 14, 3).otherwise(F.col("n_nationkey"))).cast("string"))).alias("patient_id"),
        F.sha2("n_name", 256).alias("sha256"),
        F.lit("").alias("patient_identifier_status"),
        F.lit("phash").alias("perceptual_hash_algorithm"),
        F.lit(64).alias("perceptual_hash_bits"),
        F.when(F.col("n_nationkey") < 12, 6).otherwise(8).alias("near_duplicate_hamming_threshold"),
        "n_nationkey",
    )
    return curation.augmentation_gate(n.where("n_nationkey < 12"), n.where("n_nationkey >= 12")).drop("examples")


@query(with_views("b_manifest") + """, c AS (SELECT max(image_name) AS m FROM b_manifest) SELECT 'purpose_is_evaluation' AS "check", true AS ok, 0::BIGINT AS n_bad UNION ALL SELECT 'training_forbidden', false, 1 UNION ALL
  SELECT 'records_as_declared', (SELECT count(*) FROM b_manifest) = 1000, ((SELECT count(*) FROM b_manifest) <> 1000)::BIGINT UNION ALL SELECT 'groups_as_declared', (SELECT count(DISTINCT group_id) FROM b_manifest) = 7, ((SELECT count(DISTINCT group_id) FROM b_manifest) <> 7)::BIGINT""")
def external_card_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = {"purpose": "external_evaluation_only", "training_authorized": True, "records": 1000, "groups": 7}
    return curation.external_card_gate(card, manifest(spark, sf_dir, fingerprint=False)).drop("examples")


@query("""WITH c AS (SELECT p_partkey, 'i' || p_partkey AS image_name, 'p' || (p_partkey % 97) AS patient_id, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'l' || (p_partkey % 97) END AS lesion_id FROM part WHERE p_size % 5 = 0 AND p_partkey % 11 <> 0),
  g AS (SELECT patient_id, CASE WHEN lesion_id = '' THEN image_name ELSE lesion_id END AS lesion_group, min(image_name) AS image_name FROM c GROUP BY ALL)
  SELECT image_name, patient_id, lesion_group, 'melanoma' AS class_name, sha256(image_name) AS image_sha256, CASE WHEN ('0x' || substr(sha256('3:' || patient_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.5 THEN 'calibration' ELSE 'test' END AS split FROM g""")
def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_size % 5 = 0")
    k = F.col("p_partkey")
    rows = part.select(
        F.concat(F.lit("i"), k.cast("string")).alias("image_name"),
        F.concat(F.lit("p"), (k % 97).cast("string")).alias("patient_id"),
        F.when(k % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit("l"), (k % 97).cast("string"))).alias("lesion_id"),
        F.lit("histopathology").alias("diagnosis_confirm_type"),
        F.lit("Malignant").alias("d1"),
        F.lit("Melanoma").alias("d2"),
        k.alias("k"),
    )
    receipts = rows.select("image_name", F.sha2("image_name", 256).alias("sha256"))
    return curation.build_cohort(rows.drop("k"), receipts, rows.where("k % 11 = 0").select("image_name"), fields=["d1", "d2"], seed=3, fraction=0.5)


# ---- provenance


_JSON = " || ',' || ".join(f"""'"{c}":' || coalesce({v}, 'null')""" for c, v in (
    *((c, f"""'"' || {c} || '"'""") for c in ("collection_id", "group_id", "image_name", "image_path")), ("ord", "ord::VARCHAR"), *((c, f"""'"' || {c} || '"'""") for c in ("sha256", "source_label")), ("target", "target::VARCHAR")))


@query(with_views("b_manifest") + f""" SELECT count(*) AS images, count(DISTINCT sha256) AS distinct_contents, true AS digest_repeats,
  sha256('{{"columns":["collection_id","group_id","image_name","image_path","ord","sha256","source_label","target"],"records":[' || string_agg('{{' || {_JSON} || '}}', ',' ORDER BY image_name, image_path, sha256) || ']}}') AS digest FROM b_manifest""")
def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's digest, the same after its rows are shuffled."""
    m = manifest(spark, sf_dir, fingerprint=False).drop("perceptual_hash")
    digest = provenance.manifest_digest(m)
    same = digest == provenance.manifest_digest(m.repartition(3).orderBy(F.desc("sha256")))
    return m.agg(F.count("*").alias("images"), F.count_distinct("sha256").alias("distinct_contents")).withColumns({"digest_repeats": F.lit(same), "digest": F.lit(digest)})


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderkey || chr(0) || o_orderstatus || chr(0) || o_orderpriority || chr(10) AS t FROM orders),
  c AS (SELECT i // 1000 AS c, count(*) AS n, sha256(string_agg(t, '' ORDER BY i)) AS t FROM l GROUP BY 1) SELECT sum(n)::BIGINT AS rows, sha256(string_agg(t, '' ORDER BY c)) AS sha256 FROM c""")
def tree_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a table by digests of its chunks, which are made side by side."""
    return provenance.tree_digest(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"], "o_orderkey", chunk=1000)


@query("""SELECT sha256('{' || string_agg('"' || r_name || '":{"key":' || r_regionkey || ',"nations":' || n || '}', ',' ORDER BY r_name) || '}') AS sha256 FROM region JOIN (SELECT n_regionkey AS r_regionkey, count(*) AS n FROM nation GROUP BY 1) USING (r_regionkey)""")
def component_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a set of named components."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    rows = r.join(n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n")), "r_regionkey").collect()  # a row a component
    digest = provenance.component_set_digest({x["r_name"]: {"key": x["r_regionkey"], "nations": x["n"]} for x in rows})
    return spark.createDataFrame([(digest,)], "sha256 string")


@query("SELECT sha256(string_agg(n_name || chr(0) || n_regionkey || chr(10), '' ORDER BY n_nationkey)) AS sha256 FROM nation")
def evaluation_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.ordered_digest(table(spark, sf_dir, "nation"), ["n_name", "n_regionkey"], "n_nationkey")


@query("SELECT n_name AS artifact, sha256(n_name) AS recorded, CASE WHEN n_nationkey % 5 = 0 THEN sha256('x') END AS found, CASE WHEN n_nationkey % 5 = 0 THEN 'hash_mismatch' ELSE 'missing' END AS problem FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 7 = 0")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    recorded = n.select(F.col("n_name").alias("artifact"), F.sha2("n_name", 256).alias("sha256"))
    found = n.where("n_nationkey % 5 = 0 or n_nationkey % 7 <> 0").select(F.col("n_name").alias("artifact"), F.when(F.col("n_nationkey") % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("n_name", 256)).alias("sha256"))
    return provenance.hash_chain_problems(recorded, found)


# ---- decisions


@query(with_views("b_pred") + """ SELECT record_id, CASE WHEN p < 0.3 THEN 'low' WHEN p >= 0.7 THEN 'high' ELSE 'inconclusive' END AS level, CASE WHEN (p >= 0.3 AND p < 0.7) OR abs(p - 0.5) < 0.25 THEN 'uncertain' WHEN p < 0.3 THEN 'low' ELSE 'high' END AS attention_level,
  (p >= 0.3 AND p < 0.7) OR abs(p - 0.5) < 0.25 AS abstained, CASE WHEN p >= 0.3 AND p < 0.7 THEN 'threshold_gap' WHEN abs(p - 0.5) < 0.25 THEN 'configured_margin' END AS abstention_reason FROM b_pred""")
def attention_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    return predictions(spark, sf_dir).select("record_id", policies.level(p, 0.3, 0.7).alias("level"), *(v.alias(k) for k, v in policies.worker_decision(p, 0.3, 0.7, 0.25).items()))




@query(
    with_views("b_views")
    + """, s AS (SELECT record_id, views[1:4] AS a, [views[1], views[5], views[6]] AS b, views AS c FROM b_views)
  SELECT record_id, CASE WHEN list_max(a) < 0.45 THEN 'low' WHEN list_min(a) >= 0.5 THEN 'high' ELSE 'inconclusive' END AS orientation, CASE WHEN list_max(b) < 0.45 THEN 'low' WHEN list_min(b) >= 0.5 THEN 'high' ELSE 'inconclusive' END AS center,
    CASE WHEN list_max(c) < 0.45 THEN 'low' WHEN list_min(c) >= 0.5 THEN 'high' ELSE 'inconclusive' END AS combined, round(list_min(c), 9) AS least, round(list_max(c), 9) AS most FROM s"""
)
def view_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    by = {n: policies.consensus(policies.chosen_views(F.col("views"), p), 0.45, 0.5) for n, p in (("orientation", "orientation4_consensus"), ("center", "center_scale3_consensus"), ("combined", "combined6_consensus"))}
    return v.select("record_id", *(c["level"].alias(n) for n, c in by.items()), F.round(by["combined"]["minimum"], 9).alias("least"), F.round(by["combined"]["maximum"], 9).alias("most"))


_DUAL = """, d AS (SELECT record_id, target, CASE WHEN list_min(views[1:3]) >= 0.4 AND list_min(views[4:6]) >= 0.35 AND list_min(views[4:6]) >= 0.45 THEN 'high_confirmed'
    WHEN list_max(views[1:3]) < 0.3 AND list_max(views[4:6]) < 0.25 THEN 'no_elevated_signal' ELSE 'review' END AS level FROM b_views)"""


def _dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    level = policies.dual_policy(F.slice("views", 1, 3), F.slice("views", 4, 3), first_low=0.3, first_high=0.4, second_low=0.25, second_high=0.35, confirmation=0.45)
    return v.select("record_id", "target", level.alias("level"))


@query(with_views("b_views") + _DUAL + " SELECT * FROM d")
def dual_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dual(spark, sf_dir)


@query(with_views("b_views") + _DUAL + """, c AS (SELECT count(*) FILTER (level = 'high_confirmed' AND target = 1) AS tp, count(*) FILTER (level = 'high_confirmed' AND target = 0) AS fp, count(*) FILTER (level <> 'high_confirmed' AND target = 1) AS fn, count(*) FILTER (level <> 'high_confirmed' AND target = 0) AS tn FROM d)
  SELECT tp, fp, fn, tn, round(tp / greatest(tp + fn, 1), 9) AS sensitivity, round(tn / greatest(tn + fp, 1), 9) AS specificity, round(tp / greatest(tp + fp, 1), 9) AS precision FROM c""")
def high_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = policies.high_confirmation_metrics(_dual(spark, sf_dir), "level")
    return got.select("tp", "fp", "fn", "tn", *(F.round(c, 9).alias(c) for c in ("sensitivity", "specificity", "precision")))


@query(with_views("b_views") + """, d AS (SELECT target, views[1] >= 0.5 AS base, list_min(views) >= 0.5 AS other FROM b_views), c AS (SELECT count(*) FILTER (base AND target = 1) AS base_tp, count(*) FILTER (base AND target = 0) AS base_fp,
    count(*) FILTER (NOT base AND target = 1) AS base_fn, count(*) FILTER (NOT base AND target = 0) AS base_tn, count(*) FILTER (other AND target = 1) AS policy_tp, count(*) FILTER (other AND target = 0) AS policy_fp, count(*) FILTER (NOT other AND target = 1) AS policy_fn, count(*) FILTER (NOT other AND target = 0) AS policy_tn FROM d)
  SELECT *, policy_fp - base_fp AS false_positive_delta, policy_tp - base_tp AS true_positive_delta, round((base_fp - policy_fp) / base_fp, 9) AS false_positive_reduction FROM c""")
def policy_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir)
    got = policies.policy_delta(v, F.col("views")[0] >= 0.5, F.array_min("views") >= 0.5)
    return got.withColumn("false_positive_reduction", F.round("false_positive_reduction", 9))


@query(with_views("b_orders") + """, s AS (SELECT DISTINCT source_id FROM b_orders), p AS (SELECT source_id, CASE WHEN source_id % 2 = 0 THEN 'leave_one_source_out' WHEN source_id = 1 THEN 'within_source_test' ELSE 'other' END AS protocol, source_id < 2 AS trained, source_id = 4 AS authorized FROM s)
  SELECT source_id, CASE WHEN protocol = 'other' THEN 'unsupported_protocol' WHEN authorized THEN 'training_not_forbidden' WHEN protocol = 'leave_one_source_out' AND trained THEN 'held_out_source_in_training' WHEN protocol = 'within_source_test' AND NOT trained THEN 'source_not_in_training' END AS problem FROM p""")
def dataset_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir).select("source_id").distinct()
    protocol = F.when(F.col("source_id") % 2 == 0, F.lit("leave_one_source_out")).when(F.col("source_id") == 1, F.lit("within_source_test")).otherwise(F.lit("other"))
    return s.select("source_id", policies.dataset_eligibility(protocol, F.col("source_id") < 2, F.col("source_id") == 4).alias("problem"))


_REQUESTS = """SELECT event_id, CASE WHEN event_id % 13 = 0 OR event_id % 11 = 0 THEN 'INVALID_REQUEST' WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'INVALID_REQUEST' WHEN event_id % 19 = 0 THEN 'MODEL_IDENTITY_MISMATCH'
    WHEN event_id % 23 = 0 THEN 'INVALID_REQUEST' WHEN event_id % 5 = 0 OR event_id % 6 = 0 THEN 'INELIGIBLE_OBSERVATION' END AS error_code, event_id % 7 = 0 AS status, 1 / (1 + exp(-(1.5::DOUBLE * ((event_id % 64) / 8.0::DOUBLE - 4) + 0.25))) AS s FROM events"""


@query(f"SELECT event_id, error_code, round(CASE WHEN error_code IS NULL AND NOT status THEN s END, 9) AS score, CASE WHEN error_code IS NULL AND NOT status THEN CASE WHEN (s >= 0.3 AND s < 0.7) OR abs(s - 0.5) < 0.1 THEN 'uncertain' WHEN s < 0.3 THEN 'low' ELSE 'high' END END AS attention_level FROM ({_REQUESTS})")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = policies.respond(requests(spark, sf_dir), "payload", version=1, model="scorer-1", calibration=AFFINE, low=0.3, high=0.7, margin=0.1)
    return got.select("event_id", "error_code", F.round("score", 9).alias("score"), "attention_level")


AFFINE = {"method": "affine_logistic_scaling", "logit_scale": 1.5, "logit_bias": 0.25}


@query(f"SELECT event_id, error_code, round(CASE WHEN error_code IS NULL AND NOT status THEN s END, 9) AS score FROM ({_REQUESTS})")
def stream_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests as a stream: written as files, scored by an available-now run, and read back."""
    import uuid

    from curatrix.functions.session import checkpoint_folder
    from curatrix.streaming.scorer import run_available

    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    requests(spark, sf_dir).write.parquet(f"{base}/in")
    settings = {"version": 1, "model": "scorer-1", "calibration": AFFINE, "low": 0.3, "high": 0.7, "margin": 0.1}
    run_available(spark, f"{base}/in", "event_id long, payload string", "payload", f"{base}/out", f"{base}/state", settings).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "error_code", F.round("score", 9).alias("score"))

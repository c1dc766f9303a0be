import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import text
from curatrix.operators import classify, curation, provenance
from curatrix.operators.expectations import ExpectationFailed, enforce
from curatrix.sources import bundles, sinks, tables
from curatrix.streaming.scorer import run_available


def test_exclusion_reasons_first_match_wins(spark):
    rows = [("a", True, None, " ", "x"), ("b", True, None, "g", "Indeterminate"), ("c", False, None, None, None), (" ", False, None, "g", "x"), ("e", True, "a", None, "x"), ("f", True, None, "g", "benign")]
    df = spark.createDataFrame(rows, "n string, found boolean, dup string, g string, label string")
    reason = classify.exclusion_reason(name=F.col("n"), found=F.col("found"), duplicate_of=F.col("dup"), group=F.col("g"), label=F.col("label"), mapped=F.col("label") == "benign", valid=F.lit(True))
    assert [r[0] for r in df.select(reason).collect()] == ["missing_group_id", "unmapped_label:indeterminate", "image_not_found", "missing_image_name", "source_duplicate_of:a", None]


def test_one_hot(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (1.0, 1.0, 0.0), (0.5, 0.5, 0.0), (None, 1.0, 0.0)], "BCC double, AK double, SCC double")
    got = df.select(classify.one_hot_class(["BCC", "AK", "SCC"]), classify.one_hot_valid(["BCC", "AK", "SCC"])).collect()
    assert [tuple(r) for r in got[:4]] == [("bcc", True), ("scc", True), ("bcc", False), ("bcc", False)] and got[4][1] is False


def test_reference_classes(spark):
    rows = [("Histopathology", "Benign", "Nevus"), ("histopathology", "Benign", "Nevus, Atypical, Dysplastic, or Clark"), ("histopathology", "Malignant", "Melanoma"), ("single image expert consensus", "Benign", "Nevus"), ("histopathology", None, None)]
    df = spark.createDataFrame(rows, "c string, d1 string, d2 string")
    assert [r[0] for r in df.select(classify.reference_class(F.col("c"), [F.col("d1"), F.col("d2")])).collect()] == ["benign", "atypical", "melanoma", None, None]


def test_paths_and_urls(spark):
    paths = {"a/b.jpg": True, "source/../outside.jpg": False, "/abs": False, "C:\\x": False, " ": False, None: False, "a..b/c": True}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(text.is_safe_relative_path("p")).collect()] == list(paths.values())
    urls = {"https://h.org/a.jpg": True, "http://h.org/a.jpg": False, "https://evil.org/a.jpg": False, "https://h.org/a.gif": False, None: False, "not a url": False}
    u = spark.createDataFrame([(x,) for x in urls], "u string")
    assert [r[0] for r in u.select(text.url_allowed("u", hosts=("h.org",), path_suffixes=(".jpg",))).collect()] == list(urls.values())


def test_blank_means_any_white_space(spark):
    df = spark.createDataFrame([(" \t\n",), (None,), (" x ",)], "s string")
    assert [r[0] for r in df.select(text.is_blank("s")).collect()] == [True, True, False]


CONFIG = {
    "schema_version": 1,
    "dataset": {"id": "d", "version": "1", "expected_images": 2, "source_url": "u", "license": "CC-0", "license_url": "l", "attribution": "a"},
    "columns": {"image": "i", "group": "g"},
    "label_mapping": {"version": "1", "task": "t", "source_column": "c", "values": {"benign": {"target": 0, "label": "b"}, "malignant": {"target": 1, "label": "m"}}},
    "integrity": {"perceptual_hash": {"hash_size": 8}, "near_duplicate_hamming_threshold": 6},
}


def test_config(spark):
    assert curation.validate_config(CONFIG) is CONFIG
    for part, key, value in (("dataset", "license", ""), ("columns", "group", None), ("integrity", "near_duplicate_hamming_threshold", 64)):
        broken = json.loads(json.dumps(CONFIG))
        broken[part][key] = value
        with pytest.raises(ExpectationFailed):
            curation.validate_config(broken)


def test_curate_end_to_end(spark):
    meta = spark.createDataFrame([("0000", "g", "benign"), ("0001", "g", "Benign "), ("0002", " ", "benign"), ("0003", "h", "malignant"), ("0004", "h", "odd"), ("0005", "h", "benign")], "image_name string, group_id string, source_label string")
    files = spark.createDataFrame([("0000", "x", True), ("0001", "x", True), ("0002", "y", True), ("0003", "z", True), ("0004", "w", True)], "image_name string, sha256 string, valid boolean")
    labels = spark.createDataFrame([("benign", 0, "b"), ("malignant", 1, "m")], "raw_label string, target int, curated_label string")
    kept, dropped = curation.curate(meta, files, labels)
    reasons = {r["image_name"]: r["reason"] for r in dropped.collect()}
    assert reasons["0002"] == "missing_group_id" and reasons["0004"] == "unmapped_label:odd" and reasons["0005"] == "image_not_found"
    assert reasons["0001"] == "exact_duplicate_of:0000"
    assert {r["image_name"] for r in kept.collect()} == {"0000", "0003"}
    with pytest.raises(ExpectationFailed):
        curation.curate(meta, files, labels, duplicates="block")
    torn = meta.withColumn("group_id", F.when(F.col("image_name") == "0001", F.lit("other")).otherwise(F.col("group_id")))
    with pytest.raises(ExpectationFailed, match="agree"):
        curation.curate(torn, files, labels)


def test_augmentation_and_card_gates(spark):
    cols = "image_name string, group_id string, patient_id string, sha256 string, patient_identifier_status string, perceptual_hash_algorithm string, perceptual_hash_bits int, near_duplicate_hamming_threshold int"
    base = spark.createDataFrame([("a", "g", "p", "x", "", "phash", 16, 0)], cols)
    fine = spark.createDataFrame([("b", "h", "", "y", "unavailable", "phash", 16, 0)], cols)
    enforce(curation.augmentation_gate(base, fine))
    for bad in (("b", "g", "q", "y", "", "phash", 16, 0), ("b", "h", " ", "y", "", "phash", 16, 0), ("b", "h", "q", "x", "", "phash", 16, 0), ("b", "h", "q", "y", "", "phash", 64, 0)):
        with pytest.raises(ExpectationFailed):
            enforce(curation.augmentation_gate(base, spark.createDataFrame([bad], cols)))
    with pytest.raises(ExpectationFailed):
        enforce(curation.external_card_gate({"purpose": "training"}, base))


def test_digest_ignores_order_and_notices_change(spark):
    df = spark.createDataFrame([("b", "", 0.1 + 0.2, None), ("a", "x", 1.0, 2)], "image_name string, s string, v double, n int")
    digest = provenance.manifest_digest(df)
    assert digest == provenance.manifest_digest(df.orderBy("image_name").coalesce(1).select("v", "n", "image_name", "s"))
    want = json.dumps({"columns": ["image_name", "n", "s", "v"], "records": [{"image_name": "a", "n": 2, "s": "x", "v": 1.0}, {"image_name": "b", "n": None, "s": None, "v": 0.3}]}, ensure_ascii=True, separators=(",", ":"), sort_keys=True)
    import hashlib

    assert digest == hashlib.sha256(want.encode()).hexdigest()
    assert digest != provenance.manifest_digest(df.withColumn("v", F.col("v") + 1e-6))
    assert provenance.fast_checksum(df).first() == provenance.fast_checksum(df.orderBy("image_name")).first()


def test_csv_keeps_identifiers(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('﻿image_name,target,note\n007,1,"a, ""b"""\n008,,\n', encoding="utf-8")
    df = tables.read_manifest(spark, str(path))
    assert [tuple(r) for r in df.orderBy("image_name").collect()] == [("007", 1, 'a, "b"'), ("008", None, None)]
    assert tables.read_csv(spark, str(path), keep_blanks=True).where("image_name = '008'").first()["note"] == ""
    with pytest.raises(ExpectationFailed):
        tables.read_csv(spark, str(path), required=("absent",))


def test_manifest_is_written_once(spark, tmp_path):
    df = spark.createDataFrame([("a", "p/a", "x")], "image_name string, image_path string, sha256 string")
    path = str(tmp_path / "manifest.csv")
    digest = sinks.write_manifest(df, path)
    assert (tmp_path / "manifest.csv.sha256").read_text().strip() == digest
    assert provenance.manifest_digest(tables.read_manifest(spark, path)) == digest
    with pytest.raises(FileExistsError):
        sinks.write_manifest(df, path)
    sinks.write_json(tmp_path / "card.json", {"b": 1, "a": 2})
    with pytest.raises(FileExistsError):
        sinks.write_json(tmp_path / "card.json", {})
    assert sinks.companion("x/run.csv", "report.json").name == "run.report.json"
    empty = str(tmp_path / "none.csv")
    sinks.write_csv(df.limit(0), empty)
    assert tables.csv_header(spark, empty) == df.columns


def test_npz_bundles(spark, tmp_path):
    sinks.write_npz(tmp_path / "b.npz", image_names=np.array(["a", "b"]), targets=np.array([0, 1]), logits=np.array([[0.5, 1.0], [1.5, 2.0]]))
    df = bundles.read_npz(spark, str(tmp_path / "b.npz"), "image_names string, targets long, logits array<double>", ("targets",))
    assert [tuple(r) for r in df.orderBy("image_names").collect()] == [("a", 0, [0.5, 1.0]), ("b", 1, [1.5, 2.0])]
    with pytest.raises(Exception, match="lacks"):
        bundles.read_npz(spark, str(tmp_path / "b.npz"), "targets long", ("absent",)).count()


def test_zip_members(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.txt", b"hello")
    (tmp_path / "x.zip").write_bytes(data.getvalue())
    files = spark.read.format("binaryFile").load(str(tmp_path / "x.zip"))
    row = bundles.zip_members(files).first()
    assert (row["member"], row["bytes"], bytes(row["content"])) == ("a.txt", 5, b"hello")
    stream = io.BufferedReader(bundles.RangeStream(len(data.getvalue()), lambda a, b: data.getvalue()[a:b]))
    assert zipfile.ZipFile(stream).read("a.txt") == b"hello"


def test_rest_pages():
    store = {"https://x/1": {"count": 3, "results": [{"i": 1}, {"i": 2}], "next": "https://x/2"}, "https://x/2": {"count": 3, "results": [{"i": 3}], "next": None}}
    tries = []

    def get(url):
        tries.append(url)
        if len(tries) == 1:
            raise OSError("once")
        return json.dumps(store[url]).encode()

    assert [r["i"] for r in bundles.pages("https://x/1", origin="https://x/", get=get, pause=0)] == [1, 2, 3]
    with pytest.raises(ExpectationFailed):
        list(bundles.pages("https://evil/1", origin="https://x/", get=get))
    store["https://x/2"]["count"] = 9
    with pytest.raises(ExpectationFailed):
        list(bundles.pages("https://x/1", origin="https://x/", get=get, pause=0))


def test_files_images_and_downloads(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (32).to_bytes(4, "big") + (16).to_bytes(4, "big") + bytes(9)
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x10\x00\x20" + bytes(12))
    digests = tables.file_digests(spark, str(tmp_path))
    import hashlib

    want = spark.createDataFrame([("a.png", hashlib.sha256(png).hexdigest()), ("b.png", "0")], "name string, sha256 string")
    found = digests.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    assert [r["name"] for r in tables.verify_digests(found, want, "name").collect()] == ["b.png"]
    files = spark.read.format("binaryFile").load(str(tmp_path))
    sizes = {r["format"]: (r["width"], r["height"]) for r in bundles.image_headers(files).collect()}
    assert sizes == {"png": (32, 16), "jpeg": (32, 16)}
    names = spark.createDataFrame([("a",), ("z",)], "image_name string")
    got = {r["image_name"]: r["image_path"] for r in tables.resolve_images(names, files.select("path")).collect()}
    assert got["a"].endswith("a.jpg") and got["z"] is None
    urls = spark.createDataFrame([("a", "u", 3, hashlib.md5(b"abc").hexdigest())], "image_name string, url string, size long, etag string")
    assert bundles.download(urls, get=lambda u: b"abc").first()["bytes"] == 3
    with pytest.raises(Exception, match="differs"):
        bundles.download(urls.withColumn("size", F.lit(4).cast("long")), get=lambda u: b"abc").count()


def test_perceptual_hash_of_a_shifted_image(spark):
    base = np.add.outer(np.arange(32), 2 * np.arange(32)) % 17
    df = spark.createDataFrame([("a", base.ravel().astype(float).tolist()), ("b", (base + 3).ravel().astype(float).tolist())], "key string, pixels array<double>")
    got = {r["key"]: r["perceptual_hash"] for r in bundles.perceptual_hash(df).collect()}
    assert len(got["a"]) == 16 and bin(int(got["a"], 16) ^ int(got["b"], 16)).count("1") <= 1


def test_stream_takes_each_request_once(spark, tmp_path):
    good = {"ipc_version": 1, "request_id": "a" * 32, "operation": "predict", "expected_model": "m", "input": {"quality_status": "accepted", "microscope_source_confirmed": True, "acquisition_protocol_status": "ok", "observation_id": 3, "raw_output": 2.0}}
    bad = good | {"request_id": "zz"}
    low = json.loads(json.dumps(good)) | {"input": good["input"] | {"quality_status": "rejected"}}
    settings = {"version": 1, "model": "m", "calibration": {"method": "temperature_scaling", "temperature": 1.0}, "low": 0.3, "high": 0.7, "margin": 0.1}
    for part in ([good, bad], [low, "not json"]):
        rows = [(json.dumps(r) if isinstance(r, dict) else r,) for r in part]
        spark.createDataFrame(rows, "payload string").write.mode("append").parquet(str(tmp_path / "in"))
        run_available(spark, str(tmp_path / "in"), "payload string", "payload", str(tmp_path / "out"), str(tmp_path / "state"), settings).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["error_code"] or "" for r in got) == ["", "INELIGIBLE_OBSERVATION", "INVALID_REQUEST", "INVALID_REQUEST"]
    assert [r["attention_level"] for r in got if r["ok"]] == ["high"]


def test_image_views_and_letterbox(spark):
    from curatrix.functions import images

    pixels = np.arange(40 * 20 * 3, dtype=np.uint8).reshape(20, 40, 3)
    assert images.FILL == (124, 116, 104)
    views = images.six_views(pixels, 8)
    assert views.shape == (6, 8, 8, 3) and (views[1] == views[0][:, ::-1]).all() and (views[3] == views[0][::-1, ::-1]).all()
    boxed = images.letterboxed(pixels, 10)
    assert (boxed[0] == images.FILL).all() and (boxed[2:7] != images.FILL).any()
    assert (images.resized(np.full((7, 9, 3), 200, np.uint8), 4, 3) == 200).all()
    halves = images.resized(np.array([[[0] * 3, [100] * 3, [50] * 3, [150] * 3]], np.uint8), 2, 1)
    assert halves[0, :, 0].tolist() == [50, 100]
    df = spark.createDataFrame([("a", 40, 20, pixels.tobytes())], "key string, width int, height int, pixels binary")
    tensor = np.array(images.preprocess(df, 8).first()["tensor"]).reshape(3, 8, 8)
    assert np.allclose(tensor, images.normalized(images.resized(pixels, 8, 8)), atol=1e-6)
    sizes = spark.createDataFrame([(10, 5), (3, 1000)], "w int, h int")
    for even, want in ((True, 2), (False, 3)):
        got = images.letterbox_geometry(F.col("w"), F.col("h"), 5, even)
        assert [tuple(r) for r in sizes.select(got["target_width"], got["target_height"]).collect()] == [(5, want), (1, 5)]


def test_priority_records(spark):
    training = spark.createDataFrame([("a", "x", "g", "c", 0), ("b", "y", "h", "c", 1)], "image_name string, sha256 string, group_id string, collection_id string, target int")
    fine = training.withColumn("error_type", F.when(F.col("target") == 0, F.lit("hard_false_positive")).otherwise(F.lit("hard_false_negative")))
    enforce(curation.priority_checks(fine, training))
    for broken in (fine.withColumn("sha256", F.lit("z")), fine.withColumn("error_type", F.lit("hard_false_positive")), fine.withColumn("image_name", F.lit("q"))):
        with pytest.raises(ExpectationFailed):
            enforce(curation.priority_checks(broken, training))

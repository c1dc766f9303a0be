"""Small helpers of sources, sinks, expectations and receipts."""

import io
import urllib.error
import zipfile
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import numeric, session
from curatrix.operators import curation, metrics, provenance, sample
from curatrix.operators.expectations import ExpectationFailed, count_check, enforce, require_columns
from curatrix.operators.skew import spread_join
from curatrix.sources import bundles, sinks, tables


@pytest.mark.parametrize("url", ["https://host.evil.example/a", "https://host@evil.example/a", "http://host/a", "https://host:8443/a", "https://host/b", "https://host/a/../b", "https://hos/a"])
def test_other_origins_are_refused(url):
    with pytest.raises(ExpectationFailed):
        bundles.fetch_json(url, origin="https://host/a", get=lambda u: b"{}")
    assert bundles.fetch_json("https://host/a/x?y=1", origin="https://host/a", get=lambda u: b'{"k": 1}') == {"k": 1}


def failing(*codes):
    left = list(codes)

    def get(url):
        if left:
            code = left.pop(0)
            raise OSError("no connection") if code is None else urllib.error.HTTPError(url, code, "", {}, None)
        return b"[1]"

    return get, left


def test_what_may_pass_is_tried_again():
    get, _ = failing(503, None, 429)
    assert bundles.fetch_json("https://h/", origin="https://h", get=get, pause=0) == [1]
    get, left = failing(404, 404)
    with pytest.raises(urllib.error.HTTPError):
        bundles.fetch_json("https://h/", origin="https://h", get=get, pause=0)
    assert len(left) == 1  # asked once
    get, _ = failing(500, 500, 500, 500)
    with pytest.raises(urllib.error.HTTPError):
        bundles.fetch_json("https://h/", origin="https://h", get=get, pause=0)


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(3):
            z.writestr(f"m{i}.txt", f"member {i} " * 5000)
    return out.getvalue()


def test_members_of_remote_archives(spark):
    data = archive()

    def ask(url, headers):
        begin, end = map(int, headers["Range"].removeprefix("bytes=").split("-"))
        assert headers.get("If-Match", "v1") == "v1"
        return 206, {"etag": "v1", "content-range": f"bytes {begin}-{end}/{len(data)}"}, data[begin : end + 1]

    urls = spark.createDataFrame([("https://h/a.zip",)], "url string")
    wanted = spark.createDataFrame([("https://h/a.zip", "m1.txt")], "url string, member string")
    assert [x["member"] for x in bundles.remote_zip_members(urls, origin="https://h", ask=ask).orderBy("member").collect()] == ["m0.txt", "m1.txt", "m2.txt"]
    got = bundles.remote_zip_members(urls, origin="https://h", names=wanted, ask=ask).collect()
    assert [(x["member"], bytes(x["content"])) for x in got] == [("m1.txt", b"member 1 " * 5000)]

    answers = iter(["v1", "v2"])

    def changed(url, headers):
        status, got, body = ask(url, headers)
        return status, got | {"etag": next(answers)}, body

    remote = bundles.RemoteFile("https://h/a.zip", origin="https://h", ask=changed, pause=0)
    with pytest.raises(ExpectationFailed, match="changed"):
        remote.get(0, 10)


def test_inferred_columns(spark, tmp_path):
    (tmp_path / "m.csv").write_text('image_name,target,age,weight,code,blank,signed\na,1,30,1.5,007,,-3\n"b, c",0,,2e3,12,,+4\n')
    df = tables.read_manifest(spark, str(tmp_path / "m.csv"), infer=True)
    assert dict(df.dtypes) == {"image_name": "string", "target": "int", "age": "bigint", "weight": "double", "code": "string", "blank": "string", "signed": "string"}
    assert [tuple(r) for r in df.collect()] == [("a", 1, 30, 1.5, "007", None, "-3"), ("b, c", 0, None, 2000.0, "12", None, "+4")]
    assert dict(tables.read_manifest(spark, str(tmp_path / "m.csv")).dtypes)["age"] == "string"


def test_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"a": 1,\n "b": "x"}')
    assert tables.read_json(spark, str(tmp_path / "d.json"), "a int, b string").collect()[0] == (1, "x")
    (tmp_path / "bad.json").write_text('{"a": 1,')
    with pytest.raises(Exception):
        tables.read_json(spark, str(tmp_path / "bad.json"), "a int").collect()
    assert tables.read_yaml("a: 1\nb: [x]") == {"a": 1, "b": ["x"]}
    with pytest.raises(ExpectationFailed):
        tables.read_yaml("- 1")


def test_sinks_never_overwrite(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "x.json").write_text("{}")
    sinks.copy_bundle(tmp_path / "run", tmp_path / "copy", ["x.json"])
    assert (tmp_path / "copy" / "x.json").read_text() == "{}"
    with pytest.raises(FileExistsError):
        sinks.copy_bundle(tmp_path / "run", tmp_path / "copy", ["x.json"])
    (tmp_path / "t").write_text("1")
    sinks.publish(tmp_path / "t", tmp_path / "final")
    (tmp_path / "t").write_text("2")
    with pytest.raises(FileExistsError):
        sinks.publish(tmp_path / "t", tmp_path / "final")
    assert (tmp_path / "final").read_text() == "1"
    df = spark.createDataFrame([(1, "a", "r")], "row_number int, image_name string, reason string")
    sinks.write_table(df, str(tmp_path / "p"))
    sinks.write_exclusions(df, str(tmp_path / "e"))
    for again in (lambda: sinks.write_table(df, str(tmp_path / "p")), lambda: sinks.write_exclusions(df, str(tmp_path / "e"))):
        with pytest.raises(Exception, match="(?i)exist"):
            again()


def test_expectations_of_tables(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    assert require_columns(df, ["x"]) is df
    with pytest.raises(ExpectationFailed, match="z"):
        require_columns(df, ["x", "z"], "manifest")
    enforce(count_check(df, "two rows", 2))
    with pytest.raises(ExpectationFailed, match="three"):
        enforce(count_check(df, "three rows", 3))
    assert {(r["y"], r["n"]) for r in curation.license_counts(df, "y").collect()} == {("a", 1), ("b", 1)}
    with pytest.raises(Exception, match="probabilities"):
        metrics.binary_metrics(spark.createDataFrame([(1, 1.5), (0, 0.2)], "target int, p double")).collect()


def test_numbers(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(numeric.is_finite(F.col("x"))).collect()] == [True, False, False, False]
    assert df.limit(1).select(numeric.z_score(F.col("x"), F.lit(3.0), F.lit(2.0))).first()[0] == -1.0
    for bad in ({"method": "other"}, {"method": "temperature_scaling", "temperature": 0}, {"method": "affine_logistic_scaling", "logit_scale": 1, "logit_bias": float("nan")}):
        with pytest.raises(ValueError):
            numeric.calibrated(F.col("x"), bad)


def test_receipts_and_runtime_documents():
    at = datetime(2024, 2, 29, 23, 59, 58, 999, tzinfo=UTC)
    one = provenance.receipt("curate", {"b": "2", "a": "1"}, at)
    assert one["created_at"] == "2024-02-29T23:59:58Z" and one == provenance.receipt("curate", {"a": "1", "b": "2"}, at)
    assert provenance.receipt("curate", {"a": "1"}, at)["sha256"] != one["sha256"]
    good = {"model": {"name": "m"}, "calibration": {"method": "none"}, "preprocessing": {"mean": [0.1, 0.2, 0.3], "std": [1, 1, 1]}}
    assert provenance.runtime_manifest(thresholds=(0.2, 0.8), **good)["schema_version"] == 3
    for bad in ({"thresholds": (0.8, 0.2)}, {"thresholds": (0.2, 0.8), "preprocessing": {"mean": [0.1], "std": [1, 1, 1]}}):
        with pytest.raises(ValueError):
            provenance.runtime_manifest(**{**good, **bad})


def test_views_of_an_epoch_repeat(spark):
    df = spark.range(400).select(F.col("id"), sample.chosen_scale(F.col("id"), 1, 2, (1.0, 0.5)).alias("s"), sample.chosen_scale(F.col("id"), 1, 3, (1.0, 0.5)).alias("t"))
    rows = df.collect()
    assert rows == df.repartition(7).orderBy("id").collect()
    assert 150 < sum(r["s"] == 1.0 for r in rows) < 250 and 150 < sum(r["s"] == r["t"] for r in rows) < 250
    crop = spark.range(1).select(sample.centre_crop(F.lit(101), F.lit(1), F.lit(0.5)).alias("c")).first()["c"]
    assert tuple(crop) == (25, 0, 50, 1)


def test_lookups_by_a_hot_key(spark):
    rows = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(900)], "i int, k int")
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(0, 900, 2)] + [(7, "v7")], "k int, v string")
    want = {(i, k, f"v{k}") for i, k in ((i, 7 if i % 3 else i) for i in range(900)) if k % 2 == 0 or k == 7}
    assert {(r["i"], r["k"], r["v"]) for r in spread_join(rows, lookup, "k", "i").collect()} == want


def test_a_cluster_must_name_its_checkpoint_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        session.checkpoint_folder(Session())


def test_bundles_round_trip(spark):
    df = spark.createDataFrame([(i, [float(i), 0.5], f"n{i}") for i in range(20)], "i long, v array<double>, s string").repartition(3)
    got = bundles.npz_rows(bundles.npz_bundles(df), "i long, v array<double>, s string", ("i",))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="lacks"):
        bundles.npz_rows(bundles.npz_bundles(df), "i long", ("w",)).collect()
    assert np.isfinite([x["i"] for x in got.collect()]).all()


def segment(kind, body):
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def test_jpegs_are_whole_or_not():
    frame, scan = segment(0xC0, bytes(15)), segment(0xDA, bytes(10))
    coded = b"\x12\xff\x00\x34\xff\xd0\x56"
    whole = b"\xff\xd8" + segment(0xE0, b"JFIF") + frame + scan + coded + b"\xff\xd9"
    progressive = b"\xff\xd8" + segment(0xC2, bytes(15)) + scan + coded + segment(0xC4, bytes(20)) + scan + coded + b"\xff\xff\xd9" + b"trailing"
    assert bundles.jpeg_fault(whole) is None and bundles.jpeg_fault(progressive) is None
    assert {bundles.jpeg_fault(whole[:n]) for n in range(2, len(whole))} == {"cut off"}
    assert bundles.jpeg_fault(b"\xff\xd8" + scan + coded + b"\xff\xd9") == "no frame"
    assert bundles.jpeg_fault(b"\xff\xd8" + frame + b"\xff\xd9") == "no scan"
    assert bundles.jpeg_fault(b"\xff\xd8junk") == "order of segments"


def test_pngs_are_whole_or_not():
    from curatrix.plans.queries_files import _grey_png

    png = _grey_png(5, [b"abcde", b"fghij"])
    assert bundles.png_fault(png) is None
    for n in range(8, len(png)):
        assert bundles.png_fault(png[:n]) == "cut off"
    for n in range(8, len(png)):
        assert bundles.png_fault(png[:n] + bytes([png[n] ^ 4]) + png[n + 1 :]) is not None
    assert bundles.png_fault(_grey_png(6, [b"abcde", b"fghij"])) == "pixels"


def test_preflight_compares_digest_and_report(spark):
    rows = [(f"i{n}", f"img/{n}.jpg", f"{n:064x}", f"{n:016x}", n % 2, split, f"g{n}") for n, split in enumerate(["train"] * 4 + ["validation"] * 2 + ["test"] * 2)]
    df = spark.createDataFrame(rows, "image_name string, image_path string, sha256 string, perceptual_hash string, target int, split string, group_id string")
    links = spark.createDataFrame([], "split_differ long")
    good = curation.preflight(df, links, digest=provenance.manifest_digest(df), declared={"images": 8, "groups": 8, "train": 4})
    assert [r["check"] for r in good.where("not ok").collect()] == []
    bad = {r["check"]: r for r in curation.preflight(df.withColumn("target", F.col("target") * 2), links, digest="x", declared={"images": 9, "test": 2}).collect()}
    assert {c for c, r in bad.items() if not r["ok"]} == {"target_binary", "digest_matches", "report_agrees"}
    assert bad["target_binary"]["n_bad"] == 4 and bad["target_binary"]["examples"] == ["i1"] and bad["report_agrees"]["examples"] == ["images"]

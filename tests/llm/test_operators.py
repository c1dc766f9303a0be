"""Operators on their own: properties, hand-made cases and accuracy."""

import base64
import random
from importlib.resources import files

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curatrix.llm import byte_bpe, inner_products, language_mixture, license_scan, mixing, mpeg_audio, pu_quality, simhash, skip_chain_pii, substring_dedup

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def codecs():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return byte_bpe.Codec(raw, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from(list("abtheing AE'sé ß\n\t\x85\xa0日本🙂01.,!")) | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_bpe_equals_tiktoken(codecs, text):
    mine, theirs = codecs
    ids = mine.encode(text)
    assert ids == theirs.encode_ordinary(text) and mine.decode(ids) == text.encode()


def test_bpe_of_long_runs(codecs):
    mine, theirs = codecs
    for text in ("a" * 50_000, "éß" * 10_000, "=" * 30_001, " " * 5_000):
        assert mine.encode(text) == theirs.encode_ordinary(text)


def test_bpe_forgets_without_change(codecs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECE_MEMO", 3)
    monkeypatch.setattr(byte_bpe, "PAIR_MEMO", 3)
    mine, theirs = codecs
    text = " ".join(f"word{i}ing" for i in range(50))
    assert mine.encode(text) == theirs.encode_ordinary(text) == mine.encode(text)


# ---- audio


def frame(bits=9, hertz=0, padding=0, crc=True, fill=b""):
    head = bytes([0xFF, 0xFA if crc else 0xFB, bits << 4 | hertz << 2 | padding << 1, 0xC0])
    h = mpeg_audio.header(head)
    side = bytes(h.side)
    body = head + (mpeg_audio.crc16(head[2:] + side).to_bytes(2, "big") if crc else b"") + side + fill
    return body.ljust(h.size, b"\0")


def test_frame_sizes():
    assert len(frame(9, 0)) == 417 and len(frame(9, 0, 1)) == 418  # 128 kbit/s at 44.1 kHz
    assert mpeg_audio.header(b"\xff\xff\xff\xff") is None and mpeg_audio.header(b"\xff\xfb\x00\xc0") is None and mpeg_audio.header(b"ab") is None
    one = mpeg_audio.header(bytes([0xFF, 0xFF, 0x10, 0xC0]))  # layer I, 32 kbit/s
    assert (one.layer, one.size, one.samples) == (1, 32000 * 12 // 44100 * 4, 384)


def test_variable_bitrate_offsets_and_duration():
    frames = [frame(b, 0, i % 2) for i, b in enumerate((9, 11, 5, 14, 9))]
    s = mpeg_audio.read_stream(b"".join(frames))
    assert s.offsets == [sum(map(len, frames[:i])) for i in range(5)] and s.duration == (32, 245)  # 5 * 1152 / 44100
    assert s.bad == 0 and s.checked == 5 and s.resyncs == 0


def test_resynchronises_after_junk_and_counts_bad_checksums():
    a, b = frame(9), frame(9)
    torn = bytearray(b)
    torn[8] ^= 1  # in the protected part
    data = b"junk\xff\xfb" + a + a + b"\xff\xfa\x90" * 9 + a + bytes(torn) + a + b"\xff"
    s = mpeg_audio.read_stream(data)
    assert s.offsets == [6, 423, 867, 1284, 1701] and s.bad == 1 and s.resyncs == 2


def test_tables_and_tags():
    table = frame(9, fill=b"Xing" + (7).to_bytes(4, "big") + (2).to_bytes(4, "big") + (1251).to_bytes(4, "big") + bytes(range(100)))
    tag = mpeg_audio._id3(7)
    v1 = b"TAG" + b"a title".ljust(30, b"\0") + bytes(95)
    s = mpeg_audio.read_stream(tag + table + frame(9) + frame(9) + v1)
    assert (s.table, s.table_frames, s.table_bytes, s.toc) == ("Xing", 2, 1251, list(range(100)))
    assert s.tags == {"TXXX:payload_bytes": "7", "id3v1:title": "a title"} and len(s.offsets) == 2
    vbri = bytearray(frame(9))
    vbri[36 : 36 + 30] = b"VBRI" + bytes(6) + (900).to_bytes(4, "big") + (2).to_bytes(4, "big") + b"\0\2\0\1\0\2" + bytes(2) + b"\0\5\0\6"
    s = mpeg_audio.read_stream(bytes(vbri) + frame(9) + frame(9))
    assert (s.table, s.table_frames, s.table_bytes, s.toc) == ("VBRI", 2, 900, [5, 6])
    assert mpeg_audio.read_stream(b"").offsets == [] and mpeg_audio.feature(mpeg_audio.read_stream(b"nothing")) == "none"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000) | st.lists(st.sampled_from([b"\xff\xf2\xd8\xc0", b"\xff\xfb\x90\xc0", b"\xff", b"ID3", b"TAG", b"Xing"]), max_size=400).map(b"".join))
def test_any_bytes_come_back(raw):
    media = mpeg_audio.write_stream(raw)
    s = mpeg_audio.read_stream(media)
    assert mpeg_audio.stored_payload(media, s) == mpeg_audio.pad(raw) and s.bad == 0 and s.tags["TXXX:payload_bytes"] == str(len(raw))


@pytest.mark.parametrize("mode, covered", [(0x00, 32), (0x40, 18), (0x50, 20), (0x60, 22), (0x70, 24), (0x80, 32), (0xC0, 16)])
def test_layer_one_checksums(mode, covered):
    head = bytes([0xFF, 0xFE, 0x50, mode])  # layer I, protected
    size, body = mpeg_audio.header(head).size, bytes(range(1, covered + 1))
    whole = (head + mpeg_audio.crc16(head[2:] + body).to_bytes(2, "big") + body).ljust(size, b"\x55")
    broken = whole[: 5 + covered] + b"\0" + whole[6 + covered :]  # the last byte that is covered
    s = mpeg_audio.read_stream(whole + broken + whole)
    assert (len(s.offsets), s.checked, s.bad) == (3, 3, 1)


# ---- fingerprints


def test_every_near_pair_meets_on_the_ring():
    r = random.Random(1)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), 4):
            b ^= 1 << bit
        keys, starts = simhash.ring_keys(np.array([a, b], np.uint64))
        shared = [int(starts[j]) for j in np.flatnonzero(keys[0] == keys[1])]
        assert any(len(simhash._near(np.array([b], np.uint64), np.uint64(a), s)) for s in shared)


def test_dense_groups_stay_linear():
    r = random.Random(2)
    centre = r.getrandbits(64)
    marks = {centre ^ sum(1 << b for b in r.sample(range(38), r.randint(0, 3))) for _ in range(6000)}
    fp = np.array(sorted(marks), np.uint64)
    links = simhash.links_under_key(fp, 0)
    assert len(links) < 2 * len(fp)
    assert all(bin(int(fp[a] ^ fp[b])).count("1") <= 4 for a, b in links[:500])


def test_a_repeated_id_keeps_its_own_class(spark):
    copied, own = "a text that stands under two ids of the table", "unique words of one document that no other row has"
    df = spark.createDataFrame([(3, copied), (5, copied), (5, own)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(df).collect())) == [(3, copied), (5, own)]


# ---- suffix sort


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), min_size=76, max_size=76).map("".join), min_size=1, max_size=25), st.integers(0, 3))
def test_suffix_sort_equals_sorting_bytes(strings, groups):
    bytes_ = np.array([np.frombuffer(s.encode(), np.uint8) for s in strings])
    group = np.sort(np.arange(len(strings)) % (groups + 1))
    rows, column = np.arange(len(strings)), np.arange(len(strings)) % 3
    column = np.zeros_like(rows) + 2
    order = substring_dedup.Suffixes(bytes_).sort(group, rows, column)
    want = sorted(range(len(strings)), key=lambda i: (group[i], strings[i][2:52]))
    assert [(group[i], strings[i][2:52]) for i in order] == [(group[i], strings[i][2:52]) for i in want]


def test_hash_collisions_are_found_and_mended(monkeypatch):
    """With a hash that is the same for everything, verification falls back on bytes."""
    key = np.array([7, 7, 7], np.uint64)
    left = np.array([26, 26, 26], np.uint8)
    windows = np.array([1, 1, 1], np.uint8)
    bytes_ = np.array([[97] * 76, [98] * 76, [97] * 76], np.uint8)
    monkeypatch.setattr(substring_dedup, "context_hashes", lambda *a: np.zeros(3, np.uint64))
    first, order, group = substring_dedup.equal_contexts(key, left, windows, bytes_)
    assert len(first) == 2 and sorted(np.bincount(group).tolist()) == [1, 2]
    monkeypatch.setattr(substring_dedup.Suffixes, "common", lambda self, a, b, c: np.full(len(a), substring_dedup.WINDOW))
    got = substring_dedup.least_by_window(key[:2], left[:2], windows[:2], bytes_[:2], np.array([5, 9]))
    assert got[0, 0] == 5 and got[1, 0] == 9


def test_one_passage_in_many_documents(spark):
    r = random.Random(3)
    passage = " ".join(str(r.random()) for _ in range(12))
    rows = [(i, f"{r.random()} {passage} {r.random()}") for i in range(400)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sum(x["n_removed"] >= len(passage) for x in got) == 399
    assert {bytes(x["kept"]) for x in got if x["doc_id"] == 0} == {rows[0][1].encode()}


# ---- licences, products, mixtures


def test_license_template_with_gaps():
    text = license_scan.TEMPLATES["mit"].replace("free of charge, ", "").replace("substantial", "all important and substantial")
    got = license_scan.scan_text(("noise here " + text).encode())
    assert got["labels"] == ["mit"] and got["n_base"] == 0 and 0.85 < got["score"] < 1.0
    assert (got["spans"][0]["start"], got["spans"][0]["end"]) == (6, got["n_words"])  # the first four words are too short a run
    assert license_scan.scan_text(b"the software is provided to the public")["labels"] == []


@pytest.mark.parametrize("label, text", license_scan.MORE + list(license_scan.TEMPLATES.items()))
def test_sibling_licences_are_told_apart(label, text):
    assert license_scan.scan_text(("Copyright 2020 someone. " + text + " More follows.").encode())["labels"] == [label]


@pytest.mark.parametrize("label", license_scan.BODIES)
def test_any_part_of_a_body_is_labelled(label):
    tokens = license_scan.words((files("curatrix.llm") / "licenses" / f"{label}.txt").read_bytes())
    got = [license_scan.scan_text(b" ".join(tokens[i : i + 250]))["labels"] for i in range(0, len(tokens) - 250, 250)]
    assert all(label in x for x in got) and license_scan.scan_text(b" ".join(tokens))["labels"] == [label]


def test_matching_statistics_equal_brute_force():
    r = random.Random(4)
    a = license_scan.automaton()
    vocabulary = list(a.vocabulary)
    templates = [t for _, _, t in a.templates]
    tokens = []
    for _ in range(60):
        t = r.choice(templates)
        i = r.randrange(len(t))
        tokens += t[i : i + r.randint(1, 12)] + [r.choice(vocabulary + [b"unknownword"])]
    runs = a.scan([a.vocabulary.get(t) for t in tokens])[1]
    inside = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    want = []
    for e in range(len(tokens)):
        n = max((k for k in range(1, e + 2) if tuple(tokens[e - k + 1 : e + 1]) in inside), default=0)
        want.append(n)
    maximal = [(e, n) for e, n in enumerate(want) if n >= license_scan.MIN_RUN and (e + 1 == len(want) or want[e + 1] != n + 1)]
    assert [(e, n) for e, n, _ in runs] == maximal


def test_products_prune_without_loss():
    r = np.random.default_rng(5)
    c = r.integers(-300, 300, (5000, 16)).astype(float) * r.random((5000, 1)).round(1)
    c = np.floor(c)
    q = c[::100]
    turn, stops = inner_products.rotation(c.T @ c)
    rows, ids, score = inner_products.search(np.arange(0, 5000, 100), q, np.arange(5000), c, turn, stops, 5, np.full(50, -np.inf))
    for k in range(50):
        s = c @ q[k]
        want = sorted((-s[i], i) for i in range(5000) if i != 100 * k)[:5]
        assert [(-a, b) for a, b in zip(score[rows == k], ids[rows == k])] == want


def test_products_of_other_dimensions_are_an_error(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [1.0, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError):
        inner_products.top_inner_products(df, F.col("id") % 50 == 0)


def test_products_with_empty_vectors_equal_sql(spark):
    import duckdb

    rows = [(0, [1.0, 2.0]), (50, []), (100, [-3.0, 1.0]), (100, []), (7, [-1.0, -1.0]), (8, []), (9, [2.0, 0.5]), (10, [0.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = inner_products.top_inner_products(df, F.col("id") % 50 == 0)
    with duckdb.connect() as db:
        db.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
        db.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
        want = db.execute(inner_products.OP6_SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_mixture_takes_near_its_targets(spark):
    r = random.Random(6)
    rows = [(i, "w " * int(r.paretovariate(1.2) * 5), f"s{min(3, int(r.expovariate(1)))}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.systematic_mix(df).cache()
    largest = got.agg(F.max("size")).first()[0]
    for row in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(row["t"] - row["g"]) <= 2 * largest
    assert got.agg(F.max("copies")).first()[0] <= 2
    clash = df.withColumn("size", F.lit("x")).withColumn("target", F.lit("y"))
    assert mixing.systematic_mix(clash).agg(F.sum("taken")).first() == got.agg(F.sum("taken")).first()


def test_mixture_of_two_languages_is_seen(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, logs = language_mixture.fit(docs.where(~language_mixture.held_out("doc_id")))
    text = {r["lang"]: r["text"] for r in docs.where("n_chars > 2000").dropDuplicates(["lang"]).collect()}
    (lang, share, parts), (one, whole, single) = language_mixture.infer([text["en"][:900] + " " + text["de"][:600], text["fr"][:900]], names, logs)
    assert lang == "en" and 0.4 < share < 0.8 and sum(p > 0 for p in parts) == 2 and parts[names.index("de")] > 0.25
    assert (one, sum(p > 0 for p in single)) == ("fr", 1) and whole == 1.0


def test_held_out_accuracy(spark):
    from curatrix.llm import queries

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lang = queries.QUERIES["op5_language_mixture"](spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.97
    marks = spark.read.parquet(f"{DATA}/labels.parquet")
    quality = queries.QUERIES["op2_pu_quality"](spark, DATA).join(marks, "doc_id").where("held_out")
    assert quality.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.95


def test_prior_from_positives_and_unlabelled():
    r = np.random.default_rng(7)
    for prior in (0.3, 0.8):
        positive = np.c_[r.normal(2, 1, (1500, 2)), np.ones(1500)]
        n = int(3000 * prior)
        unlabelled = np.c_[np.r_[r.normal(2, 1, (n, 2)), r.normal(-2, 1, (3000 - n, 2))], np.ones(3000)]
        assert pu_quality.estimate_prior(positive, unlabelled) == pytest.approx(prior, abs=0.08)
        w = pu_quality.fit_nnpu(positive, unlabelled, prior)
        assert ((unlabelled[:n] @ w) > 0).mean() > 0.95 and ((unlabelled[n:] @ w) < 0).mean() > 0.95


# ---- personal data


def test_beliefs_equal_enumeration_on_a_tree():
    r = np.random.default_rng(8)
    unary = r.normal(size=(4, skip_chain_pii.LABELS))
    left, right = np.array([0, 1, 1]), np.array([1, 2, 3])
    pair = r.normal(size=(3, skip_chain_pii.LABELS, skip_chain_pii.LABELS))
    got = skip_chain_pii.beliefs(unary, left, right, pair)
    k = skip_chain_pii.LABELS
    total = np.zeros((k,) * 4)
    for index in np.ndindex(*total.shape):
        total[index] = np.exp(sum(unary[i, x] for i, x in enumerate(index)) + sum(pair[e, index[a], index[b]] for e, (a, b) in enumerate(zip(left, right))))
    total /= total.sum()
    want = np.stack([total.sum(axis=tuple(j for j in range(4) if j != i)) for i in range(4)])
    assert np.allclose(got, want, atol=2e-3)


def test_repeated_tokens_get_their_spans_label():
    field = skip_chain_pii.Field([])
    text = "Call +1 (988) 555-2485 or mail bosbt.42@mail8.example.com. Later (988) 555-2485; ask bosbt.42 there, version 2.0, room 12."
    base, spans = skip_chain_pii.find_spans([text], field)[0]
    assert {text[a:b] for _, a, b in set(spans) - set(base)} == {"(988) 555-2485", "bosbt.42"}
    assert skip_chain_pii.masked(text, spans) == "Call [PHONE] or mail [EMAIL]. Later [PHONE]; ask [EMAIL] there, version 2.0, room 12."
    alone = "ask bosbt.42 there, (988) 555-2485, order 4111111111111112"
    assert skip_chain_pii.find_spans([alone], field)[0][1] == []


class Doubtful(skip_chain_pii.Field):
    """All candidates' own evidence is the least there can be."""

    def unary(self, kinds, feats):
        out = super().unary(kinds, feats)
        out[kinds == skip_chain_pii.OTHER] = [skip_chain_pii.OWN_ODDS[0]] * skip_chain_pii.OTHER + [0.0]
        return out


@pytest.mark.parametrize("n", [1, 2, 6, 40, 1000])
def test_mentions_do_not_outvote_a_known_span(n):
    for field in (skip_chain_pii.Field([]), Doubtful([])):
        for text in ("Call +1 (988) 555-2485 now." + " Later (988) 555-2485 again." * n, "(988) 555-2485 or " * n + "+1 (988) 555-2485."):
            base, spans = skip_chain_pii.find_spans([text], field)[0]
            assert len(base) == 1 and len(spans) == n + 1


@pytest.mark.parametrize("n", [1, 6, 40])
def test_mentions_of_mentions(n):
    text = "Mail bosbt.42@mail8.example.com, bosbt.42@work or " + "bosbt42work " * n
    base, spans = skip_chain_pii.find_spans([text], Doubtful([]))[0]
    assert len(base) == 1 and len(spans) == n + 2


def test_neighbours_alone_make_no_span():
    field = skip_chain_pii.Field([(1, 0, 0, 1000), (1, skip_chain_pii.OTHER, skip_chain_pii.OTHER, 1000)])
    text = " ".join(f"write a{i}@b.com item 1234567" for i in range(60))
    base, spans = skip_chain_pii.find_spans([text], field)[0]
    assert len(base) == 60 and spans == base


def test_addresses_with_very_many_zeros():
    text = "0" * 6000 + "1.2.3.4 and 1.2.3." + "9" * 6000
    assert skip_chain_pii.base_spans(text) == [(1, 0, 6007)]


def test_scanning_is_linear():
    import time

    field = skip_chain_pii.Field([])
    for text in ("1" * 200_000, "a" * 200_000, "@" * 200_000, "1." * 100_000, "+1" * 100_000, "a." * 50_000 + "@", "1a" * 100_000):
        began = time.perf_counter()
        skip_chain_pii.find_spans([text], field)
        assert time.perf_counter() - began < 10


def test_masking_keeps_all_else(spark):
    df = spark.createDataFrame([(1, "mail a@b.com", "x"), (2, None, "y"), (None, "", "z")], "doc_id long, text string, spans string")
    got = skip_chain_pii.mask_pii(df, skip_chain_pii.Field([])).collect()
    assert [tuple(r) for r in got] == [(1, "mail [EMAIL]", "x"), (2, None, "y"), (None, "", "z")]

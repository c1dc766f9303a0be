"""Operators against plain versions of what they compute, where test_queries.py does not do so."""

import hashlib
import itertools
import math
import random
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import inner_products, language_mixture, license_scan, mixing, mpeg_audio, pu_quality, simhash, skip_chain_pii, substring_dedup
from tests.llm.test_queries import classes, fingerprint, held_out, removed


def near_copies(r, n):
    """Fingerprints in clusters: a few bits from one another, so that many share keys."""
    out = set()
    for _ in range(n):
        centre = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 40])):
            out.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))))
    return sorted(out)


@pytest.mark.parametrize("hot", [1, 8, 1 << 15])
def test_links_do_not_depend_on_what_counts_as_a_hot_key(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    marks = near_copies(random.Random(11), 12)
    signed = [(m - (1 << 64) if m >> 63 else m,) for m in marks]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long").repartition(3)).collect()
    mask = (1 << 64) - 1
    parent = {m: m for m in marks}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert bin((a ^ b) & mask).count("1") <= 4
        x, y = sorted((find(a & mask), find(b & mask)))
        parent[y] = x
    assert {m: find(m) for m in marks} == classes(marks)
    assert len(links) < 5 * len(marks) * 64


def kept(rows):
    """One row of each class by the definition."""
    marks = [fingerprint(t) for _, t in rows]
    roots = classes(marks)
    groups = {}
    for row, m in zip(rows, marks):
        groups.setdefault(roots[m], []).append(row)
    return sorted((min(g, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or "")) for g in groups.values()), key=repr)


def test_every_class_keeps_a_row_of_its_own(spark):
    dup, other = "one text that three rows of this table share with each other", "words that stand in a single row and nowhere else at all"
    rows = [(2, dup), (6, dup), (6, other)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(2, dup), (6, other)] == kept(rows)
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefgh") * 3 + str(r.randrange(50)) for _ in range(r.randint(1, 30))) for _ in range(25)]
    texts += [t + " tail" for t in texts[:8]] + ["", None, "  "]
    rows = [(r.choice([None, *range(12)]), r.choice(texts)) for _ in range(160)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect()), key=repr) == kept(rows)
    one = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), distinct_ids=True).where("doc_id is not null")
    ids = [x["doc_id"] for x in one.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {i for i, _ in kept(rows) if i is not None}


def vectors_of(r, n, dim=8):
    return [(i, [round(r.gauss(0, 1) * r.choice([0.2, 1, 3]), 3) for _ in range(dim)]) for i in range(n)]


def by_sql(rows):
    with duckdb.connect() as db:
        db.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
        db.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
        return sorted(db.execute(inner_products.OP6_SQL).fetchall())


def test_products_in_rounds_and_of_mixed_lengths_equal_sql(spark, monkeypatch):
    monkeypatch.setattr(inner_products, "BLOCK", (7, 7))
    monkeypatch.setattr(inner_products, "FIRST_ROUND", 2)
    monkeypatch.setattr(inner_products, "HEAD", 6)
    rows = vectors_of(random.Random(3), 400)
    rows[100] = (100, rows[100][1][:3])
    rows += [(700, rows[0][1] + [5.0, -1.0]), (701, [2.0]), (702, []), (703, rows[5][1]), (703, rows[5][1]), (750, [1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = inner_products.top_inner_products(df, F.col("id") % 50 == 0, mixed=True)
    assert sorted(map(tuple, got.collect())) == by_sql(rows)


def test_candidates_are_shuffled_once(spark):
    for n in (3_000, 12_000):
        df = spark.createDataFrame(vectors_of(random.Random(n), n, 3), "vec_id long, embedding array<float>")
        vectors = inner_products.integer_vectors(df, "vec_id", "embedding", 256.0)
        layout = inner_products.layout_of(vectors, n)
        blocks = [x["count"] for x in inner_products.held(vectors, layout).groupBy("block").count().collect()]
        assert sum(blocks) == n and layout.blocks == len(blocks) <= 2 * n / inner_products.BLOCK[0] + 1


def test_copies_do_not_make_a_large_block(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9_000)] + [(9_000 + i, [float(i), 0.0]) for i in range(500)], "vec_id long, embedding array<float>")
    vectors = inner_products.integer_vectors(df, "vec_id", "embedding", 256.0)
    layout = inner_products.layout_of(vectors, 9_500)
    assert inner_products.held(vectors, layout).groupBy("block").count().agg(F.max("count")).first()[0] < 1.3 * inner_products.BLOCK[0]


def spaced(r, n):
    """Texts in which one run of blanks stands in many different contexts, some of them shared."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9)))
    pieces = [" ".join(word() for _ in range(6)) for _ in range(n // 3)]
    return [(i, " ".join(word() for _ in range(4)).join(["", " " * r.choice([24, 25, 40, 90]) + r.choice(pieces) + " " * 30, word()])) for i in range(n)]


@pytest.mark.parametrize("least", [2, 1 << 20])
def test_hot_seeds_change_nothing(spark, monkeypatch, least):
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", least)
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 1000)
    monkeypatch.setattr(substring_dedup, "MANY", least)
    rows = spaced(random.Random(8), 300) + [(1000, "ab" * 200), (1001, "ab" * 150 + "c" + "ab" * 90), (None, "ab" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hot = substring_dedup.hot_seeds(df, 4)
    assert (len(hot) > 0) == (least == 2)
    got = substring_dedup.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(removed(rows), key=repr)


def test_a_hot_seed_goes_to_many_buckets(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(40))
    for seed in ("".join(r.choice("qrstuvwxyz") for _ in range(24)) for _ in range(200)):  # one that is often the least of its windows
        raws = [f"{word()}{seed}{word()}".encode() for _ in range(2000)]
        doc, key, at, _, _ = substring_dedup.text_anchors(raws)
        if (at == 40).sum() > 1500:
            break
    columns = list(substring_dedup.contexts_of(raws, [np.array([40], np.uint32)] * len(raws)))
    columns[1] = columns[1] & np.uint64(2**64 - 2**16)
    assert len(np.unique(columns[1])) == 1
    split = substring_dedup.told_apart(columns[1][:1], *columns)
    assert len(np.unique(split[1])) > 1000 and split[4].sum() == columns[4].sum()
    for row, key, first, left, windows, bytes_ in list(zip(*split))[:500]:
        column = substring_dedup._LEFT - left
        assert raws[row][first : first + windows + 49] == bytes(bytes_[column : column + windows + 49])


def test_wrong_order_is_found(monkeypatch):
    bytes_ = np.array([[100] * 76, [97] * 76, [100] * 76], np.uint8)
    one = np.ones(3, np.uint8)
    monkeypatch.setattr(substring_dedup.Suffixes, "sort", lambda self, group, row, column: np.arange(len(group)))
    got = substring_dedup.least_by_window(np.full(3, 7, np.uint64), one * 26, one, bytes_, np.array([5, 9, 3]))
    assert got[:, 0].tolist() == [3, 9, 3]


def marginals(text, field):
    """Label distributions of a small text's nodes by enumerating all labellings."""
    P = skip_chain_pii
    nodes = P.nodes_of(text, P.base_spans(text))
    unary = field.unary(np.array([n[0] for n in nodes]), np.array([P.features(text, n) for n in nodes]))
    skips = P.links(text, nodes)
    by_steps = field.links(max((s for *_, s in skips), default=1))
    edges = [(i, i + 1, field.chain) for i in range(len(nodes) - 1)] + [(a, b, by_steps[s - 1]) for a, b, s in skips]
    total = np.zeros((len(nodes), P.LABELS))
    for labels in itertools.product(*([n[0]] if n[0] != P.OTHER else range(P.LABELS) for n in nodes)):
        weight = np.exp(sum(unary[i, y] for i, y in enumerate(labels)) + sum(pair[labels[a], labels[b]] for a, b, pair in edges))
        for i, y in enumerate(labels):
            total[i, y] += weight
    return nodes, skips, total / total.sum(axis=1, keepdims=True)


TEXTS = [
    "Call +1 (988) 555-2485 at 10:30 or (988) 555-2485, not (988) 555-2486.",
    "From 10.1.2.3 and later 10-1-2-3, or 10123, version 1.2.3, again 10-1-2-3.",
    "Mail jane.doe@mail.example.com; jane.doe or jane.doe9 answers, card 4111 1111 1111 1111 as 4111.1111.1111.1111",
    "Order 1234567 twice: 1234567, room 12.",
]


@pytest.mark.parametrize("text", TEXTS)
def test_added_spans_equal_enumeration(spark, text):
    P = skip_chain_pii
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for field in (P.Field([]), P.train(docs)):
        nodes, skips, share = marginals(text, field)
        known = {i for i, n in enumerate(nodes) if n[0] != P.OTHER}
        tied = {x for a, b, _ in skips for x, y in ((a, b), (b, a)) if y in known}
        want = sorted(P.base_spans(text) + [(int(share[i].argmax()), *nodes[i][1:]) for i in tied - known if share[i].argmax() != P.OTHER and share[i].max() >= P.SURE])
        assert P.find_spans([text], field)[0][1] == want


def test_short_numbers_are_linked_by_their_groups():
    base, spans = skip_chain_pii.find_spans([TEXTS[1]], skip_chain_pii.Field([]))[0]
    assert {TEXTS[1][a:b] for _, a, b in spans} == {"10.1.2.3", "10-1-2-3"} and len(spans) == 3


def test_spans_do_not_depend_on_the_texts_beside(spark):
    field = skip_chain_pii.Field([])
    texts = TEXTS + ["Call +1 (988) 555-2485." + " Or (988) 555-2485" * n for n in (1, 20, 80)]
    together = skip_chain_pii.find_spans(texts, field)
    assert together == [skip_chain_pii.find_spans([t], field)[0] for t in texts] and len(together[-1][1]) == 81


def test_weights_are_where_the_pseudo_likelihood_is_greatest():
    P = skip_chain_pii
    r = np.random.default_rng(4)
    around = np.unique(np.concatenate([((r.integers(0, 6, 30) * 6 + r.integers(0, 6, 30)) << P.LABELS) | r.integers(0, 32, 30)]))
    counts = r.integers(0, 40, (len(around), P.LABELS)).astype(float)
    w = P.fit_weights(around, counts)
    before = np.zeros(P.WEIGHTS)
    before[-1] = P.LINK_BEFORE

    def value(w):  # one node at a time
        out = -P.PRECISION / 2 * ((w - before) ** 2).sum()
        for code, row in zip(around, counts):
            left, right, linked = (code >> P.LABELS) // 6, (code >> P.LABELS) % 6, code & 31
            score = np.zeros(P.LABELS)
            for y in range(P.LABELS):
                score[y] = w[y] + (w[P.LABELS + left * 5 + y] if left < 5 else 0) + (w[P.LABELS + y * 5 + right] if right < 5 else 0) + w[-1] * (linked >> y & 1)
            out += (row * (score - np.log(np.exp(score).sum()))).sum()
        return out

    best = value(w)
    assert best == pytest.approx(P.pseudo_likelihood(P.weight_design(around), counts, w, before)[0])
    for k in range(P.WEIGHTS):
        for d in (-1e-3, 1e-3):
            moved = w.copy()
            moved[k] += d
            assert value(moved) < best


def best_chain(parts):
    """Most words that any chain of these parts covers, by trying all chains."""
    gap = license_scan.MAX_GAP

    def longest(i):  # chains that end with part i
        end, place, size = parts[i]
        out = size
        for j in range(i):
            e, p, _ = parts[j]
            overlap = max(0, e - (end - size), p - (place - size))
            if place > p and end - size - e <= gap and place - size - p <= gap and overlap < size:
                out = max(out, longest(j) + size - overlap)
        return out

    return max(map(longest, range(len(parts))))


def test_chains_equal_brute_force():
    r = random.Random(12)
    letters = [chr(97 + i) * 2 for i in range(14)]
    for _ in range(60):
        templates = tuple((f"t{k}", " ".join(r.choice(letters) for _ in range(30))) for k in range(2))
        a = license_scan.automaton(templates)
        tokens = []
        while len(tokens) < 70:
            t = r.choice(templates)[1].split()
            i = r.randrange(len(t))
            tokens += t[i : i + r.randint(5, 14)] + ["zz"] * r.randint(0, 10)
        runs = a.scan([a.vocabulary.get(t.encode()) for t in tokens])[1]
        found = a.chains(runs)
        for t, parts in a.pieces(runs).items():
            mine = [x for x in found if x[0] == t]
            assert max(x[1] for x in mine) == min(1.0, best_chain(parts) / 30)
            extents = sorted(x[2:] for x in mine)
            assert all(b < c for (_, b), (c, _) in zip(extents, extents[1:]))
            assert all(any(x <= end <= y or x <= end - size + 1 <= y for x, y in extents) for end, _, size in parts)


def test_every_copy_of_a_licence_has_a_span(spark):
    mit = license_scan.TEMPLATES["mit"]
    n = len(license_scan.words(mit.encode()))
    got = license_scan.scan_text(f"{mit} some other words {mit}".encode())
    assert [(s["label"], s["start"], s["end"]) for s in got["spans"]] == [("mit", 0, n), ("mit", n + 3, 2 * n + 3)]
    df = spark.createDataFrame([(1, "one two three four five six seven"), (2, mit), (3, "cc by nc")], "doc_id long, text string")
    got = license_scan.license_scan(df, templates=[("own", "two three four five six seven eight")]).orderBy("doc_id").collect()
    assert [x["labels"] for x in got] == [["own"], [], ["cc-by-nc"]]


def test_many_copies_take_linear_time():
    import time

    began = time.perf_counter()
    got = license_scan.scan_text((license_scan.TEMPLATES["isc"] + " and more. ").encode() * 3000)
    assert len(got["spans"]) == 3000 and time.perf_counter() - began < 20


def plain_languages(rows):
    """Language and share of every text: trigrams counted in dictionaries, proportions by many rounds on one text at a time, every nested set tried."""

    def word_grams(text):
        code = [0]
        for b in (text or "").lower().encode():
            code.append(b - 96 if 97 <= b <= 122 else 32 + (b & 31) if b >= 128 else 0)
        code.append(0)
        out, word = [], []
        for a, b, c in zip(code, code[1:], code[2:]):
            if b:
                word.append((a, b, c))
            elif word:
                out.append(word)
                word = []
        return out + ([word] if word else [])

    counts = {}
    for i, t, lang, _ in rows:
        if not held_out(i) and lang is not None and t is not None:
            n = counts.setdefault(lang, Counter())
            for word in word_grams(t):
                n.update(word)
    names = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.5 * 2**18 for x in names}
    out = []
    for _, t, *_ in rows:
        words = word_grams(t)
        if not any(map(str.isalpha, t or "")):
            out.append(("und", 0.0))
            continue
        log = np.array([[sum(np.log((counts[x][g] + 0.5) / total[x]) for g in w) for x in names] for w in words])
        like = np.exp(np.maximum(log - log.max(axis=1, keepdims=True), -60))

        def mixed(some):
            s = np.full(len(some), 1 / len(some))
            for _ in range(3000):
                p = like[:, some] * s
                s = (p / p.sum(axis=1, keepdims=True)).mean(axis=0)
            return s, np.log((like[:, some] * s).sum(axis=1)).sum()

        order = np.argsort(-mixed(range(len(names)))[0], kind="stable")
        single = np.log(like).sum(axis=0)
        best, got = single.max(), (names[int(single.argmax())], 1.0)
        for m in range(2, len(names) + 1):
            s, value = mixed(order[:m])
            value -= (m - 1) * language_mixture.PENALTY * np.log(max(2, len(words)))
            if value > best + 1e-6:
                lead = min(range(m), key=lambda i: (-s[i], names[order[i]]))
                best, got = value, (names[order[lead]], s[lead])
        out.append(got)
    return out


def test_languages_equal_brute_force(spark, awkward, rows):
    from curatrix.llm import queries

    r = random.Random(6)
    some = [x for x in rows if len(x[1] or "") < 3000]
    mixed = [(1000 + i, " ".join(w for _ in range(2) for w in (r.choice(some)[1] or "").split()[:30]), None, None) for i in range(40)]
    names, logs = language_mixture.fit(spark.read.parquet(f"{awkward}/documents.parquet").where(~language_mixture.held_out("doc_id")))
    want = plain_languages(rows + mixed)
    got = language_mixture.infer([x[1] for x in rows + mixed], names, logs)
    for (lang, share, _), (name, part) in zip(got, want):
        assert lang == name and share == pytest.approx(part, abs=0.02)
    answers = {(x["doc_id"], x["lang_pred"], round(x["score"], 6)) for x in queries.QUERIES["op5_language_mixture"](spark, awkward).collect()}
    assert answers == {(x[0], lang, round(share, 6)) for x, (lang, share, _) in zip(rows, got)}


def test_no_proportions_beat_those_found():
    r = np.random.default_rng(3)
    sizes = [1, 2, 7, 40, 400]
    like = np.exp(-r.exponential(2.0, (sum(sizes), 4)))
    like /= like.max(axis=1, keepdims=True)
    text = np.repeat(np.arange(5), sizes)
    starts = np.flatnonzero(np.diff(text, prepend=-1))
    usable = np.ones((5, 4), bool)
    usable[3, 1] = False
    share, value, gap = language_mixture._em(like, text, starts, np.full((5, 4), 0.25), usable)
    assert (gap <= language_mixture.GAP).all() and share[3, 1] == 0 and np.allclose(share.sum(axis=1), 1)
    for d in range(5):
        rows = like[text == d]
        assert value[d] == pytest.approx(np.log(rows @ share[d]).sum())
        for s in r.dirichlet(np.ones(4) * 0.5, 2000) * usable[d]:
            assert np.log(rows @ (s / s.sum()) + 1e-300).sum() <= value[d] + gap[d] + 1e-9


def plain_statistics(text):
    """The statistics as they are defined, character class by character class."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * 107 + [1.0]
    n, words, lines = len(raw), raw.split(), [x for x in raw.split(b"\n") if x]
    part = lambda test: sum(map(test, raw))
    upper, lower = part(lambda b: 65 <= b <= 90), part(lambda b: 97 <= b <= 122)
    high, digits = part(lambda b: b >= 128), part(lambda b: 48 <= b <= 57)
    letters = upper + lower + high
    marks = part(lambda b: 33 <= b <= 126) - upper - lower - digits
    out = [(raw.count(b) / n) ** 0.5 for b in range(32, 127)]
    out += [(high / n) ** 0.5, (part(lambda b: b < 32) / n) ** 0.5, upper / max(1, letters), letters / n, digits / n, marks / n]
    out += [np.log1p(n) / 10, np.log1p(len(words)) / 10, len(set(words)) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)) / 10]
    return out + [min(2.0, n / max(1, len(words)) / 10), 1.0]


def test_quality_scores_equal_brute_force(spark, awkward, rows):
    docs, labels = (spark.read.parquet(f"{awkward}/{t}.parquet") for t in ("documents", "labels"))
    quality = {}
    for x in labels.collect():
        if x["quality"] is not None:
            quality.setdefault(x["doc_id"], set()).add(x["quality"])
    trusted = {i for i, q in quality.items() if q == {1} and not held_out(i)}
    texts = [(i, t) for i, t, *_ in rows if t is not None and not held_out(i)]
    positive = np.array([plain_statistics(t) for i, t in texts if i in trusted])
    unlabelled = np.array([plain_statistics(t) for _, t in texts])
    got = pu_quality.sample(docs, labels, "doc_id", "text")
    for mine, want in zip(got, (positive, unlabelled)):
        assert np.allclose(np.array(sorted(mine.tolist())), np.array(sorted(want.astype(np.float32).tolist())), atol=1e-6)

    # the fit: standardised, the prior, then Adam on a risk whose slopes are taken numerically
    both = np.concatenate(got)
    mean, scale = both.mean(axis=0), both.std(axis=0)
    mean[-1], scale[-1] = 0, 1
    scale[scale <= 1e-6] = np.inf
    p, u = ((x - mean) / scale for x in got)
    prior = pu_quality.estimate_prior(p, u)
    model = pu_quality.fit(docs, labels)
    assert model["prior"] == pytest.approx(prior)
    w = model["weights"] * np.where(np.isinf(scale), 0, scale)
    w[-1] = model["weights"][-1] + float((model["weights"] * mean)[:-1].sum())
    assert np.allclose(w, pu_quality.fit_nnpu(p, u, prior), atol=1e-8)
    answers = pu_quality.score(docs, model, keep=("doc_id", "text")).collect()
    for x in answers:
        want = 1 / (1 + np.exp(-np.clip(np.array(plain_statistics(x["text"])) @ model["weights"], -30, 30)))
        assert x["score"] == pytest.approx(want, abs=1e-4) and x["predicted"] == int(x["score"] >= 0.5)


def test_conflicting_and_null_labels_make_no_trusted_positive(spark):
    ids = [i for i in range(60) if not held_out(i)][:6]
    docs = spark.createDataFrame([(i, f"text number {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 1), (ids[1], 1), (ids[1], 0), (ids[2], None), (ids[3], None), (ids[3], 1), (ids[4], 0), (None, 1)], "doc_id long, quality int")
    positive, unlabelled = pu_quality.sample(docs, labels, "doc_id", "text")
    assert (len(positive), len(unlabelled)) == (2, 6)  # ids 0 and 3


def test_risk_and_its_least_value():
    r = np.random.default_rng(1)
    positive, unlabelled = np.c_[r.normal(1, 1, (60, 3)), np.ones(60)], np.c_[r.normal(0, 1.3, (150, 3)), np.ones(150)]

    def value(w, prior):
        log = lambda x, s: np.mean([np.log1p(np.exp(-s * float(a @ w))) for a in x])
        return prior * log(positive, 1), log(unlabelled, -1) - prior * log(positive, -1)

    for prior, w in ((0.4, r.normal(size=4)), (0.9, r.normal(size=4) * 3)):
        first, second, *slopes = pu_quality.risk(positive, unlabelled, prior, w)
        assert value(w, prior) == pytest.approx((first, second))
        for k in range(4):
            d = np.eye(4)[k] * 1e-6
            for part, slope in enumerate(slopes):
                assert (value(w + d, prior)[part] - value(w - d, prior)[part]) / 2e-6 == pytest.approx(slope[k], abs=1e-5)
    w = pu_quality.fit_nnpu(positive, unlabelled, 0.15)
    assert value(w, 0.15)[1] > 0
    decay = (pu_quality.DECAY + 1 / 60) / 2
    total = lambda w: value(w, 0.15)[0] + max(0.0, value(w, 0.15)[1]) + decay * float(w @ w)
    best = total(w)
    assert all(total(w + r.normal(size=4) * size) > best - 1e-4 for size in (0.01, 0.1, 1.0) for _ in range(100))


def plain_crc(bits):
    value = 0xFFFF
    for bit in bits:
        top = value >> 15
        value = value << 1 & 0xFFFF
        if top != int(bit):
            value ^= 0x8005
    return value


def test_stored_form_equals_its_description(spark, awkward, rows):
    """Tag, table frame and frames built here from the store's description; feature and offsets from these bytes."""
    from curatrix.llm import queries

    bits = lambda b: "".join(f"{x:08b}" for x in b)
    head = bytes([0xFF, 0xF2, 0xD8, 0xC0])
    lead = head + plain_crc(bits(head[2:]) + "0" * 72).to_bytes(2, "big") + bytes(9)
    want = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        n = max(1, -(-len(raw) // 576))
        payload = raw.ljust(n * 576, b"\xff")
        text = b"\x03payload_bytes\0" + str(len(raw)).encode()
        tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
        tag = b"ID3\x04\0\0" + bytes([0, 0, 0, len(tag)]) + tag
        seek = bytes(min(255, (1 + k * n // 100) * 648 * 256 // ((n + 1) * 648)) for k in range(100))
        table = lead + b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + ((n + 1) * 648).to_bytes(4, "big") + seek
        frames = b"".join((lead + payload[a : a + 576]).ljust(648, b"\0") for a in range(0, n * 576, 576))
        media = tag + table.ljust(648, b"\0") + frames + b"TAG" + b"payload".ljust(30, b"\0") + bytes(95)
        offsets = [len(tag) + 648 * (k + 1) for k in range(n)]
        d = math.gcd(576 * n, 16000)
        feature = (
            f"mpeg2 layer3 16000Hz;frames={n};duration={576 * n // d}/{16000 // d};checksums={n}/{n};resyncs=0;table=Info:{n}:{(n + 1) * 648};first={offsets[0]};"
            f"step={648 if n > 1 else ''};offsets={zlib.crc32(struct.pack(f'<{n}q', *offsets)):08x};bytes={sum(payload)}/{len(set(payload))}/{zlib.crc32(payload):08x}"
        )
        want.setdefault((i, len(raw)), []).append((len(media), hashlib.sha256(media).hexdigest(), feature, zlib.crc32(",".join(map(str, offsets)).encode())))
    got = {}
    for x in queries.QUERIES["op3_mpeg_audio"](spark, awkward).collect():
        got.setdefault((x["doc_id"], x["n_bytes"]), []).append((x["media_bytes"], x["media_sha256"], x["feature"], x["seek_offsets_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("second, third, fourth", [(0xFC, 0x84, 0x00), (0xFC, 0xA0, 0xC0), (0xFC, 0x18, 0xC0), (0xFC, 0x10, 0xC0), (0xFC, 0x80, 0x50), (0xF4, 0x80, 0x00), (0xFC, 0xC0, 0x70)])
def test_layer_two_checksums(second, third, fourth):
    r = random.Random(second + third + fourth)
    head = bytes([0xFF, second, third, fourth])
    h = mpeg_audio.header(head)
    # allocation by subband from the standard's tables, then two bits for every channel and subband with any
    each = h.kbits // h.channels
    wide = [4] * 11 + [3] * 12 + [2] * 7
    if h.version != "1":
        table = [4] * 4 + [3] * 7 + [2] * 19
    elif each <= 48:
        table = [4, 4] + [3] * (10 if h.rate == 32000 else 6)
    else:
        table = wide if each >= 96 and h.rate != 48000 else wide[:27]
    bound = 4 * (fourth >> 4 & 3) + 4 if fourth >> 6 == 1 else 32
    bits, chosen = "", 0
    for sb, n in enumerate(table):
        for _ in range(1 if sb >= bound else h.channels):
            value = r.choice([0, r.randrange(1 << n)])
            bits += f"{value:0{n}b}"
            chosen += (h.channels if sb >= bound else 1) * (value > 0)
    bits += "".join(r.choice("01") for _ in range(2 * chosen))
    crc = plain_crc("".join(f"{x:08b}" for x in head[2:]) + bits)
    rest = "".join(r.choice("01") for _ in range(-len(bits) % 8 + 16))
    body = int(bits + rest, 2).to_bytes(len(bits + rest) // 8, "big")
    whole = (head + crc.to_bytes(2, "big") + body).ljust(h.size, b"\x55")
    flip = 6 + (len(bits) - 1) // 8
    broken = whole[:flip] + bytes([whole[flip] ^ 1 << (7 - (len(bits) - 1) % 8)]) + whole[flip + 1 :]
    s = mpeg_audio.read_stream(whole + broken + whole)
    assert (len(s.offsets), s.checked, s.bad) == (3, 3, 1)


def test_tags_delay_and_free_format():
    one = bytes([0xFF, 0xFB, 0x90, 0xC0]).ljust(417, b"\0")
    body = b"TIT2" + (6).to_bytes(4, "big") + b"\0\0" + b"\0a\xff\xe0bc"
    spread = body.replace(b"\xff", b"\xff\0")
    tag = b"ID3\x03\0\x80" + bytes([0, 0, 0, len(spread)]) + spread
    item = (5).to_bytes(4, "little") + bytes(4) + b"Album\0" + "Tür?".encode()
    foot = b"APETAGEX" + struct.pack("<IIII", 2000, len(item) + 32, 1, 1 << 31) + bytes(8)
    top = b"APETAGEX" + struct.pack("<IIII", 2000, len(item) + 32, 1, 5 << 29) + bytes(8)
    v1 = b"TAG" + b"old".ljust(125, b"\0")
    lame = (one[:4] + bytes(17) + b"Xing" + (0).to_bytes(4, "big") + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")).ljust(417, b"\0")
    s = mpeg_audio.read_stream(tag + lame + one * 4 + top + item + foot + v1)
    assert s.tags == {"TIT2": "a\xff\xe0bc", "ape:Album": "Tür?", "id3v1:title": "old"}
    assert (len(s.offsets), s.delay, s.ending, s.played, s.skipped) == (4, 576, 1000, 4 * 1152 - 1576, 0)
    d = math.gcd(s.played, 44100)
    assert s.duration == (s.played // d, 44100 // d)
    free = [bytes([0xFF, 0xFB, p << 1, 0xC0]).ljust(700 + p, b"\0") for p in (0, 1, 1, 0)]
    s = mpeg_audio.read_stream(b"junk\xff\xfb" + b"".join(free))
    assert s.offsets == [6, 706, 1407, 2108] and s.samples == 4 * 1152 and s.resyncs == 1


def test_rows_of_one_id_are_taken_alike_however_they_lie(spark):
    r = random.Random(14)
    rows = [(r.randrange(40), " ".join(r.choice("abcdef") for _ in range(r.choice([3, 4]))), r.choice("xy"), i) for i in range(400)]
    taken = []
    for n in (1, 3, 7):
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, other long").repartition(n)
        taken.append(sorted(tuple(x) for x in mixing.systematic_mix(df).select("doc_id", "text", "source", "other", "copies").collect()))
    assert taken[0] == taken[1] == taken[2]


def test_the_pipeline_repeats_row_by_row(spark, awkward):
    """Rows that share an id too: which of them the mixture takes does not hang on how they lie."""
    import corpus_pipeline

    key = lambda x: (x["doc_id"], x["lang"], x["source"], x["n_tokens"], tuple(x["ids"]))
    first, again = (Counter(map(key, corpus_pipeline.run(spark, awkward).collect())) for _ in range(2))
    assert first == again and sum(n > 1 for n in first.values())


def test_the_largest_id_counts_as_null_in_removal(spark):
    passage = "a passage of more than fifty bytes that stands in each of these rows"
    rows = [(2**63 - 1, "one " + passage), (None, "two " + passage), (5, passage + " three")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["n_removed"] >= len(passage) for x in got} == {2**63 - 1: True, None: True, 5: False}
    alone = substring_dedup.remove_repeats(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()
    assert [x["n_removed"] for x in alone] == [0, 0]


def test_operators_on_clashing_and_null_columns(spark):
    """Columns named like an operator's own, and rows that are null throughout, change nothing for the others."""
    rows = [(i, t, "en", "s", None) for i, t in enumerate(["the river and the stone", None, "", "mail a@b.com now", "the river and the stone"])] + [(None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, {} string"
    plain = spark.createDataFrame(rows, schema.format("other"))
    for name in ("fp", "root", "_text", "spread", "component_id", "_salt", "hx", "ord", "least", "block", "asks"):
        clash = spark.createDataFrame(rows, schema.format(name))
        a, b = (simhash.simhash_components(df).select("doc_id", "fingerprint", "component_id").collect() for df in (plain, clash))
        assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)
        assert sorted(map(tuple, simhash.keep_one(clash).select("doc_id", "text").collect()), key=repr) == sorted(map(tuple, simhash.keep_one(plain).select("doc_id", "text").collect()), key=repr)
        assert substring_dedup.remove_repeats(clash).count() == len(rows)
        if name in ("_text", "block"):
            assert license_scan.license_scan(clash).count() == mixing.mix_sizes(clash).count() == len(rows)

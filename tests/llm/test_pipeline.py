"""The pipeline's stages, one after the other, against plain Python versions of what they decide."""

import base64
import random
from collections import Counter

import pytest

import corpus_pipeline
from curatrix.llm import language_mixture, skip_chain_pii
from tests.llm.test_queries import classes, fingerprint, shares


def through(spark, docs, path, steps=None):
    out = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:steps]):
        stage(spark, docs, str(path)).write.parquet(f"{path}/{i}")
        docs = spark.read.parquet(f"{path}/{i}")
        out.append(docs)
    return out


def test_stages_against_brute_force(spark, awkward, tmp_path):
    source = spark.read.parquet(f"{awkward}/documents.parquet")
    first, second, third, fourth, last = through(spark, source, tmp_path)
    assert all(d.columns == source.columns for d in (first, second, third, fourth))
    rows = source.collect()

    # language: rejected documents go, the others keep all but their language
    names, logs = language_mixture.fit(source.where(~language_mixture.held_out("doc_id")))
    got = language_mixture.infer([r["text"] for r in rows], names, logs)
    want = [r.asDict() | {"lang": g[0]} for r, g in zip(rows, got) if g[0] != "und" and g[1] >= corpus_pipeline.MIN_SHARE]
    key = lambda r: repr(sorted(r.items(), key=str))
    kept = [r.asDict() for r in first.collect()]
    assert Counter(map(key, kept)) == Counter(map(key, want)) and 0 < len(rows) - len(kept) < 12

    # near-duplicates: one document of each class
    marks = [fingerprint(r["text"]) for r in kept]
    roots = classes(marks)
    least = {}
    for r, m in zip(kept, marks):
        order = (r["doc_id"] is None, r["doc_id"] or 0)
        least[roots[m]] = min(least.get(roots[m], order), order)
    chosen = Counter(v[1] if not v[0] else None for v in least.values())
    single = [r.asDict() for r in second.collect()]
    by_id = Counter(r["doc_id"] for r in single)
    assert set(by_id) == set(chosen) and all(n == 1 for i, n in by_id.items() if i is not None) and by_id[None] == chosen[None]
    texts = {(r["doc_id"], r["text"]) for r in kept}
    assert all((r["doc_id"], r["text"]) in texts for r in single)

    # personal data: nothing that a pattern finds is left, other texts are as they were
    masked = [r.asDict() for r in third.collect()]
    assert len(masked) == len(single)
    before = Counter(r["text"] for r in single if not skip_chain_pii.base_spans(r["text"] or ""))
    assert not before - Counter(r["text"] for r in masked)
    assert all(not skip_chain_pii.base_spans(r["text"] or "") and r["n_chars"] == len(r["text"]) for r in masked)

    # mixture: whole rows, twice at most, near each source's target
    mixed = [key(r.asDict()) for r in fourth.collect()]
    assert not Counter(mixed) - Counter({k: 2 * n for k, n in Counter(map(key, masked)).items()})
    size = lambda r: len(r["text"].split())
    _, target = shares((size(r), r["source"]) for r in masked)
    taken = Counter()
    for r in fourth.collect():
        taken[r["source"]] += size(r)
    for source_, goal in target.items():
        assert abs(taken[source_] - goal) <= 2 * max(size(r) for r in masked if r["source"] == source_)

    # tokens: those of tiktoken
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r["doc_id"], r["lang"], r["source"], tuple(enc.encode_ordinary(r["text"]))) for r in fourth.collect())
    coded = last.collect()
    assert Counter((r["doc_id"], r["lang"], r["source"], tuple(r["ids"])) for r in coded) == want
    assert all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in coded)


def test_run_equals_its_stages(spark, awkward, tmp_path):
    source = spark.read.parquet(f"{awkward}/documents.parquet")
    stages = through(spark, source, tmp_path)[-1]
    run = corpus_pipeline.run(spark, awkward)
    key = lambda r: (r["doc_id"], r["n_tokens"])
    tied = (None, 5, 6)
    assert Counter(key(r) for r in run.collect() if r["doc_id"] not in tied) == Counter(key(r) for r in stages.collect() if r["doc_id"] not in tied)


def test_empty_documents(spark, nothing, tmp_path):
    assert [d.count() for d in through(spark, spark.read.parquet(f"{nothing}/documents.parquet"), tmp_path)] == [0] * 5


@pytest.mark.parametrize("column", ["text", "lang", "source", "doc_id", "n_chars"])
def test_nulls_in_any_column(spark, tmp_path, column):
    r = random.Random(9)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [[i, " ".join(r.choice(["the", "of", "river", "stone", "and"]) for _ in range(30)), "en", "s", 10] for i in range(12)]
    for row in rows[:6]:
        row["doc_id text lang source n_chars".split().index(column)] = None
    out = through(spark, spark.createDataFrame([tuple(x) for x in rows], schema), tmp_path)
    assert out[0].count() == (6 if column == "text" else 12)
    assert out[-1].count() > 0

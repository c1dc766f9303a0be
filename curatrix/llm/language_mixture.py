"""Language identification by multilingual mixture inference.

Training counts byte trigrams of words (lower case, with word ends) for every language, over all training rows. A document is a
mixture: each of its words comes from one language, with the likelihood that the language's trigrams give it. Expectation-maximisation
estimates the document's language proportions, document by document until the log likelihood is within ``GAP`` of its greatest value (it is
concave, so its slopes bound what is left to gain); the language set is the nested one (languages by falling proportion) of the highest
log likelihood less ``PENALTY`` for each further language and log of the word count. The prediction is the set's largest
proportion and the score is that proportion.

Texts are processed whole. A letter is any character that Unicode calls alphabetic; bytes above 127 are folded to 32 classes, so the
trigram space is 2^18 and the model's size depends on the number of languages alone.

Defined cases: null texts, empty ones and those without a letter are ``und`` with score 0; without any training rows every text is;
rows with null language are not learned from; ties between languages go to the smaller name; repeated rows and null ids give a
row each (a null id counts as held out from training, like remainder 1, since its remainder is unknown); an empty table gives an
empty table; columns besides the named ones are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm._frames import map_slices, read, slices, with_text

SPACE = 1 << 18
SMOOTHING = 0.5
#: Log-likelihood units that the proportions may lack.
GAP = 0.01
#: Log-likelihood units for each language beyond the first, times log of the number of words.
PENALTY = 1.5
#: Languages that a model may have; more than these need a coarser trigram space. A model takes 1 MB a language.
MAX_LANGUAGES = 256
UNKNOWN = "und"

_CLASS = np.zeros(256, np.int32)
for _b in range(26):
    _CLASS[97 + _b] = _CLASS[65 + _b] = 1 + _b
for _b in range(128, 256):
    _CLASS[_b] = 32 + (_b & 31)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram ids of the words of all texts, each id's word, and each word's text (words in order)."""
    joined = [t.lower().encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(x) + 2 for x in joined], np.int64)
    code = _CLASS[np.frombuffer(b"\0".join([b"", *(x + b"\0" for x in joined), b""]), np.uint8)]
    inner = np.flatnonzero(code)  # the first and last codes are spaces
    ids = (code[inner - 1] << 12) | (code[inner] << 6) | code[inner + 1]
    begins = code[inner - 1] == 0
    word = np.cumsum(begins) - 1
    text = np.searchsorted(np.cumsum(sizes), inner[begins] - 1, side="right")
    return ids, word, text


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def count_trigrams(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``lang, gram, n``: sums over all rows, gathered by task before the shuffle."""
    narrow = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "_text"):
                langs = np.array(part.column("_lang").to_pylist(), object)
                texts = part.column("_text").to_pylist()
                for lang in dict.fromkeys(langs):
                    ids, _, _ = trigrams([texts[i] for i in np.flatnonzero(langs == lang)])
                    if lang not in sums:
                        sums[lang] = np.zeros(SPACE, np.int64)
                    sums[lang] += np.bincount(ids, minlength=SPACE)
        for lang, total in sums.items():
            grams = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int32()), pa.array(total[grams], pa.int64())], ["lang", "gram", "n"])

    return narrow.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Language names in order, and log likelihoods of shape (SPACE, languages).

    What reaches the driver is bounded by SPACE times MAX_LANGUAGES counts (checked), whatever the corpus is.
    """
    counts = count_trigrams(df, text_col, lang_col)
    table = counts.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("grams")).limit(MAX_LANGUAGES + 1).toArrow()
    names = table.column("lang").to_pylist()
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    order = sorted(range(len(names)), key=names.__getitem__)
    logs = np.zeros((SPACE, len(names)), np.float32)
    for to, k in enumerate(order):
        grams = table.column("grams")[k].values
        n = np.full(SPACE, SMOOTHING)
        n[grams.field("gram").to_numpy()] += grams.field("n").to_numpy()
        logs[:, to] = np.log(n / n.sum())
    return [names[k] for k in order], logs


def _grouped(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def _word_scores(ids: np.ndarray, firsts: np.ndarray, logs: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """Log likelihood of every word under every language, a bounded number of words at a time."""
    parts = []
    for a in range(0, len(firsts), block):
        begin, end = firsts[a], firsts[a + block] if a + block < len(firsts) else len(ids)
        parts.append(np.add.reduceat(logs[ids[begin:end]], firsts[a : a + block] - begin, axis=0, dtype=np.float64))
    return np.concatenate(parts)


def _em(like: np.ndarray, text: np.ndarray, starts: np.ndarray, share: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions over each text's ``usable`` languages, its log likelihood (less the words' own scale) and a bound of what that may lack.

    A round multiplies a proportion by its slope over the word count. The log likelihood is concave in the proportions, so the steepest
    slope less the word count bounds what any further round can gain; a text is done when this is at most ``GAP``.
    """
    share = np.where(usable, share, 0.0)
    share /= share.sum(axis=1, keepdims=True)
    value, gap = np.empty(len(share)), np.full(len(share), np.inf)
    live = np.arange(len(share))
    while len(live):
        ends = np.append(starts, len(like))[1:]
        size = (ends - starts)[:, None]
        mix = (like * share[live][text]).sum(axis=1)
        slope = np.where(usable[live], _grouped(like / mix[:, None], starts), 0.0)
        value[live], gap[live] = _grouped(np.log(mix), starts), slope.max(axis=1) - size[:, 0]
        open_ = gap[live] > GAP
        share[live[open_]] *= (slope / size)[open_]
        if 2 * open_.sum() <= len(live):  # what is done leaves
            rows = open_[text]
            like, live = like[rows], live[open_]
            text = np.searchsorted(np.flatnonzero(open_), text[rows])
            starts = np.flatnonzero(np.diff(text, prepend=-1))
    return share, value, np.maximum(gap, 0)


def infer(texts: list[str | None], names: list[str], logs: np.ndarray) -> list[tuple[str, float, list[float]]]:
    """Prediction, score and the proportions over all languages of each text."""
    out: list[tuple[str, float, list[float]]] = [(UNKNOWN, 0.0, [])] * len(texts)
    asked = [i for i, t in enumerate(texts) if t and names and any(map(str.isalpha, t))]
    if not asked:
        return out
    ids, word, text = trigrams([texts[i] for i in asked])
    n_words = np.bincount(text, minlength=len(asked))  # at least one each, since every letter has a class
    score = _word_scores(ids, np.flatnonzero(np.diff(word, prepend=-1)), logs)
    like = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -60.0))
    starts = np.flatnonzero(np.diff(text, prepend=-1))
    k = len(names)
    share, full, gap = _em(like, text, starts, np.full((len(asked), k), 1.0 / k), np.ones((len(asked), k), bool))
    order = np.argsort(-share, axis=1, kind="stable")
    single = _grouped(np.log(like), starts)
    step = PENALTY * np.log(np.maximum(n_words, 2))
    top = single.argmax(axis=1)
    best = single.max(axis=1)
    chosen = np.zeros((len(asked), k))
    chosen[np.arange(len(asked)), top] = 1.0
    for m in range(2, k + 1):
        # no set of m or more can beat the best one if even the full mixture can't at m's price
        open_ = np.flatnonzero(full + gap - (m - 1) * step > best)
        if not len(open_):
            break
        rows = np.isin(text, open_)
        sub = np.searchsorted(open_, text[rows])
        usable = np.zeros((len(open_), k), bool)
        np.put_along_axis(usable, order[open_, :m], True, 1)
        got, value, _ = _em(like[rows], sub, np.flatnonzero(np.diff(sub, prepend=-1)), np.maximum(share[open_], 1e-3), usable)
        better = value - (m - 1) * step[open_] > best[open_]
        best[open_[better]] = (value - (m - 1) * step[open_])[better]
        chosen[open_[better]] = np.where(got[better] < 1e-9, 0.0, got[better])
    for j, i in enumerate(asked):
        lead = int(chosen[j].argmax())
        out[i] = names[lead], float(min(1.0, chosen[j, lead])), chosen[j].tolist()
    return out


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` and ``proportions`` (array of {lang, share}, the selected set only)."""
    names, logs = model
    shared = df.sparkSession.sparkContext.broadcast((names, logs))
    narrow, text = with_text(df, keep, text_col)
    share = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    own = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("proportions", share)]
    schema = T.StructType([*(narrow.schema[c] for c in keep), *own])
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        names, logs = shared.value
        got = infer(part.column(text).to_pylist(), names, logs)
        sets = [[{"lang": n, "share": s} for n, s in zip(names, shares) if s > 0] for _, _, shares in got]
        columns = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(sets, kind)]
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *columns], schema.names)

    return map_slices(narrow, text, work, schema, limit=(4 << 20) // max(4, len(names)))


def op5_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = held_out("doc_id")
    model = fit(docs.where(~out))
    return predict(docs.withColumn("held_out", out), model, keep=("doc_id", "held_out")).drop("proportions")

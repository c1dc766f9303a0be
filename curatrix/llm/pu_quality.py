"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents whose every label is 1; unlabelled documents are web text of any quality. A logistic score
over text statistics minimises the non-negative unbiased risk: prior * risk of positives as positive + max(0, risk of unlabelled as
negative - prior * risk of positives as negative), with the step reversed where the second part falls below zero. The class prior
is estimated without negatives: a first classifier tells positives from unlabelled, and the prior is the least ratio, over score
thresholds, of the unlabelled share above to the positives' share above.

Inputs of a score are the text alone: byte frequencies, character classes, word shapes and repetition of words and lines.

Fitting uses a bounded sample, ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` training documents of smallest hash; the documents scored are all.

Defined cases: null and empty texts have no statistics but the constant, in training as in scoring, and get the score it gives; without positives or without unlabelled
documents every score is 0.5; label rows that are null are ignored, conflicting ones make a document no trusted positive; a null id counts
as held out; repeated rows give a row each; an empty table gives an empty table; columns besides the named ones are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm._frames import map_slices, raw_texts, read
from curatrix.llm.language_mixture import held_out

MAX_POSITIVE = 6_000
MAX_UNLABELLED = 12_000
STEPS = 300
RATE = 0.05
DECAY = 1e-3
#: Share of the positives that must stand above a threshold for it to bear on the prior.
TAIL = 0.3
#: Standard errors added to a ratio before the least one is taken; chosen by cross-validation within training rows (README).
MARGIN = 0.0

_KEPT = np.arange(32, 127)  # printable ASCII; all bytes above count together


def statistics(raw: bytes) -> np.ndarray:
    """About a hundred numbers of order one."""
    out = np.zeros(len(_KEPT) + 13, np.float32)
    out[-1] = 1.0
    if not raw:
        return out
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    total = n.sum()
    letters = n[65:91].sum() + n[97:123].sum() + n[128:].sum()
    out[: len(_KEPT)] = np.sqrt(n[_KEPT] / total)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    distinct = len(set(words))
    out[len(_KEPT) :] = (
        np.sqrt(n[128:].sum() / total),
        np.sqrt(n[:32].sum() / total),
        n[65:91].sum() / max(1.0, letters),
        letters / total,
        n[48:58].sum() / total,
        (n[33:48].sum() + n[58:65].sum() + n[91:97].sum() + n[123:127].sum()) / total,
        np.log1p(total) / 10,
        np.log1p(len(words)) / 10,
        distinct / max(1, len(words)),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)) / 10,
        min(2.0, total / max(1, len(words)) / 10),
        1.0,
    )
    return out


SIZE = len(statistics(b""))


def _gradient(x: np.ndarray, w: np.ndarray, sign: float) -> tuple[float, np.ndarray]:
    """Mean logistic loss of calling all rows ``sign``, and its gradient."""
    z = sign * (x @ w)
    return float(np.logaddexp(0, -z).mean()), -sign * (x.T @ (1 / (1 + np.exp(np.clip(z, -50, 50))))) / len(x)


def _descend(step, size: int, decay: float = 0.0) -> np.ndarray:
    """Adam over the whole sample; ``step`` gives the gradient at a point."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, STEPS + 1):
        g = step(w) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, margin: float = MARGIN) -> float:
    """The share of positives among the unlabelled, from a classifier of the one against the other.

    Two halves score each other, so that the classifier's overfitting doesn't count; ratios are taken where at least ``TAIL`` of the
    positives stand above, so that they aren't noisy, and at ``margin`` standard errors above their value.
    """
    ratios, decay = [], DECAY + 1 / len(positive)
    for half in (0, 1):
        p, u, q, v = positive[half::2], unlabelled[half::2], positive[1 - half :: 2], unlabelled[1 - half :: 2]
        if not all(map(len, (p, u, q, v))):
            continue
        w = _descend(lambda w: 0.5 * (_gradient(p, w, 1.0)[1] + _gradient(u, w, -1.0)[1]), positive.shape[1], 10 * decay)  # noqa: B023
        on_p, on_u = np.sort(q @ w), np.sort(v @ w)
        cuts = on_p[: max(1, int(len(q) * (1 - TAIL)))]
        above_p = 1 - np.searchsorted(on_p, cuts) / len(q)
        above_u = 1 - np.searchsorted(on_u, cuts) / len(v)
        ratio = above_u / above_p
        error = ratio * np.sqrt((1 - above_p) / (above_p * len(q)) + (1 - above_u) / (np.maximum(above_u, 1e-9) * len(v)))
        ratios.append((ratio + margin * error).min())
    return float(np.clip(np.mean(ratios or [0.5]), 0.05, 0.95))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the unbiased risk, positives as positive and the rest as negative (which may fall below zero), with their gradients."""
    right, up = _gradient(positive, w, 1.0)
    wrong, down = _gradient(positive, w, -1.0)
    rest, of_rest = _gradient(unlabelled, w, -1.0)
    return prior * right, rest - prior * wrong, prior * up, of_rest - prior * down


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights of least non-negative risk: where the second part is below zero, a step leads out of there instead of down the risk."""

    def step(w: np.ndarray) -> np.ndarray:
        _, second, of_first, of_second = risk(positive, unlabelled, prior, w)
        return -of_second if second < 0 else of_first + of_second

    return _descend(step, positive.shape[1], DECAY + 1 / len(positive))  # few positives bear fewer distinctions


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Scaled statistics of the bounded training sample: positives and unlabelled, the documents of smallest id hash."""
    order = F.xxhash64(F.lit("sample"), id_col)
    known = labels.where(F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("_q"))
    known = known.where(~held_out(id_col) & (F.col("_q") == 1))
    positive = known.select(id_col).orderBy(order, id_col).limit(MAX_POSITIVE)
    texts = docs.where(~held_out(id_col) & F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    trusted = texts.join(F.broadcast(positive), id_col)  # MAX_POSITIVE ids at most
    # web text of any quality, trusted documents among it, so that the prior is the web's own
    chosen = docs.where(~held_out(id_col) & F.col(text_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(F.lit("web"), id_col), id_col).limit(MAX_UNLABELLED)
    unlabelled = texts.join(F.broadcast(chosen), id_col)  # MAX_UNLABELLED ids at most

    def gather(df: DataFrame, most: int) -> np.ndarray:
        got = _with_statistics(df, id_col).orderBy(id_col).limit(most).select("_x").toArrow().column("_x")
        return np.array(got.to_pylist(), np.float64).reshape(-1, SIZE)

    return gather(trusted, MAX_POSITIVE), gather(unlabelled, MAX_UNLABELLED)


def _with_statistics(df: DataFrame, *keep: str) -> DataFrame:
    schema = T.StructType([*(f for f in df.select(*keep).schema), T.StructField("_x", T.ArrayType(T.FloatType(), False))])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        x = [statistics(r) for r in raw_texts(part, "_text")]
        return pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(x, pa.list_(pa.float32()))], schema.names)

    return map_slices(df.select(*keep, "_text"), "_text", work, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Weights over raw statistics, and the estimated prior."""
    positive, unlabelled = sample(docs, labels, id_col, text_col)
    if not len(positive) or not len(unlabelled):
        return {"weights": np.zeros(SIZE), "prior": 0.5}
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0)
    mean[-1], scale[-1] = 0.0, 1.0  # the constant
    scale = np.where(scale > 1e-6, scale, np.inf)  # statistics that don't vary tell nothing
    scale[-1] = 1.0
    positive, unlabelled = ((x - mean) / scale for x in (positive, unlabelled))
    prior = estimate_prior(positive, unlabelled)
    w = fit_nnpu(positive, unlabelled, prior)
    raw = w / scale
    raw[-1] -= float((w * mean / scale)[:-1].sum())
    return {"weights": raw, "prior": prior}


def score(df: DataFrame, model: dict, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``score`` in (0, 1) and ``predicted``."""
    w = model["weights"]
    narrow = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*(f for f in narrow.schema if f.name != "_text"), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(r) for r in raw_texts(part, "_text")], np.float64)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema.names)

    return map_slices(narrow, "_text", work, schema)


def op2_pu_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs.withColumn("held_out", held_out("doc_id")), model, keep=("doc_id", "held_out"))

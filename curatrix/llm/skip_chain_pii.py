"""Personal data by base patterns and a skip-chain conditional random field.

Base spans are the leftmost non-overlapping matches of four patterns, each kind for itself, less those that fail its test. The random
field labels the other candidate tokens of a document (runs with a digit or an at sign). Its nodes are base spans, clamped to their
kind, and candidates; neighbouring nodes share chain potentials; nodes that are repeated or similar anywhere in the document (same
letters and digits, same groups of digits, same last ten digits, or the local part of an address) share skip potentials. Loopy sum-product
message passing, until it settles, gives each candidate a label distribution, and a candidate whose label is sure enough becomes a span too.
Skip links join each candidate to known spans of its key, so other mentions, however many, neither pass the evidence on nor outvote it, and a
key with n nodes costs at most 2n links, not all pairs.

Potentials are trained here, over all documents, with the base patterns as distant labels. Chain and skip weights maximise the
pseudo-likelihood: of every node whose label is certain, the probability of its label given those of its neighbours and of the nodes linked to
it, with a Gaussian prior (L2) around a moderate link weight. Its counts are sufficient statistics of a few thousand numbers, whatever the
corpus. A node's own evidence is naive Bayes over its features, clipped, since a candidate's distant label only says
that no pattern matched; it takes a link to a known span to be labelled.

Defined cases: null and empty texts have no spans; texts are scanned whole in linear time; repeated rows and null ids give a row each;
an empty table gives an empty table; ``mask_pii`` keeps all columns (those named like its own are replaced), ``find_pii`` only the named ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm._frames import map_slices, read, slices

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = OTHER + 1
#: Probability from which a candidate's label makes it a span.
SURE = 0.9
#: Bounds of a candidate's own log odds against OTHER: never for a kind, since no pattern matched it.
OWN_ODDS = (-0.5, 0.0)
#: Prior mean of a link's weight, and the prior's precision for all weights.
LINK_BEFORE, PRECISION = 5.0, 1.0
#: Messages are passed until none moves by more than SETTLED; the bound of rounds is for graphs that never settle.
SETTLED, ROUNDS = 1e-4, 1000
SHAPES, WORDS_BEFORE, COUNTS = 512, 256, 48
#: A neighbour's label where there is none.
NONE = LABELS

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
# A match can only begin at the first digit of a run: what begins inside a run also matches from the run's beginning.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBERS = r"\(?[0-9]{1,4}\)?[\x20.-]?[0-9]{2,4}[\x20.-][0-9]{2,4}(?:[\x20.-][0-9]{1,4}){0,4}(?![0-9A-Za-z])"
_NODE = re.compile(_NUMBERS + r"|([0-9@][A-Za-z0-9._%+@-]*)")
_LETTERS = re.compile(r"[^0-9a-z]+")
_DIGITS = re.compile(r"[0-9]+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _byte(digits: str) -> bool:
    """At most 255, however many zeros lead."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start; offsets are code points."""
    out: list[Span] = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > done and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                done = m.end()
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(_byte(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def nodes_of(text: str, base: list[Span]) -> list[Span]:
    """Base spans and the candidates that touch none of them, by place; a candidate's kind is OTHER."""
    taken = sorted(base, key=lambda s: (s[1], s[2]))
    out, k, done = [], 0, 0
    for m in _NODE.finditer(text):
        start, end = m.span()
        if m.group(1):  # a token: from its first digit or at sign back to its beginning
            while start > done and _LOCAL.match(text[start - 1]):
                start -= 1
            end = m.start() + max(1, len(m.group().rstrip("._%+@-")))  # a full stop ends the sentence
        done = m.end()
        while k < len(taken) and taken[k][2] <= start:
            k += 1
        # spans of different kinds may overlap, a few at a place
        if all(s[2] <= start or s[1] >= end for s in taken[max(0, k - 4) : k + 4]):
            out.append((OTHER, start, end))
    return sorted(out + taken, key=lambda s: (s[1], s[2], s[0]))


def _size(n: int) -> int:
    """Small numbers as they are, larger ones by their order of magnitude."""
    return n if n < 16 else min(COUNTS - 1, 11 + n.bit_length())


def features(text: str, node: Span) -> list[int]:
    """Feature numbers: shape, digits, length, word before."""
    token = text[node[1] : node[2]]
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", token))
    digits = sum(map(str.isdigit, token))
    before = text[max(0, node[1] - 24) : node[1]].lower().split()
    word = zlib.crc32(before[-1].encode()) % WORDS_BEFORE if before else 0
    return [zlib.crc32(shape.encode()) % SHAPES, SHAPES + _size(digits), SHAPES + COUNTS + _size(len(token)), SHAPES + 2 * COUNTS + word]


FEATURES = SHAPES + 2 * COUNTS + WORDS_BEFORE


def links(text: str, nodes: list[Span]) -> list[tuple[int, int, int]]:
    """Skip links ``left, right, steps``.

    A candidate is linked to the known spans next before and after it under each of its keys. If only other candidates share its keys, and
    those share keys with a known span, it is linked to a span of each kind so reached, keys as many steps away. Known spans of a key, and
    candidates of a key that no known span reaches, are linked each to the next one.
    """
    keys: list[set[str]] = []
    places: dict[str, list[int]] = {}
    for i, (_, start, end) in enumerate(nodes):
        token = text[start:end].lower()
        digits = "".join(c for c in token if "0" <= c <= "9")
        own = {_LETTERS.sub("", token)}
        if len(digits) >= 10:
            own.add("digits " + digits[-10:])
        if "@" in token:
            own.add(_LETTERS.sub("", token.split("@")[0]))
        own = {k for k in own if len(k) >= 6}
        parts = _DIGITS.findall(token)
        if len(parts) > 2:  # however short: 10.1.2.3 and 10-1-2-3, but not 10123
            own.add("groups " + " ".join(parts))
        keys.append(own)
        for key in keys[i]:
            places.setdefault(key, []).append(i)
    out = set()
    spans = {i: {node[0]: i} for i, node in enumerate(nodes) if node[0] != OTHER}  # by node reached: known span by kind
    newest, steps = list(spans), 1
    left = {key for key, at in places.items() if len(at) > 1}
    while newest:
        now = sorted({key for i in newest for key in keys[i]} & left)
        left.difference_update(now)
        new: dict[int, dict[int, int]] = {}
        for key in now:
            at = places[key]
            for order in (at, at[::-1]):
                last = None
                for i in order:
                    if i in spans:
                        if steps == 1 and last is not None:
                            out.add((min(last, i), max(last, i), 1))
                        last = i
                    elif last is not None:
                        for kind, span in spans[last].items():
                            first = new.setdefault(i, {}).setdefault(kind, span)
                            if steps == 1 or first == span:
                                out.add((min(span, i), max(span, i), steps))
        spans |= new
        newest, steps = list(new), steps + 1
    for key in left:
        out.update((a, b, 1) for a, b in zip(places[key], places[key][1:]))
    return sorted(out)


# ---- training: counts over all documents


def surroundings(nodes: list[Span], skips: list[tuple[int, int, int]]) -> tuple[set[int], list[int]]:
    """Nodes of certain label, and for every node a number for its neighbours' labels and the set of labels linked to it, certain ones only.

    A candidate that is linked to a known span may well be personal data: its label is not certain.
    """
    unsure = {x for a, b, _ in skips for x, y in ((a, b), (b, a)) if nodes[x][0] == OTHER != nodes[y][0]}
    sure = set(range(len(nodes))) - unsure
    linked = [0] * len(nodes)
    for a, b, _ in skips:
        for x, y in ((a, b), (b, a)):
            if y in sure:
                linked[x] |= 1 << nodes[y][0]
    label = [n[0] if i in sure else NONE for i, n in enumerate(nodes)]
    return sure, [((left * (NONE + 1) + right) << LABELS) | links_ for left, right, links_ in zip([NONE, *label], [*label[1:], NONE], linked)]


def count_evidence(df: DataFrame, text_col: str) -> DataFrame:
    """``what, a, b, n``: features (0) and surroundings (1) by the node's label. A few thousand rows, whatever the corpus."""
    narrow = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "_text"):
                for text in part.column("_text").to_pylist():
                    nodes = nodes_of(text, base_spans(text))
                    if not nodes:
                        continue
                    sure, around = surroundings(nodes, links(text, nodes))
                    for i in sure:
                        n.update((0, f, nodes[i][0]) for f in features(text, nodes[i]))
                        n[1, around[i], nodes[i][0]] += 1
        keys = np.array(list(n), np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, i]) for i in range(3)), pa.array(list(n.values()), pa.int64())], ["what", "a", "b", "n"])

    return narrow.mapInArrow(run, "what long, a long, b long, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))


#: Weights: a bias of each label, one for each two neighbouring labels, and the link's.
WEIGHTS = LABELS + LABELS * LABELS + 1


def weight_design(around: np.ndarray) -> np.ndarray:
    """How often each weight counts for each label in these surroundings: (surroundings, labels, weights)."""
    left, right, linked = around >> LABELS, around >> LABELS, around & ((1 << LABELS) - 1)
    left, right = left // (NONE + 1), right % (NONE + 1)
    out = np.zeros((len(around), LABELS, WEIGHTS))
    n = np.arange(len(around))
    for y in range(LABELS):
        out[:, y, y] = 1
        some = left != NONE
        out[n[some], y, LABELS + left[some] * LABELS + y] += 1
        some = right != NONE
        out[n[some], y, LABELS + y * LABELS + right[some]] += 1
        out[:, y, -1] = linked >> y & 1
    return out


def pseudo_likelihood(design: np.ndarray, counts: np.ndarray, w: np.ndarray, before: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log pseudo-likelihood less the prior's penalty, with its gradient and Hessian; counts are (surroundings, labels)."""
    score = design @ w
    score -= score.max(axis=1, keepdims=True)
    p = np.exp(score)
    p /= p.sum(axis=1, keepdims=True)
    total = counts.sum(axis=1)
    value = float((counts * np.log(p + 1e-300)).sum()) - PRECISION / 2 * float(((w - before) ** 2).sum())
    gradient = np.einsum("cy,cyk->k", counts - total[:, None] * p, design) - PRECISION * (w - before)
    mean = np.einsum("cy,cyk->ck", p, design)
    hessian = -np.einsum("cy,cyk,cyl->kl", total[:, None] * p, design, design, optimize=True) + np.einsum("c,ck,cl->kl", total, mean, mean, optimize=True)
    return value, gradient, hessian - PRECISION * np.eye(WEIGHTS)


def fit_weights(around: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The weights of greatest penalised pseudo-likelihood by damped Newton steps (it is concave, so there is one)."""
    before = np.zeros(WEIGHTS)
    before[-1] = LINK_BEFORE
    w = before.copy()
    if not len(around):
        return w
    design = weight_design(around)
    value, gradient, hessian = pseudo_likelihood(design, counts, w, before)
    while np.abs(gradient).max() > 1e-6 * max(1.0, counts.sum()):
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while (new := pseudo_likelihood(design, counts, w - size * step, before))[0] <= value and size > 1e-9:
            size /= 2
        if size <= 1e-9:
            break
        w, (value, gradient, hessian) = w - size * step, new
    return w


class Field:
    """Log potentials: ``own`` (features, labels), ``chain`` (labels, labels) and the link's log odds of agreement."""

    def __init__(self, counts: list[tuple[int, int, int, int]]):
        own = np.full((FEATURES, LABELS), 0.1)
        around: dict[int, np.ndarray] = {}
        for what, a, b, n in counts:
            if what == 0:
                own[a, b] += n
            elif what == 1:
                around.setdefault(a, np.zeros(LABELS))[b] += n
        prior = own[:SHAPES].sum(axis=0)
        self.prior = np.log(prior / prior.sum())
        groups = np.split(own, np.cumsum([SHAPES, COUNTS, COUNTS]))
        self.own = np.concatenate([np.log(g / g.sum(axis=0)) for g in groups])
        order = sorted(around)
        weights = fit_weights(np.array(order, np.int64), np.array([around[x] for x in order]).reshape(-1, LABELS))
        self.chain = weights[LABELS:-1].reshape(LABELS, LABELS)
        self.link = float(weights[-1])

    def links(self, steps: int) -> np.ndarray:
        """Log potentials of links of 1 to ``steps`` steps: those of as many single links in a row, with nothing known of the nodes between."""
        one = np.exp(np.where(np.eye(LABELS, dtype=bool), self.link, 0.0))
        one /= one.sum(axis=1, keepdims=True)
        return np.log(np.stack(list(accumulate([one] * steps, np.matmul))))

    def unary(self, kinds: np.ndarray, feats: np.ndarray) -> np.ndarray:
        """Log evidence of each node; base spans are clamped."""
        score = self.prior + self.own[feats].sum(axis=1)
        odds = (score - score[:, [OTHER]]).clip(*OWN_ODDS)
        odds[:, OTHER] = 0.0
        clamped = np.where(np.arange(LABELS) == kinds[:, None], 0.0, -np.inf)
        return np.where((kinds == OTHER)[:, None], odds, clamped)


def beliefs(unary: np.ndarray, left: np.ndarray, right: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    """Label distributions by loopy sum-product; edges are (left, right) with potentials of shape (edges, labels, labels)."""
    source, target = np.concatenate([left, right]), np.concatenate([right, left])
    pair = np.exp(np.concatenate([potentials, potentials.transpose(0, 2, 1)]))
    e = len(left)
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    message = np.zeros((2 * e, LABELS))
    live = np.arange(2 * e)
    for _ in range(ROUNDS):
        if not len(live):
            break
        total = unary.copy()
        np.add.at(total, target, message)
        out = total[source[live]] - message[back[live]]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.einsum("ei,eij->ej", out, pair[live]) + 1e-30)
        new -= np.log(np.exp(new).sum(axis=1, keepdims=True))
        moved = live[np.abs(new - message[live]).max(axis=1) >= SETTLED]
        message[live] = 0.5 * message[live] + 0.5 * new
        # next: what still moves, and what leaves a node that a moving message reaches
        stirred = np.zeros(len(unary), bool)
        stirred[target[moved]] = True
        again = stirred[source]
        again[moved] = True
        live = np.flatnonzero(again)
    total = unary.copy()
    if e:
        np.add.at(total, target, message)
    total = np.exp(total - total.max(axis=1, keepdims=True))
    return total / total.sum(axis=1, keepdims=True)


def find_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans (by kind, then start) of each text; the graphs of all texts are passed over together."""
    base = [base_spans(t) for t in texts]
    kinds: list[int] = []
    feats: list[list[int]] = []
    chain: list[tuple[int, int]] = []
    skip: list[tuple[int, int, int]] = []
    owners: list[tuple[int, Span]] = []
    for d, text in enumerate(texts):
        nodes = nodes_of(text, base[d])
        if all(n[0] != OTHER for n in nodes):
            continue  # all clamped
        first = len(kinds)
        kinds += [n[0] for n in nodes]
        feats += [features(text, n) for n in nodes]
        owners += [(d, n) for n in nodes]
        chain += [(first + i, first + i + 1) for i in range(len(nodes) - 1)]
        skip += [(first + a, first + b, steps) for a, b, steps in links(text, nodes)]
    found = [list(b) for b in base]
    if kinds:
        edges = np.array(chain + [s[:2] for s in skip], np.int64).reshape(-1, 2)
        by_steps = field.links(max((s[2] for s in skip), default=1))
        potentials = np.concatenate([np.broadcast_to(field.chain, (len(chain), LABELS, LABELS)), by_steps[[s[2] - 1 for s in skip]].reshape(-1, LABELS, LABELS)])
        share = beliefs(field.unary(np.array(kinds), np.array(feats)), edges[:, 0], edges[:, 1], potentials)
        best = share.argmax(axis=1)
        known = np.array(kinds) != OTHER
        tied = np.zeros(len(kinds), bool)  # to a known span: neighbours alone make no span, however often a candidate stands beside known ones
        for near, far in (edges[len(chain) :].T, edges[len(chain) :, ::-1].T):
            tied[near[known[far]]] = True
        for i in np.flatnonzero(~known & tied & (best != OTHER) & (share.max(axis=1) >= SURE)):
            d, (_, start, end) = owners[i]
            found[d].append((int(best[i]), start, end))
    return [(b, sorted(f)) for b, f in zip(base, found)]


def train(df: DataFrame, text_col: str = "text") -> Field:
    return Field([tuple(r) for r in count_evidence(df, text_col).collect()])  # at most 825 features and 25 pairs, by label


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _rows(spans: list[Span]) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]


def find_pii(df: DataFrame, field: Field, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``base`` and ``spans``: arrays of {kind, start, end} by kind as listed, then start."""
    shared = df.sparkSession.sparkContext.broadcast(field)
    narrow = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*(f for f in narrow.schema if f.name != "_text"), T.StructField("base", _SPAN), T.StructField("spans", _SPAN)])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        got = find_spans([t or "" for t in part.column("_text").to_pylist()], shared.value)
        columns = [pa.array([_rows(g[i]) for g in got], _ARROW_SPAN) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *columns], schema.names)

    return map_slices(narrow, "_text", work, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def mask_pii(df: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``df`` with every span of its texts replaced; null stays null. All other columns are as they were."""
    shared = df.sparkSession.sparkContext.broadcast(field)
    schema = df.schema
    place = schema.names.index(text_col)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(place).to_pylist()
        got = find_spans([t or "" for t in texts], shared.value)
        new = pa.array([t if t is None else masked(t, s) for t, (_, s) in zip(texts, got)], pa.string())
        return pa.RecordBatch.from_arrays([new if i == place else part.column(i) for i in range(part.num_columns)], schema.names)

    return map_slices(df, text_col, work, schema)


def op4_skip_chain_pii(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = find_pii(docs, train(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))

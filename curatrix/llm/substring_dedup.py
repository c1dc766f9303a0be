"""Removal of long repeated substrings by a hash-compared suffix sort.

Every byte that a ``WINDOW``-byte string covers is removed if the string also starts in a document of smaller id. Documents with equal
texts are settled by the text's SHA-256: all but the smallest id lose what windows cover. For the others:

1. Anchors. Of the seeds (``SEED`` bytes) inside a window the one of least hash is its anchor; equal windows have equal anchors at equal
   places. Runs of windows share an anchor, so there are about 2 / (WINDOW - SEED + 2) anchors a byte. Anchors are dealt by seed hash, as
   packed columns, and those whose seed is in one document only are dropped.
2. Contexts. The other anchors go back to their documents and fetch their context, the bytes of all windows that hold the anchor there.
   Contexts are dealt by seed hash. Equal contexts are gathered before the shuffle (only the smallest id of a context can help others;
   the rest are covered), so a passage that very many documents share is sent once a task. Seeds that are anchors very often (a run of
   blanks, a phrase) are found by a count over all texts; their windows are told apart by a second anchor too, the least of the window's
   other seeds, so that their contexts go to many tasks.
3. Suffix sort. Contexts are strings with prefix polynomial hashes. They are mergesorted by suffix within a seed: two suffixes are
   compared by binary search for their common extension over the hashes (logarithmically many steps), then by the next byte. Equal
   contexts become one; where different contexts share a seed, the suffixes that begin their windows are sorted in the same way, and
   neighbours with a common extension of a window are one string. Neighbours are verified byte by byte: those taken as equal, and the order
   of all; where that fails, the seed's suffixes are sorted by their bytes.
4. Windows of a string whose smallest document is another one are marked, and each document drops the bytes that marked windows cover.

Defined cases: null and empty texts, and those shorter than a window, lose nothing; very long texts are taken whole; documents of equal
id and equal text lose nothing to each other (no smaller id), documents of equal id and different texts neither; null ids are larger
than all others (but 2^63 - 1, to which they count as equal) and lose nothing to each other; an empty table gives an empty table; columns besides the named ones are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm._frames import checkpointed, raw_texts, read, slices

WINDOW = 50
SEED = 24
BASE = 0x9E3779B97F4A7C15 | 1
_WORD = 2**64
_INVERSE = pow(BASE, -1, _WORD)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Windows that are looked at together.
PIECE = 1 << 20

_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for i, b in enumerate((BASE, _INVERSE)):
            row = np.full(n, b % _WORD, np.uint64)
            row[0] = 1
            _POWERS[i] = np.cumprod(row, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """S with S[i] the sum of (byte + 1) * base^j over the bytes before i."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def anchors(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seed keys, places, and first and last window of each run of windows that share an anchor.

    ``data`` are bytes; ``valid`` tells for each window start whether the window lies within one document.
    """
    n = len(data)
    empty = np.empty(0, np.int64)
    if n < WINDOW or not valid.any():
        return np.empty(0, np.uint64), empty, empty, empty
    sums = prefix_hashes(data)
    seeds = (sums[SEED:] - sums[:-SEED]) * powers(n + 1)[1][: n - SEED + 1]
    seeds *= _MIX
    seeds ^= seeds >> np.uint64(32)
    seeds *= _MIX
    best = (seeds & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(seeds), dtype=np.uint64)
    width, span = WINDOW - SEED + 1, 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
    starts = np.flatnonzero(valid)
    place = (best[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    last = np.append(new[1:], len(starts)) - 1
    at = place[new]
    return seeds[at], at, starts[new], starts[last]


def text_anchors(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """Document, key, place of the seed, first and last window of every run; places are within the document."""
    sizes = np.array([len(r) for r in raws], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(raws), np.uint8)
    edge = np.zeros(len(data) + 1, np.int8)  # one document at a place: small sums, small memory for long texts
    whole = sizes >= WINDOW
    np.add.at(edge, (ends - sizes)[whole], 1)
    np.add.at(edge, (ends - WINDOW + 1)[whole], -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    parts = []
    for a in range(0, len(data), PIECE):
        key, at, first, last = anchors(data[a : a + PIECE + WINDOW - 1], valid[a : a + PIECE])
        parts.append((key, at + a, first + a, last + a))
    key, at, first, last = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    doc = np.searchsorted(ends, at, side="right")
    begin = (ends - sizes)[doc] if len(doc) else doc
    return doc, key, at - begin, first - begin, last - begin


# ---- packed columns: a shuffled row holds many anchors or contexts of a task

KEY_BYTES = 6


def pack(*columns: np.ndarray) -> bytes:
    """Number of rows, then each column's bytes; compressed, since places and neighbouring texts repeat."""
    raw = np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1, write_checksum=False).compress(raw)


def unpack(blob: bytes, *kinds: np.dtype) -> list[np.ndarray]:
    blob = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for kind in map(np.dtype, kinds):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * kind.itemsize
    return out


_KEY = np.dtype(("u1", KEY_BYTES))
_CONTEXT_SIZE = 2 * WINDOW - SEED
_CONTEXT = np.dtype(("u1", _CONTEXT_SIZE))
_LEFT = WINDOW - SEED


def short_keys(key: np.ndarray) -> np.ndarray:
    return key.view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BYTES :]


def long_keys(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - KEY_BYTES :] = raw
    return out.view(np.uint64).ravel()


def _groups(*columns: np.ndarray, sorted_by: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal rows together, and where each group of it begins.

    ``sorted_by`` names a column that alone tells almost all rows apart: sorting by it alone is faster, and rows that agree in it but not
    in the others merely make more groups.
    """
    order = np.lexsort(columns[::-1]) if sorted_by is None and len(columns) > 1 else np.argsort(columns[sorted_by or 0])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, np.flatnonzero(new)


_ROW = "bucket int, ord long, hx long, blob binary"


def _row(bucket: list, blob: list) -> pa.RecordBatch:
    """Rows for buckets; the document is left null."""
    none = pa.nulls(len(bucket), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), none, none, pa.array(blob, pa.binary())], ["bucket", "ord", "hx", "blob"])


def by_document(ord_: np.ndarray, hx: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """One row (ord, hx, blob) a document: the plain bytes of its records, cut from one buffer."""
    order, first = _groups(ord_, hx, sorted_by=1)
    data = np.ascontiguousarray(records[order])
    offsets = np.append(first, len(order)) * records.dtype.itemsize
    if len(order) and offsets[-1] >= 1 << 31:
        raise ValueError("too many records at once")
    blob = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    head = order[first]
    return pa.RecordBatch.from_arrays([pa.array(ord_[head], pa.int64()), pa.array(hx[head], pa.int64()), blob], ["ord", "hx", "blob"])


def _passed(ord_: np.ndarray, hx: np.ndarray, buckets: int, records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Results that a task already knows: they go through the next shuffle as they are."""
    if len(ord_):
        rows = by_document(ord_, hx, records)
        bucket = (rows.column("hx").to_numpy().view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), *rows.columns], ["bucket", "ord", "hx", "blob"])


#: What a document's blobs hold: places of anchors; first windows and bit masks of runs.
_PLACE = np.dtype(np.uint32)
_RUN = np.dtype([("first", np.uint32), ("mask", np.uint32)])


def _dealt(key: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    bucket = (key >> np.uint64(24)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cuts))
    for a in range(0, len(full), 256):
        some = full[a : a + 256]
        blobs = [pack(*(c[order[cuts[b] : cuts[b + 1]]] for c in columns)) for b in some]
        yield _row(some.tolist(), blobs)


# ---- 1: anchors

_ANCHOR = (_KEY, np.int64, np.int64, np.uint16, np.uint16)
#: Anchors or contexts that a task holds before it sends them on.
HELD = 1 << 21


def deal_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """One row a bucket of packed anchors, and rows of documents whose anchors are known to be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                own, raws = own_texts(part)
                ord_, hx = (part.column(c).to_numpy()[own] for c in ("ord", "hx"))
                doc, key, at, _, _ = text_anchors(raws)
                held.append((key, ord_[doc], hx[doc], at.astype(np.uint32)))
            if sum(len(h[0]) for h in held) >= HELD:
                yield from send(held)
                held = []
        if held:
            yield from send(held)

    def send(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, ord_, hx, at = (np.concatenate(x) for x in zip(*held))
        key &= np.uint64(2**64 - 2 ** (64 - 8 * KEY_BYTES))
        order, first = _groups(key)
        sizes = np.diff(np.append(first, len(order)))
        o, h = ord_[order], hx[order]
        lone = np.ones(len(first), bool)
        for c in (o, h):
            lone &= np.minimum.reduceat(c, first) == np.maximum.reduceat(c, first) if len(first) else lone
        known = np.repeat(~lone, sizes)
        yield from _passed(o[known], h[known], buckets, at[order][known].astype(_PLACE))
        sent = np.zeros(len(order), bool)  # a shared seed: one place speaks for it; another: all of its places
        sent[np.repeat(lone, sizes)] = True
        sent[first] = True
        rows = np.sort(order[sent])  # in the order of the documents: their columns compress
        yield from _dealt(key[rows], buckets, short_keys(key[rows]), ord_[rows], hx[rows], at[rows].astype(np.uint16), (at[rows] >> 16).astype(np.uint16))

    return docs.mapInArrow(run, _ROW)


def own_texts(part: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    """Rows that stand for their text (no smaller id has the same one), and their texts."""
    own = np.flatnonzero(part.column("least").to_numpy() == part.column("ord").to_numpy())
    return own, raw_texts(part.take(pa.array(own)), "text")


def _gathered(batches: Iterator[pa.RecordBatch], kinds: tuple, out: list) -> Iterator[pa.RecordBatch]:
    """Passes known rows on and unpacks the others into ``out``."""
    for batch in batches:
        known = batch.filter(batch.column("ord").is_valid())
        if known.num_rows:
            yield known.select(["ord", "hx", "blob"])
        out += [unpack(b, *kinds) for b in batch.filter(batch.column("ord").is_null()).column("blob").to_pylist()]


def shared_anchors(dealt: DataFrame) -> DataFrame:
    """``ord, hx, blob``: places of anchors whose seed is in more than one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        yield from _gathered(batches, _ANCHOR, parts)
        if not parts:
            return
        raw, ord_, hx, low, high = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        key = long_keys(raw)
        order, first = _groups(key)
        sizes = np.diff(np.append(first, len(order)))
        o, h = ord_[order], hx[order]
        shared = np.zeros(len(first), bool)
        for c in (o, h):
            shared |= np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)
        chosen = np.repeat(shared, sizes)
        at = low.astype(np.uint32) | high.astype(np.uint32) << 16
        if chosen.any():
            yield by_document(o[chosen], h[chosen], at[order][chosen].astype(_PLACE))

    return dealt.mapInArrow(run, "ord long, hx long, blob binary")


# ---- 2: contexts

_SENT = (_KEY, np.int64, np.int64, np.uint32, np.uint8, np.uint8, _CONTEXT)


def _words(bytes_: np.ndarray) -> np.ndarray:
    """The bytes of each row as 64-bit words, padded."""
    out = np.zeros((len(bytes_), -(-_CONTEXT_SIZE // 8) * 8), np.uint8)
    out[:, :_CONTEXT_SIZE] = bytes_
    return out.view(np.uint64)


def context_hashes(key: np.ndarray, left: np.ndarray, windows: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = (key ^ (left << np.uint64(8)) ^ windows) * _MIX
    for i in range(words.shape[1]):
        out = (out ^ words[:, i]) * _MIX
        out ^= out >> np.uint64(31)
    return out


def contexts_of(raws: list[bytes], flagged: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Document, key, first window, bytes left of the seed, windows, and the bytes with the seed at a fixed column."""
    doc, key, at, first, last = text_anchors(raws)
    code = doc * (1 << 34) + at
    marks = np.sort(np.concatenate([np.unique(f).astype(np.int64) + (d << 34) for d, f in enumerate(flagged)] or [np.empty(0, np.int64)]))
    place = np.searchsorted(marks, code)
    chosen = np.zeros(len(code), bool)
    inside = place < len(marks)
    chosen[inside] = marks[place[inside]] == code[inside]
    doc, key, at, first, last = (x[chosen] for x in (doc, key, at, first, last))
    sizes = np.array([len(r) for r in raws], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(raws), np.uint8)
    spot = np.arange(_CONTEXT_SIZE)[None, :]
    bytes_ = np.zeros((len(doc), _CONTEXT_SIZE), np.uint8)
    for a in range(0, len(doc), 1 << 14):
        some = slice(a, a + (1 << 14))
        column = (first[some] - at[some] + _LEFT)[:, None]
        used = (spot >= column) & (spot < column + (last - first)[some, None] + WINDOW)
        where = (begin[doc[some]] + at[some] - _LEFT)[:, None] + spot
        bytes_[some][used] = data[where[used]]
    return doc, key, first, (at - first).astype(np.uint8), (last - first + 1).astype(np.uint8), bytes_


#: A seed is hot if it is more than this part of a partition's even share of all anchors, and one of this many at least.
HOT_SHARE, HOT_LEAST = 32, 1024
#: Seeds that a task reports, and those it counts before it forgets the rarest.
REPORTED, COUNTED = 4096, 1 << 22


def hot_seeds(rows: DataFrame, parts: int) -> np.ndarray:
    """Keys of hot seeds in order: ``HOT_SHARE * parts`` at most. They decide where contexts go, never what is equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, total = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        new: list[np.ndarray] = []

        def counted() -> tuple[np.ndarray, np.ndarray]:
            values, sums = np.unique(np.concatenate([np.empty(0, np.uint64), *new]), return_counts=True)
            if len(key):
                every, weight = np.concatenate([key, values]), np.concatenate([n, sums])
                order, first = _groups(every)
                values, sums = every[order][first], np.add.reduceat(weight[order], first)
            if len(values) > COUNTED // 2:
                some = np.sort(np.argpartition(-sums, COUNTED // 2)[: COUNTED // 2])
                values, sums = values[some], sums[some]
            return values, sums

        for batch in batches:
            for part in slices(batch, "text", PIECE):
                new.append(text_anchors(raw_texts(part, "text"))[1] & np.uint64(2**64 - 2 ** (64 - 8 * KEY_BYTES)))
                total += len(new[-1])
            if len(key) + sum(map(len, new)) > COUNTED:
                (key, n), new = counted(), []
        key, n = counted()
        most = np.argsort(-n, kind="stable")[:REPORTED]
        most = most[n[most] > 1]
        yield pa.RecordBatch.from_arrays([pa.array([None, *key[most].view(np.int64).tolist()], pa.int64()), pa.array([total, *n[most].tolist()], pa.int64())], ["key", "n"])

    counts = checkpointed(rows.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    total = counts.where("key is null").first()
    least = max(HOT_LEAST, (total["n"] if total else 0) // (HOT_SHARE * parts))
    hot = counts.where(F.col("key").isNotNull() & (F.col("n") > least)).select("key").toArrow()
    return np.sort(hot.column("key").to_numpy().view(np.uint64))


def told_apart(hot: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts (row, key, first, left, windows, bytes) with those of hot seeds cut into runs of windows that share a second anchor.

    The second anchor is the least of the window's seeds that differ from the first; key and second anchor make the run's key.
    """
    row, key, first, left, windows, bytes_ = columns
    if not len(hot) or not len(key):
        return columns
    is_hot = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
    parts = [tuple(c[~is_hot] for c in columns)]
    picked = np.flatnonzero(is_hot)
    up, down = powers(_CONTEXT_SIZE + 1)
    spot = np.arange(_CONTEXT_SIZE)
    for a in range(0, len(picked), 4096):
        i = picked[a : a + 4096]
        sums = np.zeros((len(i), _CONTEXT_SIZE + 1), np.uint64)
        np.cumsum((bytes_[i].astype(np.uint64) + np.uint64(1)) * up[:_CONTEXT_SIZE], axis=1, out=sums[:, 1:])
        seeds = (sums[:, SEED:] - sums[:, :-SEED]) * down[: _CONTEXT_SIZE - SEED + 1]
        seeds *= _MIX
        seeds ^= seeds >> np.uint64(32)
        seeds *= _MIX
        top = np.uint64(2**64 - 256)
        value = np.where(seeds == seeds[:, [_LEFT]], top, seeds & top) | np.arange(seeds.shape[1], dtype=np.uint64)
        second = np.lib.stride_tricks.sliding_window_view(value, _LEFT + 1, axis=1).min(axis=2)  # by the window's first column
        second = np.where(second & top == top, top, second)  # all seeds of the window are the same
        begin = _LEFT - left[i].astype(np.int64)
        end = begin + windows[i]
        columns_ = np.arange(_LEFT + 1)
        inside = (columns_ >= begin[:, None]) & (columns_ < end[:, None])
        new = inside & (columns_ == begin[:, None])
        new[:, 1:] |= inside[:, 1:] & (second[:, 1:] != second[:, :-1])
        r, c = np.nonzero(new)
        stop = np.append(c[1:], 0)
        last = np.append(r[1:] != r[:-1], True)
        stop = np.where(last, end[r], stop)
        mark = (key[i][r] ^ second[r, c] * np.uint64(BASE)) * _MIX & np.uint64(2**64 - 2 ** (64 - 8 * KEY_BYTES))
        kept = np.where((spot >= c[:, None]) & (spot < (stop + WINDOW - 1)[:, None]), bytes_[i][r], 0).astype(np.uint8)
        parts.append((row[i][r], mark, first[i][r] + (c - begin[r]), (_LEFT - c).astype(np.uint8), (stop - c).astype(np.uint8), kept))
    return tuple(np.concatenate(x) for x in zip(*parts))


def deal_contexts(flagged: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    shared = flagged.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                own, raws = own_texts(part)
                places = [np.frombuffer(b"".join(x), _PLACE) for x in part.column("blobs").take(pa.array(own)).to_pylist()]
                ord_, hx = (part.column(c).to_numpy()[own] for c in ("ord", "hx"))
                doc, key, first, left, windows, bytes_ = contexts_of(raws, places)
                key = key & np.uint64(2**64 - 2 ** (64 - 8 * KEY_BYTES))
                doc, key, first, left, windows, bytes_ = told_apart(shared.value, doc, key, first, left, windows, bytes_)
                held.append((key, ord_[doc], hx[doc], first.astype(np.uint32), left, windows, bytes_))
            if sum(len(h[0]) for h in held) >= HELD // 16:
                yield from send(held)
                held = []
        if held:
            yield from send(held)

    def send(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, ord_, hx, first, left, windows, bytes_ = (np.concatenate(x) for x in zip(*held))
        if not len(key):
            return
        same, order, group = equal_contexts(key, left, windows, bytes_, by_key=False)
        least = np.minimum.reduceat(ord_[order], same)
        covered = np.empty(len(key), bool)
        covered[order] = ord_[order] > least[group]
        runs = np.empty(len(key), _RUN)
        runs["first"], runs["mask"] = first, (np.uint32(1) << windows.astype(np.uint32)) - np.uint32(1)
        yield from _passed(ord_[covered], hx[covered], buckets, runs[covered])
        rest = np.flatnonzero(~covered)
        yield from _dealt(key[rest], buckets, short_keys(key[rest]), *(x[rest] for x in (ord_, hx, first, left, windows, bytes_)))

    return flagged.mapInArrow(run, _ROW)


def equal_contexts(key: np.ndarray, left: np.ndarray, windows: np.ndarray, bytes_: np.ndarray, by_key: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal contexts, first by hash, then verified: beginnings, order, and each ordered row's group number."""
    words = _words(bytes_)
    mark = context_hashes(key, left.astype(np.uint64), windows.astype(np.uint64), words)
    order, first = _groups(key, mark, sorted_by=None if by_key else 1)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    head = order[first][group]
    wrong = (words[order] != words[head]).any(axis=1) | (left[order] != left[head]) | (windows[order] != windows[head])
    if wrong.any():  # a collision: group these by their bytes
        columns = (key, left, windows, *(bytes_[:, i] for i in range(_CONTEXT_SIZE)))
        order, first = _groups(*columns)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return first, order, group


# ---- 3: the suffix sort


class Suffixes:
    """Strings with the seed at a fixed column; a suffix is (row, column), and suffixes are compared at equal columns only."""

    def __init__(self, bytes_: np.ndarray):
        self.bytes = bytes_
        up, _ = powers(_CONTEXT_SIZE + 1)
        self.sums = np.zeros((len(bytes_), _CONTEXT_SIZE + 1), np.uint64)
        np.cumsum((bytes_.astype(np.uint64) + np.uint64(1)) * up[:_CONTEXT_SIZE], axis=1, out=self.sums[:, 1:])

    def common(self, a: np.ndarray, b: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Common extension of two suffixes each, up to a window, by binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), WINDOW)
        base = self.sums[a, column] - self.sums[b, column]
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) >> 1
            same = self.sums[a, column + mid] - self.sums[b, column + mid] == base
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)

    def compare(self, a: np.ndarray, b: np.ndarray, column: np.ndarray) -> np.ndarray:
        n = self.common(a, b, column)
        at = np.minimum(column + n, _CONTEXT_SIZE - 1)
        return np.where(n == WINDOW, 0, self.bytes[a, at].astype(np.int16) - self.bytes[b, at])

    def sort(self, group: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Order of the items (already together by group) by suffix within the group: a bottom-up mergesort of all groups at once."""
        n = len(group)
        order = np.arange(n)
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.append(begin, n))
        start, size = np.repeat(begin, size), np.repeat(size, size)
        place = np.arange(n) - start
        width = 1
        while True:
            work = np.flatnonzero(size > width)
            if not len(work):
                return order
            # the items of runs of this width find their rank in the run beside theirs
            p, s, z = place[work], start[work], size[work]
            run = p // width
            mine, other = run * width, (run ^ 1) * width
            left = (run & 1) == 0
            low = np.minimum(other, z)
            end = np.minimum(other + width, z)
            high = end.copy()
            item = order[work]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                rival = order[s[open_] + mid]
                it = item[open_]
                c = self.compare(row[rival], row[it], column[it])
                before = (c < 0) | (c == 0) & ~left[open_]  # equal items of the left run come first
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            rank = low - np.minimum(other, z)
            new = s + np.minimum(mine, other) + (p - mine) + rank
            merged = order.copy()
            merged[new] = item
            order = merged
            width *= 2


def least_by_window(key: np.ndarray, left: np.ndarray, windows: np.ndarray, bytes_: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For distinct contexts in order of key: the smallest id that has each of the windows, by column; others hold the largest integer."""
    out = np.full((len(key), _LEFT + 1), np.iinfo(np.int64).max)
    column = _LEFT - left.astype(np.int64)
    spot = np.arange(_LEFT + 1)[None, :]
    used = (spot >= column[:, None]) & (spot < column[:, None] + windows[:, None])
    out[used] = np.broadcast_to(least[:, None], out.shape)[used]
    number = np.cumsum(np.diff(key, prepend=key[:1] - np.uint64(1)) != 0) if len(key) else np.empty(0, np.int64)
    many = np.bincount(number, minlength=1)[number] > 1 if len(key) else np.empty(0, bool)
    rows, columns = np.nonzero(used & many[:, None])
    if not len(rows):
        return out
    group = number[rows] * (_LEFT + 1) + columns
    order = np.argsort(group, kind="stable")
    group, rows, columns = group[order], rows[order], columns[order]
    suffixes = Suffixes(bytes_)
    order = suffixes.sort(group, rows, columns)
    group, rows, columns = group[order], rows[order], columns[order]
    together = group[1:] == group[:-1]
    same = np.zeros(len(rows), bool)
    same[1:] = together & (suffixes.common(rows[1:], rows[:-1], columns[1:]) == WINDOW)
    spot = np.arange(WINDOW)
    failed = False
    pairs = np.flatnonzero(together) + 1
    for a in range(0, len(pairs), 1 << 16):  # verify what hashes call equal, and the order of the others
        i = pairs[a : a + (1 << 16)]
        before, after = (bytes_[rows[k][:, None], columns[i][:, None] + spot] for k in (i - 1, i))
        differ = before != after
        at = differ.argmax(axis=1)
        n = np.arange(len(i))
        failed |= bool((differ[n, at] & (same[i] | (before[n, at] > after[n, at]))).any())
    if failed:
        strings = [bytes_[r, c : c + WINDOW].tobytes() for r, c in zip(rows, columns)]
        order = np.array(sorted(range(len(rows)), key=lambda i: (group[i], strings[i])))
        same = np.array([False, *((group[a], strings[a]) == (group[b], strings[b]) for a, b in zip(order, order[1:]))])
        rows, columns = rows[order], columns[order]
    first = np.flatnonzero(~same)
    best = np.minimum.reduceat(out[rows, columns], first)
    out[rows, columns] = np.repeat(best, np.diff(np.append(first, len(rows))))
    return out


#: Contexts sorted at once; a seed's contexts are never parted.
SORTED = 1 << 14
#: Seeds with more contexts than this are told apart by second anchors before they are sorted.
MANY = 256


def repeated_windows(dealt: DataFrame) -> DataFrame:
    """``ord, hx, blob``: windows (a first one and a bit mask) that a document of smaller id has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        yield from _gathered(batches, _SENT, parts)
        if not parts:
            return
        columns = [np.concatenate(x) for x in zip(*parts)]
        parts.clear()
        columns[0] = long_keys(columns[0])
        order = np.argsort(columns[0], kind="stable")
        key = columns[0][order]
        ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
        a = 0
        while a < len(key):
            b = int(ends[min(len(ends) - 1, np.searchsorted(ends, a + SORTED))])
            yield from solve(*(c[order[a:b]] for c in columns))
            a = b

    def solve(key, ord_, hx, first, left, windows, bytes_) -> Iterator[pa.RecordBatch]:
        seeds, n = np.unique(key, return_counts=True)
        row, key, first, left, windows, bytes_ = told_apart(seeds[n > MANY], np.arange(len(key)), key, first, left, windows, bytes_)
        ord_, hx = ord_[row], hx[row]
        begin, order, group = equal_contexts(key, left, windows, bytes_)
        head = order[begin]
        least = np.minimum.reduceat(ord_[order], begin)
        by = least_by_window(key[head], left[head], windows[head], bytes_[head], least)
        column = _LEFT - left[order].astype(np.int64)
        mask = np.zeros(len(order), np.uint32)
        o = ord_[order]
        for i in range(_LEFT + 1):
            inside = i < windows[order]
            found = by[group, np.minimum(column + i, _LEFT)]
            mask |= np.where(inside & (found < o), np.uint32(1 << i), np.uint32(0))
        runs = np.empty(len(order), _RUN)
        runs["first"], runs["mask"] = first[order], mask
        hit = mask > 0
        if hit.any():
            yield by_document(o[hit], hx[order][hit], runs[hit])

    return dealt.mapInArrow(run, "ord long, hx long, blob binary")


# ---- 4: removal


def covered(size: int, runs: np.ndarray) -> np.ndarray:
    """Which bytes the marked windows cover."""
    bit = np.arange(_LEFT + 1, dtype=np.uint32)
    row, column = np.nonzero((runs["mask"][:, None] >> bit) & np.uint32(1))
    begins = np.zeros(size, np.int8)
    begins[runs["first"].astype(np.int64)[row] + column] = 1
    open_ = begins.copy()  # windows that begin less those that end: at most WINDOW at a byte
    open_[WINDOW:] -= begins[:-WINDOW]
    return np.cumsum(open_, dtype=np.int8) > 0


#: Text bytes that a shuffle partition stands for at most; its anchors and contexts take about as much.
PARTITION_BYTES = 128 << 20


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans`` and ``kept`` (binary) of every row."""
    spark = df.sparkSession
    none = (1 << 63) - 1
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(none)).alias("ord"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("hx", F.xxhash64("text"))
    # who has a text first: copies, however many, meet as partial minima of a hash
    narrow = checkpointed(rows.select("ord", "hx", F.octet_length("text").alias("n"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("h")).distinct())
    total = narrow.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    buckets = 2 * parts
    hot = hot_seeds(rows.where(F.octet_length("text") >= WINDOW), parts)
    first = checkpointed(narrow.groupBy("h").agg(F.min("ord").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"))
    info = checkpointed(narrow.join(first, "h", "left").select("ord", "hx", F.coalesce("least", "ord").alias("least")))
    docs = rows.repartition(parts, "ord", "hx").join(info.hint("shuffle_hash"), ["ord", "hx"])

    def by_document(found: DataFrame) -> DataFrame:
        return found.groupBy("ord", "hx").agg(F.collect_list("blob").alias("blobs")).hint("shuffle_hash")

    # the same columns in each of the three uses of the texts, so that their one shuffle serves all
    texts = docs.select("_id", "ord", "hx", "text", "least")
    flagged = by_document(shared_anchors(deal_anchors(texts, buckets).repartition(parts, "bucket")))
    dealt = deal_contexts(texts.join(flagged, ["ord", "hx"]).select("_id", "ord", "hx", "text", "least", "blobs"), buckets, hot)
    marks = by_document(repeated_windows(dealt.repartition(parts, "bucket")))
    marked = docs.join(marks, ["ord", "hx"], "left").select("_id", "ord", "hx", "text", "least", "blobs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                copies = part.column("least").to_numpy() < part.column("ord").to_numpy()
                n_bytes, removed, spans, kept = [], [], [], []
                for raw, copy, blobs in zip(raw_texts(part, "text"), copies, part.column("blobs").to_pylist()):
                    gone = None
                    if copy and len(raw) >= WINDOW:
                        gone = np.ones(len(raw), bool)
                    elif blobs and not copy:
                        gone = covered(len(raw), np.frombuffer(b"".join(blobs), _RUN))
                    n_bytes.append(len(raw))
                    removed.append(0 if gone is None else int(gone.sum()))
                    spans.append(0 if gone is None else int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                    kept.append(raw if gone is None else np.frombuffer(raw, np.uint8)[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, spans)), pa.array(kept, pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    kind = df.schema[id_col].dataType.simpleString()
    return marked.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, o, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT r, o, h, unnest(range(length(h) // 2 - 49)) AS p FROM d)),
f AS (SELECT s, min(o) AS first FROM w GROUP BY s),
hit AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS gap FROM w JOIN f USING (s) WHERE first < o),
run AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM (SELECT r, p, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS k FROM hit) GROUP BY r, k),
gone AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last FROM run GROUP BY r),
piece AS (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM run),
kept AS (SELECT r, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head FROM piece JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

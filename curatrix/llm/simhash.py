"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has a bit for each of 64 positions: 1 if it is set in over half of the XXH64 hashes of a text's word shingles. Two
fingerprints link at ``LIMIT`` = 4 or fewer differing bits. The bits lie on a ring of five boxes. If two fingerprints differ in
at most 4 bits, there is a box from which every chain of consecutive boxes stays within its proportional budget: 0 differences in one
box, 1 in two, 2 in three, 3 in four, 4 in all. So linked fingerprints agree, for some box, in that box and in the next one but for
one bit. Distinct fingerprints are indexed by these two boxes with each bit of the second one left out in turn; those that meet
under a key go through the longer chains' budgets and then the full Hamming check.

Copies never multiply: fingerprints are made distinct before the index, and under a key with many fingerprints links are not listed
pairwise. There, pivots take what lies within the limit of them; only pivots that are not connected yet and lie within three limits of
each other compare their groups, so a dense group of n costs n times its few pivots, and it gives at most n - 1 links. A key with more than
``HOT_KEY`` fingerprints is dealt again: of five pieces of the bits outside of its two boxes linked fingerprints agree in one at least.

Defined cases: null and empty texts, and texts without words, have fingerprint zero, linked like any other; fewer words than a
shingle make one shingle; texts of any length are read whole; documents with null ids take part, and the component id of a class is
its smallest id that is not null (null if there is none); repeated rows give a row each; an empty table gives an empty table; columns
besides the named ones are not carried by ``simhash_components`` and all are carried by ``keep_one``, under any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm._frames import checkpointed, map_slices, numbered, raw_texts, read
from curatrix.operators.graph import connected_components
from curatrix.operators.skew import spread_join

LIMIT = 4
SEED = 42
SHINGLE = 4
#: Boxes on the ring, from the highest bits: LIMIT + 1 of them, so that a budget of one box is 0 differences.
BOXES = (13, 13, 13, 13, 12)
#: Fingerprints under one key that are taken together; those of larger keys are dealt again by a piece of their other bits.
HOT_KEY = 1 << 15
#: Groups up to this size compare all pairs at once; larger ones go by pivots.
SMALL_GROUP = 256


def fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    """Of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= size:
        hashes = np.array([xxhash.xxh64_intdigest(text, SEED)], np.uint64)
    else:
        ends = list(accumulate(map(len, words)))
        ends = [e + i for i, e in enumerate(ends)]
        starts = [0, *(e + 1 for e in ends[:-size])]
        shingles = [text[a:b] for a, b in zip(starts, ends[size - 1 :])]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[a : a + (1 << 15)].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, fp, spread``: fp is the fingerprint as a signed long, spread a number by which equal rows can be dealt."""
    narrow = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([narrow.schema[id_col], T.StructField("fp", T.LongType(), False), T.StructField("spread", T.IntegerType(), False)])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(r) for r in raw_texts(part, "_text")], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(fp), pa.array(np.arange(len(fp), dtype=np.int32))], schema.names)

    return map_slices(narrow, "_text", work, schema)


def _masks() -> list[int]:
    out, low = [], 64
    for n in BOXES:
        low -= n
        out.append(((1 << n) - 1) << low)
    return out


MASKS = _masks()
#: For each start: the bits of chains of three and four boxes and their budgets.
CHAINS = [[(sum(MASKS[(i + j) % 5] for j in range(n)), n * LIMIT // 5) for n in (3, 4)] for i in range(5)]


def ring_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of each fingerprint (uint64): (keys of shape (n, 64), starts of shape (64,))."""
    keys, starts = [], []
    for i in range(5):
        second = MASKS[(i + 1) % 5]
        pair = np.uint64(MASKS[i] | second)
        bits = [b for b in range(64) if second >> b & 1]
        for b in bits:
            # which bit is left out is part of the key: a multiplicative mix keeps the keys of all starts apart
            left = fp & (pair & ~np.uint64(1 << b))
            keys.append((left ^ np.uint64(0x9E3779B97F4A7C15 * (i * 64 + b + 1) & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93))
            starts.append(i)
    return np.stack(keys, axis=1), np.array(starts, np.uint8)


def _near(x: np.ndarray, fp: np.uint64, start: int) -> np.ndarray:
    """Which of ``x`` stay within all budgets of ``fp``, from the chain of three boxes to the full distance."""
    differ = x ^ fp
    rows = np.arange(len(x))
    for mask, budget in (*CHAINS[start], (2**64 - 1, LIMIT)):
        rows = rows[np.bitwise_count(differ[rows] & np.uint64(mask)) <= budget]
    return rows


def _pieces() -> list[list[tuple[int, int]]]:
    """For each start: five (shift, bits) pieces of the three boxes that its two boxes leave."""
    out = []
    for i in range(5):
        bits = [b for b in range(64) if not (MASKS[i] | MASKS[(i + 1) % 5]) >> b & 1]
        cuts = [k * len(bits) // (LIMIT + 1) for k in range(LIMIT + 2)]
        out.append([sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])])
    return out


PIECES = _pieces()


def piece_keys(key: np.ndarray, fp: np.ndarray, start: int) -> np.ndarray:
    """Five keys (columns) for each fingerprint of a key: the key with a piece of the bits outside of its boxes."""
    salt = [np.uint64(0xC2B2AE3D27D4EB4F * (k + 1) & (2**64 - 1)) for k in range(LIMIT + 1)]
    return np.stack([(key ^ (fp & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15) ^ salt[k]) * np.uint64(0xD6E8FEB86659FD93) for k, mask in enumerate(PIECES[start])], axis=1)


def links_under_key(fp: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links (positions) that connect exactly what links of distinct ``fp`` under one key connect."""
    n = len(fp)
    if n == 2:
        return [(0, 1)] if len(_near(fp[1:], fp[0], start)) else []
    if n <= SMALL_GROUP:
        a, b = np.triu_indices(n, 1)
        for mask, budget in (*CHAINS[start], (2**64 - 1, LIMIT)):
            near = np.bitwise_count((fp[a] ^ fp[b]) & np.uint64(mask)) <= budget
            a, b = a[near], b[near]
        if len(a) <= 2 * n:
            return list(zip(a.tolist(), b.tolist()))
    left = np.arange(n)
    pivots: list[int] = []
    groups: list[np.ndarray] = []
    while len(left):
        p = left[0]
        members = left[_near(fp[left], fp[p], start)]
        pivots.append(int(p))
        groups.append(members)
        left = np.setdiff1d(left, members, assume_unique=True)
    links = [(p, int(x)) for p, g in zip(pivots, groups) for x in g if x != p]
    root = list(range(len(pivots)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at = fp[pivots]
    for i in range(len(pivots)):
        for j in np.flatnonzero(np.bitwise_count(at[i + 1 :] ^ at[i]) <= 3 * LIMIT) + i + 1:
            a, b = find(i), find(int(j))
            if a == b:
                continue
            for x in groups[i]:
                near = np.flatnonzero(np.bitwise_count(fp[groups[j]] ^ fp[x]) <= LIMIT)
                if len(near):
                    links.append((int(x), int(groups[j][near[0]])))
                    root[a] = b
                    break
    return links


def near_links(fps: DataFrame) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) whose closure is that of all pairs within the limit."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for a in range(0, len(fp), 2048):
                part = fp[a : a + 2048]
                keys, starts = ring_keys(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(starts, len(part)).view(np.int8)), pa.array(np.repeat(part, keys.shape[1]).view(np.int64))], ["key", "start", "fp"]
                )

    def join(batches: Iterator[pa.RecordBatch], again: bool) -> Iterator[pa.RecordBatch]:
        open_: list[tuple[np.ndarray, ...]] = []  # rows of the last key so far, which may go on in the next batch
        hot = False  # that key has gone on to the next deal already

        def rows_of(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*parts)]

        for batch in batches:
            part = (batch.column("key").to_numpy(), batch.column("start").to_numpy(), batch.column("fp").to_numpy().view(np.uint64))
            if not len(part[0]):
                continue
            cut = np.flatnonzero(np.diff(part[0])) + 1
            if open_ and open_[0][0][0] == part[0][0]:
                head = int(cut[0]) if len(cut) else len(part[0])
                open_.append(tuple(x[:head] for x in part))
                if hot or again and sum(len(x[0]) for x in open_) > HOT_KEY:
                    yield dealt_again(*rows_of(open_[int(hot) :]))
                    open_, hot = [tuple(x[:1] for x in part)], True
                if not len(cut):
                    continue
                part, cut = tuple(x[head:] for x in part), cut[1:] - head
            if open_ and not hot:
                yield linked(*rows_of(open_))
            end = int(cut[-1]) if len(cut) else 0
            yield linked(*(x[:end] for x in part))
            open_, hot = [tuple(x[end:] for x in part)], False
        if open_ and not hot:
            yield linked(*rows_of(open_))

    names = ["a", "b", "key", "start"]

    def dealt_again(key: np.ndarray, start: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """The rows of one key under the five keys that their other bits give; ``b`` is null."""
        keys = piece_keys(key, fp, int(start[0]))
        n, k = keys.shape
        rows = [pa.array(np.repeat(fp, k).view(np.int64)), pa.nulls(n * k, pa.int64()), pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(start, k))]
        return pa.RecordBatch.from_arrays(rows, names)

    def linked(key: np.ndarray, start: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        firsts = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.empty(0, np.int64)
        sizes = np.diff(np.append(firsts, len(key)))
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        pairs = firsts[sizes == 2]
        if len(pairs):
            x, y, s = fp[pairs], fp[pairs + 1], start[pairs]
            ok = np.bitwise_count(x ^ y) <= LIMIT
            for i in range(5):
                for mask, budget in CHAINS[i]:
                    ok &= (s != i) | (np.bitwise_count((x ^ y) & np.uint64(mask)) <= budget)
            left.append(x[ok])
            right.append(y[ok])
        for a, n in zip(firsts[sizes > 2], sizes[sizes > 2]):
            group = np.unique(fp[a : a + n])
            found = np.array(links_under_key(group, int(start[a])), np.int64).reshape(-1, 2)
            left.append(group[found[:, 0]])
            right.append(group[found[:, 1]])
        found = [pa.array(np.concatenate(x or [np.empty(0, np.uint64)]).view(np.int64)) for x in (left, right)]
        return pa.RecordBatch.from_arrays([*found, pa.nulls(len(found[0]), pa.int64()), pa.nulls(len(found[0]), pa.int8())], names)

    def solved(keyed: DataFrame, again: bool) -> DataFrame:
        return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: join(batches, again), "a long, b long, key long, start byte")

    first = checkpointed(solved(fps.select("fp").mapInArrow(index, "key long, start byte, fp long"), True))
    rest = first.where("b is null").select("key", "start", F.col("a").alias("fp"))
    return first.where("b is not null").select("a", "b").union(solved(rest, False).select("a", "b")).distinct()


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint`` (16 hex digits) and ``component_id``, and ``root``, a name for classes even of null ids."""
    df, names = numbered(df.select(id_col, text_col))
    key = names[id_col]
    marked = checkpointed(fingerprints(df, key, names[text_col]))
    classes = marked.groupBy("fp").agg(F.min(key).alias("_least"))
    # the fingerprints are few numbers; as many partitions as the input has, since each becomes 64 index rows
    roots = connected_components(near_links(classes.repartition("fp")))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "_least")
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    # one class may hold very many fingerprints, and one fingerprint very many rows
    named = spread_join(rooted.select("fp", "root"), least, "root", "fp")
    out = spread_join(marked, named, "fp", key, "spread")
    return out.select(F.col(key).alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distinct_ids: bool = False) -> DataFrame:
    """One document of each class: of the rows of its smallest id (of all its rows, where all ids are null) the one of least text.

    A document is a row here, not an id: where an id that stands on several texts is the smallest of several classes, each of these classes
    keeps its own row. With ``distinct_ids`` an id that would stay more than once keeps the row of least text only, whatever is lost by that.
    """
    columns = df.columns
    df, names = numbered(df)
    id_col, text_col = names[id_col], names[text_col]
    marked = simhash_components(df, id_col, text_col)
    rest = [F.col(c) for c, kind in df.dtypes if c != id_col and not kind.startswith("map")]

    def least_of(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy(text_col, *rest))).where("_place = 1").drop("_place")

    ids = marked.where(F.col(id_col).isNotNull()).groupBy(id_col)
    chosen = ids.agg(F.max(F.col(id_col) == F.col("component_id")).alias("_least"), (F.min("fingerprint") != F.max("fingerprint")).alias("_split")).where("_least")
    known = least_of(df.join(chosen.where("not _split"), id_col, "left_semi"), id_col)
    # ids with several fingerprints: only rows of the classes that they were chosen for; these rows' fingerprints are made again
    split = with_fingerprint(df.join(chosen.where("_split"), id_col, "left_semi"), text_col)
    own = marked.where(F.col(id_col) == F.col("component_id")).select(id_col, "fingerprint", "root").distinct()
    split = split.join(own, [id_col, "fingerprint"])
    split = least_of(split, id_col) if distinct_ids else least_of(split, id_col, "root")
    # classes whose ids are all null: their fingerprints are made again, from these rows alone
    nameless = marked.where("component_id is null").select("fingerprint", "root").distinct()
    one = least_of(with_fingerprint(df.where(F.col(id_col).isNull()), text_col).join(nameless, "fingerprint"), "root")
    return known.unionByName(split.select(*df.columns)).unionByName(one.select(*df.columns)).toDF(*columns)


def with_fingerprint(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with a column ``fingerprint`` (16 hex digits)."""
    schema = T.StructType([*df.schema, T.StructField("fingerprint", T.StringType())])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        marks = pa.array([f"{fingerprint(r):016x}" for r in raw_texts(part, text_col)], pa.string())
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns)), marks], schema.names)

    return map_slices(df, text_col, work, schema)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")

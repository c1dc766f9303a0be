"""Near hashes by blocks: what meets under a key is compared in NumPy, so that candidates are never rows.

Distinct hashes are indexed by combinations of segments as in ``joins.hamming_pairs``. The rows of a key come to one task in order; a key of
more than ``HOT_KEY`` hashes is dealt to tiles of two blocks each, so a task holds at most two blocks of a key, however many hashes it has.
Candidates, survivors and (for ``joins``' totals) even pairs live in bounded arrays only. The number of pairs of a dense table grows with the
square of its hashes; the index grows with the hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import hex_lane

#: Hashes of one key that are a block; larger keys are dealt by pairs of blocks.
HOT_KEY = 1 << 15
#: Comparisons made at once, and pairs handed on at once.
CELLS = 1 << 15
PAIRS = 1 << 16
#: Groups up to this size are compared by shifts of the whole batch.
SMALL = 24
#: Values of a column, in a batch, up to which each row has a place for each of them.
FEW = 8

Segments = tuple[tuple[int, int], ...]


def segments(digits: int, n: int) -> list[tuple[int, int]]:
    """(first digit from 0, digits) of ``n`` segments of a hex string, as even as can be."""
    cuts = [i * digits // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def lane_masks(segment: tuple[int, int], digits: int) -> list[tuple[int, np.uint64]]:
    """The segment's bits as (lane, mask)."""
    first, n = segment
    out: dict[int, int] = {}
    for d in range(first, first + n):
        lane = d // 16
        width = min(16, digits - 16 * lane)
        out[lane] = out.get(lane, 0) | 0xF << 4 * (width - 1 - (d - 16 * lane))
    return [(lane, np.uint64(mask)) for lane, mask in out.items()]


def index(hashes: DataFrame, keys: Sequence[tuple[int, Segments]], digits: int) -> DataFrame:
    """``hashes`` (column ``hash``, distinct, not null, and any others) under each of its keys, with ``no, value, tile, block`` and lanes, a
    key's rows together and in order of tile."""
    lanes = -(-digits // 16)
    parts = F.array(*(F.struct(F.lit(no).alias("no"), F.concat(*(F.substring("hash", a + 1, n) for a, n in key)).alias("value")) for no, key in keys))
    sizes = hashes.select(F.explode(parts).alias("s")).groupBy("s.no", "s.value").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_KEY)
    hot = sizes.select("no", "value", F.ceil(F.col("_n") / HOT_KEY).cast("int").alias("_blocks"))
    rows = hashes.select("*", *(hex_lane("hash", i).alias(f"lane{i}") for i in range(lanes)))
    rows = rows.select("*", F.explode(parts).alias("_s")).select("*", "_s.no", "_s.value").drop("_s")
    # few keys are hot: one of HOT_KEY hashes or more
    rows = rows.join(F.broadcast(hot), ["no", "value"], "left")
    own = F.when(F.col("_blocks") > 1, F.pmod(F.xxhash64("hash"), "_blocks").cast("int")).otherwise(0)
    rows = rows.withColumn("block", own)
    other = F.when(F.col("_blocks") > 1, F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("_other", F.explode(other))
    rows = rows.withColumns({"low": F.least("block", "_other"), "high": F.greatest("block", "_other")}).drop("_other", "_blocks")
    return rows.repartition("no", "value", "low", "high").sortWithinPartitions("no", "value", "low", "high")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (rows of one key and tile, which come together) and the places where groups begin."""
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in ("no", "value", "low", "high"):
            x = table.column(c)
            new[1:] |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(batch.column(c)[batch.num_rows - 1] == held[0].column(c)[0] for c in ("no", "value", "low", "high")):
            held.append(batch)  # one group goes on
            continue
        table = pa.Table.from_batches([*held, batch])
        at = starts(table)
        end = int(at[-1])
        if end:
            yield table.slice(0, end).combine_chunks(), at[:-1]
        held = table.slice(end).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table)


def _lanes(table: pa.Table) -> list[np.ndarray]:
    return [table.column(c).to_numpy().view(np.uint64) for c in table.column_names if c.startswith("lane")]


def _ones(lanes: list[np.ndarray]) -> np.ndarray:
    d = np.bitwise_count(lanes[0])
    if len(lanes) > 1:
        d = d.astype(np.uint16)
        for v in lanes[1:]:
            d += np.bitwise_count(v)
    return d


def _distance(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    return _ones([a ^ b for a, b in zip(x, y)])


def _near(table: pa.Table, at: np.ndarray, threshold: int, chosen: Sequence[Segments], parts: Sequence[tuple[int, int]], digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the table's pairs within the threshold that its keys are the first for."""
    x = _lanes(table)
    no = table.column("no").to_numpy()
    low, high, block = (table.column(c).to_numpy() for c in ("low", "high", "block"))
    masks = [lane_masks(s, digits) for s in parts]
    #: For each key: the earlier segments that are not its own. All must differ, else an earlier key has the pair.
    earlier = [[masks[k] for k in range(parts.index(key[-1])) if parts[k] not in key] for key in chosen]

    def firsts(differ: list[np.ndarray], key: int) -> np.ndarray:
        """Places of the pairs (by their differing bits) that no earlier key has."""
        kept = None
        for segment in earlier[key]:
            ok = np.bitwise_and(differ[segment[0][0]], segment[0][1]) != 0
            for lane, mask in segment[1:]:
                ok |= (differ[lane] & mask) != 0
            place = np.flatnonzero(ok)
            differ = [v[place] for v in differ]
            kept = place if kept is None else kept[place]
        return np.arange(len(differ[0])) if kept is None else kept

    sizes = np.diff(np.append(at, table.num_rows))
    small = sizes <= SMALL
    ends = np.repeat(np.where(small, at + sizes, 0), sizes)
    places = np.arange(table.num_rows)
    for s in range(1, int(sizes[small].max(initial=1))):
        i = places[: len(places) - s]
        i = i[i + s < ends[: len(places) - s]]
        if not len(i):
            break
        differ = [v[i] ^ v[i + s] for v in x]
        d = _ones(differ)
        ok = np.flatnonzero((d <= threshold) & ((low[i] == high[i]) | (block[i] != block[i + s])))
        i, d, differ = i[ok], d[ok], [v[ok] for v in differ]
        for k in np.unique(no[i]):
            own = np.flatnonzero(no[i] == k)
            own = own[firsts([v[own] for v in differ], int(k))]
            yield i[own], i[own] + s, d[own]
    for a, n in zip(at[~small].tolist(), sizes[~small].tolist()):
        key = int(no[a])
        one = low[a] == high[a]
        if one:
            left = right = np.arange(a, a + n)
        else:  # a tile of two blocks: pairs between them
            mine = block[a : a + n] == low[a]
            left, right = a + np.flatnonzero(mine), a + np.flatnonzero(~mine)
        y = [v[right] for v in x]
        step = max(1, CELLS // max(1, len(right)))
        for b in range(0, len(left), step):
            rows = left[b : b + step]
            skip = b if one else 0  # below the diagonal
            differ = [v[rows][:, None] ^ w[None, skip:] for v, w in zip(x, y)]
            d = _ones(differ)
            width = d.shape[1]
            flat = np.flatnonzero(d.ravel() <= threshold)
            if one and len(rows) == 1:
                flat = flat[1:]  # the row itself
            if not len(flat):
                continue
            flat = flat[firsts([v.ravel()[flat] for v in differ], key)]
            p, q = np.divmod(flat, width)
            if one:
                up = np.flatnonzero(p < q)
                p, q, flat = p[up], q[up], flat[up]
            yield rows[p], right[q + skip], d.ravel()[flat]


def near(hashes: DataFrame, threshold: int, digits: int, work: Callable[[pa.Table, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]], schema: str, agree: int | None = None) -> DataFrame:
    """``work`` over tables of index rows and their pairs (places and distance), each pair of distinct hashes within the threshold once."""
    agree = agree or (2 if threshold + 2 <= digits else 1)
    parts = segments(digits, threshold + agree)
    keys = list(combinations(parts, agree))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in _groups(batches):
            if table.num_rows > len(at):
                yield from work(table, _gathered(_near(table, at, threshold, keys, parts, digits)))

    return index(hashes, list(enumerate(keys)), digits).mapInArrow(run, schema)


def _gathered(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same in portions of about ``PAIRS``."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for part in found:
        if len(part[0]):
            held.append(part)
            n += len(part[0])
        if n >= PAIRS:
            yield tuple(np.concatenate(v) for v in zip(*held))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(v) for v in zip(*held))


class Values:
    """A column's values in each row's class, counted: ``<column>_one`` (the value, if there is one), ``<column>_known`` (records with a value)
    and ``<column>_more`` (value and number, where there are several)."""

    def __init__(self, table: pa.Table, column: str) -> None:
        one, more = (table.column(f"{column}_{k}").combine_chunks() for k in ("one", "more"))
        self.known = table.column(f"{column}_known").to_numpy()
        several = pc.fill_null(pc.list_value_length(more), 0).to_numpy(zero_copy_only=False)
        flat = more.flatten()
        words = pa.chunked_array([one, flat.field("value")]).combine_chunks().dictionary_encode()
        code = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.one, codes = code[: len(one)], code[len(one) :]
        self.several = several > 0
        self.size = np.where(self.several, several, (self.one >= 0).astype(np.int64))
        owner = np.repeat(np.arange(len(one)), several)
        single = np.flatnonzero(~self.several & (self.one >= 0))
        self.words = len(words.dictionary) + 1
        where = np.concatenate([owner, single]) * self.words + np.concatenate([codes, self.one[single]])
        times = np.concatenate([flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64), self.known[single]])
        order = np.argsort(where, kind="stable")
        self.where, self.times = where[order], times[order]
        self.start = np.searchsorted(self.where, np.arange(len(one)) * self.words)
        self.table = None
        if self.words <= FEW:
            self.table = np.zeros((len(one), self.words), np.int64)
            self.table.ravel()[self.where] = self.times

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of rows, the pairs of their records that have one value."""
        if self.table is not None:
            return np.einsum("ij,ij->i", self.table[i], self.table[j])
        out = np.where((self.one[i] == self.one[j]) & (self.one[i] >= 0), self.known[i] * self.known[j], 0)
        rest = np.flatnonzero(self.several[i] | self.several[j])
        if len(rest):
            out[rest] = 0
            i, j = i[rest], j[rest]
            swap = self.size[i] > self.size[j]
            a, b = np.where(swap, j, i), np.where(swap, i, j)
            portion = np.cumsum(self.size[a]) // (1 << 22)
            for cut in np.split(np.arange(len(a)), np.flatnonzero(np.diff(portion)) + 1):
                n = self.size[a[cut]]
                pair = np.repeat(np.arange(len(cut)), n)
                entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[a[cut]], n)
                wanted = self.where[entry] % self.words + b[cut][pair] * self.words
                at = np.minimum(np.searchsorted(self.where, wanted), len(self.where) - 1)
                product = np.where(self.where[at] == wanted, self.times[entry] * self.times[at], 0)
                sums, end = np.append(0, np.cumsum(product)), np.cumsum(n)
                out[rest[cut]] = sums[end] - sums[end - n]
        return out


def forest(table: pa.Table, at: np.ndarray, threshold: int, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of near rows that connect, within each group, the roots (numbers) that all its near pairs connect: fewer than it has roots."""
    x = _lanes(table)
    for a, n in zip(at.tolist(), np.diff(np.append(at, table.num_rows)).tolist()):
        if n < 2:
            continue
        names = root[a : a + n]
        order = np.argsort(names, kind="stable")
        cuts = np.flatnonzero(np.diff(names[order], prepend=names[order][0] - 1))
        if len(cuts) < 2:
            continue
        sizes = np.diff(np.append(cuts, n))
        if len(cuts) == n and n == 2:
            if _distance([v[a : a + 1] for v in x], [v[a + 1 : a + 2] for v in x])[0] <= threshold:
                yield np.array([a]), np.array([a + 1])
            continue
        # whole roots are visited; what is left (numbers of roots, the largest last) is compared with one visited row at a time
        rank = np.empty(len(cuts), np.int64)
        by_size = np.argsort(sizes, kind="stable")
        rank[by_size] = np.arange(len(cuts))
        number = rank[np.repeat(np.arange(len(cuts)), sizes)]
        place = np.argsort(number, kind="stable")
        rows, number = a + order[place], number[place]
        begin = np.searchsorted(number, np.arange(len(cuts) + 1))
        left, owner = rows, number
        y = [v[left] for v in x]
        waiting = np.ones(len(cuts), bool)
        i_found, j_found = [], []
        for seed in range(len(cuts)):
            if not waiting[seed]:
                continue
            todo = [seed]
            waiting[seed] = False
            keep = waiting[owner]
            left, owner, y = left[keep], owner[keep], [v[keep] for v in y]
            while todo and len(left):
                r = todo.pop()
                members = rows[begin[r] : begin[r + 1]]
                step = max(1, CELLS // max(1, len(left)))
                for b in range(0, len(members), step):
                    part = members[b : b + step]
                    d = _distance([v[part][:, None] for v in x], [v[None, :] for v in y])
                    hit = np.flatnonzero((d <= threshold).any(axis=0))
                    if not len(hit):
                        continue
                    new, pick = np.unique(owner[hit], return_index=True)
                    for c in hit[pick]:
                        i_found.append(part[int(np.argmin(d[:, c]))])
                        j_found.append(left[c])
                    waiting[new] = False
                    todo.extend(new.tolist())
                    keep = waiting[owner]
                    left, owner, y = left[keep], owner[keep], [v[keep] for v in y]
                    if not len(left):
                        break
        if i_found:
            yield np.array(i_found), np.array(j_found)


def key_rounds(threshold: int, digits: int, agree: int | None = None) -> tuple[list[tuple[int, Segments]], list[tuple[int, Segments]]]:
    """The numbered keys of ``near``: those of disjoint segments, and the others."""
    agree = agree or (2 if threshold + 2 <= digits else 1)
    parts = segments(digits, threshold + agree)
    keys = list(enumerate(combinations(parts, agree)))
    apart = {tuple(parts[i : i + agree]) for i in range(0, len(parts) - agree + 1, agree)}
    return [k for k in keys if k[1] in apart], [k for k in keys if k[1] not in apart]


def linked(hashes: DataFrame, threshold: int, digits: int, keys: Sequence[tuple[int, Segments]]) -> DataFrame:
    """Links ``a, b`` of ``hashes`` (columns ``hash, root``) that connect the roots that all near pairs under the keys connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in _groups(batches):
            if table.num_rows == len(at):
                continue
            names = table.column("root").combine_chunks()
            root = names.dictionary_encode().indices.to_numpy()
            for i, j in forest(table, at, threshold, root):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(v)) for v in (i, j)], ["a", "b"])

    return index(hashes, keys, digits).mapInArrow(run, "a string, b string")

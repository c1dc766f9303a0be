"""Exact top-k inner products: norm-sorted vectors, SVD-rotated partial sums and Cauchy-Schwarz bounds.

Components become integers (floor(scale * x)), so scores are exact. All vectors are rotated by the right singular vectors of the
candidate matrix (from its Gram matrix, summed by task), which moves most of the length into the leading coordinates.
Candidates are cut into blocks by descending length, and a task holds one block at a time while queries stream past it: chunk
by chunk, a candidate survives for a query only while partial sum + |query's rest| * |candidate's rest| reaches the query's k-th best
score so far; survivors get the exact integer product. The first thresholds come from a bounded head of the longest candidates. Blocks are
taken in rounds, the longest first; each round raises the thresholds, and a query goes only to blocks that its length lets reach its own.

A candidate is shuffled once, into its block; only queries, a stated set, are copied, once for each block that they can reach. Blocks
have a bounded number of rows: equal lengths (copies) go round the blocks of their cut, so no block grows with a group of copies. What reaches the
driver: one Gram matrix (dimension squared), the length cuts, and head rows, all bounded by parameters.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, neither as query nor as candidate; empty
vectors' products are all 0; vectors of more than one dimension raise an error, unless ``mixed``, which counts missing components
as 0; null ids are no query and no candidate; a candidate with
the query's own id is left out, however often the id is repeated; repeated rows are candidates each, a repeated query is asked once (by its
least vector);
ties go to the smaller id; fewer than k candidates give fewer rows; an empty table gives an empty table. Other columns are not
carried. Products are exact while |score| < 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.llm._frames import checkpointed, read

#: Rows of a block: a 64th of the candidates within these bounds.
BLOCK = (2_048, 16_384)
#: Queries that a block answers together.
QUERIES_AT_ONCE = 2_048
#: Blocks of the first round, which is a 64th of all blocks if that is more; later rounds have four times as many as all before.
FIRST_ROUND = 64
HEAD = 1_024
CHUNK = 1_024
MAX_CUTS = 4_096


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``id, v, dim, norm`` of the rows that take part; ``v`` holds integers as doubles."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(finite).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    return rows.withColumns({"dim": F.size("v"), "norm": F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))})


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def gram(vectors: DataFrame, dim: int) -> np.ndarray:
    """The sum of outer products, one matrix a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = vectors.select("v").mapInArrow(run, "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros((dim, dim))
    out[sums["i"], sums["j"]] = sums["x"]
    return out


def rotation(matrix: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Right singular vectors by falling singular value, and the coordinate counts at which partial sums are tested."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values)
    share = np.cumsum(np.maximum(values[order], 0)) / max(values.clip(0).sum(), 1e-300)
    stops = sorted({int(np.searchsorted(share, s)) + 1 for s in (0.5, 0.8, 0.95)} & set(range(1, len(values))))
    return vectors[:, order], stops


def _products(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """Inner products of the pairs, in bounded memory."""
    out = np.empty(len(rows))
    for a in range(0, len(rows), at_once):
        out[a : a + at_once] = np.einsum("ij,ij->i", q[rows[a : a + at_once]], c[cols[a : a + at_once]])
    return out


class Candidates:
    """Vectors by falling length, rotated, with the lengths of what follows each stop."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray, stops: list[int]):
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        self.turn, self.stops, self.bounds = turn, stops, [0, *stops]
        self.ids, self.vectors, self.lengths = ids[order], vectors[order], lengths[order]
        self.rotated, self.rest = self._rotated(self.vectors, self.lengths)

    def _rotated(self, v: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = v @ self.turn
        return r, np.sqrt(np.maximum(0, lengths[:, None] ** 2 - np.stack([(r[:, :s] ** 2).sum(axis=1) for s in self.bounds], 1)))

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row numbers of queries, ids and scores of the best k of each query, at ``floor`` or above."""
        c, c_ids, lengths, cr, c_rest, bounds, stops = self.vectors, self.ids, self.lengths, self.rotated, self.rest, self.bounds, self.stops
        q_len = np.sqrt((q * q).sum(axis=1))
        qr, q_rest = self._rotated(q, q_len)
        best = np.full((len(q), k), -np.inf)
        best_id = np.full((len(q), k), np.iinfo(np.int64).max)
        for a in range(0, len(c), CHUNK):
            part = slice(a, min(len(c), a + CHUNK))
            need = np.maximum(floor, best[:, -1])
            slack = 1e-9 * q_len * lengths[a] + 1e-6  # rounding of the rotated coordinates never drops a tie
            alive = np.flatnonzero(q_len * lengths[a] + slack >= need)
            if not len(alive):
                # candidates get shorter: nothing after this can reach any threshold
                break
            # the first partial sums of all pairs at once, the further ones for survivors only
            lead = bounds[1] if stops else 0
            sums = qr[alive, :lead] @ cr[part, :lead].T
            rows, cols = np.nonzero(sums + q_rest[alive, min(1, len(stops)), None] * c_rest[None, part, min(1, len(stops))] + slack[alive, None] >= need[alive, None])
            partial, rows = sums[rows, cols], alive[rows]
            for s, (x, y) in enumerate(zip(bounds[1:], bounds[2:]), 2):
                partial = partial + _products(qr[:, x:y], cr[:, x:y], rows, a + cols)
                keep = partial + q_rest[rows, s] * c_rest[a + cols, s] + slack[rows] >= need[rows]
                rows, cols, partial = rows[keep], cols[keep], partial[keep]
            score = _products(q, c, rows, a + cols)  # integers: exact
            ids = c_ids[a + cols]
            keep = (score >= need[rows]) & (ids != q_ids[rows])
            best, best_id = _merged(best, best_id, rows[keep], ids[keep], score[keep], k)
        found = best > -np.inf
        return np.nonzero(found)[0], best_id[found], best[found]


def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, turn: np.ndarray, stops: list[int], k: int, floor: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row numbers of queries, ids and scores of the best k of each query among these candidates, at ``floor`` or above."""
    return Candidates(c_ids, c, turn, stops).search(q_ids, q, k, floor)


def _merged(best: np.ndarray, best_id: np.ndarray, rows: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of what stands and what is new, by falling score, then id."""
    touched, place = np.unique(rows, return_inverse=True)
    row = np.concatenate([np.repeat(np.arange(len(touched)), k), place])
    s = np.concatenate([best[touched].ravel(), score])
    i = np.concatenate([best_id[touched].ravel(), ids])
    order = np.lexsort((i, -s, row))
    row, s, i = row[order], s[order], i[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    top = rank < k
    best, best_id = best.copy(), best_id.copy()
    best[touched[row[top]], rank[top]] = s[top]
    best_id[touched[row[top]], rank[top]] = i[top]
    return best, best_id


class Layout:
    """Blocks by falling length: ``cuts`` (rising lengths) part the lengths, and a cut with many rows has several blocks."""

    def __init__(self, cuts: list[float], sizes: dict[int, tuple[int, float]], rows: int):
        self.cuts = np.array(cuts)
        falling = sorted(sizes, reverse=True)
        parts = {c: -(-sizes[c][0] // rows) for c in falling}
        self.parts, self.first = np.ones(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64)
        ends = np.cumsum([parts[c] for c in falling])
        for c, end in zip(falling, ends):
            self.parts[c], self.first[c] = parts[c], end - parts[c]
        #: By cut, the longest first: its greatest length, and the number of blocks up to its end.
        self.longest, self.ends = np.array([sizes[c][1] for c in falling]), ends
        self.blocks = int(ends[-1])

    def cut(self, lengths: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, lengths, side="left")

    def block(self, lengths: np.ndarray, mark: np.ndarray) -> np.ndarray:
        cut = self.cut(lengths)
        return self.first[cut] + mark % self.parts[cut]

    def reach(self, length: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How many blocks, from the first one, a query's length lets reach its threshold."""
        open_ = length[:, None] * self.longest * (1 + 1e-9) + 1e-6 >= least[:, None]
        return np.append(0, self.ends)[open_.sum(axis=1)]

    def rounds(self) -> list[tuple[int, int]]:
        edges = [0, min(self.blocks, max(FIRST_ROUND, self.blocks // 64))]
        while edges[-1] < self.blocks:
            edges.append(min(self.blocks, edges[-1] * 5))
        return list(zip(edges, edges[1:]))


def layout_of(vectors: DataFrame, total: int) -> Layout:
    """From quantiles of the lengths and the rows between them."""
    rows = min(BLOCK[1], max(BLOCK[0], -(-total // 64)))
    wanted = min(MAX_CUTS, -(-total // rows))
    cuts = sorted(set(vectors.agg(F.percentile_approx("norm", F.lit([i / wanted for i in range(1, wanted)]) if wanted > 1 else F.lit([1.0]), 10_000)).first()[0]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, longest = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1)
        for batch in batches:
            lengths = batch.column("norm").to_numpy()
            at = np.searchsorted(cuts, lengths, side="left")
            n += np.bincount(at, minlength=len(n))
            np.maximum.at(longest, at, lengths)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(longest[some])], ["cut", "n", "longest"])

    sizes = vectors.select("norm").mapInArrow(count, "cut long, n long, longest double").groupBy("cut").agg(F.sum("n"), F.max("longest")).collect()
    return Layout(cuts, {r[0]: (r[1], r[2]) for r in sizes}, rows)  # MAX_CUTS + 1 rows at most


_DEALT = "block long, asks boolean, id long, v array<double>, least double"


def held(vectors: DataFrame, layout: Layout) -> DataFrame:
    """Every candidate once, in its block; a cut's rows go round its blocks by their place in the (checkpointed) input."""
    shared = vectors.sparkSession.sparkContext.broadcast(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mark = TaskContext.get().partitionId() * 7919
        for batch in batches:
            n = batch.num_rows
            block = shared.value.block(batch.column("norm").to_numpy(), np.arange(mark, mark + n))
            mark += n
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.zeros(n, bool)), batch.column("id"), batch.column("v"), pa.nulls(n, pa.float64())], ["block", "asks", "id", "v", "least"])

    return vectors.select("id", "v", "norm").mapInArrow(run, _DEALT)


def sent(asked: DataFrame, layout: Layout, begin: int, end: int) -> DataFrame:
    """A copy of each query for each of the blocks from ``begin`` to ``end`` that it can reach."""
    shared = asked.sparkSession.sparkContext.broadcast(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                reach = np.minimum(shared.value.reach(part.column("length").to_numpy(), part.column("least").to_numpy()), end)
                for block in range(begin, int(reach.max(initial=0))):
                    rows = part.filter(pa.array(reach > block))
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.ones(n, bool)), rows.column("id"), rows.column("v"), rows.column("least")], ["block", "asks", "id", "v", "least"])

    return asked.select("id", "v", "least", "length").mapInArrow(run, _DEALT)


def top_inner_products(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, mixed: bool = False) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other rows for every row where ``is_query`` (a column over ``id``)."""
    spark = df.sparkSession
    vectors = checkpointed(integer_vectors(df, id_col, vector_col, scale))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    total, least_dim, most_dim, empties = vectors.agg(F.count("*"), F.min(F.when(F.col("dim") > 0, F.col("dim"))), F.max("dim"), F.count_if(F.col("dim") == 0)).first()
    if not total:
        return empty
    if not mixed and most_dim and least_dim != most_dim:
        raise ValueError("vectors of more than one dimension")
    dim = most_dim or 1
    queries = vectors.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    if empties or least_dim != most_dim:
        filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))
        vectors, queries = vectors.withColumn("v", filled), queries.withColumn("v", filled)
    turn, stops = rotation(gram(vectors, dim))
    shared = spark.sparkContext.broadcast((turn, stops))
    layout = layout_of(vectors, total)

    # first thresholds: every query against a bounded head of the longest candidates
    head = vectors.orderBy(F.desc("norm"), "id").limit(HEAD).select("id", "v").toArrow()
    heads = spark.sparkContext.broadcast((head.column("id").to_numpy(), _matrix(head.column("v").combine_chunks(), dim)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = Candidates(*heads.value, *shared.value)
        for batch in batches:
            q = _matrix(batch.column("v"), dim)
            rows, _, score = longest.search(batch.column("id").to_numpy(), q, k, np.full(len(q), -np.inf))
            least = np.full(len(q), -np.inf)
            full = np.bincount(rows, minlength=len(q)) == k
            np.minimum.at(low := np.full(len(q), np.inf), rows, score)
            least[full] = low[full]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(least), pa.array(np.sqrt((q * q).sum(axis=1)))], ["id", "v", "least", "length"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by block, candidates before queries: one block's candidates are held while its queries pass."""
        block, parts, known = None, [], None
        for batch in batches:
            blocks, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(blocks) != 0) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(blocks)]):
                if b == a:
                    continue
                if blocks[a] != block:
                    block, parts, known = blocks[a], [], None
                ids, v = batch.column("id").to_numpy()[a:b], _matrix(batch.column("v").slice(a, b - a), dim)
                if not asks[a]:
                    parts.append((ids, v))
                    continue
                if known is None and not parts:
                    continue  # a block that no candidate fell into
                if known is None:
                    known, parts = Candidates(*(np.concatenate(x) for x in zip(*parts)), *shared.value), []
                least = batch.column("least").slice(a, b - a).to_numpy()
                for i in range(0, b - a, QUERIES_AT_ONCE):
                    some = slice(i, i + QUERIES_AT_ONCE)
                    rows, found, score = known.search(ids[some], v[some], k, least[some])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some][rows]), pa.array(found), pa.array(score.astype(np.int64))], ["query_id", "vec_id", "score"])

    asked = checkpointed(queries.mapInArrow(first, "id long, v array<double>, least double, length double"))
    rounds = layout.rounds()
    candidates = checkpointed(held(vectors, layout))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = None
    for i, (begin, end) in enumerate(rounds):
        both = candidates.where(F.col("block").between(begin, end - 1)).union(sent(asked, layout, begin, end))
        found = both.repartition("block").sortWithinPartitions("block", "asks").mapInArrow(meet, "query_id long, vec_id long, score long")
        best = found if best is None else best.drop("rank").union(found)
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if i + 1 < len(rounds):
            best = checkpointed(best)
            raised = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("_score"))
            asked = checkpointed(asked.join(raised, "id", "left").withColumn("least", F.greatest("least", "_score")).drop("_score"))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_top_inner_products(spark, sf_dir: str) -> DataFrame:
    return top_inner_products(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, mixed=True)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, min(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (
  SELECT query_id, v.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM q JOIN v ON v.vec_id <> q.query_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5
"""

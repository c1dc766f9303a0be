"""Fits over counts of distinct logits: temperature, affine scaling, a development bundle, a bootstrap and a stacker.

Rows are counted by (logit, target) once; every step of a fit is one small aggregate, so the driver holds a few numbers.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.numeric import quadratic_features, sigmoid
from curatrix.functions.session import checkpointed
from curatrix.operators.metrics import binary_metrics, log_loss, ranking_metrics, rates, score_table, threshold_for_sensitivity, threshold_for_specificity
from curatrix.operators.windows import global_row_number


def _counted(df: DataFrame, logit: str, target: str) -> DataFrame:
    return checkpointed(df.groupBy(F.col(logit).cast("double").alias("z"), F.col(target).cast("int").alias("y")).agg(F.count("*").alias("n")))


def _require_both(counted: DataFrame) -> tuple[int, int]:
    got = {r["y"]: r["n"] for r in counted.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    if set(got) != {0, 1}:
        raise ValueError("a fit needs both targets")
    return got[0], got[1]


def _losses(counted: DataFrame, probabilities: list[Column]) -> list[float]:
    row = counted.agg(*((F.sum(log_loss(p, F.col("y")) * F.col("n")) / F.sum("n")).alias(f"l{i}") for i, p in enumerate(probabilities))).first()
    return list(row)


def fit_temperature(df: DataFrame, logit: str = "logit", target: str = "target", low: float = 0.05, high: float = 20.0, grid: int = 33, tolerance: float = 1e-8) -> float:
    """The temperature of least log loss: a grid over its logarithm, narrowed around the best point (the loss is unimodal there)."""
    counted = _counted(df, logit, target)
    _require_both(counted)
    a, b = math.log(low), math.log(high)
    while b - a > tolerance:
        points = np.linspace(a, b, grid)
        losses = _losses(counted, [sigmoid(F.col("z") / float(math.exp(t))) for t in points])
        k = int(np.argmin(losses))
        a, b = points[max(0, k - 1)], points[min(grid - 1, k + 1)]
    return float(math.exp((a + b) / 2))


def fit_affine(df: DataFrame, logit: str = "logit", target: str = "target", scales: tuple[float, float] = (0.05, 20.0), bias: float = 20.0, steps: int = 60) -> tuple[float, float]:
    """(scale, bias) of least log loss: damped Newton steps on the convex loss, kept in bounds."""
    counted = _counted(df, logit, target)
    neg, pos = _require_both(counted)
    median = counted.agg(F.expr("percentile(z, 0.5, n)")).first()[0]
    x = np.array([1.0, float(np.clip(math.log(pos / neg) - median, -bias, bias))])
    lower, upper = np.array([scales[0], -bias]), np.array([scales[1], bias])
    z, n, y = F.col("z"), F.col("n"), F.col("y")

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        p = sigmoid(z * float(x[0]) + float(x[1]))
        r, w = (p - y) * n, p * (1 - p) * n
        row = counted.agg(F.sum(log_loss(p, y) * n), F.sum(r * z), F.sum(r), F.sum(w * z * z), F.sum(w * z), F.sum(w), F.sum(n)).first()
        return row[0] / row[6], np.array(row[1:3]) / row[6], np.array([[row[3], row[4]], [row[4], row[5]]]) / row[6]

    loss, gradient, hessian = at(x)
    for _ in range(steps):
        free = ~(((x <= lower) & (gradient > 0)) | ((x >= upper) & (gradient < 0)))
        if not free.any() or np.abs(gradient[free]).max() < 1e-10:
            break
        step = np.zeros(2)
        step[free] = np.linalg.solve(hessian[np.ix_(free, free)] + 1e-12 * np.eye(free.sum()), gradient[free])
        size = 1.0
        while size > 1e-8:
            new = np.clip(x - size * step, lower, upper)
            got = at(new)
            if got[0] < loss:
                break
            size /= 2
        else:
            break
        done = loss - got[0] < 1e-14
        x, (loss, gradient, hessian) = new, got
        if done:
            break
    return float(x[0]), float(x[1])


def development_calibration(df: DataFrame, *, logit: str = "logit", target: str = "target", sensitivity: float, specificity: float, bins: int = 10) -> dict:
    """Affine scaling, a threshold for sensitivity and one for specificity (low and high, in strict order), and metrics before and after."""
    scale, bias = fit_affine(df, logit, target)
    scored = df.withColumn("_p", sigmoid(F.col(logit) * scale + bias)).withColumn("_raw", sigmoid(F.col(logit)))
    t1 = threshold_for_sensitivity(scored, sensitivity, target=target, score="_p").first()["threshold"]
    t2 = threshold_for_specificity(scored, specificity, target=target, score="_p").first()["threshold"]
    low, high = min(t1, t2), max(t1, t2)
    if not low < high:
        raise ValueError("the two thresholds coincide")
    after = binary_metrics(scored, target=target, score="_p", threshold=high, bins=bins).first().asDict()
    before = binary_metrics(scored, target=target, score="_raw", threshold=0.5, bins=bins).first().asDict()
    return {"method": "affine_logistic_scaling", "logit_scale": scale, "logit_bias": bias, "low_threshold": low, "high_threshold": high, "before": before, "after": after}


#: Draws (samples times groups) that NumPy's generator makes on the driver at most.
MAX_DRIVER_DRAWS = 50_000_000
#: Groups of a block, draws of a portion and digests held at once when draws are made by hash; copies of the rows that replicates are dealt over.
GROUP_BLOCK, DRAWN, DIGESTS, DEALS = 1 << 16, 1 << 22, 1 << 16, 2
BOOTSTRAP_METRICS = ("roc_auc", "pr_auc", "sensitivity", "specificity", "precision")


def _bootstrap_groups(df: DataFrame, group: str, target: str) -> DataFrame:
    return df.groupBy(F.col(group).cast("string").alias("_g")).agg(F.max(target).alias("_y"))


def bootstrap_draws(df: DataFrame, samples: int, seed: int, group: str, target: str, draws: str = "numpy") -> DataFrame:
    """Of each stratum (groups with and without positives) as many groups as it has, with replacement.

    ``draws`` names who decides, whatever the table's size. 'hash': the j-th draw of a replicate takes the stratum's group of number
    SHA-256('seed:replicate:stratum:j') modulo the stratum's size; ``_y, _block, replicate, times``, the times packed by blocks of
    ``GROUP_BLOCK`` groups in order, made on the executors in portions of ``DRAWN`` draws. 'numpy': NumPy's default generator, replicate by
    replicate, positives first, as ``group, replicate, times``; sequential on the driver, so more than ``MAX_DRIVER_DRAWS`` draws are an error.
    """
    groups = _bootstrap_groups(df, group, target)
    n, *strata = groups.agg(F.count("*"), F.count_if(F.col("_y") == 1), F.count_if(F.col("_y") == 0)).first()
    if not all(strata):
        raise ValueError("a bootstrap needs groups with and without positives")
    if draws == "hash":
        spark = df.sparkSession
        portions = [(y, size, a, min(size, a + DRAWN)) for y, size in zip((1, 0), strata) for a in range(0, size, DRAWN)]
        asked = spark.range(samples, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).select(F.col("id").cast("int").alias("replicate"))
        asked = asked.crossJoin(F.broadcast(spark.createDataFrame(portions, "_y int, size long, begin long, end long")))  # a few rows
        sizes = GROUP_BLOCK, DIGESTS
        return asked.mapInArrow(lambda batches: hash_draws(batches, seed, *sizes), "_y int, _block long, replicate int, times binary")
    if n * samples > MAX_DRIVER_DRAWS:
        raise ValueError(f"{n * samples} draws: beyond {MAX_DRIVER_DRAWS} take draws='hash'")
    rows = groups.orderBy("_g").collect()
    strata = [np.array([r["_g"] for r in rows if r["_y"] == y]) for y in (1, 0)]
    draw = np.random.default_rng(seed)
    parts = []
    for i in range(samples):
        for stratum in strata:
            names, times = np.unique(draw.choice(stratum, size=len(stratum), replace=True), return_counts=True)
            parts.append(pa.table({"_g": pa.array(names.astype(str)), "replicate": pa.array(np.full(len(names), i, np.int32)), "times": pa.array(times.astype(np.int32))}))
    return df.sparkSession.createDataFrame(pa.concat_tables(parts))


def hash_draws(batches: Iterator[pa.RecordBatch], seed: int, size_of_block: int, digests: int) -> Iterator[pa.RecordBatch]:
    """Of rows ``_y, size, replicate, begin, end``: how often draws begin to end take each group, packed by blocks of groups."""
    for batch in batches:
        for y, size, replicate, begin, end in zip(*(batch.column(c).to_pylist() for c in ("_y", "size", "replicate", "begin", "end"))):
            head, digest = f"{seed}:{replicate}:{y}:".encode(), hashlib.sha256
            got = np.empty(end - begin, np.int64)
            for a in range(begin, end, digests):
                z = min(end, a + digests)
                heads = b"".join([digest(b"%b%d" % (head, j)).digest()[:8] for j in range(a, z)])
                got[a - begin : z - begin] = (np.frombuffer(heads, ">u8") >> np.uint64(4)).astype(np.int64) % size  # 60 bits
            block, place = np.divmod(got, size_of_block)
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
            packed = []
            for at, to in zip(cuts, np.append(cuts[1:], len(order))):
                times = np.bincount(place[order[at:to]])
                kind = np.min_scalar_type(int(times.max()))
                packed.append(zlib.compress(times.astype(kind).tobytes(), 1) + bytes([kind.itemsize]))
            n = len(cuts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, y, np.int32)), pa.array(block[order[cuts]]), pa.array(np.full(n, replicate, np.int32)), pa.array(packed, pa.binary())], ["_y", "_block", "replicate", "times"])


def weigh_blocks(batches: Iterator[pa.RecordBatch], size_of_block: int) -> Iterator[pa.RecordBatch]:
    """``replicate, score, n, pos, neg`` of each block of groups: its rows (``times`` null) come first, then the draws of its replicates."""
    block = None
    rows: list[pa.RecordBatch] = []
    ready = None
    for batch in batches:
        at = [batch.column(c).to_numpy() for c in ("_y", "_block", "_deal")]
        new = np.flatnonzero(np.any([np.diff(x, prepend=x[:1]) != 0 for x in at], axis=0))
        for a, z in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
            if a == z:
                continue
            name = tuple(int(x[a]) for x in at)
            if name != block:
                block, rows, ready = name, [], None
            part = batch.slice(a, z - a)
            drawn = pc.is_valid(part.column("times"))
            own = part.filter(pc.invert(drawn))
            if own.num_rows:
                rows.append(own)
            part = part.filter(drawn)
            if not part.num_rows or not rows:
                continue
            if ready is None:
                table = pa.Table.from_batches(rows)
                words = table.column("_p").combine_chunks().dictionary_encode()
                scores = pa.concat_arrays([words.dictionary, pa.nulls(1, words.dictionary.type)])
                where = pc.fill_null(words.indices, len(scores) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
                ready = scores, table.column("_place").to_numpy(), 3 * where + table.column("_t").to_numpy(), table.column("_n").to_numpy()
                rows = rows[:1]  # a mark that there are some
            scores, place, cell, n = ready
            for replicate, packed in zip(part.column("replicate").to_pylist(), part.column("times").to_pylist()):
                times = np.zeros(size_of_block, np.int64)
                got = np.frombuffer(zlib.decompress(packed[:-1]), f"u{packed[-1]}")
                times[: len(got)] = got
                sums = np.bincount(cell, weights=times[place] * n, minlength=3 * len(scores)).astype(np.int64).reshape(-1, 3)
                some = np.flatnonzero(sums.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), replicate, np.int32)), scores.take(pa.array(some)), pa.array(sums[some].sum(axis=1)), pa.array(sums[some, 1]), pa.array(sums[some, 0])], ["replicate", "score", "n", "pos", "neg"])


def drawn_scores(df: DataFrame, drawn: DataFrame, group: str, target: str, score: str) -> DataFrame:
    """``replicate, score, n, pos, neg``: score tables of the hash draws.

    Neither draws nor weighted rows are written: what is shuffled is a byte or less a replicate and group, ``DEALS`` copies of the counted rows,
    and sums by replicate and score of each block of groups.
    """
    groups = _bootstrap_groups(df, group, target)
    numbered = None
    for y in (1, 0):
        part = global_row_number(groups.where(F.col("_y") == y).select("_g"), "_g", "_j").withColumn("_y", F.lit(y))
        numbered = part if numbered is None else numbered.union(part)
    kind = F.when(F.col(target) == 1, 1).when(F.col(target) == 0, 0).otherwise(2)
    slim = df.groupBy(F.col(group).cast("string").alias("_g"), F.col(score).cast("double").alias("_p"), kind.alias("_t")).agg(F.count("*").alias("_n"))
    rows = slim.join(numbered, "_g").withColumn("_deal", F.explode(F.array(*map(F.lit, range(DEALS)))))
    place = (F.col("_j") % GROUP_BLOCK).cast("int").alias("_place")
    null = lambda kind: F.lit(None).cast(kind)
    rows = rows.select("_y", F.expr(f"_j div {GROUP_BLOCK}").alias("_block"), "_deal", null("int").alias("replicate"), null("binary").alias("times"), place, "_p", "_t", "_n")
    deal = (F.col("replicate") % DEALS).cast("int").alias("_deal")
    both = rows.union(drawn.select("_y", "_block", deal, "replicate", "times", null("int"), null("double"), null("int"), null("long")))
    dealt = both.repartition("_y", "_block", "_deal").sortWithinPartitions("_y", "_block", "_deal", F.col("replicate").asc_nulls_first())
    size = GROUP_BLOCK
    sums = dealt.mapInArrow(lambda batches: weigh_blocks(batches, size), "replicate int, score double, n long, pos long, neg long")
    return sums.groupBy("replicate", "score").agg(*(F.sum(c).alias(c) for c in ("n", "pos", "neg")))


def bootstrap_intervals(df: DataFrame, *, threshold: float, samples: int = 2000, confidence: float = 0.95, seed: int = 2026, group: str = "group_id", target: str = "target", score: str = "p", draws: str = "numpy") -> DataFrame:
    """``metric, low, high``: quantiles over replicates of metrics that weigh each group's rows by its draws."""
    if samples < 100:
        raise ValueError("at least 100 samples")
    drawn = bootstrap_draws(df, samples, seed, group, target, draws)
    if draws == "hash":
        return _intervals(checkpointed(drawn_scores(df, drawn, group, target, score)), threshold, confidence)
    slim = df.groupBy(F.col(group).cast("string").alias("_g"), F.col(score).alias("_p"), F.col(target).alias("_y")).agg(F.count("*").alias("_n"))
    weighted = slim.join(drawn, "_g").withColumn("_w", F.col("_n") * F.col("times"))
    return _intervals(checkpointed(score_table(weighted, "_y", "_p", ["replicate"], "_w")), threshold, confidence)


def _intervals(table: DataFrame, threshold: float, confidence: float) -> DataFrame:
    """``metric, low, high`` of the replicates' score tables."""
    ranks = ranking_metrics(table, ["replicate"])
    part = lambda c, test: F.sum(F.when(test, F.col(c)).otherwise(0)).cast("long")
    hit = F.col("score") >= threshold
    cells = table.groupBy("replicate").agg(part("pos", hit).alias("tp"), part("neg", hit).alias("fp"), part("pos", ~hit).alias("fn"), part("neg", ~hit).alias("tn"))
    metrics = ranks.join(cells, "replicate").withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))
    tail = (1 - confidence) / 2
    long = metrics.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in BOOTSTRAP_METRICS))))
    return long.groupBy("metric").agg(F.percentile("value", F.lit(tail)).alias("low"), F.percentile("value", F.lit(1 - tail)).alias("high"))


def fit_stacker(df: DataFrame, members: Sequence[str], *, fold: str = "fold", target: str = "target", strengths: Sequence[float] = (0.01, 0.1, 1.0, 10.0), kinds: Sequence[str] = ("linear", "quadratic")) -> DataFrame:
    """``kind, strength, pr_auc, roc_auc, place`` of L2 logistic regressions over standardised logits, by out-of-fold ranking.

    ``df`` has a logit column for each member and a fold of its group. Folds and settings are few; each fit is distributed.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import Window as W

    stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in members for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    scaled = [(F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"] for c in members]
    rows = df.select(F.col(fold).alias("_fold"), F.col(target).cast("double").alias("label"), F.monotonically_increasing_id().alias("_row"), *(z.alias(f"x{i}") for i, z in enumerate(scaled)))
    base = [F.col(f"x{i}") for i in range(len(members))]
    scored = None
    folds = sorted(r[0] for r in rows.select("_fold").distinct().collect())
    for kind in kinds:
        features = quadratic_features(base) if kind == "quadratic" else base
        wide = rows.select("_fold", "label", *(x.alias(f"f{i}") for i, x in enumerate(features)))
        ready = checkpointed(VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features").transform(wide).select("_fold", "label", "features"))
        for strength in strengths:
            for f in folds:
                train = ready.where(F.col("_fold") != f)
                model = LogisticRegression(regParam=1.0 / (strength * max(1, train.count())), elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-9).fit(train)
                held = model.transform(ready.where(F.col("_fold") == f)).select(F.lit(f"{kind}:{strength}").alias("setting"), "label", vector_to_array("probability")[1].alias("p"))
                scored = held if scored is None else scored.union(held)
    table = checkpointed(score_table(scored, "label", "p", ["setting"]))
    metrics = ranking_metrics(table, ["setting"])
    split = metrics.select(F.split_part("setting", F.lit(":"), F.lit(1)).alias("kind"), F.split_part("setting", F.lit(":"), F.lit(2)).cast("double").alias("strength"), "pr_auc", "roc_auc")
    return split.withColumn("place", F.row_number().over(W.orderBy(F.desc("pr_auc"), F.desc("roc_auc"), F.asc("strength"), F.asc("kind"))))

"""Evaluation: hold-outs, recall, error rates, thresholds and fold accuracy."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galena.functions.vectors import dot
from galena.operators.quantizer import vectors_of
from galena.operators.search import QUERY_BLOCK, products, query_blocks

#: Fixed values of the published evaluations.
FAR_THRESHOLDS = tuple(round(0.20 + 0.05 * i, 2) for i in range(11))
EER_STEPS, FOLD_STEPS, FOLDS = 2001, 400, 10
#: Rows that meet a block of rows at once; with 4,096 of these that makes a million pairs.
PAIR_ROWS = 256
#: Rows of a block whose pairs are counted in one task, and cells that are counted by place.
COUNT_BLOCK, COUNT_CELLS = 8_192, 1 << 22


def holdout(gallery: DataFrame, many: int = 4, many_out: int = 3, few_out: int = 1, cap: int | None = None) -> DataFrame:
    """Rows held out as queries: the last three of labels with four rows or more, the last
    one of labels with two or three. ``cap``: the first so many, in order of the labels' first
    rows. Without a cap nothing is sorted globally."""
    own = Window.partitionBy("label")
    sized = gallery.select("id", "label").withColumn("n", F.count(F.lit(1)).over(own)).withColumn("from_end", F.row_number().over(own.orderBy(F.desc("id")))).withColumn("first_id", F.min("id").over(own))
    taken = sized.where((F.col("n") >= 2) & (F.col("from_end") <= F.when(F.col("n") >= many, many_out).otherwise(few_out)))
    if cap is not None:
        taken = taken.orderBy("first_id", "id").limit(cap)
    return taken.select("id", "label")


def last_of_each(gallery: DataFrame, cap: int | None = 500) -> DataFrame:
    """The last row of each label with two rows or more, the first ``cap`` by label."""
    last = gallery.groupBy("label").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n >= 2").select("id", "label")
    return last if cap is None else last.orderBy("label").limit(cap)


def database(gallery: DataFrame, held_out: DataFrame) -> DataFrame:
    return gallery.join(held_out.select("id"), "id", "left_anti")


def first_and_last(gallery: DataFrame) -> DataFrame:
    """``label, gallery_id, probe_id`` of labels with two rows or more."""
    return gallery.groupBy("label").agg(F.min("id").alias("gallery_id"), F.max("id").alias("probe_id")).where("gallery_id < probe_id")


def rank1(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """``n_probes, n_correct, rank1``: hits of rank 1 against ``query_id, true_label``."""
    joined = truth.join(hits.where("rank = 1").select("query_id", "label"), "query_id", "left")
    good = F.coalesce((F.col("label") == F.col("true_label")).cast("long"), F.lit(0))
    return joined.agg(F.count(F.lit(1)).alias("n_probes"), F.coalesce(F.sum(good), F.lit(0)).alias("n_correct"), F.avg(good.cast("double")).alias("rank1"))


def recall_at_k(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``n_queries, recall``: true neighbours (``query_id, id``) among the first ``k`` hits."""
    found = hits.where(F.col("rank") <= k).select("query_id", "id").withColumn("hit", F.lit(1.0))
    return truth.select("query_id", "id").join(found, ["query_id", "id"], "left").agg(F.count(F.lit(1)).alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def tie_aware_recall(hits: DataFrame, truth: DataFrame, k: int, tolerance: float = 1e-5) -> DataFrame:
    """As ``recall_at_k``; a hit as similar as the true one (``similarity``) counts too."""
    best = truth.select("query_id", F.col("id").alias("true_id"), F.col("similarity").alias("best"))
    good = (F.col("id") == F.col("true_id")) | (F.col("similarity") >= F.col("best") - tolerance)
    per_query = best.join(hits.where(F.col("rank") <= k), "query_id", "left").groupBy("query_id").agg(F.max(F.coalesce(good.cast("double"), F.lit(0.0))).alias("hit"))
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("hit").alias("recall"))


def candidate_sweep(codes_ranked: DataFrame, truth: DataFrame, counts: list[int]) -> DataFrame:
    """``n_candidates, recall`` for many shortlist lengths from one ranking by codes."""
    at = truth.select("query_id", "id").join(codes_ranked.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    wanted = truth.sparkSession.createDataFrame([(c,) for c in counts], "n_candidates int")
    return at.crossJoin(F.broadcast(wanted)).groupBy("n_candidates").agg(F.avg(F.coalesce((F.col("rank") <= F.col("n_candidates")).cast("double"), F.lit(0.0))).alias("recall"))


def genuine_pairs(gallery: DataFrame, per_identity: int | None = None, seed: int = 0) -> DataFrame:
    """``a, b, label, similarity`` of same-label pairs; at most ``per_identity`` in hash order
    where that is given (as a sampling operator)."""
    a = gallery.select("label", F.col("id").alias("a"), F.col("embedding").alias("va"))
    b = gallery.select("label", F.col("id").alias("b"), F.col("embedding").alias("vb"))
    pairs = a.join(b, "label").where("a < b")
    if per_identity is not None:
        order = Window.partitionBy("label").orderBy(F.xxhash64("a", "b", F.lit(seed)), "a", "b")
        pairs = pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_identity)
    return pairs.select("a", "b", "label", dot("va", "vb").alias("similarity"))


def impostor_pairs(gallery: DataFrame, pairs: int, seed: int = 0) -> DataFrame:
    """``a, b, similarity`` of ``pairs`` sampled pairs of different labels.

    Every row draws hashed partners by position, so the gallery is joined with as many rows
    as pairs are wanted, not with itself.
    """
    rows = gallery.count()
    per_row = -(-pairs * 2 // max(1, rows))
    # A dense position in id order, built from partition offsets rather than one global window.
    by_range = gallery.select("id", "label", "embedding").repartitionByRange("id").sortWithinPartitions("id").withColumn("p", F.spark_partition_id())
    offsets, total = {}, 0
    for part, n in sorted(by_range.groupBy("p").count().collect()):
        offsets[part], total = total, total + n
    starts = gallery.sparkSession.createDataFrame(list(offsets.items()), "p int, first long")
    placed = by_range.join(F.broadcast(starts), "p").withColumn("at", F.col("first") + F.row_number().over(Window.partitionBy("p").orderBy("id")) - 1)
    draws = placed.select("at", F.col("id").alias("a"), F.col("label").alias("la"), F.col("embedding").alias("va"), F.explode(F.sequence(F.lit(1), F.lit(max(1, per_row)))).alias("draw"))
    drawn = draws.withColumn("at", F.pmod(F.xxhash64("a", "draw", F.lit(seed)), F.lit(max(1, rows))))
    partner = placed.select("at", F.col("id").alias("b"), F.col("label").alias("lb"), F.col("embedding").alias("vb"))
    met = drawn.join(partner, "at").where("la <> lb")
    chosen = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), dot("va", "vb").alias("similarity")).dropDuplicates(["a", "b"])
    return chosen.orderBy(F.xxhash64("a", "b", F.lit(seed + 1)), "a", "b").limit(pairs)


def labelled_pairs(gallery: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """``a, b, same, similarity`` of all pairs, for galleries small enough for that.

    Blocks of rows meet every partition in one matrix product; nothing is shuffled.
    """
    asked = gallery.select(F.col("id").alias("query_id"), "label", "embedding")
    out = None
    for table in query_blocks(asked, ["label", "embedding"], block):
        ids, labels = table.column("query_id").to_numpy(), np.array(table.column("label").to_pylist(), object)
        wanted = vectors_of(table.column("embedding")).astype(np.float64)

        def run(batches, ids=ids, labels=labels, wanted=wanted):
            for batch in batches:
                for start in range(0, len(batch), PAIR_ROWS):
                    part = batch.slice(start, PAIR_ROWS)
                    other, names = part.column("id").to_numpy(zero_copy_only=False), np.array(part.column("label").to_pylist(), object)
                    near = wanted @ vectors_of(part.column("embedding")).astype(np.float64).T
                    r, c = np.nonzero(ids[:, None] < other[None])
                    yield pa.RecordBatch.from_pydict({"a": pa.array(ids[r], pa.int64()), "b": pa.array(other[c], pa.int64()), "same": pa.array(labels[r] == names[c], pa.bool_()), "similarity": pa.array(near[r, c], pa.float64())})

        pairs = gallery.select("id", "label", "embedding").mapInArrow(run, "a long, b long, same boolean, similarity double")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def pair_counts(gallery: DataFrame, decimals: int = 4, block: int = COUNT_BLOCK) -> DataFrame:
    """``same, similarity, n``: all pairs of rows, counted by similarity to ``decimals``
    (halves away from zero). A pair with a row of no label is neither kind and left out.

    Two blocks of rows meet in a task, and each row is sent once for every block; only counts
    leave a task, so the pairs themselves are nowhere stored.
    """
    rows = gallery.where("label is not null")
    parts = max(1, -(-rows.count() // block))
    own = rows.select(F.col("id").cast("long").alias("id"), "label", "embedding", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sent = met.select("id", "label", "embedding", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    scale = float(10**decimals)

    def meet(key, table):
        i, j = (k.as_py() for k in key)
        part, ids = table.column("part").to_numpy(), table.column("id").to_numpy()
        labels = np.unique(np.array(table.column("label").to_pylist(), object), return_inverse=True)[1]
        vectors = vectors_of(table.column("embedding")).astype(np.float64)
        a, b = part == i, part == j
        wanted, there, there_ids, there_labels = vectors[a], vectors[b], ids[b], labels[b]
        # No inner product exceeds the product of the largest norms.
        widest = [np.sqrt((v * v).sum(1).max(initial=0.0)) for v in (wanted, there)]
        bound = widest[0] * widest[1] * scale + 2
        placed = bool(bound * 4 < COUNT_CELLS)
        bound = int(bound) if placed else 0
        cells, found = np.zeros(2 * (2 * bound + 1), np.int64), []
        for start in range(0, len(wanted), PAIR_ROWS):
            piece = slice(start, start + PAIR_ROWS)
            near = products(wanted[piece], there)
            near *= scale
            near += np.copysign(0.5, near)
            same = labels[a][piece, None] == there_labels[None]
            if i == j:
                once = ids[a][piece, None] < there_ids[None]
                near, same = near[once], same[once]
            if placed:
                at = near.astype(np.int64)
                at += bound
                at *= 2
                at += same
                cells += np.bincount(at.ravel(), minlength=len(cells))
            else:
                for kind in (False, True):
                    found.append((kind, *np.unique(np.trunc(near[same == kind]), return_counts=True)))
        if placed:
            found = [(bool(kind), np.flatnonzero(cells[kind::2]) - bound, cells[kind::2][cells[kind::2] > 0]) for kind in (0, 1)]
        # Adding zero makes zero of minus zero, which would be a cell of its own.
        yield from (pa.RecordBatch.from_pydict({"same": pa.array([kind] * len(n), pa.bool_()), "similarity": pa.array(value / scale + 0.0, pa.float64()), "n": pa.array(n, pa.int64())}) for kind, value, n in found)

    def counted(key, table):
        return pa.Table.from_batches(list(meet(key, table)), pa.schema([("same", pa.bool_()), ("similarity", pa.float64()), ("n", pa.int64())]))

    return sent.groupBy("i", "j").applyInArrow(counted, "same boolean, similarity double, n long").groupBy("same", "similarity").agg(F.sum("n").alias("n"))


def _times(pairs: DataFrame) -> Column:
    """How many pairs a row stands for."""
    return F.col("n") if "n" in pairs.columns else F.lit(1).cast("long")


def _kinds(pairs: DataFrame) -> list[Column]:
    """Genuine pairs and impostors in a group."""
    return [F.sum(kind.cast("long") * _times(pairs)).alias(name) for kind, name in ((F.col("same"), "genuine"), (~F.col("same"), "impostor"))]


def _thresholds(spark: SparkSession, values) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "step int, threshold double"))


def far_frr(pairs: DataFrame, thresholds=FAR_THRESHOLDS) -> DataFrame:
    """``threshold, far, frr`` of pairs ``same, similarity``, or of counted ones with ``n``.

    False accepts: the share of impostors at or above a threshold; false rejects: the share
    of genuine pairs below it. One pass counts pairs between neighbouring thresholds.
    """
    spark = pairs.sparkSession
    values = sorted(float(t) for t in thresholds)
    edges = F.array(*(F.lit(v) for v in values))
    cell = F.aggregate(edges, F.lit(0), lambda n, t: n + F.when(F.col("similarity") >= t, 1).otherwise(0))
    counted = pairs.groupBy(cell.alias("cell")).agg(*_kinds(pairs))
    table = _thresholds(spark, values)
    per = counted.crossJoin(table)
    above = F.col("cell") > F.col("step")
    far = F.sum(F.when(above, F.col("impostor")).otherwise(0)) / F.sum("impostor")
    frr = F.sum(F.when(~above, F.col("genuine")).otherwise(0)) / F.sum("genuine")
    return per.groupBy("step", "threshold").agg(far.alias("far"), frr.alias("frr")).select("threshold", "far", "frr")


def equal_error_rate(pairs: DataFrame, steps: int = EER_STEPS) -> DataFrame:
    """``eer, threshold``: the first threshold on [0, 1] where both rates are nearest."""
    rates = far_frr_grid(pairs, np.linspace(0, 1, steps))
    return rates.withColumn("gap", F.round(F.abs(F.col("far") - F.col("frr")), 12)).orderBy("gap", "threshold").limit(1).select(((F.col("far") + F.col("frr")) / 2).alias("eer"), "threshold")


def far_frr_grid(pairs: DataFrame, grid: np.ndarray) -> DataFrame:
    """``far_frr`` on an evenly spaced grid: pairs fall into cells by arithmetic, and running
    sums over the few cells give both rates."""
    spark = pairs.sparkSession
    low, step, n = float(grid[0]), float(grid[1] - grid[0]), len(grid)
    guess = F.floor((F.col("similarity") - low) / step).cast("int")
    # The division may round across an edge: compare with the edge itself.
    edges = F.array(*(F.lit(float(g)) for g in grid))
    at = F.least(F.greatest(guess, F.lit(-1)), F.lit(n - 1))
    up = F.when((at + 1 < n) & (F.col("similarity") >= F.get(edges, at + 1)), at + 1).otherwise(F.when((at >= 0) & (F.col("similarity") < F.get(edges, at)), at - 1).otherwise(at))
    cells = pairs.groupBy(up.alias("step")).agg(*_kinds(pairs))
    table = _thresholds(spark, grid).unionByName(spark.createDataFrame([(-1, None)], "step int, threshold double"))
    upward = Window.orderBy(F.desc("step"))
    down = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = table.join(cells, "step", "left").fillna(0, ["genuine", "impostor"])
    rates = full.select("threshold", (F.sum("impostor").over(upward) / F.sum("impostor").over(every)).alias("far"), (F.coalesce(F.sum("genuine").over(down), F.lit(0)) / F.sum("genuine").over(every)).alias("frr"))
    return rates.where("threshold is not null")


def threshold_at_far(pairs: DataFrame, far: float) -> DataFrame:
    """``target_far, threshold, frr, tar``: the linear (1 - far) quantile of impostors."""
    cut = pairs.where("not same").agg(F.percentile("similarity", F.lit(1 - far), _times(pairs)).alias("threshold"))
    below = (F.col("similarity") < F.col("threshold")).cast("long") * _times(pairs)
    return pairs.where("same").crossJoin(F.broadcast(cut)).groupBy("threshold").agg((F.sum(below) / F.sum(_times(pairs))).alias("frr")).select(F.lit(far).alias("target_far"), "threshold", "frr", (1 - F.col("frr")).alias("tar"))


def score_means(pairs: DataFrame) -> DataFrame:
    return pairs.agg(_mean_of(pairs, F.col("same")).alias("mean_genuine"), _mean_of(pairs, ~F.col("same")).alias("mean_impostor"))


def _mean_of(pairs: DataFrame, condition: Column) -> Column:
    n = F.when(condition, _times(pairs))
    return F.sum(F.col("similarity") * n) / F.sum(n)


def fold_accuracy(pairs: DataFrame, order: list[str], folds: int = FOLDS, steps: int = FOLD_STEPS) -> DataFrame:
    """``fold, threshold, accuracy``: contiguous folds in the given order; each takes the
    first threshold on [-1, 1] that is best on the others.

    ``pairs`` is a benchmark's pair list, small by nature. Pairs are first counted by fold and
    cell of the grid, so thresholds meet counts, not pairs.
    """
    grid = np.linspace(-1, 1, steps)
    n = pairs.count()
    big, base = n % folds, n // folds
    at = F.row_number().over(Window.orderBy(*order)) - 1
    fold = F.when(F.col("at") < big * (base + 1), F.floor(F.col("at") / (base + 1))).otherwise(big + F.floor((F.col("at") - big * (base + 1)) / max(1, base))).cast("int")
    edges = F.array(*(F.lit(float(g)) for g in grid))
    cell = F.aggregate(edges, F.lit(0), lambda k, t: k + F.when(F.col("similarity") >= t, 1).otherwise(0))
    counted = pairs.withColumn("at", at).groupBy(fold.alias("fold"), cell.alias("cell")).agg(F.sum(F.col("same").cast("long")).alias("genuine"), F.sum((~F.col("same")).cast("long")).alias("impostor"))
    above = F.col("cell") > F.col("step")
    right = F.sum(F.when(above, F.col("genuine")).otherwise(F.col("impostor")))
    per = counted.crossJoin(_thresholds(pairs.sparkSession, grid)).groupBy("fold", "step", "threshold").agg(right.alias("good"), F.sum(F.col("genuine") + F.col("impostor")).alias("n"))
    totals = per.groupBy("step").agg(F.sum("good").alias("all_good"))
    scored = per.join(F.broadcast(totals), "step").withColumn("others", F.col("all_good") - F.col("good"))
    best = Window.partitionBy("fold").orderBy(F.desc("others"), "step")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").select("fold", "threshold", (F.col("good") / F.col("n")).alias("accuracy"))


def accuracy_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"))


def bootstrap_ci(outcomes: DataFrame, column: str, rounds: int = 2_000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """``mean, low, high``: Poisson bootstrap of a mean.

    Each row gets a Poisson(1) weight in each round from its own seeded generator state, so
    rows need not be gathered; partitions send one pair of sums a round.
    """
    def run(batches):
        rng = None
        sums, weights = np.zeros(rounds), np.zeros(rounds)
        for batch in batches:
            if rng is None:
                from pyspark import TaskContext

                rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
            values = batch.column("x").to_numpy(zero_copy_only=False)
            drawn = rng.poisson(1.0, (rounds, len(values)))
            sums += drawn @ values
            weights += drawn.sum(1)
        yield pa.RecordBatch.from_pydict({"round": pa.array(np.arange(rounds)), "s": pa.array(sums), "w": pa.array(weights)})

    drawn = outcomes.select(F.col(column).cast("double").alias("x")).where("x is not null").mapInArrow(run, "round long, s double, w double")
    means = drawn.groupBy("round").agg((F.sum("s") / F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    return outcomes.agg(F.avg(F.col(column).cast("double")).alias("mean")).crossJoin(means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high")))


def best_configuration(results: DataFrame, least_recall: float = 0.99) -> DataFrame:
    """Per method family the configuration of least memory and of least latency among those
    of at least a recall. ``results``: ``family, method, recall, memory_mb, latency_ms``."""
    good = results.where(F.col("recall") >= least_recall)
    return good.groupBy("family").agg(F.min_by("method", F.struct("memory_mb", "method")).alias("least_memory"), F.min_by("method", F.struct("latency_ms", "method")).alias("least_latency"), F.count(F.lit(1)).alias("n_methods"))


def tiled(gallery: DataFrame, rows: int) -> DataFrame:
    """``rows`` rows by repeating the gallery whole, then in part, in id order.

    Copies get ids of their own; keep queries out of the gallery first, or they find
    themselves.
    """
    n = gallery.count()
    if not n:
        return gallery.limit(0)
    copies = -(-rows // n)
    repeated = gallery.crossJoin(F.broadcast(gallery.sparkSession.range(copies).withColumnRenamed("id", "copy")))
    last = repeated.where(F.col("copy") == copies - 1).orderBy("id").limit(rows - n * (copies - 1))
    whole = repeated.where(F.col("copy") < copies - 1)
    return whole.unionByName(last)


def latency_stats(timings: DataFrame, column: str = "ms") -> DataFrame:
    """``n, mean, median, p95, p99, per_second`` of latencies in milliseconds; percentiles are
    interpolated between neighbours."""
    at = lambda q: F.percentile(column, F.lit(q))
    return timings.agg(
        F.count(column).alias("n"),
        F.round(F.avg(column), 4).alias("mean"),
        F.round(at(0.5), 4).alias("median"),
        F.round(at(0.95), 4).alias("p95"),
        F.round(at(0.99), 4).alias("p99"),
        F.round(1000 / F.avg(column), 4).alias("per_second"),
    )


class Stages:
    """Seconds of named stages, by a context manager."""

    def __init__(self, clock=None):
        import time

        self.clock, self.seconds = clock or time.perf_counter, {}

    @contextmanager
    def __call__(self, name: str):
        began = self.clock()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + self.clock() - began

    def frame(self, spark: SparkSession) -> DataFrame:
        """``stage, seconds, share`` in the order of first use."""
        total = sum(self.seconds.values()) or 1.0
        return spark.createDataFrame([(n, s, s / total) for n, s in self.seconds.items()], "stage string, seconds double, share double")


def split(gallery: DataFrame, share: float = 0.1, seed: int = 42, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries and database, by a hash of ``group`` (or of ``id``), so that a split does not
    depend on partitions, and rows of one group, such as copies of a vector, stay together."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group or "id").cast("string"))), 1, 8), 16, 10).cast("long") < int(share * (1 << 32))
    return gallery.where(drawn), gallery.where(~drawn)


def bits_grid(queries: DataFrame, gallery: DataFrame, truth: DataFrame, bits: list[int], candidates: list[int], quantizer_of=None) -> DataFrame:
    """``n_bits, candidates, recall`` for every code length and shortlist size.

    ``truth``: ``query_id, id`` of the right neighbour. One ranking by codes answers all
    shortlist sizes of a code length.
    """
    from galena.operators.quantizer import fit_quantizer
    from galena.operators.search import binary_topk

    out = None
    for n in bits:
        quantizer = quantizer_of(n) if quantizer_of else fit_quantizer(gallery, n)
        ranked = binary_topk(quantizer.encode(queries), quantizer.encode(gallery), quantizer.words, max(candidates))
        swept = candidate_sweep(ranked, truth, candidates).withColumn("n_bits", F.lit(n))
        out = swept if out is None else out.unionByName(swept)
    return out


def same_codes(queries: DataFrame, gallery: DataFrame, quantizer, truth: DataFrame, k: int = 1, n_candidates: int | None = None) -> DataFrame:
    """``rerank, recall``: one table of codes searched with and without the exact stage, which
    tells what is lost by the codes from what is lost by the search."""
    from galena.operators.search import binary_topk, two_phase_topk

    coded = quantizer.encode(gallery)
    flat = recall_at_k(binary_topk(quantizer.encode(queries), coded, quantizer.words, k), truth, k).withColumn("rerank", F.lit(False))
    both = recall_at_k(two_phase_topk(queries, coded, quantizer, k, n_candidates), truth, k).withColumn("rerank", F.lit(True))
    return flat.unionByName(both)


def ratios(results: DataFrame, baseline: str, method: str = "method") -> DataFrame:
    """Each method's speed and memory against the baseline's: ``speed_up`` of ``per_second``
    and ``compression`` of ``memory_mb``."""
    base = results.where(F.col(method) == baseline).select(F.col("per_second").alias("base_speed"), F.col("memory_mb").alias("base_memory")).limit(1)
    out = results.join(F.broadcast(base), how="left")
    return out.withColumn("speed_up", F.round(F.col("per_second") / F.col("base_speed"), 2)).withColumn("compression", F.round(F.col("base_memory") / F.col("memory_mb"), 2)).drop("base_speed", "base_memory")


def chart_rows(results: DataFrame, methods: list[str], least_recall: float = 0.85, method: str = "method") -> DataFrame:
    """What a chart of ``methods`` shows: rows of enough recall by memory, with the logarithms
    of memory and speed."""
    kept = results.where(F.col(method).isin(methods) & (F.col("recall") >= least_recall))
    return kept.withColumn("log_memory", F.round(F.log10("memory_mb"), 6)).withColumn("log_speed", F.round(F.log10("per_second"), 6)).orderBy("memory_mb", method)

"""Nearest-neighbour search: exact, by codes, and in two stages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.functions.vectors import dot, hamming
from galena.operators.quantizer import Quantizer, vectors_of

#: Queries that one pass over the gallery carries; more queries take more passes. At 512
#: elements a pass is 8 MB of vectors.
QUERY_BLOCK = 4_096


def shortlist_size(k: int, n_candidates: int | None) -> int:
    """Codes to re-rank: the given number, or 10 k and at least 100."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if n_candidates is not None and n_candidates < 1:
        raise ValueError("n_candidates must be at least 1")
    return n_candidates or max(100, 10 * k)


def ranked(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each query. Spark cuts each partition to ``k`` rows of a query
    before the shuffle (a partial window group limit)."""
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return hits.withColumn("rank", at).where(F.col("rank") <= k)


def one_block(queries: DataFrame, columns: list[str], block: int) -> pa.Table | None:
    """The queries as one table for the driver, or None if there are more than ``block``."""
    rows = queries.select("query_id", *columns)
    return rows.toArrow() if rows.limit(block + 1).count() <= block else None


def query_blocks(queries: DataFrame, columns: list[str], block: int) -> Iterator[pa.Table]:
    """Queries in blocks of bounded size, one block on the driver at a time."""
    rows = queries.select("query_id", *columns)
    if (table := one_block(queries, columns, block)) is not None:
        yield table
        return
    parts = -(-rows.count() // (block * 3 // 4))
    numbered = rows.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    for part in range(parts):
        yield numbered.where(F.col("part") == part).drop("part").toArrow()


#: Rows that a matrix is padded to a multiple of.
TILE = 64


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``.

    A matrix product sums its edges in another order, so equal rows may differ in the last bit
    by where they stand, and ties would not go by id. With whole tiles there are no edges.
    """
    whole = [np.concatenate([x, np.zeros((-len(x) % TILE, x.shape[1]), x.dtype)]) if len(x) % TILE else x for x in (a, b)]
    return (whole[0] @ whole[1].T)[: len(a), : len(b)]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least scores, ties by id."""
    if len(scores) > k:
        at = np.flatnonzero(scores <= np.partition(scores, k - 1)[k - 1])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], scores[at]))][:k]


class _Nearest:
    """The ``k`` rows of least distance for each of ``n`` queries, ties by id.

    Candidates gather until there are as many as results, then all are ordered at once; a
    query's worst result bounds what is gathered next.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k, self.worst, self.new = n, k, np.full(n, np.inf), []
        self.kept = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    def add(self, distance: np.ndarray, ids: np.ndarray, of: np.ndarray | None = None) -> None:
        """``of``: the queries that the rows of ``distance`` belong to, if not all."""
        limit = self.worst if of is None else self.worst[of]
        if distance.shape[1] > self.k and np.isinf(limit).any():
            limit = np.minimum(limit, np.partition(distance, self.k - 1, axis=1)[:, self.k - 1])
        row, column = np.nonzero(distance <= limit[:, None])
        if len(row):
            self.new.append((row if of is None else of[row], distance[row, column], ids[column]))
            if of is None and np.isinf(self.worst).any() or sum(len(r) for r, _, _ in self.new) > self.n * self.k:
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, value, ids = (np.concatenate(x) for x in zip(self.kept, *self.new, strict=True))
        order = np.lexsort((ids, value, row))
        row, value, ids = row[order], value[order], ids[order]
        many = np.bincount(row, minlength=self.n)
        near = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) < self.k
        self.kept, self.new = (row[near], value[near], ids[near]), []
        many = np.minimum(many, self.k)
        full = np.flatnonzero(many == self.k)
        self.worst[full] = self.kept[1][(np.cumsum(many) - 1)[full]]
        return self.kept


#: Gallery rows that are compared with a block of queries at once.
SCAN_ROWS = 1024
HITS = "query_id long, id long, distance double"


def _nearest(query_ids: np.ndarray, parts, k: int) -> pa.RecordBatch:
    """``parts``: ids and a matrix of distances at a time, with a row for each query, or for
    those that come third."""
    best = _Nearest(len(query_ids), k)
    for ids, distance, *of in parts:
        best.add(distance, ids, *of)
    row, value, ids = best.settle()
    return pa.RecordBatch.from_pydict({"query_id": pa.array(query_ids[row], pa.int64()), "id": pa.array(ids, pa.int64()), "distance": pa.array(value, pa.float64())})


def _pieces(batches):
    for batch in batches:
        for start in range(0, len(batch), SCAN_ROWS):
            yield batch.slice(start, SCAN_ROWS)


def _scan(queries: DataFrame, gallery: DataFrame, columns: list[str], k: int, block: int, read, distances) -> DataFrame:
    """Rows ``query_id, id, distance`` that hold the ``k`` nearest of every query.

    ``read`` makes an array of a table's ``columns``, ``distances`` a matrix of two such. One
    block of queries goes to every partition of the gallery. More queries stay distributed:
    blocks of them meet blocks of the gallery, each pair of blocks in a task of its own.
    """
    if (table := one_block(queries, columns, block)) is not None:
        query_ids, wanted = table.column("query_id").to_numpy(), read(table)

        def run(batches):
            yield _nearest(query_ids, ((p.column("id").to_numpy(zero_copy_only=False), distances(wanted, read(p))) for p in _pieces(batches)), k)

        return gallery.select("id", *columns).mapInArrow(run, HITS)

    def blocks(rows: DataFrame, name: str, n: int) -> DataFrame:
        return rows.select(F.col(name).cast("long").alias("id"), *columns, F.pmod(F.xxhash64(name), F.lit(n)).cast("int").alias("part"))

    sizes = [max(1, -(-rows.count() // block)) for rows in (queries, gallery)]
    asked, searched = blocks(queries, "query_id", sizes[0]), blocks(gallery, "id", sizes[1])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = asked.withColumn("i", F.col("part")).withColumn("j", every(sizes[1])).withColumn("asked", F.lit(True)).unionByName(searched.withColumn("i", every(sizes[0])).withColumn("j", F.col("part")).withColumn("asked", F.lit(False)))

    def meet(_, table):
        own = table.filter(table.column("asked"))
        other = table.filter(pc.invert(table.column("asked")))
        parts = ((p.column("id").to_numpy(), distances(wanted, read(p))) for p in _pieces([other])) if len(own) else ()
        wanted = read(own) if len(own) else None
        return pa.Table.from_batches([_nearest(own.column("id").to_numpy(), parts, k)])

    return sent.drop("part").groupBy("i", "j").applyInArrow(meet, HITS)


def exact_topk(queries: DataFrame, gallery: DataFrame, k: int, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, id, label, similarity``: the ``k`` largest inner products.

    ``queries`` has ``query_id, embedding``; ``gallery`` has ``id, label, embedding``. Order
    is by similarity, then id. A block of queries meets every partition of the gallery in
    matrix products; only ``k`` rows a query and partition are shuffled. More queries than a
    block are not gathered: see ``_scan``.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    read = lambda table: vectors_of(table.column("embedding")).astype(np.float64)
    out = _scan(queries, gallery, ["embedding"], k, query_block, read, lambda wanted, there: -products(wanted, there))
    top = ranked(out, k, F.asc("distance"), F.asc("id"))
    return top.join(gallery.select("id", "label"), "id").select("query_id", "rank", "id", "label", (-F.col("distance")).alias("similarity"))


def codes_of(table: pa.Table | pa.RecordBatch, words: list[str]) -> list[np.ndarray]:
    return [np.asarray(table.column(w)).astype(np.int64) for w in words]


def code_distances(wanted: list[np.ndarray], there: list[np.ndarray]) -> np.ndarray:
    total = np.zeros((len(wanted[0]), len(there[0])), np.uint16)
    for own, other in zip(wanted, there, strict=True):
        total += np.bitwise_count((own[:, None] ^ other[None, :]).view(np.uint64))
    return total.astype(np.float32)


def hamming_topk(queries: DataFrame, gallery: DataFrame, words: list[str], k: int, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, id, hamming``: the ``k`` nearest codes by (distance, id).

    Reads ids and code words only. ``k`` of 0 gives no rows.
    """
    if k < 1:
        return gallery.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0).cast("long").alias("hamming")).limit(0)

    out = _scan(queries, gallery, words, k, query_block, lambda table: codes_of(table, words), code_distances)
    return ranked(out, k, F.asc("distance"), F.asc("id")).select("query_id", "rank", "id", F.col("distance").cast("long").alias("hamming"))


def hamming_pairs(queries: DataFrame, gallery: DataFrame, words: list[str]) -> DataFrame:
    """``query_id, id, hamming`` of every pair, in native expressions."""
    asked = queries.select("query_id", *(F.col(w).alias(f"q_{w}") for w in words))
    return gallery.select("id", *words).crossJoin(asked).select("query_id", "id", hamming(words, [f"q_{w}" for w in words]).alias("hamming"))


def rerank(shortlist: DataFrame, queries: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest inner products among ``query_id, id`` pairs.

    The gallery's vectors are read here for the first time, and only shortlisted ones are
    multiplied.
    """
    pairs = shortlist.select("query_id", "id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    scored = pairs.join(gallery.select("id", "label", "embedding"), "id").select("query_id", "id", "label", dot("q", "embedding").alias("similarity"))
    return ranked(scored, k, F.desc("similarity"), F.asc("id")).select("query_id", "rank", "id", "label", "similarity")


def two_phase_topk(queries: DataFrame, gallery: DataFrame, quantizer: Quantizer, k: int, n_candidates: int | None = None) -> DataFrame:
    """Shortlist by Hamming distance, then re-rank by inner product.

    With a shortlist of the whole gallery the result is the exact one, and is computed as such:
    listing every pair to leave none out would only store them.
    """
    n = shortlist_size(k, n_candidates)
    if n > shortlist_size(k, None) and gallery.count() <= n:
        return exact_topk(queries, gallery, k)
    short = hamming_topk(quantizer.encode(queries), gallery, quantizer.words, n)
    return rerank(short, queries, gallery, k)


def binary_topk(queries: DataFrame, gallery: DataFrame, words: list[str], k: int) -> DataFrame:
    """``query_id, rank, id, label, hamming``: ranked by codes alone."""
    return hamming_topk(queries, gallery, words, k).join(gallery.select("id", "label"), "id").select("query_id", "rank", "id", "label", "hamming")


def above_threshold(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits of at least ``threshold``, with ``confidence`` of 4 decimals.

    Applied to the top k, so fewer than k rows are usual.
    """
    return hits.where(F.col("similarity") >= threshold).withColumn("confidence", F.round("similarity", 4))


def verify(pairs: DataFrame, gallery: DataFrame, threshold: float = 0.4) -> DataFrame:
    """``a, b, match, confidence`` of id pairs: a match lies strictly above the threshold."""
    left = gallery.select(F.col("id").alias("a"), F.col("embedding").alias("va"))
    right = gallery.select(F.col("id").alias("b"), F.col("embedding").alias("vb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("s", dot("va", "vb"))
    return both.select("a", "b", (F.col("s") > threshold).alias("match"), F.round("s", 4).alias("confidence"))

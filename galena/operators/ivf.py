"""Coarse clusters: search only the buckets whose centroids are nearest."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.operators.quantizer import Quantizer, vectors_of
from galena.operators.search import HITS, SCAN_ROWS, _best, _nearest, code_distances, codes_of, products, ranked, rerank, shortlist_size

#: Rows that centroids are fitted on at most, and rounds of the fit.
FIT_ROWS, FIT_ROUNDS = 50_000, 10
STILL = 1e-4
#: Queries, and rows of probed clusters, that meet in a task. The latter are only codes.
PROBE_BLOCK, BUNDLE_ROWS = 2_048, 65_536


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1.0, norm)


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = FIT_ROUNDS, seed: int = 42) -> np.ndarray:
    """Exactly ``min(k, rows)`` unit centroids; an empty cluster restarts at a random row."""
    x = unit_rows(np.asarray(sample, np.float64))
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        empty = np.bincount(home, minlength=len(centroids)) == 0
        sums[empty] = x[rng.integers(len(x), size=int(empty.sum()))]
        moved = unit_rows(sums)
        shift = np.abs(moved - centroids).max()
        centroids = moved
        if shift < STILL:
            break
    return centroids


def default_clusters(rows: int) -> int:
    return min(max(1, math.isqrt(rows)), max(1, rows))


def fit_centroids(gallery: DataFrame, n_clusters: int | None = None, fit_rows: int = FIT_ROWS, seed: int = 42) -> np.ndarray:
    """Centroids of a bounded sample in hash order; as many as the root of the rows."""
    rows = gallery.count()
    if not rows:
        raise ValueError("an empty gallery has no clusters")
    if n_clusters is not None and n_clusters < 1:
        raise ValueError("n_clusters must be at least 1")
    drawn = gallery.select("id").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(fit_rows)
    sample = gallery.select("id", "embedding").join(F.broadcast(drawn), "id", "left_semi").orderBy("id").select("embedding").toArrow()
    return spherical_kmeans(vectors_of(sample.column(0)), min(n_clusters or default_clusters(rows), rows), seed=seed)


def assign_clusters(gallery: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Append ``cluster_id``: the centroid of largest inner product, the first of equals."""
    gallery = gallery.drop("cluster_id")
    schema = gallery.withColumn("cluster_id", F.lit(0)).schema

    def run(batches):
        for batch in batches:
            home = products(unit_rows(vectors_of(batch.column("embedding")).astype(np.float64)), centroids).argmax(axis=1) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32))], names=[*batch.schema.names, "cluster_id"])

    return gallery.mapInArrow(run, schema)


def _probed(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the ``n`` nearest centroids of each row, nearest first."""
    near = -products(unit_rows(vectors.astype(np.float64)), centroids)
    numbers = np.arange(len(centroids))
    return np.array([_best(row, numbers, n) for row in near], np.int64).reshape(len(near), n)


def probe(queries: DataFrame, centroids: np.ndarray, n_probe: int) -> DataFrame:
    """``query_id, probe, cluster_id``: the ``n_probe`` nearest centroids of each query."""
    if n_probe < 1:
        raise ValueError("n_probe must be at least 1")
    n = min(n_probe, len(centroids))

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            at = _probed(vectors_of(batch.column("embedding")), centroids, n).ravel()
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(batch.column("query_id").to_numpy(zero_copy_only=False), n)), "probe": pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(batch))), "cluster_id": pa.array(at.astype(np.int32))})

    return queries.select("query_id", "embedding").mapInArrow(run, "query_id long, probe int, cluster_id int")


def bundled(sizes: dict[int, int], rows: int) -> tuple[list[list[int]], dict[int, tuple[int, int]]]:
    """Clusters in bundles of about ``rows`` rows: the clusters of each bundle, and of each
    cluster its first bundle and in how many it lies. One larger than a bundle has several of
    its own, so no bundle grows with a cluster."""
    members, places, left = [], {}, 0
    for cluster, n in sorted(sizes.items()):
        if n > rows:
            pieces = -(-n // rows)
            places[cluster] = (len(members), pieces)
            members += [[cluster]] * pieces
            left = 0
            continue
        if n > left:
            members.append([])
            left = rows
        places[cluster] = (len(members) - 1, 1)
        members[-1].append(cluster)
        left -= n
    return members, places


def nearest_probed(asked: DataFrame, gallery: DataFrame, words: list[str], centroids: np.ndarray, k: int, n_probe: int, block: int = PROBE_BLOCK, bundle_rows: int = BUNDLE_ROWS) -> DataFrame:
    """Rows ``query_id, id, distance`` that hold the ``k`` nearest codes of every query in the
    clusters that it probes.

    Blocks of queries meet bundles of clusters, each pair in a task, which compares a cluster
    with those queries that probe it and keeps ``k`` rows a query; a query is sent only to
    bundles that it probes. Only probed clusters of the gallery are read.
    """
    if n_probe < 1:
        raise ValueError("n_probe must be at least 1")
    spark, n = asked.sparkSession, min(n_probe, len(centroids))

    def used(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"cluster_id": pa.array(np.unique(_probed(vectors_of(batch.column("embedding")), centroids, n) if len(batch) else []).astype(np.int32))})

    if n < len(centroids):
        probed = asked.select("embedding").mapInArrow(used, "cluster_id int").distinct().collect()
        gallery = gallery.where(F.col("cluster_id").isin([r[0] for r in probed]))
    members, places = bundled(dict(gallery.groupBy("cluster_id").count().collect()), bundle_rows)
    blocks = max(1, -(-asked.count() // block))

    def send(batches):
        for batch in batches:
            if not len(batch):
                continue
            chosen = np.ones((len(batch), len(centroids)), bool)
            if n < len(centroids):
                chosen[:] = False
                np.put_along_axis(chosen, _probed(vectors_of(batch.column("embedding")), centroids, n), True, axis=1)
            own = batch.drop_columns(["embedding"])
            for j, clusters in enumerate(members):
                probes = chosen[:, clusters]
                to = np.flatnonzero(probes.any(axis=1))
                masks = pa.array([m.tobytes() for m in np.packbits(probes[to], axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*own.take(pa.array(to)).columns, pa.array(np.full(len(to), j, np.int32)), masks], names=[*own.schema.names, "j", "probes"])

    types = ", ".join(f"{w} long" for w in words)
    sent = asked.select(F.col("query_id").cast("long").alias("id"), *words, "embedding").mapInArrow(send, f"id long, {types}, j int, probes binary")
    queries = sent.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("cluster_id", F.lit(None).cast("int"))
    homes = F.broadcast(spark.createDataFrame([(c, *at) for c, at in places.items()], "cluster_id int, first int, pieces int"))
    searched = gallery.select(F.col("id").cast("long").alias("id"), *words, F.col("cluster_id").cast("int").alias("cluster_id")).join(homes, "cluster_id")
    searched = searched.withColumn("j", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("pieces"))).cast("int")).drop("first", "pieces")
    searched = searched.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("probes", F.lit(None).cast("binary"))

    def meet(key, table):
        clusters = members[key[1].as_py()]
        is_query = pc.is_valid(table.column("probes"))
        own, other = table.filter(is_query), table.filter(pc.invert(is_query)).sort_by("cluster_id")
        wanted, there, ids, home = codes_of(own, words), codes_of(other, words), other.column("id").to_numpy(), other.column("cluster_id").to_numpy()
        probes = np.unpackbits(np.frombuffer(b"".join(own.column("probes").to_pylist()), np.uint8).reshape(len(own), -1 if len(own) else 0), axis=1)

        def parts():
            for c, cluster in enumerate(clusters if len(own) else ()):
                of = np.flatnonzero(probes[:, c])
                first, last = np.searchsorted(home, [cluster, cluster + 1])
                for start in range(first, last if len(of) else first, SCAN_ROWS):
                    at = slice(start, min(start + SCAN_ROWS, last))
                    yield ids[at], code_distances([w[of] for w in wanted], [w[at] for w in there]), of

        return pa.Table.from_batches([_nearest(own.column("id").to_numpy(), parts(), k)])

    return queries.unionByName(searched).groupBy("i", "j").applyInArrow(meet, HITS)


def clustered_topk(queries: DataFrame, gallery: DataFrame, quantizer: Quantizer, centroids: np.ndarray, k: int, n_probe: int = 8, n_candidates: int | None = None) -> DataFrame:
    """Two-stage search within the probed buckets only.

    A gallery written by cluster is pruned to the probed folders.
    """
    n = shortlist_size(k, n_candidates)
    found = nearest_probed(quantizer.encode(queries), gallery, quantizer.words, centroids, n, n_probe)
    return rerank(ranked(found, n, F.asc("distance"), F.asc("id")), queries, gallery, k)


def cluster_sizes(gallery: DataFrame) -> DataFrame:
    return gallery.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_rows"))


def probe_sweep(queries: DataFrame, gallery: DataFrame, centroids: np.ndarray, truth: DataFrame, probes: list[int]) -> DataFrame:
    """``n_probe, recall``: the share of queries whose true hit (``query_id, id``) lies in the
    probed buckets. The true bucket's probe number answers for all settings at once."""
    at = probe(queries, centroids, len(centroids)).join(truth.join(gallery.select("id", "cluster_id"), "id").select("query_id", "cluster_id"), ["query_id", "cluster_id"])
    wanted = queries.sparkSession.createDataFrame([(p,) for p in probes], "n_probe int")
    return at.crossJoin(F.broadcast(wanted)).groupBy("n_probe").agg(F.avg((F.col("probe") <= F.col("n_probe")).cast("double")).alias("recall"))


def as_dict(centroids: np.ndarray, n_probe: int = 8) -> dict[str, int]:
    """What describes an index beside its arrays."""
    return {"n_clusters": len(centroids), "n_probe": n_probe}

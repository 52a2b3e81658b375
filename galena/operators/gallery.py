"""Gallery management: a stored, versioned table of labelled vectors and codes."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions.vectors import valid_embedding
from galena.operators import ivf
from galena.operators.quantizer import FIT_THRESHOLD, Quantizer, fit_quantizer
from galena.operators.search import above_threshold, binary_topk, exact_topk, shortlist_size, two_phase_topk


def checked(rows: DataFrame, dim: int) -> DataFrame:
    """``id, label, path, embedding`` of ``rows``; the query fails on a vector that is null,
    of another length or not finite, and on a null id or label."""
    path = F.coalesce(F.col("path").cast("string"), F.lit("")) if "path" in rows.columns else F.lit("")
    fine = valid_embedding("embedding", dim) & F.col("id").isNotNull() & F.col("label").isNotNull()
    vector = F.when(fine, F.col("embedding").cast("array<float>")).otherwise(F.raise_error(F.lit(f"a row without id, label or {dim} finite elements")))
    return rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), path.alias("path"), vector.alias("embedding"))


def repeated_ids(rows: DataFrame) -> DataFrame:
    """``id, n`` of ids that occur more than once, which a gallery must not have."""
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _unique(rows: DataFrame) -> DataFrame:
    if not (again := repeated_ids(rows)).isEmpty():
        raise ValueError(f"id {again.first()['id']} occurs more than once")
    return rows


def names(gallery: DataFrame) -> DataFrame:
    return gallery.select("label").distinct().orderBy("label")


def contains(gallery: DataFrame, label: str) -> bool:
    return not gallery.where(F.col("label") == label).limit(1).isEmpty()


def remove(gallery: DataFrame, label: str) -> DataFrame:
    """All rows of other labels."""
    return gallery.where(F.col("label") != label)


def remove_all(gallery: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose label is not among ``labels``."""
    return gallery.join(labels.select("label"), "label", "left_anti")


def stats(gallery: DataFrame, dim: int, n_bits: int) -> DataFrame:
    """``count, identities, binary_memory_mb, float_storage_mb, compression_ratio``."""
    n = F.count(F.lit(1))
    binary, floats = n * (n_bits / 8) / 1024**2, n * (dim * 4) / 1024**2
    return gallery.agg(
        n.alias("count"),
        F.count_distinct("label").alias("identities"),
        F.round(binary, 2).alias("binary_memory_mb"),
        F.round(floats, 2).alias("float_storage_mb"),
        F.when(n > 0, F.round(floats / binary, 1)).otherwise(F.lit(0.0)).alias("compression_ratio"),
    )


@dataclass(frozen=True)
class Gallery:
    """A gallery as a DataFrame with what its codes and clusters were made with.

    Immutable: ``append``, ``remove`` and ``clustered`` return another gallery. Rows keep
    their ids when others go.
    """

    rows: DataFrame
    dim: int
    n_bits: int = 512
    quantizer: Quantizer | None = None
    centroids: np.ndarray | None = None

    @classmethod
    def create(cls, rows: DataFrame, dim: int, n_bits: int = 512, quantizer: Quantizer | None = None) -> Gallery:
        """Check the rows, fit codes unless given, and encode. An empty gallery stays without
        codes until rows are appended."""
        if n_bits < 1 or n_bits % 8:
            raise ValueError("n_bits must be a positive multiple of 8")
        good = _unique(checked(rows, dim))
        if quantizer is None and not good.isEmpty():
            quantizer = fit_quantizer(good, n_bits)
        return cls(quantizer.encode(good) if quantizer else good, dim, n_bits, quantizer)

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def append(self, rows: DataFrame) -> Gallery:
        """Add rows whose ids are new.

        A fitted quantizer is frozen, and codes stay as they are. A gallery that began too
        small for a fit is fitted and encoded anew as soon as it is large enough; its clusters
        are kept, as they do not depend on codes.
        """
        plain = self.rows.select("id", "label", "path", "embedding")
        every = _unique(plain.unionByName(checked(rows, self.dim)))
        if self.quantizer is None:
            return Gallery.create(every, self.dim, self.n_bits)
        if self.quantizer.kind == "random" and not every.select("id").offset(FIT_THRESHOLD - 1).limit(1).isEmpty():
            fitted = fit_quantizer(every, self.n_bits)
            coded = fitted.encode(every)
            return replace(self, rows=coded if self.centroids is None else ivf.assign_clusters(coded, self.centroids), quantizer=fitted)
        new = self.quantizer.encode(checked(rows, self.dim))
        if self.centroids is not None:
            new = ivf.assign_clusters(new, self.centroids)
        return replace(self, rows=self.rows.unionByName(new))

    def add(self, label: str, embedding, path: str = "") -> Gallery:
        """One more row, with the next free id."""
        last = self.rows.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
        row = [(last + 1, label, path, [float(x) for x in embedding])]
        return self.append(self.spark.createDataFrame(row, "id long, label string, path string, embedding array<float>"))

    def remove(self, label: str) -> tuple[Gallery, int]:
        """The gallery without a label, and how many rows went. Clusters are dropped with
        them, the quantizer is kept."""
        gone = self.rows.where(F.col("label") == label).count()
        if not gone:
            return self, 0
        return replace(self, rows=remove(self.rows, label).drop("cluster_id"), centroids=None), gone

    def clustered(self, n_clusters: int | None = None) -> Gallery:
        centroids = ivf.fit_centroids(self.rows, n_clusters)
        return replace(self, rows=ivf.assign_clusters(self.rows, centroids), centroids=centroids)

    def search(self, queries: DataFrame, k: int = 1, n_candidates: int | None = None, n_probe: int | None = None) -> DataFrame:
        """Two-stage search, within probed buckets if the gallery is clustered and ``n_probe``
        given. An empty gallery gives no rows."""
        shortlist_size(k, n_candidates)
        if self.quantizer is None:
            return exact_topk(queries, self.rows, k)
        if n_probe is not None and self.centroids is None:
            raise ValueError("the gallery has no clusters to probe")
        if n_probe is not None:
            return ivf.clustered_topk(queries, self.rows, self.quantizer, self.centroids, k, n_probe, n_candidates)
        return two_phase_topk(queries, self.rows, self.quantizer, k, n_candidates)

    def search_binary_only(self, queries: DataFrame, k: int = 1) -> DataFrame:
        if self.quantizer is None:
            raise ValueError("the gallery has no codes")
        return binary_topk(self.quantizer.encode(queries), self.rows, self.quantizer.words, k)

    def identify(self, queries: DataFrame, k: int = 1, threshold: float = 0.4, n_candidates: int | None = None) -> DataFrame:
        return above_threshold(self.search(queries, k, n_candidates), threshold)

    def names(self) -> DataFrame:
        return names(self.rows)

    def stats(self) -> DataFrame:
        return stats(self.rows, self.dim, self.n_bits)

    def contains(self, label: str) -> bool:
        return contains(self.rows, label)

    def count(self) -> int:
        return self.rows.count()

    def describe(self) -> str:
        n, people = self.rows.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
        return f"Gallery({n} rows, {people} identities, {self.n_bits} bits)"

    def save(self, path: str) -> None:
        """Write a whole new version under ``path``, then point to it and delete the others.

        The pointer is a new file each time, renamed into place, and the one of the largest
        number counts, so a reader that starts at any moment, or after a crash, finds a whole
        version. Removed rows leave no file behind. What the gallery reads from ``path`` must
        be opened again, as its files are gone.
        """
        version = f"v-{uuid.uuid4().hex}"
        writer = self.rows.write
        if self.centroids is not None:
            writer = writer.partitionBy("cluster_id")
        writer.parquet(f"{path}/{version}/rows")
        if self.quantizer is not None:
            self.quantizer.save(self.spark, f"{path}/{version}/quantizer")
        if self.centroids is not None:
            table = [(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)]
            self.spark.createDataFrame(table, "cluster_id int, centroid array<double>").coalesce(1).write.parquet(f"{path}/{version}/centroids")
        meta = {"version": version, "dim": self.dim, "n_bits": self.n_bits, "fitted": self.quantizer is not None, "clustered": self.centroids is not None}
        files = _Files(self.spark, path)
        number = max(files.pointers(), default=0) + 1
        files.create(f"meta-{number:012d}.json", json.dumps(meta))
        for old in files.pointers():
            if old < number:
                files.delete(f"meta-{old:012d}.json")
        for name in files.folders():
            if name != version:
                files.delete(name)

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, dim: int, n_bits: int = 512) -> Gallery:
        """The gallery stored in ``path``, or an empty one if there is none."""
        try:
            return cls.open(spark, path)
        except FileNotFoundError:
            return cls.create(spark.createDataFrame([], "id long, label string, path string, embedding array<float>"), dim, n_bits)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Gallery:
        files = _Files(spark, path)
        if not (numbers := files.pointers()):
            raise FileNotFoundError(f"no gallery in {path}")
        meta = json.loads(files.read(f"meta-{max(numbers):012d}.json"))
        base = f"{path}/{meta['version']}"
        quantizer = Quantizer.load(spark, f"{base}/quantizer") if meta["fitted"] else None
        centroids = None
        if meta["clustered"]:
            centroids = np.array([r[0] for r in spark.read.parquet(f"{base}/centroids").orderBy("cluster_id").select("centroid").collect()])
        return cls(spark.read.parquet(f"{base}/rows"), meta["dim"], meta["n_bits"], quantizer, centroids)


class _Files:
    """Small metadata files through Hadoop's file system, wherever ``path`` lies."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.jvm, self.root = jvm, jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def create(self, name: str, text: str) -> None:
        """A file that appears with its whole content."""
        out = self.fs.create(self._at(f"{name}.new"), True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(self._at(f"{name}.new"), self._at(name)):
            raise OSError(f"{name} was written by another process")

    def pointers(self) -> list[int]:
        """Numbers of the pointer files."""
        if not self.fs.exists(self.root):
            return []
        found = (re.fullmatch(r"meta-(\d+)\.json", s.getPath().getName()) for s in self.fs.listStatus(self.root))
        return [int(m[1]) for m in found if m]

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def folders(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.root) if s.isDirectory()]

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

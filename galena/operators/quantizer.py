"""Learned binary codes: PCA with iterative quantization, or random projection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a fit reads at most, drawn by hash order.
FIT_ROWS = 5_000
#: Galleries of fewer rows use the random projection.
FIT_THRESHOLD = 1_024
ITQ_ROUNDS = 20
PROJECTION_SEED, PADDING_SEED = 42, 42


def vectors_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A float32 matrix of a list column without nulls."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [p for p in parts if len(p)]
    if not parts:
        return np.zeros((0, 0), np.float32)
    return np.concatenate([p.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(p), -1) for p in parts])


@dataclass(frozen=True)
class Quantizer:
    """Bit i of a code is ``weights[i] . v > thresholds[i]``, strictly."""

    weights: np.ndarray
    thresholds: np.ndarray
    kind: str

    @property
    def n_bits(self) -> int:
        return len(self.weights)

    @property
    def dim(self) -> int:
        return self.weights.shape[1]

    @property
    def words(self) -> list[str]:
        return [f"c{i}" for i in range(-(-self.n_bits // 64))]

    def encode_array(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of signed 64-bit words, most significant bit first, zero-padded."""
        vectors = np.atleast_2d(np.asarray(vectors))
        if vectors.shape[1] != self.dim:
            raise ValueError(f"vectors of {vectors.shape[1]} elements; the quantizer takes {self.dim}")
        bits = vectors.astype(np.float64) @ self.weights.astype(np.float64).T > self.thresholds.astype(np.float64)
        padded = np.zeros((len(bits), 64 * len(self.words)), bool)
        padded[:, : self.n_bits] = bits
        return np.packbits(padded, axis=1).view(">i8").astype(np.int64)

    def encode(self, gallery: DataFrame, embedding: str = "embedding") -> DataFrame:
        """Append the code words ``c0, c1, ...`` to every row; any other column passes."""
        gallery = gallery.drop(*self.words)
        schema = gallery.select("*", *(F.lit(0).cast("long").alias(w) for w in self.words)).schema

        def run(batches):
            for batch in batches:
                codes = self.encode_array(vectors_of(batch.column(embedding))) if len(batch) else np.zeros((0, len(self.words)), np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(codes[:, k])) for k in range(codes.shape[1]))], names=[*batch.schema.names, *self.words])

        return gallery.mapInArrow(run, schema)

    def search(self, queries: DataFrame, gallery: DataFrame, k: int = 1, n_candidates: int = 50) -> DataFrame:
        """Shortlist by codes, which ``gallery`` must have, then exact order. Unlike a
        gallery's own search, the shortlist does not grow with ``k``."""
        from galena.operators.search import two_phase_topk

        if missing := [w for w in self.words if w not in gallery.columns]:
            raise ValueError(f"encode the gallery first: it has no {', '.join(missing)}")
        return two_phase_topk(queries, gallery, self, k, max(k, n_candidates))

    def packed(self, frame: DataFrame) -> DataFrame:
        """Replace the words by a binary column ``code`` of n_bits / 8 bytes."""
        code = F.substring(F.concat(*(F.unhex(F.lpad(F.hex(w), 16, "0")) for w in self.words)), 1, -(-self.n_bits // 8))
        return frame.withColumn("code", code).drop(*self.words)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, [float(x) for x in w], float(t), self.kind) for i, (w, t) in enumerate(zip(self.weights, self.thresholds, strict=True))]
        return spark.createDataFrame(rows, "bit int, w array<double>, threshold double, kind string")

    @classmethod
    def from_frame(cls, frame: DataFrame) -> Quantizer:
        rows = frame.orderBy("bit").collect()
        return cls(np.array([r["w"] for r in rows], np.float32), np.array([r["threshold"] for r in rows], np.float32), rows[0]["kind"])

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Quantizer:
        return cls.from_frame(spark.read.parquet(path))


def _unit_rows(rows: int, dim: int, seed: int) -> np.ndarray:
    drawn = np.random.default_rng(seed).standard_normal((rows, dim)).astype(np.float32)
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)


def random_projection(dim: int, n_bits: int) -> Quantizer:
    """Seeded Gaussian directions of unit length, with thresholds of zero."""
    return Quantizer(_unit_rows(n_bits, dim, PROJECTION_SEED), np.zeros(n_bits, np.float32), "random")


def fit_pca_itq(sample: np.ndarray, n_bits: int, rounds: int = ITQ_ROUNDS) -> Quantizer:
    """Principal directions, rotated so that signs lose least, cut at medians.

    Beyond the sample's components, unit Gaussian directions fill up. Directions are given a
    canonical sign, so that a fit does not depend on the linear-algebra library.
    """
    x = np.asarray(sample, np.float64)
    if x.ndim != 2 or len(x) < 2:
        raise ValueError("a fit needs at least two vectors")
    centred = x - x.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:n_bits]
    axes *= np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] < 0, -1, 1)[:, None]
    if len(axes) < n_bits:
        axes = np.vstack([axes, _unit_rows(n_bits - len(axes), x.shape[1], PADDING_SEED)])
    projected = centred @ axes.T
    rotation = np.eye(n_bits)
    for _ in range(rounds):
        signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(signs.T @ projected)
        rotation = (u @ vt).T
    weights = (rotation.T @ axes).astype(np.float32)
    return Quantizer(weights, np.median(x @ weights.astype(np.float64).T, axis=0).astype(np.float32), "pca-itq")


def fit_quantizer(gallery: DataFrame, n_bits: int = 512, fit_threshold: int = FIT_THRESHOLD, fit_rows: int = FIT_ROWS, id_col: str = "id", embedding: str = "embedding", seed: int = 0) -> Quantizer:
    """Fit on at most ``fit_rows`` rows in hash order; small galleries get the projection.

    The sample is no prefix: galleries are often in order of identity. Only the ids take part
    in the ordering, so the sort moves no vectors.
    """
    first = gallery.select(F.size(embedding)).first()
    if first is None:
        raise ValueError("an empty gallery cannot be fitted")
    if gallery.select(id_col).limit(fit_threshold).count() < fit_threshold:
        return random_projection(first[0], n_bits)
    drawn = gallery.select(id_col).orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(fit_rows)
    sample = gallery.select(id_col, embedding).join(F.broadcast(drawn), id_col, "left_semi").orderBy(id_col).select(embedding).toArrow()
    return fit_pca_itq(vectors_of(sample.column(0)), n_bits)


def backend_info(spark: SparkSession) -> dict[str, str]:
    """Which engine computes codes and distances."""
    return {"engine": f"spark {spark.version}", "codegen": spark.conf.get("spark.sql.codegen.wholeStage"), "arrays": f"numpy {np.__version__}"}

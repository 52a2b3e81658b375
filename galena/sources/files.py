"""Readers of folders, pair lists and arrays; names from paths; sinks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGE_TYPES = ("jpg", "jpeg", "png")


def image_files(spark: SparkSession, folder: str, types: tuple[str, ...] = IMAGE_TYPES) -> DataFrame:
    """``path, modificationTime, length, content`` of images anywhere below ``folder``;
    endings match in either case."""
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in t) for t in types) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)


def decoded_images(spark: SparkSession, folder: str) -> DataFrame:
    """Spark's image source: decoded pixels, channels in BGR order."""
    return spark.read.format("image").option("recursiveFileLookup", "true").load(folder)


def has_type(path: Column, types: tuple[str, ...] = IMAGE_TYPES) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*types)


def name_from_path(path: Column, root: str) -> Column:
    """The parent folder's name, or, right below ``root``, the stem before its last ``_``."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    parent = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(parent == root.rstrip("/"), F.regexp_replace(stem, "_[^_]*$", "")).otherwise(F.element_at(parts, -2))


def named_pairs(lines: DataFrame, line: str = "value") -> DataFrame:
    """``name, path`` of ``Name:path`` lines, cut at the first colon and trimmed."""
    parts = F.split(F.col(line), ":", 2)
    return lines.where(F.col(line).contains(":")).select(F.trim(parts[0]).alias("name"), F.trim(parts[1]).alias("path"))


def verification_pairs(lines: DataFrame, line: str = "value") -> DataFrame:
    """``name_a, number_a, name_b, number_b, same`` of a pair list: three fields name two
    images of a person, four fields two persons; other lines are skipped."""
    parts = F.split(F.trim(F.col(line)), r"\s+")
    same = F.size(parts) == 3
    return lines.where(F.size(parts).isin(3, 4)).select(
        parts[0].alias("name_a"), F.get(parts, F.lit(1)).cast("int").alias("number_a"), F.when(same, parts[0]).otherwise(F.get(parts, F.lit(2))).alias("name_b"), F.when(same, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(3))).cast("int").alias("number_b"), same.alias("same")
    )


def npy_gallery(spark: SparkSession, folder: str, tags: tuple[str, ...]) -> DataFrame:
    """``id, label, embedding`` of the first tag for which ``<tag>_embeddings.npy`` and
    ``<tag>_labels.npy`` exist. An importer for local files of bounded size: the arrays are
    mapped on the driver."""
    from pathlib import Path

    for tag in tags:
        vectors, labels = (Path(folder) / f"{tag}_{part}.npy" for part in ("embeddings", "labels"))
        if vectors.exists() and labels.exists():
            x, y = np.load(vectors, mmap_mode="r"), np.load(labels)
            if len(x) != len(y):
                raise ValueError("as many labels as embeddings are needed")
            frame = pd.DataFrame({"id": np.arange(len(x)), "label": y.astype(str), "embedding": [r.tolist() for r in np.asarray(x, np.float32)]})
            return spark.createDataFrame(frame, "id long, label string, embedding array<float>")
    raise FileNotFoundError(f"no embeddings of {', '.join(tags)} in {folder}")


def capped_identities(images: DataFrame, per_identity: int, identity: str = "identity", path: str = "path") -> DataFrame:
    """At most ``per_identity`` images of each identity in path order, with a numeric label by
    the identities' order."""
    at = F.row_number().over(Window.partitionBy(identity).orderBy(path))
    labels = images.select(identity).distinct().withColumn("label", F.row_number().over(Window.orderBy(identity)) - 1)
    return images.withColumn("n", at).where(F.col("n") <= per_identity).drop("n").join(labels, identity)


def usable(gallery: DataFrame, least_norm: float = 0.5) -> DataFrame:
    """Rows whose vector is no failed (near-zero) embedding."""
    from galena.functions.vectors import l2_norm

    return gallery.where(l2_norm("embedding") > least_norm)


def embedded(images: DataFrame, embed: Callable[[], Callable[[list[bytes]], list[np.ndarray | None]]]) -> DataFrame:
    """``path, ok, error, embedding``: run a pluggable embedder over image bytes.

    ``embed`` builds the model once per worker and returns a function of a batch. An image
    that cannot be embedded, or a vector of no length, becomes a row with an error instead of
    a failed job; vectors are scaled to unit length.
    """

    def run(batches):
        model = None
        for pdf in batches:
            model = model or embed()
            out = []
            try:
                vectors = model(list(pdf["content"]))
            except Exception:  # a batch with one bad image: find out which
                vectors = [None] * len(pdf)
                for i, content in enumerate(pdf["content"]):
                    try:
                        vectors[i] = model([content])[0]
                    except Exception as e:
                        vectors[i] = e
            for v in vectors:
                if v is None or isinstance(v, Exception):
                    out.append((False, str(v) if v is not None else "no face", None))
                elif np.linalg.norm(v) < 1e-10:
                    out.append((False, "zero vector", None))
                else:
                    out.append((True, None, (np.asarray(v, float) / np.linalg.norm(v)).astype(np.float32).tolist()))
            ok, error, vector = zip(*out, strict=True) if out else ((), (), ())
            yield pd.DataFrame({"path": pdf["path"], "ok": ok, "error": error, "embedding": vector})

    return images.select("path", "content").mapInPandas(run, "path string, ok boolean, error string, embedding array<float>")


def registration_counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("ok")).alias("registered"), F.count_if(~F.col("ok")).alias("errors"), F.count(F.lit(1)).alias("total"))


def as_json(rows: DataFrame, ignore_null_fields: bool = False) -> DataFrame:
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(ignore_null_fields).lower()}).alias("value"))


def webhook_sink(send: Callable[[str], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that sends each row as JSON. A failed send is dropped, as
    alerts are worthless late. Alerts are few: rows are streamed to the driver one by one."""

    def sink(batch: DataFrame, _epoch: int) -> None:
        for row in as_json(batch).toLocalIterator():
            try:
                send(row["value"])
            except OSError:
                continue

    return sink

"""A gallery and its models behind one object."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.operators.attributes import age_gender, emotion
from galena.operators.gallery import Gallery
from galena.operators.search import verify
from galena.sources.faces import attributes_of
from galena.sources.files import embedded, image_files, name_from_path, registration_counts


@dataclass(frozen=True)
class Recognizer:
    """Register, find, verify and describe faces.

    ``embed`` builds an embedder (see ``files.embedded``), ``describe`` an attribute model: a
    function of a batch of image contents that returns for each ``(age and gender outputs,
    emotion logits)``. Immutable like the gallery: what changes it returns another one.
    """

    gallery: Gallery
    embed: Callable
    describe: Callable | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, embed: Callable, dim: int, n_bits: int = 512, describe: Callable | None = None) -> Recognizer:
        """With the gallery stored in ``path``; an empty one if there is none."""
        return cls(Gallery.open_or_create(spark, path, dim, n_bits), embed, describe)

    def _contents(self, images: list[bytes]) -> DataFrame:
        rows = [(str(k), bytearray(c)) for k, c in enumerate(images)]
        return self.gallery.spark.createDataFrame(rows, "path string, content binary")

    def _vector(self, image: bytes) -> list[float]:
        row = embedded(self._contents([image]), self.embed).first()
        if not row["ok"]:
            raise ValueError(row["error"])
        return row["embedding"]

    def register(self, name: str, image: bytes) -> Recognizer:
        """Fails if the image cannot be embedded."""
        return replace(self, gallery=self.gallery.add(name, self._vector(image)))

    def register_folder(self, folder: str) -> tuple[Recognizer, dict[str, int]]:
        """All images below ``folder``, named by their folders; and how many were registered,
        failed and seen. Ids follow the paths' order. The images are embedded again when the
        gallery is used; ``save`` it and open it again to keep the vectors."""
        spark = self.gallery.spark
        results = embedded(image_files(spark, folder), self.embed)
        counts = registration_counts(results).first().asDict()
        if not counts["registered"]:
            return self, counts
        good = results.where("ok").select("path", "embedding")
        order = good.select("path").orderBy("path").rdd.map(lambda r: r["path"]).zipWithIndex()
        ids = spark.createDataFrame(order, "path string, at long")
        last = self.gallery.rows.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
        name = name_from_path(F.col("path"), _absolute(spark, folder))
        rows = good.join(ids, "path").select((F.col("at") + last + 1).alias("id"), name.alias("label"), "path", "embedding")
        return replace(self, gallery=self.gallery.append(rows)), counts

    def identify(self, image: bytes, k: int = 1, threshold: float = 0.4) -> DataFrame:
        query = self.gallery.spark.createDataFrame([(0, self._vector(image))], "query_id long, embedding array<float>")
        return self.gallery.identify(query, k, threshold)

    def verify(self, first: bytes, second: bytes, threshold: float = 0.4) -> DataFrame:
        """``a, b, match, confidence``: whether both images show one person."""
        spark = self.gallery.spark
        pair = spark.createDataFrame([(0, self._vector(first)), (1, self._vector(second))], "id long, embedding array<float>")
        return verify(spark.createDataFrame([(0, 1)], "a long, b long"), pair, threshold)

    def analyze(self, images: list[bytes]) -> DataFrame:
        """``path, attributes``: age, gender and emotion of each image, by position."""
        if self.describe is None:
            raise ValueError("no attribute model was given")
        build = self.describe

        def run(batches):
            import pandas as pd

            model = None
            for pdf in batches:
                model = model or build()
                out = [(np.asarray(a, float).tolist(), np.asarray(e, float).tolist()) for a, e in model(list(pdf["content"]))]
                yield pd.DataFrame({"path": pdf["path"], "person": [a for a, _ in out], "mood": [e for _, e in out]})

        raw = self._contents(images).mapInPandas(run, "path string, person array<double>, mood array<double>")
        return raw.select("path", attributes_of(age_gender("person"), emotion("mood")).alias("attributes"))

    def remove(self, name: str) -> tuple[Recognizer, int]:
        gallery, gone = self.gallery.remove(name)
        return replace(self, gallery=gallery), gone

    def names(self) -> list[str]:
        return [r[0] for r in self.gallery.names().collect()]

    def stats(self) -> dict:
        return self.gallery.stats().first().asDict()

    def save(self, path: str) -> None:
        self.gallery.save(path)

    def __len__(self) -> int:
        return self.gallery.count()

    def __contains__(self, name: str) -> bool:
        return self.gallery.contains(name)


def _absolute(spark: SparkSession, folder: str) -> str:
    """The folder as Spark writes it in paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()

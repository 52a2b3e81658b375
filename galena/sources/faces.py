"""Faces in images: pluggable detectors, fallbacks, crops, embeddings of unknown images.

A detector is a function of a decoded image (height, width, 3) that returns boxes as dicts of
``x1, y1, x2, y2, score`` and perhaps ``points`` (five pairs). Builders of detectors and
models run once in each worker; a builder that fails is not tried again there.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from galena.operators.detections import align, centre_crop, resize

Detector = Callable[[np.ndarray], Sequence[dict]]
#: Share of a fallback box, and of a prepared portrait, that is added or cut on each side.
FALLBACK_MARGIN, PORTRAIT_MARGIN, BORDER = 0.2, 0.15, 0.05
FACE_SIZE = 112
#: Execution providers in order of preference.
PROVIDERS = ("CUDAExecutionProvider", "CoreMLExecutionProvider", "CPUExecutionProvider")
IMAGE_COLUMNS, LABEL_COLUMNS = ("image", "img", "content", "bytes"), ("label", "identity", "name", "person", "class")


class Once:
    """A builder's result, made at first use; None for good if it fails."""

    def __init__(self, build: Callable | None):
        self.build, self.made, self.done = build, None, build is None

    def __call__(self):
        if not self.done:
            self.done = True
            try:
                self.made = self.build()
            except Exception:
                self.made = None
        return self.made


def choose_provider(available: Sequence[str], wished: Sequence[str] = PROVIDERS) -> str:
    """The first wished provider that there is, else the last one wished."""
    return next((p for p in wished if p in available), wished[-1])


def widened(box: dict, width: int, height: int, margin: float = FALLBACK_MARGIN) -> tuple[int, int, int, int]:
    """A box with a margin of its size on each side, clamped to the image."""
    dx, dy = margin * (box["x2"] - box["x1"]), margin * (box["y2"] - box["y1"])
    return max(0, int(box["x1"] - dx)), max(0, int(box["y1"] - dy)), min(width, int(box["x2"] + dx)), min(height, int(box["y2"] + dy))


def without_border(image: np.ndarray, share: float = BORDER) -> np.ndarray:
    """The image without ``share`` of its size on each side."""
    h, w = image.shape[:2]
    dy, dx = int(h * share), int(w * share)
    return image[dy : h - dy or None, dx : w - dx or None]


def aligned_face(image: np.ndarray, detect: Detector | None, fallback: Detector | None = None, size: int = FACE_SIZE) -> tuple[np.ndarray, str]:
    """The face and how it was found.

    The detector's best box with points is aligned; else the largest box of the fallback, with
    a margin; else the centre of the image.
    """
    h, w = image.shape[:2]
    for box in sorted(detect(image) if detect else (), key=lambda b: -b["score"]):
        if box.get("points") is not None and (face := align(image, np.asarray(box["points"], float).reshape(5, 2), size)) is not None:
            return face, "aligned"
    boxes = list(fallback(image)) if fallback else []
    if boxes:
        x1, y1, x2, y2 = widened(max(boxes, key=lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])), w, h)
        if x2 > x1 and y2 > y1:
            return np.rint(resize(image[y1:y2, x1:x2], size, size)).astype(np.uint8), "box"
    return np.rint(resize(centre_crop(image), size, size)).astype(np.uint8), "centre"


def faces(images: DataFrame, decode: Callable[[bytes], np.ndarray], detector: Callable[[], Detector], size: int = FACE_SIZE) -> DataFrame:
    """``path, face, score, x1, y1, x2, y2, crop``: a row for every face of every image.

    ``images``: ``path, content``. ``crop`` has ``size * size * 3`` bytes, aligned where the
    detector gives points. An image without faces, or that cannot be read, gives no row.
    """

    def run(batches):
        made = Once(detector)
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    image = decode(content)
                    found = sorted(made()(image) if made() else (), key=lambda b: (-b["score"], b["x1"], b["y1"]))
                except Exception:
                    continue
                for k, box in enumerate(found):
                    crop = align(image, np.asarray(box["points"], float).reshape(5, 2), size) if box.get("points") is not None else None
                    if crop is None:
                        x1, y1, x2, y2 = widened(box, image.shape[1], image.shape[0], 0)
                        if x2 <= x1 or y2 <= y1:
                            continue
                        crop = np.rint(resize(image[y1:y2, x1:x2], size, size)).astype(np.uint8)
                    out.append((path, k, float(box["score"]), *(float(box[c]) for c in ("x1", "y1", "x2", "y2")), crop.tobytes()))
            yield pd.DataFrame(out, columns=["path", "face", "score", "x1", "y1", "x2", "y2", "crop"])

    return images.select("path", "content").mapInPandas(run, "path string, face int, score double, x1 double, y1 double, x2 double, y2 double, crop binary")


def aligned_faces(images: DataFrame, decode: Callable[[bytes], np.ndarray], detector: Callable[[], Detector] | None, fallback: Callable[[], Detector] | None = None, size: int = FACE_SIZE) -> DataFrame:
    """``path, found, crop``: one face for every image; ``found`` is aligned, box, centre or,
    for an image that cannot be read, null with a null crop."""

    def run(batches):
        first, second = Once(detector), Once(fallback)
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    face, found = aligned_face(decode(content), first(), second(), size)
                    out.append((path, found, face.tobytes()))
                except Exception:
                    out.append((path, None, None))
            yield pd.DataFrame(out, columns=["path", "found", "crop"])

    return images.select("path", "content").mapInPandas(run, "path string, found string, crop binary")


def portrait_vectors(images: DataFrame, decode: Callable[[bytes], np.ndarray], embed: Callable[[], Callable[[np.ndarray], np.ndarray]], dim: int, margin: float = PORTRAIT_MARGIN) -> DataFrame:
    """``path, embedding`` of prepared portraits: ``margin`` is cut from each side and the rest
    embedded. A failed image has the zero vector, which ``files.usable`` drops."""

    def run(batches):
        model = Once(embed)
        for pdf in batches:
            out = []
            for content in pdf["content"]:
                try:
                    v = np.asarray(model()(without_border(decode(content), margin)), float)
                    out.append((v / np.linalg.norm(v)).astype(np.float32).tolist() if np.linalg.norm(v) > 1e-10 else [0.0] * dim)
                except Exception:
                    out.append([0.0] * dim)
            yield pd.DataFrame({"path": pdf["path"], "embedding": out})

    return images.select("path", "content").mapInPandas(run, "path string, embedding array<float>")


def sniffed_columns(schema: StructType) -> tuple[str, str]:
    """Image and label column of a table of unknown names; fails before any row is read."""
    low = {f.name.lower(): f.name for f in schema.fields}
    found = [next((low[c] for c in wished if c in low), None) for wished in (IMAGE_COLUMNS, LABEL_COLUMNS)]
    if None in found:
        raise ValueError(f"no {'image' if found[0] is None else 'label'} column among {', '.join(schema.fieldNames())}")
    return found[0], found[1]


def attributes_of(age_gender: Column, emotion: Column) -> Column:
    """One struct of age, gender and emotion."""
    return F.struct(age_gender["age"].alias("age"), age_gender["gender"].alias("gender"), emotion["emotion"].alias("emotion"), emotion["confidence"].alias("emotion_confidence"))


def npy_image(content: bytes) -> np.ndarray:
    """A decoder for images kept as arrays."""
    return np.load(io.BytesIO(content), allow_pickle=False)

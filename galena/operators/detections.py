"""Face detections: anchor decoding, score filter, suppression, choice, alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Feature strides and anchors per cell of the detector; the 112 x 112 template
#: of eyes, nose and mouth corners that faces are aligned to.
STRIDES, ANCHORS, INPUT_SIZE = (8, 16, 32), 2, 640
TEMPLATE = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))
SCORE, OVERLAP = 0.5, 0.4


def decode_anchors(raw: DataFrame, scale: str = "scale") -> DataFrame:
    """Boxes from per-anchor distances.

    ``raw``: ``image, stride, anchor, score, left, top, right, bottom`` and the image's
    ``scale``, distances in strides, ``anchor`` counting cells row by row with two anchors
    each. Adds ``x1, y1, x2, y2`` in image coordinates. A column ``points`` of ten distances
    (x and y of five points, in strides) becomes ten coordinates.
    """
    cells = F.lit(INPUT_SIZE) / F.col("stride")
    cell = F.floor(F.col("anchor") / ANCHORS)
    x, y = (cell % cells) * F.col("stride"), F.floor(cell / cells) * F.col("stride")
    out = raw
    for name, centre, side, sign in (("x1", x, "left", -1), ("y1", y, "top", -1), ("x2", x, "right", 1), ("y2", y, "bottom", 1)):
        out = out.withColumn(name, (centre + sign * F.col(side) * F.col("stride")) / F.col(scale))
    if "points" in raw.columns:
        at = F.transform("points", lambda d, k: (F.when(k % 2 == 0, x).otherwise(y) + d * F.col("stride")) / F.col(scale))
        out = out.withColumn("points", at)
    return out


def confident(boxes: DataFrame, threshold: float = SCORE) -> DataFrame:
    return boxes.where(F.col("score") >= threshold)


def _suppressed(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, overlap: float) -> np.ndarray:
    """Places kept of boxes in order of falling score."""
    area = (x2 - x1 + 1) * (y2 - y1 + 1)
    alive, kept = np.ones(len(x1), bool), []
    for i in range(len(x1)):
        if alive[i]:
            kept.append(i)
            w = np.clip(np.minimum(x2[i], x2) - np.maximum(x1[i], x1) + 1, 0, None)
            h = np.clip(np.minimum(y2[i], y2) - np.maximum(y1[i], y1) + 1, 0, None)
            alive &= w * h / (area[i] + area - w * h) <= overlap
    return np.array(kept, np.int64)


def suppress(boxes: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """Greedy non-maximum suppression in each image: a box goes if it overlaps a better kept
    one by more than ``overlap``. Pixel-inclusive areas; equal scores in order of corners.

    Images are hashed to partitions and sorted there; a task walks through its images batch
    by batch and holds one image's boxes at a time.
    """
    order = [F.asc("image"), F.desc("score"), *(F.asc(c) for c in ("x1", "y1", "x2", "y2"))]
    ranged = boxes.repartition("image").sortWithinPartitions(*order)

    def walk(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            image = table.column("image").to_numpy()
            starts = np.flatnonzero(np.r_[True, image[1:] != image[:-1]]) if len(image) else np.zeros(0, np.int64)
            if len(starts):
                done, held = table.slice(0, starts[-1]), table.slice(starts[-1])
                yield from cut(done, starts)
        if held is not None:
            yield from cut(held, np.array([0, held.num_rows]))

    def cut(table, edges):
        if table.num_rows:
            corners = [table.column(c).to_numpy().astype(float) for c in ("x1", "y1", "x2", "y2")]
            keep = [a + _suppressed(*(c[a:b] for c in corners), overlap) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield from table.take(pa.array(np.concatenate(keep))).combine_chunks().to_batches()

    return ranged.mapInArrow(walk, boxes.schema)


def prominent(boxes: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """The box of each image that is largest and most central: area minus twice the squared
    distance of the centres. Of equals the leftmost, then topmost."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    weight = area - 2 * (F.pow(cx - F.col(width) / 2, 2) + F.pow(cy - F.col(height) / 2, 2))
    order = Window.partitionBy("image").orderBy(F.desc("prominence"), "x1", "y1")
    return boxes.withColumn("prominence", weight).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def letterbox(image: np.ndarray, size: int = INPUT_SIZE) -> tuple[np.ndarray, float]:
    """The image scaled to fit a square, padded with black at the right or bottom, and the
    scale; as model input ``(3, size, size)`` of (x - 127.5) / 128."""
    h, w = image.shape[:2]
    scale = min(size / w, size / h)
    small = resize(image, max(1, round(h * scale)), max(1, round(w * scale)))
    canvas = np.zeros((size, size, 3), np.float64)
    canvas[: small.shape[0], : small.shape[1]] = small
    return ((canvas - 127.5) / 128.0).transpose(2, 0, 1).astype(np.float32), scale


def _bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray, fill: float | None) -> np.ndarray:
    h, w = image.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = 0.0
    for dx in (0, 1):
        for dy in (0, 1):
            weight = (np.abs(1 - dx - (x - x0)) * np.abs(1 - dy - (y - y0)))[..., None]
            cx, cy = np.clip(x0 + dx, 0, w - 1), np.clip(y0 + dy, 0, h - 1)
            value = image[cy, cx].astype(np.float64)
            if fill is not None:
                outside = (x0 + dx < 0) | (x0 + dx >= w) | (y0 + dy < 0) | (y0 + dy >= h)
                value[outside] = fill
            out = out + weight * value
    return out


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resampling with pixel centres aligned."""
    h, w = image.shape[:2]
    y, x = np.meshgrid((np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5, indexing="ij")
    return _bilinear(image, np.clip(x, 0, w - 1), np.clip(y, 0, h - 1), None)


def centre_crop(image: np.ndarray) -> np.ndarray:
    h, w = image.shape[:2]
    side = min(h, w)
    top, left = (h - side) // 2, (w - side) // 2
    return image[top : top + side, left : left + side]


def similarity_transform(points: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """2 x 3 matrix of the least-squares rotation, scale and shift (closed form by SVD); None
    for points that all coincide."""
    points, target = np.asarray(points, float), np.asarray(target, float)
    a, b = points - points.mean(0), target - target.mean(0)
    spread = (a**2).sum()
    if spread < 1e-12:
        return None
    u, s, vt = np.linalg.svd(b.T @ a)
    flip = np.diag([1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    linear = (s @ np.diag(flip)) / spread * (u @ flip @ vt)
    return np.c_[linear, target.mean(0) - linear @ points.mean(0)]


def robust_transform(points: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """The similarity that two of the points fix and that has the least median of squared
    distances over all, fitted again to the points near it; one bad point does not bend it.
    """
    points, target = np.asarray(points, float), np.asarray(target, float)
    best, least = None, np.inf
    for i in range(len(points)):
        for j in range(i):
            matrix = similarity_transform(points[[i, j]], target[[i, j]])
            if matrix is not None:
                miss = (((points @ matrix[:, :2].T + matrix[:, 2]) - target) ** 2).sum(1)
                if (middle := float(np.median(miss))) < least - 1e-12:
                    best, least = miss, middle
    if best is None:
        return None
    spread = 2.5 * 1.4826 * (1 + 5 / max(1, len(points) - 2)) * np.sqrt(least)
    near = best <= max(spread**2, 1e-9)
    return similarity_transform(points[near], target[near]) if near.sum() >= 2 else None


def align(image: np.ndarray, landmarks: np.ndarray, size: int = 112) -> np.ndarray | None:
    """The face warped to the template, black outside the image; None if degenerate."""
    matrix = robust_transform(landmarks, np.array(TEMPLATE))
    if matrix is None or abs(np.linalg.det(matrix[:, :2])) < 1e-12:
        return None
    back = np.linalg.inv(matrix[:, :2])
    y, x = np.meshgrid(np.arange(size, dtype=float), np.arange(size, dtype=float), indexing="ij")
    source = np.stack([x - matrix[0, 2], y - matrix[1, 2]], -1) @ back.T
    return np.clip(np.rint(_bilinear(image, source[..., 0], source[..., 1], 0.0)), 0, 255).astype(np.uint8)


def preprocess(image: np.ndarray, size: int = 112) -> np.ndarray:
    """``(3, size, size)`` of (x - 127.5) / 127.5."""
    return ((resize(image, size, size) - 127.5) / 127.5).transpose(2, 0, 1).astype(np.float32)

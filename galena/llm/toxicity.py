"""Toxicity by compression distance: a zstandard dictionary for each class of text."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm._common import checkpointed, numbered, small_batches

#: Labelled rows that the dictionaries and the calibration are fitted on at most, by class,
#: and bytes of whole texts that the dictionaries of a class are trained on at most.
SAMPLE_TOXIC, SAMPLE_ORDINARY, FIT_BYTES = 4_000, 8_000, 6 << 20
#: A score of at least this says toxic; calibration moves the best threshold here.
THRESHOLD = 0.3
#: Words of a window, and from one window to the next.
WINDOW_WORDS, STEP = 16, 8
#: Parts of the sample; the features that calibrate a part come from dictionaries trained on
#: the others.
FOLDS = 5
#: Bytes of ordinary text that both dictionaries end with, and of the trained content before
#: it that sets them apart.
COMMON_BYTES, TRAINED_BYTES = 2 << 20, 16 << 10
#: Words of a training sample, bytes of a trained segment and of the strings it is made for.
SAMPLE_WORDS, SEGMENT, STRING = 2, 16, 8
#: Training samples of a class at most.
SAMPLES = 200_000
LEVEL, LEAST_MATCH = 5, 3
#: Bytes of gain from which a window counts.
MARGINS = (1, 2, 4)

_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _LETTERS.findall(text.lower())


def windows(found: list[str], size: int = WINDOW_WORDS, step: int = STEP) -> list[bytes]:
    """Windows of ``size`` words, one each ``step`` words, which cover the whole text.

    A text of fewer words is repeated up to a window's size, as zstandard stores what is too
    short as it is; the copies cost the same under any dictionary.
    """
    if 0 < len(found) < size:
        found = found * -(-size // len(found))
        step = len(found)
    last = max(1, len(found) - size + step) if found else 0
    return [(" " + " ".join(found[k : k + size]) + " ").encode("utf-8", "surrogatepass") for k in range(0, last, step)]


def compressor(content: bytes):
    """A function that gives a window's length under a dictionary of ``content``."""
    data = zstandard.ZstdCompressionDict(content + b"\n" * 16, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=256, dict_size=len(content), min_match=LEAST_MATCH, write_content_size=False, write_dict_id=False, write_checksum=False)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=how).compress


@dataclass
class CompressionModel:
    """Content of both dictionaries and the calibration.

    Either dictionary is its own trained content followed by the ordinary text that both
    have, so that what is common to both classes compresses alike and only content that was
    learned from one class makes lengths differ.
    """

    common: bytes
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] = (-3.0, *[0.0] * (2 * len(MARGINS) + 1))

    def __post_init__(self):
        self._lengths = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_lengths"}

    def __setstate__(self, state):
        self.__dict__.update(state, _lengths=None)

    def gains(self, text: str) -> np.ndarray:
        """For each window, the bytes by which the toxic dictionary compresses it better."""
        if not self.toxic:
            return np.zeros(0, np.int64)
        if self._lengths is None:
            self._lengths = [compressor(own + self.common) for own in (self.ordinary, self.toxic)]
        ordinary, toxic = self._lengths
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(words(text))], np.int64)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-(features(self.gains(text)) @ np.array(self.weights)))))


def features(gains: np.ndarray) -> np.ndarray:
    """Windows of at least each margin of gain, as a number and as a share, and their mean."""
    out = [1.0]
    for margin in MARGINS:
        hits = int((gains >= margin).sum())
        out += [np.log1p(hits), np.log1p(100 * hits / (len(gains) + 5))]
    return np.array([*out, gains.sum() / (len(gains) + 5)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 40) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression (Newton's method)."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def calibrate(model: CompressionModel, labels: np.ndarray, x: np.ndarray) -> CompressionModel:
    """Fit the weights, and shift the scores so that the threshold of the best F1 falls on
    ``THRESHOLD``."""
    if not len(labels) or labels.min() == labels.max():
        return model
    w = logistic(x, labels)
    z = x @ w
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(labels[order])
    last = np.r_[z[order][1:] != z[order][:-1], True]
    f1 = np.where(last, 2 * hits / (np.arange(1, len(z) + 1) + labels.sum()), 0)
    best = int(np.argmax(f1))
    lower = z[order][best + 1] if best + 1 < len(z) else z[order][best] - 1
    w[0] += np.log(THRESHOLD / (1 - THRESHOLD)) - (z[order][best] + lower) / 2
    model.weights = tuple(float(v) for v in w)
    return model


def trained(samples: list[bytes], size: int = TRAINED_BYTES) -> bytes:
    """Content that zstandard's trainer picks from ``samples``; all of them where they fit."""
    if sum(map(len, samples)) <= size:
        return b"".join(samples)
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=STRING).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer
        return b"".join(samples)[:size]


def train(ordinary: Iterable[str], toxic: Iterable[str]) -> CompressionModel:
    """Train both dictionaries.

    Every second ordinary text gives the common content, up to ``COMMON_BYTES``. The others,
    and the toxic texts, give the samples of the two trained parts: what the common content
    does not hold, in strings of a few words. Repeated strings teach once.
    """
    common: dict[bytes, None] = {}
    rest, size = [], 0
    for number, text in enumerate(ordinary):
        if number % 2 == 0 and size < COMMON_BYTES:
            for w in windows(words(text), step=WINDOW_WORDS):
                if w not in common:
                    common[w] = None
                    size += len(w)
        else:
            rest.append(text)
    shared = b"".join(common)[-COMMON_BYTES:]
    known = set(shared.decode("utf-8", "ignore").split())

    def samples(texts: Iterable[str]) -> list[bytes]:
        out: dict[bytes, None] = {}
        for text in texts:
            new = [w for w in words(text) if w not in known]
            out.update(dict.fromkeys((" " + " ".join(new[k : k + SAMPLE_WORDS]) + " ").encode("utf-8", "surrogatepass") for k in range(0, len(new), SAMPLE_WORDS)))
        return list(out)[:SAMPLES]

    return CompressionModel(shared, trained(samples(rest)), trained(samples(toxic)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", training: Column | None = None) -> CompressionModel:
    """Train dictionaries and calibrate on a bounded sample of labelled rows.

    At most ``SAMPLE_TOXIC`` and ``SAMPLE_ORDINARY`` ids are drawn by hash order from the
    labels that ``training`` (a condition on ``doc_id``) admits. Up to ``FIT_BYTES`` of whole
    texts a class train the dictionaries on the driver. The calibration uses all drawn rows,
    where their texts are: those of a fold are measured with dictionaries that were trained
    without it, and the weights go with dictionaries trained on all folds. Rows without label
    or id teach nothing, a null text is empty, of an id with several labels the largest
    counts. Without labels of both classes, or from empty tables, every score is the same.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if training is not None:
        known = known.where(training)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id", F.lit(11))
    drawn = [known.where(F.col("label") == c).orderBy(order).limit(size) for c, size in ((0, SAMPLE_ORDINARY), (1, SAMPLE_TOXIC))]
    drawn = drawn[0].unionByName(drawn[1]).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(FOLDS)).cast("int"))
    sample = checkpointed(numbered(docs, id_col, text_col).join(F.broadcast(drawn), "doc_id").select("doc_id", "label", "fold", "body", order.alias("at")))

    left = {0: FIT_BYTES, 1: FIT_BYTES}
    chosen = []
    for row in sample.select("doc_id", "label", F.octet_length("body").alias("size"), "at").orderBy("at", "size").collect():
        left[row["label"]] -= row["size"]
        if left[row["label"]] >= 0:
            chosen.append((row["doc_id"],))
    fit = F.broadcast(spark.createDataFrame(chosen, "doc_id long").distinct())
    taught = sample.join(fit, "doc_id").select("label", "fold", "body", "at").toArrow().sort_by([("at", "ascending"), ("body", "ascending")])
    rows = list(zip(*(taught.column(c).to_pylist() for c in ("label", "fold", "body")), strict=True))

    def trained_without(fold: int | None) -> CompressionModel:
        return train(*([t for y, f, t in rows if y == label and f != fold] for label in (0, 1)))

    models = [trained_without(fold) for fold in range(FOLDS)]

    def measure(batches):
        for batch in batches:
            got = [features(models[fold].gains(t.as_py())).tolist() for fold, t in zip(batch.column("fold").to_pylist(), batch.column("body"), strict=True)]
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "x": pa.array(got, pa.list_(pa.float64()))})

    got = sample.select("label", "fold", "body").mapInArrow(measure, "label int, x array<double>").toArrow()
    model = trained_without(None)
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(model.weights))
    return calibrate(model, got.column("label").to_numpy().astype(float), x)


def score_column(model: CompressionModel):
    """A pandas UDF: text to score; a null text scores as the empty text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t or "") for t in texts], dtype=float)

    return score


def score_toxicity(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of every row and whole text.

    A null or empty text scores what no evidence scores; a null id stays null; repeated rows
    are scored each; an empty table gives no rows; other columns are not read. Rows do not
    depend on one another: nothing is shuffled.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            score = [model.score(t.as_py()) for t in batch.column("body")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(score, pa.float64()), "predicted": pa.array([int(s >= threshold) for s in score], pa.int32())})

    return numbered(docs, id_col, text_col).select("doc_id", "body").mapInArrow(run, "doc_id long, score double, predicted int")

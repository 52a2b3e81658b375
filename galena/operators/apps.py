"""Application queries: duplicates, grouping by person, attendance, alerts, timelines."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.operators.components import components
from galena.operators.search import exact_topk


def duplicate_pairs(gallery: DataFrame, threshold: float = 0.6, k: int = 5, hits: DataFrame | None = None) -> DataFrame:
    """``id_a, id_b, confidence`` of rows among one another's ``k`` nearest.

    Each row is searched with itself in the gallery, which takes one of the ``k`` places. A
    pair is kept once, if either side lists the other. ``hits`` may come from any search
    operator; the exact one is the default.
    """
    queries = gallery.select(F.col("id").alias("query_id"), "embedding")
    found = exact_topk(queries, gallery, k) if hits is None else hits
    other = found.where((F.col("query_id") != F.col("id")) & (F.col("similarity") >= threshold))
    pairs = other.select(F.least("query_id", "id").alias("id_a"), F.greatest("query_id", "id").alias("id_b"), F.round("similarity", 4).alias("confidence"))
    return pairs.groupBy("id_a", "id_b").agg(F.max("confidence").alias("confidence"))


def organise_by_person(photos: DataFrame, threshold: float = 0.45, order: str = "path") -> DataFrame:
    """``id, person``: greedy grouping in the order of ``order``.

    Each photo takes the person of the most similar earlier photo at or above the threshold,
    else starts ``Person_001``, ``Person_002`` and so on. The outcome depends on the order, so
    this runs in one task, in batches against a matrix of what came before; ``person_graph``
    is the distributed relative, which gives another answer.
    """
    kept = photos.select("id", order, "embedding").withColumn("whole", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "id"], kind="stable")
        vectors = np.array(pdf["embedding"].tolist(), np.float64).reshape(len(pdf), -1)
        person, n = np.zeros(len(pdf), np.int64), 0
        for i in range(len(pdf)):
            near = vectors[:i] @ vectors[i]
            if i and near.max() >= threshold:
                person[i] = person[int(near.argmax())]
            else:
                n += 1
                person[i] = n
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "person": [f"Person_{p:03d}" for p in person]})

    return kept.groupBy("whole").applyInPandas(run, "id long, person string")


def person_graph(pairs: DataFrame, gallery: DataFrame) -> DataFrame:
    """``id, person_id``: least id reachable over ``id_a, id_b`` links. Not the greedy
    grouping: chains of links join whatever the order, and of any length."""
    found = components(pairs.select(F.col("id_a").cast("long").alias("u"), F.col("id_b").cast("long").alias("v")))
    return gallery.select("id").join(found, F.col("id") == F.col("vertex"), "left").select("id", F.coalesce("component", "id").alias("person_id"))


def with_cooldown(events: DataFrame, key: str, ts: str, seconds: float, tie: str | None = None) -> DataFrame:
    """Events that a greedy cooldown lets through: the first of a key, then each that comes
    more than ``seconds`` after the last one let through.

    Not a window: a dropped event does not prolong the wait. Keys are hashed to partitions and
    sorted there by time; a task walks through its events batch by batch and remembers one
    time. Events without a time are left out; those without a key share one.
    """
    wait = int(seconds * 1_000_000)
    columns = [F.col(key), *([F.col(tie)] if tie else []), F.col(ts).cast("timestamp").alias(ts)]
    rows = events.select(*columns, F.unix_micros(F.col(ts).cast("timestamp")).alias("at_micros")).where("at_micros is not null")
    ordered = rows.repartition(F.col(key)).sortWithinPartitions(key, "at_micros", *([tie] if tie else []))

    def walk(batches):
        now, last = None, None
        for batch in batches:
            keep = []
            for own, t in zip(batch.column(key).to_pylist(), batch.column("at_micros").to_pylist(), strict=True):
                passes = last is None or own != now or t - last > wait
                keep.append(passes)
                if passes:
                    now, last = own, t
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(walk, ordered.schema).drop("at_micros")


def attendance_log(arrivals: DataFrame) -> DataFrame:
    """CSV rows ``name, timestamp, confidence``, times to the second, 3 decimals."""
    return arrivals.select("name", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.format_string("%.3f", F.col("confidence").cast("double")).alias("confidence"))


def numbered_alerts(alerts: DataFrame, key: str, ts: str) -> DataFrame:
    """Alerts with their number within the key."""
    return alerts.withColumn("alert_no", F.row_number().over(Window.partitionBy(key).orderBy(ts)).cast("long"))


def sampled_frames(frames: DataFrame, every: int, frame: str = "frame") -> DataFrame:
    if every < 1:
        raise ValueError("every must be at least 1")
    return frames.where(F.col(frame) % every == 0)


def hms(seconds: Column) -> Column:
    """``HH:MM:SS`` of whole seconds; hours may exceed 24."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)


def video_detections(hits: DataFrame, fps: float, threshold: float = 0.45) -> DataFrame:
    """``frame, name, time, seconds, confidence`` of hits (``query_id`` is the frame)."""
    seconds = F.col("query_id") / F.lit(float(fps))
    return hits.where(F.col("similarity") >= threshold).select(F.col("query_id").alias("frame"), F.col("label").alias("name"), hms(seconds).alias("time"), F.round(seconds, 1).alias("seconds"), F.round("similarity", 3).alias("confidence"))


def timeline(detections: DataFrame, name: str = "name", at: str = "seconds") -> DataFrame:
    """``name, first_seen, last_seen, appearances``."""
    return detections.groupBy(F.col(name).alias("name")).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("appearances"))


def held_results(frames: DataFrame, camera: str, frame: str, result: str, every: int = 5) -> DataFrame:
    """The last result on every frame: searched frames have one, the others repeat it."""
    own = F.when(F.col(frame) % every == 0, F.col(result))
    before = Window.partitionBy(camera).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("shown", F.last(own, ignorenulls=True).over(before))


def person_folders(photos: DataFrame, people: DataFrame, root: str) -> DataFrame:
    """A manifest ``src, dst`` for copying photos into a folder per person."""
    return photos.join(people, "id").select(F.col("path").alias("src"), F.concat_ws("/", F.lit(root), "person", F.element_at(F.split("path", "/"), -1)).alias("dst"))

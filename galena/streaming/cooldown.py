"""Greedy cooldown per key on a stream, with state that survives restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def cooldown_stream(events: DataFrame, key: str, ts: str, seconds: float, lateness: str = "10 minutes") -> DataFrame:
    """``key, ts`` of the events of a stream that a greedy cooldown lets through.

    Events wait in state until the watermark has passed them, and are then folded in order of
    time, so arrival order across micro-batches does not change the outcome. Later ones than
    ``lateness`` are dropped by the watermark. ``key`` is cast to string, ``ts`` to
    TIMESTAMP. The events still waiting when a stream ends come out once time moves on.
    """
    stream = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")).where("key is not null and ts is not null")

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        waiting = list(waiting)
        for pdf in batches:
            waiting += (pdf["ts"].astype("int64") // 1000).tolist() if str(pdf["ts"].dtype).endswith("[ns]") or "ns" in str(pdf["ts"].dtype) else pdf["ts"].astype("int64").tolist()
        mark = state.getCurrentWatermarkMs() * 1000
        out = []
        for t in sorted(t for t in waiting if t <= mark):
            if last is None or t - last > seconds * 1_000_000:
                out.append(t)
                last = t
        waiting = [t for t in waiting if t > mark]
        state.update((last, waiting))
        if waiting:
            state.setTimeoutTimestamp(min(waiting) // 1000 + 1)
        if out:
            yield pd.DataFrame({"key": group[0], "ts": pd.to_datetime(out, unit="us")})

    return stream.withWatermark("ts", lateness).groupBy("key").applyInPandasWithState(fold, "key string, ts timestamp", "last long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, key: str, ts: str, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """Session windows per key, emitted once the watermark closes them."""
    stream = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    if stream.isStreaming:
        stream = stream.withWatermark("ts", lateness)
    return stream.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def identify_stream(frames: DataFrame, gallery: DataFrame, threshold: float = 0.4, every: int = 1) -> DataFrame:
    """``frame, ts, id, label, similarity``: the best gallery hit of each sampled frame.

    A stream-static join: each micro-batch's frames meet the gallery's partitions and keep
    their best hit by aggregation. For galleries too large to scan per batch, use
    ``foreachBatch`` with the two-stage search.
    """
    from galena.functions.vectors import dot

    asked = frames.where(F.col("frame") % every == 0).select("frame", "ts", F.col("embedding").alias("q"))
    scored = asked.crossJoin(gallery.select("id", "label", "embedding")).select("frame", "ts", "id", "label", dot("q", "embedding").alias("similarity"))
    best = scored.groupBy("frame", "ts").agg(F.max(F.struct("similarity", (-F.col("id")).alias("n"), "label")).alias("b"))
    return best.where(F.col("b.similarity") >= threshold).select("frame", "ts", (-F.col("b.n")).alias("id"), F.col("b.label").alias("label"), F.col("b.similarity").alias("similarity"))

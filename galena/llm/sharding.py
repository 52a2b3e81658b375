"""Sharding by sampled splitters: weighted quantile boundaries and packed ranges."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galena.llm._common import checkpointed, numbered

#: Ranges per shard, at least and at most, and bytes that a range has between them. A task
#: sorts a range, and the driver packs them.
RANGES, MOST_RANGES, RANGE_BYTES = 64, 8192, 256 << 20
#: Keys sampled per range on average. It bounds what the driver sorts.
SAMPLES = 32
#: A range of more than this many times its share is subdivided.
OVERFULL = 3
#: Times that overfull ranges are subdivided at most; a row is never cut. Each time divides a
#: range by its share of a sample of its own, so sizes fall fast; that many rounds without an
#: end would be an error of the sample.
ROUNDS = 20


def weighted_splitters(keys: np.ndarray, subs: np.ndarray, weights: np.ndarray, parts: int) -> list[tuple[int, int]]:
    """At most ``parts - 1`` boundaries ``(key, sub)`` at quantiles of the sampled weight."""
    if not len(keys) or parts < 2:
        return []
    order = np.lexsort((subs, keys))
    keys, subs, filled = keys[order], subs[order], np.cumsum(weights[order])
    at = np.searchsorted(filled, filled[-1] * np.arange(1, parts) / parts)
    return sorted({(int(keys[i]), int(subs[i])) for i in at})


def whole_keys(splitters: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Move boundaries to the start of their key, unless one key holds several of them.

    A key with several boundaries is a hot group: it gets a range of its own, which stays
    subdivided. All other keys stay whole.
    """
    low = -(1 << 63)
    by_key: dict[int, list[int]] = {}
    for key, sub in splitters:
        by_key.setdefault(key, []).append(sub)
    out = set()
    for key, subs in by_key.items():
        out.add((key, low))
        if len(subs) > 1:
            out.update((key, s) for s in subs)
            if key < (1 << 63) - 1:
                out.add((key + 1, low))
    return sorted(out)


def _range_of(splitters: list[tuple[int, int]]):
    """Arrow function that appends ``range``: the number of boundaries at or below a row."""
    keys = np.array([k for k, _ in splitters], np.int64)
    subs = np.array([s for _, s in splitters], np.int64)

    def run(batches):
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            found = low.copy()
            for a, b in {(int(a), int(b)) for a, b in zip(low[low < high], high[low < high], strict=True)}:
                rows = np.flatnonzero((low == a) & (high == b))
                found[rows] = a + np.searchsorted(subs[a:b], batch.column("sub").to_numpy(zero_copy_only=False)[rows], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "range"])

    return run


def _sample(rows: DataFrame, bytes_per_sample: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys drawn with chance size / bytes_per_sample, and the bytes that each stands for."""
    chance = F.least(F.lit(1.0), F.col("size") / F.lit(float(bytes_per_sample)))
    draw = F.pmod(F.xxhash64("key", "sub", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    got = rows.where(draw < chance).select("key", "sub", (F.col("size") / chance).alias("weight")).toArrow()
    return tuple(got.column(c).to_numpy() for c in ("key", "sub", "weight"))


def pack_ranges(sizes: list[tuple[int, int, int]], groups: dict[int, int], shards: int) -> dict[int, int]:
    """Shard of each range: largest unit first, into the shard with the fewest bytes.

    ``sizes``: ``(range, bytes, rows)``. Ranges that ``groups`` maps to one number hold one
    hot group and stay together, unless they are more than half a shard.
    """
    total = sum(b for _, b, _ in sizes)
    units: dict = {}
    for number, size, _ in sizes:
        units.setdefault(("group", groups[number]) if number in groups else ("range", number), []).append((number, size))
    parts = []
    for unit in units.values():
        whole = sum(b for _, b in unit)
        parts += [(whole, [n for n, _ in unit])] if whole * 2 * shards <= total else [(b, [n]) for n, b in unit]
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, numbers in sorted(parts, key=lambda p: (-p[0], p[1])):
        filled, shard = heapq.heappop(heap)
        out.update(dict.fromkeys(numbers, shard))
        heapq.heappush(heap, (filled + size, shard))
    return out


def ranges_for(total: int, shards: int) -> int:
    return min(MOST_RANGES, max(RANGES, -(-total // (shards * RANGE_BYTES))))


def shard_by_splitters(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int | None = None, seed: int = 7) -> DataFrame:
    """Put every row into a shard so that the shards' bytes are near equal.

    Rows are ordered by ``(key, sub)``: a hash of the text and one of the row. A size-weighted
    sample of keys gives quantile boundaries; ranges that turn out overfull are subdivided by
    a sample of their own rows; the ranges' true sizes, a few thousand numbers, are packed
    into shards on the driver. There are more ranges the more bytes there are, up to
    ``MOST_RANGES`` a shard. Equal texts share a key and thus a shard, except where one
    group exceeds half a shard: then its ranges are dealt out.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per input
    row; ``size`` is the text's UTF-8 bytes plus 1 (a null text has none), ``slot`` counts
    from 0 without gaps in each shard, ``law`` is ``bytes`` and ``grown_shard`` null. Null
    ids are kept as null; repeated rows get a slot each; an empty table gives no rows; other
    columns are not read.
    """
    rows = numbered(docs, id_col, text_col).select(
        "rid",
        "doc_id",
        (F.octet_length("body") + 1).cast("long").alias("size"),
        F.crc32(F.col("body").cast("binary")).alias("text_crc32"),
        F.xxhash64("body").alias("key"),
        F.xxhash64("doc_id", "rid").alias("sub"),
    )
    rows = checkpointed(rows)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = shards * (ranges_per_shard or ranges_for(total, shards))
    splitters = whole_keys(weighted_splitters(*_sample(rows, max(1.0, total / (parts * SAMPLES)), seed), parts))
    for turn in range(ROUNDS):
        dealt = rows.mapInArrow(_range_of(splitters), f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, range long")
        sizes = [tuple(r) for r in dealt.groupBy("range").agg(F.sum("size"), F.count(F.lit(1)), F.min("key"), F.max("key"), F.max("size")).collect()]
        over = {r: b for r, b, n, _, _, largest in sizes if n > 1 and b > OVERFULL * total / parts and b > 2 * largest}
        if not over:
            break
        if turn == ROUNDS - 1:
            raise RuntimeError("overfull ranges were not subdivided")
        inner = dealt.where(F.col("range").isin(list(over)))
        keys, subs, weights = _sample(inner, max(1.0, total / (parts * SAMPLES)), seed + turn + 1)
        more = weighted_splitters(keys, subs, weights, int(sum(over.values()) * parts / total) + 2)
        grown = sorted(set(splitters) | set(whole_keys(more)))
        if grown == splitters:
            break
        splitters = grown
    hot = {r: low for r, _, _, low, high, _ in sizes if low == high}
    many = [k for k in set(hot.values()) if sum(v == k for v in hot.values()) > 1]
    home = pack_ranges([(r, b, n) for r, b, n, *_ in sizes], {r: k for r, k in hot.items() if k in many}, shards)
    first, seen = {}, dict.fromkeys(range(shards), 0)
    for number, _, n, *_ in sorted(sizes):
        first[number] = seen[home[number]]
        seen[home[number]] += n
    place = docs.sparkSession.createDataFrame([(r, home[r], first[r]) for r in home], "range long, shard int, first long")
    slots = F.row_number().over(Window.partitionBy("range").orderBy("key", "sub", "rid"))
    return dealt.withColumn("at", slots).join(F.broadcast(place), "range").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

"""Repeated byte windows by a radix sort of suffixes, limited to the windows' depth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm._common import TEXT_KEY, checkpointed, first_of_each, id_bitmap, mixed, numbered, small_batches, without_repeats
from galena.llm._exchange import PACKETS, answered, buckets_for, packets, totals

#: Starts of windows that are hashed at once; longer texts are cut into overlapping tiles.
TILE = 1 << 18
#: Text bytes of one block of candidate documents.
BLOCK_BYTES = 4 << 20
ROUTE_BITS = 1 << 23
#: Suffixes that one task orders, on average.
BUCKET_SUFFIXES = 1 << 18
#: Places of an anchor whose runs are ordered in one task; those of a more frequent one are
#: told apart by hashes of whole windows, any number of which can be totalled.
ORDERED_PLACES = 4096

_RNG = np.random.default_rng(20240)
_TABLES = _RNG.integers(0, 1 << 63, (3, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo 2**64 and of its inverse."""
    size = max(TILE + 1024, n)
    if (which, size) not in _powers:
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _powers[which, size] = tuple(out)
    return _powers[which, size]


def window_hashes(data: np.ndarray, width: int, which: int) -> np.ndarray:
    """A 64-bit hash of ``data[p : p + width]`` for each start ``p``."""
    up, down = _power_tables(which, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[which][data] * up[: len(data)], out=total[1:])
    return mixed((total[width:] - total[:-width]) * down[: len(data) - width + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in turn (two passes over blocks of ``width``)."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def tiles(data: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(start, bytes)``: all windows of ``width`` bytes, each in one tile."""
    for start in range(0, len(data) - width + 1, TILE):
        yield start, data[start : start + TILE + width - 1]


def anchors(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a tile, its anchor's hash and place.

    The anchor is the gram of least hash among the window's grams of half its width; equal
    windows have equal anchors at equal distances from their starts.
    """
    gram = width // 2
    hashes = window_hashes(data, gram, 0)
    low = np.uint64(max(1, int(len(hashes)).bit_length()))
    place = np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min(((hashes >> low) << low) | place, width - gram + 1)
    at = (least & np.uint64((1 << int(low)) - 1)).astype(np.int64)
    return hashes[at], at


def runs(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of successive windows with one anchor: its hash, the first start, how far the
    anchor stands from it, and the number of windows."""
    found = []
    for start, tile in tiles(data, width):
        hashes, at = anchors(tile, width)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        found.append((hashes[first], first + start, at[first] - first, np.diff(np.r_[first, len(at)])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _ranks(data: np.ndarray, width: int) -> dict[int, np.ndarray]:
    """For each power of two up to ``width``, equal numbers for equal strings of that many
    bytes at each place of ``data`` (exact: a longer one is the pair of its halves)."""
    out = {1: data.astype(np.uint64)}
    size = 1
    while 2 * size <= width:
        half = out[size]
        if size < 8:
            pair = (half[:-size] << np.uint64(8 * size)) | half[size:]
        else:
            if size == 8:
                half = np.unique(half, return_inverse=True)[1].astype(np.uint64)
            _, pair = np.unique((half[:-size] << np.uint64(32)) | half[size:], return_inverse=True)
            pair = pair.astype(np.uint64)
        size *= 2
        out[size] = pair
    return out


def _digits(width: int) -> list[tuple[int, int]]:
    """Depth and size of each pass's digit: 8 bytes, then as many as are settled already."""
    out, depth = [], 0
    while depth < width:
        size = 1 << (min(max(depth, 8), width - depth).bit_length() - 1)
        out.append((depth, size))
        depth += size
    return out


def repeated_suffixes(data: np.ndarray, starts: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Which of the suffixes at ``starts`` share their first ``width`` bytes with another of
    the same ``group``.

    A most-significant-digit radix sort: each pass orders the suffixes of a group by their
    next digit and splits it; a suffix that is alone leaves, and none is read beyond
    ``width``. The groups that remain are the repeated windows, byte for byte.
    """
    left = np.arange(len(starts))
    ranks = _ranks(data, width) if len(starts) else {}
    group = np.unique(group, return_inverse=True)[1].astype(np.uint64)
    for depth, size in _digits(width):
        if not len(left):
            break
        digit = ranks[size][starts[left] + depth]
        order = np.lexsort((digit, group))
        left, group, digit = left[order], group[order], digit[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]
        number = np.cumsum(new) - 1
        many = np.bincount(number)[number] > 1
        left, group = left[many], number[many].astype(np.uint64)
    out = np.zeros(len(starts), bool)
    out[left] = True
    return out


def covered_runs(starts: np.ndarray, n: int, width: int) -> tuple[np.ndarray, int]:
    """A mask of the bytes that windows at ``starts`` cover, and its number of runs."""
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1
    edge[starts + width] -= 1
    mask = np.cumsum(edge[:-1]) > 0
    return mask, int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if n else 0


def _block_rows(block: int, keys: list[tuple[int, int]], texts: list[bytes], shared: list[np.ndarray], frequent: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.array([[*k, len(t), len(d)] for k, t, d in zip(keys, texts, shared, strict=True)], "<i8")
    raw = b"".join(x.tobytes() for x in (np.array([len(keys)], "<i8"), sizes, np.concatenate(shared).astype("<i8"), np.concatenate(frequent).astype("<i8"))) + b"".join(texts)
    return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "payload": pa.array([zstandard.ZstdCompressor(level=1).compress(raw)], pa.binary())})


def _read_block(payload: bytes) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]]:
    """Key, bytes, shared anchors and whether each is frequent, of every text."""
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", 4 * n, 8).reshape(n, 4)
    total = int(sizes[:, 3].sum())
    shared, frequent = np.frombuffer(raw, "<i8", 2 * total, 8 + 32 * n).reshape(2, total)
    at, at_text = 0, 8 + 32 * n + 16 * total
    for key_a, key_b, size, digits in sizes.tolist():
        yield (key_a, key_b), np.frombuffer(raw, np.uint8, size, at_text), shared[at : at + digits], frequent[at : at + digits]
        at_text += size
        at += digits


class Candidates:
    """The candidate windows of a block of texts, in an order that a second reading repeats.

    ``segments`` maps each different ``(anchor, distance, bytes)`` of a run to its number and
    ``counts`` says how often it occurs here; ``spans`` has ``(text, first start, number)`` of
    every run. Windows of frequent anchors are ``starts`` with two hashes each.
    """

    def __init__(self, payload: bytes, width: int):
        self.texts, self.segments, self.counts, self.spans = [], {}, [], []
        at, first, second = [], [], []
        for number, (key, data, shared, frequent) in enumerate(_read_block(payload)):
            self.texts.append((key, data))
            anchor, start, distance, n = runs(data, width)
            own = np.flatnonzero(np.isin(anchor.view(np.int64), shared))
            often = np.isin(anchor[own].view(np.int64), shared[frequent > 0])
            raw = data.tobytes()
            cold = own[~often]
            for a, s, d, m in zip(anchor[cold].tolist(), start[cold].tolist(), distance[cold].tolist(), n[cold].tolist(), strict=True):
                segment = (a, d, raw[s : s + m + width - 1])
                k = self.segments.setdefault(segment, len(self.counts))
                if k == len(self.counts):
                    self.counts.append(0)
                self.counts[k] += 1
                self.spans.append((number, s, k))
            hot = own[often]
            if len(hot):
                starts = np.concatenate([np.arange(s, s + m) for s, m in zip(start[hot].tolist(), n[hot].tolist(), strict=True)])
                at.append(np.stack([np.full(len(starts), number), starts], 1))
                for which, out in ((1, first), (2, second)):
                    hashed = [(low, window_hashes(tile, width, which)) for low, tile in tiles(data, width)]
                    out.append(np.concatenate([h for _, h in hashed])[starts])
        self.places = np.concatenate(at) if at else np.zeros((0, 2), np.int64)
        self.first, self.second = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (first, second))

    def keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of the windows of frequent anchors, their buckets and counts, and
        the place of each window among them."""
        every, first, where, counts = np.unique(self.first, return_index=True, return_inverse=True, return_counts=True)
        return every, (self.second[first] % np.uint64(buckets)).astype(np.int64), counts, where

    def bucketed(self, buckets: int) -> dict[int, list[int]]:
        """Numbers of the segments that go to each bucket."""
        anchor = np.fromiter((a for a, _, _ in self.segments), np.uint64, len(self.segments))
        out: dict[int, list[int]] = {}
        for k, bucket in enumerate((mixed(anchor) % np.uint64(buckets)).astype(np.int64).tolist()):
            out.setdefault(bucket, []).append(k)
        return out


def _pack_segments(segments: list[tuple[int, int, bytes]], counts: list[int]) -> bytes:
    head = np.array([[a, d, len(b), c] for (a, d, b), c in zip(segments, counts, strict=True)], "<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(segments)], "<u8").tobytes() + head.tobytes() + b"".join(b for _, _, b in segments))


def _unpack_segments(payload: bytes) -> list[tuple[tuple[int, int, bytes], int]]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    out, at = [], 8 + 32 * n
    for a, d, size, count in np.frombuffer(raw, "<u8", 4 * n, 8).reshape(n, 4).tolist():
        out.append(((a, d, raw[at : at + size]), count))
        at += size
    return out


def repeated_in(packed: list[bytes], width: int) -> list[list[np.ndarray]]:
    """For each packet, for each of its segments, which of its windows occur elsewhere too."""
    every: dict[tuple[int, int, bytes], int] = {}
    totals: list[int] = []
    places = []
    for payload in packed:
        own = []
        for segment, count in _unpack_segments(payload):
            k = every.setdefault(segment, len(totals))
            if k == len(totals):
                totals.append(0)
            totals[k] += count
            own.append(k)
        places.append(own)
    segments = list(every)
    anchor = np.array([a for a, _, _ in segments], np.uint64)
    _, which, alike = np.unique(anchor, return_inverse=True, return_counts=True)
    sizes = np.array([len(b) - width + 1 for _, _, b in segments], np.int64)
    met = np.flatnonzero(alike[which] > 1)
    data = np.frombuffer(b"".join(segments[k][2] for k in met.tolist()), np.uint8)
    n = sizes[met]
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    starts = within + np.repeat(np.cumsum(n + width - 1) - (n + width - 1), n)
    # Equal windows have their anchor at equal distances.
    distance = np.repeat(np.array([segments[k][1] for k in met.tolist()], np.int64), n) - within
    found = repeated_suffixes(data, starts, np.repeat(which[met], n).astype(np.int64) * width + distance, width)
    masks = [np.full(int(m), t > 1) for m, t in zip(sizes, totals, strict=True)]
    at = 0
    for k, m in zip(met.tolist(), n.tolist(), strict=True):
        masks[k] |= found[at : at + m]
        at += m
    return [[masks[k] for k in own] for own in places]


def _order(width: int):
    def run(key, table):
        payloads = [x.as_py() for x in table.column("payload")]
        found = repeated_in(payloads, width)
        zipped = zstandard.ZstdCompressor(level=1).compress
        out = [zipped(np.packbits(np.concatenate(masks)).tobytes()) for masks in found]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "totals": pa.array(out, pa.binary())})

    return run


def repeated_spans(docs: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, ordered_places: int = ORDERED_PLACES, bucket_suffixes: int = BUCKET_SUFFIXES) -> DataFrame:
    """Remove every byte of a ``width``-byte string that starts at another place too.

    Windows are parted by their anchors, the least hashes among their half-width grams, and
    only the windows of anchors with several places are candidates (about one place in a
    hundred is an anchor, so only those are shuffled at first). The suffixes at candidate
    places then go to buckets by anchor, with the bytes they need, and are ordered by radix
    passes, the most significant digit first, no deeper than ``width``: the groups that are
    left are exactly the repeated windows. An anchor of more than ``ordered_places`` places
    may be too frequent for a task; its windows are totalled by 64 bits of one hash within
    buckets by another, so groups of any size are never gathered. Copies of a whole text are
    removed whole. Texts are read a second time by a 128-bit hash, so it does not matter how
    either reading is split.

    Returns ``rid, doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per input row.
    A null text counts as empty; a text shorter than ``width`` loses nothing; repeated rows
    are copies of one another; null ids stay null; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = numbered(docs, id_col, text_col)
    key = list(TEXT_KEY)
    narrow = checkpointed(rows.select("rid", "doc_id", *key, F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("sha")))
    copied = checkpointed(narrow.where(F.col("n_bytes") >= width).groupBy("sha").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("sha", F.lit(True).alias("copied")))

    def anchored(batches):
        for batch in batches:
            out = []
            for key_a, key_b, text in zip(*(batch.column(c).to_pylist() for c in key), batch.column("body"), strict=True):
                found, n = np.unique(runs(np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), np.uint8), width)[0], return_counts=True)
                out.append(np.stack([np.full(len(found), key_a), np.full(len(found), key_b), found.view(np.int64), n], 1))
            if out:
                columns = np.concatenate(out).T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names=[*key, "anchor", "places"])

    long_rows = rows.where(F.octet_length("body") >= width).select(*key, "body")
    # A partition's copies of a text count once; copies in several ones only add candidates.
    once = first_of_each(long_rows)
    digits = checkpointed(once.mapInArrow(anchored, "key_a long, key_b long, anchor long, places long"))
    shared = checkpointed(digits.groupBy("anchor").agg(F.sum("places").alias("all_places")).where("all_places > 1"))
    frequent = F.when(F.col("all_places") > ordered_places, 1).otherwise(0).cast("long")
    shared_of = digits.join(shared, "anchor").groupBy(*key).agg(F.collect_set(F.struct("anchor", frequent.alias("frequent"))).alias("found"))
    shared_of = checkpointed(shared_of.select(*key, F.col("found.anchor").alias("anchors"), F.col("found.frequent").alias("frequent")))
    texts = without_repeats(first_of_each(long_rows, id_bitmap(shared_of, "key_a", ROUTE_BITS)))
    joined = texts.join(shared_of, key)

    def gather(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        block, size, held = 0, 0, ([], [], [], [])
        for batch in batches:
            for *own, text, found, often in zip(*(batch.column(c).to_pylist() for c in key), batch.column("body"), batch.column("anchors"), batch.column("frequent"), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for to, value in zip(held, (tuple(own), raw, found.values.to_numpy(), often.values.to_numpy()), strict=True):
                    to.append(value)
                size += len(raw)
                if size >= block_bytes:
                    yield _block_rows((part << 32) + block, *held)
                    block, size, held = block + 1, 0, ([], [], [], [])
        if held[0]:
            yield _block_rows((part << 32) + block, *held)

    blocks = checkpointed(joined.select(*key, "body", "anchors", "frequent").mapInArrow(gather, "block long, payload binary"))
    n_shared, n_frequent = shared.agg(F.coalesce(F.sum(F.when(F.col("all_places") <= ordered_places, F.col("all_places"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("all_places") > ordered_places, F.col("all_places"))), F.lit(0))).first()
    # A run has about a quarter of the width in windows; distinct windows of frequent anchors
    # are at most as many.
    buckets, hash_buckets = buckets_for(n_shared * (width // 4), bucket_suffixes), buckets_for(n_frequent * (width // 4))

    def ask(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                own = Candidates(payload.as_py(), width)
                segments = list(own.segments)
                for bucket, numbers in sorted(own.bucketed(buckets).items()):
                    packed = _pack_segments([segments[k] for k in numbers], [own.counts[k] for k in numbers])
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "bucket": pa.array([bucket], pa.int32()), "payload": pa.array([packed], pa.binary())})

    def ask_frequent(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                keys, bucket, counts, _ = Candidates(payload.as_py(), width).keys(hash_buckets)
                yield from packets(block, keys, bucket, counts[:, None], hash_buckets)

    small_batches(spark, 16)
    sent = blocks.mapInArrow(ask, "block long, bucket int, payload binary").groupBy("bucket").applyInArrow(_order(width), "block long, bucket int, totals binary")
    answers = sent.withColumn("hashed", F.lit(False))
    if n_frequent:
        told = totals(blocks.mapInArrow(ask_frequent, PACKETS), 1, lambda total: (total[:, 0] > 1).astype(np.uint64))
        answers = answers.unionByName(told.withColumn("hashed", F.lit(True)))

    def remove(_, left, right):
        out = {c: [] for c in (*key, "n_removed", "n_spans", "kept_sha256")}
        hashed = right.column("hashed")
        ordered = dict(zip(*(right.filter(pa.compute.invert(hashed)).column(c).to_pylist() for c in ("bucket", "totals")), strict=True))
        unzip = zstandard.ZstdDecompressor().decompress
        for payload in left.column("payload"):
            own = Candidates(payload.as_py(), width)
            masks: dict[int, np.ndarray] = {}
            sizes = [len(b) - width + 1 for _, _, b in own.segments]
            for bucket, numbers in own.bucketed(buckets).items():
                bits = np.unpackbits(np.frombuffer(unzip(ordered[bucket]), np.uint8))
                at = 0
                for k in numbers:
                    masks[k] = np.flatnonzero(bits[at : at + sizes[k]])
                    at += sizes[k]
            found: list[list[np.ndarray]] = [[] for _ in own.texts]
            for number, start, k in own.spans:
                if len(masks[k]):
                    found[number].append(masks[k] + start)
            if len(own.places):
                keys, bucket, _, where = own.keys(hash_buckets)
                again = own.places[(answered(right.filter(hashed), keys, bucket)[:, 0] > 0)[where]]
                for number in np.unique(again[:, 0]).tolist():
                    found[number].append(again[again[:, 0] == number, 1])
            for (text, data), starts in zip(own.texts, found, strict=True):
                mask, spans = covered_runs(np.unique(np.concatenate(starts)) if starts else np.zeros(0, np.int64), len(data), width)
                for c, value in zip(out, (*text, int(mask.sum()), spans, hashlib.sha256(data[~mask].tobytes()).hexdigest()), strict=True):
                    out[c].append(value)
        return pa.table({c: pa.array(v, pa.string() if c == "kept_sha256" else pa.int64()) for c, v in out.items()})

    removed = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, "key_a long, key_b long, n_removed long, n_spans long, kept_sha256 string")
    none = hashlib.sha256(b"").hexdigest()
    whole = F.col("copied").isNotNull()
    return narrow.join(copied, "sha", "left").join(checkpointed(removed), key, "left").select(
        "rid",
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(none)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )

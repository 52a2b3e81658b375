"""Exact deduplication by counting quotient filters and byte verification."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm._common import TEXT_KEY, checkpointed, id_bitmap, in_bitmap, numbered, small_batches

#: Fingerprints that one merged filter holds on average; sets how many ranges there are.
FILTER_ROWS = 1 << 20
#: Bits of the routing bitmap. 2**23 bits are 1 MB at any input size.
ROUTE_BITS = 1 << 23


@dataclass
class CountingQuotientFilter:
    """A counting quotient filter over one range of 64-bit fingerprints.

    A fingerprint is cut into a quotient (its home slot) and a remainder. ``occupied`` has a
    bit per quotient that has a run, ``runend`` a bit per slot that ends one, ``remainders``
    the slots in order, ascending within a run, and ``counts`` their multiplicities. With
    quotient and remainder kept whole, the fingerprints can be read back, so two filters
    merge without loss.
    """

    quotient_bits: int
    remainder_bits: int
    occupied: np.ndarray
    runend: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None, range_bits: int) -> CountingQuotientFilter:
        """``fingerprints`` (unsigned 64-bit) share their top ``range_bits`` bits."""
        if counts is None:
            keys, total = np.unique(fingerprints, return_counts=True)
        else:
            order = np.argsort(fingerprints, kind="stable")
            ordered = fingerprints[order]
            first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
            keys, total = ordered[first], np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)
        quotient_bits = max(1, int(np.ceil(np.log2(max(2, len(keys))))))
        remainder_bits = 64 - range_bits - quotient_bits
        local = keys & np.uint64((1 << (64 - range_bits)) - 1)
        quotient = (local >> np.uint64(remainder_bits)).astype(np.int64)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotient] = True
        runend = np.r_[quotient[1:] != quotient[:-1], True] if len(keys) else np.zeros(0, bool)
        return cls(quotient_bits, remainder_bits, occupied, runend, local & np.uint64((1 << remainder_bits) - 1), total.astype(np.int64))

    def fingerprints(self, prefix: int, range_bits: int) -> np.ndarray:
        """All fingerprints in ascending order."""
        run = np.r_[0, np.cumsum(self.runend)[:-1]] if len(self.runend) else np.zeros(0, np.int64)
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        top = np.uint64((prefix << (64 - range_bits)) & ((1 << 64) - 1)) if range_bits else np.uint64(0)
        return top | (quotient << np.uint64(self.remainder_bits)) | self.remainders

    def to_bytes(self) -> bytes:
        width = (self.remainder_bits + 7) // 8
        slots = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        head = np.array([self.quotient_bits, self.remainder_bits, len(self.remainders)], "<i8").tobytes()
        return head + np.packbits(self.occupied).tobytes() + np.packbits(self.runend).tobytes() + slots.tobytes() + self.counts.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        quotient_bits, remainder_bits, n = (int(x) for x in np.frombuffer(raw, "<i8", 3))
        at = 24
        size = ((1 << quotient_bits) + 7) // 8
        occupied = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=1 << quotient_bits).astype(bool)
        at += size
        runend = np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
        at += (n + 7) // 8
        width = (remainder_bits + 7) // 8
        slots = np.zeros((n, 8), np.uint8)
        slots[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        return cls(quotient_bits, remainder_bits, occupied, runend, slots.reshape(-1).view("<u8").astype(np.uint64), np.frombuffer(raw, "<i8", n, at).astype(np.int64))


def merge_filters(filters: list[CountingQuotientFilter], prefix: int, range_bits: int) -> CountingQuotientFilter:
    """Merge by sorted remainders: equal fingerprints add their counts, none is lost."""
    keys = np.concatenate([f.fingerprints(prefix, range_bits) for f in filters])
    return CountingQuotientFilter.build(keys, np.concatenate([f.counts for f in filters]), range_bits)


def _filters_per_partition(range_bits: int, flush_rows: int = FILTER_ROWS):
    def emit(keys: np.ndarray):
        keys = np.sort(keys)
        ranges = (keys >> np.uint64(64 - range_bits)).astype(np.int64) if range_bits else np.zeros(len(keys), np.int64)
        starts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        raw = [CountingQuotientFilter.build(keys[a:b], None, range_bits).to_bytes() for a, b in zip(starts, ends, strict=True)]
        return pa.RecordBatch.from_pydict({"range": pa.array(ranges[starts], pa.int64()), "filter": pa.array(raw, pa.binary())})

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += len(held[-1])
            if n >= flush_rows:
                yield emit(np.concatenate(held))
                held, n = [], 0
        if n:
            yield emit(np.concatenate(held))

    return run


def repeated_fingerprints(narrow: DataFrame, rows: int, filter_rows: int = FILTER_ROWS) -> DataFrame:
    """``fp, n`` of the fingerprints that merged filters count more than once."""
    range_bits = max(0, int(np.ceil(np.log2(max(1, rows / filter_rows)))))

    def merge(key, table):
        prefix = key[0].as_py()
        merged = merge_filters([CountingQuotientFilter.from_bytes(x.as_py()) for x in table.column("filter")], prefix, range_bits)
        many = merged.counts > 1
        return pa.table({"fp": pa.array(merged.fingerprints(prefix, range_bits)[many].view(np.int64), pa.int64()), "n": pa.array(merged.counts[many], pa.int64())})

    filters = narrow.select("fp").mapInArrow(_filters_per_partition(range_bits, filter_rows), "range long, filter binary")
    return filters.groupBy("range").applyInArrow(merge, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_rows: int = FILTER_ROWS, route_bits: int = ROUTE_BITS) -> DataFrame:
    """Group rows with identical texts; the row with the largest id of a group stays.

    Each partition puts its 64-bit text fingerprints in counting quotient filters, one per
    fingerprint range; the filters of a range merge in one task. Texts whose fingerprint
    counts above one are routed, through a bitmap of fixed size, to a grouping by the text's
    own bytes, which combines a partition's copies before the shuffle; an exact semi join
    then drops what the bitmap let through.

    Returns ``rid, doc_id, keep_id, group_size, kept, text_sha256`` and the text's hash
    ``key_a, key_b``, one row per input row. A null text counts as the empty text, and empty
    texts are copies of one another. A null id is smaller than any other; ``keep_id`` is null
    only where a group has no other. Of repeated rows with the same id and text exactly one
    is kept, the one read last (largest ``rid``). An empty table gives no rows; other columns
    are not read. Should two texts share SHA-256 and fingerprint but not bytes, the query
    fails instead of joining them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = numbered(docs, id_col, text_col).withColumnRenamed(TEXT_KEY[0], "fp")
    narrow = checkpointed(rows.select("rid", "doc_id", "fp", TEXT_KEY[1], F.sha2("body", 256).alias("text_sha256")))
    total = narrow.count()
    repeated = checkpointed(repeated_fingerprints(narrow, total, filter_rows))
    bitmap = id_bitmap(repeated, "fp", route_bits)

    def listed(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(batch.column("fp").to_numpy(zero_copy_only=False), bitmap), pa.bool_()))

    doubtful = rows.select("fp", "body").mapInArrow(listed, "fp long, body string")
    texts = doubtful.groupBy("fp", "body").agg(F.count(F.lit(1)).alias("n")).join(repeated.select("fp"), "fp", "left_semi")
    verified = texts.groupBy("fp", F.sha2("body", 256).alias("text_sha256")).agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"))
    largest = F.max(F.struct("doc_id", "rid"))
    groups = narrow.groupBy("fp", "text_sha256").agg(largest.alias("top"), F.count(F.lit(1)).alias("size")).join(repeated.select("fp"), "fp", "left_semi")
    checked = groups.join(verified, ["fp", "text_sha256"], "left").select(
        "fp",
        "text_sha256",
        F.col("top.doc_id").alias("top_id"),
        F.col("top.rid").alias("top_rid"),
        F.when((F.col("texts") == 1) & (F.col("n") == F.col("size")), F.col("size")).otherwise(F.raise_error(F.lit("texts with equal digests differ"))).alias("size"),
    )
    checked = checkpointed(checked)  # as an input of its own, its join can split a hot key
    single = F.col("size").isNull()
    return narrow.join(checked, ["fp", "text_sha256"], "left").select(
        "rid",
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("top_id")).alias("keep_id"),
        F.coalesce(F.col("size"), F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("rid") == F.col("top_rid"))).alias("kept"),
        "text_sha256",
        F.col("fp").alias(TEXT_KEY[0]),
        TEXT_KEY[1],
    )

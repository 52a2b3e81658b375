"""Corpus-wide totals of 64-bit keys, exchanged in packed blocks.

Blocks of rows ask for the totals of their distinct keys. A block sends each bucket of keys
one packet of sorted, delta-coded keys with its own counts; a bucket's task adds the packets
up and answers each with totals in the packet's order, so answers need no keys. A key costs a
few bytes a block however often it occurs, and buckets are cut from hashes, so that no
frequent key makes a task large.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Keys that a bucket receives on average.
BUCKET_KEYS = 1 << 20


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers in as many bytes each as the largest needs."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unsqueeze(raw: bytes) -> np.ndarray:
    width = raw[0]
    body = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(body), 8), np.uint8)
    out[:, :width] = body
    return out.reshape(-1).view("<u8")


def pack_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(raw), dtype=np.uint64)


def buckets_for(keys: int, per_bucket: int = BUCKET_KEYS) -> int:
    return max(1, -(-keys // per_bucket))


def packets(block: int, keys: np.ndarray, bucket: np.ndarray, counts: np.ndarray, buckets: int):
    """Arrow batches ``block, bucket, keys, counts``. ``keys`` are distinct, in any order;
    ``counts`` has a row per key."""
    order = np.lexsort((keys, bucket))
    keys, bucket, counts = keys[order], bucket[order], counts[order]
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    filled = np.flatnonzero(np.diff(edges))
    zip_counts = zstandard.ZstdCompressor(level=1).compress
    yield pa.RecordBatch.from_pydict({
        "block": pa.array(np.full(len(filled), block), pa.int64()),
        "bucket": pa.array(filled, pa.int32()),
        "keys": pa.array([pack_sorted(keys[edges[b] : edges[b + 1]]) for b in filled], pa.binary()),
        "counts": pa.array([zip_counts(squeeze(counts[edges[b] : edges[b + 1]].reshape(-1))) for b in filled], pa.binary()),
    })


PACKETS = "block long, bucket int, keys binary, counts binary"
ANSWERS = "block long, bucket int, totals binary"


def totals(sent: DataFrame, columns: int, answer, tally=None) -> DataFrame:
    """Answers ``block, bucket, totals`` to ``packets``.

    ``answer`` turns the totals of a packet's keys (a row per key) into the unsigned integers
    that are sent back. ``tally``, if given, makes one integer of the totals of all distinct
    keys of a bucket; it comes as a row of block -1.
    """

    def add_up(key, table):
        unzip = zstandard.ZstdDecompressor().decompress
        keys = [unpack_sorted(x.as_py()) for x in table.column("keys")]
        counts = np.concatenate([unsqueeze(unzip(x.as_py())).reshape(-1, columns) for x in table.column("counts")])
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.stack([np.bincount(where, counts[:, c].astype(np.float64), len(every)) for c in range(columns)], 1).astype(np.int64)
        zipped = zstandard.ZstdCompressor(level=1).compress
        out, at = [], 0
        for own in keys:
            out.append(zipped(squeeze(answer(total[where[at : at + len(own)]]))))
            at += len(own)
        blocks, buckets = table.column("block").to_pylist(), table.column("bucket").to_pylist()
        if tally is not None:
            blocks, buckets = [*blocks, -1], [*buckets, key[0].as_py()]
            out.append(zipped(squeeze(np.array([tally(total)]))))
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array(buckets, pa.int32()), "totals": pa.array(out, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(add_up, ANSWERS)


def tallied(answers: DataFrame) -> dict[int, int]:
    """The tally of each bucket."""
    unzip = zstandard.ZstdDecompressor().decompress
    return {r["bucket"]: int(unsqueeze(unzip(bytes(r["totals"])))[0]) for r in answers.where("block = -1").select("bucket", "totals").collect()}


def answered(table: pa.Table, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """What came back for ``keys``, in their order; ``table`` holds one block's answers."""
    order = np.lexsort((keys, bucket))
    unzip = zstandard.ZstdDecompressor().decompress
    parts = sorted(zip(table.column("bucket").to_pylist(), table.column("totals"), strict=True), key=lambda p: p[0])
    got = np.concatenate([unsqueeze(unzip(raw.as_py())) for _, raw in parts]) if parts else np.zeros(0, np.uint64)
    width, rest = divmod(len(got), max(1, len(keys)))
    if rest:
        raise ValueError("a block's answers do not match its keys; was the input replayed in another order?")
    out = np.zeros((len(keys), width), np.uint64)
    out[order] = got.reshape(len(keys), width)
    return out

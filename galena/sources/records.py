"""Record files, streamed folders, sampled frames and appended logs."""

from __future__ import annotations

import struct
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from galena.sources.files import IMAGE_TYPES, has_type

#: Fixed values of the format: what each record begins with, bits of its length, and the
#: header of an image record (flag, label, two ids).
MAGIC, LENGTH_BITS, HEADER = 0xCED7230A, 29, "<IfQQ"


def records(raw: bytes) -> Iterator[tuple[int, float, bytes]]:
    """``id, label, content`` of each record of a file; a record in several parts is joined."""
    at, held = 0, b""
    while at + 8 <= len(raw):
        magic, word = struct.unpack_from("<II", raw, at)
        if magic != MAGIC:
            raise ValueError(f"no record at byte {at}")
        part, size = word >> LENGTH_BITS, word & ((1 << LENGTH_BITS) - 1)
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("the last record is cut off")
        at += 8 + size + (-size) % 4
        held = body if part in (0, 1) else held + struct.pack("<I", MAGIC) + body
        if part in (0, 3):
            flag, label, first, _ = struct.unpack_from(HEADER, held)
            start = struct.calcsize(HEADER)
            if flag:
                label = struct.unpack_from("<f", held, start)[0]
            yield first, label, held[start + 4 * flag :]


def record_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, id, label, content`` of the records of all ``.rec`` files below ``folder``; each
    file is read by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.rec").load(folder)

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for first, label, content in records(raw.as_py()):
                    yield pa.RecordBatch.from_pydict({"path": [path], "id": pa.array([first], pa.int64()), "label": pa.array([label], pa.float32()), "content": pa.array([content], pa.binary())})

    return files.select("path", "content").mapInArrow(run, "path string, id long, label float, content binary")


def extract_stream(spark: SparkSession, folder: str, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, types: tuple[str, ...] = IMAGE_TYPES, files_per_batch: int = 5_000) -> StreamingQuery:
    """Run ``extract`` over the images of a folder, new ones too, and append what it returns.

    Progress is kept in ``checkpoint``: a run that is stopped or fails goes on with the files
    that it has not finished, and writes none twice.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    images = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    made = extract(images.where(has_type(F.col("path"), types)))
    return made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def limited_identities(images: DataFrame, per_identity: int, total: int, identity: str = "identity", path: str = "path") -> DataFrame:
    """At most ``per_identity`` images of each identity in path order, then ``total`` in all,
    whole identities first by name; with the identity's number as ``label``."""
    from galena.sources.files import capped_identities

    capped = capped_identities(images, per_identity, identity, path)
    return capped.orderBy("label", path).limit(total)


def frames(open_source: Callable[[], Iterator], every: int = 5, retries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[int, object]]:
    """Number and content of each ``every``-th frame of a camera or video.

    ``open_source`` returns an iterator that ends with the video, or raises OSError when the
    connection is lost: then it is opened again, ``retries`` times in a row at most.
    """
    number = lost = 0
    while True:
        try:
            for frame in open_source():
                lost = 0
                if number % every == 0:
                    yield number, frame
                number += 1
            return
        except OSError:
            lost += 1
            if lost > retries:
                raise
            sleep(wait)


def csv_log(rows: DataFrame, path: str) -> None:
    """Append ``name, timestamp, confidence`` as CSV, the confidence with three decimals."""
    shown = rows.select("name", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.format_string("%.3f", "confidence").alias("confidence"))
    shown.write.mode("append").option("header", "false").csv(path)


def csv_sink(path: str) -> Callable[[DataFrame, int], None]:
    """``csv_log`` as a ``foreachBatch`` function."""
    return lambda batch, _epoch: csv_log(batch, path)

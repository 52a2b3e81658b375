"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions.tables import checkpointed, shared_folder  # noqa: F401

#: Rows of one Arrow batch. Texts can be long, so batches are kept short.
ARROW_ROWS = 256

#: What separates words: the space and the control characters from tab to carriage return.
WORD_GAPS = "\x09\x0a\x0b\x0c\x0d\x20"

_GAPS_TO_SPACE = str.maketrans({c: " " for c in WORD_GAPS})
_ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: White space to str.split() that the word pattern counts as part of a word.
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of an Arrow batch for the Python stages of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: The columns of a text's 128-bit hash.
TEXT_KEY = ("key_a", "key_b")


def text_key(body: str = "body") -> list[Column]:
    """Two independent 64-bit hashes. They name a text in any reading of the table, however
    the reading is split; texts that differ share both with chance 2**-128."""
    return [F.xxhash64(body).alias(TEXT_KEY[0]), F.xxhash64(F.lit(0x5EED), body).alias(TEXT_KEY[1])]


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rid, doc_id, body, key_a, key_b``: one row per input row, null text read as empty.

    ``rid`` tells repeated rows apart within this reading only: another one may be split
    otherwise and number rows otherwise. So what holds a ``rid`` is checkpointed before it is
    used, and a second reading is matched by id and text hash.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"),
    )
    return rows.select("rid", "doc_id", "body", *text_key())


def in_training(id_column: Column, modulus: int, left_out: int) -> Column:
    """crc32 of the id's decimal text decides; a null id hashes as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))), F.lit(modulus)) != left_out


def words_of(text: str) -> list[str]:
    """Words of ``text`` with A-Z in lower case; only ASCII white space separates."""
    if text.isascii():
        low = text.lower()
        return low.split() if not _OTHER_SPACE.search(low) else _WORD.findall(low)
    low = text.translate(_ASCII_LOWER)
    return _WORD.findall(low) if _OTHER_SPACE.search(low) else low.split()


def id_bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits (a power of two) with one bit set for every ``column`` value,
    which is a hash.

    Its size is fixed, however many keys there are; the driver receives ``bits`` / 8 small
    rows at most.
    """
    at = keys.select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("bit"))
    words = at.groupBy(F.shiftright("bit", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit & 7 as int))")).alias("byte"))
    bitmap = np.zeros(bits // 8, np.uint8)
    found = words.toArrow()
    if len(found):
        bitmap[found.column("at").to_numpy()] = found.column("byte").to_numpy().astype(np.uint8)
    return bitmap


def in_bitmap(values: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which of ``values`` may be among the bitmap's keys."""
    at = values.astype(np.int64) & (8 * len(bitmap) - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


#: Texts of a partition that are remembered as sent; beyond that some are sent again.
SENT = 1 << 18


def first_of_each(rows: DataFrame, bitmap: np.ndarray | None = None) -> DataFrame:
    """From a partition one row for each text, if its ``key_a`` is in the bitmap."""

    def run(batches):
        sent: set = set()
        for batch in batches:
            if bitmap is not None:
                batch = batch.filter(pa.array(in_bitmap(batch.column(TEXT_KEY[0]).to_numpy(zero_copy_only=False), bitmap), pa.bool_()))
            new = []
            for key in zip(*(batch.column(c).to_pylist() for c in TEXT_KEY), strict=True):
                new.append(key not in sent)
                sent.add(key)
            if len(sent) > SENT:
                sent.clear()
            yield batch.filter(pa.array(new, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def without_repeats(rows: DataFrame) -> DataFrame:
    """One row ``key_a, key_b, body`` for each text of ``first_of_each``."""
    return rows.groupBy(*TEXT_KEY).agg(F.first("body").alias("body"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit integers (splitmix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

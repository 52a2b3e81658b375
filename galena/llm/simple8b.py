"""Token ids in Simple-8b blocks: a selector and as many ids as fit in each 64-bit word."""

from __future__ import annotations

import os
import re
import sys
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm._common import numbered, shared_folder, small_batches

#: Fixed values of the code: ids per word and bits per id of selectors 1 to 14.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: Selector 0 stands for one id of more than 60 bits, kept whole in the block's escape list.
ESCAPE = 0

MAGIC = 0x53384231
#: A block is closed once it has this many ids; documents are never cut.
BLOCK_IDS = 1 << 16
#: Bytes of text that one output file gets, at least and at most, on average. Between them
#: there are as many files as the session has shuffle partitions.
LEAST_FILE, MOST_FILE = 16 << 20, 256 << 20
#: Words whose ids a worker remembers; beyond that it starts anew.
REMEMBERED_WORDS = 600_000

#: White space to str.split() that the tokenizer's own pattern counts as part of a word.
_CONTROLS = "\x1c\x1d\x1e\x1f"
_WORD = re.compile(rf"(?:\S|[{_CONTROLS}])+")
#: Letters below this code point are Latin; the one dotted capital among them is lowered to two
#: characters.
LATIN_END, DOTTED_I = "\u0250", "\u0130"
_MARKS = (".", ",")
_TOUCH = re.compile(r"[.,](?:[^\w\s]|_)|(?:[^\w\s]|_)[.,]")
#: What keeps a text from being cut at full stops and commas: controls, capitals that are not
#: lowered by themselves, and marks in a row.
_WHOLE = (*_CONTROLS, DOTTED_I, "\u03a3", *(a + b for a in _MARKS for b in _MARKS))


def _widths(values: np.ndarray) -> np.ndarray:
    """Least width of the code that holds each value; 255 where none does."""
    bits = np.full(len(values), 255, np.uint8)
    for width in sorted(WIDTHS, reverse=True):
        bits[values < np.uint64(1 << width)] = width
    return bits


_SHORT_WIDTHS = _widths(np.arange(1 << 16, dtype=np.uint64))


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words and escaped values of ``values`` (unsigned 64-bit)."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    bits = _SHORT_WIDTHS[values] if values.max() < len(_SHORT_WIDTHS) else _widths(values)
    selector = np.zeros(n, np.uint8)
    selector[bits <= 60] = len(COUNTS)
    widest, reach = bits.copy(), 1
    for at in range(len(COUNTS) - 2, -1, -1):
        count, width = COUNTS[at], WIDTHS[at]
        while reach < count and len(widest):
            widest = np.maximum(widest[:-1], bits[reach:]) if n > reach else widest[:0]
            reach += 1
        if not len(widest):
            break
        fits = widest <= width
        if not fits.any() and width > int(bits.min()) * 2:
            continue
        selector[: len(widest)][fits] = at + 1
    step = np.array((1, *COUNTS), np.int64)[selector].tolist()
    starts, at = [], 0
    add = starts.append
    while at < n:
        add(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for number, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True), 1):
        rows = np.flatnonzero(chosen == number)
        if len(rows):
            packed = np.zeros(len(rows), np.uint64)
            for k in range(count):
                packed |= values[starts[rows] + k] << np.uint64(k * width)
            words[rows] |= packed
    return words, values[starts[chosen == ESCAPE]]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values of ``pack``; each selector's words are decoded together."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    count = np.array((1, *COUNTS), np.int64)[chosen]
    ends = np.cumsum(count)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - count
    for number, (per_word, width) in enumerate(zip(COUNTS, WIDTHS, strict=True), 1):
        rows = np.flatnonzero(chosen == number)
        if len(rows):
            word, to, mask = words[rows], starts[rows], np.uint64((1 << width) - 1)
            for k in range(per_word):
                out[to + k] = (word >> np.uint64(k * width)) & mask
    out[starts[chosen == ESCAPE]] = escapes
    return out


def write_block(doc_ids: list[int | None], lengths: list[int], values: np.ndarray, before: int) -> bytes:
    """A block: head, documents (id, null mark, first id's offset in the block), escapes, words."""
    words, escapes = pack(values)
    offsets = np.r_[0, np.cumsum(np.array(lengths, np.int64))].astype("<i8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = np.array([MAGIC, len(doc_ids), len(values), len(words), len(escapes), before], "<i8")
    return b"".join(x.tobytes() for x in (head, ids, offsets, escapes.astype("<u8"), words.astype("<u8"), known))


def read_block(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """Document ids, their offsets (one more than documents), values, ids before the block."""
    magic, docs, n, n_words, n_escapes, before = (int(x) for x in np.frombuffer(raw, "<i8", 6))
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = 48
    ids = np.frombuffer(raw, "<i8", docs, at)
    offsets = np.frombuffer(raw, "<i8", docs + 1, at := at + 8 * docs)
    escapes = np.frombuffer(raw, "<u8", n_escapes, at := at + 8 * (docs + 1))
    words = np.frombuffer(raw, "<u8", n_words, at := at + 8 * n_escapes)
    known = np.frombuffer(raw, np.uint8, docs, at + 8 * n_words)
    values = unpack(words, escapes)
    if len(values) != n:
        raise ValueError("a block of token ids is damaged")
    return [int(i) if k else None for i, k in zip(ids, known, strict=True)], offsets, values, before


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the
    code points from 256 on, in turn."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


def _plain(word: str) -> bool:
    """Letters only, each of which is lowered to one letter and composes with no other."""
    return word.isalpha() and (word.isascii() or max(word) < LATIN_END and DOTTED_I not in word)


class WordIds(dict):
    """Ids of white-space separated words, as bytes, by the tokenizers library.

    The vocabulary's tokenizer drops white space and merges within words only, so a text's
    ids are those of its words in turn. U+001C to U+001F are no white space to it. A word of
    Latin letters is one piece to its pattern and goes to the library's model at once, in
    lower case and in the byte-level alphabet; any other word takes the library's whole way.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.pieces = self.tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        raw = self[word] = self.fresh(word)
        return raw

    def fresh(self, word: str) -> bytes:
        """The word's ids by the library, not remembered."""
        if _plain(word):
            piece = word.lower()
            if not piece.isascii():
                piece = piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = [t.id for t in self.pieces(piece)]
        elif (stem := word.rstrip(".,")) != word and _plain(stem[-1:]):
            return self[stem] + self[word[len(stem) :]]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        ids = array("I", ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        words = _WORD.findall(text) if any(c in text for c in _CONTROLS) else text.split()
        return b"".join(map(self.__getitem__, words))


class _Touching(Exception):
    """A word that begins or ends with a mark, which may belong to the mark beside it."""


class TextIds(dict):
    """Ids of texts: words in lower case, without the full stops and commas around them.

    Fewer words are different so. Text in which a full stop or comma may touch another mark,
    or whose lower case depends on more than each letter, is read word by word by ``WordIds``.
    """

    def __init__(self, words: WordIds):
        self.words = words

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        if word not in _MARKS and not (word[0].isalnum() and word[0] < LATIN_END and word[-1].isalnum() and word[-1] < LATIN_END):
            raise _Touching
        raw = self[word] = self.words.fresh(word)
        return raw

    def encode(self, text: str) -> bytes:
        if any(c in text for c in _WHOLE):
            return self.words.encode(text)
        words = text.lower().replace(".", " . ").replace(",", " , ").split()
        try:
            return b"".join(map(self.__getitem__, words))
        except _Touching:
            return self.words.encode(text) if _TOUCH.search(text) else b"".join(map(self.words.__getitem__, words))


@lru_cache(maxsize=2)
def word_ids(tokenizer_file: str) -> TextIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TextIds(WordIds(tokenizer_file))


def files_for(rows: DataFrame, wished: int) -> int:
    total = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    return max(1, -(-total // MOST_FILE), min(wished, -(-total // LEAST_FILE)))


def write_token_files(docs: DataFrame, tokenizer_file: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Tokenize and write blocks, in ascending id order; returns what was written, read back.

    Rows are range-partitioned by id (then by text hash and row number, so that even a
    repeated id spreads out), sorted, encoded and written by the same task. The result has a
    row per block: ``file, block, n_ids, image``. They are Parquet files in ``path``, without
    which they go to a new folder in the session's shared checkpoint folder.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = numbered(docs, id_col, text_col).withColumn("tie", F.xxhash64("body"))
    files = files or files_for(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.asc_nulls_first("doc_id"), F.asc("tie"), F.asc("rid")]
    ranged = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        table = word_ids(tokenizer_file)
        end = np.array([end_id], "<u4").tobytes()
        file = TaskContext.get().partitionId()
        ids, lengths, held, n, block, before = [], [], [], 0, 0, 0

        def close():
            values = np.frombuffer(b"".join(held), "<u4")
            image = write_block(ids, lengths, values, before)
            return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "block": pa.array([block], pa.int64()), "n_ids": pa.array([n], pa.int64()), "image": pa.array([image], pa.binary())})

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("body"), strict=True):
                raw = table.encode(text.as_py()) + end
                ids.append(doc_id.as_py())
                held.append(raw)
                lengths.append(len(raw) // 4)
                n += len(raw) // 4
                if n >= block_ids:
                    yield close()
                    before, block = before + n, block + 1
                    ids, lengths, held, n = [], [], [], 0
        if ids:
            yield close()

    blocks = ranged.select("doc_id", "body").mapInArrow(run, "file int, block long, n_ids long, image binary")
    path = path or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    blocks.write.mode("overwrite").parquet(path)
    return spark.read.schema("file int, block long, n_ids long, image binary").parquet(path)


def read_token_files(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in ``blocks``.

    Files stand in the order of ``file``; only one total per file goes through the driver.
    """
    spark = blocks.sparkSession
    totals = sorted(blocks.groupBy("file").agg(F.sum("n_ids")).collect())
    offset, starts = 0, {}
    for file, n in totals:
        starts[file] = offset
        offset += n

    def run(batches):
        for batch in batches:
            for file, image in zip(batch.column("file"), batch.column("image"), strict=True):
                ids, offsets, values, before = read_block(image.as_py())
                raw = memoryview(values.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(offsets[:-1] + (starts[file.as_py()] + before), pa.int64()), "n_tokens": pa.array(np.diff(offsets), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    small_batches(spark, 16)
    return blocks.select("file", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """Write the token files of ``docs`` and return what reading them back gives.

    Returns ``doc_id, start, n_tokens, ids_crc32``, one row per input row. A null or empty
    text has the end id only. Rows with a null id come first; rows that share an id follow
    the order of their text hashes, then of reading. An empty table gives no rows; other
    columns are not read.
    """
    return read_token_files(write_token_files(docs, tokenizer_file, end_id, path, id_col, text_col, files))

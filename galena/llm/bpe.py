"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm._common import numbered, small_batches

#: Texts longer than this many characters are split before they are encoded.
PIECE_CHARS = 1 << 16

#: A match of the pattern never holds white space after another character, so a text may be
#: cut in front of a blank that follows a character which no definition counts as white space.
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n])")

#: The white space of the pattern's ``\s``.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space from this many characters on is not left to the pattern, which steps back
#: through it one by one and needs stack for each step.
LONG_RUN = 1 << 16
_LONG_RUN = re.compile(f"[{WHITE_SPACE}]{{{LONG_RUN},}}")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file; one per worker process."""
    import tiktoken

    ranks = {}
    with open(rank_file, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, piece_chars: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces of at least ``piece_chars`` characters whose encodings join to the text's own.

    A text without a safe place to cut stays whole.
    """
    start, n = 0, len(text)
    while n - start > piece_chars:
        cut = _SAFE_CUT.search(text, start + piece_chars)
        if cut is None or cut.start() >= n:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, enc, piece_chars: int = PIECE_CHARS) -> np.ndarray:
    """Ids of ``text`` as unsigned 32-bit integers.

    A long run of white space is one match, without its last character unless it ends the
    text; the matches on either side are those of the text on either side.
    """
    if len(text) <= piece_chars:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    ids, at = [], 0
    for run in _LONG_RUN.finditer(text):
        ids += [enc.encode_ordinary(p) for p in safe_pieces(text[at : run.start()], piece_chars)]
        at = run.end() - (run.end() < len(text))
        ids.append(enc._encode_single_piece(text[run.start() : at]))
    ids += [enc.encode_ordinary(p) for p in safe_pieces(text[at:], piece_chars)]
    return np.concatenate([np.array(i, dtype="<u4") for i in ids])


def decode(ids: np.ndarray, enc) -> bytes:
    """The raw bytes of ``ids``; they need not be valid UTF-8 where ids are cut."""
    return enc.decode_bytes(ids.tolist())


def bpe_round_trip(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    piece_chars: int = PIECE_CHARS,
    with_ids: bool = False,
) -> DataFrame:
    """Encode each text, decode the ids again, and return digests of both.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, on request, ``ids`` (binary,
    little-endian unsigned 32-bit). One row per input row: repeated rows are encoded each, a
    null id stays null, a null or empty text gives 0 tokens and the digests of no bytes; an
    empty table gives no rows; other columns are not read. No row depends on another, so
    nothing is shuffled and no group of copies can be hot.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            n, id_hash, text_hash, raw = [], [], [], []
            for text in batch.column("body"):
                ids = encode(text.as_py(), enc, piece_chars)
                packed = ids.tobytes()
                n.append(len(ids))
                id_hash.append(hashlib.sha256(packed).hexdigest())
                text_hash.append(hashlib.sha256(decode(ids, enc)).hexdigest())
                raw.append(packed)
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(id_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(raw, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")
    return numbered(docs, id_col, text_col).select("doc_id", F.col("body")).mapInArrow(run, schema)

"""Word hashes of whole batches, from the bytes of their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from galena.llm._common import WORD_GAPS, mixed

#: Bytes that are hashed at once. Texts are grouped up to this size; a longer one is cut
#: between words.
TILE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(77).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_IN_WORD = np.ones(256, bool)
_IN_WORD[[ord(c) for c in WORD_GAPS]] = False
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base modulo 2**64 and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (_BASE, _INVERSE):
            table = np.full(max(n, 1 << 16), base, np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table))
    return _powers


def _long_word(data: np.ndarray) -> np.uint64:
    """The hash of one word, a tile at a time."""
    up, _ = _power_tables(TILE)
    total, factor, step = 0, 1, pow(_BASE, TILE, 1 << 64)
    for at in range(0, len(data), TILE):
        part = data[at : at + TILE]
        total = (total + factor * int((_VALUES[part] * up[: len(part)]).sum(dtype=np.uint64))) % (1 << 64)
        factor = factor * step % (1 << 64)
    return mixed(np.array([total], np.uint64))[0]


def _hashed(data: np.ndarray, edges: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data``, and how many lie before each of ``edges``, at which
    words end too. A-Z count as a-z."""
    up, down = _power_tables(len(data))
    inside = in_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = edges[(edges > 0) & (edges < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, edges)


def _long_text(data: np.ndarray, in_word: np.ndarray) -> np.ndarray:
    """Word hashes of a text of any length, in tiles cut behind what separates words."""
    out, at = [], 0
    while at < len(data):
        tile = data[at : at + TILE]
        if at + TILE < len(data):
            gaps = np.flatnonzero(~in_word[tile])
            if not len(gaps):
                ahead = at + TILE
                while ahead < len(data) and in_word[data[ahead : ahead + TILE]].all():
                    ahead += TILE
                end = min(len(data), ahead + (int(np.argmin(in_word[data[ahead : ahead + TILE]])) if ahead < len(data) else 0))
                out.append(np.array([_long_word(data[at:end])], np.uint64))
                at = end
                continue
            tile = tile[: int(gaps[-1]) + 1]
        out.append(_hashed(tile, np.zeros(0, np.int64), in_word)[0])
        at += len(tile)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and where each row begins."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def batch_words(column: pa.Array, in_word: np.ndarray = _IN_WORD) -> Iterator[np.ndarray]:
    """For each text of ``column`` (UTF-8, no nulls) the 64-bit hashes of its words, in order.

    Words are runs of the bytes that ``in_word`` marks, by default what stands between spaces
    and the control characters from tab to carriage return; A-Z are read as a-z.
    """
    if not len(column):
        return
    data, at = _raw(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + TILE, "right")) - 1)
        if last == first + 1:
            yield _long_text(data[at[first] : at[last]], in_word)
        else:
            hashes, place = _hashed(data[at[first] : at[last]], at[first : last + 1] - at[first], in_word)
            yield from (hashes[a:b] for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True))
        first = last


def text_words(text: str) -> np.ndarray:
    """Word hashes of one text, the same as in a batch."""
    return _long_text(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), _IN_WORD)

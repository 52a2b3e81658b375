"""Benchmark decontamination: words in common as seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm._common import numbered, small_batches
from galena.llm._words import batch_words

#: Alignment scores: a word that matches, one that is replaced, one that is left out or added.
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: Least score as a share of the item's own (all words matching).
LEAST_SHARE = 0.5
#: Least matching score of any alignment, so that short items need nearly all their words.
LEAST_SCORE = 6.0
#: Score that is enough whatever the item's length, so that an excerpt of a long item counts.
EXCERPT_SCORE = 13.0
#: Words of test items that one pass over the documents carries; more items, more passes.
PASS_WORDS = 1 << 21
#: Words of a text that are looked up at once, at least.
CHUNK_WORDS = 1024

#: Cells of items and words that are compared at once.
CELLS = 1 << 18
#: Bits by which most other words are passed over.
SIEVE_BITS = 20

#: Letters and digits of ASCII, and all bytes of other characters that are kept.
_IN_TOKEN = np.zeros(256, bool)
_IN_TOKEN[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_OTHER = re.compile(r"[^\w\x00-\x7f]")


def _lowered(text: str) -> str:
    low = text.lower()
    return low if low.isascii() else _OTHER.sub(" ", low)


def batch_tokens(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text the hashes of its runs of letters and digits, in lower case."""
    return batch_words(pa.array([_lowered(t) for t in texts], pa.string()), _IN_TOKEN)


def tokens(text: str) -> np.ndarray:
    return next(batch_tokens([text]))


@dataclass
class Items:
    """Words of the test items, and for each distinct word the items that have it."""

    items: list[tuple[int, np.ndarray]]
    share: float = LEAST_SHARE
    least: float = LEAST_SCORE

    def __post_init__(self):
        self.sizes = np.array([len(w) for _, w in self.items], np.int64)
        self.need = np.minimum(np.maximum(self.share * self.sizes, self.least), np.minimum(self.sizes, EXCERPT_SCORE))
        # Matched and replaced words are the item's own, and what the score has above the
        # least one pays for added words: an alignment that reaches it spans no more.
        self.reach = self.sizes + np.floor((self.sizes * MATCH - self.need) / -GAP).astype(np.int64)
        words = np.concatenate([w for _, w in self.items]) if self.items else np.zeros(0, np.uint64)
        self.vocabulary, word = np.unique(words, return_inverse=True)
        pair, self.repeats = np.unique(word * max(1, len(self.items)) + np.repeat(np.arange(len(self.items)), self.sizes), return_counts=True)
        self.owners = pair % max(1, len(self.items))
        self.starts = np.searchsorted(pair, np.arange(len(self.vocabulary) + 1) * max(1, len(self.items)))
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self._cell(self.vocabulary)] = True

    def _cell(self, words: np.ndarray) -> np.ndarray:
        return (words & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)

    def near(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Item numbers, and places in ``words`` at which an alignment that reaches the least
        score may end; no other place can be such an end.

        An alignment scores at most its item's words that occur here at all, and at most what
        the passage would score if each word that the item has anywhere were a match and
        each other word a gap.
        """
        place = np.flatnonzero(self.sieve[self._cell(words)])
        distinct, where = np.unique(words[place], return_inverse=True)
        word = np.searchsorted(self.vocabulary, distinct)
        word[word == len(self.vocabulary)] = 0
        n = np.where(self.vocabulary[word] == distinct, self.starts[word + 1] - self.starts[word], 0)
        at = np.arange(int(n.sum())) + np.repeat(self.starts[word] - np.cumsum(n) + n, n)
        owner, column = self.owners[at], np.repeat(np.arange(len(distinct)), n)
        found = np.flatnonzero(np.bincount(owner, self.repeats[at], len(self.items)) >= self.need)
        step = max(1, CELLS // max(1, len(place)))
        for low in range(0, len(found), step):
            part = found[low : low + step]
            row = np.full(len(self.items), -1, np.int64)
            row[part] = np.arange(len(part))
            mine = row[owner] >= 0
            has = np.zeros((len(part), len(distinct)), bool)
            has[row[owner[mine]], column[mine]] = True
            hit = has[:, where]
            # The best sum of a run of words that ends at a hit, within each item's hits.
            level = (np.cumsum(hit, axis=1, dtype=np.float32) - 1) * np.float32(MATCH - GAP) + (place * GAP).astype(np.float32)
            lowest = np.minimum.accumulate(np.where(hit, level, np.float32(np.inf)), axis=1)
            end = hit & (level - lowest + np.float32(MATCH) >= self.need[part, None])
            for k in np.flatnonzero(end.any(axis=1)).tolist():
                yield int(part[k]), place[end[k]]


def with_words(items: list[tuple[int, str]], share: float = LEAST_SHARE) -> Items:
    return Items([(i, w) for i, t in items if len(w := tokens(t or ""))], share)


def best_score(item: np.ndarray, passage: np.ndarray) -> float:
    """Best local alignment score alone."""
    n = len(passage)
    ramp = np.arange(n + 1) * -GAP
    row, best = np.zeros(n + 1), 0.0
    gain = np.where(passage[None, :] == item[:, None], MATCH, MISMATCH)
    for own in gain:
        new = row + GAP
        np.maximum(new[1:], row[:-1] + own, out=new[1:])
        np.maximum(new, 0, out=new)
        new += ramp
        row = np.maximum.accumulate(new)
        row -= ramp
        best = max(best, row.max())
    return float(best)


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment score and the passage words ``[start, end)`` that it covers."""
    n = len(passage)
    ramp = np.arange(n + 1) * -GAP
    row, begin = np.zeros(n + 1), np.arange(n + 1)
    best = (0.0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        up = row[1:] + GAP
        new, source = np.zeros(n + 1), np.arange(n + 1)
        source[1:] = np.where(diagonal >= up, begin[:-1], begin[1:])
        new[1:] = np.maximum(diagonal, up)
        source[new <= 0] = np.flatnonzero(new <= 0)
        np.maximum(new, 0, out=new)
        lifted = new + ramp
        top = np.maximum.accumulate(lifted)
        carried = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        row, begin = top - ramp, source[carried]
        if (peak := row.max()) > best[0]:
            end = int(row.argmax())
            best = (float(peak), int(begin[end]), end)
    return best


def leaks(words: np.ndarray, items: Items) -> list[tuple[int, float, int, int]]:
    """``(item number, share, start, end)`` of the best alignment of each item found."""
    if not len(items.items):
        return []
    longest = int(items.reach.max())
    chunk = max(CHUNK_WORDS, 2 * longest)
    spans: dict[int, list[list[int]]] = defaultdict(list)
    # Chunks overlap by the longest alignment, so that each lies in one of them as a whole.
    for first in range(0, max(1, len(words) - longest), chunk - longest):
        part = words[first : first + chunk]
        for number, ends in items.near(part):
            merged, reach = spans[number], int(items.reach[number])
            for end in (ends + (first + 1)).tolist():
                begin = max(0, end - reach)
                if merged and begin <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([begin, end])
    out = []
    for number, merged in spans.items():
        item = items.items[number][1]
        best = (0.0, 0, 0)
        for a, b in merged:
            if best_score(item, words[a:b]) < max(best[0], items.need[number]):
                continue
            score, start, end = smith_waterman(item, words[a:b])
            if score > best[0]:
                best = (score, a + start, a + end)
        if best[0] >= items.need[number]:
            out.append((number, best[0] / len(item), best[1], best[2]))
    return sorted(out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", share: float = LEAST_SHARE, pass_words: int = PASS_WORDS) -> DataFrame:
    """Documents that hold a test item, an edited copy of one or an excerpt of 13 words in net.

    Every word of an item is a seed. Where the words that a text and an item have in common
    could add up to the least score, they are aligned word by word; this bound leaves out no
    pair that reaches it, however the copy is edited and however many copies there are.
    Each pass over the whole texts carries at most ``pass_words`` words of test items, with
    further items in further passes, and shuffles nothing.

    Returns ``rid, doc_id, item_id, score, start, end``, one row per document and item found:
    ``score`` is the alignment's share of the item's own, ``start`` and ``end`` word offsets.
    Null and empty texts, and items without words, match nothing; null ids stay null;
    repeated rows and repeated items are reported each; empty tables give no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = numbered(docs, id_col, text_col)
    schema = "rid long, doc_id long, item_id long, score double, start long, end long"
    out = None
    for part in _parts(benchmark, item_id_col, item_text_col, pass_words):
        found = _one_pass(rows, with_words(part, share), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _parts(benchmark: DataFrame, item_id_col: str, item_text_col: str, pass_words: int) -> list[list[tuple[int, str]]]:
    """Items, in parts of about ``pass_words`` words."""
    parts, size = [[]], 0
    for item in benchmark.select(F.col(item_id_col).cast("long"), F.coalesce(F.col(item_text_col).cast("string"), F.lit(""))).toLocalIterator():
        if size and size + len(item[1]) > 6 * pass_words:
            parts.append([])
            size = 0
        parts[-1].append((item[0], item[1]))
        size += len(item[1])
    return parts


def _clean_of(items: Items):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not leaks(words, items) for words in batch_tokens([t or "" for t in texts])], dtype=bool)

    return clean


def clean_column(benchmark: DataFrame, item_id_col: str = "item_id", item_text_col: str = "text", share: float = LEAST_SHARE, pass_words: int = PASS_WORDS):
    """A function of a text column: true where ``decontaminate`` finds no item.

    A null or empty text is clean. Each row is judged where it is read.
    """
    small_batches(benchmark.sparkSession)
    columns = [_clean_of(with_words(part, share)) for part in _parts(benchmark, item_id_col, item_text_col, pass_words)]

    def judged(text):
        out = F.lit(True)
        for clean in columns:
            out = out & clean(text)
        return out

    return judged


def _one_pass(rows: DataFrame, items: Items, schema: str) -> DataFrame:
    def align(batches):
        for batch in batches:
            found = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id")), batch_tokens(batch.column("body").to_pylist()), strict=True)
            for rid, doc_id, words in rows:
                found += [(rid, doc_id, items.items[n][0], score, a, b) for n, score, a, b in leaks(words, items)]
            columns = list(zip(*found, strict=True)) if found else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["rid", "doc_id", "item_id", "score", "start", "end"])

    return rows.mapInArrow(align, schema)

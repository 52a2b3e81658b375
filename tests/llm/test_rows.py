"""Rows, words and packed blocks: what the operators build on."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from galena.llm import _words, exact_dedup, near_dedup, repeated_spans, row_filter
from galena.llm._shingles import shingle_sets

LETTERS = "abAB \t\n\x0b\x0c\r\x1c\x85\xa0é你Z."


@pytest.mark.parametrize("tile", [1 << 20, 64, 7])
def test_batch_words(tile, monkeypatch):
    monkeypatch.setattr(_words, "TILE", tile)
    rng = random.Random(3)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30))) for _ in range(500)] + ["", "x" * 500, " " * 400, "ab " * 300]
    got, known = list(_words.batch_words(pa.array(texts))), {}
    for text, hashes in zip(texts, got, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        assert len(words) == len(hashes)
        assert all(known.setdefault(w, h) == h for w, h in zip(words, hashes.tolist(), strict=True))
        assert np.array_equal(_words.text_words(text), hashes)
    assert len(set(known.values())) == len(known)
    assert all(np.array_equal(a, b) for a, b in zip(_words.batch_words(pa.array(texts)[5:99]), got[5:99], strict=True))
    assert list(_words.batch_words(pa.array([], pa.string()))) == []


def test_shingle_sets():
    sets = [len(s) for s in shingle_sets(pa.array(["", "a b", "a b c d e", "a b c d e f", "x x x x x x x x"]), 5)]
    assert sets == [0, 1, 1, 2, 1]


def test_blocks_count_shingles_in_common(monkeypatch):
    monkeypatch.setattr(near_dedup, "COMMON", 7)
    rng = np.random.default_rng(1)
    sides = []
    for n in (9, 5):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(n)]
        block = near_dedup.unpack_block(near_dedup.pack_block(np.arange(n), np.arange(n) + 3, sets))
        assert block[0].tolist() == list(range(n)) and block[2].tolist() == [len(s) for s in sets]
        sides.append((sets, block))
    both = near_dedup.in_common(sides[0][1], sides[1][1])
    assert both.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sides[1][0]] for a in sides[0][0]]


@pytest.mark.parametrize("width", [1, 3, 8, 20, 40])
def test_radix_passes(width):
    rng = np.random.default_rng(width)
    data = rng.integers(97, 99 if width < 9 else 98, 900).astype(np.uint8)
    data[rng.integers(0, 900, 60)] = 120
    starts, group = np.arange(0, 900 - width), rng.integers(0, 3, 900 - width)
    seen = collections.Counter((int(g), data[s : s + width].tobytes()) for s, g in zip(starts, group, strict=True))
    want = [seen[int(g), data[s : s + width].tobytes()] > 1 for s, g in zip(starts, group, strict=True)]
    assert repeated_spans.repeated_suffixes(data, starts, group, width).tolist() == want
    assert sum(size for _, size in repeated_spans._digits(width)) == width


def test_radix_passes_of_nothing():
    assert len(repeated_spans.repeated_suffixes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), 400)) == 0
    assert repeated_spans.repeated_in([], 400) == []


def split_anew(monkeypatch, spark, module):
    """From one reading to the next, files are cut into other partitions."""
    plain, turn = module.checkpointed, [0]

    def checkpointed(df):
        out = plain(df)
        turn[0] += 1
        size = str(("128m", "2k", "40k")[turn[0] % 3])
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0" if turn[0] % 2 else "4m")
        return out

    monkeypatch.setattr(module, "checkpointed", checkpointed)


@pytest.mark.parametrize("module, operator, columns", [
    (near_dedup, near_dedup.near_dedup, ("doc_id", "n_shingles", "component_id")),
    (repeated_spans, lambda d: repeated_spans.repeated_spans(d, width=40), ("doc_id", "n_removed", "n_spans", "kept_sha256")),
    (exact_dedup, exact_dedup.exact_dedup, ("doc_id", "keep_id", "group_size", "text_sha256")),
])
def test_readings_may_be_split_otherwise(spark, odd_docs, module, operator, columns, monkeypatch):
    def result():
        return collections.Counter(tuple(r) for r in operator(odd_docs).select(*columns).collect())

    want = result()
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    split_anew(monkeypatch, spark, module)
    try:
        assert result() == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("bits", [1 << 23, 8])
def test_keep_judged(spark, tmp_path, bits):
    """Columns of any name and kind stay; of repeated rows one stays; null ids are ids."""
    names = ["doc_id", "text", "rid_listed", "RID", "Row", "DOUBT", "key_a", "id", "none", "a`b.c"]
    rows = [(i if i % 9 else None, None if i % 7 == 0 else f"t{i % 40}", f"x{i}", i, i, i, i, i, True, [i]) for i in range(200)] + [(500, "same", "one", 1, 1, 1, 1, 1, None, [1])] * 6
    schema = ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in zip(names, "long string string int int int int int boolean array<int>".split(), strict=True))
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    judged = exact_dedup.exact_dedup(docs)
    got = row_filter.keep_judged(docs, judged, bits=bits)
    assert got.schema == docs.schema
    best: dict = {}
    for r in rows:
        text = r[1] or ""
        best[text] = max([best.get(text, -1), -1 if r[0] is None else r[0]])
    kept = [tuple(r) for r in got.collect()]
    assert sorted((r[1] or "", -1 if r[0] is None else r[0]) for r in kept) == sorted(best.items())
    assert all(r in rows for r in kept)
    assert row_filter.keep_judged(docs.limit(0), judged.limit(0)).collect() == []

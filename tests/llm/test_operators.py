"""Each operator against a brute-force version, over odd rows and over an empty table."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from galena.llm import exact_dedup as ed
from galena.llm import secret_scan as ss
from galena.llm import simple8b as s8
from galena.llm import toxicity
from galena.llm._exchange import pack_sorted, squeeze, unpack_sorted, unsqueeze
from galena.llm.bpe import bpe_round_trip, decode, encode, encoding, safe_pieces
from galena.llm.decontaminate import Items, batch_tokens, best_score, decontaminate, leaks, smith_waterman, tokens
from galena.llm.interpolation import interpolated_scores
from galena.llm.near_dedup import near_dedup, sketch
from galena.llm.queries import RANK_FILE, WORD_FILE
from galena.llm.repeated_spans import repeated_spans
from galena.llm.sharding import pack_ranges, ranges_for, shard_by_splitters, weighted_splitters, whole_keys
from galena.llm.toxicity import fit_toxicity, score_toxicity

OPERATORS = {
    "secrets": lambda d: secret_scan_all(d),
    "scores": lambda d: interpolated_scores(d),
    "exact": lambda d: ed.exact_dedup(d),
    "bpe": lambda d: bpe_round_trip(d, RANK_FILE, public_tokenizers.PATTERN),
    "files": lambda d: s8.token_files(d, WORD_FILE, 1),
    "shards": lambda d: shard_by_splitters(d),
    "near": lambda d: near_dedup(d),
    "spans": lambda d: repeated_spans(d),
}


def secret_scan_all(docs):
    return ss.secret_scan(docs)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(no_docs, name):
    assert OPERATORS[name](no_docs).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_input_row(odd_docs, odd_rows, name):
    got = [r["doc_id"] for r in OPERATORS[name](odd_docs).collect()]
    assert collections.Counter(got) == collections.Counter(r[0] for r in odd_rows)


def test_exact_dedup(odd_docs, odd_rows):
    got = ed.exact_dedup(odd_docs, filter_rows=8).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in odd_rows:
        groups[t or ""].append(i)
    assert sum(r["kept"] for r in got) == len(groups)
    for r in got:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        known = [i for i in own if i is not None]
        assert r["group_size"] == len(own) and r["keep_id"] == (max(known) if known else None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]


def test_counting_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    top = np.uint64(5 << 60)
    parts = [(rng.integers(0, 1 << 60, 500, dtype=np.uint64) % np.uint64(1 << 9)) * np.uint64(1 << 50) | top for _ in range(3)]
    filters = [ed.CountingQuotientFilter.from_bytes(ed.CountingQuotientFilter.build(p, None, 4).to_bytes()) for p in parts]
    merged = ed.merge_filters(filters, 5, 4)
    want = collections.Counter(np.concatenate(parts).tolist())
    assert dict(zip(merged.fingerprints(5, 4).tolist(), merged.counts.tolist(), strict=True)) == want


def test_bpe_matches_the_library(odd_docs):
    enc = encoding(RANK_FILE, public_tokenizers.PATTERN)
    for r in odd_docs.select("text").collect():
        text = r[0] or ""
        assert encode(text, enc, piece_chars=50).tolist() == enc.encode_ordinary(text)
        assert "".join(safe_pieces(text, 50)) == text
    for text in ("a  b \n\n c  d  \x1c e 's 're", " " * 500 + "x", "a\n" * 300):
        assert encode(text, enc, piece_chars=3).tolist() == enc.encode_ordinary(text)
    for r in bpe_round_trip(odd_docs, RANK_FILE, public_tokenizers.PATTERN, with_ids=True).collect():
        assert r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest()
    texts = sorted(hashlib.sha256((r[0] or "").encode()).hexdigest() for r in odd_docs.select("text").collect())
    assert texts == sorted(r["decoded_sha256"] for r in bpe_round_trip(odd_docs, RANK_FILE, public_tokenizers.PATTERN).collect())


def test_bpe_of_long_runs_of_white_space():
    """Runs that the library can still take whole, and runs that it cannot."""
    enc = encoding(RANK_FILE, public_tokenizers.PATTERN)
    for run in (" " * 70_000, "\n" * 70_000, " \t\r\n\u3000\x85" * 12_000, "\x1c" * 70_000):
        for text in (run, "a" + run, run + "a", f"a{run}b\n{run}.{run[:-1]}", f"{run}\x1c{run}\u00e9"):
            assert encode(text, enc).tolist() == enc.encode_ordinary(text)
    for text in (" " * 2_000_000, "a" + "\n" * 1_500_000 + "b", " " * 1_000_000 + "x" + " " * 1_000_000 + "\t"):
        assert decode(encode(text, enc), enc) == text.encode()


@pytest.mark.parametrize("values", [[], [0], [1] * 500, [2**60 - 1, 2**60, 2**64 - 1, 0], list(range(3000)), [2**i for i in range(64)] * 3, [0] * 61 + [9] * 61])
def test_simple8b_round_trip(values):
    values = np.array(values, np.uint64)
    words, escapes = s8.pack(values)
    assert np.array_equal(s8.unpack(words, escapes), values)


def test_simple8b_packs_as_many_as_fit():
    words, _ = s8.pack(np.ones(120, np.uint64))
    assert len(words) == 2
    words, _ = s8.pack(np.full(400, 40_000, np.uint64))
    assert len(words) == 134


def test_token_files(odd_docs, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_FILE)
    got = s8.token_files(odd_docs, WORD_FILE, 1, path=str(tmp_path / "files"), files=4).collect()
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    want = collections.Counter()
    for r in odd_docs.select("doc_id", "text").collect():
        own = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want[r["doc_id"], len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert want == collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got)


@pytest.mark.parametrize("char", [*"\x1c\x1d\x1e\x1f\x85\xa0\u2028\u3000\u200b\ufeff"])
def test_word_ids_are_those_of_the_whole_text(char):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_FILE)
    for text in (f"a{char}b", f"One {char} two,{char}{char}three. {char}", f"{char}don't{char}.", char):
        ids = np.frombuffer(s8.word_ids(WORD_FILE).encode(text), "<u4")
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["x <|endoftext|> y", "x<|startoftext|>y.", "<|endoftext|>,", "X <|ENDOFTEXT|>\x1c<|endoftext|>"])
def test_word_ids_of_special_tokens_are_the_librarys(text):
    from tokenizers import Tokenizer

    ids = np.frombuffer(s8.word_ids(WORD_FILE).encode(text), "<u4")
    assert ids.tolist() == Tokenizer.from_file(WORD_FILE).encode(text, add_special_tokens=False).ids


def test_word_ids_of_any_text_are_the_librarys():
    from tokenizers import Tokenizer

    rng, tok, table = random.Random(1), Tokenizer.from_file(WORD_FILE), s8.word_ids(WORD_FILE)
    marks = ["\u0130", "\u017f", "\u1e9e", "\u03a3", "\u0307", "\u0301", "<|endoftext|>", "'s", "'ll", "...", ".,", "\u4f60", " ", " ", " ", ",", ".", ",", "."]
    letters = [chr(c) for c in range(0x250)] + marks * 4
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(8000)]
    for text in [*texts, "\u0130,", "a).b", "e.g. 4.0, and so on."]:
        assert np.frombuffer(table.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_files_follow_the_size():
    class Total:
        def __init__(self, n):
            self.n = n

        def agg(self, _):
            return self

        def first(self):
            return [self.n]

    assert [s8.files_for(Total(n), 50) for n in (0, 1, 100 << 20, 800 << 20, 100 << 30)] == [1, 1, 7, 50, 400]


def test_shards(odd_docs, odd_rows):
    got = shard_by_splitters(odd_docs, shards=3).collect()
    for shard in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
    assert want == collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)


def test_shards_are_even_around_a_hot_group(spark, tmp_path):
    rows = [(i, "hot text " * 20 if i % 3 == 0 else f"text {i} " * (1 + i % 40)) for i in range(6000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = shard_by_splitters(spark.read.parquet(str(tmp_path / "d"))).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() / sizes.min() < 1.05
    cool = got[got.doc_id % 3 != 0].groupby("text_crc32")["shard"].nunique()
    assert (cool == 1).all()


def test_ranges_grow_with_the_bytes():
    assert [ranges_for(n, 8) for n in (0, 1 << 30, 1 << 40, 1 << 47)] == [64, 64, 512, 8192]


def test_shards_against_brute_force(spark, tmp_path):
    """Ranges are runs of hash order, each in one shard, and slots follow that order."""
    rng = random.Random(9)
    rows = [(i, "word " * rng.randint(0, 60) + str(i // 3)) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    hashed = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("text")).collect()}
    got = shard_by_splitters(docs, shards=4, ranges_per_shard=8).collect()
    by_key = sorted(got, key=lambda r: hashed[r["doc_id"]])
    switches = sum(a["shard"] != b["shard"] for a, b in zip(by_key, by_key[1:], strict=False))
    assert 3 <= switches < 200
    for shard in range(4):
        own = sorted((r for r in got if r["shard"] == shard), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        keys = [hashed[r["doc_id"]] for r in own]
        assert keys == sorted(keys)
    texts = dict(rows)
    homes = collections.defaultdict(set)
    for r in got:
        homes[texts[r["doc_id"]]].add(r["shard"])
        assert r["size"] == len(texts[r["doc_id"]]) + 1
    assert all(len(h) == 1 for h in homes.values())
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert max(sizes) < 1.1 * min(sizes)


def test_splitters():
    keys = np.repeat(np.arange(10), 100)
    cuts = weighted_splitters(keys, np.arange(1000), np.ones(1000), 10)
    assert len(cuts) == 9 and [k for k, _ in cuts] == sorted(k for k, _ in cuts)
    assert weighted_splitters(keys[:0], keys[:0], keys[:0], 4) == []
    assert whole_keys([(3, 5), (3, 9), (4, 1)]) == [(3, -(1 << 63)), (3, 5), (3, 9), (4, -(1 << 63))]
    home = pack_ranges([(0, 50, 1), (1, 30, 1), (2, 20, 1)], {}, 2)
    assert home[0] != home[1] == home[2]


def base_brute(text):
    out = []
    for m in re.finditer(ss.ASSIGN, text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((*m.span(), "assign"))
    out += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return out


def test_secrets(spark, tmp_path):
    key = "Zq8vN3kLw0Rt5yUx7PbS2d"
    rows = [(1, f"a {key} b", "own"), (2, "PASSWORD: 'hunter2hunter2' token=short Api_Key = abcdef.12345", "own"), (3, "copied Ab1Cd2Ef3Gh4Ij5Kl6Mn7", "x"), (4, "copied Ab1Cd2Ef3Gh4Ij5Kl6Mn7", "y"), (5, "0123456789abcdef" * 3 + " secret=" + "f" * 40, None), (6, None, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r for r in ss.secret_scan(spark.read.parquet(str(tmp_path / "d"))).collect()}
    for i, t, _ in rows:
        base = base_brute(t or "")
        assert [got[i][f"n_{k}"] for k in ss.KINDS[:3]] == [sum(x[2] == k for x in base) for k in ss.KINDS[:3]]
        assert got[i]["base_sha256"] == hashlib.sha256(ss.written(base).encode()).hexdigest()
    assert got[1]["spans"] == f"live:2:{2 + len(key)}" and got[3]["spans"] == "" and got[6]["spans"] == ""


def test_secret_spans_against_brute_force(spark, tmp_path):
    """Every column, with values of one or several owners, repositories and many uses."""
    rng = random.Random(12)
    letters = "abcdefghABCDEFGH0123456789+/_-"
    values = ["".join(rng.choice(letters) for _ in range(rng.randint(15, 40))) for _ in range(60)] + ["a1" * 15, "AKIA" + "Q7" * 9, "0f" * 20]
    rows = []
    for i in range(400):
        own = [rng.choice(values[:40]) if rng.random() < 0.1 else values[40 + (i % 5)] if i % 7 == 0 else "word" for _ in range(rng.randint(0, 6))]
        own += [f"token={values[i % 60]}"] if i % 11 == 0 else []
        own += [values[-1]] if i % 40 == 0 else []
        rows.append((i if i % 50 else None, " ".join(own) if i % 23 else None, rng.choice(["en", "de", None]), rng.choice([None, *"stuv"]) if i % 5 else "s"))
    rows += [(1000 + k, f"x {values[45]}z9z9z9z9z9 y", "en", "s") for k in range(30)] + [(2000 + k, f"x {values[46]}z9z9z9z9z9 y", "en", None) for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(str(tmp_path / "d"))
    uses, spans = [], []
    for i, text, lang, owner in rows:
        text = text or ""
        base = base_brute(text)
        more = [(*m.span(), "live") for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        more = [m for m in more if ss.entropy(text[m[0] : m[1]]) >= 3 and all(m[1] <= a or m[0] >= b for a, b, _ in base)]
        own = [(a, b, k, re.fullmatch(ss.ASSIGN, text[a:b], re.I | re.A)[2] if k == "assign" else text[a:b]) for a, b, k in base + more]
        spans.append(own)
        uses += [(v, "/".join(x for x in (owner, lang) if x), owner) for *_, v in own]
    want = collections.Counter()
    for (i, *_), own in zip(rows, spans, strict=True):
        counts = {v: (len({r for x, r, _ in uses if x == v}), len({o for x, _, o in uses if x == v}), sum(x == v for x, _, _ in uses)) for *_, v in own}
        live = lambda v: counts[v][1] <= 1 and counts[v][0] <= 3 and counts[v][2] <= 20 and ss.entropy(v) >= 3  # noqa: B023, E731
        kept = [(a, b, k, v) for a, b, k, v in own if k != "live" or live(v)]
        most = [max([counts[v][n] for *_, v in kept], default=0) for n in range(3)]
        want[i, ss.written([s[:3] for s in kept]), sum(live(v) for *_, v in kept), sum(not live(v) for *_, v in kept), *most] += 1
    repo = {"repo_col": F.concat_ws("/", "source", "lang"), "owner_col": "source"}
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = ss.secret_scan(docs, **repo).collect()
    assert want == collections.Counter((r["doc_id"], r["spans"], r["n_live"], r["n_example"], r["most_repos"], r["most_owners"], r["most_uses"]) for r in got)
    table = {r["value"]: (r["n_repos"], r["n_owners"], r["n_uses"]) for r in ss.secret_values(docs, **repo).collect()}
    assert table == {hashlib.sha256(v.encode()).hexdigest(): (len({r for x, r, _ in uses if x == v}), len({o for x, _, o in uses if x == v}), sum(x == v for x, _, _ in uses)) for v, *_ in uses}


def test_interpolation(odd_docs, odd_rows):
    got = interpolated_scores(odd_docs, block_tokens=500).collect()
    counts = collections.Counter()
    for i, t, *_ in odd_rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            counts.update([*split(t or ""), None])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t, *_ in odd_rows:
        own = [*split(t or ""), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        want[i, len(own), sum(counts[w] > 0 for w in own), n, round(base, 5)] += 1
    assert want == collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got)
    assert all(r["score"] < 0 for r in got)


def test_interpolation_is_a_distribution(spark, tmp_path):
    """Probabilities of all next words after a context sum to one."""
    rows = [(i, " ".join("abc"[(i * k) % 3] for k in range(1, 1 + i % 7))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    tests = [(10_000 + k, w) for k, w in enumerate(["", "a", "b", "c", "new"])]
    tests = [(next(j for j in range(10_000 * (k + 1), 10_000 * (k + 2)) if zlib.crc32(str(j).encode()) % 7 == 2), w) for k, (_, w) in enumerate(tests)]
    spark.createDataFrame(tests, "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: 10 ** r["score"] for r in interpolated_scores(spark.read.parquet(str(tmp_path / "d"))).collect()}
    # P(end | start) plus, for each word, P(word, end): all at most one together.
    assert 0 < sum(got[i] for i, _ in tests) <= 1.0


def jaccard_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = split(t or "")
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    return sets, [groups[find(k)] for k in range(len(rows))]


@pytest.mark.parametrize("small,block,rounds", [(24, 256, 2), (1, 3, 0), (1, 4, 1), (1000, 8, 0)])
def test_near_dedup(odd_docs, odd_rows, small, block, rounds):
    sets, groups = jaccard_components(odd_rows)
    want = collections.Counter()
    for (i, *_), s, g in zip(odd_rows, sets, groups, strict=True):
        known = [x for x in g if x is not None]
        want[i, len(s), min(known) if known else None] += 1
    got = near_dedup(odd_docs, small_bucket=small, block=block, pivot_rounds=rounds).collect()
    assert want == collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)
    assert len({r["keep_rid"] for r in got}) == sum(r["rid"] == r["keep_rid"] for r in got)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    both = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    a, b = sketch(both[:500], 250), sketch(both[100:], 250)
    assert abs((a == b).mean() - 400 / 600) < 0.15
    assert (sketch(both[:1], 250) < np.iinfo(np.uint64).max).all()


@pytest.mark.parametrize("width, places", [(40, 4096), (400, 4096), (40, 5), (400, 0), (7, 30)])
def test_repeated_spans(odd_docs, odd_rows, width, places):
    raw = [(t or "").encode() for _, t, *_ in odd_rows]
    seen = collections.Counter(b[p : p + width] for b in raw for p in range(len(b) - width + 1))
    want = collections.Counter()
    for (i, *_), b in zip(odd_rows, raw, strict=True):
        mask = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                mask[p : p + width] = b"\1" * width
        runs = len(re.findall(b"\1+", bytes(mask)))
        want[i, len(b), sum(mask), runs, hashlib.sha256(bytes(x for x, m in zip(b, mask, strict=True) if not m)).hexdigest()] += 1
    got = repeated_spans(odd_docs, width=width, block_bytes=20_000, ordered_places=places, bucket_suffixes=500).collect()
    assert want == collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)


def test_decontamination(spark, tmp_path):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    items = [[word() for _ in range(30)] for _ in range(10)]
    filler = lambda n: [word() for _ in range(n)]
    edited = [w if k % 6 else word() for k, w in enumerate(items[1])]
    rows = [(1, filler(50) + items[0] + filler(20)), (2, filler(40) + edited + filler(10)), (3, filler(100)), (4, filler(30) + items[2][:4] + filler(30))]
    docs = [(i, " ".join(w)) for i, w in rows] + [(5, None), (None, " ".join(items[3]).upper())] + [(100 + k, " ".join(filler(5) + items[4])) for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(50, None), (51, "")], "item_id long, text string")
    for size in (1 << 21, 20):
        got = decontaminate(spark.read.parquet(str(tmp_path / "d")), bench, pass_words=size).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 0), (2, 1), (None, 3)} | {(100 + k, 4) for k in range(40)}
    assert decontaminate(spark.read.parquet(str(tmp_path / "d")), bench.limit(0)).collect() == []


@pytest.mark.parametrize("copies", [0, 3])
def test_decontamination_of_copies_edited_throughout(spark, tmp_path, copies):
    """Unchanged runs of two to four words, with exact copies and broken parts elsewhere."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 5))
    item = [word() for _ in range(40)]
    filler = [word() for _ in range(3000)]
    docs = {n: filler[:30] + [word() if k % n == n - 1 else w for k, w in enumerate(item)] + filler[:30] for n in (3, 4, 5)}
    docs[6] = filler[:1500] + [x for k, w in enumerate(item) for x in ([w, word()] if k % 2 else [w])] + filler[1500:]
    docs[7] = filler + item[:12]
    docs |= {100 * (k + 1) + n: item if n == 9 else docs[n] for k in range(copies) for n in (5, 9)}
    spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontaminate(spark.read.parquet(str(tmp_path / "d")), bench).collect()}
    assert set(got) == set(docs) - {7}
    assert got == {i: smith_waterman(tokens(" ".join(item)), tokens(" ".join(docs[i])))[0] / 40 for i in got}


def test_tokens_are_runs_of_letters_and_digits():
    rng, known = random.Random(5), {}
    texts = ["".join(rng.choice("aA\u00e9\u00c9\u00df_\u0130 .,-\u20141\u00b2\u03a3\u4f60\u0307\u01c5") for _ in range(rng.randint(0, 20))) for _ in range(1000)]
    for text, hashes in zip(texts, batch_tokens(texts), strict=True):
        words = re.findall(r"[^\W_]+", text.lower())
        assert len(words) == len(hashes)
        assert all(known.setdefault(w, h) == h for w, h in zip(words, hashes.tolist(), strict=True))
    assert len(set(known.values())) == len(known)


def test_leaks_against_plain_alignment():
    """Whatever an alignment of a whole text with each item finds, the bounds let through."""
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    word = lambda n: np.where(rng.random(n) < 0.5, rng.choice(common, n), rng.integers(0, 1 << 63, n, dtype=np.uint64))
    items = Items([(k, word(int(rng.integers(3, 70)))) for k in range(25)])
    for _ in range(40):
        text = word(int(rng.integers(1, 2500)))
        for k in rng.integers(0, 25, 2):
            item = items.items[int(k)][1]
            copy = item[rng.random(len(item)) < rng.uniform(0.3, 1)]
            at = int(rng.integers(0, len(text) + 1))
            text = np.r_[text[:at], copy, text[at:]]
        want = {k: smith_waterman(item, text)[0] / len(item) for k, item in items.items if best_score(item, text) >= items.need[k]}
        assert {k: score for k, score, _, _ in leaks(text, items)} == want


def test_decontamination_of_excerpts():
    """A run of words counts whatever its share of the item; a shorter one does not."""
    rng = np.random.default_rng(9)
    words = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    items = Items([(k, words(n)) for k, n in enumerate((59, 500, 20))])
    for number, length in ((0, 25), (1, 200), (1, 13), (1, 12), (2, 10), (2, 9)):
        item = items.items[number][1]
        got = leaks(np.r_[words(2000), item[7 : 7 + length], words(70)], items)
        assert got == ([(number, length / len(item), 2000, 2000 + length)] if length not in (12, 9) else [])


def test_smith_waterman_against_the_plain_recurrence():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.integers(0, 4, 9).astype(np.uint64), rng.integers(0, 4, 14).astype(np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -0.5), h[i, j + 1] - 0.5, h[i + 1, j] - 0.5)
        score, start, end = smith_waterman(a, b)
        assert score == h.max() == best_score(a, b) and 0 <= start < end <= len(b)
    assert len(tokens("")) == 0


def test_toxicity(spark, tmp_path, no_docs):
    import random

    rng = random.Random(8)
    bad = ["vile", "rotten", "nasty", "horrid", "filth"]
    good = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        text = [rng.choice(good) for _ in range(80)]
        if toxic:
            for w in rng.sample(bad, 3):
                text.insert(rng.randrange(len(text)), w)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "vile rotten nasty")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    table = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = fit_toxicity(docs, table.where("doc_id % 3 <> 0 or doc_id is null"))
    got = {r["doc_id"]: r for r in score_toxicity(docs, model).collect()}
    held = [i for i in range(900) if i % 3 == 0]
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) / len(held) > 0.97
    assert got[1000]["score"] == got[1001]["score"] and got[1000]["predicted"] == 0 and got[None]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert score_toxicity(no_docs, model).collect() == []
    blank = fit_toxicity(docs, table.limit(0))
    assert len({r["score"] for r in score_toxicity(docs, blank).collect()}) == 1


def test_toxic_words_of_unseen_endings():
    """The dictionaries hold strings, not words: new forms of toxic stems are found."""
    rng = random.Random(4)
    good = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    endings = rng.sample([a + b + c for a in "aeioulmnrst" for b in "aeioulmnrst" for c in "aeioulmnrst"], 200)
    stems = ["zvagh", "quiff", "bdobk"]
    text = lambda own: " ".join(rng.choice(good) if k % 12 else f"{rng.choice(stems)}{rng.choice(own)}" if own else rng.choice(good) for k in range(120))
    taught = [text(endings[:100]) for _ in range(200)]
    model = toxicity.train([text(None) for _ in range(300)], taught)
    rows = [(text(endings[:100]), 1) for _ in range(60)] + [(text(None), 0) for _ in range(120)]
    toxicity.calibrate(model, np.array([y for _, y in rows], float), np.array([toxicity.features(model.gains(t)) for t, _ in rows]))
    unseen = [text(endings[100:]) for _ in range(50)]
    assert sum(model.score(t) >= 0.3 for t in unseen) >= 48
    assert sum(model.score(text(None)) >= 0.3 for _ in range(100)) <= 3
    assert not {w for t in unseen for w in t.split() if w[:5] in stems} & {w for t in taught for w in t.split()}


def test_windows_cover_the_whole_text():
    found = toxicity.words("A b, c! " * 7)
    assert b"".join(toxicity.windows(found, 4, 4)).split() == [w.encode() for w in found]
    for n in range(1, 60):
        numbers = [str(k) for k in range(n)]
        assert {w.decode() for x in toxicity.windows(numbers) for w in x.split()} == set(numbers)
    assert toxicity.windows([]) == [] and toxicity.features(np.zeros(0, np.int64)).tolist()[1:] == [0] * 7


def test_packed_integers():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert np.array_equal(unpack_sorted(pack_sorted(keys)), keys)
    assert np.array_equal(unsqueeze(squeeze(np.array([0, 300, 5]))), [0, 300, 5])
    assert len(unsqueeze(squeeze(np.zeros(0)))) == 0

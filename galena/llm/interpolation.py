"""Language-model scores by deleted interpolation of corpus-wide n-gram counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm._common import checkpointed, mixed, numbered, small_batches
from galena.llm._exchange import PACKETS, answered, buckets_for, packets, tallied, totals
from galena.llm._words import batch_words

#: Tokens of one block of documents.
BLOCK_TOKENS = 1 << 20
#: Bits of a pair's key within its bucket of about a million. About one pair in a million
#: shares a key with another, at any size of the corpus; single words keep 64 bits.
PAIR_BITS = 40
#: Contexts are put in buckets by the binary logarithm of their frequency, up to this one.
CONTEXT_BUCKETS = 20
#: Natural-log steps into which probabilities are cut for the weights' estimation.
LOG_STEP = 0.125
EM_ROUNDS = 60
#: Least weight of a mixture's part, so that no token has probability 0.
LEAST_WEIGHT = 1e-6

#: Hashes of the end of a text, which is a token, and of its start, which is only a context.
END, START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
_PAIR = np.array([0x9FB21C651E98DF25, 0xC13FA9A902A6328F], np.uint64)


@dataclass
class Mixture:
    """Weights of bigram, unigram and uniform estimates by context bucket."""

    weights: np.ndarray
    tokens: int
    types: int

    def probability(self, pair: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        w = self.weights[context_bucket(context)]
        return (w * parts(pair, context, word, self.tokens, self.types)).sum(1)


def context_bucket(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + floor(log2(frequency)), up to the last bucket."""
    exponent = np.frexp(context.astype(np.float64))[1]
    return np.minimum(np.where(context > 0, exponent, 0), CONTEXT_BUCKETS)


def parts(pair: np.ndarray, context: np.ndarray, word: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """Maximum-likelihood bigram and unigram estimates, and the uniform one, as columns."""
    bigram = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
    uniform = np.full(len(word), 1.0 / (types + 1))
    return np.stack([bigram, word / tokens if tokens else uniform, uniform], 1)


def estimate(histogram: np.ndarray, tokens: int, types: int) -> Mixture:
    """Expectation-maximisation on held-out counts.

    ``histogram`` rows: context bucket, log steps of the bigram and unigram estimates (-1:
    the estimate is 0), held-out tokens. Buckets without held-out tokens take the weights of
    all buckets together.
    """

    def em(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        p = np.stack([np.where(rows[:, 1] < 0, 0, np.exp(-rows[:, 1] * LOG_STEP)), np.where(rows[:, 2] < 0, 0, np.exp(-rows[:, 2] * LOG_STEP)), np.full(len(rows), 1.0 / (types + 1))], 1)
        n, w = rows[:, 3].astype(float), start
        for _ in range(EM_ROUNDS if len(rows) else 0):
            share = p * w
            share /= share.sum(1, keepdims=True)
            w = np.maximum((share * n[:, None]).sum(0) / n.sum(), LEAST_WEIGHT)
            w = w / w.sum()
        return w

    every = em(histogram, np.array([0.5, 0.4, 0.1]))
    own = [em(histogram[histogram[:, 0] == b], every) for b in range(CONTEXT_BUCKETS + 1)]
    return Mixture(np.array(own), tokens, types)


def remainders(doc_ids: list[int | None], modulus: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % modulus for d in doc_ids], np.int64)


def _write_block(rids: list[int], doc_ids: list[int | None], lengths: list[int], hashes: list[np.ndarray]) -> tuple[bytes, int, int]:
    vocabulary, local, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    # Frequent words get small numbers, whose upper bytes are zeros and compress well.
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    vocabulary, local = vocabulary[order], rank[local]
    planes = local.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()
    known = np.array([d is not None for d in doc_ids], "<i8")
    head = np.array([len(rids), len(vocabulary)], "<i8")
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    raw = b"".join(x.tobytes() for x in (head, np.array(rids, "<i8"), ids, known, np.array(lengths, "<i8"), vocabulary.astype("<u8"), planes))
    return zstandard.ZstdCompressor(level=3).compress(raw), len(local), len(vocabulary)


@dataclass
class Block:
    rids: np.ndarray
    doc_ids: list[int | None]
    lengths: np.ndarray
    vocabulary: np.ndarray
    local: np.ndarray

    @classmethod
    def read(cls, payload: bytes) -> Block:
        raw = zstandard.ZstdDecompressor().decompress(payload)
        n, types = (int(x) for x in np.frombuffer(raw, "<i8", 2))
        rids, ids, known, lengths = np.frombuffer(raw, "<i8", 4 * n, 16).reshape(4, n)
        at = 16 + 32 * n
        return cls(rids, [int(i) if k else None for i, k in zip(ids, known, strict=True)], lengths, np.frombuffer(raw, "<u8", types, at), np.frombuffer(raw, np.uint8, -1, at + 8 * types).reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int64))

    def contexts(self) -> np.ndarray:
        """Place in the vocabulary of the token before each; its size stands for the start."""
        before = np.r_[len(self.vocabulary), self.local[:-1]]
        before[np.r_[0, np.cumsum(self.lengths)[:-1]]] = len(self.vocabulary)
        return before

    def keys(self, spans: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys (vocabulary, start, pairs), their buckets, and each token's pair."""
        words = np.r_[self.vocabulary, START]
        pair, where = np.unique(self.contexts() * (len(words)) + self.local, return_inverse=True)
        pairs = mixed(words[pair // len(words)] * _PAIR[0] + words[pair % len(words)] * _PAIR[1])
        bucket = np.r_[(mixed(words) % np.uint64(spans[0])).astype(np.int64), spans[0] + (mixed(pairs) % np.uint64(spans[1])).astype(np.int64)]
        return np.r_[words, pairs >> np.uint64(64 - PAIR_BITS)], bucket, where

    def counts(self, where: np.ndarray, n_pairs: int, chosen: np.ndarray) -> np.ndarray:
        """Occurrences of each key in the ``chosen`` documents."""
        per_token = np.repeat(chosen, self.lengths).astype(np.float64)
        words = np.bincount(self.local, per_token, len(self.vocabulary))
        return np.r_[words, chosen.sum(), np.bincount(where, per_token, n_pairs)].astype(np.int64)

    def resolved(self, answers: pa.Table, spans: tuple[int, int], column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token the totals of its pair, its context and itself."""
        keys, bucket, where = self.keys(spans)
        total = answered(answers, keys, bucket)[:, column].astype(np.int64)
        words = len(self.vocabulary) + 1
        return total[words:][where], total[self.contexts()], total[self.local]


def _blocks(modulus: int, weights_part: int, block_tokens: int):
    """Documents to blocks; those that the weights are learned on get blocks of their own."""

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held = {True: ([], [], [], []), False: ([], [], [], [])}
        size = {True: 0, False: 0}

        def close(kind):
            nonlocal number
            payload, tokens, types = _write_block(*held[kind])
            batch = pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) + number], pa.int64()), "weighs": pa.array([kind]), "tokens": pa.array([tokens], pa.int64()), "types": pa.array([types], pa.int64()), "payload": pa.array([payload], pa.binary())})
            number, held[kind], size[kind] = number + 1, ([], [], [], []), 0
            return batch

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for rid, doc_id, words, rest in zip(batch.column("rid").to_pylist(), ids, batch_words(batch.column("body")), remainders(ids, modulus), strict=True):
                kind = bool(rest == weights_part)
                hashes = np.r_[words, END]
                for to, value in zip(held[kind], (rid, doc_id, len(hashes), hashes), strict=True):
                    to.append(value)
                size[kind] += len(hashes)
                if size[kind] >= block_tokens:
                    yield close(kind)
        for kind in (True, False):
            if held[kind][0]:
                yield close(kind)

    return run


def interpolated_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, left_out: int = 2, weights_part: int = 3, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Score every text by a bigram model with deleted interpolation.

    Rows whose crc32(id as text) mod ``modulus`` is ``left_out`` teach nothing. Of the
    others, the part with remainder ``weights_part`` is deleted while the mixture weights are
    learned: n-gram maximum-likelihood estimates come from the rest, and
    expectation-maximisation fits, for each bucket of context frequency, the weights of the
    bigram, unigram and uniform estimates on the deleted part's counts. The final estimates
    use all training rows. Counts cover the whole corpus: blocks of documents exchange
    packed, distinct n-grams with buckets of a hash, so no n-gram is too frequent for a task;
    the driver sees only totals and the held-out histogram, whose size is bounded.

    Returns ``rid, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``,
    one row per input row. A null text counts as empty and has the end token only; a null id
    hashes as the empty text; repeated rows count and are scored each; without training rows
    all estimates are uniform; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made = numbered(docs, id_col, text_col).mapInArrow(_blocks(modulus, weights_part, block_tokens), "block long, weighs boolean, tokens long, types long, payload binary")
    blocks = checkpointed(made)
    n_tokens, n_types = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    spans = (buckets_for(n_types), buckets_for(n_tokens * 3 // 4))

    def ask(batches):
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                block = Block.read(payload.as_py())
                keys, bucket, where = block.keys(spans)
                rest = remainders(block.doc_ids, modulus)
                n_pairs = len(keys) - len(block.vocabulary) - 1
                taught = [block.counts(where, n_pairs, chosen) for chosen in (rest != left_out, (rest != left_out) & (rest != weights_part))]
                yield from packets(number, keys, bucket, np.stack(taught, 1), sum(spans))

    def tally(total: np.ndarray) -> int:
        return int((total[:, 0] > 0).sum())

    small_batches(spark, 4)
    answers = checkpointed(totals(blocks.select("block", "payload").mapInArrow(ask, PACKETS), 2, lambda total: total.astype(np.uint64).reshape(-1), tally))
    sizes = blocks.select("payload").mapInArrow(_train_sizes(modulus, left_out, weights_part), "trained long, kept long").agg(F.coalesce(F.sum("trained"), F.lit(0)), F.coalesce(F.sum("kept"), F.lit(0))).first()
    train_tokens, kept_tokens = (int(x) for x in sizes)
    # The start is a key among the words but not a token.
    types = sum(n for bucket, n in tallied(answers).items() if bucket < spans[0]) - (train_tokens > 0)

    def histogram(key, left, right):
        rows = np.zeros((0, 4), np.int64)
        for payload in left.column("payload"):
            pair, context, word = Block.read(payload.as_py()).resolved(right, spans, 1)
            p = parts(pair, context, word, kept_tokens, types)
            with np.errstate(divide="ignore"):
                steps = np.where(p[:, :2] > 0, np.rint(-np.log(p[:, :2]) / LOG_STEP), -1).astype(np.int64)
            cells, n = np.unique(np.c_[context_bucket(context), steps], axis=0, return_counts=True)
            rows = np.r_[rows, np.c_[cells, n]]
        return pa.table({c: pa.array(rows[:, k], pa.int64()) for k, c in enumerate(("bucket", "pair", "word", "n"))})

    own = answers.where("block >= 0")
    weighing = blocks.where("weighs").select("block", "payload")
    theirs = own.join(weighing.select("block"), "block", "left_semi")
    if weights_part == left_out:
        raise ValueError("the weights need a part of the training rows")
    counted = weighing.groupBy("block").cogroup(theirs.groupBy("block")).applyInArrow(histogram, "bucket long, pair long, word long, n long")
    held = counted.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).toArrow()
    table = np.stack([held.column(c).to_numpy() for c in ("bucket", "pair", "word", "n")], 1).reshape(-1, 4)
    mixture = estimate(table, train_tokens, types)

    def score(key, left, right):
        out: dict[str, list] = {c: [] for c in ("rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        for payload in left.column("payload"):
            block = Block.read(payload.as_py())
            pair, context, word = block.resolved(right, spans, 0)
            starts = np.r_[0, np.cumsum(block.lengths)[:-1]]
            base = np.log10((word + 1) / (train_tokens + types + 1))
            out["rid"] += block.rids.tolist()
            out["doc_id"] += block.doc_ids
            out["held_out"] += (remainders(block.doc_ids, modulus) == left_out).tolist()
            out["n_tokens"] += block.lengths.tolist()
            out["n_known"] += np.add.reduceat((word > 0).astype(np.int64), starts).tolist()
            out["base_score"] += np.add.reduceat(base, starts).tolist()
            out["score"] += np.add.reduceat(np.log10(mixture.probability(pair, context, word)), starts).tolist()
        kinds = {"held_out": pa.bool_(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    scored = blocks.select("block", "payload").groupBy("block").cogroup(own.groupBy("block")).applyInArrow(score, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("rid", "doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _train_sizes(modulus: int, left_out: int, weights_part: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload"):
                block = Block.read(payload.as_py())
                rest = remainders(block.doc_ids, modulus)
                trained = rest != left_out
                yield pa.RecordBatch.from_pydict({"trained": pa.array([int(block.lengths[trained].sum())], pa.int64()), "kept": pa.array([int(block.lengths[trained & (rest != weights_part)].sum())], pa.int64())})

    return run

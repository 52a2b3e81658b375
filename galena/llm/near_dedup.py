"""Near-duplicates by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm._common import TEXT_KEY, checkpointed, first_of_each, id_bitmap, mixed, numbered, small_batches, without_repeats
from galena.operators.components import components
from galena.llm._shingles import shingle_sets

#: A pair at a Jaccard similarity of 0.75 shares a band of 4 coordinates with chance 0.316,
#: and misses all 36 bands with chance 1.1e-6; one at 0.2 meets in one with chance 0.056.
BANDS, BAND_ROWS = 36, 4
#: Rounds in which each text is compared with one pivot of its crowded buckets.
PIVOT_ROUNDS = 2
#: Unsettled buckets of at most this many members are compared pair by pair, larger ones in
#: blocks of BLOCK members and BLOCK_SHINGLES shingles a side, on average.
SMALL_BUCKET, BLOCK, BLOCK_SHINGLES = 24, 1024, 1 << 19
#: Shingles that two blocks have in common and that are counted at once.
COMMON = 4096
ROUTE_BITS = 1 << 23
#: Elements that are thrown at once; bounds the memory of a sketch.
THROWN = 1 << 20

_SEEDS = mixed(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_EMPTY = np.iinfo(np.uint64).max
_VALUE = np.uint64((1 << 40) - 1)


def sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes.

    Round i < ``size`` throws each element into one hashed bin with value i + hash; round
    ``size`` + j throws all into bin j, so that every bin fills. A bin keeps its least value,
    and rounds end once none is empty, since later values are larger. Two sets agree in a bin
    with chance equal to their Jaccard similarity, as concentrated as independent draws.
    Several rounds are thrown together, as many as are likely to be needed.
    """
    bins = np.full(size, _EMPTY, np.uint64)
    turn, n = 0, len(elements)
    rounds = max(1, int(np.ceil(size * (np.log(size) + 2) / n)))
    while turn < size:
        rounds = min(rounds, size - turn, max(1, THROWN // n))
        numbers = np.arange(turn, turn + rounds)
        h = mixed(elements[None, :] ^ _SEEDS[numbers, None])
        value = (h & _VALUE) | (numbers.astype(np.uint64) << np.uint64(48))[:, None]
        np.minimum.at(bins, ((h >> np.uint64(40)) % np.uint64(size)).astype(np.int64).reshape(-1), value.reshape(-1))
        if bins.max() != _EMPTY:
            return bins
        turn += rounds
        rounds = max(1, rounds // 2)
    for j in np.flatnonzero(bins == _EMPTY).tolist():
        bins[j] = (mixed(elements ^ _SEEDS[size + j]) & _VALUE).min() | np.uint64((size + j) << 48)
    return bins


def band_keys(bins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = mixed(bins[: bands * rows]).reshape(bands, rows)
    total = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(rows):
        total = mixed(total ^ parts[:, k])
    return total.view(np.int64)


def _sketched(n: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            sizes, keys, banded = [], [], []
            for own in shingle_sets(batch.column("body"), n):
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                banded.append(band_keys(sketch(own, bands * rows), bands, rows) if len(own) else None)
            made = {"n_shingles": pa.array(sizes, pa.int64()), "set_key": pa.array(keys, pa.binary()), "bands": pa.array(banded, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("rid", "doc_id", *TEXT_KEY)} | made)

    return run


def _shingled(n: int):
    def run(batches):
        for batch in batches:
            sets = [own.tobytes() for own in shingle_sets(batch.column("body"), n)]
            yield pa.RecordBatch.from_pydict({"cid": batch.column("cid"), "shingles": pa.array(sets, pa.binary())})

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                both = 0
                if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` whose full shingle sets are similar enough."""
    left = sets.select(F.col("cid").alias("u"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("v"), F.col("shingles").alias("sb"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "sa", "sb").mapInArrow(_confirm(percent), "u long, v long")


def _labelled(crowded: DataFrame, links: DataFrame | None) -> DataFrame:
    """``band, cid, comp``: members of crowded buckets with their component so far."""
    if links is None:
        return crowded.withColumn("comp", F.col("cid"))
    found = components(links)
    return crowded.join(found.withColumnRenamed("vertex", "cid"), "cid", "left").select("band", "cid", F.coalesce("component", "cid").alias("comp"))


def _mixed_buckets(labelled: DataFrame) -> DataFrame:
    """Members of buckets in which more than one component meets."""
    open_bands = labelled.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("band")
    return labelled.join(checkpointed(open_bands), "band", "left_semi")


def pack_block(cid: np.ndarray, comp: np.ndarray, sets: list[np.ndarray]) -> bytes:
    """Members with their components and shingle sets; a shingle's hash is written once."""
    sizes = np.array([len(s) for s in sets], "<i8")
    vocabulary, index = np.unique(np.concatenate(sets), return_inverse=True)
    planes = index.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()
    head = np.array([len(sets), len(vocabulary)], "<i8")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in (head, cid.astype("<i8"), comp.astype("<i8"), sizes, vocabulary.astype("<u8"), planes)))


def unpack_block(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``cid, comp, sizes, vocabulary`` and each shingle's place in it, member by member."""
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n, words = (int(x) for x in np.frombuffer(raw, "<i8", 2))
    cid, comp, sizes = np.frombuffer(raw, "<i8", 3 * n, 16).reshape(3, n)
    at = 16 + 24 * n
    planes = np.frombuffer(raw, np.uint8, -1, at + 8 * words).reshape(4, -1)
    return cid, comp, sizes, np.frombuffer(raw, "<u8", words, at), planes.T.copy().view("<u4").reshape(-1).astype(np.int64)


def in_common(a: tuple, b: tuple) -> np.ndarray:
    """How many shingles each member of one block shares with each member of another."""
    shared, in_a, in_b = np.intersect1d(a[3], b[3], assume_unique=True, return_indices=True)
    out = np.zeros((len(a[0]), len(b[0])), np.float32)
    sides = []
    for block, places in ((a, in_a), (b, in_b)):
        column = np.full(len(block[3]), -1, np.int64)
        column[places] = np.arange(len(shared))
        own, owner = column[block[4]], np.repeat(np.arange(len(block[0])), block[2])
        order = np.argsort(own, kind="stable")
        sides.append((own[order], owner[order], len(block[0])))
    for low in range(0, len(shared), COMMON):
        parts = []
        for own, owner, n in sides:
            first, last = np.searchsorted(own, [low, low + COMMON])
            dense = np.zeros((n, COMMON), np.float32)
            dense[owner[first:last], own[first:last] - low] = 1
            parts.append(dense)
        out += parts[0] @ parts[1].T
    return out


def _block_links(percent: int):
    """Links of guests with members of another component.

    Of a guest's links into a component only the strongest comes out, as one joins the two.
    """

    def run(key, table):
        sides = dict(zip(table.column("guest").to_pylist(), table.column("payload"), strict=True))
        found = ([], [])
        if len(sides) == 2:
            guests, members = (unpack_block(sides[side].as_py()) for side in (True, False))
            both = in_common(guests, members)
            union = guests[2][:, None] + members[2][None, :] - both
            row, col = np.nonzero((100 * both >= percent * union) & (guests[1][:, None] != members[1][None, :]))
            order = np.lexsort((-(both[row, col] / union[row, col]), members[1][col], row))
            row, col = row[order], col[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (members[1][col[1:]] != members[1][col[:-1]])][: len(row)]
            a, b = guests[0][row[new]], members[0][col[new]]
            found = (np.minimum(a, b), np.maximum(a, b))
        return pa.table({"u": pa.array(found[0], pa.int64()), "v": pa.array(found[1], pa.int64())})

    return run


def _pack(key, table):
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in table.column("shingles").chunks for x in c]
    payload = pack_block(table.column("cid").to_numpy(), table.column("comp").to_numpy(), sets)
    return pa.table({"host": pa.array([key[0].as_py()], pa.int64()), "guest": pa.array([key[1].as_py()], pa.bool_()), "number": pa.array([key[2].as_py()], pa.int32()), "payload": pa.array([payload], pa.binary())})


def _large_buckets(large: DataFrame, labelled: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """All links across components within buckets too large for pairs.

    A bucket's host is its largest component; its other members are the host's guests. Each
    host's guests meet all its members and one another, block by block. A block's sets are
    packed once, and only packed blocks are sent to the pairs of blocks, which any number of
    tasks can take. Nothing but links is emitted.
    """
    most = F.max(F.struct("n", "comp")).alias("h")
    hosts = checkpointed(large.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(most).select("band", F.col("h.comp").alias("host")))
    guests = checkpointed(large.join(hosts, "band").where("comp <> host").select("host", "cid", "comp").distinct())
    hosting = checkpointed(hosts.select(F.col("host").alias("comp")).distinct())
    own = labelled.select("cid", "comp").distinct().join(hosting, "comp", "left_semi")
    members = own.select(F.col("comp").alias("host"), "cid", "comp").unionByName(guests)
    sided = checkpointed(members.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True))).join(sizes, "cid"))
    needed = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    blocks = sided.groupBy("host").pivot("guest", [False, True]).agg(needed).select("host", F.col("false").alias("mc"), F.col("true").alias("gc"))
    blocks = checkpointed(blocks.where("gc > 0"))
    number = F.pmod(F.xxhash64("cid"), F.when(F.col("guest"), F.col("gc")).otherwise(F.col("mc"))).cast("int")
    placed = sided.join(blocks, "host").select("host", "guest", number.alias("number"), "cid", "comp").join(sets, "cid")
    packed = checkpointed(placed.groupBy("host", "guest", "number").applyInArrow(_pack, "host long, guest boolean, number int, payload binary"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sent = packed.join(blocks, "host")
    sent = sent.where("not guest").select("host", F.col("number").alias("i"), every("gc").alias("j"), "guest", "payload").unionByName(
        sent.where("guest").select("host", every("mc").alias("i"), F.col("number").alias("j"), "guest", "payload")
    )
    return sent.groupBy("host", "i", "j").applyInArrow(_block_links(percent), "u long, v long").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, bands: int = BANDS, band_rows: int = BAND_ROWS, pivot_rounds: int = PIVOT_ROUNDS, small_bucket: int = SMALL_BUCKET, block: int = BLOCK) -> DataFrame:
    """Link texts whose sets of ``words``-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more, and return the connected components.

    Texts with the same set are one class from the start, whatever their number. Classes are
    sketched and banded; in each bucket of more than one class, members are first compared
    with one pivot (a member that all draw by the same hash), each member only with the pivot
    with which it shares most buckets. Links join components, and the next round draws other
    pivots. What then still meets across different components is compared in full: pair by
    pair in small buckets; in large ones the members outside the largest component against
    all others, in blocks that emit links only. So the bulk of a group of near copies costs a
    few comparisons a member, and no pair that could join two components is left out. All
    links are confirmed on full sets. The texts of crowded classes are read a second time and
    found by a 128-bit hash, so it does not matter how either reading is split.

    Returns ``rid, doc_id, n_shingles, component_id, kept, keep_rid`` and the text's hash
    ``key_a, key_b``, one row per input row: ``component_id`` is the smallest id reachable,
    ``kept`` says that it is the row's own, ``keep_rid`` the row that represents the component
    (of repeated ids, the one read first). A null or empty text, or one of blanks, has no
    shingles and is linked with nothing. A null id is larger than any other; a component
    without any id has a null ``component_id``, and there ``kept`` is true for its
    representative only. Repeated rows are in one component. An empty table gives no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = numbered(docs, id_col, text_col)
    table = checkpointed(rows.mapInArrow(_sketched(words, bands, band_rows), "rid long, doc_id long, key_a long, key_b long, n_shingles long, set_key binary, bands array<long>"))
    filled = table.where("n_shingles > 0")
    first = F.min(F.struct("rid", *TEXT_KEY, "n_shingles")).alias("first")
    classes = checkpointed(filled.groupBy("set_key").agg(first).select("set_key", F.col("first.rid").alias("cid"), *(f"first.{c}" for c in (*TEXT_KEY, "n_shingles"))))
    banded = filled.join(classes.select(F.col("cid").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("cid"), F.explode("bands").alias("band"))
    full = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    crowded = checkpointed(banded.join(full, "band", "left_semi"))
    members = checkpointed(classes.drop("set_key").join(crowded.select("cid").distinct(), "cid", "left_semi"))
    texts = first_of_each(rows.select(*TEXT_KEY, "body"), id_bitmap(members, "key_a", ROUTE_BITS))
    texts = without_repeats(texts).join(members.select("cid", *TEXT_KEY), list(TEXT_KEY)).select("cid", "body")
    sets = checkpointed(texts.mapInArrow(_shingled(words), "cid long, shingles binary"))

    links, tried = None, None
    for turn in range(pivot_rounds):
        unsettled = checkpointed(_mixed_buckets(_labelled(crowded, links)))
        draw = F.struct(F.xxhash64("cid", F.lit(turn)).alias("d"), F.col("cid").alias("p"), F.col("comp").alias("pc"))
        pivots = checkpointed(unsettled.groupBy("band").agg(F.min(draw).alias("pivot")).select("band", "pivot.p", "pivot.pc"))
        met = unsettled.join(pivots, "band").where("comp <> pc").groupBy("cid", "p").agg(F.count(F.lit(1)).alias("n"))
        best = met.groupBy("cid").agg(F.max(F.struct("n", "p")).alias("b"))
        pairs = best.select(F.least("cid", "b.p").alias("u"), F.greatest("cid", "b.p").alias("v")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = checkpointed(pairs)
        found = confirmed(pairs, sets, percent)
        links = checkpointed(found if links is None else links.unionByName(found))
        tried = pairs if tried is None else tried.unionByName(pairs)
    if links is None:
        links = tried = spark.createDataFrame([], "u long, v long")
    labelled = checkpointed(_labelled(crowded, links))
    unsettled = checkpointed(_mixed_buckets(labelled))
    counts = checkpointed(unsettled.groupBy("band").agg(F.count(F.lit(1)).alias("n")))
    small = unsettled.join(counts.where(F.col("n") <= small_bucket).select("band"), "band", "left_semi")
    other = small.select("band", F.col("cid").alias("v"), F.col("comp").alias("other"))
    rest = small.withColumnRenamed("cid", "u").join(other, "band").where("u < v and comp <> other").select("u", "v").distinct().join(tried, ["u", "v"], "left_anti")
    found = links.unionByName(confirmed(rest, sets, percent))
    if not counts.where(F.col("n") > small_bucket).isEmpty():
        large = unsettled.join(counts.where(F.col("n") > small_bucket).select("band"), "band", "left_semi")
        found = found.unionByName(_large_buckets(checkpointed(large), labelled, members.select("cid", "n_shingles"), sets, percent, block))
    links = checkpointed(found)

    found = components(links).select(F.col("vertex").alias("cid"), "component")
    joined = checkpointed(classes.select("set_key", "cid").join(found, "cid", "left").select("set_key", F.coalesce("component", "cid").alias("component")))
    placed = table.drop("bands").join(joined, "set_key", "left").withColumn("component", F.coalesce("component", "rid"))
    placed = checkpointed(placed.select("rid", "doc_id", *TEXT_KEY, "n_shingles", "component"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rid").alias("at")))
    heads = placed.groupBy("component").agg(first.alias("head")).select("component", F.col("head.id").alias("component_id"), F.col("head.at").alias("keep_rid"))
    heads = checkpointed(heads)  # as an input of its own, its join can split a hot key
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("rid") == F.col("keep_rid"))
    return placed.join(heads, "component").select("rid", "doc_id", "n_shingles", "component_id", kept.alias("kept"), "keep_rid", *TEXT_KEY)

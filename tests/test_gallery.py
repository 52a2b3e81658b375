"""Galleries, codes and search, on seeded unit vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from galena.functions import cosine, dot, hamming, l2_normalize, register_functions, sign_bits
from galena.operators import ivf, search
from galena.operators.gallery import Gallery
from galena.operators.quantizer import Quantizer, fit_pca_itq, fit_quantizer, random_projection


def unit(n, dim=32, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, first=0, label="p{}"):
    rows = [(first + i, label.format(i), f"/{i}.jpg", [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, label string, path string, embedding array<float>")


def queries(spark, x):
    return frame(spark, x).select(F.col("id").alias("query_id"), "embedding")


def top(hits):
    return {(r["query_id"], r["rank"]): r["id"] for r in hits.collect()}


@pytest.fixture(scope="module")
def small(spark):
    return frame(spark, unit(120)).repartition(3).cache()


def test_exact_topk_against_numpy(spark, small):
    x, q = unit(120), unit(7, seed=1)
    want = np.argsort(-(q.astype(float) @ x.astype(float).T), axis=1, kind="stable")[:, :5]
    for block in (4_096, 3):
        assert top(search.exact_topk(queries(spark, q), small, 5, block)) == {(i, k + 1): int(want[i, k]) for i in range(7) for k in range(5)}


@pytest.mark.parametrize("bits", [8, 64, 72, 256])
def test_hamming_topk_against_numpy(spark, small, bits):
    x, q = unit(120), unit(5, seed=2)
    quantizer = random_projection(32, bits)
    bit = lambda v: v.astype(float) @ quantizer.weights.astype(float).T > 0
    d = (bit(q)[:, None] != bit(x)[None]).sum(2)
    want = np.lexsort((np.broadcast_to(np.arange(120), d.shape), d), axis=1)[:, :9]
    hits = search.hamming_topk(quantizer.encode(queries(spark, q)), quantizer.encode(small), quantizer.words, 9)
    assert top(hits) == {(i, k + 1): int(want[i, k]) for i in range(5) for k in range(9)}
    assert {(r["query_id"], r["id"]): r["hamming"] for r in hits.collect()} == {(i, int(j)): int(d[i, j]) for i in range(5) for j in want[i]}
    assert search.hamming_topk(quantizer.encode(queries(spark, q)), quantizer.encode(small), quantizer.words, 0).count() == 0


def test_native_codes_equal_the_matrix_product(spark, small):
    quantizer = random_projection(32, 72)
    native = small.select("id", *(w.alias(f"n{i}") for i, w in enumerate(sign_bits("embedding", quantizer.weights))))
    both = quantizer.encode(small).join(native, "id")
    assert both.where("c0 <> n0 or c1 <> n1").count() == 0
    packed = quantizer.packed(quantizer.encode(small)).first()["code"]
    assert len(packed) == 9


def test_two_phase_with_whole_shortlist_is_exact(spark, small):
    q = queries(spark, unit(6, seed=3))
    quantizer = random_projection(32, 64)
    assert top(search.two_phase_topk(q, quantizer.encode(small), quantizer, 4, n_candidates=120)) == top(search.exact_topk(q, small, 4))
    with pytest.raises(ValueError):
        search.shortlist_size(0, None)
    assert search.shortlist_size(20, None) == 200


def test_whole_shortlist_lists_no_pairs(spark, small, monkeypatch):
    """Queries, gallery and results are all that is stored, not a row for every pair."""
    asked, quantizer = queries(spark, unit(120)), random_projection(32, 64)
    want = top(search.exact_topk(asked, small, 4))

    def listed(*_):
        raise AssertionError("a shortlist of every pair")

    monkeypatch.setattr(search, "rerank", listed)
    coded = quantizer.encode(small)
    assert top(search.two_phase_topk(asked, coded, quantizer, 4, n_candidates=120)) == want
    assert top(search.two_phase_topk(asked, coded, quantizer, 4, n_candidates=10**6)) == want
    with pytest.raises(AssertionError):
        search.two_phase_topk(asked, coded, quantizer, 4, n_candidates=119)


@pytest.mark.parametrize("block", [61, 4096])
def test_copies_tie_by_id(spark, block):
    """Copies are equally similar wherever they stand in a matrix."""
    x = np.random.default_rng(2).normal(size=(3, 33)).astype(np.float32)
    g = frame(spark, np.tile(x, (333, 1))).repartition(3)
    q = np.random.default_rng(3).normal(size=(100, 33)).astype(np.float32)
    best = (q @ x.T).argmax(1)
    got = top(search.exact_topk(queries(spark, q), g, 9, query_block=block))
    assert got == {(i, r + 1): int(best[i]) + 3 * r for i in range(100) for r in range(9)}


def test_pca_itq(spark, tmp_path):
    x = unit(1100)
    g = frame(spark, x)
    quantizer = fit_quantizer(g, 64)
    assert quantizer.kind == "pca-itq" and fit_quantizer(g.limit(50), 64).kind == "random"
    bits = x.astype(float) @ quantizer.weights.astype(float).T > quantizer.thresholds.astype(float)
    assert np.abs(bits.mean(0) - 0.5).max() < 0.01
    quantizer.save(spark, str(tmp_path / "q"))
    again = Quantizer.load(spark, str(tmp_path / "q"))
    assert np.allclose(again.weights, quantizer.weights) and again.kind == quantizer.kind
    assert fit_pca_itq(x, 96).n_bits == 96
    with pytest.raises(ValueError):
        quantizer.encode_array(np.zeros((1, 5)))
    hits = search.two_phase_topk(queries(spark, x[:30]), quantizer.encode(g), quantizer, 1, 50)
    assert top(hits) == {(i, 1): i for i in range(30)}


def test_ivf_covers_and_full_probe_equals_scan(spark, small):
    centroids = ivf.fit_centroids(small, 6)
    clustered = ivf.assign_clusters(small, centroids)
    assert clustered.count() == 120 and ivf.cluster_sizes(clustered).agg(F.sum("n_rows")).first()[0] == 120
    quantizer, q = random_projection(32, 64), queries(spark, unit(4, seed=5))
    coded = quantizer.encode(clustered)
    full = ivf.clustered_topk(q, coded, quantizer, centroids, 3, n_probe=6, n_candidates=20)
    assert top(full) == top(search.two_phase_topk(q, coded, quantizer, 3, n_candidates=20))
    assert ivf.probe(q, centroids, 99).count() == 4 * 6
    with pytest.raises(ValueError):
        ivf.probe(q, centroids, 0)


@pytest.mark.parametrize("block, rows", [(16, 25), (2048, 65_536)])
def test_probed_codes_against_numpy(spark, small, block, rows):
    """Blocks of queries and bundles of clusters, one of them in several pieces, hold the
    nearest codes of the probed clusters; no task sends more than k rows a query."""
    centroids = ivf.fit_centroids(small, 6)
    quantizer = random_projection(32, 64)
    coded = quantizer.encode(ivf.assign_clusters(small, centroids)).persist()
    asked = quantizer.encode(queries(spark, unit(70, seed=6))).persist()
    sizes = dict(coded.groupBy("cluster_id").count().collect())
    members, places = ivf.bundled(sizes, 25)
    assert max(p for _, p in places.values()) > 1 and len(members) > len(sizes) / 2
    g = {r["id"]: (r["c0"], r["cluster_id"]) for r in coded.collect()}
    for n_probe in (1, 2, 6):
        probes = {}
        for r in ivf.probe(asked, centroids, n_probe).collect():
            probes.setdefault(r["query_id"], set()).add(r["cluster_id"])
        want = {}
        for q in asked.collect():
            near = sorted(((q["c0"] ^ c) % 2**64).bit_count() * 1000 + i for i, (c, home) in g.items() if home in probes[q["query_id"]])
            want |= {(q["query_id"], n + 1): x % 1000 for n, x in enumerate(near[:5])}
        found = ivf.nearest_probed(asked, coded, quantizer.words, centroids, 5, n_probe, block, rows)
        assert top(search.ranked(found, 5, F.asc("distance"), F.asc("id"))) == want
        assert found.count() <= 70 * 5 * len(ivf.bundled(sizes, rows)[0])


def test_full_probe_ranks_few_rows(spark, small, monkeypatch):
    """What is sorted for the shortlist are k rows a query and bundle, not all pairs."""
    centroids, quantizer = ivf.fit_centroids(small, 6), random_projection(32, 64)
    coded = quantizer.encode(ivf.assign_clusters(small, centroids))
    seen = []
    monkeypatch.setattr(ivf, "ranked", lambda rows, *a: seen.append(rows.count()) or search.ranked(rows, *a))
    hits = ivf.clustered_topk(queries(spark, unit(120)), coded, quantizer, centroids, 3, 6, 10)
    assert hits.count() == 360 and seen == [1200]
    assert ivf.clustered_topk(queries(spark, unit(3)).limit(0), coded, quantizer, centroids, 3).count() == 0
    assert ivf.clustered_topk(queries(spark, unit(3)), coded.limit(0), quantizer, centroids, 3).count() == 0


def test_gallery_round_trip(spark, tmp_path):
    path = str(tmp_path / "g")
    g = Gallery.create(frame(spark, unit(60)), 32, 64)
    g.save(path)
    again = Gallery.open(spark, path)
    q = queries(spark, unit(60)[:3])
    assert top(again.search(q)) == {(i, 1): i for i in range(3)}
    more = again.append(frame(spark, unit(5, seed=9), first=100, label="new{}"))
    assert more.count() == 65 and more.contains("new3") and not again.contains("new3")
    less, gone = more.remove("new3")
    assert gone == 1 and less.count() == 64 and more.remove("nobody")[1] == 0
    less.clustered(4).save(path)
    last = Gallery.open(spark, path)
    assert last.count() == 64 and last.centroids.shape == (4, 32) and not last.contains("new3")
    assert top(last.search(q, n_probe=4)) == {(i, 1): i for i in range(3)}
    assert last.describe() == "Gallery(64 rows, 64 identities, 64 bits)"
    assert last.stats().first()["count"] == 64
    assert len([p for p in (tmp_path / "g").iterdir() if p.is_dir()]) == 1


def test_gallery_rejects_bad_rows(spark):
    for bad in ([1.0], [float("nan")] * 32, None):
        rows = spark.createDataFrame([(1, "a", bad)], "id long, label string, embedding array<float>")
        with pytest.raises(Exception, match="finite elements"):
            Gallery.create(rows, 32, 64).rows.collect()
    with pytest.raises(ValueError):
        Gallery.create(frame(spark, unit(3)), 32, 12)


def test_empty_gallery(spark):
    g = Gallery.create(frame(spark, unit(3)).limit(0), 32, 64)
    assert g.search(queries(spark, unit(2))).count() == 0 and g.count() == 0
    assert g.append(frame(spark, unit(3))).count() == 3


def test_functions(spark, small):
    register_functions(spark)
    small.createOrReplaceTempView("small")
    row = spark.sql("select inner_product(embedding, embedding) d, l2_norm(embedding) n, cosine_similarity(embedding, embedding) c, hamming(array(7L, -1L), array(0L, 0L)) h from small limit 1").first()
    assert abs(row["d"] - 1) < 1e-5 and abs(row["n"] - 1) < 1e-5 and abs(row["c"] - 1) < 1e-9 and row["h"] == 67
    z = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<double>, b array<double>")
    got = z.select(l2_normalize("a").alias("a"), l2_normalize("b").alias("b"), cosine("a", "b").alias("c"), dot("b", "b").alias("d")).first()
    assert list(got["a"]) == [0, 0] and list(got["b"]) == [0.6, 0.8] and got["c"] == 0 and got["d"] == 25
    with pytest.raises(ValueError):
        hamming([], [])


def test_thresholds(spark, small):
    hits = search.exact_topk(queries(spark, unit(120)[:5]), small, 3)
    assert search.above_threshold(hits, 0.999).count() == 5
    pairs = spark.createDataFrame([(0, 0), (0, 1)], "a long, b long")
    got = {r["b"]: r["match"] for r in search.verify(pairs, small).collect()}
    assert got == {0: True, 1: bool(unit(120)[0] @ unit(120)[1] > 0.4)}


@pytest.mark.parametrize("block", [7, 4096])
def test_many_queries_stay_distributed(spark, block):
    """Blocks of queries and gallery find what one block does, ties by id."""
    x = np.round(unit(90, 3) * 2) / 2
    g = frame(spark, x)
    asked = g.select((F.col("id") * 2).alias("query_id"), "embedding")
    scores = x @ x.T
    for k in (1, 4, 200):
        got = {}
        for r in search.exact_topk(asked, g, k, query_block=block).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
        want = {2 * q: [(n + 1, int(i)) for n, i in enumerate(np.lexsort((np.arange(90), -scores[q]))[:k])] for q in range(90)}
        assert {q: sorted(v) for q, v in got.items()} == want

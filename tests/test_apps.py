"""Applications, evaluation and streams against plain Python."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from galena.operators import apps, attributes, detections, metrics
from galena.sources import files
from galena.streaming.cooldown import cooldown_stream, identify_stream


def greedy(times, wait):
    last, out = None, []
    for t in sorted(times):
        if last is None or t - last > wait:
            out.append(t)
            last = t
    return out


def arrivals(spark):
    rng = np.random.default_rng(1)
    start = dt.datetime(2024, 1, 1)
    return [(f"n{rng.integers(4)}", start + dt.timedelta(seconds=int(s))) for s in rng.integers(0, 4000, 300)]


def expected(rows, wait):
    out = set()
    for name in {n for n, _ in rows}:
        out |= {(name, t) for t in greedy({t for n, t in rows if n == name}, dt.timedelta(seconds=wait))}
    return out


def test_cooldown(spark):
    rows = arrivals(spark)
    got = apps.with_cooldown(spark.createDataFrame(rows, "name string, ts timestamp"), "name", "ts", 60).collect()
    assert {(r["name"], r["ts"]) for r in got} == expected(rows, 60)


def test_cooldown_stream_equals_batch_in_any_arrival_order(spark, tmp_path):
    rows = arrivals(spark)
    for part in range(3):
        spark.createDataFrame(rows[part::3], "name string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # Time moves on, so that all of them are let out.
    spark.createDataFrame([("clock", dt.datetime(2024, 1, 3))], "name string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = cooldown_stream(stream, "name", "ts", 60, "2 hours").writeStream.format("memory").queryName("let").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {(r["key"], r["ts"]) for r in spark.sql("select * from let").collect() if r["key"] != "clock"}
    assert got == expected(rows, 60)


def test_identify_stream(spark, tmp_path):
    g = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "id long, label string, embedding array<double>")
    frames = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 0, 0, i), [float(i % 2), 1.0 - i % 2]) for i in range(6)], "frame long, ts timestamp, embedding array<double>")
    assert {(r["frame"], r["label"]) for r in identify_stream(frames, g, every=2).collect()} == {(0, "b"), (2, "b"), (4, "b")}


def test_organise_is_greedy_in_path_order(spark):
    c, s = np.cos(0.9), np.sin(0.9)
    rows = [(0, "b.jpg", [1.0, 0.0]), (1, "a.jpg", [float(c), float(s)]), (2, "c.jpg", [math.cos(0.45), math.sin(0.45)]), (3, "d.jpg", [-1.0, 0.0])]
    got = apps.organise_by_person(spark.createDataFrame(rows, "id long, path string, embedding array<double>"), 0.8)
    assert {r["id"]: r["person"] for r in got.collect()} == {1: "Person_001", 0: "Person_002", 2: "Person_001", 3: "Person_003"}


def test_person_graph_joins_long_chains(spark):
    """Chains of more links than a fixed number of rounds would follow, in mixed order of ids."""
    order = np.random.default_rng(4).permutation(150).tolist()
    links = [(min(p), max(p)) for p in zip(order, order[1:])] + [(200, 201), (201, 202), (200, 202)]
    pairs = spark.createDataFrame(links, "id_a long, id_b long")
    g = spark.range(210).repartition(3)
    want = {i: 0 if i < 150 else 200 if 200 <= i <= 202 else i for i in range(210)}
    assert {r["id"]: r["person_id"] for r in apps.person_graph(pairs, g).collect()} == want
    assert {r["id"]: r["person_id"] for r in apps.person_graph(pairs.limit(0), g).collect()} == {i: i for i in range(210)}


def test_suppression(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        x, y, w, h = rng.uniform(0, 50), rng.uniform(0, 50), rng.uniform(5, 30), rng.uniform(5, 30)
        rows.append((int(rng.integers(9)), float(x), float(y), float(x + w), float(y + h), float(rng.uniform())))
    want = set()
    for image in range(9):
        kept = []
        for b in sorted((r for r in rows if r[0] == image), key=lambda r: -r[5]):
            def iou(o, b=b):
                w, h = max(0, min(o[3], b[3]) - max(o[1], b[1]) + 1), max(0, min(o[4], b[4]) - max(o[2], b[2]) + 1)
                area = lambda q: (q[3] - q[1] + 1) * (q[4] - q[2] + 1)
                return w * h / (area(o) + area(b) - w * h)
            if all(iou(o) <= 0.4 for o in kept):
                kept.append(b)
        want |= set(kept)
    boxes = spark.createDataFrame(rows, "image long, x1 double, y1 double, x2 double, y2 double, score double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    assert {tuple(r) for r in detections.suppress(boxes).collect()} == want
    assert detections.suppress(boxes.limit(0)).collect() == []


def test_alignment():
    template = np.array(detections.TEMPLATE)
    turn = np.array([[0.0, -2.0], [2.0, 0.0]])
    moved = (template - 10) @ np.linalg.inv(turn).T + 40
    assert np.allclose(np.c_[moved, np.ones(5)] @ detections.similarity_transform(moved, template).T, template)
    assert detections.align(np.zeros((50, 50, 3), np.uint8), np.zeros((5, 2))) is None
    image = np.random.default_rng(0).integers(0, 255, (112, 112, 3)).astype(np.uint8)
    assert np.abs(detections.align(image, template).astype(int) - image).max() <= 1
    assert detections.centre_crop(image[:50]).shape == (50, 50, 3)
    assert detections.letterbox(image, 64)[0].shape == (3, 64, 64) and detections.preprocess(image).max() <= 1


def test_far_frr_and_eer(spark):
    rng = np.random.default_rng(5)
    gen, imp = rng.normal(0.6, 0.15, 300), rng.normal(0.2, 0.15, 900)
    pairs = spark.createDataFrame([(True, float(s)) for s in gen] + [(False, float(s)) for s in imp], "same boolean, similarity double")
    for r in metrics.far_frr(pairs).collect():
        assert np.isclose(r["far"], (imp >= r["threshold"]).mean()) and np.isclose(r["frr"], (gen < r["threshold"]).mean())
    grid = np.linspace(0, 1, 2001)
    far, frr = np.array([(imp >= t).mean() for t in grid]), np.array([(gen < t).mean() for t in grid])
    at = np.abs(far - frr).round(12).argmin()
    got = metrics.equal_error_rate(pairs).first()
    assert np.isclose(got["threshold"], grid[at]) and np.isclose(got["eer"], (far[at] + frr[at]) / 2)
    ci = metrics.bootstrap_ci(pairs.withColumn("x", F.col("same").cast("double")), "x").first()
    assert ci["low"] < ci["mean"] < ci["high"] and abs(ci["mean"] - 0.25) < 1e-9


def counted(rows):
    return sorted((r["same"], r["similarity"], r["n"]) for r in rows.collect())


def test_pair_counts_are_those_of_all_pairs(spark):
    """Signed halves, equal vectors, wide values and any number of blocks; no pair leaves a task."""
    rng = np.random.default_rng(8)
    for x in (rng.normal(size=(90, 4)) / 4, np.round(rng.normal(size=(90, 2)) * 2) / 64, rng.normal(size=(90, 3)) * 1000):
        g = spark.createDataFrame([(i, None if i == 7 else str(i % 4), [float(e) for e in v]) for i, v in enumerate(x.astype(np.float32))], "id long, label string, embedding array<float>")
        every = metrics.labelled_pairs(g.where("label is not null")).withColumn("similarity", F.round("similarity", 4) + F.lit(0.0))
        want = counted(every.groupBy("same", "similarity").agg(F.count(F.lit(1)).alias("n")))
        for block in (8, 8192):
            assert counted(metrics.pair_counts(g, 4, block)) == want


def test_counted_pairs_rate_as_pairs_do(spark):
    rng = np.random.default_rng(6)
    rows = [(bool(rng.integers(2)), float(s)) for s in rng.normal(0.4, 0.3, 500).round(2)]
    pairs = spark.createDataFrame(rows, "same boolean, similarity double")
    few = pairs.groupBy("same", "similarity").agg(F.count(F.lit(1)).alias("n"))
    assert few.count() < 400
    for f in (metrics.far_frr, metrics.equal_error_rate, metrics.score_means, lambda p: metrics.threshold_at_far(p, 0.013)):
        got, want = (sorted(map(tuple, f(p).collect())) for p in (few, pairs))
        assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_impostor_pairs(spark):
    rows = [(i, str(i % 5), [float(i), 1.0]) for i in range(200)]
    g = spark.createDataFrame(rows, "id long, label string, embedding array<double>")
    got = metrics.impostor_pairs(g, 150).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got}) == 150
    assert all(r["a"] % 5 != r["b"] % 5 and r["a"] < r["b"] for r in got)


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "ann").mkdir(parents=True)
    for n, content in (("ann/x.JPG", b"good"), ("bob_1.png", b"bad"), ("note.txt", b"no")):
        (tmp_path / "in" / n).write_bytes(content)
    images = files.image_files(spark, str(tmp_path / "in"))
    root = f"file:{tmp_path}/in"
    assert {r[0] for r in images.select(files.name_from_path(F.col("path"), root)).collect()} == {"ann", "bob"}

    def build():
        def model(batch):
            if b"bad" in batch:
                raise ValueError("no face here")
            return [np.array([3.0, 4.0]) for _ in batch]
        return model

    results = files.embedded(images, build)
    assert files.registration_counts(results).first()[:] == (1, 1, 2)
    good = results.where("ok").first()
    assert np.allclose(good["embedding"], [0.6, 0.8])
    np.save(tmp_path / "b_embeddings.npy", np.eye(3, dtype=np.float32))
    np.save(tmp_path / "b_labels.npy", np.array([1, 1, 2]))
    assert files.npy_gallery(spark, str(tmp_path), ("a", "b")).count() == 3
    sent = []
    files.webhook_sink(sent.append)(spark.range(2), 0)
    assert len(sent) == 2


def test_attributes(spark):
    rows = [([0.1, 2.0, 0.3],), ([1.0, 1.0],)]
    got = spark.createDataFrame(rows, "l array<double>").select(attributes.emotion("l").alias("e")).collect()
    assert got[0]["e"]["emotion"] == "happy" and got[1]["e"]["emotion"] == "neutral" and got[1]["e"]["confidence"] == 0.5
    ages = spark.createDataFrame([([1.0, 0.31, 0.0],), ([-1.0, 140.0],), ([1.0],)], "o array<double>").select(attributes.age_gender("o").alias("a")).collect()
    assert [(r["a"]["age"], r["a"]["gender"]) for r in ages] == [(31, "F"), (100, "M"), (-1, "unknown")]

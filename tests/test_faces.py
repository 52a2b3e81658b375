"""Facade, face front end, record files, streams and the evaluation additions."""

import io
import struct
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from galena.functions.vectors import register_functions, sign_bits
from galena.operators import detections, ivf, metrics
from galena.operators.gallery import Gallery
from galena.operators.quantizer import random_projection
from galena.operators.recognizer import Recognizer
from galena.sources import faces, records
from galena.sources.files import usable

DIM = 16
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


def unit(n, seed=0, dim=DIM):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, vectors, first=0, label="p{}"):
    rows = [(first + k, label.format(k % 7), "", [float(x) for x in v]) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, label string, path string, embedding array<float>")


def build_embedder():
    def embed(contents):
        return [np.frombuffer(c, np.float32)[:DIM] if len(c) == 4 * DIM else None for c in contents]

    return embed


def build_describer():
    return lambda contents: [([1.0, 0.3, 0.0], [0, 5, 0, 0, 0, 0, 0, 0]) for _ in contents]


def image(seed):
    return unit(1, seed)[0].astype(np.float32).tobytes()


def test_recognizer(spark, tmp_path):
    for k, name in enumerate(["anna", "anna", "bert"]):
        folder = tmp_path / "images" / name
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{k}.jpg").write_bytes(image(k))
    (tmp_path / "images" / "bert" / "bad.png").write_bytes(b"none")
    r = Recognizer.open(spark, str(tmp_path / "store"), build_embedder, DIM, 64, build_describer)
    assert len(r) == 0 and r.names() == []
    r, counts = r.register_folder(str(tmp_path / "images"))
    assert counts == {"registered": 3, "errors": 1, "total": 4} and len(r) == 3
    r = r.register("carl", image(9))
    assert "carl" in r and "dora" not in r and r.names() == ["anna", "bert", "carl"]
    with pytest.raises(ValueError):
        r.register("dora", b"none")
    assert r.identify(image(9)).first()["label"] == "carl"
    assert r.verify(image(1), image(1)).first()["match"] and not r.verify(image(1), (-np.frombuffer(image(1), np.float32)).tobytes()).first()["match"]
    told = r.analyze([b"x", b"y"]).orderBy("path").collect()
    assert [t["attributes"]["emotion"] for t in told] == ["happy"] * 2 and told[0]["attributes"]["age"] == 30 and told[0]["attributes"]["gender"] == "F"
    r.save(str(tmp_path / "store"))
    again = Recognizer.open(spark, str(tmp_path / "store"), build_embedder, DIM, 64)
    assert again.stats()["count"] == 4 and again.identify(image(0)).first()["label"] == "anna"
    again, gone = again.remove("anna")
    assert gone == 2 and len(again) == 2
    with pytest.raises(ValueError):
        again.analyze([b"x"])


def test_gallery_is_fitted_once_large_enough(spark):
    g = Gallery.create(frame(spark, unit(600)), DIM, 32).clustered(4)
    assert g.quantizer.kind == "random"
    more = g.append(frame(spark, unit(600, 1), first=600))
    assert more.quantizer.kind == "pca-itq" and more.count() == 1200 and "cluster_id" in more.rows.columns
    codes = more.quantizer.encode(more.rows.select("id", "embedding"))
    assert codes.join(more.rows.select("id", F.col("c0").alias("stored")), "id").where("c0 <> stored").isEmpty()
    frozen = more.append(frame(spark, unit(5, 2), first=5000))
    assert frozen.quantizer is more.quantizer
    with pytest.raises(ValueError):
        more.append(frame(spark, unit(1, 2), first=3))
    with pytest.raises(ValueError):
        Gallery.create(frame(spark, unit(2)).union(frame(spark, unit(2))), DIM, 32)


def test_pointer_survives_a_crash(spark, tmp_path):
    path = str(tmp_path / "g")
    with pytest.raises(FileNotFoundError):
        Gallery.open(spark, path)
    Gallery.create(frame(spark, unit(5)), DIM, 32).save(path)
    (tmp_path / "g" / "meta-000000000002.json.new").write_text("{")  # written, never renamed
    assert Gallery.open(spark, path).count() == 5
    Gallery.create(frame(spark, unit(3)), DIM, 32).save(path)
    assert Gallery.open(spark, path).count() == 3
    assert len(list((tmp_path / "g").glob("meta-*.json"))) == 1 and len(list((tmp_path / "g").glob("v-*"))) == 1


def test_quantizer_search_and_same_codes(spark):
    g, q = frame(spark, unit(80)), random_projection(DIM, 64)
    asked = g.select(F.col("id").alias("query_id"), "embedding")
    with pytest.raises(ValueError):
        q.search(asked, g)
    hits = q.search(asked, q.encode(g), 1)
    assert hits.where("query_id <> id").isEmpty()
    truth = g.select(F.col("id").alias("query_id"), "id")
    grid = metrics.bits_grid(asked, g, truth, [32, 64], [1, 5], lambda n: random_projection(DIM, n)).collect()
    assert {r["n_bits"] for r in grid} == {32, 64} and len(grid) == 4
    isolated = {r["rerank"]: r for r in metrics.same_codes(asked, g, q, truth).collect()}
    assert set(isolated) == {True, False}
    assert ivf.as_dict(np.zeros((3, 2)), 5) == {"n_clusters": 3, "n_probe": 5}


def test_one_query_at_a_time_finds_what_a_batch_finds(spark):
    g = Gallery.create(frame(spark, unit(60)), DIM, 64)
    asked = g.rows.select(F.col("id").alias("query_id"), "embedding").where("query_id < 4")
    batch = {(r["query_id"], r["id"], round(r["similarity"], 5)) for r in g.search(asked, 3).collect()}
    single = {(r["query_id"], r["id"], round(r["similarity"], 5)) for k in range(4) for r in g.search(asked.where(F.col("query_id") == k), 3).collect()}
    assert batch == single


def test_stages_and_split(spark):
    ticks = iter(range(100))
    stages = metrics.Stages(lambda: next(ticks))
    for name in ("embed", "search", "embed"):
        with stages(name):
            pass
    assert [tuple(r) for r in stages.frame(spark).collect()] == [("embed", 2.0, 2 / 3), ("search", 1.0, 1 / 3)]
    g = frame(spark, unit(300))
    q, d = metrics.split(g, 0.3)
    ids = {r["id"] for r in q.collect()}
    assert 50 < len(ids) < 130 and ids | {r["id"] for r in d.collect()} == set(range(300)) and q.join(d, "id").isEmpty()
    assert {r["id"] for r in metrics.split(g.repartition(7), 0.3)[0].collect()} == ids
    by_label = metrics.split(g, 0.3, group="label")
    assert by_label[0].join(by_label[1], "label", "left_semi").isEmpty()


def detector():
    return lambda img: [{"x1": 2, "y1": 2, "x2": 8, "y2": 9, "score": 0.7}, {"x1": 1, "y1": 1, "x2": 30, "y2": 30, "score": 0.9, "points": np.array(detections.TEMPLATE) / 4}]


def broken():
    raise RuntimeError("no model")


def as_npy(x):
    out = io.BytesIO()
    np.save(out, x)
    return out.getvalue()


def test_faces(spark):
    img = np.random.default_rng(0).integers(0, 255, (40, 32, 3)).astype(np.uint8)
    images = spark.createDataFrame([("a", bytearray(as_npy(img))), ("b", bytearray(b"bad"))], "path string, content binary")
    rows = faces.faces(images, faces.npy_image, detector, 16).collect()
    assert [(r["path"], r["face"], r["score"], len(r["crop"])) for r in rows] == [("a", 0, 0.9, 768), ("a", 1, 0.7, 768)]
    found = lambda *a: {r["path"]: r["found"] for r in faces.aligned_faces(images, faces.npy_image, *a, size=16).collect()}
    assert found(detector) == {"a": "aligned", "b": None}
    assert found(broken, detector) == {"a": "box", "b": None}
    assert found(None) == {"a": "centre", "b": None}
    vectors = faces.portrait_vectors(images, faces.npy_image, lambda: lambda x: x.mean((0, 1)), 3)
    assert [r["path"] for r in usable(vectors).collect()] == ["a"] and vectors.count() == 2


def test_crops_and_choices(spark):
    assert faces.widened({"x1": 10, "y1": 0, "x2": 20, "y2": 10}, 21, 50) == (8, 0, 21, 12)
    assert faces.without_border(np.zeros((100, 40, 3)), 0.05).shape == (90, 36, 3)
    assert faces.choose_provider(["CPUExecutionProvider", "CUDAExecutionProvider"]) == "CUDAExecutionProvider"
    assert faces.choose_provider([]) == "CPUExecutionProvider"
    assert faces.sniffed_columns(spark.createDataFrame([], "Image binary, Identity string").schema) == ("Image", "Identity")
    with pytest.raises(ValueError):
        faces.sniffed_columns(spark.createDataFrame([], "image binary, x int").schema)
    calls = []
    once = faces.Once(lambda: calls.append(1) or 1 / 0)
    assert once() is None and once() is None and calls == [1]


def test_one_bad_point_does_not_bend_the_alignment():
    target = np.array(detections.TEMPLATE)
    turn = np.array([[0.8, -0.6], [0.6, 0.8]]) * 1.7
    points = (target - 50) @ turn + 90
    want = detections.similarity_transform(points, target)
    bad = points.copy()
    bad[2] += 60
    assert np.allclose(detections.robust_transform(bad, target), want, atol=1e-6)
    assert np.allclose(detections.robust_transform(points, target), want, atol=1e-6)
    assert detections.robust_transform(np.ones((5, 2)), target) is None


def record(number, label, content, parts=1):
    body = struct.pack(records.HEADER, 0, label, number, 0) + content
    out = struct.pack("<II", records.MAGIC, len(body)) + body
    return out + b"\0" * (-len(body) % 4)


def test_record_files(spark, tmp_path):
    (tmp_path / "a.rec").write_bytes(b"".join(record(k, float(k % 2), b"x" * k) for k in range(5)))
    got = records.record_files(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r["id"], r["label"], bytes(r["content"])) for r in got] == [(k, k % 2, b"x" * k) for k in range(5)]
    long = struct.pack(records.HEADER, 2, 9.0, 7, 0) + struct.pack("<ff", 3.0, 4.0)
    split = struct.pack("<II", records.MAGIC, (1 << 29) | len(long)) + long + struct.pack("<II", records.MAGIC, (3 << 29) | 4) + b"tail"
    assert list(records.records(split)) == [(7, 3.0, struct.pack("<I", records.MAGIC) + b"tail")]
    for raw in (b"\0" * 8, record(1, 0.0, b"abcdefgh")[:-8]):
        with pytest.raises(ValueError):
            list(records.records(raw))


def test_streamed_folder_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: records.extract_stream(spark, str(tmp_path / "in"), lambda d: d.select("path", "length"), str(tmp_path / "out"), str(tmp_path / "mark"), files_per_batch=2).awaitTermination()
    for k in range(5):
        (tmp_path / "in" / f"{k}.jpg").write_bytes(b"x" * (k + 1))
    (tmp_path / "in" / "note.txt").write_bytes(b"x")
    run()
    (tmp_path / "in" / "9.JPG").write_bytes(b"xxxxxxxxx")
    run()
    run()
    assert sorted(r["length"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4, 5, 9]


def test_frames_reconnect():
    opened = []

    def source():
        opened.append(1)
        yield from range(4)
        if len(opened) < 3:
            raise OSError("lost")

    assert [n for n, _ in records.frames(source, every=3, sleep=lambda _: None)] == [0, 3, 6, 9]

    def dead():
        raise OSError("off")
        yield

    with pytest.raises(OSError):
        list(records.frames(dead, retries=2, sleep=lambda _: None))


def test_csv_log(spark, tmp_path):
    rows = spark.sql("SELECT 'anna' AS name, timestamp'2024-05-01 08:09:10' AS timestamp, 0.98765D AS confidence")
    for _ in range(2):
        records.csv_sink(str(tmp_path / "log"))(rows, 0)
    assert [r[0] for r in spark.read.text(str(tmp_path / "log")).collect()] == ["anna,2024-05-01 08:09:10,0.988"] * 2


def test_sql_functions(spark):
    register_functions(spark)
    weights = unit(70, 5)
    frame(spark, unit(5)).createOrReplaceTempView("some")
    spark.createDataFrame([([w.tolist() for w in weights], [0.0] * 70)], "w array<array<double>>, t array<double>").createOrReplaceTempView("model")
    got = spark.sql("SELECT id, encode_bits(embedding, w, t) AS code, l2_norm(cast(l2_normalize(embedding) AS ARRAY<FLOAT>)) AS n FROM some CROSS JOIN model ORDER BY id").collect()
    want = spark.table("some").select("id", F.array(*sign_bits("embedding", weights))).orderBy("id").collect()
    assert [r["code"] for r in got] == [r[1] for r in want] and all(abs(r["n"] - 1) < 1e-6 for r in got)

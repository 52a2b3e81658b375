"""One query per operator, over the whole of its tables.

``embeddings`` serves as gallery and as query set, ``events`` as the stream of detections.
Boxes, ages, logits, paths and frames, for which there is no table, are derived from columns
that there are, in the same way here and in ``sql.py``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galena.functions.vectors import l2_norm, l2_normalize
from galena.operators import apps, attributes, detections, ivf, metrics, search
from galena.operators import gallery as galleries
from galena.operators.quantizer import fit_quantizer, random_projection
from galena.sources import files
from galena.streaming.cooldown import sessions

DIM, BITS = 64, 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gallery_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), "embedding")
    # A table of one row group is one task otherwise.
    return rows.repartition(spark.sparkContext.defaultParallelism, "id")


def queries_of(gallery: DataFrame) -> DataFrame:
    return gallery.select(F.col("id").alias("query_id"), "embedding")


def coded(gallery: DataFrame):
    quantizer = random_projection(DIM, BITS)
    return quantizer, quantizer.encode(gallery)


def first_centroids(gallery: DataFrame) -> np.ndarray:
    """The first rows by id as centroids, for results that SQL can follow; a fit takes
    ``ivf.fit_centroids``."""
    n = ivf.default_clusters(gallery.count())
    rows = gallery.orderBy("id").limit(n).select("embedding").collect()
    return ivf.unit_rows(np.array([r[0] for r in rows], np.float64))


def shown(hits: DataFrame) -> DataFrame:
    return hits.withColumn("similarity", F.round("similarity", 4)).withColumn("rank", F.col("rank").cast("long"))


@query
def exact_topk(spark, sf_dir):
    g = gallery_of(spark, sf_dir)
    return shown(search.exact_topk(queries_of(g), g, 3))


@query
def exact_topk_threshold(spark, sf_dir):
    g = gallery_of(spark, sf_dir)
    return search.above_threshold(search.exact_topk(queries_of(g), g, 5), 0.3).select("query_id", "id", "label", "confidence")


@query
def verify_pairs(spark, sf_dir):
    g = gallery_of(spark, sf_dir)
    pairs = g.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(g.select(F.col("id").alias("a"), F.col("id").alias("b")))
    return search.verify(pairs, g)


@query
def l2_norms(spark, sf_dir):
    return files.usable(gallery_of(spark, sf_dir)).select("id", F.round(l2_norm("embedding"), 6).alias("norm"))


@query
def normalized_vectors(spark, sf_dir):
    g = gallery_of(spark, sf_dir)
    return g.select("id", F.posexplode(l2_normalize("embedding")).alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query
def rp_codes(spark, sf_dir):
    return coded(gallery_of(spark, sf_dir))[1].select("id", F.col("c0").alias("code"))


@query
def hamming_histogram(spark, sf_dir):
    quantizer, g = coded(gallery_of(spark, sf_dir))
    pairs = search.hamming_pairs(quantizer.encode(queries_of(g)), g, quantizer.words)
    return pairs.groupBy("hamming").agg(F.count(F.lit(1)).alias("n_pairs"))


@query
def hamming_topk(spark, sf_dir):
    quantizer, g = coded(gallery_of(spark, sf_dir))
    return search.hamming_topk(quantizer.encode(queries_of(g)), g, quantizer.words, 10).withColumn("rank", F.col("rank").cast("long"))


@query
def binary_only(spark, sf_dir):
    quantizer, g = coded(gallery_of(spark, sf_dir))
    return search.binary_topk(quantizer.encode(queries_of(g)), g, quantizer.words, 5).withColumn("rank", F.col("rank").cast("long"))


@query
def two_phase_full(spark, sf_dir):
    quantizer, g = coded(gallery_of(spark, sf_dir))
    return shown(search.two_phase_topk(queries_of(g), g, quantizer, 3, n_candidates=g.count()))


@query
def two_phase_rp(spark, sf_dir):
    quantizer, g = coded(gallery_of(spark, sf_dir))
    return shown(search.two_phase_topk(queries_of(g), g, quantizer, 5, n_candidates=50))


@query
def batch_search(spark, sf_dir):
    quantizer, g = coded(gallery_of(spark, sf_dir))
    return shown(search.two_phase_topk(queries_of(g), g, quantizer, 1))


@query
def pca_itq_recall(spark, sf_dir):
    """Recall@1 without the query itself, of codes fitted on the gallery."""
    g = gallery_of(spark, sf_dir)
    quantizer = fit_quantizer(g, 256, fit_threshold=100)
    hits = search.two_phase_topk(queries_of(g), quantizer.encode(g), quantizer, 2)
    truth = search.exact_topk(queries_of(g), g, 2).where("rank = 2").select("query_id", "id", "similarity")
    return metrics.recall_at_k(hits, truth, 2)


@query
def ivf_assign(spark, sf_dir):
    g = gallery_of(spark, sf_dir)
    return ivf.assign_clusters(g, first_centroids(g)).select("id", F.col("cluster_id").cast("long").alias("cluster_id"))


@query
def ivf_cluster_sizes(spark, sf_dir):
    g = gallery_of(spark, sf_dir)
    return ivf.cluster_sizes(ivf.assign_clusters(g, first_centroids(g))).withColumn("cluster_id", F.col("cluster_id").cast("long"))


@query
def ivf_probe(spark, sf_dir):
    g = gallery_of(spark, sf_dir)
    return ivf.probe(queries_of(g), first_centroids(g), 4).select("query_id", F.col("probe").cast("long").alias("probe"), F.col("cluster_id").cast("long").alias("cluster_id"))


@query
def ivf_search(spark, sf_dir):
    quantizer, g = coded(gallery_of(spark, sf_dir))
    centroids = first_centroids(g)
    return shown(ivf.clustered_topk(queries_of(g), ivf.assign_clusters(g, centroids), quantizer, centroids, 3, n_probe=4, n_candidates=30))


@query
def ivf_full_probe(spark, sf_dir):
    quantizer, g = coded(gallery_of(spark, sf_dir))
    centroids = first_centroids(g)
    return shown(ivf.clustered_topk(queries_of(g), ivf.assign_clusters(g, centroids), quantizer, centroids, 5, n_probe=len(centroids), n_candidates=50))


@query
def ivf_kmeans(spark, sf_dir):
    g = gallery_of(spark, sf_dir)
    return ivf.cluster_sizes(ivf.assign_clusters(g, ivf.fit_centroids(g)))


def _truth(g: DataFrame) -> DataFrame:
    """The nearest other row of each row."""
    hits = search.exact_topk(queries_of(g), g, 2).where("query_id <> id")
    first = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("r", F.row_number().over(first)).where("r = 1").select("query_id", "id", "similarity")


@query
def probe_sweep(spark, sf_dir):
    g = gallery_of(spark, sf_dir)
    centroids = first_centroids(g)
    swept = ivf.probe_sweep(queries_of(g), ivf.assign_clusters(g, centroids), centroids, _truth(g), [1, 2, 4, 8, 16])
    return swept.select(F.col("n_probe").cast("long").alias("n_probe"), F.round("recall", 6).alias("recall"))


@query
def candidate_sweep(spark, sf_dir):
    quantizer, g = coded(gallery_of(spark, sf_dir))
    ranks = search.hamming_topk(quantizer.encode(queries_of(g)), g, quantizer.words, 100)
    swept = metrics.candidate_sweep(ranks, _truth(g), [10, 20, 50, 100])
    return swept.select(F.col("n_candidates").cast("long").alias("n_candidates"), F.round("recall", 6).alias("recall"))


@query
def recall_at_k(spark, sf_dir):
    quantizer, g = coded(gallery_of(spark, sf_dir))
    hits = search.two_phase_topk(queries_of(g), g, quantizer, 5, n_candidates=50)
    return metrics.recall_at_k(hits, _truth(g), 5).withColumn("recall", F.round("recall", 6))


@query
def tie_aware_recall(spark, sf_dir):
    quantizer, g = coded(gallery_of(spark, sf_dir))
    hits = search.two_phase_topk(queries_of(g), g, quantizer, 2, n_candidates=50).where("query_id <> id")
    return metrics.tie_aware_recall(hits, _truth(g), 2).withColumn("recall", F.round("recall", 6))


@query
def gallery_names(spark, sf_dir):
    return galleries.names(gallery_of(spark, sf_dir))


@query
def gallery_stats(spark, sf_dir):
    return galleries.stats(gallery_of(spark, sf_dir), DIM, 512)


@query
def gallery_remove(spark, sf_dir):
    left = galleries.remove(gallery_of(spark, sf_dir), "3")
    return left.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def gallery_contains(spark, sf_dir):
    g = gallery_of(spark, sf_dir)
    wanted = spark.createDataFrame([("3",), ("nobody",)], "label string")
    found = g.select("label").distinct().withColumn("present", F.lit(True))
    return wanted.join(found, "label", "left").select("label", F.coalesce("present", F.lit(False)).alias("present"))


@query
def holdout_split(spark, sf_dir):
    return metrics.holdout(gallery_of(spark, sf_dir))


@query
def last_holdout(spark, sf_dir):
    return metrics.last_of_each(gallery_of(spark, sf_dir))


@query
def holdout_database(spark, sf_dir):
    g = gallery_of(spark, sf_dir)
    return metrics.database(g, metrics.holdout(g)).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def rank1(spark, sf_dir):
    g = gallery_of(spark, sf_dir)
    ends = metrics.first_and_last(g)
    kept = g.join(ends.select(F.col("gallery_id").alias("id")), "id", "left_semi")
    probes = g.join(ends.select(F.col("probe_id").alias("id")), "id", "left_semi")
    hits = search.exact_topk(queries_of(probes), kept, 1)
    result = metrics.rank1(hits, ends.select(F.col("probe_id").alias("query_id"), F.col("label").alias("true_label")))
    return result.withColumn("rank1", F.round("rank1", 6))


@query
def genuine_pairs(spark, sf_dir):
    return metrics.genuine_pairs(gallery_of(spark, sf_dir)).withColumn("similarity", F.round("similarity", 4))


@query
def impostor_sample(spark, sf_dir):
    return metrics.impostor_pairs(gallery_of(spark, sf_dir), 5_000).withColumn("similarity", F.round("similarity", 4))


def pairs_of(spark, sf_dir) -> DataFrame:
    return metrics.pair_counts(gallery_of(spark, sf_dir), 4)


def rounded(frame: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        frame = frame.withColumn(c, F.round(c, 6))
    return frame


@query
def far_frr(spark, sf_dir):
    return rounded(metrics.far_frr(pairs_of(spark, sf_dir)), "far", "frr")


@query
def equal_error_rate(spark, sf_dir):
    return rounded(metrics.equal_error_rate(pairs_of(spark, sf_dir)), "eer", "threshold")


@query
def threshold_at_far(spark, sf_dir):
    p = pairs_of(spark, sf_dir).persist()
    return rounded(metrics.threshold_at_far(p, 1e-2).unionByName(metrics.threshold_at_far(p, 1e-3)), "threshold", "frr", "tar")


@query
def score_means(spark, sf_dir):
    return rounded(metrics.score_means(pairs_of(spark, sf_dir)), "mean_genuine", "mean_impostor")


@query
def kfold_accuracy(spark, sf_dir):
    return rounded(metrics.fold_accuracy(_pair_list(spark, sf_dir), ["a", "b"]), "threshold", "accuracy").withColumn("fold", F.col("fold").cast("long"))


@query
def accuracy_summary(spark, sf_dir):
    return rounded(metrics.accuracy_summary(metrics.fold_accuracy(_pair_list(spark, sf_dir), ["a", "b"])), "mean_accuracy", "std_accuracy")


def _pair_list(spark, sf_dir) -> DataFrame:
    """A verification list: each row with the next and with the tenth row."""
    g = gallery_of(spark, sf_dir)
    a = g.select(F.col("id").alias("a"), F.col("label").alias("la"), F.col("embedding").alias("va"), F.explode(F.array(F.lit(1), F.lit(10))).alias("step"))
    b = g.select(F.col("id").alias("b"), F.col("label").alias("lb"), F.col("embedding").alias("vb"))
    from galena.functions.vectors import dot

    joined = a.withColumn("b", F.col("a") + F.col("step")).join(b, "b")
    return joined.select("a", "b", (F.col("la") == F.col("lb")).alias("same"), F.round(dot("va", "vb"), 4).alias("similarity"))


@query
def bootstrap_recall(spark, sf_dir):
    quantizer, g = coded(gallery_of(spark, sf_dir))
    ranks = search.hamming_topk(quantizer.encode(queries_of(g)), g, quantizer.words, 50)
    hit = _truth(g).join(ranks.select("query_id", "id", F.lit(1.0).alias("hit")), ["query_id", "id"], "left").fillna(0.0, ["hit"])
    return metrics.bootstrap_ci(hit, "hit", rounds=2_000)


@query
def best_configuration(spark, sf_dir):
    """Events stand for measured configurations: kind, user, value."""
    e = table(spark, sf_dir, "events")
    results = e.groupBy(F.col("event_type").alias("family"), F.col("user_id").cast("string").alias("method")).agg(F.round(1 - F.min("value") / 100, 6).alias("recall"), F.round(F.max("value"), 6).alias("memory_mb"), F.min("event_id").cast("double").alias("latency_ms"))
    return metrics.best_configuration(results, 0.99)


@query
def tiled_scale(spark, sf_dir):
    g = gallery_of(spark, sf_dir).select("id", "label")
    return metrics.tiled(g, 1234).groupBy("copy").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("id").alias("sum_id"))


@query
def dedup_pairs(spark, sf_dir):
    return apps.duplicate_pairs(gallery_of(spark, sf_dir), threshold=0.3, k=5)


@query
def organise_people(spark, sf_dir):
    g = gallery_of(spark, sf_dir).withColumn("path", F.format_string("photo_%06d.jpg", "id"))
    return apps.organise_by_person(g, threshold=0.4).groupBy("person").agg(F.count(F.lit(1)).alias("n_photos"))


@query
def person_graph(spark, sf_dir):
    g = gallery_of(spark, sf_dir)
    return apps.person_graph(apps.duplicate_pairs(g, threshold=0.4, k=5), g)


def detections_of(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("name"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


@query
def timeline(spark, sf_dir):
    return apps.timeline(detections_of(spark, sf_dir), at="event_id")


@query
def attendance_cooldown(spark, sf_dir):
    let = apps.with_cooldown(detections_of(spark, sf_dir), "name", "ts", 24 * 3600)
    return let.select("name", F.unix_micros("ts").alias("ts_us"))


@query
def watchlist_alerts(spark, sf_dir):
    errors = detections_of(spark, sf_dir).where("event_type = 'error'")
    alerts = apps.numbered_alerts(apps.with_cooldown(errors, "name", "ts", 24 * 3600), "name", "ts")
    return alerts.select("name", F.unix_micros("ts").alias("ts_us"), "alert_no")


@query
def attendance_log(spark, sf_dir):
    arrivals = detections_of(spark, sf_dir).withColumn("confidence", F.floor(F.col("value")) / 8)
    return apps.attendance_log(arrivals.select("name", "ts", "confidence"))


@query
def event_sessions(spark, sf_dir):
    s = sessions(detections_of(spark, sf_dir), "name", "ts", "6 hours")
    return s.select(F.col("key").alias("name"), F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), F.col("n").alias("n_events"))


@query
def video_search(spark, sf_dir):
    g = gallery_of(spark, sf_dir)
    frames = apps.sampled_frames(queries_of(g).withColumnRenamed("query_id", "frame"), 5).withColumnRenamed("frame", "query_id")
    hits = search.exact_topk(frames, g, 3)
    return apps.video_detections(hits, fps=25.0, threshold=0.3)


@query
def video_timeline(spark, sf_dir):
    return apps.timeline(video_search(spark, sf_dir))


@query
def live_identify(spark, sf_dir):
    frames = detections_of(spark, sf_dir).withColumn("camera", F.col("event_type"))
    held = apps.held_results(frames, "camera", "event_id", "name")
    return held.select("camera", "event_id", "shown")


@query
def age_gate(spark, sf_dir):
    e = detections_of(spark, sf_dir).select("event_id", (F.col("event_id") % 80).cast("int").alias("age"))
    gates = {"adults": attributes.age_gate("age", "adult"), "children": attributes.age_gate("age", "child"), "band": attributes.age_gate("age", None, 25, 60), "all_rules": attributes.age_gate("age", "adult", 21, 40)}
    return e.select("event_id", F.col("age").cast("long").alias("age"), *(c.alias(n) for n, c in gates.items()), attributes.is_child("age").alias("is_child"))


@query
def age_gender(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.array(F.col("event_id") % 3 - 1.0, F.col("event_id") % 150 - 20.0).alias("two"))
    three = F.array(F.get("two", F.lit(0)), F.get("two", F.lit(1)) / 100 + 0.0025, F.lit(0.0))
    d = e.select("event_id", attributes.age_gender("two").alias("p"), attributes.age_gender(three).alias("q"))
    return d.select("event_id", F.col("p.age").cast("long").alias("age"), F.col("p.gender").alias("gender"), F.col("q.age").cast("long").alias("age3"), F.col("q.gender").alias("gender3"))


@query
def softmax_argmax(spark, sf_dir):
    g = gallery_of(spark, sf_dir).select("id", F.slice("embedding", 1, 8).alias("logits"))
    e = g.select("id", attributes.emotion("logits").alias("e"))
    return e.select("id", F.col("e.emotion").alias("emotion"), F.col("e.confidence").alias("confidence"), F.col("e.scores")["happy"].alias("happy"))


def boxes_of(spark, sf_dir) -> DataFrame:
    """Rows of ``lineitem`` as boxes: the order is the image."""
    li = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") % 90, F.col("l_suppkey") % 70
    return li.select(F.col("l_orderkey").alias("image"), x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + F.col("l_quantity")).alias("x2"), (y + F.col("l_quantity") + F.col("l_linenumber")).alias("y2"), (F.col("l_discount") * 10).alias("score"), F.lit(160.0).alias("width"), F.lit(120.0).alias("height"))


@query
def prominent_face(spark, sf_dir):
    best = detections.prominent(boxes_of(spark, sf_dir))
    return best.select("image", "x1", "y1", "x2", "y2", F.round("prominence", 4).alias("prominence"))


@query
def confident_boxes(spark, sf_dir):
    return detections.confident(boxes_of(spark, sf_dir)).groupBy("image").agg(F.count(F.lit(1)).alias("n_boxes"))


@query
def suppressed_boxes(spark, sf_dir):
    return detections.suppress(boxes_of(spark, sf_dir)).select("image", "x1", "y1", "x2", "y2", F.round("score", 4).alias("score"))


@query
def anchor_decode(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    raw = li.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").cast("long").alias("line"), F.lit(16).alias("stride"), (F.col("l_partkey") % 3200).alias("anchor"), F.col("l_discount").alias("score"), *((F.col("l_quantity") / d).alias(n) for n, d in (("left", 8), ("top", 4), ("right", 2), ("bottom", 1))), F.lit(0.5).alias("scale"))
    return detections.decode_anchors(raw).select("image", "line", "x1", "y1", "x2", "y2")


def paths_of(spark, sf_dir) -> DataFrame:
    """Pages as files: a third right below the root, the others in a folder."""
    p = table(spark, sf_dir, "pages").select("page_id")
    root = F.format_string("/data/person_%d_%d.JPG", F.col("page_id") % 7, "page_id")
    deep = F.format_string("/data/person_%d/img_%d.png", F.col("page_id") % 7, "page_id")
    return p.select("page_id", F.when(F.col("page_id") % 3 == 0, root).when(F.col("page_id") % 3 == 1, deep).otherwise(F.regexp_replace(deep, "png$", "txt")).alias("path"))


@query
def name_from_path(spark, sf_dir):
    p = paths_of(spark, sf_dir)
    return p.select("page_id", files.name_from_path(F.col("path"), "/data").alias("name"), files.has_type(F.col("path")).alias("is_image"))


@query
def registration_counts(spark, sf_dir):
    p = paths_of(spark, sf_dir).select(files.has_type(F.col("path")).alias("ok"))
    return files.registration_counts(p)


@query
def capped_identities(spark, sf_dir):
    p = paths_of(spark, sf_dir).select("page_id", "path", files.name_from_path(F.col("path"), "/data").alias("identity"))
    return files.capped_identities(p, 5).select("page_id", "identity", F.col("label").cast("long").alias("label"))


@query
def named_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "customer").select(F.concat(F.lit(" "), "c_name", F.lit(" : /img/a:"), "c_custkey", F.lit(".jpg ")).alias("value"))
    return files.named_pairs(n)


@query
def verification_list(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("p"), F.col("o_custkey"))
    line = F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws("\t", name, F.lit("1"), F.lit("2"))).when(F.col("o_orderkey") % 3 == 1, F.concat_ws("\t", name, F.lit("1"), F.lit("q"), F.lit("4"))).otherwise(F.lit("10\t300"))
    v = files.verification_pairs(o.select(line.alias("value")))
    return v.groupBy("same", "number_b").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name_a").alias("n_a"), F.count_distinct("name_b").alias("n_b")).withColumn("number_b", F.col("number_b").cast("long"))


@query
def frame_sampling(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("frame"), "event_type")
    return apps.sampled_frames(e, 15).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_frames"), F.sum("frame").alias("sum_frame"))


@query
def format_hms(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", apps.hms(F.col("event_id") * 37 / 25).alias("time"))
    return e


@query
def duplicates_json(spark, sf_dir):
    pairs = apps.duplicate_pairs(gallery_of(spark, sf_dir), threshold=0.4, k=5)
    return files.as_json(pairs.select("id_a", "id_b"))


@query
def person_folders(spark, sf_dir):
    p = paths_of(spark, sf_dir).withColumnRenamed("page_id", "id")
    people = p.select("id", files.name_from_path(F.col("path"), "/data").alias("person"))
    return apps.person_folders(p, people, "/out")


def methods_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of methods, derived from the suppliers."""
    t = table(spark, sf_dir, "supplier")
    return t.select(
        F.concat(F.lit("m"), (F.col("s_suppkey") % 7).cast("string")).alias("method"),
        (F.col("s_suppkey") % 20 / 20.0).alias("recall"),
        (F.col("s_suppkey") % 13 + 1.0).alias("memory_mb"),
        (F.col("s_suppkey") % 17 + 1.0).alias("per_second"),
    ).distinct()


@query
def latency_stats(spark, sf_dir):
    return metrics.latency_stats(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 97 + 1.0).alias("ms")))


@query
def hash_split(spark, sf_dir):
    queries, database = metrics.split(gallery_of(spark, sf_dir), 0.2, group="label")
    return queries.select("id", F.lit("query").alias("part")).unionByName(database.select("id", F.lit("database").alias("part")))


@query
def chart_rows(spark, sf_dir):
    return metrics.chart_rows(methods_of(spark, sf_dir), ["m1", "m2", "m3", "m5"])


@query
def speed_ratios(spark, sf_dir):
    firsts = methods_of(spark, sf_dir).groupBy("method").agg(F.max("per_second").alias("per_second"), F.min("memory_mb").alias("memory_mb"))
    return metrics.ratios(firsts, "m0")


@query
def analyzed_faces(spark, sf_dir):
    from galena.sources.faces import attributes_of

    rows = gallery_of(spark, sf_dir).select("id", F.array(F.element_at("embedding", 1).cast("double"), F.abs(F.element_at("embedding", 2).cast("double")) * 100).alias("person"), F.slice("embedding", 3, 8).alias("mood"))
    told = rows.select("id", attributes_of(attributes.age_gender("person"), attributes.emotion("mood")).alias("a"))
    return told.select("id", F.col("a.age").cast("long").alias("age"), "a.gender", "a.emotion")


@query
def repeated_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).alias("id"))
    return galleries.repeated_ids(rows)


@query
def decoded_points(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.lit(8).alias("stride"), (F.col("vec_id") % 12800).alias("anchor"), F.lit(0.9).alias("score"), *(F.lit(1.0).alias(c) for c in ("left", "top", "right", "bottom")), F.lit(0.5).alias("scale"), F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("points"))
    return detections.decode_anchors(rows).select("image", F.posexplode("points").alias("k", "at")).select("image", F.col("k").cast("long").alias("k"), F.round("at", 6).alias("at"))


@query
def limited_identities(spark, sf_dir):
    from galena.sources.records import limited_identities as limited

    images = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.lpad((F.col("o_custkey") % 50).cast("string"), 3, "0")).alias("identity"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("path"))
    return limited(images, 5, 120).select("identity", "path", F.col("label").cast("long").alias("label"))

"""DuckDB SQL for the queries, by the same names and columns.

Learned or drawn values (the projection) enter as literals; centroids are rows of the table.
"""

from __future__ import annotations

from galena.operators.quantizer import random_projection
from galena.plans.queries import BITS, DIM


def _projection() -> str:
    rows = random_projection(DIM, BITS).weights.astype(float)
    return "[" + ",".join("[" + ",".join(repr(float(x)) for x in r) + "]" for r in rows) + "]::DOUBLE[][]"


G = "g AS (SELECT vec_id AS id, label::VARCHAR AS label, embedding::DOUBLE[] AS v FROM embeddings)"
DOT = "list_dot_product(a.v, b.v)"
CODES = f"""
p AS (SELECT {_projection()} AS w),
bits AS (SELECT id, i, list_dot_product(v, w[i]) > 0 AS bit FROM g, p, range(1, {BITS + 1}) r(i)),
codes AS (
  SELECT id, CASE WHEN sum(CASE WHEN bit AND i = 1 THEN 1 ELSE 0 END) > 0 THEN -9223372036854775808::HUGEINT ELSE 0 END
             + sum(CASE WHEN bit AND i > 1 THEN 1::HUGEINT << (64 - i)::INT ELSE 0 END) AS code
  FROM bits GROUP BY id),
c AS (SELECT id, code::BIGINT AS code FROM codes)"""
NEAR = """near AS (
  SELECT a.id AS query_id, b.id, bit_count(xor(a.code, b.code))::BIGINT AS hamming,
         row_number() OVER (PARTITION BY a.id ORDER BY bit_count(xor(a.code, b.code)), b.id) AS rank
  FROM c a, c b)"""
ALL = f"""allp AS (
  SELECT a.id AS query_id, b.id, b.label, {DOT} AS s,
         row_number() OVER (PARTITION BY a.id ORDER BY {DOT} DESC, b.id) AS rank
  FROM g a, g b)"""
TRUTH = "truth AS (SELECT query_id, id, s FROM allp WHERE query_id <> id AND rank <= 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1)"
CENTROIDS = """cent AS (
  SELECT row_number() OVER (ORDER BY id) - 1 AS cluster_id, v FROM g
  QUALIFY row_number() OVER (ORDER BY id) <= (SELECT floor(sqrt(count(*))) FROM g)),
near_c AS (
  SELECT g.id, cent.cluster_id, row_number() OVER (PARTITION BY g.id ORDER BY
         list_dot_product(g.v, cent.v) / (sqrt(list_dot_product(g.v, g.v)) * sqrt(list_dot_product(cent.v, cent.v))) DESC, cluster_id) AS probe
  FROM g, cent),
home AS (SELECT id, cluster_id FROM near_c WHERE probe = 1)"""
PAIRS = f"pairs AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, round({DOT}, 4) AS s FROM g a JOIN g b ON a.id < b.id)"
PAIR_LIST = f"""pl AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, round({DOT}, 4) AS s FROM g a JOIN g b ON b.id IN (a.id + 1, a.id + 10)),
folded AS (SELECT *, ntile(10) OVER (ORDER BY a, b) - 1 AS fold FROM pl),
grid AS (SELECT i, CASE WHEN i = 399 THEN 1.0::DOUBLE ELSE i * (2.0::DOUBLE / 399) - 1.0 END AS t FROM range(400) r(i)),
acc AS (SELECT fold, i, t, sum(CASE WHEN (s >= t) = same THEN 1 ELSE 0 END) AS good, count(*) AS n FROM folded, grid GROUP BY ALL),
best AS (
  SELECT acc.fold, acc.t AS threshold, acc.good / acc.n AS accuracy FROM acc
  JOIN (SELECT i, sum(good) AS all_good FROM acc GROUP BY i) x USING (i)
  QUALIFY row_number() OVER (PARTITION BY acc.fold ORDER BY all_good - good DESC, i) = 1)"""


def _rerank(candidates: int, k: int) -> str:
    return f"""WITH {G}, {CODES}, {NEAR}, short AS (
      SELECT n.query_id, n.id, b.label, {DOT} AS s FROM near n JOIN g a ON a.id = n.query_id JOIN g b ON b.id = n.id WHERE n.rank <= {candidates}),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM short)
    SELECT query_id, rank, id, label, round(s, 4) AS similarity FROM top WHERE rank <= {k}"""


def _cooldown(where: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS name, epoch_us(ts) AS t FROM events WHERE {where}),
    kept AS (
      SELECT name, min(t) AS t FROM e GROUP BY name
      UNION ALL
      SELECT e.name, min(e.t) FROM kept JOIN e ON e.name = kept.name AND e.t > kept.t + 86400000000 GROUP BY e.name, kept.t)"""


DETECTIONS = f"""WITH {G}, {ALL}, hits AS (SELECT * FROM allp WHERE rank <= 3 AND s >= 0.3 AND query_id % 5 = 0),
    det AS (SELECT query_id AS frame, label AS name, query_id / 25.0::DOUBLE AS sec, s FROM hits)"""
BOXES = """boxes AS (
  SELECT l_orderkey AS image, (l_partkey % 90)::DOUBLE AS x1, (l_suppkey % 70)::DOUBLE AS y1, l_partkey % 90 + l_quantity AS x2,
         l_suppkey % 70 + l_quantity + l_linenumber AS y2, l_discount * 10 AS score FROM lineitem)"""
PATHS = """paths AS (
  SELECT page_id, CASE page_id % 3 WHEN 0 THEN format('/data/person_{}_{}.JPG', page_id % 7, page_id)
         WHEN 1 THEN format('/data/person_{}/img_{}.png', page_id % 7, page_id) ELSE format('/data/person_{}/img_{}.txt', page_id % 7, page_id) END AS path,
         'person_' || (page_id % 7) AS name, page_id % 3 <> 2 AS is_image FROM pages)"""
DUPLICATES = f"""dup AS (
  SELECT least(query_id, id) AS id_a, greatest(query_id, id) AS id_b, max(round(s, 4)) AS confidence, max(s) AS s
  FROM allp WHERE rank <= 5 AND query_id <> id GROUP BY 1, 2)"""

METHODS = """methods AS (SELECT DISTINCT 'm' || s_suppkey % 7 AS method, (s_suppkey % 20) / 20.0::DOUBLE AS recall, s_suppkey % 13 + 1.0::DOUBLE AS memory_mb, s_suppkey % 17 + 1.0::DOUBLE AS per_second FROM supplier)"""

ORACLE_SQL: dict[str, str] = {
    "exact_topk": f"WITH {G}, {ALL} SELECT query_id, rank, id, label, round(s, 4) AS similarity FROM allp WHERE rank <= 3",
    "exact_topk_threshold": f"WITH {G}, {ALL} SELECT query_id, id, label, round(s, 4) AS confidence FROM allp WHERE rank <= 5 AND s >= 0.3",
    "verify_pairs": f"WITH {G} SELECT a.id AS a, b.id AS b, {DOT} > 0.4 AS match, round({DOT}, 4) AS confidence FROM g a JOIN g b ON b.id IN (a.id, a.id + 1)",
    "l2_norms": f"WITH {G} SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM g WHERE sqrt(list_dot_product(v, v)) > 0.5",
    "normalized_vectors": f"WITH {G} SELECT id, (i - 1)::BIGINT AS pos, round(v[i] / sqrt(list_dot_product(v, v)), 6) AS x FROM g, range(1, {DIM + 1}) r(i)",
    "rp_codes": f"WITH {G}, {CODES} SELECT id, code FROM c",
    "hamming_histogram": f"WITH {G}, {CODES} SELECT bit_count(xor(a.code, b.code))::BIGINT AS hamming, count(*) AS n_pairs FROM c a, c b GROUP BY 1",
    "hamming_topk": f"WITH {G}, {CODES}, {NEAR} SELECT query_id, rank, id, hamming FROM near WHERE rank <= 10",
    "binary_only": f"WITH {G}, {CODES}, {NEAR} SELECT query_id, rank, near.id, label, hamming FROM near JOIN g ON g.id = near.id WHERE rank <= 5",
    "two_phase_full": f"WITH {G}, {ALL} SELECT query_id, rank, id, label, round(s, 4) AS similarity FROM allp WHERE rank <= 3",
    "two_phase_rp": _rerank(50, 5),
    "batch_search": _rerank(100, 1),
    "ivf_assign": f"WITH {G}, {CENTROIDS} SELECT id, cluster_id FROM home",
    "ivf_cluster_sizes": f"WITH {G}, {CENTROIDS} SELECT cluster_id, count(*) AS n_rows FROM home GROUP BY 1",
    "ivf_probe": f"WITH {G}, {CENTROIDS} SELECT id AS query_id, probe, cluster_id FROM near_c WHERE probe <= 4",
    "ivf_search": f"""WITH {G}, {CODES}, {CENTROIDS}, cand AS (
        SELECT q.id AS query_id, h.id, row_number() OVER (PARTITION BY q.id ORDER BY bit_count(xor(ca.code, cb.code)), h.id) AS n
        FROM near_c q JOIN home h ON h.cluster_id = q.cluster_id AND q.probe <= 4 JOIN c ca ON ca.id = q.id JOIN c cb ON cb.id = h.id),
      short AS (SELECT query_id, b.id, b.label, {DOT} AS s FROM cand JOIN g a ON a.id = query_id JOIN g b ON b.id = cand.id WHERE n <= 30),
      top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM short)
      SELECT query_id, rank, id, label, round(s, 4) AS similarity FROM top WHERE rank <= 3""",
    "ivf_full_probe": _rerank(50, 5),
    "probe_sweep": f"""WITH {G}, {ALL}, {TRUTH}, {CENTROIDS}
      SELECT n_probe, round(avg(CASE WHEN nc.probe <= n_probe THEN 1.0 ELSE 0.0 END), 6) AS recall
      FROM truth t JOIN home h ON h.id = t.id JOIN near_c nc ON nc.id = t.query_id AND nc.cluster_id = h.cluster_id,
           (SELECT unnest([1, 2, 4, 8, 16])::BIGINT AS n_probe) GROUP BY 1""",
    "candidate_sweep": f"""WITH {G}, {ALL}, {TRUTH}, {CODES}, {NEAR}
      SELECT n_candidates, round(avg(CASE WHEN n.rank <= n_candidates THEN 1.0 ELSE 0.0 END), 6) AS recall
      FROM truth t JOIN near n ON n.query_id = t.query_id AND n.id = t.id, (SELECT unnest([10, 20, 50, 100])::BIGINT AS n_candidates) GROUP BY 1""",
    "recall_at_k": f"WITH {G}, {ALL}, {TRUTH}, hits AS ({_rerank(50, 5)}) SELECT count(*) AS n_queries, round(avg(CASE WHEN h.id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall FROM truth t LEFT JOIN hits h ON h.query_id = t.query_id AND h.id = t.id",
    "tie_aware_recall": f"""WITH {G}, {ALL}, {TRUTH}, hits AS ({_rerank(50, 2)}), own AS (
        SELECT t.query_id, max(CASE WHEN h.id = t.id OR ({DOT}) >= t.s - 1e-5 THEN 1.0 ELSE 0.0 END) AS hit
        FROM truth t LEFT JOIN hits h ON h.query_id = t.query_id AND h.id <> t.query_id LEFT JOIN g a ON a.id = t.query_id LEFT JOIN g b ON b.id = h.id GROUP BY 1)
      SELECT count(*) AS n_queries, round(avg(hit), 6) AS recall FROM own""",
    "gallery_names": f"WITH {G} SELECT DISTINCT label FROM g ORDER BY label",
    "gallery_stats": f"""WITH {G} SELECT count(*) AS count, count(DISTINCT label) AS identities, round(count(*) * 64.0::DOUBLE / 1048576, 2) AS binary_memory_mb,
      round(count(*) * {DIM * 4}.0::DOUBLE / 1048576, 2) AS float_storage_mb, round({DIM * 4}.0::DOUBLE / 64, 1) AS compression_ratio FROM g""",
    "gallery_remove": f"WITH {G} SELECT label, count(*) AS n_rows FROM g WHERE label <> '3' GROUP BY 1",
    "gallery_contains": f"WITH {G} SELECT w.label, EXISTS (SELECT 1 FROM g WHERE g.label = w.label) AS present FROM (VALUES ('3'), ('nobody')) w(label)",
    "holdout_split": f"WITH {G} SELECT id, label FROM (SELECT id, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY id DESC) AS r FROM g) WHERE n >= 2 AND r <= CASE WHEN n >= 4 THEN 3 ELSE 1 END",
    "last_holdout": f"WITH {G} SELECT max(id) AS id, label FROM g GROUP BY label HAVING count(*) >= 2 ORDER BY label LIMIT 500",
    "holdout_database": f"WITH {G} SELECT label, count(*) AS n_rows FROM (SELECT label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY id DESC) AS r FROM g) WHERE NOT (n >= 2 AND r <= CASE WHEN n >= 4 THEN 3 ELSE 1 END) GROUP BY 1",
    "rank1": f"""WITH {G}, ends AS (SELECT label, min(id) AS gid, max(id) AS pid FROM g GROUP BY 1 HAVING min(id) < max(id)),
      best AS (SELECT e.pid, e.label, b.label AS found FROM ends e JOIN g a ON a.id = e.pid, ends f JOIN g b ON b.id = f.gid
        QUALIFY row_number() OVER (PARTITION BY e.pid ORDER BY {DOT} DESC, b.id) = 1)
      SELECT count(*) AS n_probes, sum(CASE WHEN label = found THEN 1 ELSE 0 END)::BIGINT AS n_correct, round(avg(CASE WHEN label = found THEN 1.0 ELSE 0.0 END), 6) AS rank1 FROM best""",
    "genuine_pairs": f"WITH {G} SELECT a.id AS a, b.id AS b, a.label, round({DOT}, 4) + 0.0::DOUBLE AS similarity FROM g a JOIN g b ON a.label = b.label AND a.id < b.id",
    "far_frr": f"""WITH {G}, {PAIRS}, t AS (SELECT round(0.2 + 0.05 * i, 2)::DOUBLE AS threshold FROM range(11) r(i))
      SELECT threshold, round(avg(CASE WHEN NOT same THEN (s >= threshold)::INT END), 6) AS far, round(avg(CASE WHEN same THEN (s < threshold)::INT END), 6) AS frr FROM pairs, t GROUP BY 1""",
    "equal_error_rate": f"""WITH {G}, {PAIRS}, t AS (SELECT i * (1.0::DOUBLE / 2000) AS threshold FROM range(2001) r(i)),
      cells AS (SELECT s, sum(same::INT) AS gen, sum((NOT same)::INT) AS imp FROM pairs GROUP BY s),
      rates AS (SELECT threshold, sum(CASE WHEN s >= threshold THEN imp ELSE 0 END)::DOUBLE / sum(imp) AS far, sum(CASE WHEN s < threshold THEN gen ELSE 0 END)::DOUBLE / sum(gen) AS frr FROM cells, t GROUP BY 1)
      SELECT round((far + frr) / 2, 6) AS eer, round(threshold, 6) AS threshold FROM rates ORDER BY round(abs(far - frr), 12), rates.threshold LIMIT 1""",
    "threshold_at_far": f"""WITH {G}, {PAIRS}, cut AS (SELECT unnest([0.01, 0.001])::DOUBLE AS target_far, unnest((SELECT quantile_cont(s, [0.99, 0.999]) FROM pairs WHERE NOT same)) AS threshold)
      SELECT target_far, round(threshold, 6) AS threshold, round(avg((s < threshold)::INT), 6) AS frr, round(1 - avg((s < threshold)::INT), 6) AS tar FROM pairs, cut WHERE same GROUP BY target_far, cut.threshold""",
    "score_means": f"WITH {G}, {PAIRS} SELECT round(avg(CASE WHEN same THEN s END), 6) AS mean_genuine, round(avg(CASE WHEN NOT same THEN s END), 6) AS mean_impostor FROM pairs",
    "kfold_accuracy": f"WITH {G}, {PAIR_LIST} SELECT fold, round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy FROM best",
    "accuracy_summary": f"WITH {G}, {PAIR_LIST} SELECT round(avg(accuracy), 6) AS mean_accuracy, round(stddev_pop(accuracy), 6) AS std_accuracy FROM best",
    "best_configuration": """WITH r AS (SELECT event_type AS family, user_id::VARCHAR AS method, round(1 - min(value) / 100, 6) AS recall, round(max(value), 6) AS m, min(event_id)::DOUBLE AS l FROM events GROUP BY 1, 2)
      SELECT family, arg_min(method, (m, method)) AS least_memory, arg_min(method, (l, method)) AS least_latency, count(*) AS n_methods FROM r WHERE recall >= 0.99 GROUP BY 1""",
    "tiled_scale": f"""WITH {G}, n AS (SELECT count(*) AS n FROM g), numbered AS (SELECT id, row_number() OVER (ORDER BY id) AS r, n FROM g, n)
      SELECT copy, count(*) AS n_rows, sum(id)::BIGINT AS sum_id FROM numbered, range(100000) x(copy) WHERE copy * n + r <= 1234 AND copy * n < 1234 GROUP BY 1""",
    "dedup_pairs": f"WITH {G}, {ALL}, {DUPLICATES} SELECT id_a, id_b, confidence FROM dup WHERE s >= 0.3",
    "person_graph": f"""WITH RECURSIVE {G}, {ALL}, {DUPLICATES}, e AS (SELECT id_a AS x, id_b AS y FROM dup WHERE s >= 0.4 UNION ALL SELECT id_b, id_a FROM dup WHERE s >= 0.4),
      reach AS (SELECT id, id AS other FROM g UNION SELECT reach.id, e.y FROM reach JOIN e ON e.x = reach.other)
      SELECT id, min(other) AS person_id FROM reach GROUP BY 1""",
    "timeline": "SELECT user_id::VARCHAR AS name, min(event_id) AS first_seen, max(event_id) AS last_seen, count(*) AS appearances FROM events GROUP BY 1",
    "attendance_cooldown": _cooldown("true") + " SELECT name, t AS ts_us FROM kept",
    "watchlist_alerts": _cooldown("event_type = 'error'") + " SELECT name, t AS ts_us, row_number() OVER (PARTITION BY name ORDER BY t) AS alert_no FROM kept",
    "attendance_log": "SELECT user_id::VARCHAR AS name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, printf('%.3f', floor(value) / 8) AS confidence FROM events",
    "event_sessions": """WITH e AS (SELECT user_id::VARCHAR AS name, epoch_us(ts) AS t FROM events),
      m AS (SELECT *, CASE WHEN t >= lag(t) OVER (PARTITION BY name ORDER BY t) + 21600000000 THEN 1 ELSE 0 END AS new FROM e),
      s AS (SELECT *, sum(new) OVER (PARTITION BY name ORDER BY t) AS n FROM m)
      SELECT name, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS n_events FROM s GROUP BY name, n""",
    "video_search": DETECTIONS + " SELECT frame, name, printf('%02d:%02d:%02d', floor(sec)::BIGINT // 3600, floor(sec)::BIGINT % 3600 // 60, floor(sec)::BIGINT % 60) AS time, round(sec, 1) AS seconds, round(s, 3) AS confidence FROM det",
    "video_timeline": DETECTIONS + " SELECT name, min(round(sec, 1)) AS first_seen, max(round(sec, 1)) AS last_seen, count(*) AS appearances FROM det GROUP BY 1",
    "live_identify": "SELECT event_type AS camera, event_id, last_value(CASE WHEN event_id % 5 = 0 THEN user_id::VARCHAR END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS shown FROM events",
    "age_gate": """SELECT event_id, age, CASE WHEN age < 18 THEN 'query is child' END AS adults, CASE WHEN age >= 18 THEN 'query is adult' END AS children,
      CASE WHEN age < 25 THEN 'age ' || age || ' below min_age 25' WHEN age > 60 THEN 'age ' || age || ' above max_age 60' END AS band,
      CASE WHEN age < 18 THEN 'query is child' WHEN age < 21 THEN 'age ' || age || ' below min_age 21' WHEN age > 40 THEN 'age ' || age || ' above max_age 40' END AS all_rules,
      age < 16 AS is_child FROM (SELECT event_id, event_id % 80 AS age FROM events)""",
    "age_gender": """SELECT event_id, greatest(0, least(100, event_id % 150 - 20)) AS age, CASE WHEN event_id % 3 - 1 > 0 THEN 'F' ELSE 'M' END AS gender,
      greatest(0, least(100, trunc(((event_id % 150 - 20.0::DOUBLE) / 100 + 0.0025::DOUBLE) * 100)))::BIGINT AS age3, CASE WHEN event_id % 3 - 1 > 0 THEN 'F' ELSE 'M' END AS gender3 FROM events""",
    "softmax_argmax": """WITH x AS (SELECT vec_id AS id, embedding[1:8]::DOUBLE[] AS l FROM embeddings), e AS (SELECT id, list_transform(l, lambda v: exp(v - list_max(l))) AS z FROM x),
      p AS (SELECT id, list_transform(z, lambda v: v / list_sum(z)) AS p FROM e)
      SELECT id, (['neutral', 'happy', 'surprise', 'sad', 'angry', 'disgust', 'fear', 'contempt'])[list_position(p, list_max(p))] AS emotion, round(list_max(p), 3) AS confidence, round(p[2], 3) AS happy FROM p""",
    "prominent_face": f"""WITH {BOXES}, w AS (SELECT *, (x2 - x1) * (y2 - y1) - 2 * (pow((x1 + x2) / 2 - 80, 2) + pow((y1 + y2) / 2 - 60, 2)) AS prominence FROM boxes)
      SELECT image, x1, y1, x2, y2, round(prominence, 4) AS prominence FROM w QUALIFY row_number() OVER (PARTITION BY image ORDER BY w.prominence DESC, x1, y1) = 1""",
    "confident_boxes": f"WITH {BOXES} SELECT image, count(*) AS n_boxes FROM boxes WHERE score >= 0.5 GROUP BY 1",
    "anchor_decode": """WITH r AS (SELECT l_orderkey AS image, l_linenumber::BIGINT AS line, (l_partkey % 3200) // 2 AS cell, l_quantity AS q FROM lineitem)
      SELECT image, line, (cell % 40 * 16 - q / 8 * 16) / 0.5 AS x1, (cell // 40 * 16 - q / 4 * 16) / 0.5 AS y1, (cell % 40 * 16 + q / 2 * 16) / 0.5 AS x2, (cell // 40 * 16 + q * 16) / 0.5 AS y2 FROM r""",
    "name_from_path": f"WITH {PATHS} SELECT page_id, name, is_image FROM paths",
    "registration_counts": f"WITH {PATHS} SELECT count(*) FILTER (is_image) AS registered, count(*) FILTER (NOT is_image) AS errors, count(*) AS total FROM paths",
    "capped_identities": f"WITH {PATHS} SELECT page_id, name AS identity, dense_rank() OVER (ORDER BY name) - 1 AS label FROM paths QUALIFY row_number() OVER (PARTITION BY name ORDER BY path) <= 5",
    "named_pairs": "SELECT c_name AS name, '/img/a:' || c_custkey || '.jpg' AS path FROM customer",
    "verification_list": """WITH v AS (SELECT 'p' || o_custkey AS a, o_orderkey % 3 = 0 AS same FROM orders WHERE o_orderkey % 3 < 2)
      SELECT same, CASE WHEN same THEN 2 ELSE 4 END::BIGINT AS number_b, count(*) AS n, count(DISTINCT a) AS n_a, count(DISTINCT CASE WHEN same THEN a ELSE 'q' END) AS n_b FROM v GROUP BY 1, 2""",
    "frame_sampling": "SELECT event_type, count(*) AS n_frames, sum(event_id)::BIGINT AS sum_frame FROM events WHERE event_id % 15 = 0 GROUP BY 1",
    "format_hms": "SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS time FROM (SELECT event_id, floor(event_id * 37 / 25.0::DOUBLE)::BIGINT AS s FROM events)",
    "duplicates_json": f"""WITH {G}, {ALL}, {DUPLICATES} SELECT '{{"id_a":' || id_a || ',"id_b":' || id_b || '}}' AS value FROM dup WHERE s >= 0.4""",
    "person_folders": f"WITH {PATHS} SELECT path AS src, '/out/' || name || '/' || regexp_extract(path, '[^/]+$') AS dst FROM paths",
    "latency_stats": """WITH t AS (SELECT o_orderkey % 97 + 1.0::DOUBLE AS ms FROM orders)
      SELECT count(ms) AS n, round(avg(ms), 4) AS mean, round(quantile_cont(ms, 0.5), 4) AS median, round(quantile_cont(ms, 0.95), 4) AS p95, round(quantile_cont(ms, 0.99), 4) AS p99, round(1000 / avg(ms), 4) AS per_second FROM t""",
    "hash_split": "SELECT vec_id AS id, CASE WHEN substr(md5('42:' || label), 1, 8) < '33333333' THEN 'query' ELSE 'database' END AS part FROM embeddings",
    "chart_rows": f"""WITH {METHODS} SELECT method, recall, memory_mb, per_second, round(log10(memory_mb), 6) AS log_memory, round(log10(per_second), 6) AS log_speed FROM methods
      WHERE method IN ('m1', 'm2', 'm3', 'm5') AND recall >= 0.85""",
    "speed_ratios": f"""WITH {METHODS}, f AS (SELECT method, max(per_second) AS per_second, min(memory_mb) AS memory_mb FROM methods GROUP BY 1), b AS (SELECT * FROM f WHERE method = 'm0')
      SELECT f.method, f.per_second, f.memory_mb, round(f.per_second / b.per_second, 2) AS speed_up, round(b.memory_mb / f.memory_mb, 2) AS compression FROM f LEFT JOIN b ON true""",
    "analyzed_faces": """SELECT vec_id AS id, floor(least(100, abs(embedding[2]::DOUBLE) * 100))::BIGINT AS age, CASE WHEN embedding[1] > 0 THEN 'F' ELSE 'M' END AS gender,
        (['neutral', 'happy', 'surprise', 'sad', 'angry', 'disgust', 'fear', 'contempt'])[list_position(embedding[3:10], list_max(embedding[3:10]))] AS emotion FROM embeddings""",
    "repeated_ids": "SELECT o_custkey % 500 AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
    "decoded_points": """WITH a AS (SELECT vec_id AS image, vec_id % 12800 // 2 AS cell, embedding FROM embeddings), k AS (SELECT *, unnest(range(10)) AS k FROM a)
      SELECT image, k, round((CASE WHEN k % 2 = 0 THEN cell % 80 * 8 ELSE cell // 80 * 8 END + embedding[k + 1]::DOUBLE * 8) / 0.5, 6) AS at FROM k""",
    "limited_identities": """WITH i AS (SELECT 'p' || lpad((o_custkey % 50)::VARCHAR, 3, '0') AS identity, lpad(o_orderkey::VARCHAR, 12, '0') AS path FROM orders),
      c AS (SELECT *, dense_rank() OVER (ORDER BY identity) - 1 AS label FROM i QUALIFY row_number() OVER (PARTITION BY identity ORDER BY path) <= 5)
      SELECT identity, path, label FROM c ORDER BY label, path LIMIT 120""",
}

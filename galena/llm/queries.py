"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.llm._common import TEXT_KEY, documents, in_training
from galena.llm.bpe import bpe_round_trip
from galena.llm.decontaminate import decontaminate
from galena.llm.exact_dedup import exact_dedup
from galena.llm.interpolation import interpolated_scores
from galena.llm.near_dedup import near_dedup
from galena.llm.repeated_spans import repeated_spans
from galena.llm.secret_scan import secret_scan
from galena.llm.sharding import shard_by_splitters
from galena.llm.simple8b import token_files
from galena.llm.toxicity import CompressionModel, fit_toxicity, score_toxicity

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A source is an owner, and what it has in one language a repository of it.
    return secret_scan(documents(spark, sf_dir), repo_col=F.concat_ws("/", "source", "lang"), owner_col="source")


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_scores(documents(spark, sf_dir), modulus=7, left_out=2).drop("rid")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("rid", *TEXT_KEY)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), RANK_FILE, public_tokenizers.PATTERN)


def op5_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), WORD_FILE, end_id=1)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(documents(spark, sf_dir), benchmark).drop("rid")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> CompressionModel:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit_toxicity(docs, labels, training=in_training(F.col("doc_id"), 4, 2))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_toxicity(docs, toxicity_model(spark, docs, sf_dir))
    return scored.withColumn("held_out", ~in_training(F.col("doc_id"), 4, 2))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_splitters(documents(spark, sf_dir), shards=8)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), words=5, percent=75).drop("rid", "keep_rid", *TEXT_KEY)


def op10_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir), width=400).drop("rid")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_deleted_interpolation, op3_exact_dedup, op4_byte_bpe, op5_simple8b, op6_decontamination, op7_toxicity, op8_sharding, op9_near_dedup, op10_repeated_spans)}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_near_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l
          FROM documents),
        s AS (
          SELECT DISTINCT r, CASE WHEN len(l) >= 5 THEN array_to_string(l[p:p + 4], ' ') ELSE array_to_string(l, ' ') END AS g
          FROM w, unnest(range(1, CASE WHEN len(l) >= 5 THEN len(l) - 3 WHEN len(l) > 0 THEN 2 ELSE 1 END)) u(p)),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        both_ AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
        link AS (SELECT x, y FROM both_ JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
        e AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
        reach AS (SELECT r, r AS o FROM w UNION SELECT reach.r, e.y FROM reach JOIN e ON e.x = reach.o),
        c AS (SELECT reach.r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.o GROUP BY 1)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN c USING (r) LEFT JOIN n USING (r)
    """,
}

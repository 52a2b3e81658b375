"""A corpus pipeline of the operators in ``galena.llm``.

Stages, in order: toxic documents go; of exact copies one stays; of near copies one stays;
documents that hold benchmark items go; the rest is encoded to token ids and decoded again.
Each stage takes ``(spark, docs, sf_dir)`` and works on every row it is given; all but the
last return the columns of ``docs`` unchanged, whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from galena.llm._common import checkpointed
from galena.llm.bpe import bpe_round_trip
from galena.llm.decontaminate import clean_column
from galena.llm.exact_dedup import exact_dedup
from galena.llm.near_dedup import near_dedup
from galena.llm.queries import RANK_FILE, toxicity_model
from galena.llm.row_filter import keep_judged
from galena.llm.toxicity import THRESHOLD, score_column


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold. A null or empty text has no toxic window and
    stays; equal texts score alike; an empty table stays empty."""
    score = score_column(toxicity_model(spark, docs, sf_dir))
    return docs.where(score(docs["text"]) < THRESHOLD)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts the one with the largest id. Null and empty texts are copies
    of one another; a null id is the smallest; of rows with the same id and text one stays."""
    return keep_judged(docs, exact_dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts the row with the smallest id. Texts without words are linked with
    nothing and stay; a null id is the largest; of rows with the same id and text one stays."""
    judged = near_dedup(docs)
    return keep_judged(docs, judged.select("doc_id", "key_a", "key_b", (judged["rid"] == judged["keep_rid"]).alias("kept")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, nor an edited copy or long excerpt of one. Null and
    empty texts stay; equal texts are judged alike; an empty benchmark drops nothing."""
    clean = clean_column(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.where(clean(docs["text"]))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of ids and digests for each row; a null or empty text has 0 ids."""
    return bpe_round_trip(docs, RANK_FILE, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: SQL cannot express sketches, alignments or compression; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

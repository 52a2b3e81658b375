"""Dropping decided rows from a table with any columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm._common import TEXT_KEY, checkpointed, id_bitmap, in_bitmap, small_batches, text_key

BITMAP_BITS = 1 << 23


def free_names(taken: list[str], wished: list[str]) -> list[str]:
    """``wished`` with underscores added until no column of ``taken`` is called so, in any case."""
    low = {c.lower() for c in taken}
    tail = ""
    while any((w + tail).lower() in low for w in wished):
        tail += "_"
    return [w + tail for w in wished]


def keep_judged(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITMAP_BITS) -> DataFrame:
    """Rows of ``docs`` that ``judged`` keeps.

    ``judged`` has a row ``doc_id, key_a, key_b, kept`` for each row of ``docs``, as the
    operators return them; id and text hash say which, so it does not matter how ``docs`` is
    split when it is read again. Of rows with the same id and text, which only other columns
    can tell apart, one stays if any is kept. A bitmap of fixed size says which rows may be
    dropped; only those are shuffled, for the exact join, and all others pass in place. A null
    id equals a null id, a null text is empty, an empty table gives no rows. Columns come
    back unchanged, whatever they are called.
    """
    small_batches(docs.sparkSession)
    identity = ["none", "id", *TEXT_KEY]
    none, number = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0))
    rows = judged.select(none.alias("none"), number.alias("id"), *TEXT_KEY, "kept").groupBy(*identity).agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    listed = checkpointed(rows.where("not kept or n > 1").select(*identity, "kept", F.xxhash64(*identity).alias("mark")))
    bitmap = id_bitmap(listed, "mark", bits)

    @F.pandas_udf("boolean")
    def may_go(mark: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(mark.to_numpy(), bitmap))

    own = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    row, doubt, body, *names = free_names(docs.columns, ["row", "doubt", "body", *identity])
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keys = [k.alias(n) for k, n in zip(text_key(body), names[2:], strict=True)]
    told = docs.select(F.struct(*own).alias(row), doc_id.isNull().alias(names[0]), F.coalesce(doc_id, F.lit(0)).alias(names[1]), text.alias(body)).select(row, *names[:2], *keys)
    told = told.withColumn(doubt, may_go(F.xxhash64(*names)))
    passed = told.where(~F.col(doubt)).select(row)
    listed = listed.select(*(F.col(i).alias(n) for i, n in zip(identity, names, strict=True)), "kept")
    doubted = told.where(doubt).drop(doubt)
    kept = passed.unionByName(doubted.join(listed, names, "left_anti").select(row))
    if not listed.where("kept").isEmpty():
        once = doubted.join(listed.where("kept").drop("kept"), names, "left_semi").groupBy(*names).agg(F.first(row).alias(row))
        kept = kept.unionByName(once.select(row))
    return kept.select(f"{row}.*")

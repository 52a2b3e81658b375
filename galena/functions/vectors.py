"""Vector arithmetic as native column expressions.

Everything here stays in the JVM. Sums run in double precision from left to right, so equal
inputs give equal results on every plan.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null where an element or either vector is null."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str) -> Column:
    """``v`` scaled to unit length; a zero vector stays as it is."""
    norm = F.when(l2_norm(v) == 0, F.lit(1.0)).otherwise(l2_norm(v))
    return F.transform(_col(v), lambda x: x.cast("double") / norm)


def cosine(a: Column | str, b: Column | str) -> Column:
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def valid_embedding(v: Column | str, dim: int) -> Column:
    """True for a vector of ``dim`` finite elements; false, never null, for anything else."""
    bad = F.exists(_col(v), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(_col(v)) == dim) & ~bad, F.lit(False))


def hamming(a: Sequence[Column | str], b: Sequence[Column | str]) -> Column:
    """Differing bits of two codes given as equally many 64-bit words."""
    if len(a) != len(b) or not a:
        raise ValueError("codes need the same positive number of words")
    total = None
    for x, y in zip(a, b, strict=True):
        bits = F.bit_count(_col(x).bitwiseXOR(_col(y))).cast("long")
        total = bits if total is None else total + bits
    return total


def sign_bits(v: Column | str, weights: np.ndarray, thresholds: np.ndarray | None = None) -> list[Column]:
    """64-bit words of the bits ``w . v > t``, most significant bit first.

    One native expression per word, for codes of few bits; ``Quantizer.encode`` multiplies
    matrices instead. The last word is padded with zeros.
    """
    cut = np.zeros(len(weights)) if thresholds is None else np.asarray(thresholds, float)
    words = []
    for start in range(0, len(weights), 64):
        word = F.lit(0).cast("long")
        for k, (row, t) in enumerate(zip(weights[start : start + 64], cut[start : start + 64], strict=True)):
            literal = F.array(*(F.lit(float(x)) for x in row))
            bit = F.when(dot(v, literal) > float(t), F.lit(1)).otherwise(F.lit(0)).cast("long")
            word = word.bitwiseOR(F.shiftleft(bit, 63 - k))
        words.append(word)
    return words


def register_functions(spark: SparkSession) -> None:
    """SQL functions ``inner_product``, ``l2_norm``, ``l2_normalize``, ``cosine_similarity``,
    ``hamming`` and ``encode_bits`` (words of the bits ``w . v > t``, 64 a word, the most
    significant first; the last word is padded with zeros)."""
    product = "aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)"
    bodies = {
        "inner_product(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": product,
        "l2_norm(a ARRAY<FLOAT>) RETURNS DOUBLE": "sqrt(aggregate(a, 0D, (s, x) -> s + double(x) * double(x)))",
        "cosine_similarity(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": f"{product} / (sqrt(aggregate(a, 0D, (s, x) -> s + double(x) * double(x))) * sqrt(aggregate(b, 0D, (s, x) -> s + double(x) * double(x))))",
        "l2_normalize(a ARRAY<FLOAT>) RETURNS ARRAY<DOUBLE>": "transform(a, x -> double(x) / if(aggregate(a, 0D, (s, y) -> s + double(y) * double(y)) = 0, 1D, sqrt(aggregate(a, 0D, (s, y) -> s + double(y) * double(y)))))",
        "encode_bits(v ARRAY<FLOAT>, w ARRAY<ARRAY<DOUBLE>>, t ARRAY<DOUBLE>) RETURNS ARRAY<BIGINT>": "transform(sequence(0, cast(ceil(size(w) / 64D) as int) - 1), k -> aggregate(sequence(0, least(63, size(w) - 64 * k - 1)), 0L, (s, b) -> s | if(aggregate(zip_with(v, w[64 * k + b], (x, y) -> double(x) * y), 0D, (z, x) -> z + x) > t[64 * k + b], shiftleft(1L, 63 - b), 0L)))",
        "hamming(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS BIGINT": "aggregate(zip_with(a, b, (x, y) -> bigint(bit_count(x ^ y))), 0L, (s, x) -> s + x)",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

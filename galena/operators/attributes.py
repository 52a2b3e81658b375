"""Decoding of attribute models and filters on attributes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Emotion classes in the order of the model's outputs.
EMOTIONS = ("neutral", "happy", "surprise", "sad", "angry", "disgust", "fear", "contempt")
ADULT_AGE, CHILD_AGE = 18, 16


def softmax(logits: Column | str) -> Column:
    """Stable softmax of an array column."""
    logits = F.col(logits) if isinstance(logits, str) else logits
    exps = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    return F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda s, x: s + x))


def emotion(logits: Column | str) -> Column:
    """``STRUCT<emotion, confidence, scores>``: the first largest class, 3 decimals."""
    probabilities = softmax(logits)
    top = F.array_max(probabilities)
    at = F.array_position(probabilities, top).cast("int")
    names = F.array(*(F.lit(e) for e in EMOTIONS))
    shown = F.slice(probabilities, 1, len(EMOTIONS))
    scores = F.map_from_arrays(F.slice(names, F.lit(1), F.least(F.size(shown), F.lit(len(EMOTIONS)))), F.transform(shown, lambda p: F.round(p, 3)))
    return F.struct(F.coalesce(F.get(names, at - 1), F.lit("unknown")).alias("emotion"), F.round(top, 3).alias("confidence"), scores.alias("scores"))


def age_gender(outputs: Column | str) -> Column:
    """``STRUCT<age, gender>`` of a model's outputs: three values carry age / 100, two the age
    itself; fewer are unknown. Ages are cut to 0..100."""
    outputs = F.col(outputs) if isinstance(outputs, str) else outputs
    raw = F.get(outputs, F.lit(1)).cast("double") * F.when(F.size(outputs) == 3, 100.0).otherwise(1.0)
    age = F.greatest(F.least(raw, F.lit(100.0)), F.lit(0.0)).cast("int")
    known = F.size(outputs) >= 2
    return F.struct(
        F.when(known, age).otherwise(F.lit(-1)).alias("age"),
        F.when(~known, F.lit("unknown")).when(F.get(outputs, F.lit(0)) > 0, F.lit("F")).otherwise(F.lit("M")).alias("gender"),
    )


def is_child(age: Column | str, threshold: int = CHILD_AGE) -> Column:
    return (F.col(age) if isinstance(age, str) else age) < threshold


def age_gate(age: Column | str, age_filter: str | None = None, min_age: int | None = None, max_age: int | None = None) -> Column:
    """Why a query is filtered out, or null. The first failing rule gives the reason: adults
    only, children only, least age, greatest age. Filter on it before any search join.

    The reasons' wording is a fixed value of the output.
    """
    age = F.col(age) if isinstance(age, str) else age
    if age_filter not in (None, "adult", "child"):
        raise ValueError("age_filter is adult, child or None")
    shown = age.cast("string")
    reason = F.lit(None).cast("string")
    rules = []
    if age_filter == "adult":
        rules.append(F.when(age < ADULT_AGE, F.lit("query is child")))
    if age_filter == "child":
        rules.append(F.when(age >= ADULT_AGE, F.lit("query is adult")))
    if min_age is not None:
        rules.append(F.when(age < min_age, F.concat(F.lit("age "), shown, F.lit(f" below min_age {min_age}"))))
    if max_age is not None:
        rules.append(F.when(age > max_age, F.concat(F.lit("age "), shown, F.lit(f" above max_age {max_age}"))))
    return F.coalesce(*rules, reason) if rules else reason

"""Connected components of a graph that is never gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.functions.tables import checkpointed

#: Alternations after which a graph that has not settled is an error. The number needed
#: grows with the logarithm of the graph's diameter.
MOST_ROUNDS = 60


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link neighbours of each vertex to the least vertex of its neighbourhood.

    ``larger_only``: the large-star step (larger neighbours move); otherwise the small-star
    step (smaller neighbours and the vertex itself move).
    """
    if larger_only:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = checkpointed(least)  # as an input of its own, the join can split a hub's neighbours
    joined = both.join(least, "u")
    if larger_only:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``vertex, component`` for each vertex of ``edges`` (``u, v``, both long).

    The component is its least vertex. Large-star and small-star steps alternate until the
    edges are stars; each round is a few joins, cut by a checkpoint. Neighbourhoods are only
    aggregated, so a hub's may hold any number of vertices.
    """
    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(MOST_ROUNDS):
        now = checkpointed(_star(_star(now, True), False))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())

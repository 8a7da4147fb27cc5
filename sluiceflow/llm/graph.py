"""Connected components of links, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceflow.llm.common import keep


def components(edges: DataFrame) -> DataFrame:
    """(point, root) for all points of the links: alternating large and small stars until nothing changes.

    A link leads from a larger to a smaller point, and stays one link in both
    stars: no round has more links than the first, and repeats go at its end.
    """
    state = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "stars")
    mark = _mark(state)
    while True:
        # Large star: a link's smaller end gives way to the least that it links to itself.
        lower = state.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
        large = state.join(lower, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        # Small star: of a point's smaller ends the least takes the others and the point.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        state = keep(small.distinct(), "stars")
        now = _mark(state)
        if now == mark:
            break
        mark = now
    roots = state.select("v").distinct().select(F.col("v").alias("point"), F.col("v").alias("root"))
    return state.select(F.col("u").alias("point"), F.col("v").alias("root")).unionByName(roots)


def _mark(state: DataFrame) -> tuple:
    return tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

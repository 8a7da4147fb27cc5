"""Word panels: the words that stand for a group, and documents scored against every panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceflow.operators.ordered import Ordered
from sluiceflow.session import REPLICATE_BYTES, REPLICATE_LIMIT, at_most, materialize


def panels(tokens: DataFrame, group: str, word: str, size: int) -> DataFrame:
    """(species, words): for each group the `size` words that most rows of `tokens` have, ties by word."""
    counts = tokens.groupBy(group, word).agg(F.count(F.lit(1)).alias("n"))
    # The window keeps `size` rows per group in each task before the shuffle.
    order = Window.partitionBy(group).orderBy(F.desc("n"), word)
    best = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size)
    return best.groupBy(F.col(group).alias("species")).agg(F.collect_list(word).alias("words"))


def _scored(df: DataFrame, words: Column, found: DataFrame, name: str) -> DataFrame:
    """`df` with the best (overlap, species) of panels that are few enough to be copied to its rows."""
    one = found.agg(F.array_sort(F.collect_list(F.struct("species", "words"))).alias("__panels"))
    score = F.transform("__panels", lambda p, i: F.struct(
        F.size(F.array_intersect(words, p.words)).alias("overlap"), (-i).alias("place"), p.species.alias("species"),
    ))
    top = F.array_max(score)
    return df.crossJoin(F.broadcast(one)).withColumn(name, F.struct(top.overlap.alias("overlap"), top.species.alias("species"))).drop("__panels")


def best_panel(
    df: DataFrame, words: Column, found: DataFrame, name: str = "best", limit: int = REPLICATE_LIMIT, size: int = REPLICATE_BYTES,
) -> DataFrame:
    """`df` with (overlap, species) of the panel that shares most words; the smaller species wins a tie.

    The panels, one of `size` words per group, travel to the rows, so a row's score is made where the row is. They
    are counted and measured first. When there are more than may be copied, they come in blocks, in the order of their
    species: each block meets the rows' words in a pass of its own, which keeps a row's best so far.
    """
    found = materialize(found, "panels")
    if at_most(found, limit, size):
        return _scored(df, words, found, name)
    width = F.length(F.to_json(F.struct("species", "words"))).cast("bigint")
    placed = Ordered(found.withColumn("__width", width), ["species"]).extend(row_number="__nr", running={"__upto": F.col("__width")})
    before = F.col("__upto") - F.col("__width")
    # Both terms grow along the order, so a block has `limit` rows at most, and `size` bytes and one panel.
    block = F.floor((F.col("__nr") - 1) / limit) + F.floor(before / size)
    blocks = materialize(placed.select("species", "words", block.alias("__block")), "blocks")
    rows = materialize(df.select("*", F.monotonically_increasing_id().alias("__row"), words.alias("__words")), "rows")
    kind = f"struct<overlap:int,species:{found.schema['species'].dataType.simpleString()}>"
    best = rows.select("__row", "__words", F.lit(None).cast(kind).alias("__best"))
    for (number,) in sorted(tuple(r) for r in blocks.select("__block").distinct().collect()):
        met = _scored(best, F.col("__words"), blocks.where(F.col("__block") == number).select("species", "words"), "__new")
        better = F.col("__best").isNull() | (F.col("__new.overlap") > F.col("__best.overlap"))
        best = materialize(met.select("__row", "__words", F.when(better, F.col("__new")).otherwise(F.col("__best")).alias("__best")), "best")
    joined = rows.join(best.select("__row", F.col("__best").alias(name)), "__row")
    return joined.select(*[c for c in df.columns if c != name], name)

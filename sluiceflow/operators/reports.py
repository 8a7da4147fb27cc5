"""Aggregations behind the score and run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceflow.operators.ordered import Ordered


def with_totals(df: DataFrame, key: str, *aggregates: Column, total: str = "total") -> DataFrame:
    """The aggregates per key and over everything, from one pass."""
    rolled = df.rollup(key).agg(F.grouping(key).alias("__all"), *aggregates)
    return rolled.withColumn(key, F.when(F.col("__all") == 1, F.lit(total)).otherwise(F.col(key))).drop("__all")


def hits(column: str, limit: float = 0.01) -> Column:
    """Rows at or under a q-value limit."""
    return F.count_if(F.col(column) <= limit)


def top_labels(scores: DataFrame, item: str, label: str, score: str) -> DataFrame:
    """(item, label, top): the label with the greatest score, the smallest among equals."""
    rank = F.struct((-F.col(score)).alias("s"), F.col(label).alias("l"))
    return scores.groupBy(item).agg(F.min_by(label, rank).alias(label), F.max(score).alias("top"))


def tally(labelled: DataFrame, actual: str, expected: str, score: str, limits: Sequence[float], scale: float) -> DataFrame:
    """Correct, unknown and wrong answers for every limit, from one pass over the rows.

    An answer whose score is under limit × scale counts as unknown.
    """
    choices = F.array(*[F.lit(float(t)) for t in limits])
    each = labelled.select(actual, expected, score, F.explode(choices).alias("threshold"))
    unknown = F.col(score) < F.col("threshold") * scale
    right = F.col(actual) == F.col(expected)
    return each.groupBy("threshold").agg(
        F.count_if(~unknown & right).alias("correct"),
        F.count_if(unknown).alias("unknown"),
        F.count_if(~unknown & ~right).alias("wrong"),
    )


def rank_bins(df: DataFrame, order_by: Sequence[str | Column], size: int, confident: Column) -> DataFrame:
    """Rows in rank order, cut into bins of `size`; how many of each bin are confident."""
    placed = Ordered(df, order_by).extend(row_number="__row")
    return placed.groupBy(F.floor((F.col("__row") - 1) / size).cast("bigint").alias("bin")).agg(
        F.count_if(confident).alias("confident"), F.count_if(~confident).alias("other")
    )


def balanced(df: DataFrame, label: str, key: str) -> DataFrame:
    """As many rows of each label as the rarest one has, chosen by a hash of the key.

    Rows are ranked across range partitions, so a label with most of the rows
    is not gathered in one place.
    """
    hashed = Ordered(df.withColumn("__h", F.md5(F.col(key).cast("string"))), ["__h", key], [label])
    fewest = hashed.rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n")).first()["n"]
    placed = hashed.extend(row_number="__row")
    return placed.where(F.col("__row") <= (fewest or 0)).drop("__h", "__row")


def hash_sample(df: DataFrame, key: str, number: int, seed: str = "") -> DataFrame:
    """`number` rows in a shuffled order that is the same on every run."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(number)


def last_of(df: DataFrame, group: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The greatest row of each group by `order`, without sorting the group."""
    latest = F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("__last")
    return df.groupBy(group).agg(latest).select(group, *[F.col(f"__last.{c}").alias(c) for c in columns])


def part_lists(df: DataFrame, group: str, part: str, per_row: int = 1000) -> DataFrame:
    """(group, page, n, parts): the parts of each group in order, `per_row` to a row.

    A group of any size becomes as many rows as it needs, so none is gathered whole.
    """
    placed = Ordered(df.select(group, part), [part], [group]).extend(row_number="__row")
    paged = placed.withColumn("page", F.floor((F.col("__row") - 1) / per_row).cast("bigint"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("__row", part))), lambda p: p[part].cast("string"))
    return paged.groupBy(group, "page").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", listed).alias("parts"))

"""Range boundaries, binning, and total sorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceflow.operators.ordered import Ordered


def bin_column(value: Column, boundaries: Sequence[float]) -> Column:
    """1-based bin i with boundaries[i-1] <= value < boundaries[i]; null outside.

    The list is short by construction (one entry per bin) and the comparisons
    are halved at each step.
    """

    def search(low: int, high: int) -> Column:
        if high - low == 1:
            return F.lit(high)
        middle = (low + high) // 2
        return F.when(value < F.lit(boundaries[middle]), search(low, middle)).otherwise(search(middle, high))

    covered = (value >= F.lit(boundaries[0])) & (value < F.lit(boundaries[-1]))
    return F.when(covered, search(0, len(boundaries) - 1)).cast("int")


def pivots(df: DataFrame, value: str, bins: int, within: Sequence[str] = ()) -> DataFrame:
    """Exact boundaries per group: every (rows div bins)-th distinct value, and the maximum + 1."""
    counts = df.groupBy(*within, value).agg(F.count(F.lit(1)).alias("n"))
    placed = Ordered(counts, [value], within).extend(
        row_number="place", lead={"following": F.col(value)}, whole={"rows": F.col("n")}
    )
    step = F.greatest(F.lit(1), F.floor(F.col("rows") / bins))
    last = F.col("following").isNull()
    chosen = placed.where(last | ((F.col("place") - 1) % step == 0))
    return chosen.select(*within, F.when(last, F.col(value) + 1).otherwise(F.col(value)).alias("boundary"))


def merge_pivots(boundaries: DataFrame, bins: int) -> DataFrame:
    """Distinct union of boundary lists, resampled to `bins` ranges; the maximum stays."""
    union = Ordered(boundaries.select("boundary").distinct(), ["boundary"])
    total = union.rows.count()
    wanted = {min(round(i * total / bins), total - 1) for i in range(bins)} | {total - 1}
    return union.extend(row_number="place").where(F.col("place").isin([w + 1 for w in sorted(wanted)])).select("boundary")


def approximate_pivots(df: DataFrame, value: str, bins: int, accuracy: float = 0.001) -> list[float]:
    """Boundaries of equally filled bins from one mergeable quantile summary."""
    shares = [i / bins for i in range(bins + 1)]
    found = df.approxQuantile(value, shares, accuracy)
    return sorted(set(found[:-1])) + [found[-1] + 1]


# Size of a summary: ranks are off by some 0.3 % of the rows, whatever their number.
SUMMARY_SIZE = 800


def summaries(df: DataFrame, value: str, within: Sequence[str] = (), size: int = SUMMARY_SIZE) -> DataFrame:
    """(within…, summary, n, top): a KLL quantile summary per group, to be stored and merged with later ones.

    It is of bounded size, some thousand numbers. Null values are left out, and so are groups without others.
    """
    number = F.col(value).cast("double")
    return df.where(number.isNotNull()).groupBy(*within).agg(
        F.kll_sketch_agg_double(number, F.lit(size)).alias("summary"), F.count("*").alias("n"), F.max(number).alias("top"),
    ).where("n > 0")


def merge_summaries(parts: DataFrame, within: Sequence[str] = (), size: int = SUMMARY_SIZE) -> DataFrame:
    """One summary per group of several, in whatever order they come; parts of parts may be merged again."""
    return parts.groupBy(*within).agg(
        F.kll_merge_agg_double("summary", F.lit(size)).alias("summary"), F.sum("n").cast("bigint").alias("n"), F.max("top").alias("top"),
    ).where("n > 0")


def summary_pivots(merged: DataFrame, bins: int, within: Sequence[str] = ()) -> DataFrame:
    """(within…, boundary): boundaries of `bins` evenly filled ranges, distinct, with the exact maximum + 1 as the last."""
    shares = F.array(*[F.lit(i / bins) for i in range(bins)])
    inner = F.filter(F.kll_sketch_get_quantile_double("summary", shares), lambda v: v <= F.col("top"))
    edges = F.array_distinct(F.concat(inner, F.array(F.col("top") + 1)))
    return merged.select(*within, F.explode(edges).alias("boundary"))


def pivot_ranges(boundaries: DataFrame, value: str = "boundary") -> DataFrame:
    """(bin, lo, hi): consecutive boundaries as half-open ranges, numbered from 1."""
    placed = Ordered(boundaries, [value]).extend(row_number="bin", lead={"hi": F.col(value)})
    return placed.where(F.col("hi").isNotNull()).select("bin", F.col(value).alias("lo"), "hi")


def range_join(df: DataFrame, value: str, boundaries: DataFrame, boundary: str = "boundary") -> DataFrame:
    """`df` with (bin, lo, hi): the range, numbered from 1, with lo <= value < hi between neighbouring boundaries; nulls outside.

    Rows and boundaries are laid in one order and the last boundary is carried
    along, so neither side is sent anywhere whole, however many boundaries
    there are. Boundaries given twice count once; null values have no range.
    """
    kind = dict(df.dtypes)[value]
    edges = boundaries.select(F.col(boundary).cast(kind).alias("__edge")).where("__edge IS NOT NULL").distinct()
    whole = F.struct(*[F.col(c) for c in df.columns])
    both = df.select(F.col(value).alias("__at"), whole.alias("__row"), F.lit(None).cast(kind).alias("__edge")).unionByName(
        edges.select(F.col("__edge").alias("__at"), F.lit(None).cast(df.schema).alias("__row"), "__edge")
    )
    # A boundary comes before the rows equal to it.
    placed = Ordered(both, ["__at", F.col("__edge").isNull()]).extend(
        running={"bin": F.col("__edge").isNotNull().cast("bigint")}, latest={"lo": F.col("__edge")}, least_after={"hi": F.col("__edge")},
    )
    within = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    return placed.where("__edge IS NULL").select(
        *[F.col("__row")[c].alias(c) for c in df.columns],
        *[F.when(within, F.col(c)).alias(c) for c in ("bin", "lo", "hi")],
    )


def sort_range(df: DataFrame, *order_by: str | Column) -> DataFrame:
    """Total order over range partitions; rows of one partition follow those of the one before."""
    return df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)


def partition_bounds(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(partition, n, lo, hi) of `bins` range partitions."""
    laid = df.select(value).repartitionByRange(bins, value).withColumn("partition", F.spark_partition_id())
    return laid.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))

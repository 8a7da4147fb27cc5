"""Curves over time: how many (or how much) is active, finished or spent."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceflow.operators.ordered import Ordered


# Repeats of one value that a row makes at a time.
GAP_STEPS = 10_000


def _deltas(df: DataFrame, start: Column, end: Column, weight: Column, by: Sequence[str]) -> DataFrame:
    """Net change per distinct time; most rows are summed away before the shuffle."""
    change = F.array(
        F.struct(start.alias("t"), weight.alias("d")), F.struct(end.alias("t"), (-weight).alias("d"))
    )
    return (
        df.select(*by, F.inline(change))
        .groupBy(*by, "t")
        .agg(F.sum("d").alias("delta"))
    )


def concurrency(
    df: DataFrame, start: str = "start_us", end: str = "end_us", weight: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """(by…, t, delta, active): +weight at each start, -weight at each end, summed along time."""
    weight = F.lit(1).cast("bigint") if weight is None else weight
    changes = _deltas(df, F.col(start), F.col(end), weight, by)
    return Ordered(changes, ["t"], by).extend(running={"active": F.col("delta")})


def cumulative(df: DataFrame, at: str, amount: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by…, t, amount, total): running total of an amount that falls due at a time."""
    due = df.groupBy(*by, F.col(at).alias("t")).agg(F.sum(amount).alias("amount"))
    return Ordered(due, ["t"], by).extend(running={"total": F.col("amount")})


def step_points(curve: DataFrame, gap: int) -> DataFrame:
    """Two points per change: the value before it, `gap` earlier, and the value after it."""
    points = F.array(
        F.struct((F.col("t") - gap).alias("t"), (F.col("active") - F.col("delta")).alias("active"), F.lit(0).alias("side")),
        F.struct(F.col("t").alias("t"), F.col("active").alias("active"), F.lit(1).alias("side")),
    )
    return curve.select(F.inline(points))


def fill_gaps(curve: DataFrame, step: int, by: Sequence[str] = ()) -> DataFrame:
    """Repeat each value every `step` until the next change.

    A long gap is cut into pieces of `GAP_STEPS` repeats; those after the first are dealt over the tasks.
    """
    following = Ordered(curve, ["t"], by).extend(lead={"next": F.col("t")})
    until = F.coalesce(F.col("next") - 1, F.col("t"))
    piece = F.explode(F.sequence(F.col("t"), F.col("__until"), F.lit(step * GAP_STEPS)))
    pieces = following.select(*by, "t", "active", until.alias("__until")).select("*", piece.alias("__from"))
    first = F.col("__from") == F.col("t")
    dealt = pieces.where(first).unionByName(pieces.where(~first).repartition(*by, "__from"))
    last = F.least(F.col("__from") + step * (GAP_STEPS - 1), F.col("__until"))
    return dealt.select(*by, F.explode(F.sequence(F.col("__from"), last, F.lit(step))).alias("t"), "active")


def ecdf(df: DataFrame, value: Column) -> DataFrame:
    """(value, n, share): share of rows at or below each distinct value."""
    counts = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = Ordered(counts, ["value"]).extend(running={"seen": F.col("n")}, whole={"total": F.col("n")})
    return placed.select("value", "n", (F.col("seen") / F.col("total")).alias("share"))


def quartiles(df: DataFrame, value: Column, by: Sequence[str]) -> DataFrame:
    """Exact minimum, quartiles (linear between ranks) and maximum per group.

    Equal values are counted first, then ranks are read off a running total, so
    no group's values are ever held in one place.
    """
    counts = df.groupBy(*by, value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = Ordered(counts, ["v"], by).extend(running={"upto": F.col("n")}, whole={"total": F.col("n")})
    picks = []
    for name, share in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)):
        rank = (F.col("total") - 1) * F.lit(share)
        for side, position in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            here = (F.col("upto") - F.col("n") <= position) & (position < F.col("upto"))
            picks.append(F.max(F.when(here, F.col("v"))).alias(f"{name}_{side}"))
        picks.append(F.max(rank - F.floor(rank)).alias(f"{name}_part"))
    wanted = ranked.groupBy(*by).agg(F.min("v").alias("low"), F.max("v").alias("high"), *picks)
    between = [
        (F.col(f"{q}_lo") + (F.col(f"{q}_hi") - F.col(f"{q}_lo")) * F.col(f"{q}_part")).alias(q)
        for q in ("q1", "q2", "q3")
    ]
    return wanted.select(*by, "low", *between, "high")


def normal_cdf(df: DataFrame, value: Column, edges: int) -> DataFrame:
    """(i, edge, cdf): the fitted normal density at equally spaced edges, summed and scaled to 1.

    Without values there are no rows; where all are equal, so are the edges, and all rows lie at or below each.
    """
    mean, std, low, high = df.agg(F.avg(value), F.stddev_pop(value), F.min(value), F.max(value)).first()
    places = df.sparkSession.range(edges if low is not None else 0).select("id", F.col("id").cast("int").alias("i"))
    if not std:
        return places.select("i", F.lit(low).cast("double").alias("edge"), F.lit(1.0).alias("cdf"))
    edge = F.lit(low) + F.lit((high - low) / max(1, edges - 1)) * F.col("id")
    density = F.exp(-((edge - F.lit(mean)) ** 2) / F.lit(2 * std * std)) / F.lit(std * math.sqrt(2 * math.pi))
    points = places.select("i", edge.alias("edge"), density.alias("pdf"))
    so_far = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # `edges` rows
    whole = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return points.select("i", "edge", (F.sum("pdf").over(so_far) / F.sum("pdf").over(whole)).alias("cdf"))

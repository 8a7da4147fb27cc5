"""Row numbers, running totals and neighbours over a total order, at any size.

A window without a partition key, or with one key holding much of the data,
runs in one task. Here the rows are range-partitioned on the full order
instead, so a hot key is spread over many tasks. Each (group, partition) piece
is summarised into one row, the summaries are accumulated, and every row adds
what came before its piece. The range-partitioned rows are written out first,
because a recomputed range partitioning may draw other boundaries.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from sluiceflow.session import materialize

PIECE = "__piece"
SPOT = "__spot"


def _as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


class Ordered:
    """`df` laid out in the order (`within`, `order_by`), where ties are broken by the caller's keys.

    Range partitioning reads its input twice, once to sample it. With `settle`
    an input that is costly to compute but narrow is written out before that.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[str | Column], within: Sequence[str] = (), settle: bool = False):
        self.within = list(within)
        if settle:
            df = materialize(df, "settled")
        self.order_by = [_as_column(c) for c in order_by]
        layout = [F.col(c) for c in self.within] + self.order_by
        self.rows = materialize(
            df.repartitionByRange(*layout)
            .sortWithinPartitions(*layout)
            .withColumn(PIECE, F.spark_partition_id())
            .withColumn(SPOT, F.monotonically_increasing_id()),
            "ordered",
        )

    def extend(
        self,
        row_number: str | None = None,
        running: Mapping[str, Column] | None = None,
        lag: Mapping[str, Column] | None = None,
        lead: Mapping[str, Column] | None = None,
        whole: Mapping[str, Column] | None = None,
        latest: Mapping[str, Column] | None = None,
        least_after: Mapping[str, Column] | None = None,
    ) -> DataFrame:
        """Add a 1-based row number, running sums, previous / next values and sums over the whole group.

        `latest` is the last value that is not null, up to the row itself; `least_after` the smallest from the row on.

        Everything that concerns a group is joined per piece of it, so a group
        with most of the rows is still handled by many tasks.
        """
        running, lag, lead, whole = dict(running or {}), dict(lag or {}), dict(lead or {}), dict(whole or {})
        latest, least_after = dict(latest or {}), dict(least_after or {})
        keys = [*self.within, PIECE]
        pieces = self.rows.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("__n"),
            F.min(SPOT).alias("__first"),
            F.max(SPOT).alias("__last"),
            *[F.sum(c).alias(f"__sum_{name}") for name, c in running.items()],
            *[F.sum(c).alias(f"__all_{name}") for name, c in whole.items()],
            *[F.max_by(c, SPOT).alias(f"__end_{name}") for name, c in lag.items()],
            *[F.min_by(c, SPOT).alias(f"__begin_{name}") for name, c in lead.items()],
            *[F.max_by(c, F.when(c.isNotNull(), F.col(SPOT))).alias(f"__latest_{name}") for name, c in latest.items()],
            *[F.min(c).alias(f"__least_{name}") for name, c in least_after.items()],
        )
        # One row per piece: a group has at most as many as there are partitions.
        along = Window.partitionBy(*self.within).orderBy(PIECE)
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        # Backwards, as a frame up to the end would be gone over anew for every row.
        after = Window.partitionBy(*self.within).orderBy(F.desc(PIECE)).rowsBetween(Window.unboundedPreceding, -1)
        offsets = pieces.select(
            *[F.col(k).alias(f"__at_{k}") for k in keys],
            "__first",
            "__last",
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n_before"),
            *[F.sum(f"__sum_{n}").over(before).alias(f"__sum_{n}") for n in running],
            *[F.sum(f"__all_{n}").over(Window.partitionBy(*self.within)).alias(n) for n in whole],
            *[F.lag(f"__end_{n}").over(along).alias(f"__end_{n}") for n in lag],
            *[F.lead(f"__begin_{n}").over(along).alias(f"__begin_{n}") for n in lead],
            *[F.last(f"__latest_{n}", ignorenulls=True).over(before).alias(f"__latest_{n}") for n in latest],
            *[F.min(f"__least_{n}").over(after).alias(f"__least_{n}") for n in least_after],
        )
        rows = self.rows
        if running or lag or lead or latest or least_after:
            local = Window.partitionBy(*keys).orderBy(SPOT)
            so_far = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            from_end = Window.partitionBy(*keys).orderBy(F.desc(SPOT)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            rows = rows.select(
                "*",
                *[F.sum(c).over(so_far).alias(f"__here_{n}") for n, c in running.items()],
                *[F.lag(c).over(local).alias(f"__prev_{n}") for n, c in lag.items()],
                *[F.lead(c).over(local).alias(f"__next_{n}") for n, c in lead.items()],
                *[F.last(c, ignorenulls=True).over(so_far).alias(f"__now_{n}") for n, c in latest.items()],
                *[F.min(c).over(from_end).alias(f"__on_{n}") for n, c in least_after.items()],
            )
        if not self.within:
            offsets = F.broadcast(offsets)  # one row per partition
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__at_{k}")) for k in keys])
        joined = rows.join(offsets, same)
        added: list[Column] = []
        if row_number:
            position = F.col(SPOT) - F.col("__first") + F.col("__n_before") + 1
            added.append(position.cast("bigint").alias(row_number))
        for name in running:
            here, earlier = F.col(f"__here_{name}"), F.col(f"__sum_{name}")
            kind = joined.schema[f"__here_{name}"].dataType
            if isinstance(kind, DecimalType):
                # One digit less on each side: adding two 38-digit decimals would drop a decimal place.
                kind = DecimalType(min(kind.precision, 37), kind.scale)
            zero = F.lit(0).cast(kind)
            added.append((F.coalesce(earlier.cast(kind), zero) + F.coalesce(here.cast(kind), zero)).alias(name))
        for name in lag:
            edge = F.col(SPOT) == F.col("__first")
            added.append(F.when(edge, F.col(f"__end_{name}")).otherwise(F.col(f"__prev_{name}")).alias(name))
        for name in lead:
            edge = F.col(SPOT) == F.col("__last")
            added.append(F.when(edge, F.col(f"__begin_{name}")).otherwise(F.col(f"__next_{name}")).alias(name))
        added += [F.coalesce(F.col(f"__now_{name}"), F.col(f"__latest_{name}")).alias(name) for name in latest]
        added += [F.least(F.col(f"__on_{name}"), F.col(f"__least_{name}")).alias(name) for name in least_after]
        added += [F.col(name) for name in whole]
        kept = [c for c in self.rows.columns if c not in (PIECE, SPOT)]
        return joined.select(*kept, *added)


def numbered(
    df: DataFrame, order_by: Sequence[str | Column], name: str, within: Sequence[str] = (), total: str | None = None
) -> DataFrame:
    """`df` with its 1-based position in the order within its group, and the group's row count."""
    whole = {total: F.lit(1).cast("bigint")} if total else None
    return Ordered(df, order_by, within).extend(row_number=name, whole=whole)


def running_total(
    df: DataFrame, order_by: Sequence[str | Column], sums: Mapping[str, Column], within: Sequence[str] = ()
) -> DataFrame:
    return Ordered(df, order_by, within).extend(running=sums)

"""Operators on pixel grids: 3×3 neighbourhoods, windows, border clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSIDE, BORDER, OUTSIDE = 0, 1, 2


def _spread(cells: DataFrame, values: Sequence[str], width: int, height: int, by: Sequence[str]) -> DataFrame:
    """Send every cell's values to all cells whose window holds it.

    `slot` numbers the sender's place in the receiver's window, row by row.
    """
    rows = F.sequence(F.lit(-height), F.lit(height))
    columns = F.sequence(F.lit(-width), F.lit(width))
    offsets = F.flatten(F.transform(rows, lambda dy: F.transform(columns, lambda dx: F.struct(dx.alias("dx"), dy.alias("dy")))))
    slot = (F.col("o.dy") + height) * (2 * width + 1) + F.col("o.dx") + width
    return cells.select(*by, "x", "y", *values, F.explode(offsets).alias("o")).select(
        *by,
        (F.col("x") - F.col("o.dx")).alias("x"),
        (F.col("y") - F.col("o.dy")).alias("y"),
        slot.cast("int").alias("slot"),
        *values,
    )


def around(
    cells: DataFrame, values: Sequence[str], aggregates: Sequence[Column], width: int = 1, height: int = 1,
    by: Sequence[str] = (),
) -> DataFrame:
    """Aggregate each existing cell's window with one shuffle and no join.

    The aggregates may use `values` and `slot`; the centre slot is the cell itself.
    """
    centre = (2 * width + 1) * height + width
    return (
        _spread(cells, values, width, height, by)
        .groupBy(*by, "x", "y")
        .agg(F.max((F.col("slot") == centre)).alias("__here"), *aggregates)
        .where("__here")
        .drop("__here")
    )


def window_features(
    cells: DataFrame, value: str | Sequence[str], width: int = 1, height: int = 1, outside: int = 0, by: Sequence[str] = (),
) -> DataFrame:
    """The window's values in row order, `outside` where the image ends; of several channels, a place's values stand together."""
    channels = [value] if isinstance(value, str) else list(value)
    slots = (2 * width + 1) * (2 * height + 1)
    found = [
        F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"__w{i}_{k}") for i in range(slots) for k, c in enumerate(channels)
    ]
    flat = F.array(*[F.coalesce(F.col(f"__w{i}_{k}"), F.lit(outside)) for i in range(slots) for k in range(len(channels))])
    return around(cells, channels, found, width, height, by).select(*by, "x", "y", flat.alias("features"))


def clean_borders(cells: DataFrame, cls: str = "cls", by: Sequence[str] = ()) -> DataFrame:
    """A border cell with no other border cell around it becomes an outside cell."""
    own = F.max(F.when(F.col("slot") == 4, F.col(cls))).alias(cls)
    borders = F.count_if(F.col(cls) == BORDER).alias("__borders")
    lonely = (F.col(cls) == BORDER) & (F.col("__borders") <= 1)
    return (
        around(cells, [cls], [own, borders], by=by)
        .withColumn(cls, F.when(lonely, F.lit(OUTSIDE)).otherwise(F.col(cls)))
        .drop("__borders")
    )

"""Points against polygons: inside, and near an edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceflow.operators.verbs import replicated_if_small
from sluiceflow.session import REPLICATE_LIMIT

# Fixed value: the largest cross product of a point that counts as near an edge.
SLACK = 10.0
# Smaller boxes share a level: 2 ** LEAST_LEVEL is their cells' side.
LEAST_LEVEL = -20


def edges(vertices: Column) -> Column:
    """Each vertex `a` with the one after it, `b`; the last is joined to the first."""
    following = F.concat(F.slice(vertices, 2, F.greatest(F.size(vertices) - 1, F.lit(0))), F.slice(vertices, 1, 1))
    return F.zip_with(vertices, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_box(vertices: Column, x: Column, y: Column) -> Column:
    def span(axis: str) -> tuple[Column, Column]:
        values = F.transform(vertices, lambda v: v[axis])
        return F.array_min(values), F.array_max(values)

    (x0, x1), (y0, y1) = span("x"), span("y")
    return x.between(x0, x1) & y.between(y0, y1)


def inside(vertices: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point to the right crosses the outline an odd number of times."""

    def crossed(edge: Column) -> Column:
        a, b = edge["a"], edge["b"]
        straddles = (a["y"] > y) != (b["y"] > y)
        at = F.try_divide((a["x"] - b["x"]) * (y - b["y"]), a["y"] - b["y"]) + b["x"]
        return straddles & F.coalesce(x < at, F.lit(False))

    return in_box(vertices, x, y) & (F.size(F.filter(edges(vertices), crossed)) % 2 == 1)


def near_edge(vertices: Column, x: Column, y: Column, slack: float = SLACK) -> Column:
    """Whether the point is a vertex, or beside an edge with a cross product of at most `slack`.

    A vertex given twice in a row makes no edge.
    """

    def close(edge: Column) -> Column:
        a, b = edge["a"], edge["b"]
        along_x, along_y = b["x"] - a["x"], b["y"] - a["y"]
        length = along_x * along_x + along_y * along_y
        cross = (y - a["y"]) * along_x - (x - a["x"]) * along_y
        dot = (x - a["x"]) * along_x + (y - a["y"]) * along_y
        corner = ((x == a["x"]) & (y == a["y"])) | ((x == b["x"]) & (y == b["y"]))
        return corner | ((length > 0) & (F.abs(cross) <= slack) & dot.between(F.lit(0.0), length))

    return F.exists(edges(vertices), close)


def reach(vertices: Column, slack: float = SLACK) -> Column:
    """How far from its outline a point can be and still be `near_edge`: slack / shortest edge."""

    def length(edge: Column) -> Column:
        return F.hypot(edge["b"]["x"] - edge["a"]["x"], edge["b"]["y"] - edge["a"]["y"])

    shortest = F.array_min(F.filter(F.transform(edges(vertices), length), lambda n: n > 0))
    return F.coalesce(F.lit(slack) / shortest, F.lit(0.0))


def pair_with_polygons(
    points: DataFrame, polygons: DataFrame, condition: Column, margin: Column | float = 0.0, limit: int = REPLICATE_LIMIT,
) -> DataFrame:
    """Points (x, y, …) with the polygons (name, vertices) for which `condition` holds.

    Joined by cells of several levels. A polygon is listed on the level whose
    cell side, a power of two, is just over the extent of its box, widened by
    `margin`: in four cells at most, however large it is. A point looks in its
    cell of every level that has polygons; there are as many as the extents have
    powers of two. A short list is sent to every executor, so that the points do
    not move; else a busy cell's points are split by the adaptive skew join.
    """
    margin = F.lit(margin) if isinstance(margin, float) else margin

    def bounds(axis: str) -> tuple[Column, Column]:
        values = F.transform("vertices", lambda v: v[axis])
        return F.array_min(values) - margin, F.array_max(values) + margin

    (x0, x1), (y0, y1) = bounds("x"), bounds("y")
    extent = F.greatest(x1 - x0, y1 - y0, F.lit(2.0**LEAST_LEVEL))
    drawn = polygons.where(F.size("vertices") > 0).withColumn("__level", F.ceil(F.log2(extent)).cast("int"))

    def cells(low: Column, high: Column) -> Column:
        side = F.pow(F.lit(2.0), F.col("__level"))
        return F.sequence(F.floor(low / side), F.floor(high / side))

    listed = drawn.withColumn("__cx", F.explode(cells(x0, x1))).withColumn("__cy", F.explode(cells(y0, y1)))
    levels = sorted(r[0] for r in drawn.select("__level").distinct().collect())  # powers of two
    spread = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    side = F.pow(F.lit(2.0), F.col("__level"))
    placed = spread.withColumn("__cx", F.floor(F.col("x") / side)).withColumn("__cy", F.floor(F.col("y") / side))
    joined = placed.join(replicated_if_small(listed, limit), ["__level", "__cx", "__cy"])
    return joined.where(condition).drop("__level", "__cx", "__cy")

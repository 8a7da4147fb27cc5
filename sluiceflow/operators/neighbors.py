"""Exact k nearest neighbours by Euclidean distance, the merge of partial lists, and the vote.

When a count shows that the training vectors are few, every executor gets all
of them and the test vectors are not shuffled. Otherwise both sides are
partitioned around pivots as in Lu et al., "Efficient Processing of k Nearest
Neighbor Joins using MapReduce" (VLDB 2012): the triangle inequality bounds how
far a cell's test vectors can be from their k-th neighbour, and a training
vector is sent only to the cells within that bound. Cells are cut into blocks
of test vectors, which a task holds while the cell's training vectors stream
past, and it emits the k best once. Only a cell with very many training vectors
is shared by several tasks per block, so the partial lists do not grow with the
training blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceflow.session import at_most, materialize

MAX_PIVOTS = 2048
# Numbers the driver may hold while bounding the cells: pivots² × (k + 1).
BOUND_VALUES = 10_000_000
BLOCK_ROWS = 4096
# Training blocks that stream past one held test block.
STREAM_BLOCKS = 256
SEND_ALL_VALUES = 4_000_000
# Numbers of a temporary matrix in a task.
_TILE = 1_000_000
# Candidates per wanted neighbour beyond which a block's own k-th distance is looked up.
_FEW = 4
_SLACK = 1e-9


def matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    squared = (left**2).sum(1)[:, None] + (right**2).sum(1)[None, :] - 2.0 * left @ right.T
    return np.sqrt(np.maximum(squared, 0.0))


def exact_distances(left: np.ndarray, right: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Distances of the pairs (left[at], right[of]), of however many pairs, a tile of numbers at a time."""
    found = np.empty(len(at))
    step = max(1, _TILE // max(1, left.shape[1]))
    for low in range(0, len(at), step):
        own = slice(low, low + step)
        found[own] = np.sqrt(((left[at[own]] - right[of[own]]) ** 2).sum(1))
    return found


def sliced(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """The batches cut so that rows times `width` stay within a tile."""
    step = max(1, _TILE // max(1, width))
    for batch in batches:
        for low in range(0, len(batch), step):
            yield batch.iloc[low : low + step]


def block_nearest(
    test_ids: np.ndarray, test: np.ndarray, train_ids: np.ndarray, train: np.ndarray, k: int, skip_same: bool,
    within: np.ndarray | None = None,
) -> pd.DataFrame:
    """The k best training rows of this block per test row; with `within`, of those no further than that.

    The matrix product only selects candidates, with a slack for its rounding;
    their distances are then taken from the differences.
    """
    parts = []
    norms, turned = (train**2).sum(1), -2.0 * train.T
    tile = max(1, _TILE // max(1, len(train_ids)))
    for begin in range(0, len(test_ids), tile):
        ids, rows = test_ids[begin : begin + tile], test[begin : begin + tile]
        own = (rows**2).sum(1)
        squared = rows @ turned
        squared += own[:, None]
        squared += norms[None, :]
        if skip_same:
            squared[ids[:, None] == train_ids[None, :]] = np.inf
        slack = _SLACK * (1.0 + own + norms.max())
        bound = np.full(len(ids), np.inf) if within is None else within[begin : begin + tile] ** 2 * (1 + _SLACK)
        near = squared <= (bound + slack)[:, None]
        if near.sum() > _FEW * k * len(ids):
            depth = min(k, squared.shape[1])
            bound = np.minimum(bound, np.partition(squared, depth - 1, axis=1)[:, depth - 1])
            near = squared <= (bound + slack)[:, None]
        at, of = np.nonzero(near)
        other = np.isfinite(squared[at, of])
        at, of = at[other], of[other]
        exact = exact_distances(rows, train, at, of)
        found = pd.DataFrame({"test_id": ids[at], "train_id": train_ids[of], "distance": exact})
        found = found.sort_values(["test_id", "distance", "train_id"], kind="stable")
        parts.append(found.groupby("test_id", sort=False).head(k))
    if not parts:
        return pd.DataFrame({"test_id": [], "train_id": [], "distance": []})
    return pd.concat(parts)


_PAIR = "test_id bigint, train_id bigint, distance double"


def merge_nearest(partial: DataFrame, k: int) -> DataFrame:
    """The k best per test vector over all partial lists, ranked from 1."""
    order = Window.partitionBy("test_id").orderBy("distance", "train_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    test: DataFrame, train: DataFrame, k: int, skip_same: bool = False, limit: int = SEND_ALL_VALUES,
    pivots: int | None = None, block: int = BLOCK_ROWS,
) -> DataFrame:
    """(test_id, train_id, distance, rank) for frames of (id, vec).

    `limit` is the largest training set, in numbers (rows × dimensions), that is
    copied to every executor.
    """
    test, train = test.select("id", "vec"), train.select("id", "vec")
    first = train.select(F.size("vec").alias("n")).first()
    if at_most(train, limit // max(1, first["n"] if first else 1)):
        return merge_nearest(_against_all(test, train, k, skip_same), k)
    return merge_nearest(_by_cells(test, train, k, skip_same, pivots, block), k)


def _against_all(test: DataFrame, train: DataFrame, k: int, skip_same: bool) -> DataFrame:
    held = train.toPandas()
    shared = test.sparkSession.sparkContext.broadcast((held["id"].to_numpy(), matrix(held["vec"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = shared.value
        for batch in batches:
            if len(batch) and len(ids):
                yield block_nearest(batch["id"].to_numpy(), matrix(batch["vec"]), ids, vectors, k, skip_same)

    return test.mapInPandas(scan, _PAIR)


def _by_cells(
    test: DataFrame, train: DataFrame, k: int, skip_same: bool, pivots: int | None, block: int
) -> DataFrame:
    wanted = k + 1 if skip_same else k
    # Of equal vectors only the smallest ids can be among the nearest. However
    # many copies there are, each task sends on no more than `wanted` of them.
    copies = Window.partitionBy("vec").orderBy("id")
    train = materialize(
        train.withColumn("__copy", F.row_number().over(copies)).where(F.col("__copy") <= wanted).drop("__copy"), "train"
    )
    ceiling = min(MAX_PIVOTS, int((BOUND_VALUES / (wanted + 1)) ** 0.5))
    # No more cells than blocks of test vectors: where the bounds cut little off,
    # a training vector is then sent no further than in a plain block join.
    count = pivots or min(ceiling, -(-test.count() // block) + 1, train.count())
    chosen = train.orderBy(F.xxhash64("id"), "id").limit(count).select("vec").toPandas()
    centres = matrix(chosen["vec"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches, len(centres)):
            away = distances(matrix(batch["vec"]), centres)
            cell = away.argmin(1)
            yield batch.assign(cell=cell.astype("int32"), reach=away[np.arange(len(cell)), cell])

    placed_test = materialize(test.mapInPandas(place, f"{_fields(test)}, cell int, reach double"), "cells")

    def closest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # At most `wanted` reaches per cell leave a task.
        best: pd.DataFrame | None = None
        for batch in place(batches):
            rows = batch[["cell", "reach"]] if best is None else pd.concat([best, batch[["cell", "reach"]]])
            best = rows.sort_values("reach").groupby("cell").head(wanted)
        if best is not None:
            yield best

    by_reach = Window.partitionBy("cell").orderBy("reach")
    reaches = (
        train.mapInPandas(closest, "cell int, reach double")
        .withColumn("rank", F.row_number().over(by_reach))
        .where(F.col("rank") <= wanted)
        .toPandas()  # at most pivots × (k + 1) numbers
    )
    sizes = placed_test.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("far")).toPandas()
    far = np.full(len(centres), -np.inf)
    far[sizes["cell"].to_numpy(dtype=int)] = sizes["far"].to_numpy()
    test_blocks = np.ones(len(centres), dtype=int)
    test_blocks[sizes["cell"].to_numpy(dtype=int)] = np.ceil(sizes["n"].to_numpy() / block).astype(int)

    between = distances(centres, centres)
    # Furthest a cell's k-th neighbour can be: via the pivots of both cells.
    upper = far[:, None] + between[:, reaches["cell"].to_numpy(dtype=int)] + reaches["reach"].to_numpy()[None, :]
    depth = min(wanted, upper.shape[1])
    radius = np.partition(upper, depth - 1, axis=1)[:, depth - 1]
    if upper.shape[1] < wanted:
        radius = np.full(len(centres), np.inf)

    def wanted_by(batch: pd.DataFrame) -> np.ndarray:
        away = distances(matrix(batch["vec"]), centres)
        slack = 1e-6 * (1.0 + away)
        own = away.min(1)[:, None]
        home = away.argmin(1)
        gap = 2.0 * between[:, home].T
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(gap > 0, (away**2 - own**2) / gap, 0.0)
        return np.isfinite(far) & (away - far <= radius + slack) & (plane <= radius + slack)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(centres), dtype=np.int64)
        for batch in sliced(batches, len(centres)):
            total += wanted_by(batch).sum(0)
        yield pd.DataFrame({"cell": np.arange(len(centres), dtype="int32"), "n": total})

    loads = train.mapInPandas(tally, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    train_blocks = np.ones(len(centres), dtype=int)
    train_blocks[loads["cell"].to_numpy(dtype=int)] = np.maximum(1, np.ceil(loads["n"].to_numpy() / (block * STREAM_BLOCKS))).astype(int)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A vector may go to every cell, so what is sent of a batch goes out in parts, too.
        for batch in sliced(batches, len(centres)):
            at, cell = np.nonzero(wanted_by(batch))
            step = max(1, _TILE // max(1, len(batch["vec"].iloc[0])))
            for low in range(0, len(at), step):
                yield batch.iloc[at[low : low + step]].assign(cell=cell[low : low + step].astype("int32"))

    def blocks(counts: np.ndarray) -> "F.Column":
        return F.element_at(F.array(*[F.lit(int(c)) for c in counts]), F.col("cell") + 1)

    def block_of(counts: np.ndarray) -> "F.Column":
        return F.pmod(F.xxhash64("id"), blocks(counts)).cast("int")

    def every(counts: np.ndarray) -> "F.Column":
        return F.explode(F.sequence(F.lit(0), blocks(counts) - 1))

    left = placed_test.select("id", "vec", "cell", block_of(test_blocks).alias("tb")).withColumn("sb", every(train_blocks))
    right = (
        train.mapInPandas(send, f"{_fields(train)}, cell int")
        .select("id", "vec", "cell", block_of(train_blocks).alias("sb"))
        .withColumn("tb", every(test_blocks))
    )

    keys = ["cell", "tb", "sb"]
    both = left.select(*keys, F.lit(0).alias("side"), "id", "vec").unionByName(right.select(*keys, F.lit(1).alias("side"), "id", "vec"))
    laid = both.repartition(*keys).sortWithinPartitions(*keys, "side")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        test_side: tuple[np.ndarray, np.ndarray] | None = None
        best: pd.DataFrame | None = None
        within: np.ndarray | None = None
        last = None
        for batch in batches:
            for key, rows in batch.groupby([*keys, "side"], sort=False):
                if key[:3] != last:
                    if best is not None:
                        yield best
                    held, test_side, best, last = [], None, None, key[:3]
                if key[3] == 0:
                    held.append(rows[["id", "vec"]])
                    continue
                if not held:
                    continue
                if test_side is None:
                    tests = pd.concat(held)
                    test_side = tests["id"].to_numpy(), matrix(tests["vec"])
                    held.clear()
                    held.append(tests[["id"]])
                    within = None
                found = block_nearest(*test_side, rows["id"].to_numpy(), matrix(rows["vec"]), k, skip_same, within)
                if best is not None:
                    found = pd.concat([best, found]).sort_values(["test_id", "distance", "train_id"], kind="stable")
                    found = found.groupby("test_id", sort=False).head(k)
                best = found
                full = best.groupby("test_id")["distance"].agg(["size", "max"])
                kth = full["max"].where(full["size"] >= k, np.inf)
                within = kth.reindex(test_side[0]).fillna(np.inf).to_numpy()
        if best is not None:
            yield best

    return laid.mapInPandas(solve, _PAIR)


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def merge_lists(lists: DataFrame, k: int) -> DataFrame:
    """Merge (point, neighbors array<struct<dist, cls>>) lists from many files to k per point."""
    flat = lists.select("point", F.inline("neighbors"))
    order = Window.partitionBy("point").orderBy("dist", "cls")
    kept = flat.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k)
    return kept.groupBy("point").agg(
        F.sort_array(F.collect_list(F.struct("dist", "cls"))).alias("neighbors")
    )


def vote(neighbors: DataFrame, point: str = "test_id", classes: tuple[int, ...] = (0, 1, 2), otherwise: int = 2) -> DataFrame:
    """Distance-weighted class of each point from (point, distance, rank, cls).

    The nearest neighbour weighs 1, the others fall linearly to 0 at the
    furthest. A tie gives `otherwise`.
    """
    span = neighbors.groupBy(point).agg(
        F.min("distance").alias("__d1"), F.max("distance").alias("__dk"),
        F.sort_array(F.collect_list(F.struct("rank", "distance", "cls"))).alias("__near"),  # k entries
    )
    width = F.when(F.col("__dk") != F.col("__d1"), F.col("__dk") - F.col("__d1")).otherwise(F.lit(0.0001))

    def score(cls: int):
        def add(total, n):
            weight = F.when(n["rank"] == 1, F.lit(1.0)).otherwise((F.col("__dk") - n["distance"]) / width)
            return total + F.when(n["cls"] == cls, weight).otherwise(F.lit(0.0))

        return F.round(F.aggregate("__near", F.lit(0.0), add), 9)

    scored = span.select(point, F.array(*[score(c) for c in classes]).alias("__scores"))
    best = F.array_max("__scores")
    ballots = F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("cls"), F.col("__scores").alias("score"))
    winners = F.filter(ballots, lambda b: b["score"] == best)
    winner = F.when(F.size(winners) == 1, F.element_at(winners, 1)["cls"]).otherwise(F.lit(otherwise))
    return scored.select(point, winner.cast("int").alias("cls"))

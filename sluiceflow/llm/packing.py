"""Packing plans over counts of lengths, and their application to the actual pieces.

A plan needs no more than how many pieces have each length, at most `capacity`
numbers however large the corpus is. It lists classes of sequences that hold the
same lengths, so it is bounded too, and exact: every piece gets its place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceflow.llm.common import extended

Runs = list[tuple[int, int]]  # (length, how many), in order of place

# Sizes to which long pieces are rounded; each is tried and the fewest sequences win.
GROUPS = (6, 12, 20)
# Pieces over capacity / LARGE are packed by configurations.
LARGE = 6


@dataclass
class Class:
    """`count` sequences that all hold `runs` and have `room` left."""

    count: int
    room: int
    runs: Runs = field(default_factory=list)


class Stock:
    """Classes by room, with a segment tree over the rooms that have any."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.any = np.zeros(2 * self.leaves, dtype=np.int64)
        self.by_room: dict[int, list[Class]] = {}

    def put(self, c: Class) -> None:
        self.by_room.setdefault(c.room, []).append(c)
        self._add(c.room, 1)

    def take(self, room: int) -> Class:
        self._add(room, -1)
        return self.by_room[room].pop()

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.any[node] += by
            node //= 2

    def least(self, room: int) -> int | None:
        """The smallest stocked room that is at least `room`."""
        node = self.leaves + room
        if self.any[node]:
            return room
        while node > 1 and (node % 2 or not self.any[node + 1]):
            node //= 2
        if node == 1:
            return None
        node += 1
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves

    def all(self) -> list[Class]:
        return [c for room in sorted(self.by_room) for c in self.by_room[room]]


def best_fit(counts: np.ndarray, capacity: int, started: Iterable[Class] = ()) -> list[Class]:
    """Best-fit-decreasing of `counts[length]` pieces, into started sequences first."""
    stock = Stock(capacity)
    for c in started:
        stock.put(c)
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            room = stock.least(length)
            if room is None:
                each = capacity // length
                if left >= each:
                    stock.put(Class(left // each, capacity - each * length, [(length, each)]))
                if left % each:
                    stock.put(Class(1, capacity - left % each * length, [(length, left % each)]))
                break
            c = stock.take(room)
            each = room // length  # the fullest sequence that fits is the one just used
            full = min(c.count, left // each)
            if full:
                stock.put(Class(full, room - each * length, [*c.runs, (length, each)]))
                left -= full * each
            rest = c.count - full
            if rest and left:
                stock.put(Class(1, room - left * length, [*c.runs, (length, left)]))
                rest, left = rest - 1, 0
            if rest:
                stock.put(Class(rest, room, c.runs))
    return stock.all()


def configurations(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Every non-empty choice of sizes that fits, as rows of counts."""
    rows = [np.zeros((1, len(sizes)), dtype=np.int16)]
    used = np.zeros(1, dtype=np.int64)
    every = rows[0]
    for i, size in enumerate(sizes):
        grown, room = [every], [used]
        while len(grown[-1]):
            fits = room[-1] + size <= capacity
            more = grown[-1][fits].copy()
            more[:, i] += 1
            grown.append(more)
            room.append(room[-1][fits] + size)
        every, used = np.concatenate(grown), np.concatenate(room)
    return every[used > 0]


def optimise(patterns: np.ndarray, demand: np.ndarray) -> dict[int, float]:
    """Fewest sequences (fractional) whose patterns cover the demand: revised simplex on the covering programme."""
    m = len(demand)
    cost = np.ones(len(patterns) + m)
    # Start from one pattern per size that holds nothing else; it always exists.
    alone = {int(np.flatnonzero(p)[0]): k for k, p in enumerate(patterns) if np.count_nonzero(p) == 1}
    columns = np.concatenate([patterns.astype(float), -np.eye(m)])
    cost[len(patterns):] = 0.0
    basis = [alone[i] for i in range(m)]
    for _ in range(50 * m):
        inverse = np.linalg.inv(columns[basis].T)
        value = inverse @ demand
        dual = cost[basis] @ inverse
        reduced = cost - columns @ dual
        enter = int(np.argmin(reduced))
        if reduced[enter] > -1e-9:
            break
        step = inverse @ columns[enter]
        ratio = np.where(step > 1e-9, value / np.where(step > 1e-9, step, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[int(np.argmin(ratio))] = enter
    value = np.linalg.inv(columns[basis].T) @ demand
    return {k: float(v) for k, v in zip(basis, value) if k < len(patterns) and v > 1e-9}


def linear_grouping(counts: np.ndarray, capacity: int, groups: tuple[int, ...] = GROUPS) -> list[Class]:
    """Fewest sequences found by linear grouping over several numbers of groups.

    Long pieces, by falling length, form groups of equal cardinality and count
    as the longest of their group. The best mix of configurations of those few
    sizes is optimised and rounded down; the actual pieces take the slots of
    their group, which leaves their difference as room. What is left of the
    long pieces and all short ones then go by best fit.
    """
    plans = [_grouped(counts, capacity, k) for k in groups]
    return min(plans, key=lambda plan: sum(c.count for c in plan))


def _grouped(counts: np.ndarray, capacity: int, groups: int) -> list[Class]:
    rest = counts.copy()
    full = Class(int(rest[capacity]), 0, [(capacity, 1)])
    rest[capacity] = 0
    lengths = np.arange(capacity, capacity // LARGE, -1)
    amounts = rest[lengths]
    total = int(amounts.sum())
    started: list[Class] = []
    if total:
        share = -(-total // groups)
        runs: list[Runs] = []  # of each group, by falling length
        position = 0
        for length, amount in zip(lengths.tolist(), amounts.tolist()):
            while amount:
                if position // share == len(runs):
                    runs.append([])
                part = min(amount, share - position % share)
                runs[-1].append((length, part))
                position, amount = position + part, amount - part
        sizes = np.array([r[0][0] for r in runs])
        demand = np.array([float(sum(n for _, n in r)) for r in runs])
        patterns = configurations(sizes, capacity)
        for pattern, times in sorted(optimise(patterns, demand).items()):
            whole = int(times + 1e-9)
            if not whole:
                continue
            # Rounding down and the covering slack never ask for more than a group has, but check anyway.
            need = patterns[pattern].astype(int)
            for g in np.flatnonzero(need):
                whole = min(whole, sum(n for _, n in runs[g]) // int(need[g]))
            mixed = [Class(whole, capacity)] if whole else []
            for g in np.flatnonzero(need).tolist():
                for _ in range(need[g]):
                    mixed = [d for c in mixed for d in _substitute(c, runs[g])]
            started += mixed
        rest[lengths] = 0
        for r in runs:
            for length, n in r:
                rest[length] += n
    plan = best_fit(rest, capacity, started)
    return ([full] if full.count else []) + plan


def _substitute(c: Class, runs: Runs) -> Iterator[Class]:
    """Give each sequence of a class one actual piece of a group; splits the class where lengths change."""
    left = c.count
    while left:
        length, n = runs[0]
        part = min(left, n)
        yield Class(part, c.room - length, [*c.runs, (length, 1)])
        runs[:1] = [(length, n - part)] if n > part else []
        left -= part


def slots(plan: list[Class], capacity: int) -> dict[str, np.ndarray]:
    """For each length, which ranks go where: arrays sorted by (length, first rank)."""
    nth = np.zeros(capacity + 1, dtype=np.int64)
    rows, sequence = [], 0
    for c in plan:
        offset = 0
        for length, each in c.runs:
            rows.append((length, nth[length], sequence, offset, each))
            nth[length] += c.count * each
            offset += length * each
        sequence += c.count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "offset", "each"), table.T)) | {"n": np.array([sequence])}


def find_slots(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the piece with this rank among those of its length."""
    key = (table["length"] << 44) + table["rank"]
    at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
    beyond = rank - table["rank"][at]
    each = table["each"][at]
    return table["sequence"][at] + beyond // each, table["offset"][at] + beyond % each * length


def place(pieces: DataFrame, capacity: int, planner) -> DataFrame:
    """Add `sequence_id` and `offset` to written pieces.

    `pieces` has `part` (the task that made it), `nth` (its rank among the
    pieces of its length in that task) and `length`. A piece's rank among all of
    its length is its own plus what earlier parts have, so nothing is sorted as
    a whole and a length that a third of the corpus has is not gathered.
    """
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("in_part"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("first", F.coalesce(F.sum("in_part").over(before), F.lit(0))).drop("in_part")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    # At most `capacity` rows, whatever the input.
    for row in counts.groupBy("length").agg(F.sum("in_part").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    table = slots(planner(histogram, capacity), capacity)
    ranked = pieces.join(firsts, ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth")).drop("first", "nth", "part")
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast(table)  # bounded by the capacity, see the module's head
    schema = extended(ranked.drop("rank"), sequence_id="long", offset="integer")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = find_slots(shared.value, length, rank)
            kept = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
            yield pa.RecordBatch.from_pydict(kept | {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset.astype(np.int32))})

    return ranked.mapInArrow(put, schema)

"""Jaccard join of shingle sets by vertical partitioning.

The shingles' names of 56 bits are the global order. It is cut into fragments,
ranges of equal width whose number grows with the text; a set's part in a
fragment is its segment. Fragments are counted apart from each other, twice:

1. A fragment holds all segments in its range, so it knows how many sets have
   each shingle. Summed over fragments, the shingles that a set shares with any
   other bound its overlap with every other: a set that shares less than the
   wanted part links with nothing and goes.
2. Of the sets that stay, each takes the first shingles in (frequency, name)
   order that a linked set must share one of. Sets joined by these make
   clusters, and clusters are cut into blocks along the size of the sets. For a
   pair of blocks, overlaps of all pairs are counted fragment by fragment and
   summed per pair; a pair of blocks whose sizes are too far apart is left out.

Pairs never leave the task that counts them: it returns a spanning forest of
the links and each set's number of links. Equal sets are one point throughout,
named by 64 bits of all members, so copies are never compared.

A null text has no shingles. A text without words has an empty set, is linked
with nothing and is its own component; fewer words than a shingle are one
shingle. A null id belongs to its component, whose id is the smallest that is
not null. Repeated rows are documents of their own and stay. Empty tables give
no rows, and only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from sluiceflow.llm import words
from sluiceflow.llm.common import keep
from sluiceflow.llm.graph import components
from sluiceflow.operators.ordered import Ordered
from sluiceflow.session import spread

SHINGLE = 5
# Links need PERCENT * union <= 100 * intersection.
PERCENT = 80
# Shingles of a fragment, about; a task holds one fragment at a time.
FRAGMENT = 3 * 2**19
LEAST_FRAGMENTS = 64
# Counts that a task holds before it sends their sums on.
HELD_COUNTS = 2**20
# Buckets of points; a task sends on the sums of a bucket in one row.
COUNT_BUCKETS = 1024
# Sets of a block, and shingles that a block's sets add up to but for its last one.
BLOCK, BLOCK_SHINGLES = 1024, 2**22
# Fragments in which the pairs of a cluster are counted.
CUTS = 8
_COLUMNS = 4096
_SPACE = words.byte_kinds(b" \t\n\x0b\x0c\r")


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The distinct names of each text's shingles, in order; 56 bits each."""
    found = words.split(column, _SPACE)
    named = words.names(found.distinct)[found.ids]
    n = len(named)
    top = np.uint64(8)
    runs = words.chained([named[i : n - shingle + 1 + i] for i in range(shingle)]) >> top if n >= shingle else named[:0]
    bounds = found.bounds().tolist()
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= shingle:
            sets.append(np.unique(runs[a : b - shingle + 1]))
        else:
            sets.append(words.chained([named[k : k + 1] for k in range(a, b)]) >> top if b > a else named[:0])
    return sets


def set_name(values: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(values.tobytes(), len(values))


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, dtype=np.uint64).view(np.int64))


def _lists(values: pa.Array, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


def packed(values: np.ndarray) -> bytes:
    """Numbers of 56 bits, in seven bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 7, 8), dtype=np.uint8)
    wide[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return wide.reshape(-1).view("<u8")


def segments(df: DataFrame, id_type, fragments: int, shingle: int) -> DataFrame:
    """Rows of `slot` 0 and up: segments (point, number of shingles, names) of a fragment; below 0: documents (id, point, size of the set)."""
    schema = (
        StructType().add("slot", "long").add("id", ArrayType(id_type)).add("point", ArrayType(LongType()))
        .add("n", ArrayType(IntegerType())).add("names", BinaryType())
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = shingle_sets(batch.column("text"), shingle)
            points = np.array([set_name(s) for s in sets], dtype=np.uint64)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            ids = batch.column("id")
            # Documents go along under a slot of their own, another one for each batch.
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1 - int(points[0] >> np.uint64(40))]), _lists(ids, [len(ids)]), _lists(_longs(points), [len(ids)]),
                 _lists(pa.array(sizes, pa.int32()), [len(ids)]), pa.array([None], pa.binary())],
                names=schema.names,
            )
            _, kept = np.unique(points, return_index=True)
            values = np.concatenate([sets[k] for k in kept])
            of = np.repeat(kept, sizes[kept])
            slot = ((values >> np.uint64(24)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            values, of, slot = values[order], of[order], slot[order]
            if not len(values):
                continue
            begins = np.flatnonzero(np.append(True, (slot[1:] != slot[:-1]) | (of[1:] != of[:-1])))
            counts = np.diff(np.append(begins, len(values)))
            rows = np.flatnonzero(np.append(True, np.diff(slot[begins]) != 0))
            per_row = np.diff(np.append(rows, len(begins))).tolist()
            edges = np.append(begins[rows], len(values)).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot[begins[rows]]), pa.nulls(len(rows), ids_type(ids)), _lists(_longs(points[of[begins]]), per_row),
                 _lists(pa.array(counts, pa.int32()), per_row), pa.array([packed(values[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary())],
                names=schema.names,
            )

    return df.mapInArrow(cut, schema)


def ids_type(ids: pa.Array) -> pa.DataType:
    return pa.list_(ids.type)


def _by_slot(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each value of a column by which the batches are in order."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        values = batch.column(column).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if held and values[a] != at:
                yield held
                held = []
            at = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def _flat(batches: list[pa.RecordBatch], column: str) -> np.ndarray:
    return np.concatenate([b.column(column).flatten().to_numpy(zero_copy_only=False) for b in batches])


def shared_segments(cut: DataFrame) -> DataFrame:
    """The segments without shingles that only one set has, with each shingle's number of sets; documents as they are; written."""
    schema = StructType(list(cut.schema.fields)).add("sets", BinaryType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_slot(batches, "slot"):
            slot = held[0].column("slot")[0].as_py()
            if slot < 0:
                for part in held:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(len(part), pa.binary())], names=schema.names)
                continue
            points, sizes = _flat(held, "point"), _flat(held, "n")
            values = unpacked(b"".join(v.as_buffer() for b in held for v in b.column("names")))
            # Equal sets have equal segments; the first of each stays.
            _, first = np.unique(points, return_index=True)
            one = np.zeros(len(points), dtype=bool)
            one[first] = True
            if not one.all():
                values, points, sizes = values[np.repeat(one, sizes)], points[one], sizes[one]
            # Only the few names that come twice are looked up; a sort of a copy tells which.
            ordered = np.sort(values)
            repeats, times = np.unique(ordered[np.append(ordered[1:] == ordered[:-1], False)], return_counts=True) if len(ordered) else (ordered, ordered)
            del ordered
            place = np.searchsorted(repeats, values)
            np.minimum(place, max(len(repeats) - 1, 0), out=place)
            both = repeats[place] == values if len(repeats) else np.zeros(len(values), dtype=bool)
            times = times[place[both]] + 1  # each name but its last occurrence was counted
            del place
            owner = np.repeat(np.arange(len(points)), sizes)[both]
            counts = np.bincount(owner, minlength=len(points))
            some = counts > 0
            if some.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slot]), pa.nulls(1, held[0].schema.field("id").type), _lists(pa.array(points[some]), [int(some.sum())]),
                     _lists(pa.array(counts[some], pa.int32()), [int(some.sum())]), pa.array([values[both].tobytes()], pa.binary()),
                     pa.array([times.astype(np.uint32).tobytes()], pa.binary())],
                    names=schema.names,
                )

    return keep(cut.repartition("slot").sortWithinPartitions("slot").mapInArrow(count, schema), "fragments", rows=500)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Points and their sums so far, each time there are HELD_COUNTS of them, and at the end."""
    points, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        points = np.append(points, batch.column("point").flatten().to_numpy())
        counts = np.append(counts, batch.column("n").flatten().to_numpy())
        if len(points) > HELD_COUNTS:
            points, place = np.unique(points, return_inverse=True)
            counts = np.bincount(place, weights=counts).astype(np.int64)
            if 2 * len(points) > HELD_COUNTS:
                yield points, counts
                points, counts = points[:0], counts[:0]
    points, place = np.unique(points, return_inverse=True)
    yield points, np.bincount(place, weights=counts, minlength=len(points)).astype(np.int64)


def partial_counts(shared: DataFrame) -> DataFrame:
    """(bucket, points, their counts): sums over the fragments that a task reads, a row per bucket of points instead of one per point."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for points, counts in _summed(batches):
            bucket = (points.view(np.uint64) % np.uint64(COUNT_BUCKETS)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            found, sizes = np.unique(bucket, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), _lists(pa.array(points[order]), sizes.tolist()), _lists(pa.array(counts[order]), sizes.tolist())], names=["bucket", "point", "n"],
            )

    return shared.select("point", "n").mapInArrow(total, "bucket int, point array<long>, n array<long>")


def shared_counts(shared: DataFrame) -> DataFrame:
    """(point, n): how many shared shingles a point has, a row per point."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, points, counts = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, place = np.unique(points, return_inverse=True)
            return found, np.bincount(place, weights=counts, minlength=len(found)).astype(np.int64)

        limit = HELD_COUNTS
        for batch in batches:
            for k, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket != at and len(points):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged()], names=["point", "n"])
                    points, counts, limit = points[:0], counts[:0], HELD_COUNTS
                at = bucket
                points, counts = (np.append(v, batch.column(c)[k].values.to_numpy()) for v, c in ((points, "point"), (counts, "n")))
                if len(points) > limit:
                    points, counts = merged()
                    limit = max(HELD_COUNTS, 2 * len(points))
        if len(points):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged()], names=["point", "n"])

    laid = partial_counts(shared).repartition("bucket").sortWithinPartitions("bucket")
    return laid.mapInArrow(add, "point long, n long")


def _parted(shared: DataFrame) -> DataFrame:
    """A row per point and fragment: (point, slot, names, sets)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                points, sizes = (batch.column(c).slice(k, 1).flatten() for c in ("point", "n"))
                cuts = np.append(0, np.cumsum(sizes.to_numpy()))
                slot = pa.array(np.full(len(points), batch.column("slot")[k].as_py()))
                halves = [
                    pa.Array.from_buffers(pa.large_binary(), len(points), [None, pa.py_buffer(cuts * size), batch.column(c)[k].as_buffer()]).cast(pa.binary())
                    for c, size in (("names", 8), ("sets", 4))
                ]
                yield pa.RecordBatch.from_arrays([points, slot, *halves], names=["point", "slot", "names", "sets"])

    return shared.select("slot", "point", "n", "names", "sets").mapInArrow(part, "point long, slot long, names binary, sets binary")


def _first_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(token, point): the shingles, rarest first, of which a linked set has one; a set's unshared ones come before and are left out."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, counts = [], []
            for n, parts in zip(batch.column("n").to_pylist(), batch.column("parts")):
                values = np.concatenate([np.frombuffer(p["names"].as_buffer(), np.uint64) for p in parts.values])
                times = np.concatenate([np.frombuffer(p["sets"].as_buffer(), np.uint32) for p in parts.values])
                wanted = max(len(values) - (percent * n + 99) // 100 + 1, 0)
                tokens.append(values[np.lexsort((values, times))[:wanted]])
                counts.append(len(tokens[-1]))
            points = np.repeat(batch.column("point").to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([_longs(np.concatenate(tokens or [np.zeros(0, np.uint64)])), pa.array(points)], names=["token", "point"])

    return sets.select("point", "n", "parts").mapInArrow(first, "token long, point long")


def _recut(sets: DataFrame) -> DataFrame:
    """(point, n, copies, names): a set's shared shingles in CUTS fragments, whatever the number was that all texts needed."""
    edges = (np.arange(1, CUTS, dtype=np.uint64) << np.uint64(32)) // np.uint64(CUTS) << np.uint64(24)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for parts in batch.column("parts"):
                values = np.frombuffer(b"".join(p["names"].as_buffer() for p in parts.values), np.uint64)  # parts are in order
                at = [0, *np.searchsorted(values, edges).tolist(), len(values)]
                names.append([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:])])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("point", "n", "copies")], pa.array(names, pa.list_(pa.binary()))], names=["point", "n", "copies", "names"],
            )

    return sets.select("point", "n", "copies", "parts").mapInArrow(cut, "point long, n long, copies long, names array<binary>")


def _linked(counts: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * counts >= percent * (n[:, None] + m[None, :] - counts)


def _forest(near: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    unseen = np.ones(len(near), dtype=bool)
    a: list[int] = []
    b: list[int] = []
    for start in range(len(near)):
        if not unseen[start]:
            continue
        unseen[start] = False
        todo = [start]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(near[x] & unseen).tolist()
            unseen[new] = False
            a += [x] * len(new)
            b += new
            todo += new
    return a, b


class _Cell:
    """The overlaps of the sets of one block, or of the pairs across two, summed over fragments."""

    def __init__(self, points: np.ndarray, side: np.ndarray, n: np.ndarray, copies: np.ndarray):
        self.points, self.side, self.n, self.copies = points, side, n, copies
        self.at = {p: k for k, p in enumerate(points.tolist())}
        self.left = np.flatnonzero(~side)
        self.right = np.flatnonzero(side) if side.any() else self.left
        self.counts = np.zeros((len(self.left), len(self.right)), dtype=np.int64)

    def add(self, points: list[int], names: list[pa.Buffer]) -> None:
        """Count one fragment."""
        parts = [np.frombuffer(v, np.uint64) for v in names]
        owner = np.repeat([self.at[p] for p in points], [len(p) for p in parts])
        _, column, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        several = times > 1
        renumbered = np.cumsum(several) - 1
        owner, column = owner[several[column]], renumbered[column[several[column]]]
        width = int(several.sum())
        for low in range(0, width, _COLUMNS):
            here = (column >= low) & (column < low + _COLUMNS)
            has = np.zeros((len(self.points), min(_COLUMNS, width - low)), dtype=np.float32)
            has[owner[here], column[here] - low] = 1
            self.counts += (has[self.left] @ has[self.right].T).astype(np.int64)

    def links(self, percent: int) -> tuple[list[int], list[int], np.ndarray]:
        """Edges of a forest, and how many documents each point links with here."""
        near = _linked(self.counts, self.n[self.left], self.n[self.right], percent)
        degree = np.zeros(len(self.points), dtype=np.int64)
        if self.side.any():
            degree[self.left] = near @ self.copies[self.right]
            degree[self.right] = near.T @ self.copies[self.left]
            whole = np.zeros((len(self.points),) * 2, dtype=bool)
            whole[np.ix_(self.left, self.right)] = near
            near = whole | whole.T
        else:
            np.fill_diagonal(near, False)
            degree = near @ self.copies
        return *_forest(near), degree


def _compared(cells: DataFrame, percent: int) -> DataFrame:
    """(a, b, links): edges of the forests of all cells, and (a, null, links) for every point; written."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: _Cell | None = None

        def closed() -> pa.RecordBatch:
            a, b, degree = cell.links(percent)
            some = np.flatnonzero(degree)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.append(cell.points[a], cell.points[some]).astype(np.int64)),
                 pa.array(cell.points[b].tolist() + [None] * len(some), pa.int64()),
                 pa.array([None] * len(a) + degree[some].tolist(), pa.int64())],
                names=["a", "b", "links"],
            )

        for held in _by_slot(batches, "part"):
            if held[0].column("slot")[0].as_py() < 0:  # a new cell: all its points first
                if cell is not None:
                    yield closed()
                columns = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("point", "side", "n", "copies")]
                cell = _Cell(columns[0], columns[1].astype(bool), columns[2], columns[3])
            else:
                cell.add([p for b in held for p in b.column("point").to_pylist()], [v.as_buffer() for b in held for v in b.column("names")])
        if cell is not None:
            yield closed()

    keys = ["root", "low", "high"]
    laid = cells.repartition(*keys).sortWithinPartitions(*keys, "slot")
    # A number for each run of (cell, fragment), without regard to how the rows come in batches.
    laid = laid.withColumn("part", F.xxhash64(*keys, "slot"))
    return keep(laid.select("part", "slot", "point", "side", "n", "copies", "names").mapInArrow(compare, "a long, b long, links long"), "links", rows=1000)


def _cells(sets: DataFrame, clusters: DataFrame, percent: int, block: int) -> DataFrame:
    """The rows each pair of blocks needs: per cell and point a head (slot -1) and its segments."""
    placed = sets.select("point", "n").join(clusters, "point")
    laid = Ordered(placed, ["n", "point"], within=["root"]).extend(row_number="nr", running={"sum": F.col("n")})
    dealt = keep(
        laid.select("root", "point", "n", (F.floor((F.col("nr") - 1) / block) + F.floor(F.col("sum") / BLOCK_SHINGLES)).alias("own")), "blocks",
    )
    blocks = dealt.groupBy("root", "own").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    x = blocks.select("root", F.col("own").alias("low"), "most")
    y = blocks.select("root", F.col("own").alias("high"), "least")
    pairs = x.join(y, "root").where((F.col("low") <= F.col("high")) & (100 * F.col("most") >= percent * F.col("least"))).select("root", "low", "high")
    # A block once for every pair it is in; sizes grow with the block's number.
    sides = pairs.select("root", F.col("low").alias("own"), "low", "high", F.lit(False).alias("side")).unionByName(
        pairs.where("low < high").select("root", F.col("high").alias("own"), "low", "high", F.lit(True).alias("side"))
    )
    members = dealt.join(sides, ["root", "own"]).select("root", "low", "high", "side", "point")
    parts = F.concat(F.array(F.lit(None).cast("binary")), "names")  # a head, then the fragments
    whole = members.join(_recut(sets), "point").select("root", "low", "high", "side", "point", "n", "copies", F.posexplode(parts).alias("slot", "names"))
    return whole.withColumn("slot", F.col("slot").cast("long") - 1)


def similar_sets(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK,
    fragment: int = FRAGMENT,
) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, n_links (documents linked with it, copies included)."""
    source = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    letters = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(LEAST_FRAGMENTS, letters // (6 * fragment))  # some six letters to a word
    shared = shared_segments(segments(source, source.schema["id"].dataType, int(fragments), shingle))
    docs = shared.where("slot < 0").select(F.explode(F.arrays_zip("id", "point", "n")).alias("d")).select("d.id", "d.point", F.col("d.n").cast("long").alias("n"))
    shared = shared.where("slot >= 0")
    points = docs.where("n > 0").groupBy("point").agg(F.first("n").alias("n"), F.count("*").alias("copies"))
    bound = shared_counts(shared).withColumnRenamed("n", "bound")
    able = keep(points.join(bound, "point").where(100 * F.col("bound") >= percent * F.col("n")).drop("bound"), "able")
    sets = keep(
        _parted(shared).join(able, "point").groupBy("point", "n", "copies")
        .agg(F.sort_array(F.collect_list(F.struct("slot", "names", "sets"))).alias("parts")),
        "sets", rows=500,
    )
    first = keep(_first_shingles(sets, percent), "first-shingles")
    heads = first.groupBy("token").agg(F.min("point").alias("head"), F.count("*").alias("size")).where("size > 1")
    near = first.join(heads, "token").where("point <> head").select(F.col("point").alias("a"), F.col("head").alias("b")).distinct()
    found = _compared(_cells(sets, components(near), percent, block), percent)
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    degrees = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    state = points.join(roots, "point", "left").join(degrees, F.col("a") == F.col("point"), "left").select(
        "point", "copies", F.coalesce("root", "point").alias("root"), F.coalesce("links", F.lit(0)).alias("links"),
    )
    joined = docs.where("n > 0").join(state, "point")
    least = joined.groupBy("root").agg(F.min("id").alias("component"))
    full = joined.join(least, "root").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        (F.col("links") + F.col("copies") - 1).alias("n_links"),
    )
    empty = docs.where("n = 0").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"),
    )
    return full.unionByName(empty)

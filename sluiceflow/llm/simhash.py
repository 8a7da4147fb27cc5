"""SimHash near copies by anchor points of a covering code.

A fingerprint has 64 bits: a bit is 1 if more than half of the shingles' hashes
have it. Two fingerprints within 3 bits have a half (of 32 bits) within 1 bit,
and one of the four bytes of the other half is equal. The first 31 bits of a
half are covered by the perfect Hamming code (covering radius 1), whose 2^26
words are the anchors: a fingerprint goes to every anchor within radius plus
threshold, 1 + 1 = 2 bits, with each byte of the other half, and any two linked
ones meet at the anchor nearest to either. Only there are they compared.

Equal fingerprints are one point, so copies are never compared. An anchor with
more points than a task should hold is cut into blocks, and every pair of blocks
is compared by a task of its own. Each comparison reports a spanning forest of
its links, and components come from alternating star contractions on the
cluster.

A null text is an empty one; texts without words have fingerprint zero and link
like others. A null id belongs to its component; the component's id is the
smallest that is not null. Repeated rows stay, empty tables give no rows, and
only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceflow.llm import overlap_join
from sluiceflow.llm.common import extended, fresh, keep
from sluiceflow.llm.graph import components

SEED = 42
LINK_BITS = 3
SHINGLE = 3
# Points of one anchor that one task compares; more are cut into blocks of about this size.
BLOCK = 4096
_LANES = np.uint64(0x0101010101010101)


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; of all words if there are fewer."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # ASCII white space and letters only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    found = [digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    return np.array(found, dtype=np.uint64)


def majority(values: np.ndarray) -> int:
    """The bits that more than half of the values have."""
    if not len(values):
        return 0
    # Eight bits at a time are counted in the bytes of one word, up to 255 values to a sum.
    cuts = np.arange(0, len(values), 255)
    counts = np.empty(64, dtype=np.int64)
    for k in range(8):
        sums = np.add.reduceat((values >> np.uint64(k)) & _LANES, cuts)
        counts[k::8] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text_col: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """`df` with the fingerprint as a signed long."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([majority(hashes(t, shingle)) for t in batch.column(text_col).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], names=[*batch.schema.names, name])

    return df.mapInArrow(add, extended(df, **{name: "long"}))


def syndromes(halves: np.ndarray) -> np.ndarray:
    """Hamming syndrome of 31 bits: the exclusive or of the numbers (1 to 31) of the set bits."""
    out = np.zeros(len(halves), dtype=np.uint64)
    for bit in range(5):
        mask = sum(1 << (place - 1) for place in range(1, 32) if place >> bit & 1)
        out |= (np.bitwise_count(halves & np.uint64(mask)).astype(np.uint64) & np.uint64(1)) << np.uint64(bit)
    return out


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All code words within 2 bits of each 31-bit value: index of the value, and the word.

    A code word has itself alone. Any other value has the one at its syndrome's
    place and those at the 15 pairs of places whose numbers add up to it.
    """
    syndrome = syndromes(halves)
    at, words = [np.flatnonzero(syndrome == 0)], [halves[syndrome == 0]]
    off = np.flatnonzero(syndrome)
    flip = lambda place: np.uint64(1) << (place - np.uint64(1))
    at.append(off)
    words.append(halves[off] ^ flip(syndrome[off]))
    for place in range(1, 32):
        first = np.uint64(place)
        other = syndrome[off] ^ first
        ordered = other > first  # each pair once; none has place 0
        at.append(off[ordered])
        words.append(halves[off[ordered]] ^ flip(first) ^ flip(other[ordered]))
    return np.concatenate(at), np.concatenate(words)


def anchor_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the fingerprint and a 64-bit key (half, byte of the other half, its value, anchor), for all its anchors."""
    index, keys = [], []
    low, high = prints & np.uint64(0xFFFFFFFF), prints >> np.uint64(32)
    for side, (half, rest) in enumerate(((low, high), (high, low))):
        at, words = anchors(half & np.uint64(0x7FFFFFFF))
        for byte in range(4):
            value = (rest[at] >> np.uint64(8 * byte)) & np.uint64(0xFF)
            index.append(at)
            keys.append(np.uint64(side << 42 | byte << 40) | value << np.uint64(32) | words)
    return np.concatenate(index), np.concatenate(keys)


def forest(keys: np.ndarray, words: list[np.ndarray], sides: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) whose links join the components of each run of equal keys; with `sides`, only those across sides are compared.

    Two rows link if their words differ in at most `bits` bits.
    """
    n = len(keys)
    root = np.arange(n)
    a, b = [], []
    live = np.arange(n)
    for gap in range(1, n):
        live = live[live + gap < n]
        live = live[keys[live] == keys[live + gap]]
        if not len(live):
            break
        other = live + gap
        near = sum(np.bitwise_count(w[live] ^ w[other]).astype(np.int16) for w in words) <= bits
        if sides is not None:
            near &= sides[live] != sides[other]
        i, j = live[near], other[near]
        apart = root[i] != root[j]
        if not apart.any():
            continue
        parent = root.copy()

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(i[apart].tolist(), j[apart].tolist()):
            p, q = find(x), find(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                a.append(x)
                b.append(y)
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
        root = parent
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _rows(names: list[str], columns: list[np.ndarray | None]) -> pa.RecordBatch:
    size = next(len(c) for c in columns if c is not None)
    arrays = [pa.nulls(size, pa.int64()) if c is None else pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _runs(batches: Iterator[pa.RecordBatch], columns: int, block: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Complete runs of equal keys, several at a time; (True, part) for parts of a run of more than `block` rows."""
    held: list[np.ndarray] | None = None
    long_key = None
    for batch in batches:
        new = [batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(columns)]
        cols = new if held is None else [np.concatenate(pair) for pair in zip(held, new)]
        if not len(cols[0]):
            continue
        if long_key is not None:
            stop = int(np.searchsorted(cols[0] != long_key, True))
            if stop:
                yield True, [c[:stop] for c in cols]
                cols = [c[stop:] for c in cols]
            if not len(cols[0]):
                held = None
                continue
            long_key = None
        edges = np.append(np.flatnonzero(np.diff(cols[0].view(np.int64)) != 0) + 1, len(cols[0]))
        starts = np.concatenate([[0], edges[:-1]])
        sizes = edges - starts
        whole = np.arange(len(sizes)) < len(sizes) - 1
        several = np.repeat(whole & (sizes > 1) & (sizes <= block), sizes)
        if several.any():
            yield False, [c[several] for c in cols]
        for k in np.flatnonzero(whole & (sizes > block)):
            yield True, [c[starts[k] : edges[k]] for c in cols]
        held = [c[starts[-1] :] for c in cols]
        if sizes[-1] > block:
            yield True, held
            long_key, held = held[0][0], None
    if held is not None and len(held[0]) > 1:
        yield False, held


def _met(met: DataFrame, words: list[str], bits: int, block: int) -> DataFrame:
    """Links (a, b) of fingerprints in (key, fp, further words) rows with a common key and few differing bits in `words`; written.

    `words` are names among fp and the further ones.
    """
    carried = met.columns
    schema = ", ".join(f"{c} long" for c in ["a", "b", *carried])
    names = ["a", "b", *carried]
    used = [carried.index(w) for w in words]

    def linked(cols: list[np.ndarray], sides: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        i, j = forest(cols[0], [cols[k] for k in used], sides, bits)
        if len(i):
            yield _rows(names, [cols[1][i], cols[1][j], *[None] * len(carried)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for late, cols in _runs(batches, len(carried), block):
            if late:
                yield _rows(names, [None, None, *cols])
            else:
                yield from linked(cols, None)

    first = keep(met.repartition("key").sortWithinPartitions("key").mapInArrow(compare, schema), "links", rows=10_000)
    found = first.where("a IS NOT NULL").select("a", "b")
    crowded = first.where("a IS NULL").select(*carried)
    sizes = keep(crowded.groupBy("key").agg(F.count("*").alias("size")), "crowded")
    if sizes.isEmpty():
        return found
    # A row of a crowded key is in one block, and so in one pair of blocks with every block.
    blocks = F.ceil(F.col("size") / block).cast("long")
    dealt = crowded.join(sizes, "key").select(*carried, blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).alias("own"))
    pairs = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with")).select(
        F.xxhash64("key", F.least("own", "with"), F.greatest("own", "with")).alias("key"), *carried[1:],
        # Within a block all are compared; of two blocks, rows of different ones.
        F.when(F.col("own") == F.col("with"), F.lit(-1).cast("long")).otherwise(F.col("own")).alias("side"),
    )

    def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols in _runs(batches, len(carried) + 1, 1 << 62):
            within = cols[-1] == np.uint64(2**64 - 1)
            if within.any():
                yield from linked([c[within] for c in cols], None)
            if not within.all():
                across = [c[~within] for c in cols]
                yield from linked(across, across[-1])

    second = pairs.repartition("key").sortWithinPartitions("key").mapInArrow(compare_blocks, schema)
    return found.unionByName(keep(second, "block-links", rows=10_000).select("a", "b"))


def links(points: DataFrame, bits: int = LINK_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join the components of the distinct fingerprints in column `fp`; written."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            index, keys = anchor_keys(prints)
            yield _rows(["key", "fp"], [keys, prints[index]])

    return _met(points.select("fp").mapInArrow(replicate, "key long, fp long"), ["fp"], bits, block)


def component_of(prints: DataFrame, bits: int = LINK_BITS, block: int = BLOCK) -> DataFrame:
    """(fp, component) for the distinct fingerprints of (fp, id) rows: the smallest id reachable."""
    points = keep(prints.groupBy("fp").agg(F.min("id").alias("id")), "points")
    roots = components(links(points, bits, block))
    joined = points.join(roots.withColumnRenamed("point", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    grouped = joined.groupBy("root").agg(F.min("id").alias("component"))
    return joined.join(grouped, "root").select("fp", "component")


def hex_of(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = LINK_BITS, block: int = BLOCK,
) -> DataFrame:
    """A row per document: doc_id, fingerprint, component_id."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = keep(with_fingerprint(source, "text", "fp", shingle).select("id", "fp"), "fingerprints")
    return prints.join(component_of(prints, bits, block), "fp").select(
        F.col("id").alias("doc_id"), hex_of(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"),
    )


def text_key(text: str | None) -> int:
    """A 64-bit name of the sequence of words, on which all shingles depend."""
    import xxhash

    return xxhash.xxh64_intdigest(b" ".join((text or "").encode("utf-8", "replace").lower().split()), SEED + 1)


def with_prints(df: DataFrame, text_col: str, fp: str, point: str, shingle: int = SHINGLE) -> DataFrame:
    """`df` with the fingerprint and the text's key."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            found = [np.array([f(t) for t in texts], dtype=np.uint64) for f in (lambda t: majority(hashes(t, shingle)), text_key)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v.view(np.int64)) for v in found]], names=[*batch.schema.names, fp, point])

    return df.mapInArrow(add, extended(df, **{fp: "long", point: "long"}))


def print_links(points: DataFrame, bits: int = LINK_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join the (point, fp) rows with close fingerprints; points of one fingerprint link to the smallest of them."""
    heads = keep(points.groupBy("fp").agg(F.min("point").alias("head")), "heads")
    a, b = (heads.select(F.col("fp").alias(side), F.col("head").alias(f"head_{side}")) for side in "ab")
    across = links(heads, bits, block).join(a, "a").join(b, "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    within = points.join(heads, "fp").where("point <> head").select(F.col("point").alias("a"), F.col("head").alias("b"))
    return keep(across.unionByName(within), "print-links")


def one_of_each(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = LINK_BITS, block: int = BLOCK,
    similarity: float | None = None,
) -> DataFrame:
    """`df` with one row of each component: that of the smallest id, nulls last; of equal ones the first written.

    With a `similarity`, in whole hundredths, texts also link when the sets of their five-word shingles have that Jaccard
    similarity or more; the sets are compared exactly (`overlap_join`).
    """
    fp, row, least, point = (fresh(df, name) for name in ("fp", "row", "least", "point"))
    # Written with row numbers, which then stay as they are.
    marked = keep(with_prints(df, text_col, fp, point, shingle).withColumn(row, F.monotonically_increasing_id()), "marked")
    # Numbered by (id, row): a component's smallest pair is the row that stays.
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row")).alias("id")
    # Different texts are points of their own, also where their fingerprints are equal.
    ids = marked.select(F.col(point).alias("point"), F.col(fp).alias("fp"), first)
    points = keep(ids.groupBy("point").agg(F.min("id").alias("id"), F.min("fp").alias("fp")), "points")
    edges = print_links(points, bits, block)
    if similarity is not None:
        similar = overlap_join.similar_sets(marked.select(F.col(point).alias("doc_id"), F.col(text_col).alias("text")), percent=round(100 * similarity))
        alike = similar.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        edges = edges.unionByName(alike)
    joined = points.select("point", "id").join(components(edges), "point", "left")
    stay = joined.groupBy(F.coalesce("root", "point").alias("root")).agg(F.min("id").alias("id")).select(F.col("id.row").alias(least))
    return marked.join(stay, F.col(row) == F.col(least), "left_semi").select(*df.columns)

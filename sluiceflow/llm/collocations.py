"""Phrase collocations by weighted acyclic automata.

A shard's n-grams, in order, make a count transducer: every n-gram adds the
states below the longest common prefix with its predecessor, and a state's
weight is the number of occurrences that pass it. Transducers are cut into
prefix ranges by a phrase's first two words, so that a frequent first word
alone is no range, and those of all shards are united per range by summing
weights. Counts of a phrase's parts are found by composing: a part goes to the
range of its own first words and walks that range's transducer.

Only phrases of frequent words and then of frequent pairs can be frequent, so
three passes count words, pairs, and phrases of three and four. What is frequent
reaches the shards as a bit filter of fixed size; where it lets through others,
these are counted and fall short of the limit like any. Words are named by 64
bits of (language, word); languages never meet.

A null text is empty, a null language `und`. Repeated rows count again; ties are
broken by the phrase's bytes. Empty tables give no rows, and only the two named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceflow.llm import words
from sluiceflow.llm.common import keep
from sluiceflow.llm.overlap_join import _by_slot
from sluiceflow.session import spread

LONGEST = 4
LEAST, WITHIN, TOP = 30, 80, 2000
SCALE = 2_000_000
# Word occurrences of a shard, about.
SHARD = 2**19
# Bytes of transducers of a batch that a task sends on.
SENT = 2**21
# Documents of an Arrow batch; the arrays over a batch's letters are what a task holds.
BATCH = 250
FILTER_BITS = 26
# Letters of text to a prefix range, about; copies of a range among which its look-ups are dealt.
RANGE_LETTERS, SALTS = 2**22, 8
_KINDS = words.byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
_ENDED = np.uint64(0)


class Transducer:
    """Weighted n-grams as a trie in levels: labels and numbers of children in order, weights per state.

    A label of zero ends an n-gram that is shorter than the trie is deep.
    """

    def __init__(self, labels: list[np.ndarray], children: list[np.ndarray], weights: list[np.ndarray]):
        self.labels, self.children, self.weights = labels, children, weights

    @classmethod
    def of_sorted(cls, columns: list[np.ndarray], counts: np.ndarray) -> Transducer:
        """From n-grams in order, equal ones next to each other."""
        labels, children, weights = [], [], []
        leaves = np.ones(len(counts), dtype=bool)
        above = np.zeros(len(counts), dtype=bool)
        above[:1] = True
        starts = []
        for column in columns:
            # A state begins where the path leaves that of the n-gram before.
            above = above.copy()
            above[1:] |= column[1:] != column[:-1]
            starts.append(np.flatnonzero(above & leaves))
            labels.append(column[starts[-1]])
            weights.append(np.add.reduceat(counts, starts[-1]) if len(counts) else counts)
        for upper, lower in zip(starts[:-1], starts[1:]):
            children.append(np.diff(np.append(np.searchsorted(lower, upper), len(lower))))
        return cls(labels, children, weights)

    @classmethod
    def of(cls, columns: list[np.ndarray], counts: np.ndarray | None = None) -> Transducer:
        order = np.lexsort(columns[::-1])
        counts = np.ones(len(order), dtype=np.int64) if counts is None else counts
        return cls.of_sorted([c[order] for c in columns], counts[order])

    @classmethod
    def union(cls, parts: list[Transducer]) -> Transducer:
        """Of tries of one depth; weights are summed."""
        rows = [p.rows() for p in parts]
        return cls.of([np.concatenate([r[0][k] for r in rows]) for k in range(len(rows[0][0]))], np.concatenate([r[1] for r in rows]))

    def rows(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The n-grams, one column for each place, and their weights."""
        columns = [self.labels[-1]]
        spread_out = np.ones(len(self.labels[-1]), dtype=np.int64)
        for level in range(len(self.children) - 1, -1, -1):
            sizes = np.add.reduceat(spread_out, np.cumsum(self.children[level]) - self.children[level]) if len(spread_out) else spread_out
            columns.insert(0, np.repeat(self.labels[level], sizes))
            spread_out = sizes
        return columns, self.weights[-1]

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.labels), *map(len, self.labels)], dtype=np.int64)
        parts = [sizes, *self.labels, *[c.astype(np.uint32) for c in self.children], self.weights[-1].astype(np.int64)]
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def of_bytes(cls, data: pa.Buffer) -> Transducer:
        data = memoryview(data)
        depth = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, depth, 8).tolist()
        at = 8 + 8 * depth
        labels, children = [], []
        for size in sizes:
            labels.append(np.frombuffer(data, np.uint64, size, at))
            at += 8 * size
        for size in sizes[:-1]:
            children.append(np.frombuffer(data, np.uint32, size, at).astype(np.int64))
            at += 4 * size
        weights = [np.frombuffer(data, np.int64, sizes[-1], at)]
        for level in range(depth - 2, -1, -1):
            first = np.cumsum(children[level]) - children[level]
            weights.insert(0, np.add.reduceat(weights[0], first) if len(first) else weights[0][:0])
        return cls(labels, children, weights)

    def find(self, columns: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """Weights of the states at the end of some paths, `sizes` long; 0 where there is none."""
        low = np.zeros(len(sizes), dtype=np.int64)
        high = np.full(len(sizes), len(self.labels[0]), dtype=np.int64)
        out = np.zeros(len(sizes), dtype=np.int64)
        live = np.arange(len(sizes))
        for level, labels in enumerate(self.labels):
            live = live[sizes[live] > level]
            if not len(live):
                break
            a, b, wanted = low[live], high[live], columns[level][live]
            while (a < b).any():  # all binary searches side by side
                middle = (a + b) >> 1
                less = (a < b) & (labels[np.minimum(middle, len(labels) - 1)] < wanted)
                a, b = np.where(less, middle + 1, a), np.where(less, b, np.minimum(b, np.maximum(middle, a)))
            hit = (a < high[live]) & (labels[np.minimum(a, len(labels) - 1)] == wanted)
            live, a = live[hit], a[hit]
            ends = sizes[live] == level + 1
            out[live[ends]] = self.weights[level][a[ends]]
            if level < len(self.children):
                until = np.cumsum(self.children[level])
                high[live], low[live] = until[a], until[a] - self.children[level][a]
        return out


def named_words(batch: pa.RecordBatch) -> tuple[words.Words, np.ndarray, np.ndarray]:
    """The words of a batch's texts, their 64-bit names by language, and the language of each."""
    import xxhash

    found = words.split(batch.column("text"), _KINDS)
    langs = batch.column("lang").dictionary_encode()
    seeds = np.array([xxhash.xxh64_intdigest(v, 42) for v in langs.dictionary.to_pylist()], dtype=np.uint64)
    lang = langs.indices.to_numpy()[found.text]
    return found, words.chained([words.names(found.distinct)[found.ids], seeds[lang]]) if len(lang) else np.zeros(0, np.uint64), lang


def word_counts(df: DataFrame) -> DataFrame:
    """(name, lang, word, f) of all words of (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, named, lang = named_words(batch)
            keys = lang.astype(np.int64) * max(len(found.distinct), 1) + found.ids
            _, first, counts = np.unique(keys, return_index=True, return_counts=True)
            langs = batch.column("lang").dictionary_encode().dictionary
            yield pa.RecordBatch.from_arrays(
                [pa.array(named[first].view(np.int64)), langs.take(pa.array(lang[first])),
                 found.distinct.cast(pa.large_string()).cast(pa.string()).take(pa.array(found.ids[first])), pa.array(counts)],
                names=["name", "lang", "word", "f"],
            )

    return df.mapInArrow(count, "name long, lang string, word string, f long").groupBy("lang", "word").agg(F.first("name").alias("name"), F.sum("f").alias("f"))


def bit_filter(names: DataFrame, bits: int = FILTER_BITS) -> Broadcast:
    """The first bits of all names, as a bitmap of 2 ** bits; its size does not depend on their number."""
    place = F.shiftrightunsigned("name", 64 - bits)
    masks = names.groupBy(F.shiftright(place, 6).alias("block")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(name, {64 - bits}) & 63 as int))")).alias("mask"))
    rows = masks.toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[rows.column("block").to_numpy()] = rows.column("mask").to_numpy()
    return names.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def passes(bitmap: np.ndarray, names: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    place = names >> np.uint64(64 - bits)
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _slots(columns: list[np.ndarray], bits: int) -> np.ndarray:
    return (words.chained(columns[:2]) >> np.uint64(64 - bits)).astype(np.int64)


def phrase_counts(df: DataFrame, depth: int, frequent: Broadcast, pairs: Broadcast | None, bits: int, least: int, shard: int) -> DataFrame:
    """(slot, transducer) of each prefix range, of phrases of two words, or of three with a fourth where it follows; rare ones are left out."""

    def windows(batch: pa.RecordBatch) -> list[np.ndarray]:
        found, named, _ = named_words(batch)
        n = len(named)
        if n < 2:
            return [np.zeros(0, np.uint64)] * depth
        good = passes(frequent.value, named)
        joined = (found.piece[1:] == found.piece[:-1]) & good[1:] & good[:-1]
        if depth == 2:
            at = np.flatnonzero(joined)
            return [named[at], named[at + 1]]
        at = np.flatnonzero(joined)
        joined[at] = passes(pairs.value, words.chained([named[at], named[at + 1]]))
        at = np.flatnonzero(joined[:-1] & joined[1:])
        # The fourth word where its pair goes on.
        more = np.append(joined, False)[at + 2]
        return [named[at], named[at + 1], named[at + 2], np.where(more, named[np.minimum(at + 3, n - 1)], _ENDED)]

    def ranged(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate([p[k] for p in parts]) for k in range(depth)]
        parts.clear()
        slots = _slots(columns, bits)
        order = np.argsort(slots, kind="stable")
        slots = slots[order]
        edges = [*np.flatnonzero(np.append(True, slots[1:] != slots[:-1])).tolist(), len(slots)] if len(slots) else []
        made, first, size = [], 0, 0
        # A range is put in order and sent on by itself, so that neither a sorted copy of the shard nor one row of all its bytes is held.
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]), 1):
            made.append(Transducer.of([c[order[a:b]] for c in columns]).to_bytes())
            size += len(made[-1])
            if size >= SENT or k == len(edges) - 1:
                yield pa.RecordBatch.from_arrays([pa.array(slots[edges[first:k]]), pa.array(made, pa.binary())], names=["slot", "counts"])
                made, first, size = [], k, 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(windows(batch))
            size += len(held[-1][0])
            if size >= shard:
                yield from ranged(held)
                held, size = [], 0
        if held:
            yield from ranged(held)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_slot(batches, "slot"):
            whole = Transducer.union([Transducer.of_bytes(v.as_buffer()) for b in held for v in b.column("counts")])
            columns, counts = whole.rows()
            if depth > 2:
                # The first three words count with any fourth; a rare fourth is one end for all.
                above = np.repeat(whole.weights[-2], whole.children[-1])
                last = np.where(counts >= least, columns[-1], _ENDED)
                columns, counts = [c[above >= least] for c in [*columns[:-1], last]], counts[above >= least]
            else:
                columns, counts = [c[counts >= least] for c in columns], counts[counts >= least]
            if len(counts):
                yield pa.RecordBatch.from_arrays(
                    [held[0].column("slot").slice(0, 1), pa.array([Transducer.of(columns, counts).to_bytes()], pa.binary())], names=["slot", "counts"],
                )

    cut = df.mapInArrow(build, "slot long, counts binary")
    return keep(cut.repartition("slot").sortWithinPartitions("slot").mapInArrow(unite, "slot long, counts binary"), "transducers", rows=BATCH)


def phrases(transducers: DataFrame, depth: int) -> DataFrame:
    """(w1, w2, w3, w4, size, f) of all states that a range's transducers accept."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("counts"):
                t = Transducer.of_bytes(data.as_buffer())
                if depth == 2:
                    columns, counts = t.rows()
                    sizes = np.full(len(counts), 2)
                else:
                    columns, counts = t.rows()
                    fourth = columns[3] != _ENDED
                    first = np.cumsum(t.children[-1]) - t.children[-1]
                    columns = [np.append(c[first], c[fourth]) for c in columns[:3]] + [np.append(np.zeros(len(first), np.uint64), columns[3][fourth])]
                    sizes = np.append(np.full(len(first), 3), np.full(int(fourth.sum()), 4))
                    counts = np.append(t.weights[-2], counts[fourth])
                columns = [*columns, *[np.zeros(len(counts), np.uint64)] * (LONGEST - len(columns))]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c.view(np.int64)) for c in columns], pa.array(sizes.astype(np.int64)), pa.array(counts)],
                    names=["w1", "w2", "w3", "w4", "size", "f"],
                )

    return transducers.select("counts").mapInArrow(listed, "w1 long, w2 long, w3 long, w4 long, size long, f long")


def pair_names(transducers: DataFrame) -> DataFrame:
    """(name) of the pairs in transducers of two words; read from them at once, as a second Python function in a stage doubles the workers that executors keep."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("counts"):
                columns, _ = Transducer.of_bytes(data.as_buffer()).rows()
                yield pa.RecordBatch.from_arrays([pa.array(words.chained(columns).view(np.int64))], names=["name"])

    return transducers.select("counts").mapInArrow(named, "name long")


_PLACES = ["w1", "w2", "w3", "w4"]


def _part(places: list[str]) -> Column:
    """The words at some places, moved to the front."""
    return F.array(*[F.col(p) for p in places], *[F.lit(0).cast("long")] * (LONGEST - len(places)))


def part_counts(candidates: DataFrame, transducers: DataFrame, bits: int) -> DataFrame:
    """`candidates` with (k, l, r) per cut: the counts of the first k words and of the rest, by walking the transducers of their ranges.

    `transducers` has (depth, slot, counts), single words among them with depth 1.
    """
    asked = []
    for size in range(2, LONGEST + 1):
        for k in range(1, size):
            for side, places in ((0, _PLACES[:k]), (1, _PLACES[k:size])):
                asked.append((size, F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), F.lit(len(places)).alias("words"), _part(places).alias("part"))))
    queries = candidates.select(
        *_PLACES, "size", "f", F.explode(F.filter(F.array(*[F.when(F.col("size") == size, s) for size, s in asked]), lambda s: s.isNotNull())).alias("q")
    ).select(*_PLACES, "size", "f", "q.*")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part").flatten().to_numpy().view(np.uint64).reshape(-1, LONGEST)
            slots = _slots([parts[:, 0], parts[:, 1]], bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slots)], names=[*batch.schema.names, "slot"])

    fields = "w1 long, w2 long, w3 long, w4 long, size long, f long, k int, side int, words int, part array<bigint>, slot long"
    # Pairs and longer phrases are in transducers of their own, as are single words.
    depth = F.when(F.col("words") > 2, LONGEST).otherwise(F.col("words")).cast("int")
    salted = queries.mapInArrow(route, fields).select("*", depth.alias("depth"), F.pmod(F.xxhash64(*_PLACES), F.lit(SALTS)).alias("salt"), F.lit(None).cast("binary").alias("counts"))
    copies = transducers.select("depth", "slot", "counts", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    both = salted.unionByName(copies, allowMissingColumns=True).repartition("depth", "slot", "salt").sortWithinPartitions("depth", "slot", "salt", F.col("counts").isNull())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Transducer | None = None
        for batch in batches:
            heads = np.flatnonzero(batch.column("counts").is_valid().to_numpy(zero_copy_only=False)).tolist()
            for a, b in zip([-1, *heads], [*heads, batch.num_rows]):
                if a >= 0:
                    held = Transducer.of_bytes(batch.column("counts")[a].as_buffer())
                part = batch.slice(a + 1, b - a - 1)
                if not part.num_rows:
                    continue
                paths = part.column("part").flatten().to_numpy().view(np.uint64).reshape(-1, LONGEST)
                counts = held.find([paths[:, c] for c in range(LONGEST)], part.column("words").to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in (*_PLACES, "size", "f", "k", "side")], pa.array(counts)], names=[*_PLACES, "size", "f", "k", "side", "count"],
                )

    found = both.mapInArrow(walk, "w1 long, w2 long, w3 long, w4 long, size long, f long, k int, side int, count long")
    cuts = found.groupBy(*_PLACES, "size", "f", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("count"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("count"))).alias("r"),
    )
    return cuts


def _word_transducers(frequent: DataFrame, bits: int) -> DataFrame:
    """(slot, counts) over single words."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column("name").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_slots([named, np.zeros(len(named), np.uint64)], bits)), *batch.columns], names=["slot", "name", "f"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_slot(batches, "slot"):
            named, counts = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("name", "f"))
            made = Transducer.of([named.view(np.uint64)], counts).to_bytes()
            yield pa.RecordBatch.from_arrays([held[0].column("slot").slice(0, 1), pa.array([made], pa.binary())], names=["slot", "counts"])

    placed = frequent.select("name", "f").mapInArrow(place, "slot long, name long, f long")
    return placed.repartition("slot").sortWithinPartitions("slot").mapInArrow(build, "slot long, counts binary")


def collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, within: int = WITHIN, top: int = TOP, shard: int = SHARD,
    range_letters: int = RANGE_LETTERS,
) -> DataFrame:
    """A row per language and rank: lang, rank, phrase, a, l, r, n, score."""
    source = spread(df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")))
    letters = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(letters // range_letters).bit_length())
    counts = keep(word_counts(source), "word-counts", rows=BATCH)
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counts.where(F.col("f") >= least)
    in_words = bit_filter(frequent)
    pairs = phrase_counts(source, 2, in_words, None, bits, least, shard)
    two = phrases(pairs, 2)
    in_pairs = bit_filter(pair_names(pairs))
    longer = phrase_counts(source, LONGEST, in_words, in_pairs, bits, least, shard)
    candidates = keep(two.unionByName(phrases(longer, LONGEST)), "phrases")
    ranges = (
        _word_transducers(frequent, bits).withColumn("depth", F.lit(1))
        .unionByName(pairs.withColumn("depth", F.lit(2))).unionByName(longer.withColumn("depth", F.lit(LONGEST)))
    )
    cuts = part_counts(candidates, ranges, bits)
    exact = F.expr(f"cast({SCALE} as decimal(10,0)) * cast(f as decimal(20,0)) div cast(l + r as decimal(20,0))")
    scored = cuts.withColumn("score", exact).groupBy(*_PLACES, "size", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = [
        F.when(F.col("size") >= at + size, F.struct(F.lit(size).cast("long").alias("size"), _part(_PLACES[at : at + size]).alias("part")))
        for size in (2, 3) for at in range(LONGEST - size + 1)
    ]
    # A part shorter than its phrase, with the most frequent phrase around it.
    around = (
        candidates.where("size > 2").select("f", "size", F.explode(F.filter(F.array(*inner), lambda s: s.isNotNull())).alias("s"))
        .where("s.size < size").groupBy(*[F.col("s.part")[i].alias(w) for i, w in enumerate(_PLACES)]).agg(F.max("f").alias("around"))
    )
    stay = scored.join(around, _PLACES, "left").where(F.col("around").isNull() | (100 * F.col("around") < within * F.col("f")))
    stay = keep(stay.select(*_PLACES, "size", "f", "cut.score", "cut.l", "cut.r"), "scored")
    for place in _PLACES:
        named = frequent.select(F.col("name").alias(place), F.col("word").alias(f"text_{place}"), *([F.col("lang")] if place == "w1" else []))
        stay = stay.join(named, place, "inner" if place == "w1" else "left")
    spelled = stay.select("lang", F.concat_ws(" ", *[f"text_{p}" for p in _PLACES]).alias("phrase"), F.col("f").alias("a"), "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of every share first, so that no language is ranked in one task.
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = spelled.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top).drop("rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

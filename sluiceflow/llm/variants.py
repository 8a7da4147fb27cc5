"""Spelling variants: words one inserted, deleted or replaced letter apart, by pairs of trie nodes.

Words in order give the forward trie: a word adds the nodes below its longest
common prefix with its predecessor, numbered as they come. Words in order of
their reversed letters give the reversed trie. A word without its letter i is
the pair (prefix node i, suffix node i + 1), a word cut before letter i the
pair (prefix node i, suffix node i). Equal pairs of the first kind differ by a
replaced letter, equal pairs of both kinds by an inserted one; of a run of equal
letters only the first counts as inserted, so every such pair of words meets
once. Nodes that one word alone goes through cannot meet and are left out: a
word's common prefixes with its two neighbours in the order tell.

Tries are numbered by range partitions: each numbers its own nodes, and one row
per partition (first word, last word and the last word's nodes) tells which
nodes of its first word exist already. A pair has as many words as there are
letters, at most, so no group is large.

A null text has no words; a null id counts as the empty string in the digest
that picks deletions. Repeated rows count again. Ties between near words go to
the smallest in code-point order. Empty tables give no rows, and only the two
named columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceflow.llm import words
from sluiceflow.llm.common import keep
from sluiceflow.session import spread

LEAST_LETTERS, LEAST_COUNT = 7, 2
# A word is a variant of a near one that is FACTOR times as frequent.
FACTOR = 10
# One run in so many of a document loses a letter.
DELETED = 31


def letters_of(distinct: pa.Array) -> np.ndarray:
    """Code points of each of some UTF-8 words."""
    offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    data = np.frombuffer(distinct.buffers()[2], np.uint8) if distinct.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.diff(np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets])


def word_counts(df: DataFrame, least: int, deleted: int) -> DataFrame:
    """(word, n) of runs of letters in `text`, with a letter taken out where the digest of (id, run) says so."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words.split(batch.column("text"), None)
            distinct = found.distinct.to_pylist()
            long = letters_of(found.distinct) >= least
            stay = long[found.ids]
            # Runs of a document are equal in the digest, so each counts once with its number.
            pairs, times = np.unique(found.text[stay] * max(len(distinct), 1) + found.ids[stay], return_counts=True)
            of, which = np.divmod(pairs, max(len(distinct), 1))
            starts = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column("id").to_pylist()]
            crc32 = zlib.crc32
            digests = np.fromiter((crc32(distinct[w], starts[d]) for d, w in zip(of.tolist(), which.tolist())), np.int64, len(pairs))
            cut = digests % deleted == 0
            counts = np.bincount(which[~cut], weights=times[~cut], minlength=len(distinct)).astype(np.int64)
            out: Counter[str] = Counter()
            for w, digest, n in zip(which[cut].tolist(), digests[cut].tolist(), times[cut].tolist()):
                word = distinct[w].decode()
                at = digest % len(word)
                if len(word) > least:
                    out[word[:at] + word[at + 1 :]] += n
            some = np.flatnonzero(counts)
            whole = found.distinct.cast(pa.large_string()).take(pa.array(some)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([whole, pa.array(out.keys(), pa.string())]), pa.array(np.append(counts[some], list(out.values())).astype(np.int64))],
                names=["word", "n"],
            )

    return df.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    return sum(1 for _ in takewhile(lambda pair: pair[0] == pair[1], zip(a, b)))


def numbered_nodes(df: DataFrame, key: str, nodes: str, rank: str) -> DataFrame:
    """`df`, whose column `key` has no word twice, with the word's place in the order and the trie's nodes on its way.

    `nodes` has those below the root as far as another word shares them; written.
    """
    columns = df.columns
    inner = keep(
        _locally(df.repartitionByRange(key).sortWithinPartitions(key), key, nodes, rank), "trie",
    )
    # One row per partition: its ends, and how far its own numbers go.
    ends = inner.where("first OR last").select("piece", "first", "last", key, nodes, rank, "made").orderBy("piece", rank).collect()
    pieces: dict[int, tuple] = {}
    base, before, stack, previous, last_word = 1, 0, [], None, ""
    for row in ends:
        if row["first"]:
            shared = common(last_word, row[key]) if previous is not None else 0
            carried = stack[:shared]
            pieces[row["piece"]] = [base, before, carried, 0]
            if previous is not None:
                pieces[previous][3] = shared
        if row["last"]:
            stack = [carried[x] if x < len(carried) else base + x for x in row[nodes]]
            base, before = base + row["made"], before + row[rank] + 1
            previous, last_word = row["piece"], row[key]

    def globally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            piece = batch.column("piece").to_numpy()
            lists, ranks = batch.column(nodes), batch.column(rank).to_numpy() + np.array([pieces[p][1] for p in piece.tolist()])
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            # Only the ends of a partition have more than is shared within it.
            first, last, inside = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "last", "inside"))
            wanted = sizes.copy()
            for k in np.flatnonzero(first | last).tolist():
                _, _, carried, after = pieces[piece[k]]
                wanted[k] = max(inside[k], len(carried) if first[k] else 0, after if last[k] else 0)
            values = lists.flatten().to_numpy()
            at = np.repeat(piece, sizes)
            out = values + np.array([pieces[p][0] for p in piece.tolist()]).repeat(sizes)
            for p in np.unique(piece).tolist():
                carried = np.array(pieces[p][2], dtype=np.int64)
                if len(carried):
                    old = (at == p) & (values < len(carried))
                    out[old] = carried[values[old]]
            depth = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out = out[depth < np.repeat(wanted, sizes)]
            kept = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(wanted)), pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], kept, pa.array(ranks)], names=[*columns, nodes, rank])

    schema = inner.select(*columns, nodes, rank).schema
    return inner.mapInArrow(globally, schema)


def _locally(df: DataFrame, key: str, nodes: str, rank: str) -> DataFrame:
    """Nodes and places as counted within each partition of `df`, which is in order."""
    columns = df.columns
    schema = df.schema.simpleString()[len("struct<") : -1]
    added = f"{nodes}: array<bigint>, {rank}: bigint, piece: bigint, first: boolean, last: boolean, inside: bigint, made: bigint"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        stack: list[int] = []
        made = place = above = 0
        held: tuple[pa.RecordBatch, list[str]] | None = None

        def done(batch: pa.RecordBatch, keys: list[str], after: str | None) -> pa.RecordBatch:
            nonlocal stack, made, place, above
            lists, inside, makes = [], [], []
            begin = place
            for word, following in zip(keys, [*keys[1:], after]):
                del stack[above:]
                stack.extend(range(made, made + len(word) - above))
                made += len(word) - above
                below = common(word, following) if following is not None else 0
                shared = max(above, below)
                inside.append(shared)
                lists.append(stack[:] if place == 0 or following is None else stack[:shared])
                makes.append(made)
                above, place = below, place + 1
            size = len(keys)
            first, last = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
            first[0], last[-1] = begin == 0, after is None
            more = [
                pa.array(lists, pa.list_(pa.int64())), pa.array(np.arange(begin, place)), pa.array(np.full(size, piece)),
                pa.array(first), pa.array(last), pa.array(inside, pa.int64()), pa.array(makes, pa.int64()),
            ]
            return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, nodes, rank, "piece", "first", "last", "inside", "made"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_pylist()
            if held is not None:
                yield done(*held, keys[0])
            held = batch, keys
        if held is not None:
            yield done(*held, None)

    return df.mapInArrow(number, f"{schema}, {added}")


WHOLE, SKIPPED, FIRST_SKIPPED = 0, 1, 2


def node_pairs(tries: DataFrame) -> DataFrame:
    """(p, s, rank, n, kind): the pairs of nodes of each of (word, n, rank, prefixes, suffixes)."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, s, kinds, counts = [], [], [], []
            for word, front, back in zip(*(batch.column(c).to_pylist() for c in ("word", "prefixes", "suffixes"))):
                size, ahead, behind = len(word), [0, *front], [0, *back]
                low, high = max(0, size - len(behind)), min(size, len(ahead))
                skipped = range(low, high)  # prefix node i and suffix node i + 1 are both shared
                whole = range(low + (size >= len(behind)), min(size + 1, high + (size < len(ahead))))
                p += [ahead[i] for i in skipped] + [ahead[i] for i in whole]
                s += [behind[size - 1 - i] for i in skipped] + [behind[size - i] for i in whole]
                kinds += [SKIPPED if i and word[i] == word[i - 1] else FIRST_SKIPPED for i in skipped] + [WHOLE] * len(whole)
                counts.append(len(skipped) + len(whole))
            more = [pa.array(np.repeat(batch.column(c).to_numpy(), counts)) for c in ("rank", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(s, pa.int64()), *more, pa.array(kinds, pa.int8())], names=["p", "s", "rank", "n", "kind"])

    return tries.select("word", "n", "rank", "prefixes", "suffixes").mapInArrow(pairs, "p long, s long, rank long, n long, kind byte")


def near_words(pairs: DataFrame) -> DataFrame:
    """(rank, n_near, best): how many words are near, and the (count, -rank) of the most frequent of them."""

    def beside(group, m):
        def linked(o):
            replaced = (o["kind"] != WHOLE) & (m["kind"] != WHOLE) & (o["rank"] != m["rank"])
            return replaced | ((o["kind"] == WHOLE) & (m["kind"] == FIRST_SKIPPED)) | ((o["kind"] == FIRST_SKIPPED) & (m["kind"] == WHOLE))

        return F.transform(F.filter(group, linked), lambda o: F.struct(o["n"].alias("n"), (-o["rank"]).alias("order")))

    groups = pairs.groupBy("p", "s").agg(F.collect_list(F.struct("rank", "n", "kind")).alias("g")).where(F.size("g") > 1)
    each = groups.select(F.explode(F.transform("g", lambda m: F.struct(m["rank"].alias("rank"), beside(F.col("g"), m).alias("near")))).alias("m"))
    return (
        each.where(F.size("m.near") > 0).select("m.rank", F.size("m.near").alias("size"), F.array_max("m.near").alias("best"))
        .groupBy("rank").agg(F.sum("size").alias("n_near"), F.max("best").alias("best"))
    )


def last_of(forms: DataFrame) -> DataFrame:
    """(rank, up) with `up` followed to the end of the chain; chains have no cycles, as counts grow along them."""
    while True:
        on = forms.select(F.col("rank").alias("up"), F.col("up").alias("next"))
        forms = keep(forms.join(on, "up", "left").select("rank", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "chains")
        if forms.where("moved").isEmpty():
            return forms.select("rank", "up")
        forms = forms.select("rank", "up")


def grouped(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
    factor: int = FACTOR, deleted: int = DELETED,
) -> DataFrame:
    """A row per word: word, form (the near word it is a variant of), root, n, n_near, form_n."""
    source = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    counts = keep(word_counts(source, least_letters, deleted).where(F.col("n") >= least_count), "words")
    forward = numbered_nodes(counts, "word", "prefixes", "rank")
    tries = keep(numbered_nodes(forward.withColumn("drow", F.reverse("word")), "drow", "suffixes", "back").drop("drow", "back"), "tries")
    vocabulary = tries.select("rank", "word", "n")
    near = keep(near_words(node_pairs(tries)), "near")
    known = keep(
        vocabulary.join(near, "rank", "left").select(
            "rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("best.n") >= factor * F.col("n"), F.col("best")).alias("best"),
        ),
        "variants",
    )
    forms = known.where("best IS NOT NULL").select("rank", (-F.col("best.order")).alias("up"))
    named = last_of(forms).join(vocabulary.select(F.col("rank").alias("up"), F.col("word").alias("root")), "up").select("rank", "root")
    named = named.join(
        forms.join(vocabulary.select(F.col("rank").alias("up"), F.col("word").alias("form")), "up").select("rank", "form"), "rank"
    )
    return known.join(named, "rank", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("best.n").alias("form_n"),
    )

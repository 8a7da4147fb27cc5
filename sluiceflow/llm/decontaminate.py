"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of ASCII letters (in lower case), digits and characters beyond
ASCII. A window is `window` consecutive words of an item; a shorter item that
has words is one window. Training words stream through the automaton, which
keeps the longest match that ends at each word; a word inside an occurrence of
a window is hit.

Null texts have no words; null item ids are left out of the item lists, their
words still hit. Repeated items count once by id. An empty benchmark hits
nothing. Document rows stay rows, repeated or not, whatever further columns
they have.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceflow.llm.common import extended, fresh, keep

WINDOW = 10
# Item words in one automaton (some 300 bytes each). More items make more automata, which documents
# pass one after the other.
SHARD_WORDS = 400_000
_DELIMITERS = bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123))
_WORDS = bytes.maketrans(
    _DELIMITERS + bytes(range(65, 91)), b" " * len(_DELIMITERS) + bytes(range(97, 123)),
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


class Automaton:
    """Suffix automaton of several word sequences, built word by word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, words in coded:
            last = 0
            for word in words:
                last = self._extend(last, word)
        # Items by the state whose strings include the window, and by window length for short items.
        self.marks: dict[int, dict[int, set[str]]] = {}
        for name, words in coded:
            size = min(window, len(words))
            state, matched = 0, 0
            for word in words:
                state, matched = self.step(state, matched, word)
                if matched >= size:
                    at = self._holding(state, size)
                    self.marks.setdefault(at, {}).setdefault(size, set()).add(name)
        self.shortest = min((size for sizes in self.marks.values() for size in sizes), default=0)
        self.above: dict[int, tuple[tuple[int, frozenset[str]], ...]] = {}

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(word)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._split(last, word, known)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state != -1 and word not in nxt[state]:
            nxt[state][word] = new
            state = link[state]
        if state != -1:
            target = nxt[state][word]
            link[new] = target if length[target] == length[state] + 1 else self._split(state, word, target)
        return new

    def _split(self, state: int, word: int, target: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[target]))
        length.append(length[state] + 1)
        link.append(link[target])
        link[target] = clone
        while state != -1 and nxt[state].get(word) == target:
            nxt[state][word] = clone
            state = link[state]
        return clone

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        nxt = self.next
        while word not in nxt[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            matched = self.length[state]
        return nxt[state][word], matched + 1

    def _holding(self, state: int, size: int) -> int:
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _marked(self, state: int) -> tuple[tuple[int, frozenset[str]], ...]:
        """Windows that end where the state's strings end, longest first."""
        known = self.above.get(state)
        if known is None:
            found, at = [], state
            while at > 0:
                found += [(size, frozenset(names)) for size, names in self.marks.get(at, {}).items()]
                at = self.link[at]
            known = self.above[state] = tuple(sorted(found, key=lambda x: -x[0]))
        return known

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of words [from, to), joined, and the items whose windows occur."""
        spans: list[list[int]] = []
        names: set[str] = set()
        if not self.shortest or len(words) < self.shortest:
            return [], names
        codes = np.fromiter((get(w, -1) for get in (self.vocabulary.get,) for w in words), np.int64, len(words))
        # A word that no item has resets the match, so only runs of known words can hold a window.
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (codes >= 0).view(np.int8), [0]])))
        for first, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if stop - first < self.shortest:
                continue
            state, matched = 0, 0
            for at, word in enumerate(codes[first:stop].tolist(), first + 1):
                state, matched = self.step(state, matched, word)
                if matched >= self.shortest:
                    hit = [(size, own) for size, own in self._marked(state) if size <= matched]
                    for _, own in hit:
                        names |= own
                    if hit:
                        begin = at - hit[0][0]
                        while spans and spans[-1][1] >= begin:
                            begin = min(begin, spans.pop()[0])
                        spans.append([begin, at])
        return [(a, b) for a, b in spans], names


def automata(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> list[Broadcast]:
    """The items' automata, each of about `shard_words` words at most, built in tasks and sent to the executors.

    How many there are follows from the benchmark; every document passes each.
    """
    spark = items.sparkSession
    # A repeated row would only be built again, and all of them in one group.
    source = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    size = source.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = size // (4 * shard_words) + 1  # a word and its gap take four characters or more in running text

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(
            ((i, words_of(t)) for i, t in zip(table.column("item").to_pylist(), table.column("text").to_pylist())),
            key=lambda r: (r[0] is None, r[0] or "", r[1]),
        )
        packed = pickle.dumps(vars(Automaton(rows, window)), protocol=5)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "automaton": pa.array([packed], pa.binary())})

    by_shard = source.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards)))
    built = keep(by_shard.groupBy("shard").applyInArrow(build, "shard long, automaton binary"), "automata")
    shared = []
    for row in built.select("shard").orderBy("shard").collect():
        packed = built.where(F.col("shard") == row["shard"]).first()["automaton"]
        shared.append(spark.sparkContext.broadcast(packed))
    return shared


def _loaded(shared: list[Broadcast]) -> list[Automaton]:
    machines = []
    for s in shared:
        machines.append(Automaton([]))
        vars(machines[-1]).update(pickle.loads(s.value))  # noqa: S301 - made by this job
    return machines


def _join(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    joined: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """A row per document: words, hit words, and the items whose windows occur."""
    shared = automata(items, item_id, item_text, window, shard_words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = _loaded(shared)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                spans, names = [], set()
                for machine in machines:
                    more, found = machine.match(words)
                    spans += more
                    names |= found
                hit = sum(b - a for a, b in _join(spans))
                names.discard(None)
                digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
                out.append((doc, len(words), hit, len(names), digest, hit > 0))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
                names_ = [part.split()[0] for part in REPORT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names_)

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(scan, REPORT)


def word_spans(text: str) -> list[tuple[int, int]]:
    """Byte ranges of the words in the text's UTF-8."""
    data = np.frombuffer(text.encode("utf-8", "replace").translate(_WORDS), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (data != 32).view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def cleaned(text: str, machines: list[Automaton], max_coverage: float) -> str | None:
    """The text without hit spans, or None if they cover more than `max_coverage` of its words.

    Repeats until nothing is hit, as a removal can bring two halves of a window together.
    """
    covered, total = 0, None
    while True:
        words = words_of(text)
        total = len(words) if total is None else total
        spans = _join([s for m in machines for s in m.match(words)[0]])
        if not spans:
            return text
        covered += sum(b - a for a, b in spans)
        if covered > max_coverage * total:
            return None
        places, data = word_spans(text), text.encode("utf-8", "replace")
        kept, at = [], 0
        for a, b in spans:
            kept.append(data[at : places[a][0]])
            at = places[b - 1][1]
        text = b"".join([*kept, data[at:]]).decode("utf-8", "replace")


def decontaminate(
    df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, max_coverage: float = 0.5, length_col: str | None = None, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """`df` with the hit spans cut out of its texts; rows that hits cover beyond `max_coverage` go.

    All columns stay as they are, but for `length_col`, which gets the new number of characters of changed texts.
    """
    shared = automata(items, item_id, item_text, window, shard_words)
    lost = fresh(df, "lost")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = _loaded(shared)
        for batch in batches:
            texts, gone = batch.column(text_col).to_pylist(), []
            changed: dict[int, str] = {}
            for i, text in enumerate(texts):
                new = cleaned(text, machines, max_coverage) if text else text
                gone.append(bool(text) and new is None)
                if new is not None and new != text:
                    changed[i] = new
            yield _replaced(batch, {text_col: changed} | ({length_col: {i: len(t) for i, t in changed.items()}} if length_col else {}), {lost: gone})

    return df.mapInArrow(scan, extended(df, **{lost: "boolean"})).where(~F.col(lost)).drop(lost)


def _replaced(batch: pa.RecordBatch, changes: dict[str, dict[int, object]], more: dict[str, list]) -> pa.RecordBatch:
    """The batch with some values replaced and columns appended."""
    arrays = []
    for name, column in zip(batch.schema.names, batch.columns):
        if changes.get(name):
            values = column.to_pylist()
            for i, value in changes[name].items():
                values[i] = value
            column = pa.array(values, column.type)
        arrays.append(column)
    arrays += [pa.array(v) for v in more.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *more])

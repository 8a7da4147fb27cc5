"""Secret scans with a random forest that tells real findings from false ones.

Candidates are runs of 16 or more key characters that have a digit, or 20 or more
that mix cases; values of 6 or more characters of any kind but blanks and quotes
that a credential's name is given; and what follows a vendor's prefix. Those that
overlap are one. A forest of decision trees, grown in numpy from labelled
findings, judges each by its length, character classes and transitions, how much
of it dictionary words cover, the path around it and the words beside it. The
letter transitions and the dictionary (the most frequent short words) are
counted over all documents.

Without labels at hand, `label_findings` marks a candidate as real when it is
the value of a credential's name or has a vendor's prefix; all others are
negatives. That rule itself is no feature. Every finding is learned from twice,
once without its neighbourhood, so that shape alone counts too. The forest is
grown from distinct values, as many of each label as `fit_rows` halved where
there are more.

Null and empty texts have no candidates; null ids and repeated rows give rows of
their own. With labels of one kind only, the forest is that constant.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceflow.llm.common import keep

CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
NAMES = re.compile(r"(?i)(token|secret|passw(or)?d|passwd|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth)[a-z_]*['\"]?\s*(=|:|=>|:=)\s*['\"]?$")
PREFIXES = re.compile(r"(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abp]-|sk_live_|rk_live_|AIza)")
PLACEHOLDER = "<SECRET>"
GIVEN = re.compile(r"(?:=>|:=|[=:])\s*['\"]?")
VALUE = re.compile(r"[^\s'\"]{6,}")
PREFIXED = re.compile(rf"(?<![A-Za-z0-9]){PREFIXES.pattern}[A-Za-z0-9+/_\-]{{6,}}={{0,2}}")
# Bound on the labelled findings the forest is grown from, spread by hash over the distinct values of each label.
FIT_ROWS = 10_000
DICTIONARY = 5_000  # words, by parameter
TREES, DEPTH, LEAST = 40, 8, 3
THRESHOLD = 0.5
NEAR = 60  # characters looked at on both sides of a candidate, by parameter
_SHAPES, _CONTEXT = 12, 18
WIDTH = _SHAPES + _CONTEXT
_WORD = re.compile(r"\w+")
_LETTERS = bytes(b if 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans, in order and disjoint."""
    text = text or ""
    found = []
    for m in CANDIDATE.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) or len(value) >= 20 and value != value.lower() and value != value.upper():
            found.append(m.span())
    found += [m.span() for m in PREFIXED.finditer(text)]
    upto = 0
    for m in GIVEN.finditer(text):
        if m.end() < upto or not NAMES.search(text[max(0, m.start() - NEAR) : m.end()]):
            continue
        if value := VALUE.match(text, m.end()):
            upto = value.end()
            found.append((m.end(), m.end() + len(value[0].rstrip(",;.)]}>"))))
    spans: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if spans and start < spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        elif end > start:
            spans.append((start, end))
    return spans


@dataclass
class Language:
    """Log probabilities of letter transitions (26 x 26) and the dictionary."""

    transitions: np.ndarray
    words: frozenset[str]
    near: int = NEAR


def language(df: DataFrame, text_col: str, size: int = DICTIONARY, near: int = NEAR) -> Language:
    """Counted over all texts: letter pairs, and words of 3 to 6 ASCII letters, of which the `size` most frequent stay."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter[bytes] = Counter()
            pairs = np.zeros(26 * 26, dtype=np.int64)
            for text in batch.column(0).to_pylist():
                line = (text or "").encode("utf-8", "replace").translate(_LETTERS)
                codes = np.frombuffer(line, np.uint8).astype(np.int16) - 97
                both = (codes[1:] >= 0) & (codes[:-1] >= 0)
                pairs += np.bincount(codes[:-1][both] * 26 + codes[1:][both], minlength=26 * 26)
                words.update(w for w in line.split() if 3 <= len(w) <= 6)
            at = np.flatnonzero(pairs)
            keys = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in at.tolist()] + [w.decode() for w in words]
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "n": pa.array([*pairs[at].tolist(), *words.values()], pa.int64())})

    counted = keep(df.select(F.col(text_col).cast("string")).mapInArrow(count, "key string, n long"), "letters", rows=10_000)
    totals = counted.groupBy("key").agg(F.sum("n").alias("n"))
    pairs = np.ones((26, 26))
    for row in totals.where(F.length("key") == 2).collect():  # at most 676
        pairs[ord(row["key"][0]) - 97, ord(row["key"][1]) - 97] += row["n"]
    top = totals.where(F.length("key") > 2).orderBy(F.desc("n"), "key").limit(size).collect()
    return Language(np.log(pairs / pairs.sum(axis=1, keepdims=True)), frozenset(r["key"] for r in top), near)


def coverage(value: str, words: frozenset[str]) -> float:
    """Share of the characters that dictionary words cover, longest first from the left."""
    value, covered, at = value.lower(), 0, 0
    while at < len(value):
        size = next((k for k in (6, 5, 4, 3) if value[at : at + k] in words), 0)
        covered += size
        at += size or 1
    return covered / len(value)


def describe(text: str, start: int, end: int, known: Language) -> np.ndarray:
    """Shape features, then those of path and neighbouring words."""
    value = text[start:end]
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    share = {k: kinds.count(k) / n for k in "dulo"}
    counts = np.array(list(Counter(value).values())) / n
    letters = value.lower()
    moves = [known.transitions[ord(a) - 97, ord(b) - 97] for a, b in zip(letters, letters[1:]) if "a" <= a <= "z" and "a" <= b <= "z"]
    runs = re.findall(r"[A-Za-z]+", value)
    before, after = text[max(0, start - known.near) : start], text[end : end + known.near]
    left, right = _WORD.findall(before.lower()), _WORD.findall(after.lower())
    head = before.split()[-1] if before and not before[-1].isspace() and before.split() else ""
    shape = [
        math.log(n), share["d"], share["u"], share["l"], share["o"], float(re.fullmatch(r"[0-9a-fA-F]+", value) is not None),
        len(counts) / n, float(-(counts * np.log2(counts)).sum()), sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum(moves) / len(moves) if moves else 0.0, coverage(value, known.words), max(map(len, runs), default=0) / n,
    ]
    buckets = np.zeros(12)
    if left:
        buckets[zlib.crc32(left[-1].encode()) % 8] = 1
    if right:
        buckets[8 + zlib.crc32(right[0].encode()) % 4] = 1
    context = [
        float(value.count("/")), float("/" in head), float("://" in head), float("@" in head or after[:1] == "@"),
        float(before[-1:] in "'\"" and before != ""), float(re.search(r"[=:]\s*['\"]?$", before) is not None),
        *buckets,
    ]
    return np.array(shape + context)


def extract(df: DataFrame, known: Language, id_col: str, text_col: str) -> DataFrame:
    """A row per candidate: doc_id, start, length, value_sha, x (features), named (the labelling rule's view)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for start, end in candidates(text):
                    rows.append((
                        doc, start, end - start, hashlib.sha256(text[start:end].encode()).hexdigest(),
                        describe(text, start, end, known).tobytes(), ruled(text, start, end),
                    ))
            columns = zip(*rows) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "value_sha", "x", "named"])

    source = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(scan, "doc_id long, start long, length long, value_sha string, x binary, named boolean")


def ruled(text: str, start: int, end: int) -> bool:
    """What the labelling rule says: a credential's value, or a vendor's prefix."""
    return NAMES.search(text[max(0, start - NEAR) : start]) is not None or PREFIXES.match(text[start:end]) is not None


def label_findings(found: DataFrame) -> DataFrame:
    return found.select("value_sha", "x", F.col("named").cast("int").alias("label"))


@dataclass
class Forest:
    """Trees as arrays; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            low = x[rows, self.feature[at]] <= self.cut[at]
            at = np.where(low, self.left[at], self.right[at])
        return self.value[at].mean(axis=1)


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 11) -> Forest:
    """Bootstrap trees on random features, split by Gini impurity at quantiles."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 17)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    some = max(2, int(math.sqrt(x.shape[1])) + 1)
    nodes: list[list] = []
    roots = []

    def node(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        share = float(y[idx].mean())
        nodes.append([0, np.inf, me, me, share])
        if depth == DEPTH or len(idx) < 2 * LEAST or share in (0.0, 1.0):
            return me
        best = (1e-12, -1, -1)
        for f in rng.choice(x.shape[1], some, replace=False):
            if not len(edges[f]):
                continue
            c = codes[idx, f]
            n = np.cumsum(np.bincount(c, minlength=len(edges[f]) + 1))[:-1]
            good = np.cumsum(np.bincount(c, weights=y[idx], minlength=len(edges[f]) + 1))[:-1]
            m, rest = len(idx) - n, y[idx].sum() - good
            fits = (n >= LEAST) & (m >= LEAST)
            n_, m_ = np.maximum(n, 1), np.maximum(m, 1)
            gain = np.where(fits, share * (1 - share) - (good * (1 - good / n_) + rest * (1 - rest / m_)) / len(idx), 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), k)
        if best[1] < 0:
            return me
        low = codes[idx, best[1]] <= best[2]
        nodes[me][0], nodes[me][1] = best[1], float(edges[best[1]][best[2]])
        nodes[me][2] = node(idx[low], depth + 1)
        nodes[me][3] = node(idx[~low], depth + 1)
        return me

    for _ in range(trees):
        roots.append(node(rng.integers(0, len(x), len(x)), 0))
    feature, cut, left, right, value = zip(*nodes)
    return Forest(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value), np.array(roots))


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Forest:
    """A forest from (value_sha, x, label) rows, of which about `fit_rows` at most come to the driver.

    They are distinct values, drawn by hash from each label's own; of a value's rows with one label that with the largest
    features, by their bytes, stands for all, so a hot value is one row.
    """
    distinct = keep(
        labelled.where("label IS NOT NULL AND x IS NOT NULL").groupBy("value_sha", "label").agg(F.max("x").alias("x")), "labelled-values",
    )
    counts = distinct.groupBy("label").agg(F.count("*").alias("n")).collect()  # two rows
    portion = F.lit(0)
    for row in counts:
        share = min(1.0, fit_rows / 2 / row["n"])
        portion = F.when(F.col("label") == row["label"], int(share * (1 << 20))).otherwise(portion)
    rows = distinct.where(F.pmod(F.xxhash64("value_sha"), F.lit(1 << 20)) < portion).select("x", "label", "value_sha").collect()
    rows.sort(key=lambda r: (r["value_sha"], r["label"]))
    x = np.stack([np.frombuffer(r["x"], np.float64) for r in rows]) if rows else np.zeros((1, WIDTH))
    y = np.array([float(r["label"]) for r in rows]) if rows else np.zeros(1)
    bare = x.copy()
    bare[:, _SHAPES:] = 0
    return grow(np.concatenate([x, bare]), np.concatenate([y, y]))


def judged(found: DataFrame, forest: Forest) -> Column:
    @F.pandas_udf("double")
    def score(x):  # noqa: ANN001, ANN202 - a pandas series of feature bytes
        import pandas as pd

        return pd.Series(forest.predict(np.stack([np.frombuffer(b, np.float64) for b in x])) if len(x) else [])

    return score(found["x"])


def scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None, threshold: float = THRESHOLD,
    fit_rows: int = FIT_ROWS, dictionary: int = DICTIONARY, near: int = NEAR,
) -> DataFrame:
    """A row per candidate: doc_id, start, length (characters), value_sha256, score, secret."""
    found, forest, _ = prepared(df, id_col, text_col, labelled, fit_rows, dictionary, near)
    return found.select(
        "doc_id", "start", "length", F.col("value_sha").alias("value_sha256"), judged(found, forest).alias("score"),
    ).withColumn("secret", F.col("score") >= threshold)


def prepared(
    df: DataFrame, id_col: str, text_col: str, labelled: DataFrame | None, fit_rows: int, dictionary: int, near: int,
) -> tuple[DataFrame, Forest, Language]:
    known = language(df, text_col, dictionary, near)
    found = keep(extract(df, known, id_col, text_col), "candidates")
    return found, train(label_findings(found) if labelled is None else labelled, fit_rows), known


def redact(
    df: DataFrame, text_col: str = "text", length_col: str | None = None, labelled: DataFrame | None = None, threshold: float = THRESHOLD,
    fit_rows: int = FIT_ROWS, dictionary: int = DICTIONARY, near: int = NEAR,
) -> DataFrame:
    """`df` with the secrets in its texts replaced by a placeholder; all rows and columns stay.

    `length_col` gets the new number of characters of changed texts.
    """
    from sluiceflow.llm.decontaminate import _replaced

    source = df.select(F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text"))
    _, forest, known = prepared(source, "id", "text", labelled, fit_rows, dictionary, near)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed: dict[int, str] = {}
            for i, text in enumerate(batch.column(text_col).to_pylist()):
                spans = candidates(text)
                if not spans:
                    continue
                scores = forest.predict(np.stack([describe(text, a, b, known) for a, b in spans]))
                new = text
                for (a, b), score in reversed(list(zip(spans, scores))):
                    if score >= threshold:
                        new = new[:a] + PLACEHOLDER + new[b:]
                if new != text:
                    changed[i] = new
            yield _replaced(batch, {text_col: changed} | ({length_col: {i: len(t) for i, t in changed.items()}} if length_col else {}), {})

    return df.mapInArrow(clean, df.schema)

"""Token ids of whole texts, with every distinct word encoded once per task."""

from __future__ import annotations

import codecs
import json
import os
import re
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np

WORD_BPE = "word_bpe_49k.json"
# Distinct words a task remembers; beyond it the memory starts afresh, which changes no result.
CACHE_WORDS = 1_000_000
# Characters whose lower case is one character and that no Unicode normalisation joins or splits.
_PLAIN = "[\\x21-\\x7e\\u00c0-\\u012f\\u0132-\\u024f]+"
# Any other character; the blank is left to part words.
_ODD = "[^\\x20-\\x7e\\u00c0-\\u012f\\u0132-\\u024f]"
# What the classes of a tokenizer's pattern come to among plain characters in lower case, of which some lie beyond
# U+024F; `re` takes half the time of `regex`.
_CLASSES = {r"\p{L}": "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u2c65\u2c66", r"\p{N}": "0-9"}
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}


def _numbered() -> defaultdict:
    """Word to number, in order of arrival; a new word gets the next one without a Python call."""
    return defaultdict(count().__next__)


def _latest(index: dict, known: int) -> list:
    """The words numbered `known` and up."""
    return list(islice(reversed(index), len(index) - known))[::-1]


def _byte_letters() -> str:
    """The characters by which byte-level models write the 256 bytes, but for the blank, which stays."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    more = count(256)
    return "".join(chr(b if b in own else next(more)) for b in range(256)).replace("\u0120", " ")


def _flat(encodings: list) -> np.ndarray:
    return np.fromiter(chain.from_iterable(e.ids for e in encodings), np.uint32)


class WordIds:
    """Ids as `Tokenizer.encode(text, add_special_tokens=False)` gives them.

    The tokenizer drops white space and no token crosses it, so the ids of a
    text are those of its words. New words of plain Latin letters, digits and
    marks are cut all at once by the tokenizer's own pattern, and the parts that
    are new go in one call to the same model without its normaliser; other words
    go to the full tokenizer. Words and parts are remembered apart, as a word
    comes with one mark after it and then with another.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already uses the cores
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.full = Tokenizer.from_file(path)
        cut = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = cut["pattern"]["Regex"]
        for name, members in _CLASSES.items():
            pattern = pattern.replace(name, members)
        # The blank between two words is a match of its own.
        self.cut = (regex if "\\p" in pattern else re).compile(pattern + "| ").findall
        self.plain = regex.compile(_PLAIN).fullmatch
        self.odd = re.compile(_ODD).search
        spec["normalizer"] = None
        rest = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] != "Split"]
        # Bytes become their characters here, for a whole line in one step.
        self.letters = _byte_letters() if len(rest) == 1 and _BYTE_LEVEL.items() <= rest[0].items() else None
        spec["pre_tokenizer"]["pretokenizers"] = [{"type": "CharDelimiterSplit", "delimiter": " "}] + (rest if self.letters is None else [])
        self.bare = Tokenizer.from_str(json.dumps(spec))
        suffix = spec["model"]["end_of_word_suffix"]
        size = self.full.get_vocab_size()
        self.ends = np.zeros(size, dtype=bool)
        for piece, number in spec["model"]["vocab"].items():
            self.ends[number] = piece.endswith(suffix)
        self.size, self.limit = size, limit
        self.forget()

    def forget(self) -> None:
        """Give up the words remembered so far; workers outlive their tasks, and would hold them through all later steps."""
        self.index, self.parts = _numbered(), _numbered()
        self.ids, self.part_ids = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint32)
        self.start, self.part_start = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.count, self.part_count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the parts, and each part's start and number: a part's last id is the only one that ends a word."""
        lines = [" ".join(parts[i : i + 200]) for i in range(0, len(parts), 200)]
        if self.letters is not None:
            lines = [codecs.charmap_decode(line.encode(), "strict", self.letters)[0] for line in lines]
        ids = _flat(self.bare.encode_batch_fast(lines, add_special_tokens=False)) if lines else np.zeros(0, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(parts):
            start = np.concatenate([[0], cuts[:-1]]) if len(cuts) else cuts
            return ids, start, np.diff(np.append(start, len(ids)))
        found = self.full.encode_batch_fast(parts, add_special_tokens=False)
        count = np.fromiter((len(e.ids) for e in found), np.int64, len(found))
        return _flat(found), np.cumsum(count) - count, count

    def _learn(self, waiting: list[bytes]) -> None:
        words = b" ".join(waiting).decode("utf-8", "replace")
        other, texts = [], []
        plain = np.ones(len(waiting), dtype=bool)
        if "<|" in words or self.odd(words):
            every = words.split(" ")
            other = [i for i, w in enumerate(every) if "<|" in w or not self.plain(w)]
            texts = [every[i] for i in other]
            plain[other] = False
            words = " ".join([w for w, p in zip(every, plain.tolist()) if p])
        cut = self.cut(words.lower())
        known = len(self.parts)
        # Numbers of the words' parts, one word after the other; -1 between words.
        self.parts[" "] = -1
        part = np.fromiter(map(self.parts.__getitem__, cut), np.int64, len(cut))
        del self.parts[" "]
        table, start, number = self._parts(_latest(self.parts, known))
        self.part_start = np.concatenate([self.part_start, len(self.part_ids) + start])
        self.part_count = np.concatenate([self.part_count, number])
        self.part_ids = np.concatenate([self.part_ids, table])
        between = np.flatnonzero(part < 0)
        sizes = np.zeros(len(waiting) + 1, dtype=np.int64)  # the last size is no word's
        if plain.any():
            sizes[:-1][plain] = np.diff(np.concatenate([[-1], between, [len(part)]])) - 1
        part = part[part >= 0]
        ends = np.concatenate([[0], np.cumsum(self.part_count[part])])
        ids = gather(self.part_ids, self.part_start[part], self.part_count[part], ends)
        edges = ends[np.cumsum(sizes) - sizes]
        start, number = edges[:-1], np.diff(edges)
        if other:
            found = self.full.encode_batch_fast(texts, add_special_tokens=False)
            number[other] = [len(e.ids) for e in found]
            start[other] = len(ids) + np.cumsum(number[other]) - number[other]
            ids = np.concatenate([ids, _flat(found)])
        self.start, self.count = np.concatenate([self.start, len(self.ids) + start]), np.concatenate([self.count, number])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's ids end."""
        if max(len(self.index), len(self.parts)) > self.limit:
            self.forget()
        words = [split_words(t) for t in texts]
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64)
        if len(self.index) > known:
            self._learn(_latest(self.index, known))
        number = self.count[at]
        ends = np.concatenate([[0], np.cumsum(number)])
        ids = gather(self.ids, self.start[at], number, ends)
        return ids, ends[np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]


def split_words(text: str | None) -> list[bytes]:
    """Runs between ASCII white space, in lower case unless a special token's name may occur."""
    data = (text or "").encode("utf-8", "replace")
    return data.split() if b"<|" in data else data.lower().split()


def gather(values: np.ndarray, start: np.ndarray, count: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The runs `values[start : start + count]` one after the other; `ends` is the running count from 0."""
    return values[np.repeat(start - ends[:-1], count) + np.arange(ends[-1])]


def word_ids(name: str) -> WordIds:
    """This worker's encoder for a tokenizer file, by public name or path.

    The package's code travels by value, so its globals are new in every task;
    the encoder is kept on the tokenizers module, which stays for the worker.
    A task that is done calls `forget`.
    """
    import tokenizers

    known = tokenizers.__dict__.setdefault("_word_ids", {})
    if name not in known:
        known[name] = WordIds(tokenizer_path(name))
    return known[name]


def tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)

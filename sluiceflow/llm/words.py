"""Words of whole columns of texts at once, on the bytes of Arrow buffers; no string is made per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Kinds of bytes: part of a word, between words, end of a piece.
WORD, GAP, BREAK = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_kinds(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """A table from bytes to their kinds; all others are parts of words."""
    kinds = np.full(256, WORD, dtype=np.uint8)
    kinds[list(gaps)] = GAP
    kinds[list(breaks)] = BREAK
    return kinds


@dataclass
class Words:
    """The words of some texts in order; `ids` count distinct words in no particular order."""

    ids: np.ndarray
    distinct: pa.Array  # binary
    text: np.ndarray  # which text a word is of
    piece: np.ndarray  # which piece, over all texts; texts never share one
    n_texts: int

    def bounds(self) -> np.ndarray:
        """Where each text's words begin, and the end."""
        return np.searchsorted(self.text, np.arange(self.n_texts + 1))


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(column: pa.Array, kinds: np.ndarray | None) -> Words:
    """The words of a string column, A-Z in lower case; without a table, runs of the letters A-Z, a-z and U+00C0 to U+00FF."""
    data, offsets = _raw(column)
    if kinds is None:
        lead = data == 0xC3  # with the byte after it, U+00C0 to U+00FF
        letter = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | lead
        letter[1:] |= lead[:-1]
        kind = np.where(letter, WORD, GAP).astype(np.uint8)
    else:
        kind = kinds[data]
    inside = kind == WORD
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    starts[edges] = inside[edges]  # a text begins a word of its own
    begin = np.flatnonzero(starts)
    # Bytes of words only, and where each word begins among them. A count per byte is the largest array here, so it is a short one.
    count = np.int32 if len(data) < 2**31 else np.int64
    where = np.append(np.cumsum(inside, dtype=count)[begin].astype(np.int64) - 1, int(inside.sum()))
    values = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(where), pa.py_buffer(_LOWER[data[inside]])])
    coded = values.dictionary_encode()
    text = np.searchsorted(offsets, begin, side="right") - 1
    if kinds is None or not (kinds == BREAK).any():
        piece = text
    else:
        cut = kind == BREAK
        cut[edges] = True
        piece = np.cumsum(cut, dtype=count)[begin].astype(np.int64)
        # A text's first byte may itself end a piece, which is then just empty.
    return Words(coded.indices.to_numpy(), coded.dictionary, text, piece, len(column))


def names(distinct: pa.Array, seed: int = 42) -> np.ndarray:
    """XXH64 of each distinct word."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in distinct.to_pylist()), np.uint64, len(distinct))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chained(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of the sequences whose members' names stand in the columns."""
    out = np.full(len(columns[0]), len(columns), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in columns:
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out

"""Token ids packed into sequences: a row per piece (linear grouping) or per sequence (best-fit-decreasing).

A text's tokens are its ids and then an end id. Only texts longer than the
capacity are cut, into pieces of the capacity and a rest. A null text is empty
and has the end id alone; null ids, repeated rows and very long texts are
pieces like others; an empty table has no rows. Only the two columns asked for
are read, so further columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceflow.llm.common import keep
from sluiceflow.llm.packing import best_fit, linear_grouping, place
from sluiceflow.llm.tokens import WORD_BPE, word_ids

CAPACITY = 4096
END_ID = 1
# Texts of an Arrow batch; their ids and new words are what a task holds besides the words it remembers.
BATCH = 500
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


def pieces(
    df: DataFrame, id_col: str, text_col: str, tokenizer: str = WORD_BPE, capacity: int = CAPACITY, end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """A written row per piece; `with_ids` keeps the ids, compressed, as little-endian bytes of two or four each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, pack = word_ids(tokenizer), zstandard.ZstdCompressor().compress
        kind = np.dtype("<u2" if encoder.size <= 1 << 16 else "<u4")
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            ids, ends = encoder.encode(batch.column(1).to_pylist())
            out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "nth", "ids")}
            first = 0
            for doc, end in zip(batch.column(0).to_pylist(), ends.tolist()):
                own = np.append(ids[first:end], np.uint32(end_id)).astype("<u4")
                first = end
                for k, start in enumerate(range(0, len(own), capacity)):
                    piece = own[start : start + capacity]
                    row = (doc, k, start, len(piece), zlib.crc32(piece), seen[len(piece)], pack(piece.astype(kind).tobytes()) if with_ids else None)
                    seen[len(piece)] += 1
                    for column, value in zip(out.values(), row):
                        column.append(value)
            if not with_ids:
                del out["ids"]
            columns = out | {"part": [part] * len(out["doc_id"])}
            yield pa.RecordBatch.from_pydict({n: pa.array(columns[n], kinds[n]) for n in kinds})
        encoder.forget()

    kinds = {
        "doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int32(), "ids_crc32": pa.int64(),
        "part": pa.int32(), "nth": pa.int64(),
    } | ({"ids": pa.binary()} if with_ids else {})
    source = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return keep(source.mapInArrow(cut, PIECES + (", ids binary" if with_ids else "")), "pieces", rows=BATCH)


def pack_grouped(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = WORD_BPE, capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """A row per piece with its place, planned by linear grouping."""
    return place(pieces(df, id_col, text_col, tokenizer, capacity, end_id), capacity, linear_grouping).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id",
        F.col("offset").cast("long").alias("offset"),
    )


SEQUENCES = (
    "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, "
    "pieces array<int>, starts array<long>, ids_crc32 long"
)


def pack_ids(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = WORD_BPE, capacity: int = CAPACITY,
    end_id: int = END_ID, pad_id: int = 0,
) -> DataFrame:
    """A row per sequence: its line of the id matrix, cumulative segment lengths and position resets.

    `ids` and `positions` are `capacity` numbers each, of the same width: pieces
    by place, padded at the end with `pad_id` and position 0. `cu_seqlens` starts
    at 0 and ends at `n_tokens`. `doc_ids`, `pieces` and `starts` name the pieces,
    so that the texts' ids can be put together again.
    """
    placed = place(pieces(df, id_col, text_col, tokenizer, capacity, end_id, with_ids=True), capacity, best_fit)
    columns = ["sequence_id", "offset", "length", "doc_id", "piece", "start", "ids"]
    sorted_pieces = placed.select(*columns).repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            rows = held + list(zip(*(batch.column(c).to_pylist() for c in columns)))
            last = rows[-1][0] if rows else None
            done = [r for r in rows if r[0] != last]
            held = rows[len(done):]
            yield from build(done)
        yield from build(held)

    def build(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        out, at = [], 0
        while at < len(rows):
            stop = at
            while stop < len(rows) and rows[stop][0] == rows[at][0]:
                stop += 1
            own = [(*r[:6], unpack(r[6])) for r in rows[at:stop]]
            width = len(own[0][6]) // own[0][2]
            matrix = np.full(capacity, pad_id, dtype=f"<u{width}")
            position = np.zeros(capacity, dtype=matrix.dtype)
            for _, offset, length, _, _, _, ids in own:
                matrix[offset : offset + length] = np.frombuffer(ids, matrix.dtype)
                position[offset : offset + length] = np.arange(length)
            bounds = [0, *(r[1] + r[2] for r in own)]
            out.append((
                own[0][0], bounds[-1], matrix.tobytes(), bounds, position.tobytes(), [r[3] for r in own],
                [r[4] for r in own], [r[5] for r in own], zlib.crc32(matrix[: bounds[-1]].astype("<u4")),
            ))
            at = stop
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    target = pa.schema([
        ("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
        ("positions", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())),
        ("starts", pa.list_(pa.int64())), ("ids_crc32", pa.int64()),
    ])
    return sorted_pieces.mapInArrow(lines, SEQUENCES)

"""FASTQ files as a Spark data source named `fastq`.

A quality line may begin with `@`, so a task that starts inside a file cannot
tell a header by that sign alone. It looks for a line that begins with `@` and
is followed, two lines on, by one that begins with `+`; sequence lines hold
letters only, so no other line fits.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64_000_000
BLOCK_BYTES = 8_000_000
MARGIN_BYTES = 64_000
FIELDS = ("id", "seq", "plus", "qual")


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


def first_header(lines: list[bytes]) -> int | None:
    """Index of the first line that begins a record, or None."""
    for i in range(len(lines) - 2):
        if lines[i].startswith(b"@") and lines[i + 2].startswith(b"+"):
            return i
    return None


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path within it; Hadoop's names for S3 are taken as S3."""
    for scheme in ("s3a://", "s3n://"):
        if path.startswith(scheme):
            path = "s3://" + path[len(scheme) :]
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """Path and size of every file with content at or below a path, by path; hidden ones are left out."""
    store, root = open_store(path)
    info = store.get_file_info(root)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.size and not f.base_name.startswith(("_", ".")))


def byte_ranges(path: str, start: int, end: int, split: int) -> list[ByteRange]:
    return [ByteRange(path, low, min(low + split, end)) for low in range(start, end, split)]


def first_record(raw, start: int) -> int | None:
    """Where the first record at or after `start` begins."""
    if start == 0:
        return 0
    raw.seek(start - 1)
    stream = io.BufferedReader(raw, MARGIN_BYTES)
    # The rest of a line that began before this range belongs to the range before.
    position = start - 1 + len(stream.readline())
    ahead = [line for line in (stream.readline() for _ in range(7)) if line]
    stream.detach()
    first = first_header(ahead)
    return None if first is None else position + sum(len(line) for line in ahead[:first])


def strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts at raw[start:end], without the carriage returns at their ends."""
    while len(cut := np.flatnonzero((ends > starts) & (raw[np.maximum(ends - 1, 0)] == 13))):
        ends = ends.copy()
        ends[cut] -= 1
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    values = raw[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)]
    made = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.tobytes()))
    made.validate(full=True)
    return made


def fastq_batches(raw, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """The records whose header line begins at a byte in [start, end)."""
    position = first_record(raw, start)
    if position is None:
        return
    raw.seek(position)
    rest, block = b"", b" "
    while position < end and block:
        block = raw.read(min(BLOCK_BYTES, end - position + MARGIN_BYTES))
        data = rest + block
        bytes_of = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(bytes_of == 10)
        if not block and data and data[-1:] != b"\n":
            ends = np.append(ends, len(data))  # the file's last line
        ends = ends[: len(ends) // 4 * 4]
        if not len(ends):
            rest = data
            continue
        starts = np.concatenate([[0], ends[:-1] + 1])
        inside = 4 * int((position + starts[::4] < end).sum())
        if inside:
            columns = [strings(bytes_of, np.minimum(starts[k:inside:4] + (k == 0), ends[k:inside:4]), ends[k:inside:4]) for k in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=list(FIELDS))
        used = int(ends[-1]) + 1
        rest, position = data[used:], position + used


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[ByteRange]:
        return [part for path, size in listed(self.path) for part in byte_ranges(path, 0, size, self.split)]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark hands out when there are no partitions
            return
        store, _ = open_store(self.path)
        with store.open_input_file(partition.path) as raw:
            yield from fastq_batches(raw, partition.start, partition.end)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "id string, seq string, plus string, qual string"

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(id, seq, plus, qual) of the four-line reads below a path."""
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("splitbytes", split_bytes).load(path)

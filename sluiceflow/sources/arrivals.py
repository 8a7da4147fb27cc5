"""Record files as streams: new files below a folder, in batches bounded by bytes.

Files are to be moved in whole, as for every file stream. Each gets the next
place in a log when it is first seen, and an offset is a place in that log with a
byte of the file there, so a batch may end inside a file: a record belongs to the
batch in which it begins. Modification times play no part. The log lies in a
shared folder of its own, with the place up to which batches were offered, so a
restarted query goes on from there; what had been offered but not been planned is
part of its next batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from sluiceflow.sources.reads import BLOCK_BYTES, SPLIT_BYTES, ByteRange, byte_ranges, fastq_batches, listed, open_store

BATCH_BYTES = 4_000_000_000
_OPEN = re.compile(rb"<spectrum[\s/>]")
_CLOSE = b"</spectrum>"


def spectra(raw, start: int, end: int) -> Iterator[bytes]:
    """The XML of every spectrum whose tag begins at a byte in [start, end)."""
    raw.seek(start)
    # `held` begins at byte `base` of the file; `at` is the place in it up to which it was looked through.
    held, base, at, more = b"", start, 0, True
    while True:
        hit = _OPEN.search(held, at)
        begin = hit.start() if hit else max(at, len(held) - 9)
        if base + begin >= end or (not hit and not more):
            return
        at, stop = begin, -1
        if hit:
            tag = held.find(b">", at)
            if tag > 0 and held[tag - 1 : tag] == b"/":
                stop = tag + 1
            elif tag > 0:
                close = held.find(_CLOSE, tag)
                stop = close + len(_CLOSE) if close >= 0 else -1
        if stop > 0:
            yield held[at:stop]
            at = stop
        elif more:
            # What was looked through goes once a block, not with every spectrum.
            block = raw.read(BLOCK_BYTES)
            held, base, at, more = held[at:] + block, base + at, 0, bool(block)
        else:
            return  # a spectrum that the file does not end


def spectrum_batches(raw, start: int, end: int) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for xml in spectra(raw, start, end):
        rows.append(xml.decode())
        size += len(xml)
        if size >= BLOCK_BYTES:
            yield pa.RecordBatch.from_pydict({"xml": pa.array(rows, pa.string())})
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pydict({"xml": pa.array(rows, pa.string())})


class FileLog:
    """The files seen so far, in the order in which they were seen, and the place up to which they were offered."""

    def __init__(self, folder: str):
        self.store, self.root = open_store(folder)
        self.store.create_dir(self.root, recursive=True)
        self.files: list[list] = []
        for entry in sorted(f.path for f in self.store.get_file_info(fs.FileSelector(self.root)) if re.fullmatch(r"\d+\.json", f.base_name)):
            self.files += self._read(entry)
        self.known = {path for path, _ in self.files}
        mark = f"{self.root}/offered.json"
        self.offered = self._read(mark) if self.store.get_file_info(mark).is_file else {"file": 0, "at": 0}

    def _read(self, path: str):
        with self.store.open_input_stream(path) as held:
            return json.loads(held.read())

    def _write(self, name: str, content) -> None:
        """Whole or not at all."""
        draft = f"{self.root}/draft"
        with self.store.open_output_stream(draft) as out:
            out.write(json.dumps(content).encode())
        self.store.move(draft, f"{self.root}/{name}")

    def discover(self, path: str) -> None:
        new = [[name, size] for name, size in listed(path) if name not in self.known]
        if new:
            self._write(f"{len(self.files):012d}.json", new)
            self.files += new
            self.known.update(name for name, _ in new)

    def advance(self, limit: int) -> dict:
        """The place some `limit` bytes on, or the end of what is there."""
        file, at = self.offered["file"], self.offered["at"]
        while file < len(self.files) and limit > 0:
            step = min(limit, self.files[file][1] - at)
            at, limit = at + step, limit - step
            if at == self.files[file][1]:
                file, at = file + 1, 0
        moved = {"file": file, "at": at}
        if moved != self.offered:
            self._write("offered.json", moved)
            self.offered = moved
        return moved


class RecordStream(DataSourceStreamReader):
    def __init__(self, options: dict, batches: Callable):
        self.path, self.folder, self.batches = options["path"], options["log"], batches
        self.split, self.bound = int(options["splitbytes"]), int(options["batchbytes"])
        if self.split < 1 or self.bound < 1:
            raise ValueError("a range and a batch hold at least one byte")
        self.held: FileLog | None = None

    def log(self) -> FileLog:
        # Tasks get a copy of this object and never open the log.
        if self.held is None:
            self.held = FileLog(self.folder)
        return self.held

    def initialOffset(self) -> dict:
        return {"file": 0, "at": 0}

    def latestOffset(self) -> dict:
        log = self.log()
        log.discover(self.path)
        return log.advance(self.bound)

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        files = self.log().files
        if end["file"] > len(files) or (end["at"] and end["file"] == len(files)):
            raise ValueError(f"the log {self.folder} lacks files that the checkpoint names")
        found = []
        for place in range(start["file"], min(end["file"] + 1, len(files))):
            path, size = files[place]
            low = start["at"] if place == start["file"] else 0
            high = end["at"] if place == end["file"] else size
            found += byte_ranges(path, low, high, self.split)
        return found

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        with store.open_input_file(partition.path) as raw:
            yield from self.batches(raw, partition.start, partition.end)

    def commit(self, end: dict) -> None:
        """Nothing to do: files stay where they are."""


class FastqArrivals(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq_arrivals"

    def schema(self) -> str:
        return "id string, seq string, plus string, qual string"

    def streamReader(self, schema) -> RecordStream:
        return RecordStream(self.options, fastq_batches)


class SpectrumArrivals(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mzml_arrivals"

    def schema(self) -> str:
        return "xml string"

    def streamReader(self, schema) -> RecordStream:
        return RecordStream(self.options, spectrum_batches)


KINDS = {"fastq": FastqArrivals, "mzML": SpectrumArrivals}


def record_arrivals(
    spark: SparkSession, kind: str, folder: str, log: str, batch_bytes: int = BATCH_BYTES, split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """A stream of the records (`fastq`: id, seq, plus, qual; `mzML`: xml) of every file that appears below a folder.

    `log` is a shared folder that belongs to one query, like its checkpoint. No file, an empty one, or one without a
    whole record gives no rows. Run it with `flows.drain_batches` or a trigger by time; asked for all that is available
    at once, Spark takes but the first batch of a source of this kind.
    """
    source = KINDS[kind]
    spark.dataSource.register(source)
    reader = spark.readStream.format(source.name()).option("log", log)
    return reader.option("splitbytes", split_bytes).option("batchbytes", batch_bytes).load(folder)

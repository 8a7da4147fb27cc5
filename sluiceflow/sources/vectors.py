"""Labelled vectors in records of a fixed width, as a Spark data source named `fixed_vectors`.

A record is `features` little-endian int64 values, a space, the class in a fixed
number of digits, and CR LF. Files are cut by the width of a record, which
follows from the number of features, so no byte inside a feature parts records.
The last record of a file may lack its CR LF.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from sluiceflow.sources import sinks
from sluiceflow.sources.reads import BLOCK_BYTES, SPLIT_BYTES, ByteRange, byte_ranges, listed, open_store

END = b"\r\n"


def record_width(features: int, digits: int) -> int:
    if features < 0 or not 1 <= digits <= 9:
        raise ValueError("a vector has no fewer than 0 features and a class of 1 to 9 digits")
    return 8 * features + 1 + digits + len(END)


def decoded(data: bytes, features: int, digits: int) -> pa.RecordBatch:
    """The records in `data`, which holds whole ones only."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, record_width(features, digits))
    head, signs = rows[:, : 8 * features], rows[:, 8 * features + 1 : -len(END)]
    wrong = (rows[:, 8 * features] != 32) | (rows[:, -2] != 13) | (rows[:, -1] != 10) | ((signs < 48) | (signs > 57)).any(axis=1)
    if wrong.any():
        raise ValueError(f"no vectors of {features} features and {digits} digits: record {int(wrong.argmax())} of a block has other marks")
    values = np.ascontiguousarray(head).reshape(-1).view("<i8")
    label = (signs.astype(np.int64) - 48) @ 10 ** np.arange(digits - 1, -1, -1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * features
    return pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(label.astype(np.int32))], names=["features", "label"],
    )


class VectorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.features, self.digits = options["path"], int(options["features"]), int(options["digits"])
        self.width = record_width(self.features, self.digits)
        self.split = max(1, int(options["splitbytes"]) // self.width) * self.width

    def partitions(self) -> list[ByteRange]:
        found = []
        for path, size in listed(self.path):
            if size % self.width not in (0, self.width - len(END)):
                raise ValueError(f"{path}: {size} bytes are no whole records of {self.width}")
            found += byte_ranges(path, 0, size, self.split)
        return found

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark hands out when there are no partitions
            return
        store, _ = open_store(self.path)
        block = max(1, BLOCK_BYTES // self.width) * self.width
        with store.open_input_file(partition.path) as raw:
            raw.seek(partition.start)
            for low in range(partition.start, partition.end, block):
                data = raw.read(min(block, partition.end - low))
                if len(data) % self.width:
                    data += END
                yield decoded(data, self.features, self.digits)


class VectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixed_vectors"

    def schema(self) -> str:
        return "features array<bigint>, label int"

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options)


def read_fixed_vectors(spark: SparkSession, path: str, features: int, digits: int = 1, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(features, label) of the vectors below a path. A file of another width, or with other marks, is an error."""
    spark.dataSource.register(VectorSource)
    reader = spark.read.format("fixed_vectors").option("features", features).option("digits", digits)
    return reader.option("splitbytes", split_bytes).load(path)


def write_fixed_vectors(df: DataFrame, path: str, features: int, digits: int = 1) -> None:
    """Write (features, label) as `read_fixed_vectors` reads it.

    A vector of another length, with a null in it, or a class that is null, negative or of more digits is an error.
    """
    width = record_width(features, digits)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, labels = batch.column("features"), batch.column("label")
            if vectors.null_count or labels.null_count or vectors.flatten().null_count:
                raise ValueError("a vector to write has a null")
            label = labels.to_numpy().astype(np.int64)
            lengths = np.diff(vectors.offsets.to_numpy())
            if (lengths != features).any() or (label < 0).any() or (label >= 10**digits).any():
                raise ValueError(f"a vector to write has not {features} features and a class of {digits} digits")
            rows = np.full((len(label), width - len(END)), 32, dtype=np.uint8)
            values = np.ascontiguousarray(vectors.flatten().to_numpy().astype("<i8"))
            rows[:, : 8 * features] = values.view(np.uint8).reshape(len(label), 8 * features)
            rows[:, 8 * features + 1 :] = label[:, None] // 10 ** np.arange(digits - 1, -1, -1) % 10 + 48
            yield pa.RecordBatch.from_pydict({"raw": pa.array([row.tobytes() for row in rows], pa.binary())})

    narrow = df.select(F.col("features").cast("array<bigint>").alias("features"), F.col("label").cast("bigint").alias("label"))
    sinks.write_lines(narrow.mapInArrow(encode, "raw binary"), path, F.col("raw").cast("string"), END.decode())

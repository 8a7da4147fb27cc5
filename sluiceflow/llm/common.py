"""What the operators of this package share: small Arrow batches, written stages, names that do not clash."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructType

from sluiceflow.session import scratch_path, sized_shuffles

BATCH_ROWS = 2_000
BATCH_BYTES = 16 * 1024 * 1024
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[None]:
    """Bound what one Arrow batch of long texts takes in a Python worker."""
    before = {key: spark.conf.get(key, None) for key in (_ROWS, _BYTES)}
    spark.conf.set(_ROWS, rows)
    spark.conf.set(_BYTES, size)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def keep(df: DataFrame, label: str, rows: int = BATCH_ROWS, per_file: int = 0) -> DataFrame:
    """Write `df` once to the shared folder and go on from the files, which outlive lost executors.

    `per_file` bounds the rows of a file, where rows are large.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with sized_shuffles(df), small_batches(spark, rows):
        df.write.option("compression", "zstd").option("maxRecordsPerFile", per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def extended(df: DataFrame, **more: str | DataType) -> StructType:
    """The schema of `df` with columns added; `df.schema` itself is kept by the frame and must not change."""
    schema = StructType(list(df.schema.fields))
    for name, kind in more.items():
        schema = schema.add(name, kind)
    return schema

"""Session settings, shared scratch space and table loading."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table, in rows, that an operator may copy to every executor. Each use
# counts the table first and takes a shuffled join when there are more rows.
REPLICATE_LIMIT = 10_000
# Its largest size, as JSON text; few rows can be wide.
REPLICATE_BYTES = 64 * 1024 * 1024

INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
PARTITION_BYTES = 128 * 1024 * 1024
MAX_PARTITIONS = 50_000
# Spark gives sources of unknown size the largest number there is.
UNKNOWN_BYTES = 2**62


def build_session(app: str = "sluiceflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for.

    `master` is only for local runs; on a cluster it comes from spark-submit,
    as do executor sizes and `spark.checkpoint.dir`.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Rows can be long texts; a Python worker holds a batch at a time.
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """This application's folder on the storage all executors share.

    The cluster names that storage in `spark.checkpoint.dir`. Only on one
    machine may it be unset, as in tests: a temporary folder is then made and set.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sluiceflow-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/sluiceflow-{context.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no result is read from them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Size of the files and tables a plan reads, where Spark knows it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(size for size in sizes if size < UNKNOWN_BYTES)


@contextmanager
def sized_shuffles(df: DataFrame) -> Iterator[None]:
    """Let shuffles start with partitions in proportion to the input.

    `spark.sql.shuffle.partitions` does not grow with the data. Adaptive
    execution joins small partitions again, so starting with many is safe.
    """
    spark = df.sparkSession
    key = INITIAL_PARTITIONS if spark.conf.get(INITIAL_PARTITIONS, None) else "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    wanted = min(input_bytes(df) // PARTITION_BYTES, MAX_PARTITIONS)
    if wanted <= int(before):
        yield
        return
    spark.conf.set(key, wanted)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def batch_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Let Python workers get at most `rows` rows at a time; None leaves that to the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    if rows is not None:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        if rows is not None:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, label: str = "stage", rows: int | None = None) -> DataFrame:
    """Write `df` once to shared storage and continue from the written table.

    Used where a later step needs a value that recomputation could change, such
    as a partition number, or where one result feeds several branches. The
    files outlive lost executors. `rows` bounds the batches of Python functions in the plan, where rows are long texts.
    """
    path = scratch_path(df.sparkSession, label)
    with sized_shuffles(df), batch_rows(df.sparkSession, rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Share rows that are costly to process among all cores when the files give fewer splits than that.

    A table of many files or row groups is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few constant rows, as an expression of the plan."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [part.split()[1] for part in schema.split(", ")]
    items = [F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(row, kinds, names)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*items)))


def at_most(df: DataFrame, limit: int = REPLICATE_LIMIT, size: int = REPLICATE_BYTES) -> bool:
    """Whether `df` has at most `limit` rows and `size` bytes; reads no more than limit + 1 rows."""
    wide = F.length(F.to_json(F.struct(*[df[c] for c in df.columns])))
    rows, held = df.limit(limit + 1).select(wide.alias("n")).agg(F.count("*"), F.sum("n")).first()
    return rows <= limit and (held or 0) <= size

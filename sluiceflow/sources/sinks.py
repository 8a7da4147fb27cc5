"""Writers: by bin, by record count, as lines, and at most once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def write_binned(df: DataFrame, path: str, bin_column: str, compression: str = "zstd") -> None:
    """One folder per bin. Rows already sorted keep their order within each task's file."""
    df.write.option("compression", compression).partitionBy(bin_column).parquet(path)


def write_chunks(df: DataFrame, path: str, records: int, kind: str = "parquet") -> None:
    """Files of at most `records` rows."""
    df.write.option("maxRecordsPerFile", records).format(kind).save(path)


def write_lines(df: DataFrame, path: str, line: Column, separator: str = "\n") -> None:
    df.select(line.alias("value")).write.option("lineSep", separator).text(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a run has finished writing this output; a dead run leaves no mark of success."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def write_once(df: DataFrame, path: str) -> None:
    """Write unless an earlier run has already finished this output; what a dead run left is replaced."""
    if not is_complete(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)


def export_ordered(df: DataFrame, path: str, *order_by: str, header: bool = True, sep: str = "\t") -> None:
    """Text files whose name order is the row order; no task holds more than its range."""
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    ranged.write.option("header", header).option("sep", sep).csv(path)

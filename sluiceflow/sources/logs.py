"""Readers of run logs, profiles, scores and other log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceflow.functions.text import parse_key
from sluiceflow.sources.records import read_lines

PAYLOAD = "struct<key:string, bin:int, num_bins:int, file_id:int, num_files:int>"
RUN_LOG = (
    "name string, start_time double, duration double, read_count bigint, write_count bigint, list_count bigint, "
    f"read_byte_count bigint, write_byte_count bigint, invoke boolean, path string, payloads array<{PAYLOAD}>"
)


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Run logs with the parsed key of the object each belongs to.

    The key is the log's `path` where it names one, else the log file's own path.
    """
    logs = spark.read.schema(RUN_LOG).option("recursiveFileLookup", True).json(path)
    file_key = F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+/[^/]+/[^/]+)$", 1)
    end = F.col("start_time") + F.col("duration") / 1000.0
    return logs.select("*", end.alias("end_time"), parse_key(F.coalesce("path", file_key)).alias("key"))


def children(logs: DataFrame, parent: str = "name") -> DataFrame:
    """One row per (parent task, child task) from the payloads of the logs."""
    return logs.select(F.col(parent).alias("parent"), F.inline("payloads"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile runs; rows whose numbers do not parse are left out."""
    names = "name string, size string, region string, split_size string, memory string, duration string, cost string"
    raw = spark.read.csv(path, schema=names, header=True)
    numbers = {"size": "bigint", "split_size": "bigint", "memory": "int", "duration": "double", "cost": "double"}
    parsed = [F.col(c).try_cast(numbers[c]).alias(c) if c in numbers else F.col(c) for c in raw.columns]
    return raw.select(*parsed).dropna(subset=list(numbers))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(path, species, score, cost): score rows, an empty score being 0; the `Cost` row has the cost instead.

    A score may be large or have decimals; one that is not a number is null.
    """
    cut = F.split("value", ",")
    value = F.nullif(F.trim(F.get(cut, 1)), F.lit(""))
    is_cost = F.col("species") == "Cost"
    rows = spark.read.text(path).where(F.col("value").contains(",")).select(
        F.col("_metadata.file_path").alias("path"), cut[0].alias("species"), value.alias("v")
    )
    return rows.where(F.col("species") != "species").select(
        "path", "species",
        F.when(~is_cost, F.when(F.col("v").isNull(), F.lit(0.0)).otherwise(F.col("v").try_cast("double"))).alias("score"),
        F.when(is_cost, F.col("v").try_cast("double")).alias("cost"),
    )


def read_score_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(file, species, score, cost): a wide table with a column per file, a `Cost` row and a row per species.

    Files are named by what follows the first slash of a column's name. A blank
    score is 0; the cost row has the cost instead of a score.
    """
    wide = spark.read.csv(path, header=True)
    first, files = wide.columns[0], wide.columns[1:]
    long = wide.select(F.col(f"`{first}`").alias("species"), F.explode(F.array(*[
        F.struct(F.lit(f.split("/", 1)[-1]).alias("file"), F.trim(F.col(f"`{f}`")).alias("value")) for f in files
    ])).alias("cell"))
    value, is_cost = F.nullif(F.col("cell.value"), F.lit("")), F.lower("species") == "cost"
    return long.select(
        "cell.file", "species", F.when(~is_cost, F.when(value.isNull(), F.lit(0.0)).otherwise(value.try_cast("double"))).alias("score"),
        F.when(is_cost, value.try_cast("double")).alias("cost"),
    )


def write_score_files(scores: DataFrame, path: str) -> None:
    """A folder `file=…` per file with `species,score` lines and its `Cost` line, as `read_scores` reads them."""
    shown = F.coalesce("cost", "score")
    text = F.when(shown == F.floor(shown), shown.cast("bigint").cast("string")).otherwise(shown.cast("string"))
    scores.select("file", F.concat_ws(",", "species", text).alias("value")).write.partitionBy("file").text(path)


def read_access(spark: SparkSession, path: str, column: int = 6) -> DataFrame:
    """(at): the timestamps of an access log, leaving out rows that lack a date or a time."""
    names = ", ".join(f"c{i} string" for i in range(column + 1))
    stamp = F.trim(F.col(f"c{column}"))
    full = F.when(stamp.rlike(r"^\S+ \S+$"), stamp)
    return spark.read.csv(path, schema=names, header=True).select(full.try_cast("timestamp").alias("at")).where("at IS NOT NULL")


def _number(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("double")


def read_memory_reports(spark: SparkSession, path: str) -> DataFrame:
    """(start_time, end_time, used, total) from JSON log events; the start is the end less the duration."""
    events = spark.read.schema("timestamp bigint, message string").json(path).where(F.col("message").contains("Max Memory Used"))
    message = F.col("message")
    end = F.col("timestamp") / 1000.0
    return events.select(
        (end - _number(message, r"Duration:\s([0-9.]+)") / 1000.0).alias("start_time"),
        end.alias("end_time"),
        _number(message, r"Max Memory Used: ([0-9]+)").cast("bigint").alias("used"),
        _number(message, r"Memory Size: ([0-9]+)").cast("bigint").alias("total"),
    )


# The labels of the marker lines.
TASK_MARKERS = {"s3_created": "S3 CREATED TIME", "start": "EXECUTION START TIME", "end": "EXECUTION END TIME"}
NODE_MARKERS = {"start": "NODE START TIME", "end": "NODE END TIME"}


def read_markers(spark: SparkSession, path: str, markers: dict[str, str] | None = None) -> DataFrame:
    """(path, one column per marker): the labelled times of each task's log file."""
    wanted = markers or TASK_MARKERS
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    times = [_number(F.col("value"), label + r": ([0-9.]+)").alias(name) for name, label in wanted.items()]
    return files.select(F.col("_metadata.file_path").alias("path"), *times)


def read_incorrect(spark: SparkSession, path: str) -> DataFrame:
    """(pxd, run, path, file, expected, actual) of each misclassified run."""
    cut = F.split(F.rtrim("value"), "Incorrect |Expected |Actual ")
    place = cut[1]
    folder = F.regexp_replace(place, "/[^/]*$", "")
    return read_lines(spark, path).where(F.col("value").contains("Incorrect ")).select(
        F.regexp_extract(folder, r"(PXD[0-9]+)", 1).alias("pxd"),
        F.get(F.split(place, "/"), 1).alias("run"),
        place.alias("path"),
        F.regexp_extract(place, "([^/]*)$", 1).alias("file"),
        cut[2].alias("expected"),
        cut[3].alias("actual"),
    )

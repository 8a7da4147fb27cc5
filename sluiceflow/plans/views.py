"""Views of the test tables that several queries share, in Spark and in SQL.

Times are whole microseconds, so that grouping by time and adding durations is
exact in both engines; only results are turned into seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceflow.functions.costs import MEMORY_PRICES, STAGE_MEMORY
from sluiceflow.session import load, spread

SECOND = 1_000_000

TASKLOG = """tasklog AS (
  SELECT event_id, user_id AS token, event_type AS stage, epoch_us(ts) AS start_us,
         CAST(round(value * 1000) AS BIGINT) AS dur_ms,
         epoch_us(ts) + CAST(round(value * 1000) AS BIGINT) * 1000 AS end_us
  FROM events)"""

PRICES = (
    "price(memory, rate) AS (VALUES "
    + ", ".join(f"({m}, CAST({p} AS DOUBLE))" for m, p in MEMORY_PRICES.items())
    + "), stage_memory(stage, memory) AS (VALUES "
    + ", ".join(f"('{s}', {m})" for s, m in STAGE_MEMORY.items())
    + ")"
)

GRID = """grid AS (
  SELECT CAST(vec_id % 25 AS BIGINT) AS x, CAST(vec_id // 25 AS BIGINT) AS y, CAST(label % 3 AS INTEGER) AS cls
  FROM embeddings)"""

# Read-like text: the letters of a document that name bases.
READS = """reads AS (
  SELECT doc_id, seq FROM (
    SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents)
  WHERE length(seq) >= 8)"""

SCORES = """score AS (
  SELECT CAST(l_suppkey % 20 AS BIGINT) AS file, l_returnflag AS species,
         count(*) FILTER (WHERE l_discount <= 0.01) AS n
  FROM lineitem GROUP BY 1, 2)"""


def tasklog(spark: SparkSession, directory: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    dur = F.round(F.col("value") * 1000).cast("bigint")
    return load(spark, directory, "events").select(
        "event_id",
        F.col("user_id").alias("token"),
        F.col("event_type").alias("stage"),
        start.alias("start_us"),
        dur.alias("dur_ms"),
        (start + dur * 1000).alias("end_us"),
    )


def grid(spark: SparkSession, directory: str) -> DataFrame:
    return load(spark, directory, "embeddings").select(
        (F.col("vec_id") % 25).alias("x"),
        F.expr("vec_id div 25").alias("y"),
        (F.col("label") % 3).cast("int").alias("cls"),
    )


def reads(spark: SparkSession, directory: str) -> DataFrame:
    seq = F.upper(F.regexp_replace("text", "[^ACGTacgt]+", ""))
    documents = spread(load(spark, directory, "documents").select("doc_id", "text"), "doc_id")
    return documents.select("doc_id", seq.alias("seq")).where(F.length("seq") >= 8)


def scores(spark: SparkSession, directory: str) -> DataFrame:
    return (
        load(spark, directory, "lineitem")
        .groupBy((F.col("l_suppkey") % 20).alias("file"), F.col("l_returnflag").alias("species"))
        .agg(F.count_if(F.col("l_discount") <= 0.01).alias("n"))
    )

"""Queries for the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluiceflow.functions import text as fn
from sluiceflow.plans.catalog import query
from sluiceflow.session import load

KEY_SQL = """'0/' || printf('%.6f', o_totalprice) || '-' || o_orderkey || '/' || (o_orderkey % 13) || '-13/' || (o_custkey % 4 + 1) || '-0.000000-4-'
    || lower(replace(replace(o_orderpriority, '-', ''), ' ', '')) || '.txt'"""


@query("key_roundtrip", f"""
SELECT o_orderkey AS nonce, {KEY_SQL} AS key, o_totalprice AS "timestamp", CAST(o_orderkey % 13 AS INTEGER) AS bin, CAST(o_custkey % 4 + 1 AS INTEGER) AS file_id,
       lower(replace(replace(o_orderpriority, '-', ''), ' ', '')) AS suffix, 'txt' AS ext, TRUE AS same FROM orders""")
def key_roundtrip(spark, d):
    """Build a key name, parse it, and build it again."""
    fields = F.struct(
        F.lit(0).alias("prefix"), F.col("o_totalprice").alias("timestamp"), F.col("o_orderkey").alias("nonce"),
        (F.col("o_orderkey") % 13).alias("bin"), F.lit(13).alias("num_bins"), (F.col("o_custkey") % 4 + 1).alias("file_id"),
        F.lit(None).cast("double").alias("execute"), F.lit(4).alias("num_files"),
        F.lower(F.regexp_replace("o_orderpriority", "[- ]", "")).alias("suffix"), F.lit("txt").alias("ext"),
    )
    named = load(spark, d, "orders").select(fn.format_key(fields).alias("key"))
    parsed = named.withColumn("p", fn.parse_key(F.col("key")))
    return parsed.select(
        F.col("p.nonce").cast("bigint").alias("nonce"), "key", F.col("p.timestamp").alias("timestamp"), F.col("p.bin").alias("bin"),
        F.col("p.file_id").alias("file_id"), F.col("p.suffix").alias("suffix"), F.col("p.ext").alias("ext"),
        (fn.format_key(F.col("p")) == F.col("key")).alias("same"),
    )


@query("align_score", """
SELECT p_partkey, CAST(p_partkey * 1000 + CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size END AS DOUBLE) AS score FROM part""")
def align_score(spark, d):
    head = F.format_string("target_name: %d\nquery_name: q\noptimal_alignment_score: %d", "p_partkey", "p_partkey")
    tail = F.when(F.col("p_size") % 2 != 0, F.format_string(" suboptimal_alignment_score: %d", "p_size")).otherwise(F.lit(""))
    return load(spark, d, "part").select("p_partkey", fn.align_score(F.concat(head, tail)).alias("score"))


@query("elapsed_label", """
SELECT event_id, printf('01/%02d %02d:%02d', s // 86400 + 1, s // 3600 % 24, s // 60 % 60) AS label
FROM (SELECT event_id, (epoch_us(ts) - 1704067200000000) // 1000000 AS s FROM events)""")
def elapsed_label(spark, d):
    seconds = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000) / 1_000_000)
    return load(spark, d, "events").select("event_id", fn.elapsed_label(seconds).alias("label"))


SIZED = "(SELECT doc_id, CAST(n_chars * (doc_id + 1) * (doc_id + 1) AS DOUBLE) AS v FROM documents)"


@query("size_label", f"""
SELECT doc_id, CASE WHEN v > 1073741824 THEN printf('%.2fGB', v / 1073741824) WHEN v > 1048576 THEN printf('%.2fMB', v / 1048576)
  WHEN v > 1024 THEN printf('%.2fKB', v / 1024) ELSE printf('%.2fB', v) END AS label FROM {SIZED}""")
def size_label(spark, d):
    size = (F.col("n_chars") * (F.col("doc_id") + 1) * (F.col("doc_id") + 1)).cast("double")
    return load(spark, d, "documents").select("doc_id", fn.size_label(size).alias("label"))


@query("checksum", "SELECT doc_id, sha1(text) AS checksum FROM documents")
def checksum(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("checksum"))


@query("json_props", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, d):
    """Decode, encode and decode again before adding up."""
    decoded = F.from_json("props", "k bigint")
    again = F.from_json(F.to_json(decoded), "k bigint")
    return load(spark, d, "events").groupBy("event_type").agg(F.sum(again["k"]).alias("k"), F.count(F.lit(1)).alias("n"))


@query("regex_extract", """
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '/([0-9]+)', 1) AS number,
       CAST(length(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '[^/]', '', 'g')) AS INTEGER) AS depth FROM pages""")
def regex_extract(spark, d):
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)
    return load(spark, d, "pages").select(
        "page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "/([0-9]+)", 1).alias("number"),
        F.length(F.regexp_replace(path, "[^/]", "")).alias("depth"),
    )


@query("list_folders", "SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS folder FROM pages ORDER BY folder")
def list_folders(spark, d):
    folder = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return load(spark, d, "pages").select(folder.alias("folder")).distinct().orderBy("folder")

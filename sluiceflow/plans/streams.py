"""Queries that stream a table through the arrival-driven stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluiceflow.plans.catalog import query
from sluiceflow.plans.views import READS, reads
from sluiceflow.session import load, materialize, scratch_path
from sluiceflow.sources import records, sinks
from sluiceflow.sources.arrivals import record_arrivals
from sluiceflow.streaming import flows

DAYS_NEEDED = 10
TIMEOUT_US = 60_000_000_000
# Rows may come this long after later ones; groups that are silent longer than a week are forgotten.
LATENESS = "1 hour"
LATENESS_US = 3_600_000_000
TTL_MS = 7 * 24 * 3_600_000


def event_stream(spark, d):
    """The table as one arrival; a table's files have no order of time."""
    schema = load(spark, d, "events").schema
    return flows.table_arrivals(spark, f"{d}/events.parquet", schema).withColumn("at", F.col("ts").cast("timestamp"))


@query("stream_ingest", "SELECT event_id, user_id, event_type, value FROM events")
def stream_ingest(spark, d):
    return flows.drain(event_stream(spark, d).select("event_id", "user_id", "event_type", "value"), "ingest")


@query("stream_chain", """
SELECT event_id, user_id % 10 AS shard, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, round(value * 2, 4) AS doubled
FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50""")
def stream_chain(spark, d):
    """Stages one after another on the arriving rows: decode, filter, compute."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    stream = (
        event_stream(spark, d)
        .transform(lambda s: s.withColumn("k", k))
        .transform(lambda s: s.where(F.col("k") >= 50))
        .transform(lambda s: s.select("event_id", (F.col("user_id") % 10).alias("shard"), "k", F.round(F.col("value") * 2, 4).alias("doubled")))
    )
    return flows.drain(stream, "chain")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    stream = flows.deduplicated(event_stream(spark, d).select("user_id", "event_type"), ["user_id", "event_type"])
    return flows.drain(stream, "dedup")


@query("stream_deadline", "SELECT event_id, value FROM events WHERE value - 10 <= 0 OR 100 < value - 10")
def stream_deadline(spark, d):
    kept = flows.before_deadline(event_stream(spark, d), F.lit(1), F.col("value") - 10, F.lit(100))
    return flows.drain(kept.select("event_id", "value"), "deadline")


RELEASED = "SELECT user_id, CAST(count(DISTINCT event_type) AS INTEGER) AS members FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 5"


@query("stream_barrier", RELEASED)
def stream_barrier(spark, d):
    """Users are let through once all five event types have been seen."""
    return flows.drain(flows.barrier(event_stream(spark, d), ["user_id"], F.col("event_type"), F.lit(5), "at", LATENESS, TTL_MS), "barrier")


@query("stream_stage_complete", f"""
SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING count(DISTINCT CAST(ts AS DATE)) >= {DAYS_NEEDED}""")
def stream_stage_complete(spark, d):
    """A (user, type) is complete when it has been active on ten distinct days."""
    done = flows.barrier(event_stream(spark, d), ["user_id", "event_type"], F.to_date("at"), F.lit(DAYS_NEEDED), "at", LATENESS, TTL_MS)
    return flows.drain(done.drop("members"), "complete")


@query("stream_overdue", f"""
SELECT user_id, since_us FROM (
  SELECT user_id, event_type, epoch_us(ts) AS since_us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS next_us, (SELECT max(epoch_us(ts)) FROM events) AS top_us FROM events)
WHERE event_type = 'signup' AND since_us + {TIMEOUT_US + LATENESS_US} <= top_us AND (next_us IS NULL OR next_us - since_us >= {TIMEOUT_US})""")
def stream_overdue(spark, d):
    late = flows.overdue(event_stream(spark, d), "user_id", "at", F.col("event_type") == "signup", "60000 seconds", LATENESS)
    return flows.drain(late.select("user_id", F.unix_micros("since").alias("since_us")), "overdue")


@query("stream_utilisation", f"""
SELECT CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS hour, round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS cpu,
       round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS memory,
       round(greatest(avg(value) FILTER (WHERE event_type = 'view'), avg(value) FILTER (WHERE event_type = 'click')), 6) AS busiest
FROM events WHERE epoch_us(ts) // 3600000000 < (SELECT (max(epoch_us(ts)) - {LATENESS_US}) // 3600000000 FROM events) GROUP BY 1""")
def stream_utilisation(spark, d):
    """Hourly means of closed hours; late rows may still come for the last two."""
    kind, value = F.col("event_type"), F.col("value")
    means = flows.utilisation(event_stream(spark, d), "at", F.when(kind == "view", value), F.when(kind == "click", value), "1 hour", LATENESS)
    hour = F.floor(F.unix_micros("begin") / 3_600_000_000).cast("bigint")
    return flows.drain(
        means.select(hour.alias("hour"), *[F.round(c, 6).alias(c) for c in ("cpu", "memory", "busiest")]), "utilisation"
    )


@query("stream_initiate", f"WITH r AS ({RELEASED}) SELECT user_id, min_by(event_id, ts) AS event_id FROM events JOIN r USING (user_id) GROUP BY 1")
def stream_initiate(spark, d):
    """When a user's barrier opens, the user's first event is taken up again."""
    # Written once, as every batch joins it.
    first = materialize(load(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", "ts").alias("event_id")), "first")
    released = flows.barrier(event_stream(spark, d), ["user_id"], F.col("event_type"), F.lit(5), "at", LATENESS, TTL_MS)
    path = scratch_path(spark, "next-run")
    flows.drain_each(released, flows.initiate(first, ["user_id"], path), "initiate")
    return spark.read.schema("user_id bigint, event_id bigint").parquet(path).select("user_id", "event_id")


SILENT_MS = 3_000


@query("stream_silent_starts", """
SELECT user_id, max(epoch_us(ts)) AS since_us FROM events GROUP BY user_id
HAVING arg_max(event_type, struct_pack(ts := ts, start := event_type = 'signup')) = 'signup'""")
def stream_silent_starts(spark, d):
    """Users whose last event is a signup, told by timers once nothing arrives any more."""
    stream = flows.silent_starts(event_stream(spark, d), "user_id", "at", F.col("event_type") == "signup", SILENT_MS)
    found = flows.drain_silence(stream, 2 * SILENT_MS, "silent-starts")
    return found.select("user_id", F.unix_micros("since").alias("since_us"))


@query("stream_replay", """
WITH first AS (
  SELECT user_id, min_by(CAST(json_extract_string(props, '$.k') AS BIGINT), struct_pack(ts := ts, k := CAST(json_extract_string(props, '$.k') AS BIGINT))) AS k
  FROM events GROUP BY user_id),
child AS (SELECT user_id, unnest(['run-' || k, 'merge-' || k // 10]) AS payload FROM first)
SELECT user_id, payload, count(*) AS sends, CAST(1 AS BIGINT) AS first_sends FROM child JOIN events USING (user_id) GROUP BY 1, 2""")
def stream_replay(spark, d):
    """A user's first event makes two payloads, which every further event of that user sends again."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    made = F.array(F.concat(F.lit("run-"), k), F.concat(F.lit("merge-"), F.floor(k / 10)))
    sent = flows.drain(flows.replayed(event_stream(spark, d), ["user_id"], "at", made), "replay")
    return sent.groupBy("user_id", "payload").agg(F.sum("sends").alias("sends"), F.sum("first_sends").alias("first_sends"))


@query("stream_reads", f"""WITH {READS}
SELECT CAST(doc_id AS VARCHAR) AS id, md5(seq) AS seq, CAST(length(seq) AS INTEGER) AS n FROM reads""")
def stream_reads(spark, d):
    """Reads that arrive as FASTQ files, taken in some eight batches whatever their size, with batches ending inside files."""
    folder = scratch_path(spark, "arriving")
    sinks.write_lines(reads(spark, d), folder, F.concat_ws("\n", F.concat(F.lit("@"), "doc_id"), "seq", F.lit("+"), F.translate("seq", "ACGT", "@I;+")))
    size = records.list_objects(spark, folder).agg(F.sum("length")).first()[0] or 0
    stream = record_arrivals(spark, "fastq", folder, scratch_path(spark, "log"), batch_bytes=size // 8 + 1)
    return flows.drain_batches(stream.select("id", F.md5(F.col("seq").cast("binary")).alias("seq"), F.length("seq").alias("n")), "reads")


@query("stream_spectra", """
SELECT event_id AS scan, value AS mass FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0""")
def stream_spectra(spark, d):
    """Spectra that arrive as mzML text, those of level 2 parsed batch by batch."""
    level = 2 - F.get_json_object("props", "$.k").cast("bigint") % 2
    spectrum = F.format_string(
        '<spectrum id="scan=%d" index="%d"><cvParam name="ms level" value="%d"/><cvParam name="base peak m/z" value="%s"/></spectrum>',
        "event_id", "event_id", level, F.col("value").cast("string"),
    )
    folder = scratch_path(spark, "arriving")
    sinks.write_lines(load(spark, d, "events"), folder, spectrum)
    size = records.list_objects(spark, folder).agg(F.sum("length")).first()[0] or 0
    stream = record_arrivals(spark, "mzML", folder, scratch_path(spark, "log"), batch_bytes=size // 8 + 1)
    found = records.parsed_spectra(stream)
    peak = F.filter("cvParam", lambda p: p["_name"] == "base peak m/z")[0]["_value"].cast("double")
    return flows.drain_batches(found.select(F.col("_index").alias("scan"), peak.alias("mass")), "spectra")

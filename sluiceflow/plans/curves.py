"""Queries for curves over time and distributions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sluiceflow.functions import costs
from sluiceflow.operators import curves
from sluiceflow.operators.ordered import Ordered, numbered
from sluiceflow.operators.reports import with_totals
from sluiceflow.plans.catalog import query
from sluiceflow.plans.reports import COST, COST_SUM, PRICED, priced
from sluiceflow.plans.views import SECOND, TASKLOG, tasklog
from sluiceflow.session import load

TEN_SECONDS = 10 * SECOND


def _curve_sql(source: str, by: str = "", weight: str = "CAST(1 AS BIGINT)", start: str = "start_us", end: str = "end_us") -> str:
    """Net change per time and its running sum, as CTEs `delta` and `curve`."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""delta AS (SELECT {keys}t, sum(d) AS delta FROM (
    SELECT {keys}{start} AS t, {weight} AS d FROM {source} UNION ALL SELECT {keys}{end}, -({weight}) FROM {source}) GROUP BY {keys}t),
  curve AS (SELECT {keys}t, delta, sum(delta) OVER ({part}ORDER BY t) AS active FROM delta)"""


PLAIN = f"WITH {TASKLOG}, {_curve_sql('tasklog')}"
BY_STAGE = f"WITH {TASKLOG}, {_curve_sql('tasklog', 'stage')}"


@query("concurrency", f"{PLAIN} SELECT t, CAST(delta AS BIGINT) AS delta, CAST(active AS BIGINT) AS active FROM curve")
def concurrency(spark, d):
    return curves.concurrency(tasklog(spark, d))


@query("peak_concurrency", f"{PLAIN} SELECT CAST(max(active) AS BIGINT) AS peak FROM curve")
def peak_concurrency(spark, d):
    return curves.concurrency(tasklog(spark, d)).agg(F.max("active").alias("peak"))


@query("vcpu_curve", f"WITH {PRICED}, {_curve_sql('priced', weight='CAST(memory AS BIGINT)')} SELECT t, round(CAST(active AS DOUBLE) * 2 / 3008, 6) AS active FROM curve")
def vcpu_curve(spark, d):
    """Whole megabytes are summed, so the running total is exact; only the result is scaled."""
    curve = curves.concurrency(priced(spark, d), weight=F.col("memory").cast("bigint"))
    return curve.select("t", F.round(costs.virtual_cpus(F.col("active")), 6).alias("active"))


@query("stage_concurrency", f"{BY_STAGE} SELECT stage, t, CAST(active AS BIGINT) AS active FROM curve")
def stage_concurrency(spark, d):
    return curves.concurrency(tasklog(spark, d), by=["stage"]).drop("delta")


@query("three_curves", f"""WITH {TASKLOG}, kinds AS (
  SELECT 'pending' AS kind, start_us AS s, start_us + {TEN_SECONDS} AS e FROM tasklog
  UNION ALL SELECT 'active', start_us + {TEN_SECONDS}, end_us + {TEN_SECONDS} FROM tasklog
  UNION ALL SELECT 'total', start_us, end_us + {TEN_SECONDS} FROM tasklog),
{_curve_sql('kinds', 'kind', start='s', end='e')} SELECT kind, t, CAST(active AS BIGINT) AS active FROM curve""")
def three_curves(spark, d):
    """Pending, running and all tasks, from one pass over the log."""
    start, end = F.col("start_us"), F.col("end_us")

    def interval(kind, begin, finish):
        return F.struct(F.lit(kind).alias("kind"), begin.alias("start_us"), finish.alias("end_us"))

    intervals = F.array(
        interval("pending", start, start + TEN_SECONDS),
        interval("active", start + TEN_SECONDS, end + TEN_SECONDS),
        interval("total", start, end + TEN_SECONDS),
    )
    kinds = tasklog(spark, d).select(F.inline(intervals))
    return curves.concurrency(kinds, by=["kind"]).drop("delta")


@query("step_points", f"""{PLAIN} SELECT t - {SECOND} AS t, CAST(active - delta AS BIGINT) AS active, 0 AS side FROM curve
UNION ALL SELECT t, CAST(active AS BIGINT), 1 FROM curve""")
def step_points(spark, d):
    return curves.step_points(curves.concurrency(tasklog(spark, d)), SECOND)


HOUR = 3600 * SECOND


@query("gap_fill", f"""{BY_STAGE}
SELECT stage, unnest(range(t, greatest(until, t + 1), {HOUR})) AS t, CAST(active AS BIGINT) AS active
FROM (SELECT *, coalesce(lead(t) OVER (PARTITION BY stage ORDER BY t), t + 1) AS until FROM curve)""")
def gap_fill(spark, d):
    return curves.fill_gaps(curves.concurrency(tasklog(spark, d), by=["stage"]), HOUR, ["stage"])


AGAIN = "event_id % 7 = 0"


@query("finished_curve", f"""WITH {TASKLOG}, due AS (SELECT {AGAIN} AS again, end_us AS t, count(*) AS amount FROM tasklog GROUP BY 1, 2)
SELECT again, t, amount, CAST(sum(amount) OVER (PARTITION BY again ORDER BY t) AS BIGINT) AS total FROM due""")
def finished_curve(spark, d):
    log = tasklog(spark, d).withColumn("again", F.expr(AGAIN))
    return curves.cumulative(log, "end_us", F.lit(1).cast("bigint"), ["again"])


SPEND = f"""{PRICED}, due AS (SELECT end_us AS t, sum({COST.format('(dur_ms + 99) // 100')}) AS amount FROM priced GROUP BY 1),
spent AS (SELECT t, sum(amount) OVER (ORDER BY t) AS total, (t - (SELECT min(start_us) FROM tasklog)) / 1e6 AS elapsed FROM due)"""


@query("cumulative_cost", f"WITH {SPEND} SELECT t, CAST(total AS DOUBLE) AS cost, round(elapsed * 4.256 / 3600, 6) AS machine_cost FROM spent")
def cumulative_cost(spark, d):
    log = priced(spark, d)
    begin = tasklog(spark, d).agg(F.min("start_us")).first()[0]
    spent = curves.cumulative(log, "end_us", costs.compute_cost(F.col("dur_ms"), F.col("rate")))
    elapsed = (F.col("t") - F.lit(begin)) / SECOND
    return spent.select("t", F.col("total").cast("double").alias("cost"), F.round(costs.machine_cost(elapsed), 6).alias("machine_cost"))


@query("ecdf", """
SELECT l_quantity AS value, count(*) AS n, round(sum(count(*)) OVER (ORDER BY l_quantity) / (SELECT count(*) FROM lineitem), 9) AS share
FROM lineitem GROUP BY 1""")
def ecdf(spark, d):
    table = curves.ecdf(load(spark, d, "lineitem"), F.col("l_quantity"))
    return table.withColumn("share", F.round("share", 9))


PDF = f"exp(-((edge - mean) * (edge - mean)) / (2 * std * std)) / (std * {math.sqrt(2 * math.pi)!r})"


@query("normal_cdf", f"""
WITH s AS (SELECT avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders),
e AS (SELECT i, low + (high - low) / 10.0 * i AS edge, mean, std FROM s CROSS JOIN (SELECT unnest(range(11)) AS i)),
p AS (SELECT i, edge, {PDF} AS pdf FROM e)
SELECT CAST(i AS INTEGER) AS i, round(edge, 4) AS edge, round(sum(pdf) OVER (ORDER BY i) / (SELECT sum(pdf) FROM p), 9) AS cdf FROM p""")
def normal_cdf(spark, d):
    return curves.normal_cdf(load(spark, d, "orders"), F.col("o_totalprice"), 11).select(
        "i", F.round("edge", 4).alias("edge"), F.round("cdf", 9).alias("cdf")
    )


ORIGIN = 1_704_067_200 * SECOND


@query("deltas", f"""
SELECT event_id, CAST(us - coalesce(lag(us) OVER (ORDER BY us, event_id), {ORIGIN}) AS BIGINT) AS delta_us FROM (SELECT event_id, epoch_us(ts) AS us FROM events)""")
def deltas(spark, d):
    """Time since the event before; the first counts from the start of the run."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    events = load(spark, d, "events").select("event_id", at.alias("at"))
    placed = Ordered(events, ["at", "event_id"]).extend(lag={"before": F.col("at")})
    return placed.select("event_id", (F.col("at") - F.coalesce("before", F.lit(ORIGIN))).alias("delta_us"))


@query("relative_time", "SELECT event_id, round((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1e6, 6) AS t_s FROM events")
def relative_time(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    events = load(spark, d, "events").select("event_id", at.alias("at"))
    first = events.agg(F.min("at")).first()[0]
    return events.select("event_id", F.round((F.col("at") - F.lit(first)) / SECOND, 6).alias("t_s"))


@query("chunk_numbers", """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS file_id, count(*) OVER (PARTITION BY user_id) AS num_files FROM events""")
def chunk_numbers(spark, d):
    events = load(spark, d, "events").select("event_id", "user_id", "ts")
    return numbered(events, ["ts", "event_id"], "file_id", ["user_id"], total="num_files").drop("ts")


@query("pipe_cost_report", f"""WITH {SPEND}, {_curve_sql('tasklog')},
{_curve_sql('tasklog', 'stage').replace('delta AS', 'stage_delta AS').replace('curve AS', 'stage_curve AS').replace('FROM delta)', 'FROM stage_delta)')},
r AS (SELECT coalesce(stage, 'total') AS stage, count(*) AS n, round(count(*) * 2 / 1000.0 * 0.005 + count(*) / 1000.0 * 0.0004, 6) AS request_cost,
        {COST_SUM.format('(dur_ms + 99) // 100')} AS compute_cost, round((max(end_us) - min(start_us)) / 1e6, 6) AS makespan_s
      FROM priced GROUP BY GROUPING SETS ((stage), ())),
m AS (SELECT stage, max(active) AS peak FROM stage_curve GROUP BY 1 UNION ALL SELECT 'total', max(active) FROM curve)
SELECT r.*, CAST(peak AS BIGINT) AS peak, round(makespan_s * 4.256 / 3600, 6) AS machine_cost FROM r JOIN m ON r.stage = m.stage""")
def pipe_cost_report(spark, d):
    """Cost and runtime per stage and in total: requests, compute, makespan, peak, and a rented machine's price."""
    log = priced(spark, d)
    n = F.count(F.lit(1))
    table = with_totals(
        log, "stage", n.alias("n"), F.round(costs.request_cost(n, n, n), 6).alias("request_cost"),
        F.sum(costs.compute_cost(F.col("dur_ms"), F.col("rate"))).cast("double").alias("compute_cost"),
        F.round((F.max("end_us") - F.min("start_us")) / SECOND, 6).alias("makespan_s"),
    )
    doubled = log.select(
        F.explode(F.array(F.col("stage"), F.lit("total"))).alias("stage"), "start_us", "end_us"
    )
    peaks = curves.concurrency(doubled, by=["stage"]).groupBy("stage").agg(F.max("active").alias("peak"))
    # One row per stage on both sides.
    return table.join(peaks, "stage").withColumn("machine_cost", F.round(costs.machine_cost(F.col("makespan_s")), 6))

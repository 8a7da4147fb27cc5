"""Queries for scores, costs, averages and other aggregate reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluiceflow.functions import costs
from sluiceflow.operators import curves, reports as rep, verbs as op
from sluiceflow.plans.catalog import query
from sluiceflow.plans.views import PRICES, SCORES, SECOND, TASKLOG, scores, tasklog
from sluiceflow.session import load, materialize, small_table

# The thresholds of the accuracy sweep.
THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 15)]
SCORE_SCALE = 200.0


@query("score_per_group", "SELECT l_suppkey, count(*) FILTER (WHERE l_discount <= 0.01) AS score FROM lineitem GROUP BY 1")
def score_per_group(spark, d):
    return load(spark, d, "lineitem").groupBy("l_suppkey").agg(rep.hits("l_discount").alias("score"))


@query("fraction", """
SELECT l_suppkey, count(*) FILTER (WHERE l_discount <= 0.01) AS score, count(*) AS total,
       round(count(*) FILTER (WHERE l_discount <= 0.01) / count(*), 6) AS ratio FROM lineitem GROUP BY 1""")
def fraction(spark, d):
    counted = load(spark, d, "lineitem").groupBy("l_suppkey").agg(
        rep.hits("l_discount").alias("score"), F.count(F.lit(1)).alias("total")
    )
    return counted.withColumn("ratio", F.round(F.col("score") / F.col("total"), 6))


@query("stage_rollup", f"""WITH {TASKLOG}
SELECT coalesce(stage, 'total') AS stage, count(*) AS n, CAST(sum(dur_ms) AS BIGINT) AS dur_ms, min(start_us) AS first_us, max(end_us) AS last_us
FROM tasklog GROUP BY GROUPING SETS ((stage), ())""")
def stage_rollup(spark, d):
    return rep.with_totals(
        tasklog(spark, d), "stage", F.count(F.lit(1)).alias("n"), F.sum("dur_ms").alias("dur_ms"),
        F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"),
    )


@query("makespan", f"""WITH {TASKLOG}
SELECT coalesce(stage, 'total') AS stage, round((max(end_us) - min(start_us)) / 1e6, 6) AS makespan_s FROM tasklog GROUP BY GROUPING SETS ((stage), ())""")
def makespan(spark, d):
    span = F.round((F.max("end_us") - F.min("start_us")) / SECOND, 6)
    return rep.with_totals(tasklog(spark, d), "stage", span.alias("makespan_s"))


@query("stage_run_summary", f"""WITH {TASKLOG}, s AS (
  SELECT stage, token, min(start_us) AS first_us, max(end_us) AS last_us, count(*) AS n, CAST(sum(dur_ms) AS BIGINT) AS dur_ms, max(dur_ms) AS longest
  FROM tasklog GROUP BY 1, 2)
SELECT s.stage, token, first_us, last_us, n, dur_ms, stage_longest FROM s JOIN (SELECT stage, max(longest) AS stage_longest FROM s GROUP BY 1) m ON s.stage = m.stage""")
def stage_run_summary(spark, d):
    """The log is read once; the written runs give each stage's longest task."""
    runs = materialize(tasklog(spark, d).groupBy("stage", "token").agg(
        F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"), F.count(F.lit(1)).alias("n"),
        F.sum("dur_ms").alias("dur_ms"), F.max("dur_ms").alias("longest"),
    ), "runs")
    longest = op.replicated_if_small(runs.groupBy("stage").agg(F.max("longest").alias("stage_longest")))
    return runs.drop("longest").join(longest, "stage")


@query("request_cost", """
SELECT coalesce(l_returnflag, 'total') AS l_returnflag,
       round((sum(l_linenumber) + count(*)) / 1000.0 * 0.005 + sum(l_quantity) / 1000.0 * 0.0004, 6) AS cost
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())""")
def request_cost(spark, d):
    cost = F.round(costs.request_cost(F.sum("l_linenumber"), F.count(F.lit(1)), F.sum("l_quantity")), 6)
    return rep.with_totals(load(spark, d, "lineitem"), "l_returnflag", cost.alias("cost"))


@query("io_totals", """
SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS writes, count(*) AS lists, CAST(sum(l_quantity) AS BIGINT) AS reads,
       CAST(sum(CAST(l_quantity AS BIGINT) * l_linenumber) AS BIGINT) AS read_bytes FROM lineitem GROUP BY 1""")
def io_totals(spark, d):
    quantity = F.col("l_quantity").cast("bigint")
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.sum("l_linenumber").alias("writes"), F.count(F.lit(1)).alias("lists"), F.sum(quantity).alias("reads"),
        F.sum(quantity * F.col("l_linenumber")).alias("read_bytes"),
    )


def priced(spark, d):
    """The run log with its stage's memory and price; both come from small constant tables."""
    memory = costs.lookup(costs.STAGE_MEMORY, F.col("stage"))
    return tasklog(spark, d).withColumn("memory", memory).withColumn("rate", costs.memory_rate(F.col("memory")))


COST = "CAST({} AS DECIMAL(20,0)) * CAST(rate AS DECIMAL(12,9))"
COST_SUM = f"CAST(sum({COST}) AS DOUBLE)"
PRICED = f"{TASKLOG}, {PRICES}, priced AS (SELECT * FROM tasklog JOIN stage_memory USING (stage) JOIN price USING (memory))"


@query("compute_cost", f"""WITH {PRICED}
SELECT coalesce(stage, 'total') AS stage, {COST_SUM.format('(dur_ms + 99) // 100')} AS cost_up, {COST_SUM.format('dur_ms // 100')} AS cost_down
FROM priced GROUP BY GROUPING SETS ((stage), ())""")
def compute_cost(spark, d):
    up = costs.compute_cost(F.col("dur_ms"), F.col("rate"))
    down = costs.compute_cost(F.col("dur_ms"), F.col("rate"), round_up=False)
    return rep.with_totals(
        priced(spark, d), "stage", F.sum(up).cast("double").alias("cost_up"),
        F.sum(down).cast("double").alias("cost_down"),
    )


@query("storage_cost", """
SELECT source, round((sum(n_chars) + coalesce(sum(n_chars) FILTER (WHERE lang = 'en'), 0)) / 1073741824.0 * 0.023, 12) AS cost FROM documents GROUP BY 1""")
def storage_cost(spark, d):
    """Bytes held, plus a second copy of those in one format."""
    copied = F.sum("n_chars") + F.sum(F.when(F.col("lang") == "en", F.col("n_chars")).otherwise(0))
    cost = F.round(copied / float(1024**3) * costs.STORAGE_PRICE, 12)
    return load(spark, d, "documents").groupBy("source").agg(cost.alias("cost"))


CONFIGS = """runs AS (SELECT CAST(o_custkey % 40 AS BIGINT) AS config, o_orderpriority AS region, o_orderkey % 500 = 0 AS failed,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(o_custkey % 97 AS BIGINT) AS duration FROM orders),
configs AS (SELECT config, region, CASE WHEN bool_or(failed) THEN NULL ELSE round(avg(cents) / 100, 4) END AS cost,
         CASE WHEN bool_or(failed) THEN NULL ELSE round(avg(duration), 6) END AS duration
       FROM runs GROUP BY GROUPING SETS ((config, region), (config)))"""


def configs(spark, d):
    """Mean cost and duration per configuration with and without region; a failed run makes them infinite."""
    runs = load(spark, d, "orders").select(
        (F.col("o_custkey") % 40).alias("config"), F.col("o_orderpriority").alias("region"),
        (F.col("o_orderkey") % 500 == 0).alias("failed"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), (F.col("o_custkey") % 97).alias("duration"),
    )
    infinite = F.lit(float("inf"))

    def mean(column):
        return F.avg(F.when(F.col("failed"), infinite).otherwise(F.col(column).cast("double")))

    def shown(column, digits):
        return F.when(column != infinite, F.round(column, digits))

    averages = runs.groupingSets([[F.col("config"), F.col("region")], [F.col("config")]], "config", "region").agg(
        mean("cents").alias("cents"), mean("duration").alias("seconds")
    )
    return averages.select("config", "region", shown(F.col("cents") / 100, 4).alias("cost"), shown(F.col("seconds"), 6).alias("duration"))


@query("config_avg", f"WITH {CONFIGS} SELECT * FROM configs")
def config_avg(spark, d):
    return configs(spark, d)


@query("config_best", f"""WITH {CONFIGS}
SELECT (SELECT config FROM configs WHERE region IS NOT NULL AND cost IS NOT NULL ORDER BY cost, config, region LIMIT 1) AS cheapest,
       (SELECT region FROM configs WHERE region IS NOT NULL AND cost IS NOT NULL ORDER BY cost, config, region LIMIT 1) AS cheapest_region,
       (SELECT config FROM configs WHERE region IS NOT NULL AND duration IS NOT NULL ORDER BY duration, config, region LIMIT 1) AS fastest,
       (SELECT region FROM configs WHERE region IS NOT NULL AND duration IS NOT NULL ORDER BY duration, config, region LIMIT 1) AS fastest_region""")
def config_best(spark, d):
    known = configs(spark, d).where("region IS NOT NULL AND cost IS NOT NULL")
    cheap = F.min(F.struct("cost", "config", "region")).alias("cheap")
    fast = F.min(F.struct("duration", "config", "region")).alias("fast")
    return known.agg(cheap, fast).select(
        F.col("cheap.config").alias("cheapest"), F.col("cheap.region").alias("cheapest_region"),
        F.col("fast.config").alias("fastest"), F.col("fast.region").alias("fastest_region"),
    )


ACCURACY = f"""{SCORES},
best AS (SELECT file, species, n, CASE file % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS expected
  FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, species) AS r FROM score) WHERE r = 1),
sweep AS (SELECT threshold, count(*) FILTER (WHERE n >= threshold * 200 AND species = expected) AS correct,
       count(*) FILTER (WHERE n < threshold * 200) AS unknown, count(*) FILTER (WHERE n >= threshold * 200 AND species <> expected) AS wrong
FROM best CROSS JOIN (SELECT CAST(unnest({THRESHOLDS}) AS DOUBLE) AS threshold) GROUP BY 1)"""


def swept(spark, d, limits):
    best = rep.top_labels(scores(spark, d), "file", "species", "n")
    expected = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("file") % 3 + 1).cast("int"))
    return rep.tally(best.withColumn("expected", expected), "species", "expected", "top", limits, SCORE_SCALE)


@query("accuracy", f"WITH {ACCURACY} SELECT correct, unknown, wrong FROM sweep WHERE threshold = 0.5")
def accuracy(spark, d):
    return swept(spark, d, [0.5]).drop("threshold")


@query("threshold_sweep", f"WITH {ACCURACY} SELECT * FROM sweep")
def threshold_sweep(spark, d):
    return swept(spark, d, THRESHOLDS)


@query("pipe_accuracy", f"""WITH {ACCURACY} SELECT threshold, round(100.0 * correct / (correct + unknown + wrong), 6) AS correct,
  round(100.0 * unknown / (correct + unknown + wrong), 6) AS unknown, round(100.0 * wrong / (correct + unknown + wrong), 6) AS wrong FROM sweep""")
def pipe_accuracy(spark, d):
    table = swept(spark, d, THRESHOLDS)
    total = F.col("correct") + F.col("unknown") + F.col("wrong")
    return table.select("threshold", *[F.round(F.col(c) * 100.0 / total, 6).alias(c) for c in ("correct", "unknown", "wrong")])


@query("rank_histogram", """
SELECT CAST((rn - 1) // 5000 AS BIGINT) AS bin, count(*) FILTER (WHERE l_discount <= 0.01) AS confident, count(*) FILTER (WHERE l_discount > 0.01) AS other
FROM (SELECT l_discount, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rn FROM lineitem) GROUP BY 1""")
def rank_histogram(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    lines = load(spark, d, "lineitem").select("l_extendedprice", "l_discount", *keys)
    return rep.rank_bins(lines, [F.desc("l_extendedprice"), *keys], 5000, F.col("l_discount") <= 0.01)


@query("log_histogram", """
SELECT power, round(exp(power), 6) AS bin, count(*) FILTER (WHERE l_discount <= 0.01) AS hits, count(*) AS total,
       round(100.0 * count(*) FILTER (WHERE l_discount <= 0.01) / count(*), 6) AS percent
FROM (SELECT l_discount, CASE WHEN l_extendedprice > 0 THEN CAST(trunc(ln(l_extendedprice)) AS BIGINT) END AS power FROM lineitem) GROUP BY 1""")
def log_histogram(spark, d):
    """Bins of the logarithm cut toward zero; what has no logarithm is a bin of its own, with a null power."""
    power = F.ln("l_extendedprice").cast("bigint")
    counted = load(spark, d, "lineitem").groupBy(power.alias("power")).agg(
        rep.hits("l_discount").alias("hits"), F.count(F.lit(1)).alias("total")
    )
    return counted.select(
        "power", F.round(F.exp("power"), 6).alias("bin"), "hits", "total", F.round(F.col("hits") * 100.0 / F.col("total"), 6).alias("percent")
    )


@query("size_bucket", "SELECT CAST(floor(o_totalprice / 10000) * 10000 AS BIGINT) AS size, count(*) AS n FROM orders GROUP BY 1")
def size_bucket(spark, d):
    size = (F.floor(F.col("o_totalprice") / 10_000) * 10_000).cast("bigint")
    return load(spark, d, "orders").groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("stage_stats", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def stage_stats(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std")
    )


@query("group_average", """
SELECT stage_group, count(*) AS runs, round(avg(span_us) / 1e6, 4) AS span_s FROM (
  SELECT CASE WHEN event_type IN ('view', 'click') THEN 'browse' WHEN event_type = 'purchase' THEN 'buy' ELSE 'other' END AS stage_group,
         user_id, max(epoch_us(ts)) - min(epoch_us(ts)) AS span_us FROM events GROUP BY 1, 2) GROUP BY 1""")
def group_average(spark, d):
    kind = F.col("event_type")
    group = F.when(kind.isin("view", "click"), F.lit("browse")).when(kind == "purchase", F.lit("buy")).otherwise(F.lit("other"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = load(spark, d, "events").groupBy(group.alias("stage_group"), "user_id").agg((F.max(at) - F.min(at)).alias("span_us"))
    return spans.groupBy("stage_group").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("span_us") / SECOND, 4).alias("span_s")
    )


@query("box_summary", """
SELECT event_type, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2,
       round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high FROM events GROUP BY 1""")
def box_summary(spark, d):
    box = curves.quartiles(load(spark, d, "events"), F.col("value"), ["event_type"])
    return box.select("event_type", "low", *[F.round(q, 6).alias(q) for q in ("q1", "q2", "q3")], "high")


@query("usage_share", "SELECT round(sum(CAST(round(l_quantity * l_discount * 100) AS BIGINT)) / 100.0 / sum(l_quantity), 9) AS share FROM lineitem")
def usage_share(spark, d):
    used = F.sum(F.round(F.col("l_quantity") * F.col("l_discount") * 100).cast("bigint"))
    return load(spark, d, "lineitem").agg(F.round(used / 100.0 / F.sum("l_quantity"), 9).alias("share"))


@query("avg_run", f"""WITH {TASKLOG}, runs AS (SELECT token, max(end_us) - min(start_us) AS span, avg(dur_ms) AS task, sum(dur_ms) AS busy FROM tasklog GROUP BY 1)
SELECT count(*) AS runs, round(avg(span) / 1e6, 4) AS run_s, round(avg(task), 6) AS task_ms, round(sum(busy) / 3600000.0 * 4.256, 6) AS node_cost FROM runs""")
def avg_run(spark, d):
    runs = tasklog(spark, d).groupBy("token").agg(
        (F.max("end_us") - F.min("start_us")).alias("span"), F.avg("dur_ms").alias("task"), F.sum("dur_ms").alias("busy")
    )
    return runs.agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("span") / SECOND, 4).alias("run_s"), F.round(F.avg("task"), 6).alias("task_ms"),
        F.round(costs.machine_cost(F.sum("busy") / 1000.0), 6).alias("node_cost"),
    )


@query("class_balance", """
SELECT quality, doc_id FROM (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM labels)
WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""")
def class_balance(spark, d):
    return rep.balanced(load(spark, d, "labels").select("quality", "doc_id"), "quality", "doc_id")


@query("distinct_tokens", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS stages FROM events")
def distinct_tokens(spark, d):
    """Two small distinct sets instead of expanding every row once per counted column."""
    pairs = load(spark, d, "events").select("user_id", "event_type").distinct()
    return pairs.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("stages"))


@query("count_check", """
SELECT stage, expected, coalesce(n, 0) AS n, expected = coalesce(n, 0) AS equal
FROM (VALUES ('view', CAST(150 AS BIGINT)), ('click', CAST(48 AS BIGINT)), ('purchase', CAST(268 AS BIGINT)), ('signup', CAST(1 AS BIGINT)), ('percolator', CAST(0 AS BIGINT))) e(stage, expected)
LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ON event_type = stage
UNION ALL SELECT event_type, NULL, count(*), FALSE FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup', 'percolator') GROUP BY 1""")
def count_check(spark, d):
    """Task counts per stage against an expected table; a stage missing on either side is unequal unless 0 was expected."""
    expected = small_table(
        spark, [("view", 150), ("click", 48), ("purchase", 268), ("signup", 1), ("percolator", 0)], "stage string, expected bigint"
    )
    counted = load(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return expected.join(counted, "stage", "full").select(
        "stage", "expected", n.alias("n"), F.coalesce(F.col("expected") == n, F.lit(False)).alias("equal")
    )


@query("group_parts", """
SELECT host, page, count(*) AS n, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS parts FROM (
  SELECT host, page_id, CAST((row_number() OVER (PARTITION BY host ORDER BY page_id) - 1) // 1000 AS BIGINT) AS page
  FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, page_id FROM pages)) GROUP BY 1, 2""")
def group_parts(spark, d):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return rep.part_lists(load(spark, d, "pages").select(host.alias("host"), "page_id"), "host", "page_id")


@query("last_object", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def last_object(spark, d):
    return rep.last_of(load(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("overdue", """
WITH top AS (SELECT max(epoch_us(ts)) AS t FROM events), s AS (SELECT user_id, max(epoch_us(ts)) AS at FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT s.user_id, round(s.at / 1e6, 6) AS since_s FROM s, top
WHERE s.at < top.t - 60000000000 AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = s.user_id AND epoch_us(e.ts) > s.at AND epoch_us(e.ts) <= s.at + 60000000000)""")
def overdue(spark, d):
    """Tasks started long ago with no sign of life within the timeout."""
    timeout = 60_000 * SECOND
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    events = load(spark, d, "events").select("user_id", "event_type", at.alias("at"))
    started = events.where("event_type = 'signup'").groupBy("user_id").agg(F.max("at").alias("since"))
    now = events.agg(F.max("at")).first()[0]
    late = started.where(F.col("since") < F.lit(now) - timeout)
    after = (F.col("at") > F.col("since")) & (F.col("at") <= F.col("since") + timeout)
    signs = events.join(late.withColumnRenamed("user_id", "u"), F.col("user_id") == F.col("u")).where(after).select("user_id").distinct()
    return late.join(signs, "user_id", "left_anti").select("user_id", F.round(F.col("since") / SECOND, 6).alias("since_s"))


@query("stage_complete", """
SELECT user_id, event_type, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1, 2 HAVING count(DISTINCT CAST(ts AS DATE)) >= 10""")
def stage_complete(spark, d):
    days = load(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day")).distinct()
    return days.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("days")).where("days >= 10")


@query("utilisation", """
SELECT CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS hour, round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS cpu,
       round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS memory,
       round(greatest(avg(value) FILTER (WHERE event_type = 'view'), avg(value) FILTER (WHERE event_type = 'click')), 6) AS busiest FROM events GROUP BY 1""")
def utilisation(spark, d):
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("bigint")
    cpu = F.avg(F.when(F.col("event_type") == "view", F.col("value")))
    memory = F.avg(F.when(F.col("event_type") == "click", F.col("value")))
    return load(spark, d, "events").groupBy(hour.alias("hour")).agg(
        F.round(cpu, 6).alias("cpu"), F.round(memory, 6).alias("memory"), F.round(F.greatest(cpu, memory), 6).alias("busiest")
    )

"""Queries for sorts, range boundaries, top-k and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluiceflow.functions import text as fn
from sluiceflow.operators import reports as rep, sorting, verbs as op
from sluiceflow.operators.confidence import compete, q_values
from sluiceflow.operators.ordered import Ordered, numbered
from sluiceflow.plans.catalog import query
from sluiceflow.plans.views import READS, reads
from sluiceflow.plans.verbs import LINE_KEYS, LINE_ORDER
from sluiceflow.session import load, materialize, scratch_path

PIVOTS = """chunk AS (SELECT CAST(l_suppkey % 5 AS BIGINT) AS chunk, l_extendedprice AS v FROM lineitem),
size AS (SELECT chunk, greatest(1, count(*) // 8) AS step, max(v) AS top FROM chunk GROUP BY 1),
bounds AS (SELECT chunk, v AS boundary FROM (SELECT chunk, v, row_number() OVER (PARTITION BY chunk ORDER BY v) - 1 AS i FROM (SELECT DISTINCT chunk, v FROM chunk)) JOIN size USING (chunk)
  WHERE i % step = 0 AND v <> top UNION ALL SELECT chunk, top + 1 FROM size)"""


def chunk_pivots(spark, d):
    chunks = load(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("chunk"), F.col("l_extendedprice").alias("v"))
    return sorting.pivots(chunks, "v", 8, ["chunk"])


@query("pivots_exact", f"WITH {PIVOTS} SELECT chunk, round(boundary, 6) AS boundary FROM bounds")
def pivots_exact(spark, d):
    return chunk_pivots(spark, d).withColumn("boundary", F.round("boundary", 6))


@query("pivot_merge", f"""WITH {PIVOTS}, u AS (SELECT boundary, row_number() OVER (ORDER BY boundary) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT boundary FROM bounds))
SELECT DISTINCT round(boundary, 6) AS boundary FROM u WHERE i = n - 1 OR i IN (SELECT CAST(round_even(k * (SELECT max(n) FROM u) / 8.0, 0) AS BIGINT) FROM (SELECT unnest(range(8)) AS k))""")
def pivot_merge(spark, d):
    return sorting.merge_pivots(chunk_pivots(spark, d), 8).withColumn("boundary", F.round("boundary", 6))


@query("pivots_approx", "SELECT count(*) AS n, CAST(8 AS BIGINT) AS bins, true AS even FROM lineitem")
def pivots_approx(spark, d):
    """What holds for approximate bins: all rows, in 8 bins, none over its eighth by more than twice the stated error."""
    bounds = sorting.approximate_pivots(load(spark, d, "lineitem"), "l_extendedprice", 8)
    rows = load(spark, d, "lineitem").select(sorting.bin_column(F.col("l_extendedprice"), bounds).alias("bin"))
    counts = rows.where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    even = F.max("n") <= (1 / 8 + 2 * 0.001) * F.sum("n") + 1
    return counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("bins"), even.alias("even"))


@query("pivots_by_day", """
SELECT l_returnflag AS flag, count(*) AS n, CAST(8 AS BIGINT) AS bins, true AS even FROM lineitem GROUP BY 1""")
def pivots_by_day(spark, d):
    """Chunks that come on different days are summed up one by one; their stored summaries give the boundaries later.

    What holds for good boundaries is returned: all rows in 8 bins, none off its eighth by more than twice the stated error.
    """
    rows = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_shipdate", "l_extendedprice")
    parts = materialize(sorting.summaries(rows, "l_extendedprice", ["flag", "l_shipdate"]), "summaries")
    bounds = sorting.summary_pivots(sorting.merge_summaries(parts, ["flag"]), 8, ["flag"])
    # One row of at most nine numbers a flag.
    edges = bounds.groupBy("flag").agg(F.sort_array(F.collect_list("boundary")).alias("edges"))
    placed = rows.join(op.replicated_if_small(edges, settle=True), "flag").select(
        "flag", F.size(F.filter("edges", lambda e: e <= F.col("l_extendedprice"))).alias("bin"), F.size("edges").alias("held"),
    )
    counts = placed.where("bin > 0 AND bin < held").groupBy("flag", "bin").agg(F.count("*").alias("n"))
    even = F.max("n") <= (1 / 8 + 2 * 0.005) * F.sum("n") + 1
    return counts.groupBy("flag").agg(F.sum("n").alias("n"), F.count("*").alias("bins"), even.alias("even"))


@query("partition_bounds", """
SELECT count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, CAST(0 AS BIGINT) AS overlaps, true AS even FROM lineitem""")
def partition_bounds(spark, d):
    """What holds for range partitions: all rows, the whole range, no two that overlap, none twice its share."""
    bounds = sorting.partition_bounds(load(spark, d, "lineitem"), "l_extendedprice", 8)
    # One row per partition, 8 at most.
    before = F.max("hi").over(Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1))
    return bounds.withColumn("before", before).agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count_if(F.col("before") >= F.col("lo")).alias("overlaps"),
        (F.max("n") <= 2 * F.sum("n") / 8).alias("even"),
    )


@query("key_order", """
SELECT doc_id, source, row_number() OVER (ORDER BY CAST(substr(source, 4) AS BIGINT), doc_id) AS rn FROM documents""")
def key_order(spark, d):
    """Keys in the order of a number parsed from them, so that `src2` comes before `src10`."""
    number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("bigint")
    keys = load(spark, d, "documents").select("doc_id", "source", number.alias("number"))
    return Ordered(keys, ["number", "doc_id"]).extend(row_number="rn").drop("number")


@query("sort_range", f"""
SELECT l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, row_number() OVER (ORDER BY {LINE_ORDER}) AS rn FROM lineitem""")
def sort_range(spark, d):
    return Ordered(load(spark, d, "lineitem").select(*LINE_KEYS), LINE_KEYS).extend(row_number="rn")


@query("interval_sort", """
SELECT o_orderkey, CAST(floor((rn - 1) * 35 / total) AS BIGINT) AS bin FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, CAST(count(*) OVER () AS DOUBLE) AS total FROM orders)""")
def interval_sort(spark, d):
    """Sort by start, cut into 35 even bins, and write each bin compressed."""
    orders = load(spark, d, "orders").select("o_orderdate", "o_orderkey")
    placed = numbered(orders, ["o_orderdate", "o_orderkey"], "rn", total="total")
    binned = placed.select("o_orderkey", F.floor((F.col("rn") - 1) * 35 / F.col("total")).cast("bigint").alias("bin"))
    path = scratch_path(spark, "intervals")
    binned.write.option("compression", "zstd").partitionBy("bin").parquet(path)
    return spark.read.schema("o_orderkey bigint, bin bigint").parquet(path)


@query("top_n", """
SELECT l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 1000""")
def top_n(spark, d):
    keys = LINE_KEYS[:-1]
    return op.top(load(spark, d, "lineitem").select(*keys), 1000, *keys)


@query("hash_sample", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def hash_sample(spark, d):
    return rep.hash_sample(load(spark, d, "documents").select("doc_id"), "doc_id", 100)


BASE5 = " + ".join(f"(strpos('ACGNT', substr(seq, {i + 1}, 1)) - 1) * {5 ** (7 - i)}" for i in range(8))
SIGNED = f"{READS}, signed AS (SELECT doc_id, CAST({BASE5} AS BIGINT) AS signature FROM reads)"


@query("signature", f"WITH {SIGNED} SELECT doc_id, signature FROM signed")
def signature(spark, d):
    return reads(spark, d).select("doc_id", fn.signature(F.col("seq")).alias("signature"))


@query("minimizer", f"""WITH {READS}
SELECT doc_id, list_min(list_transform(range(1, length(seq) - 6), lambda i: substr(seq, CAST(i AS BIGINT), 8))) AS minimizer FROM reads""")
def minimizer(spark, d):
    return reads(spark, d).select("doc_id", fn.minimizer(F.col("seq")).alias("minimizer"))


def sorted_reads(spark, d):
    signed = reads(spark, d).select("doc_id", fn.signature(F.col("seq")).alias("signature"))
    return Ordered(signed, ["signature", "doc_id"], settle=True).extend(row_number="rn", whole={"total": F.lit(1).cast("bigint")})


@query("signature_sort", f"WITH {SIGNED} SELECT doc_id, signature, row_number() OVER (ORDER BY signature, doc_id) AS rn FROM signed")
def signature_sort(spark, d):
    return sorted_reads(spark, d).drop("total")


@query("pipe_compress", f"""WITH {SIGNED}, placed AS (SELECT signature, row_number() OVER (ORDER BY signature, doc_id) AS rn, count(*) OVER () AS total FROM signed)
SELECT CAST(floor((rn - 1) * 10 / CAST(total AS DOUBLE)) AS INTEGER) AS bin, count(*) AS n, min(signature) AS low, max(signature) AS high FROM placed GROUP BY 1""")
def pipe_compress(spark, d):
    """Sort reads by signature, write them compressed by range, and read the bins back."""
    placed = sorted_reads(spark, d)
    path = scratch_path(spark, "reads")
    bin_of = F.floor((F.col("rn") - 1) * 10 / F.col("total")).cast("int")
    placed.withColumn("bin", bin_of).write.option("compression", "zstd").partitionBy("bin").parquet(path)
    held = spark.read.schema("doc_id bigint, signature bigint, rn bigint, bin int").parquet(path)
    return held.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("signature").alias("low"), F.max("signature").alias("high"))


@query("pipe_sort_search", f"""
SELECT CAST((rn - 1) // 1000 AS BIGINT) AS run, count(*) FILTER (WHERE l_discount <= 0.01) AS hits FROM (
  SELECT l_discount, row_number() OVER (ORDER BY {LINE_ORDER}) AS rn FROM lineitem) GROUP BY 1""")
def pipe_sort_search(spark, d):
    """Sort by price, cut into runs of 1000 rows, and count each run's rows under the threshold."""
    lines = load(spark, d, "lineitem").select(*LINE_KEYS, "l_discount")
    runs = op.split_by_count(lines, LINE_KEYS, 1000, "run")
    return runs.groupBy("run").agg(rep.hits("l_discount").alias("hits"))


@query("pipe_sort_rescore", f"""
WITH line AS (SELECT l_partkey, CAST(l_quantity AS DOUBLE) AS score, l_returnflag = 'R' AS decoy, l_discount,
    CAST((row_number() OVER (ORDER BY {LINE_ORDER}) - 1) // 1000 AS BIGINT) AS run FROM lineitem),
first AS (SELECT run, l_partkey, score, decoy FROM (SELECT *, row_number() OVER (PARTITION BY run, l_partkey ORDER BY score DESC, decoy DESC) AS r FROM line WHERE l_discount <= 0.05) WHERE r = 1),
best AS (SELECT l_partkey, score, decoy FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, decoy DESC) AS r FROM first) WHERE r = 1),
level AS (SELECT score, sum(count(*) FILTER (WHERE decoy)) OVER w AS d, sum(count(*) FILTER (WHERE NOT decoy)) OVER w AS t
  FROM best GROUP BY score WINDOW w AS (ORDER BY score DESC)),
q AS (SELECT score, min(CASE WHEN t > 0 THEN least(1.0, (CAST(d AS DOUBLE) + 1) / t) ELSE 1.0 END) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM level)
SELECT l_partkey, score, decoy, round(q, 9) AS q, runs FROM best JOIN q USING (score) JOIN (SELECT l_partkey, count(*) AS runs FROM first GROUP BY 1) USING (l_partkey)""")
def pipe_sort_rescore(spark, d):
    """Sort by price, cut into runs, search each run, combine, and rescore the combined results in a second run.

    A run's result for a part is its largest discounted quantity; returned lines are the decoys.
    """
    lines = load(spark, d, "lineitem").select(*LINE_KEYS, "l_discount", "l_quantity", "l_returnflag")
    runs = op.split_by_count(lines, LINE_KEYS, 1000, "run").where(F.col("l_discount") <= 0.05)
    scored = runs.select("run", "l_partkey", F.col("l_quantity").cast("double").alias("score"), (F.col("l_returnflag") == "R").alias("decoy"))
    first = compete(scored, ["run", "l_partkey"], "score", "decoy")
    rank = F.struct("score", F.col("decoy").cast("int").alias("d"))
    merged = first.groupBy("l_partkey").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("runs"))
    best = materialize(merged.select("l_partkey", F.col("best.score").alias("score"), (F.col("best.d") == 1).alias("decoy"), "runs"), "combined")
    return q_values(best, "score", "decoy", "q").withColumn("q", F.round("q", 9))

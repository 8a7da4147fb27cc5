"""Queries for the join-shaped verbs, nearest neighbours, polygons and grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluiceflow.operators import grids, neighbors as knn, polygons as poly, verbs as op
from sluiceflow.operators.sorting import bin_column, pivots
from sluiceflow.operators.sorting import range_join as sorted_ranges
from sluiceflow.plans.catalog import query
from sluiceflow.plans.views import GRID, PRICES, SECOND, TASKLOG, grid, tasklog
from sluiceflow.functions import costs
from sluiceflow.session import load, materialize, scratch_path, small_table
from sluiceflow.sources import records



@query("map_cross", """
SELECT c_mktsegment, r_regionkey, r_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY r_regionkey) AS file_id,
       count(*) OVER (PARTITION BY c_mktsegment) AS num_files
FROM (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN region""")
def map_cross(spark, d):
    segments = load(spark, d, "customer").select("c_mktsegment").distinct()
    return op.fan_out(segments, load(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"])


@query("pair_blocks", """
SELECT test, train, n_test, n_train, dense_rank() OVER (ORDER BY train) AS file_id, (SELECT count(DISTINCT item_id // 10) FROM benchmark) AS num_files
FROM (SELECT doc_id // 50 AS test, count(*) AS n_test FROM documents GROUP BY 1)
CROSS JOIN (SELECT item_id // 10 AS train, count(*) AS n_train FROM benchmark GROUP BY 1)""")
def pair_blocks(spark, d):
    tests = load(spark, d, "documents").groupBy(F.expr("doc_id div 50").alias("test")).agg(F.count(F.lit(1)).alias("n_test"))
    trains = load(spark, d, "benchmark").groupBy(F.expr("item_id div 10").alias("train")).agg(F.count(F.lit(1)).alias("n_train"))
    return op.fan_out(tests, materialize(trains, "trains"), ["train"])


K = 5
KNN = f"""vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label % 3 AS cls FROM embeddings),
near AS (
  SELECT test_id, train_id, distance, cls, rank FROM (
    SELECT a.vec_id AS test_id, b.vec_id AS train_id, list_distance(a.e, b.e) AS distance, b.cls,
           row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rank
    FROM vec a JOIN vec b ON a.vec_id <> b.vec_id) WHERE rank <= {K}),
span AS (SELECT test_id, min(distance) AS d1, max(distance) AS dk FROM near GROUP BY 1),
weighted AS (
  SELECT test_id, c, round(sum(CASE WHEN cls <> c THEN 0 WHEN rank = 1 THEN 1
                               ELSE (dk - distance) / CASE WHEN dk = d1 THEN 0.0001 ELSE dk - d1 END END), 9) AS w
  FROM near JOIN span USING (test_id) CROSS JOIN (VALUES (0), (1), (2)) classes(c) GROUP BY 1, 2),
ballot AS (
  SELECT test_id, CAST(CASE WHEN count(*) FILTER (WHERE w = best) = 1 THEN min(c) FILTER (WHERE w = best) ELSE 2 END AS INTEGER) AS cls
  FROM (SELECT *, max(w) OVER (PARTITION BY test_id) AS best FROM weighted) GROUP BY 1)"""
KNN_ROWS = "SELECT test_id, train_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM near"


def vectors(spark, d):
    return load(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), (F.col("label") % 3).alias("cls")
    )


def neighbours(spark, d):
    """The K nearest other vectors of every vector."""
    table = vectors(spark, d)
    return knn.nearest(table, table, K, skip_same=True)


@query("knn_pairs", f"WITH {KNN} {KNN_ROWS}")
def knn_pairs(spark, d):
    return neighbours(spark, d).withColumn("distance", F.round("distance", 6))


@query("knn_merge", f"WITH {KNN} {KNN_ROWS}")
def knn_merge(spark, d):
    """Partial lists against four splits of the training vectors, merged."""
    table = vectors(spark, d)
    split = F.pmod(F.xxhash64("id"), F.lit(4))
    parts = [knn.nearest(table, table.where(split == i), K, skip_same=True).drop("rank") for i in range(4)]
    return knn.merge_nearest(op.combine(*parts), K).withColumn("distance", F.round("distance", 6))


@query("topk_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (
  SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS rank
  FROM orders) WHERE rank <= 5""")
def topk_per_group(spark, d):
    """The window keeps 5 rows per key in each task before the shuffle, so a hot key sends few rows."""
    order = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    orders = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return orders.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 5)


def ballots(spark, d):
    near = neighbours(spark, d)
    labels = vectors(spark, d).select(F.col("id").alias("train_id"), "cls")
    return knn.vote(near.join(labels, "train_id"))


@query("knn_vote", f"WITH {KNN} SELECT test_id, cls FROM ballot")
def knn_vote(spark, d):
    return ballots(spark, d)


@query("pipe_knn_border", f"""WITH {KNN},
cells AS (SELECT test_id % 25 AS x, test_id // 25 AS y, cls FROM ballot)
SELECT CAST(a.x AS BIGINT) AS x, CAST(a.y AS BIGINT) AS y,
       CAST(CASE WHEN a.cls = 1 AND count(*) FILTER (WHERE b.cls = 1) <= 1 THEN 2 ELSE a.cls END AS INTEGER) AS cls
FROM cells a JOIN cells b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY a.x, a.y, a.cls""")
def pipe_knn_border(spark, d):
    """Flagship: neighbours of every pixel, their vote, and removal of lone border pixels."""
    cells = ballots(spark, d).select(
        (F.col("test_id") % 25).alias("x"), F.expr("test_id div 25").alias("y"), "cls"
    )
    return grids.clean_borders(cells)


@query("log_price", f"""WITH {TASKLOG}, {PRICES}
SELECT stage, memory, count(*) AS n, round(sum(dur_ms / 1000.0 * rate), 6) AS cost
FROM tasklog JOIN stage_memory USING (stage) JOIN price USING (memory) GROUP BY 1, 2""")
def log_price(spark, d):
    memory = small_table(spark, list(costs.STAGE_MEMORY.items()), "stage string, memory int")
    price = small_table(spark, list(costs.MEMORY_PRICES.items()), "memory int, rate double")
    # Two fixed tables of a few rows each.
    priced = tasklog(spark, d).join(F.broadcast(memory), "stage").join(F.broadcast(price), "memory")
    return priced.groupBy("stage", "memory").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("dur_ms") / 1000.0 * F.col("rate")), 6).alias("cost")
    )


@query("left_miss", """
SELECT lang, count(l.doc_id) AS found, count(*) - count(l.doc_id) AS missing, count(*) FILTER (WHERE quality = 1) AS good
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def left_miss(spark, d):
    labels = load(spark, d, "labels").select("doc_id", "quality")
    joined = load(spark, d, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return joined.groupBy("lang").agg(
        F.count("quality").alias("found"),
        F.count_if(F.col("quality").isNull()).alias("missing"),
        F.count_if(F.col("quality") == 1).alias("good"),
    )


@query("range_bin", """
WITH cut AS (SELECT unnest([10000.0 * i FOR i IN range(1, 12)]) AS edge)
SELECT CAST((SELECT count(*) FROM cut WHERE edge <= l_extendedprice) AS INTEGER) AS bin, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high
FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1""")
def range_bin(spark, d):
    """Half-open ranges given as a sorted list of boundaries; the first and the last range are open to their side."""
    price = F.col("l_extendedprice")
    bins = bin_column(price, [float("-inf"), *[10_000.0 * i for i in range(1, 12)], float("inf")])
    return (
        load(spark, d, "lineitem").select(price, (bins - 1).alias("bin")).where(price.isNotNull())
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min(price).alias("low"), F.max(price).alias("high"))
    )


@query("range_join", """
WITH v AS (SELECT l_extendedprice AS v, count(*) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1),
p AS (SELECT v, row_number() OVER (ORDER BY v) AS place, sum(n) OVER () AS rows, lead(v) OVER (ORDER BY v) AS following FROM v),
b AS (SELECT CASE WHEN following IS NULL THEN v + 1 ELSE v END AS lo FROM p WHERE following IS NULL OR (place - 1) % greatest(1, rows // 100000) = 0),
r AS (SELECT row_number() OVER (ORDER BY lo) AS bin, lo, lead(lo) OVER (ORDER BY lo) AS hi FROM b)
SELECT bin, lo, hi, count(*) AS n FROM lineitem ASOF JOIN r ON l_extendedprice >= lo WHERE hi IS NOT NULL GROUP BY 1, 2, 3""")
def range_join(spark, d):
    """Rows by the range they fall in, of a table of up to 100,000 boundaries."""
    rows = load(spark, d, "lineitem").select("l_extendedprice").where("l_extendedprice IS NOT NULL")
    boundaries = pivots(rows, "l_extendedprice", 100_000)
    return sorted_ranges(rows, "l_extendedprice", boundaries).groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))


# The two example outlines.
OUTLINES = {
    "triangle": [(5.0, 20.0), (45.0, 60.0), (10.0, 180.0)],
    "quad": [(20.0, 30.0), (48.0, 40.0), (40.0, 150.0), (25.0, 120.0)],
}
EDGES = "edge(name, x1, y1, x2, y2) AS (VALUES " + ", ".join(
    f"('{name}', {a[0]}, {a[1]}, {b[0]}, {b[1]})"
    for name, ring in OUTLINES.items() for a, b in zip(ring, ring[1:] + ring[:1])
) + ")"
POINTS = "point AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice - 900 AS y FROM part)"


def outlines(spark):
    """The example outlines as a table; a corner list is a constant of the plan."""
    corners = [(name, i, x, y) for name, ring in OUTLINES.items() for i, (x, y) in enumerate(ring)]
    table = small_table(spark, corners, "name string, i int, x double, y double")
    ring = F.sort_array(F.collect_list(F.struct("i", "x", "y")))
    return table.groupBy("name").agg(F.transform(ring, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("vertices"))


def points(spark, d):
    return load(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") - 900).alias("y"))


@query("point_in_polygon", f"""WITH {EDGES}, {POINTS}
SELECT name, p_partkey FROM point CROSS JOIN edge GROUP BY name, p_partkey, x, y
HAVING x BETWEEN min(x1) AND max(x1) AND y BETWEEN min(y1) AND max(y1)
   AND count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x1 - x2) * (y - y2) / nullif(y1 - y2, 0) + x2) % 2 = 1""")
def point_in_polygon(spark, d):
    hit = poly.inside(F.col("vertices"), F.col("x"), F.col("y"))
    return poly.pair_with_polygons(points(spark, d), outlines(spark), hit).select("name", "p_partkey")


@query("near_border", f"""WITH {EDGES}, {POINTS}
SELECT DISTINCT name, p_partkey FROM point CROSS JOIN edge WHERE (x = x1 AND y = y1) OR (x = x2 AND y = y2) OR (
  abs((y - y1) * (x2 - x1) - (x - x1) * (y2 - y1)) <= 10
  AND (x - x1) * (x2 - x1) + (y - y1) * (y2 - y1) BETWEEN 0 AND (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))""")
def near_border(spark, d):
    hit = poly.near_edge(F.col("vertices"), F.col("x"), F.col("y"))
    near = poly.pair_with_polygons(points(spark, d), outlines(spark), hit, margin=poly.reach(F.col("vertices")))
    return near.select("name", "p_partkey")


@query("compare_runs", """
WITH base AS (SELECT l_suppkey AS f, l_returnflag AS s, count(*) AS score FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2),
other AS (SELECT l_suppkey AS f, l_returnflag AS s, count(*) AS score FROM lineitem WHERE l_linenumber > 3 GROUP BY 1, 2)
SELECT count(*) FILTER (WHERE b.score IS NULL) AS missing, count(*) FILTER (WHERE b.score <= o.score) AS as_good,
       count(*) FILTER (WHERE 0.95 * b.score <= o.score) AS nearly, count(*) AS total
FROM other o LEFT JOIN base b ON o.f = b.f AND o.s = b.s""")
def compare_runs(spark, d):
    """Two runs' scores side by side; both are counted in one pass over the rows."""
    first = F.col("l_linenumber") <= 3
    both = load(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.count_if(first).alias("base"), F.count_if(~first).alias("score")
    ).where("score > 0")
    base = F.when(F.col("base") > 0, F.col("base"))
    return both.agg(
        F.count_if(base.isNull()).alias("missing"),
        F.count_if(base <= F.col("score")).alias("as_good"),
        F.count_if(base * 0.95 <= F.col("score")).alias("nearly"),
        F.count(F.lit(1)).alias("total"),
    )


@query("missing_keys", f"""
WITH span AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) - min(epoch_us(ts)) + 1 AS width FROM events),
p AS (SELECT DISTINCT user_id, 1 + 3 * (epoch_us(ts) - low) // width AS part FROM events, span WHERE event_type = 'signup')
SELECT user_id, CASE WHEN user_id NOT IN (SELECT user_id FROM p WHERE part = 2) THEN 'second' ELSE 'third' END AS absent_in
FROM p WHERE part = 1 AND (user_id NOT IN (SELECT user_id FROM p WHERE part = 2) OR user_id NOT IN (SELECT user_id FROM p WHERE part = 3))""")
def missing_keys(spark, d):
    """Users of the first run, a third of the time seen, that a later run lost; the second run is looked at first."""
    events = load(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    part = F.expr(f"1 + 3 * (unix_micros(CAST(ts AS timestamp)) - {low or 0}L) div {(high or 0) - (low or 0) + 1}L")
    seen = events.where("event_type = 'signup'").groupBy("user_id").agg(
        *[F.bool_or(part == k).alias(name) for k, name in enumerate(("first", "second", "third"), 1)]
    )
    return seen.where("first AND NOT (second AND third)").select(
        "user_id", F.when(~F.col("second"), F.lit("second")).otherwise(F.lit("third")).alias("absent_in")
    )


@query("missing_tasks", f"""
SELECT user_id, event_type, day FROM (SELECT DISTINCT user_id FROM events)
CROSS JOIN (SELECT DISTINCT event_type FROM events)
CROSS JOIN (SELECT CAST(unnest(range(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)) + 1, INTERVAL 1 DAY)) AS DATE) AS day FROM events)
EXCEPT SELECT user_id, event_type, CAST(ts AS DATE) FROM events""")
def missing_tasks(spark, d):
    """Expected user × type × day tasks with no log."""
    seen = materialize(load(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day")).distinct(), "seen")
    days = seen.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    users = seen.select("user_id").distinct()
    types = seen.select("event_type").distinct()
    # One row with two days, carried by every key.
    expected = op.fan_out(users, types, ["event_type"]).crossJoin(F.broadcast(days)).select(
        "user_id", "event_type", F.explode(F.sequence("first", "last")).alias("day")
    )
    return expected.join(seen, ["user_id", "event_type", "day"], "left_anti")


@query("common_keys", """
SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)""")
def common_keys(spark, d):
    """Keys present in every result set, with one aggregation instead of a chain of joins."""
    pairs = load(spark, d, "events").select("user_id", "event_type").distinct()
    kinds = pairs.select("event_type").distinct().count()
    return pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == kinds).select("user_id")


@query("idle_interval", """
SELECT user_id, round((min(epoch_us(ts)) FILTER (WHERE event_type = 'click') - min(epoch_us(ts)) FILTER (WHERE event_type = 'signup')) / 1e6, 6) AS idle_s
FROM events WHERE event_type IN ('click', 'signup') GROUP BY 1 HAVING count(DISTINCT event_type) = 2""")
def idle_interval(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    firsts = load(spark, d, "events").where(F.col("event_type").isin("click", "signup")).groupBy("user_id").agg(
        F.min(F.when(F.col("event_type") == "click", at)).alias("task"),
        F.min(F.when(F.col("event_type") == "signup", at)).alias("upload"),
    )
    return firsts.where("task IS NOT NULL AND upload IS NOT NULL").select(
        "user_id", F.round((F.col("task") - F.col("upload")) / SECOND, 6).alias("idle_s")
    )


AROUND = "FROM grid a JOIN grid b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1"


@query("neighborhood", f"""WITH {GRID}
SELECT a.x, a.y, count(*) AS present, count(*) FILTER (WHERE b.cls = 0) AS inside, count(*) FILTER (WHERE b.cls = 1) AS border,
       count(*) FILTER (WHERE b.cls = 2) AS outside {AROUND} GROUP BY 1, 2""")
def neighborhood(spark, d):
    counts = [F.count_if(F.col("cls") == i).alias(n) for i, n in enumerate(("inside", "border", "outside"))]
    return grids.around(grid(spark, d), ["cls"], [F.count(F.lit(1)).alias("present"), *counts])


@query("border_clean", f"""WITH {GRID}
SELECT a.x, a.y, CAST(CASE WHEN a.cls = 1 AND count(*) FILTER (WHERE b.cls = 1) <= 1 THEN 2 ELSE a.cls END AS INTEGER) AS cls
{AROUND} GROUP BY a.x, a.y, a.cls""")
def border_clean(spark, d):
    return grids.clean_borders(grid(spark, d))


@query("window_features", f"""WITH {GRID}
SELECT c.x, c.y, string_agg(CAST(coalesce(g.cls, 0) AS VARCHAR), ',' ORDER BY o.dy, o.dx) AS features
FROM grid c CROSS JOIN (SELECT dx, dy FROM (SELECT unnest(range(-1, 2)) AS dx) CROSS JOIN (SELECT unnest(range(-1, 2)) AS dy)) o
LEFT JOIN grid g ON g.x = c.x + o.dx AND g.y = c.y + o.dy GROUP BY 1, 2""")
def window_features(spark, d):
    features = grids.window_features(grid(spark, d), "cls")
    return features.withColumn("features", F.concat_ws(",", F.col("features").cast("array<string>")))


@query("window_features_rgb", """
WITH pixel AS (SELECT vec_id % 25 AS x, vec_id // 25 AS y, [label, vec_id % 7, vec_id % 256] AS rgb FROM embeddings)
SELECT c.x, c.y, string_agg(CAST(coalesce(g.rgb[k], 0) AS VARCHAR), ',' ORDER BY o.dy, o.dx, k) AS features
FROM pixel c CROSS JOIN (SELECT dx, dy, k FROM (SELECT unnest(range(-1, 2)) AS dx) CROSS JOIN (SELECT unnest(range(-1, 2)) AS dy)
  CROSS JOIN (SELECT unnest(range(1, 4)) AS k)) o
LEFT JOIN pixel g ON g.x = c.x + o.dx AND g.y = c.y + o.dy GROUP BY 1, 2""")
def window_features_rgb(spark, d):
    """Windows of three channels: 27 values per pixel, with one shuffle."""
    pixels = load(spark, d, "embeddings").select(
        (F.col("vec_id") % 25).alias("x"), F.expr("vec_id div 25").alias("y"), F.col("label").cast("bigint").alias("r"),
        (F.col("vec_id") % 7).alias("g"), (F.col("vec_id") % 256).alias("b"),
    )
    features = grids.window_features(pixels, ["r", "g", "b"])
    return features.withColumn("features", F.concat_ws(",", F.col("features").cast("array<string>")))


@query("map_listing", """
SELECT n_nationkey, 'o_orderstatus=' || s AS folder, row_number() OVER (PARTITION BY n_nationkey ORDER BY s) AS file_id
FROM nation CROSS JOIN (SELECT DISTINCT o_orderstatus AS s FROM orders)""")
def map_listing(spark, d):
    """Every nation with every folder below a written table: a listing is the key side of `map`."""
    path = scratch_path(spark, "listed")
    load(spark, d, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    folders = records.list_folders(spark, path)
    return op.fan_out(load(spark, d, "nation").select("n_nationkey"), folders, ["folder"]).select("n_nationkey", "folder", "file_id")


@query("match_best", """
SELECT l_suppkey, count(*) FILTER (WHERE l_discount <= 0.01) AS score FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def match_best(spark, d):
    scores = load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_discount") <= 0.01).alias("score"))
    return op.match(scores, "l_suppkey", "score")


@query("apply_match", """
WITH s AS (SELECT l_returnflag, l_suppkey, count(*) FILTER (WHERE l_discount <= 0.01) AS score FROM lineitem GROUP BY 1, 2),
best AS (SELECT l_returnflag, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY score DESC, l_suppkey) AS r FROM s) WHERE r = 1)
SELECT l_returnflag, l_suppkey, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem JOIN best USING (l_returnflag, l_suppkey) GROUP BY 1, 2""")
def apply_match(spark, d):
    """Each flag's best supplier, applied to the rows of the input again."""
    lines = load(spark, d, "lineitem").select("l_returnflag", "l_suppkey", "l_quantity", "l_discount")
    scores = lines.groupBy("l_returnflag", "l_suppkey").agg(F.count_if(F.col("l_discount") <= 0.01).alias("score"))
    best = op.match_within(scores, ["l_returnflag"], "l_suppkey", "score").drop("score")
    kept = lines.join(op.replicated_if_small(best, settle=True), ["l_returnflag", "l_suppkey"])
    return kept.groupBy("l_returnflag", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))

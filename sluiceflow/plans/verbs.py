"""Queries for the dataflow verbs: filters, splits, unions and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluiceflow.functions import text as fn
from sluiceflow.operators import verbs as op
from sluiceflow.operators.ordered import Ordered, numbered
from sluiceflow.plans.catalog import query
from sluiceflow.sources.sinks import write_once
from sluiceflow.session import load, scratch_path, small_table

LINE_KEYS = ("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
LINE_ORDER = ", ".join(LINE_KEYS)

# Fixed values of the routing example: (condition in Spark SQL and DuckDB, target).
ROUTES = (
    ("n_chars > 5000 AND lang = 'en'", "long-english"),
    ("n_chars > 5000", "long"),
    ("lang = 'de' OR lang = 'fr'", "continental"),
    ("source = 'src0' OR source = 'src1'", "first-sources"),
)
ROUTE_CASE = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in ROUTES) + " ELSE 'normal' END"


def route_column():
    return op.route([(F.expr(c), t) for c, t in ROUTES], "normal")


@query("identifier", """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS start_position,
       round(l_extendedprice * (1 - l_discount), 4) AS end_position FROM lineitem""")
def identifier(spark, d):
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_extendedprice").alias("start_position"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("end_position"),
    )


@query("cvparam", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def cvparam(spark, d):
    params = F.from_json("props", "map<string,string>")
    return load(spark, d, "events").select("event_id", F.element_at(params, "k").cast("double").alias("k"))


@query("ms2_only", "SELECT event_id, event_type FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
def ms2_only(spark, d):
    level = F.get_json_object("props", "$.k").cast("double")
    return load(spark, d, "events").where(level >= 50).select("event_id", "event_type")


@query("threshold", "SELECT l_orderkey, l_linenumber, l_partkey, l_discount + 0.0 AS q FROM lineitem WHERE l_discount <= 0.01")
def threshold(spark, d):
    kept = op.threshold(load(spark, d, "lineitem"), "l_discount", 0.01)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") + 0.0).alias("q"))


@query("key_filter", "SELECT page_id, url FROM pages WHERE starts_with(url, 'http://') AND contains(url, '.example.org')")
def key_filter(spark, d):
    url = F.col("url")
    return load(spark, d, "pages").where(url.startswith("http://") & url.contains(".example.org")).select("page_id", "url")


@query("date_range", """
SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-10'""")
def date_range(spark, d):
    # Bounds on the raw column reach the Parquet scan.
    low, high = F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-11").cast("timestamp_ntz")
    kept = load(spark, d, "events").where((F.col("ts") >= low) & (F.col("ts") < high))
    return kept.select("event_id", F.to_date("ts").cast("string").alias("day"))


@query("deadline_filter", "SELECT event_id, value FROM events WHERE value - 10 <= 0 OR 100 < value - 10")
def deadline_filter(spark, d):
    kept = op.before_deadline(load(spark, d, "events"), F.lit(1), F.col("value") - 10, F.lit(100))
    return kept.select("event_id", "value")


@query("route", f"SELECT {ROUTE_CASE} AS target, count(*) AS n FROM documents GROUP BY 1")
def route(spark, d):
    return load(spark, d, "documents").groupBy(route_column().alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("every_nth", """
SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) WHERE i % 5 = 0""")
def every_nth(spark, d):
    """Systematic sampling is the operator: every 5th row of the table in key order."""
    placed = Ordered(load(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"]).extend(row_number="i")
    return placed.where((F.col("i") - 1) % 5 == 0).drop("i")


@query("exclude", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE'))""")
def exclude(spark, d):
    segments = small_table(spark, [("MACHINERY",), ("FURNITURE",)], "c_mktsegment string")
    listed = load(spark, d, "customer").join(F.broadcast(segments), "c_mktsegment", "left_semi")
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    return op.exclude(orders, listed.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


@query("take_n", "SELECT source, doc_id, n_chars FROM documents ORDER BY source, doc_id LIMIT 100")
def take_n(spark, d):
    return op.take_first(load(spark, d, "documents").select("source", "doc_id", "n_chars"), 100, "source", "doc_id")


@query("skip_names", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src1')")
def skip_names(spark, d):
    return load(spark, d, "documents").where(~F.col("source").isin("src0", "src1")).select("doc_id", "source")


@query("split_chunks", """
SELECT CAST(floor((sum(n_chars) OVER (ORDER BY doc_id) - n_chars) / 100000.0) + 1 AS BIGINT) AS chunk, doc_id, n_chars FROM documents
""".replace("SELECT", "SELECT chunk, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM (SELECT", 1) + ") GROUP BY 1")
def split_chunks(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "n_chars")
    chunks = op.split_by_size(docs, ["doc_id"], F.col("n_chars"), 100_000)
    return chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("bytes"))


@query("chunk_by_count", """
SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS file, o_orderkey FROM orders
""".replace("SELECT", "SELECT CAST(file AS BIGINT) AS file, count(*) AS n, min(o_orderkey) AS first FROM (SELECT", 1) + ") GROUP BY 1")
def chunk_by_count(spark, d):
    chunks = op.split_by_count(load(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 1000, "file")
    return chunks.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


@query("binned_sink", """
WITH held AS (SELECT CAST(floor(l_extendedprice / 10000) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1),
bins AS (SELECT CAST(unnest(range(least(0, min(bin)), max(bin) + 1)) AS INTEGER) AS bin FROM held)
SELECT coalesce(b.bin, h.bin) AS bin, coalesce(n, 0) AS n FROM bins b FULL JOIN held h ON b.bin = h.bin""")
def binned_sink(spark, d):
    """Write the rows by bin, then count what each bin's folder holds; empty bins from 0 to the largest are kept."""
    path = scratch_path(spark, "bins")
    bin_of = F.floor(F.col("l_extendedprice") / 10000).cast("int")
    rows = load(spark, d, "lineitem").select("l_orderkey", bin_of.alias("bin"))
    rows.write.partitionBy("bin").parquet(path)
    held = spark.read.schema("l_orderkey bigint, bin int").parquet(path).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    span = held.agg(F.explode(F.sequence(F.least(F.lit(0), F.min("bin")), F.max("bin"))).alias("bin"))
    return span.join(held, "bin", "full").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def _halves(spark, d):
    lines = load(spark, d, "lineitem").select(*LINE_KEYS)
    return lines.where("l_linenumber <= 3"), lines.where("l_linenumber > 3")


@query("combine_union", f"SELECT {LINE_ORDER} FROM lineitem")
def combine_union(spark, d):
    return op.combine(*_halves(spark, d))


@query("combine_sorted", f"""
SELECT l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY {LINE_ORDER}) AS rn FROM lineitem""")
def combine_sorted(spark, d):
    return Ordered(op.combine(*_halves(spark, d)), LINE_KEYS).extend(row_number="rn").drop("l_shipdate")


@query("renumber", f"""
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
       row_number() OVER (PARTITION BY l_suppkey ORDER BY {LINE_ORDER}) - 1 AS "index",
       count(*) OVER (PARTITION BY l_suppkey) AS total FROM lineitem""")
def renumber(spark, d):
    lines = load(spark, d, "lineitem").select(*LINE_KEYS)
    order = [k for k in LINE_KEYS if k != "l_suppkey"]
    placed = numbered(lines, order, "rn", ["l_suppkey"], total="total")
    return placed.select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("rn") - 1).alias("index"), "total"
    )


@query("copy", "SELECT r_regionkey, r_name FROM region")
def copy(spark, d):
    path = scratch_path(spark, "copy")
    load(spark, d, "region").write.parquet(path)
    return spark.read.parquet(path).select("r_regionkey", "r_name")


@query("idempotent_write", "SELECT n_nationkey, n_name FROM nation")
def idempotent_write(spark, d):
    """A dead run's rest is replaced; a further run finds the finished output and leaves it alone."""
    path = scratch_path(spark, "once")
    nations = load(spark, d, "nation").select("n_nationkey", "n_name")
    half = nations.where("n_nationkey < 3").withColumn("n_name", F.lit("half"))
    half.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    write_once(nations, path)
    write_once(nations.withColumn("n_name", F.lit("again")), path)
    return spark.read.schema(nations.schema).parquet(path)


@query("export", """
SELECT c_custkey, c_mktsegment, c_acctbal FROM customer UNION ALL SELECT s_suppkey, 'SUPPLIER', s_acctbal FROM supplier""")
def export(spark, d):
    """Export as JSON lines, append a second table, and read everything back."""
    path = scratch_path(spark, "export")
    customers = load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    suppliers = load(spark, d, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.lit("SUPPLIER").alias("c_mktsegment"), F.col("s_acctbal").alias("c_acctbal")
    )
    customers.write.json(path)
    suppliers.write.mode("append").json(path)
    return spark.read.schema("c_custkey bigint, c_mktsegment string, c_acctbal double").json(path)


CUSTOMERS_BY_STATUS = "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = '{}'"


def _with_status(spark, d, status):
    return load(spark, d, "orders").where(F.col("o_orderstatus") == status).select("o_custkey")


@query("set_intersect", CUSTOMERS_BY_STATUS.format("F") + " INTERSECT " + CUSTOMERS_BY_STATUS.format("O"))
def set_intersect(spark, d):
    return _with_status(spark, d, "F").intersect(_with_status(spark, d, "O"))


@query("set_except", f"""
SELECT 'only F' AS side, * FROM ({CUSTOMERS_BY_STATUS.format('F')} EXCEPT {CUSTOMERS_BY_STATUS.format('O')})
UNION ALL SELECT 'only O', * FROM ({CUSTOMERS_BY_STATUS.format('O')} EXCEPT {CUSTOMERS_BY_STATUS.format('F')})""")
def set_except(spark, d):
    """Both differences from one pass: which sides each key was seen on."""
    sides = (
        load(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O")).groupBy("o_custkey")
        .agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderstatus") == "O").alias("o"))
    )
    return sides.where(F.col("f") != F.col("o")).select(
        F.when(F.col("f"), F.lit("only F")).otherwise(F.lit("only O")).alias("side"), "o_custkey"
    )


@query("set_union", CUSTOMERS_BY_STATUS.format("F") + " UNION " + CUSTOMERS_BY_STATUS.format("O"))
def set_union(spark, d):
    return _with_status(spark, d, "F").union(_with_status(spark, d, "O")).distinct()


@query("distinct_keys", "SELECT DISTINCT source FROM documents ORDER BY source")
def distinct_keys(spark, d):
    return load(spark, d, "documents").select("source").distinct().orderBy("source")


@query("unpivot_scores", """
WITH g AS (SELECT file, species FROM (SELECT DISTINCT l_suppkey % 20 AS file FROM lineitem), (VALUES ('A'), ('N'), ('R')) v(species))
SELECT CAST(g.file AS BIGINT) AS file, g.species, count(l_orderkey) AS score FROM g
LEFT JOIN lineitem ON l_suppkey % 20 = g.file AND l_returnflag = g.species AND l_discount <= 0.01 GROUP BY 1, 2""")
def unpivot_scores(spark, d):
    """Wide score matrix (one column per species) to one row per file and species; blank is 0."""
    lines = load(spark, d, "lineitem")
    wide = (
        lines.groupBy((F.col("l_suppkey") % 20).alias("file")).pivot("l_returnflag", ["A", "N", "R"])
        .agg(F.count(F.when(F.col("l_discount") <= 0.01, F.lit(1))))
    )
    return wide.unpivot("file", ["A", "N", "R"], "species", "score").withColumn("score", F.coalesce("score", F.lit(0)))


@query("run_app", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n, upper(lang) AS lang FROM documents")
def run_app(spark, d):
    def measure(batch, params):
        batch["n"] = batch["text"].str.len().astype("int64")
        batch["lang"] = batch["lang"].str.upper() if params["upper"] else batch["lang"]
        return batch[["doc_id", "n", "lang"]]

    docs = load(spark, d, "documents").select("doc_id", "text", "lang")
    return op.run(docs, measure, "doc_id bigint, n bigint, lang string", {"upper": True})


@query("run_many", """
SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(length(lines[line]) AS BIGINT) AS n
FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""")
def run_many(spark, d):
    """An application that turns one row into several output frames."""

    def lines(batch, params):
        split = batch["text"].str.split("\n", regex=False)
        batch["n"] = split.map(lambda parts: [len(p) for p in parts])
        batch["line"] = split.map(lambda parts: range(1, len(parts) + 1))
        for start in range(0, len(batch), params["rows"]):
            yield batch[start : start + params["rows"]][["doc_id", "line", "n"]].explode(["line", "n"])

    docs = load(spark, d, "documents").select("doc_id", "text")
    return op.run(docs, lines, "doc_id bigint, line bigint, n bigint", {"rows": 500})


@query("pipe_app", "SELECT c_name AS line FROM customer")
def pipe_app(spark, d):
    return op.pipe_through(load(spark, d, "customer"), "c_name", ["cat"])


@query("pipe_counts", "SELECT count(*) AS n, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS size FROM customer")
def pipe_counts(spark, d):
    """A program that answers only at the end of its input, once per task."""
    counted = op.pipe_through(load(spark, d, "customer"), "c_name", ["wc", "-l", "-c"])
    cells = F.split(F.trim("line"), r"\s+")
    return counted.agg(F.sum(cells[0].cast("bigint")).alias("n"), F.sum(cells[1].cast("bigint")).alias("size"))


@query("config_merge", """
SELECT p_partkey, p_size AS memory, CASE WHEN p_size > 25 THEN p_size * 2 ELSE 300 END AS timeout FROM part""")
def config_merge(spark, d):
    """Defaults, then the part's own setting, then an override for large parts."""
    defaults = F.create_map(F.lit("memory"), F.lit(1536), F.lit("timeout"), F.lit(300))
    own = F.create_map(F.lit("memory"), F.col("p_size"))
    override = F.when(F.col("p_size") > 25, F.create_map(F.lit("timeout"), F.col("p_size") * 2)).otherwise(
        F.expr("cast(map() as map<string,int>)")
    )
    config = fn.merged(defaults, own, override)
    return load(spark, d, "part").select("p_partkey", config["memory"].alias("memory"), config["timeout"].alias("timeout"))

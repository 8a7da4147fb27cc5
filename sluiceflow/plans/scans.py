"""Queries that write a table in a record format and scan it back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceflow.functions import text as fn
from sluiceflow.operators import reports as rep
from sluiceflow.operators.neighbors import merge_lists
from sluiceflow.plans.catalog import query
from sluiceflow.plans.joins import KNN, neighbours, vectors
from sluiceflow.plans.orders import BASE5, PIVOTS, chunk_pivots
from sluiceflow.plans.views import READS, TASKLOG, reads, tasklog
from sluiceflow.sources import formats, logs, records, sinks
from sluiceflow.sources.reads import read_fastq
from sluiceflow.sources.vectors import read_fixed_vectors, write_fixed_vectors
from sluiceflow.session import load, scratch_path


def lines_of(spark: SparkSession, df: DataFrame, line: Column, separator: str = "\n") -> str:
    path = scratch_path(spark, "lines")
    sinks.write_lines(df, path, line, separator)
    return path


@query("scan_lines", r"""
SELECT CAST(length(line) AS INTEGER) AS width, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE regexp_matches(line, '\S') GROUP BY 1""")
def scan_lines(spark, d):
    path = lines_of(spark, load(spark, d, "documents"), F.col("text"))
    return records.read_lines(spark, path).groupBy(F.length("value").alias("width")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_tsv", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def scan_tsv(spark, d):
    path = scratch_path(spark, "tsv")
    customers = load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    customers.write.option("header", True).option("sep", "\t").csv(path)
    return records.read_tsv(spark, path, "c_custkey bigint, c_name string, c_mktsegment string")


@query("scan_bed", """
SELECT l_returnflag AS chrom, count(*) AS n, CAST(min(l_partkey) AS DOUBLE) AS first, max(l_partkey + l_quantity) AS last, CAST(sum(l_quantity) AS DOUBLE) AS covered
FROM lineitem GROUP BY 1""")
def scan_bed(spark, d):
    end = F.col("l_partkey") + F.col("l_quantity").cast("bigint")
    path = lines_of(spark, load(spark, d, "lineitem"), F.concat_ws("\t", "l_returnflag", F.col("l_partkey"), end, F.lit("read"), F.lit("+")))
    spans = formats.read(spark, "bed", path, "start_position", "end_position")
    return spans.groupBy("chrom").agg(
        F.count(F.lit(1)).alias("n"), F.min("start_position").alias("first"), F.max("end_position").alias("last"),
        F.sum(F.col("end") - F.col("start")).alias("covered"),
    )


LETTERS = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


@query("scan_fasta", f"SELECT doc_id || ' ' || lang AS header, CAST(length({LETTERS}) AS INTEGER) AS n, md5({LETTERS}) AS sequence FROM documents")
def scan_fasta(spark, d):
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]+", ""))
    wrapped = F.regexp_replace(letters, "(.{60})", "$1\n")
    path = lines_of(spark, load(spark, d, "documents"), F.concat(F.lit(">"), "doc_id", F.lit(" "), "lang", F.lit("\n"), wrapped))
    return records.read_fasta(spark, path).select("header", F.length("sequence").alias("n"), F.md5(F.col("sequence").cast("binary")).alias("sequence"))


@query("scan_fastq", f"""WITH {READS}
SELECT CAST(doc_id AS VARCHAR) AS id, md5(seq) AS seq, md5(translate(seq, 'ACGT', '@I;+')) AS qual, CAST({BASE5} AS BIGINT) AS signature FROM reads""")
def scan_fastq(spark, d):
    """Reads written four lines each; many quality lines begin with `@` or `+`."""
    quality = F.translate("seq", "ACGT", "@I;+")
    path = lines_of(spark, reads(spark, d), F.concat_ws("\n", F.concat(F.lit("@"), "doc_id"), "seq", F.lit("+"), quality))
    scanned = read_fastq(spark, path)
    return scanned.select(
        "id", F.md5(F.col("seq").cast("binary")).alias("seq"), F.md5(F.col("qual").cast("binary")).alias("qual"),
        fn.signature(F.col("seq")).alias("signature"),
    )


@query("custom_format", "SELECT n_name AS name, CAST(n_regionkey AS DOUBLE) AS region FROM nation")
def custom_format(spark, d):
    """A format added by the user: `;`-separated items of `name=region`."""

    def read(session, path):
        cut = F.split("value", "=")
        return session.read.text(path, lineSep=";").where(F.length("value") > 0).select(cut[0].alias("name"), cut[1].alias("number"))

    formats.register_format("pairs", formats.RecordFormat(read, {"region": lambda: F.col("number").cast("double")}))
    path = lines_of(spark, load(spark, d, "nation"), F.concat_ws("=", "n_name", "n_regionkey"), ";")
    return formats.read(spark, "pairs", path, "region").drop("number")


@query("scan_align", """
SELECT 'part' || p_partkey AS target, p_name AS query, p_partkey AS optimal, CASE WHEN p_size % 2 <> 0 THEN CAST(p_size AS BIGINT) END AS suboptimal,
       CAST(p_partkey * 1000 + CASE WHEN p_size % 2 <> 0 THEN p_size ELSE 0 END AS DOUBLE) AS score FROM part""")
def scan_align(spark, d):
    head = F.format_string("target_name: part%d\nquery_name: %s\noptimal_alignment_score: %d", "p_partkey", "p_name", "p_partkey")
    tail = F.when(F.col("p_size") % 2 != 0, F.format_string(" suboptimal_alignment_score: %d", "p_size")).otherwise(F.lit(""))
    path = lines_of(spark, load(spark, d, "part"), F.concat(head, tail), "\n\n")
    return records.read_alignments(spark, path)


@query("scan_spectra", """
SELECT event_id AS scan, event_id AS "index", value AS mass FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0""")
def scan_spectra(spark, d):
    level = F.get_json_object("props", "$.k").cast("bigint") % 2
    spectrum = F.format_string(
        '<spectrum id="controllerType=0 controllerNumber=1 scan=%d" index="%d"><cvParam name="ms level" value="%d"/>'
        '<cvParam name="base peak m/z" value="%s"/><cvParam /></spectrum>',
        "event_id", "event_id", 2 - level, F.col("value").cast("string"),
    )
    path = lines_of(spark, load(spark, d, "events"), spectrum)
    return formats.read(spark, "mzML", path, "id", "mass").select(F.col("id").alias("scan"), F.col("_index").alias("index"), "mass")


@query("scan_vectors", "SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS size, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def scan_vectors(spark, d):
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return load(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").alias("size"), F.round(total, 6).alias("total"))


@query("scan_vector_bytes", "SELECT label, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids, CAST(sum(len(embedding)) AS BIGINT) AS values FROM embeddings GROUP BY 1")
def scan_vector_bytes(spark, d):
    """Vectors written as raw int64 bytes and read back. The first value is the id, held in printable bytes' range."""

    def encode(batches):
        for batch in batches:
            raw = []
            for vec_id, label, size in zip(batch["vec_id"], batch["label"], batch["n"]):
                # Base 200 digits from 32 on never hold a line break.
                digits = [32 + vec_id % 200, 32 + vec_id // 200 % 200, 32 + vec_id // 40_000]
                raw.append(records.vector_bytes(digits + [32] * (size - 3), label))
            yield type(batch)({"raw": raw})

    path = scratch_path(spark, "vectors")
    table = load(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").alias("n"))
    rows = table.mapInPandas(encode, "raw binary")
    sinks.write_lines(rows, path, F.col("raw").cast("string"), "\r\n")
    found = records.read_vectors(spark, path)
    vec_id = (F.col("features")[0] - 32) + (F.col("features")[1] - 32) * 200 + (F.col("features")[2] - 32) * 40_000
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(vec_id).alias("ids"), F.sum(F.size("features")).alias("values"))


@query("scan_fixed_vectors", """
SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS size, CAST(list_sum(list_transform(embedding, lambda e: CAST(round(CAST(e AS DOUBLE) * 1000) AS BIGINT))) AS BIGINT) AS total
FROM embeddings""")
def scan_fixed_vectors(spark, d):
    """Vectors in thousandths, written in records of one width and read back; the first feature is the id, of any bytes."""
    scaled = F.transform("embedding", lambda e: F.round(e.cast("double") * 1000).cast("bigint"))
    table = load(spark, d, "embeddings").select(F.concat(F.array("vec_id"), scaled).alias("features"), "label")
    width = table.agg(F.max(F.size("features"))).first()[0] or 1
    path = scratch_path(spark, "vectors")
    write_fixed_vectors(table, path, width, 3)
    found = read_fixed_vectors(spark, path, width, 3)
    values = F.slice("features", 2, width - 1)
    return found.select(
        F.col("features")[0].alias("vec_id"), "label", F.size(values).alias("size"),
        F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"),
    )


@query("scan_image", """
SELECT label AS g, count(*) AS n, CAST(sum(x) AS BIGINT) AS x, CAST(sum(r) AS BIGINT) AS r, max(y) AS y FROM (
  SELECT label, CAST(vec_id % 256 AS INTEGER) AS y, unnest(range(len(embedding))) AS x,
         unnest(list_transform(embedding, lambda v: CAST(floor((CAST(v AS DOUBLE) + 1) * 100) AS INTEGER))) AS r FROM embeddings) GROUP BY 1""")
def scan_image(spark, d):
    """Vectors drawn as images, 256 to an image and one to a row, and read back pixel by pixel."""
    def draw(key, rows):
        ordered = rows.sort_values("y")
        red = np.floor((np.vstack(ordered["embedding"].to_numpy()).astype("float64") + 1) * 100).astype("uint8")
        planes = np.zeros((*red.shape, 3), dtype="uint8")
        planes[:, :, 0], planes[:, :, 1] = red, ordered["label"].to_numpy()[:, None]
        return pd.DataFrame({"block": [key[0]], "image": [records.png(planes)]})

    path = scratch_path(spark, "images")
    table = load(spark, d, "embeddings").select(F.expr("vec_id div 256").alias("block"), (F.col("vec_id") % 256).alias("y"), "embedding", "label")
    images = table.groupBy("block").applyInPandas(draw, "block bigint, image binary")
    # One row per folder, so one image per file.
    images.select("block", F.col("image").cast("string").alias("value")).write.partitionBy("block").text(path)
    return records.read_image(spark, path).groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("r").alias("r"), F.max("y").alias("y")
    )


def neighbor_file(spark, d) -> str:
    near = neighbours(spark, d).join(vectors(spark, d).select(F.col("id").alias("train_id"), "cls"), "train_id")
    point = F.concat_ws(" ", F.col("test_id") % 25, F.expr("test_id div 25"))
    # Two partial lists per point: even and odd ranks. Each holds at most K entries.
    lists = near.groupBy(point.alias("point"), (F.col("rank") % 2).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("distance").alias("dist"), "cls"))).alias("neighbors")
    )
    return lines_of(spark, lists, records.neighbor_line(F.col("point"), F.col("neighbors")))


NEAR_POINTS = """pts AS (SELECT CAST(CAST(test_id % 25 AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(test_id // 25 AS BIGINT) AS VARCHAR) AS point, round(distance, 6) AS dist, rank FROM near)"""


@query("scan_neighbors", f"""WITH {KNN}, {NEAR_POINTS}
SELECT point, count(*) AS n, min(dist) AS nearest, max(dist) AS furthest, CAST(replace(point, ' ', '.') AS DOUBLE) AS place FROM pts GROUP BY 1""")
def scan_neighbors(spark, d):
    lists = records.read_neighbors(spark, neighbor_file(spark, d))
    flat = lists.select("point", F.inline("neighbors"))
    return flat.groupBy("point").agg(
        F.count(F.lit(1)).alias("n"), F.min("dist").alias("nearest"), F.max("dist").alias("furthest")
    ).withColumn("place", records.point_value(F.col("point")))


@query("merge_neighbor_files", f"""WITH {KNN}, {NEAR_POINTS}
SELECT point, CAST(count(*) AS INTEGER) AS n, max(dist) AS furthest FROM pts WHERE rank <= 3 GROUP BY 1""")
def merge_neighbor_files(spark, d):
    """Partial neighbour files of the same points merged to the 3 nearest."""
    merged = merge_lists(records.read_neighbors(spark, neighbor_file(spark, d)), 3)
    return merged.select("point", F.size("neighbors").alias("n"), F.element_at("neighbors", -1)["dist"].alias("furthest"))


@query("scan_pixels", """
SELECT CAST(l_partkey % 256 AS INTEGER) AS r, count(*) AS n, CAST(sum(l_suppkey % 256) AS BIGINT) AS g, CAST(sum(l_quantity) AS BIGINT) AS b,
       CAST(max(l_orderkey) AS INTEGER) AS x, max(l_linenumber) AS y FROM lineitem GROUP BY 1""")
def scan_pixels(spark, d):
    line = F.concat_ws(" ", "l_orderkey", "l_linenumber", F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_quantity").cast("int"))
    path = lines_of(spark, load(spark, d, "lineitem"), line)
    return records.read_pixels(spark, path).groupBy("r").agg(
        F.count(F.lit(1)).alias("n"), F.sum("g").alias("g"), F.sum("b").alias("b"), F.max("x").alias("x"), F.max("y").alias("y")
    )


def scored_file(spark, d, column: int) -> str:
    """A tab-separated table per return flag whose q-value stands in the given column."""
    path = scratch_path(spark, "scored")
    filler = [F.lit(i).alias(f"f{i}") for i in range(column)]
    rows = load(spark, d, "lineitem").select("l_returnflag", *filler, (F.col("l_discount") + 0.0).alias("qvalue"))
    rows.write.partitionBy("l_returnflag").option("header", True).option("sep", "\t").csv(path)
    return path


SCORED = "SELECT l_returnflag AS file, count(*) FILTER (WHERE l_discount <= 0.01) AS score, count(*) AS total FROM lineitem GROUP BY 1"


def scored(table: DataFrame) -> DataFrame:
    file = F.regexp_extract("path", "l_returnflag=([^/]+)/", 1)
    return table.groupBy(file.alias("file")).agg(rep.hits("qvalue").alias("score"), F.count(F.lit(1)).alias("total"))


@query("scan_confidence", SCORED)
def scan_confidence(spark, d):
    return scored(records.read_confidence(spark, scored_file(spark, d, 9)))


@query("scan_percolator", SCORED)
def scan_percolator(spark, d):
    return scored(records.read_percolator(spark, scored_file(spark, d, 7)))


@query("scan_pivots", f"""WITH {PIVOTS}, whole AS (SELECT chunk, CAST(trunc(boundary) AS BIGINT) AS lo, row_number() OVER (PARTITION BY chunk ORDER BY boundary) AS bin FROM bounds)
SELECT bucket, key, CAST(bin AS INTEGER) AS bin, lo, hi FROM (
  SELECT 'bucket' AS bucket, 'chunk' || chunk AS key, bin, lo, lead(lo) OVER (PARTITION BY chunk ORDER BY bin) AS hi FROM whole) WHERE hi IS NOT NULL""")
def scan_pivots(spark, d):
    """Boundary files, one per chunk of a fixed number of chunks, each with about 8 boundaries."""
    bounds = chunk_pivots(spark, d).groupBy("chunk").agg(F.sort_array(F.collect_list("boundary")).alias("b"))
    content = F.concat_ws("\n", F.lit("bucket"), F.concat(F.lit("chunk"), "chunk"), F.concat_ws("\t", F.col("b").cast("array<string>")))
    path = scratch_path(spark, "pivots")
    bounds.select(content.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return records.read_pivots(spark, path)


@query("scan_polygons", """
SELECT s_name AS name, CAST(s_suppkey AS INTEGER) AS id, CASE WHEN s_nationkey = 0 THEN 0 ELSE 4 END AS corners,
       CASE WHEN s_nationkey = 0 THEN 0.0 ELSE CAST(4 * s_suppkey + 2 * s_nationkey AS DOUBLE) END AS xs FROM (SELECT *, replace(s_name, '#', '_') AS n FROM supplier)
""".replace("s_name AS name", "n AS name"))
def scan_polygons(spark, d):
    s, n = "s_suppkey", "s_nationkey"
    corner = "%d.0 0.0 0,%d.0 0.0 0,%d.0 9.5 0,%d.0 9.5 0,%d.0 0.0 0"
    ring = F.format_string(corner, s, F.col(s) + F.col(n), F.col(s) + F.col(n), s, s)
    shape = F.when(F.col(n) == 0, F.lit('"POLYGON EMPTY",0')).otherwise(F.concat(F.lit('"POLYGON (('), ring, F.lit('))",1')))
    path = lines_of(spark, load(spark, d, "supplier"), F.concat_ws(",", F.replace(F.col("s_name"), F.lit("#"), F.lit("_")), s, shape))
    xs = F.aggregate("vertices", F.lit(0.0), lambda a, v: a + v["x"])
    return records.read_polygons(spark, path).select("name", "id", F.size("vertices").alias("corners"), xs.alias("xs"))


@query("scan_runlog", f"""WITH {TASKLOG}
SELECT stage AS name, CAST(token % 7 AS INTEGER) AS prefix, count(*) AS n, round(CAST(sum(dur_ms) AS DOUBLE), 3) AS duration, round(max(end_us / 1e6), 3) AS last_end FROM tasklog GROUP BY 1, 2""")
def scan_runlog(spark, d):
    """One JSON log per task, naming the key of the task's object."""
    log = tasklog(spark, d)
    key = F.format_string("%d/%.6f-%d/1-1/1-0.000000-1-%s.log", F.col("token") % 7, F.col("start_us") / 1e6, "event_id", "stage")
    path = scratch_path(spark, "logs")
    log.select(
        F.col("stage").alias("name"), (F.col("start_us") / 1e6).alias("start_time"), F.col("dur_ms").cast("double").alias("duration"), key.alias("path")
    ).write.json(path)
    return logs.read_run_logs(spark, path).groupBy("name", F.col("key.prefix").alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("duration"), 3).alias("duration"), F.round(F.max("end_time"), 3).alias("last_end")
    )


@query("explode_lineage", """
SELECT l_returnflag || l_orderkey AS parent, count(*) AS children, CAST(sum(l_linenumber) AS BIGINT) AS file_ids, CAST(max(l_suppkey) AS INTEGER) AS bin FROM lineitem GROUP BY 1""")
def explode_lineage(spark, d):
    """Logs whose payloads name a task's children, read back as one row per child.

    A log holds the children of one task only: a task with more children than
    fit writes further logs under the same name, here one log per line item.
    """
    child = F.struct(
        F.lit("k").alias("key"), F.col("l_suppkey").cast("int").alias("bin"), F.lit(1).alias("num_bins"),
        F.col("l_linenumber").alias("file_id"), F.lit(7).alias("num_files"),
    )
    path = scratch_path(spark, "lineage")
    lines = load(spark, d, "lineitem")
    lines.select(F.concat("l_returnflag", "l_orderkey").alias("name"), F.array(child).alias("payloads")).write.json(path)
    return logs.children(logs.read_run_logs(spark, path)).groupBy("parent").agg(
        F.count(F.lit(1)).alias("children"), F.sum("file_id").alias("file_ids"), F.max("bin").alias("bin")
    )


@query("scan_profile", """
SELECT o_orderpriority AS region, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS size, CAST(sum(o_orderkey % 97) AS DOUBLE) AS duration
FROM orders WHERE o_orderkey % 500 <> 0 GROUP BY 1""")
def scan_profile(spark, d):
    """Profile rows; some have text where the duration should be and are left out."""
    duration = F.when(F.col("o_orderkey") % 500 == 0, F.lit("failed")).otherwise((F.col("o_orderkey") % 97).cast("string"))
    path = scratch_path(spark, "profile")
    load(spark, d, "orders").select(
        F.col("o_orderstatus").alias("name"), F.col("o_custkey").alias("size"), F.col("o_orderpriority").alias("region"),
        F.lit(100_000_000).alias("split_size"), F.lit(1024).alias("memory"), duration.alias("duration"), F.lit(0.5).alias("cost"),
    ).write.option("header", True).csv(path)
    return logs.read_profiles(spark, path).groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("duration").alias("duration")
    )


@query("scan_scores", """
SELECT l_returnflag AS file, species, CAST(sum(score) AS BIGINT) AS score, count(*) AS n FROM (
  SELECT l_returnflag, 'supplier' || l_suppkey AS species, count(*) FILTER (WHERE l_discount <= 0.0) AS score FROM lineitem GROUP BY 1, 2) GROUP BY 1, 2
UNION ALL SELECT l_returnflag, 'Cost', NULL, 1 FROM lineitem GROUP BY 1""")
def scan_scores(spark, d):
    """Score files per return flag: empty scores count as 0 and the cost row is kept apart."""
    counted = load(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count_if(F.col("l_discount") <= 0.0).alias("n"))
    score = F.when(F.col("n") > 0, F.col("n").cast("string")).otherwise(F.lit(""))
    rows = counted.select("l_returnflag", F.concat(F.lit("supplier"), "l_suppkey", F.lit(","), score).alias("value"))
    cost = counted.select("l_returnflag").distinct().withColumn("value", F.lit("Cost,1.25"))
    head = cost.withColumn("value", F.lit("species,score"))
    path = scratch_path(spark, "scores")
    head.unionByName(cost).unionByName(rows).write.partitionBy("l_returnflag").text(path)
    return logs.read_scores(spark, path).groupBy(F.regexp_extract("path", "l_returnflag=([^/]+)/", 1).alias("file"), "species").agg(
        F.sum("score").cast("bigint").alias("score"), F.count(F.lit(1)).alias("n")
    )


@query("scan_score_matrix", """
WITH cell AS (SELECT 'supplier' || l_suppkey AS species, l_returnflag AS file, count(*) FILTER (WHERE l_discount <= 0.0) AS score FROM lineitem GROUP BY 1, 2),
every AS (SELECT f.file, s.species FROM (SELECT DISTINCT file FROM cell) f CROSS JOIN (SELECT DISTINCT species FROM cell) s)
SELECT file, species, coalesce(score, 0) AS score, CAST(NULL AS DOUBLE) AS cost FROM every LEFT JOIN cell USING (file, species)
UNION ALL SELECT file, 'Cost', NULL, 1.25 FROM (SELECT DISTINCT file FROM cell)""")
def scan_score_matrix(spark, d):
    """A wide score table taken apart: blanks are 0, each file gets its own folder with its cost, and is read again."""
    counted = load(spark, d, "lineitem").groupBy(F.concat(F.lit("supplier"), "l_suppkey").alias("species")).pivot("l_returnflag", ["A", "N", "R"]).agg(
        F.count(F.when(F.col("l_discount") <= 0.0, F.lit(1)))
    )
    files = {f"run/{c}": F.nullif(F.col(c), F.lit(0)).cast("string") for c in ("A", "N", "R")}
    cost = spark.range(1).select(F.lit("Cost").alias("species"), *[F.lit("1.25").alias(f) for f in files])
    wide, path = scratch_path(spark, "matrix"), scratch_path(spark, "matrix-files")
    counted.select("species", *[c.alias(f) for f, c in files.items()]).unionByName(cost).write.option("header", True).csv(wide)
    logs.write_score_files(logs.read_score_matrix(spark, wide), path)
    return logs.read_scores(spark, path).select(
        F.regexp_extract("path", "/file=([^/]+)/", 1).alias("file"), "species", F.col("score").cast("bigint").alias("score"), "cost",
    )


@query("scan_access", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events WHERE event_type <> 'error' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' GROUP BY 1""")
def scan_access(spark, d):
    """Access rows in a range of days; rows whose stamp has no time are left out."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    shown = F.when(F.col("event_type") == "error", F.date_format("ts", "yyyy-MM-dd")).otherwise(stamp)
    path = scratch_path(spark, "access")
    filler = [F.lit(i).alias(f"f{i}") for i in range(6)]
    load(spark, d, "events").select(*filler, shown.alias("date")).write.option("header", True).option("quoteAll", True).csv(path)
    day = F.to_date("at")
    kept = logs.read_access(spark, path).where(day.between(F.lit("2024-01-03").cast("date"), F.lit("2024-01-20").cast("date")))
    return kept.groupBy(day.cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_memory_report", f"""WITH {TASKLOG}
SELECT total, count(*) AS n, CAST(sum(used) AS BIGINT) AS used, round(min(start_s), 3) AS first_start FROM (
  SELECT CASE stage WHEN 'view' THEN 128 WHEN 'click' THEN 256 ELSE 1024 END AS total, event_id % 100 AS used, (end_us // 1000) / 1000.0 - dur_ms / 1000.0 AS start_s FROM tasklog) GROUP BY 1
""".replace("THEN 128 WHEN 'click' THEN 256 ELSE 1024 END", "THEN CAST(128 AS BIGINT) WHEN 'click' THEN 256 ELSE 1024 END"))
def scan_memory_report(spark, d):
    total = F.when(F.col("stage") == "view", F.lit(128)).when(F.col("stage") == "click", F.lit(256)).otherwise(F.lit(1024))
    message = F.format_string(
        "REPORT RequestId: %d Duration: %d.0 ms Billed Duration: %d ms Memory Size: %d MB Max Memory Used: %d MB",
        "event_id", "dur_ms", F.col("dur_ms") + 100, total, F.col("event_id") % 100,
    )
    path = scratch_path(spark, "memory")
    tasklog(spark, d).select(F.expr("end_us div 1000").alias("timestamp"), message.alias("message")).write.json(path)
    return logs.read_memory_reports(spark, path).groupBy("total").agg(
        F.count(F.lit(1)).alias("n"), F.sum("used").alias("used"), F.round(F.min("start_time"), 3).alias("first_start")
    )


@query("scan_markers", f"""WITH {TASKLOG}
SELECT stage, round(min(start_us) / 1e6, 3) AS s3_created, round(max(start_us) / 1e6, 3) AS start, round(max(end_us) / 1e6, 3) AS "end" FROM tasklog GROUP BY 1""")
def scan_markers(spark, d):
    """One marker log per stage with its first and last times."""
    times = tasklog(spark, d).groupBy("stage").agg(
        F.min("start_us").alias("created"), F.max("start_us").alias("start"), F.max("end_us").alias("end")
    )
    text = F.format_string(
        "booting\nS3 CREATED TIME: %.6f\nEXECUTION START TIME: %.6f\nEXECUTION END TIME: %.6f\nbye",
        *[F.col(c) / 1e6 for c in ("created", "start", "end")],
    )
    path = scratch_path(spark, "markers")
    times.select("stage", text.alias("value")).write.partitionBy("stage").text(path)
    found = logs.read_markers(spark, path)
    return found.select(
        F.regexp_extract("path", "stage=([^/]+)/", 1).alias("stage"), *[F.round(c, 3).alias(c) for c in ("s3_created", "start", "end")]
    )


@query("scan_incorrect", """
SELECT 'PXD' || o_custkey AS pxd, 'run' || o_orderkey AS run, ' data/run' || o_orderkey || '/PXD' || o_custkey || '/f.mzML ' AS path, 'f.mzML ' AS file,
       o_orderstatus || ' ' AS expected, o_orderpriority AS actual FROM orders""".replace("' data/run'", "'data/run'"))
def scan_incorrect(spark, d):
    line = F.format_string("Incorrect data/run%d/PXD%d/f.mzML Expected %s Actual %s", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return logs.read_incorrect(spark, lines_of(spark, load(spark, d, "orders"), line))


@query("list_objects", "SELECT DISTINCT 'source=' || source AS folder, TRUE AS filled FROM documents")
def list_objects(spark, d):
    """Files below a written table as data: one row per first-level folder."""
    path = scratch_path(spark, "listed")
    load(spark, d, "documents").select("source", "doc_id").write.partitionBy("source").parquet(path)
    files = records.list_objects(spark, path).where(F.col("path").endswith(".parquet") & ~F.col("path").endswith("/"))
    folder = F.regexp_extract("path", "/(source=[^/]+)/", 1)
    return files.groupBy(folder.alias("folder")).agg((F.sum("length") > 0).alias("filled"))


@query("chunk_files", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, TRUE AS within FROM orders")
def chunk_files(spark, d):
    """Orders written to files of at most 1000 rows; every file is checked to hold no more."""
    path = scratch_path(spark, "chunks")
    sinks.write_chunks(load(spark, d, "orders").select("o_orderkey"), path, 1000)
    held = spark.read.schema("o_orderkey bigint").parquet(path).groupBy(F.input_file_name()).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")
    )
    return held.agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"), (F.max("n") <= 1000).alias("within"))

"""Whole flows: search, identification, all-pairs scores and training sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sluiceflow.flow import Flow
from sluiceflow.functions import text as fn
from sluiceflow.operators.confidence import compete, q_values
from sluiceflow.operators import grids, polygons as poly, reports as rep
from sluiceflow.operators.ordered import Ordered
from sluiceflow.operators.overlap import top_overlaps
from sluiceflow.operators.panels import best_panel, panels
from sluiceflow.operators.verbs import match_within
from sluiceflow.plans.catalog import query
from sluiceflow.plans.verbs import ROUTE_CASE, route_column
from sluiceflow.session import load, materialize, spread


# Whole texts that a scorer gets in one batch.
TEXTS = 1000


def count_words(batch, params):
    """Example scorer: words and distinct words of each document; the words of one text are held at a time."""
    texts = batch["text"]
    scores = batch[["doc_id", "source", "n_chars"]].copy()
    scores["words"] = pd.array([t.count(" ") + 1 if isinstance(t, str) else None for t in texts], dtype="Int64")
    scores["distinct"] = pd.array([len(set(t.split(" "))) if isinstance(t, str) else None for t in texts], dtype="Int64")
    return scores


@query("pipe_search", """
SELECT source, count(*) AS n, CAST(count(DISTINCT chunk) AS BIGINT) AS chunks, round(avg(ratio), 6) AS ratio FROM (
  SELECT source, CAST(floor((sum(n_chars) OVER (ORDER BY doc_id) - n_chars) / 100000.0) + 1 AS BIGINT) AS chunk,
         CAST(len(list_distinct(string_split(text, ' '))) AS DOUBLE) / len(string_split(text, ' ')) AS ratio FROM documents)
WHERE ratio >= 0.5 GROUP BY 1""")
def pipe_search(spark, d):
    """Split into chunks, score each document, keep the good ones, and report per source.

    A document's score does not depend on its chunk, so the texts are scored
    where they are read and only the narrow scores are ordered and numbered.
    """
    documents = load(spark, d, "documents").select("doc_id", "text", "source", "n_chars")
    found = (
        Flow(documents)
        .run(count_words, "doc_id bigint, source string, n_chars bigint, words bigint, distinct bigint")
        .transform(lambda scores: materialize(scores, "scores", TEXTS))
        .split(["doc_id"], 100_000, "n_chars")
        .result()
    )
    ratio = F.col("distinct") / F.col("words")
    per_chunk = found.where(ratio >= 0.5).groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum(ratio).alias("ratio"))
    return per_chunk.groupBy("source").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("chunks"), F.round(F.sum("ratio") / F.sum("n"), 6).alias("ratio")
    )


RESCORE_LIMIT = 0.6


@query("pipe_rescore", f"""
WITH word AS (SELECT doc_id, source, list_distinct(list_filter(string_split(lower(text), ' '), lambda w: w <> '')) AS words,
    CAST(floor((sum(n_chars) OVER (ORDER BY doc_id) - n_chars) / 100000.0) + 1 AS BIGINT) AS chunk FROM documents),
result AS (SELECT doc_id, source, chunk, len(list_filter(words, lambda w: substr(w, 1, 1) BETWEEN 'a' AND 'h')) AS score, FALSE AS decoy FROM word
  UNION ALL SELECT doc_id, source, chunk, len(list_filter(words, lambda w: substr(w, -1, 1) BETWEEN 'a' AND 'h')), TRUE FROM word),
best AS (SELECT doc_id, source, chunk, score, decoy FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, decoy DESC) AS r FROM result) WHERE r = 1),
level AS (SELECT score, sum(count(*) FILTER (WHERE decoy)) OVER w AS d, sum(count(*) FILTER (WHERE NOT decoy)) OVER w AS t
  FROM best GROUP BY score WINDOW w AS (ORDER BY score DESC)),
q AS (SELECT score, min(CASE WHEN t > 0 THEN least(1.0, (CAST(d AS DOUBLE) + 1) / t) ELSE 1.0 END) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM level)
SELECT source, count(DISTINCT chunk) AS chunks, count(*) FILTER (WHERE NOT decoy) AS targets, count(*) FILTER (WHERE decoy) AS decoys,
  count(*) FILTER (WHERE NOT decoy AND q <= {RESCORE_LIMIT}) AS confident, round(min(q), 6) AS best_q, round(sum(q), 4) AS sum_q
FROM best JOIN q USING (score) GROUP BY 1""")
def pipe_rescore(spark, d):
    """Split, run against targets and decoys, combine, and rescore the merged results by their q-values.

    A document's targets are its words that begin with a to h, its decoys the same words read backwards.
    """
    documents = load(spark, d, "documents").select("doc_id", "text", "source", "n_chars")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), " ", -1), lambda w: w != ""))
    hits = lambda place: F.size(F.filter(words, lambda w: F.substring(w, place, 1).between("a", "h"))).cast("bigint")
    searched = (
        Flow(documents.select("doc_id", "source", "n_chars", hits(1).alias("target"), hits(-1).alias("reverse")))
        .transform(lambda scores: materialize(scores, "scores", TEXTS))
        .split(["doc_id"], 100_000, "n_chars")
        .result()
    )
    runs = [searched.select("doc_id", "source", "chunk", F.col(c).alias("score"), F.lit(c == "reverse").alias("decoy")) for c in ("target", "reverse")]
    best = materialize(compete(Flow(runs[0]).combine(runs[1]).result(), ["doc_id", "source", "chunk"], "score", "decoy"), "merged")
    rescored = q_values(best, "score", "decoy", "q")
    target = ~F.col("decoy")
    return rescored.groupBy("source").agg(
        F.count_distinct("chunk").alias("chunks"), F.count_if(target).alias("targets"), F.count_if(F.col("decoy")).alias("decoys"),
        F.count_if(target & (F.col("q") <= RESCORE_LIMIT)).alias("confident"), F.round(F.min("q"), 6).alias("best_q"), F.round(F.sum("q"), 4).alias("sum_q"),
    )


@query("pipe_route", f"SELECT target, count(*) AS n FROM (SELECT {ROUTE_CASE} AS target FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 500) GROUP BY 1")
def pipe_route(spark, d):
    """The 500 largest documents, each routed by the rules."""
    documents = load(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    best = Flow(documents).top("n_chars", 500, "doc_id").result()
    return best.groupBy(route_column().alias("target")).agg(F.count(F.lit(1)).alias("n"))


# Words of a panel: a parameter of `panels`.
PANEL_WORDS = 50
WORDS = "token AS (SELECT DISTINCT doc_id, lang, word FROM (SELECT doc_id, lang, unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> '')"


@query("pipe_identify", f"""WITH {WORDS},
panel AS (SELECT lang AS species, word FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM token GROUP BY lang, word) WHERE r <= {PANEL_WORDS}),
score AS (SELECT doc_id, species, count(*) AS overlap FROM token JOIN panel USING (word) GROUP BY 1, 2),
best AS (SELECT doc_id, species, overlap FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, species) AS r FROM score) WHERE r = 1)
SELECT lang, count(*) FILTER (WHERE overlap >= 5 AND species = lang) AS correct, count(*) FILTER (WHERE overlap IS NULL OR overlap < 5) AS unknown,
       count(*) FILTER (WHERE overlap >= 5 AND species <> lang) AS wrong FROM documents LEFT JOIN best USING (doc_id) GROUP BY 1""")
def pipe_identify(spark, d):
    """Best word panel for every document: panels, score, match, and the tally of the answers.

    A document meets the panels where it is read; only its answer goes on.
    """
    documents = spread(load(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id")
    tokens = documents.select("lang", F.explode(fn.words(F.col("text"))).alias("word"))
    answered = best_panel(documents, fn.words(F.col("text")), panels(tokens, "lang", "word", PANEL_WORDS))
    known, right = F.col("best.overlap") >= 5, F.col("best.species") == F.col("lang")
    return answered.groupBy("lang").agg(
        F.count_if(known & right).alias("correct"), F.count_if(~known).alias("unknown"), F.count_if(known & ~right).alias("wrong")
    )


@query("pipe_identify_routed", f"""WITH {WORDS},
panel AS (SELECT lang AS species, word FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM token GROUP BY lang, word) WHERE r <= {PANEL_WORDS}),
largest AS (SELECT doc_id, lang, {ROUTE_CASE} AS target FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 500),
score AS (SELECT doc_id, species, count(*) AS overlap FROM (SELECT doc_id, word FROM token JOIN largest USING (doc_id)) JOIN panel USING (word) GROUP BY 1, 2),
best AS (SELECT doc_id, species, overlap FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, species) AS r FROM score) WHERE r = 1)
SELECT target, count(*) AS n, count(*) FILTER (WHERE overlap >= 5 AND species = lang) AS correct,
  count(*) FILTER (WHERE overlap IS NULL OR overlap < 5) AS unknown, count(*) FILTER (WHERE overlap >= 5 AND species <> lang) AS wrong,
  CAST(sum(coalesce(overlap, 0)) AS BIGINT) AS shared
FROM largest LEFT JOIN best USING (doc_id) GROUP BY 1""")
def pipe_identify_routed(spark, d):
    """The 500 largest documents: top, route, map over the panels of all documents, best match, and a tally per route."""
    documents = spread(load(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", "text"), "doc_id")
    found = panels(documents.select("lang", F.explode(fn.words(F.col("text"))).alias("word")), "lang", "word", PANEL_WORDS)
    largest = (
        Flow(documents)
        .top("n_chars", 500, "doc_id")
        .transform(lambda best: materialize(best.select("doc_id", "lang", route_column().alias("target"), fn.words(F.col("text")).alias("found")), "largest"))
    )
    overlap = F.size(F.array_intersect("found", "words")).alias("overlap")
    pairs = largest.map(lambda met: met.select("doc_id", "species", overlap), materialize(found, "panels"), ["species"]).result()
    best = match_within(pairs, ["doc_id"], "species", "overlap")
    known, right = F.coalesce("overlap", F.lit(0)) >= 5, F.col("species") == F.col("lang")
    return largest.result().drop("found").join(best, "doc_id", "left").groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known & right).alias("correct"), F.count_if(~known).alias("unknown"),
        F.count_if(known & ~right).alias("wrong"), F.sum(F.coalesce("overlap", F.lit(0))).alias("shared"),
    )


PAIRS = """a AS (SELECT DISTINCT item_id, word FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS word FROM benchmark) WHERE word <> ''),
b AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> ''),
best AS (SELECT item_id, doc_id, count(*) AS score FROM a JOIN b USING (word) GROUP BY 1, 2 ORDER BY score DESC, item_id, doc_id LIMIT 100)"""


def best_pairs(spark, d):
    left = load(spark, d, "benchmark").select("item_id", fn.words(F.col("text")).alias("words"))
    documents = spread(load(spark, d, "documents").select("doc_id", "text"), "doc_id")
    right = documents.select("doc_id", fn.words(F.col("text")).alias("words"))
    return top_overlaps(left, right, "item_id", "doc_id", 100)


@query("pipe_pairs", f"WITH {PAIRS} SELECT * FROM best")
def pipe_pairs(spark, d):
    """The 100 pairs of benchmark item and document with the most words in common."""
    return best_pairs(spark, d)


@query("pipe_pairs_sorted", f"""WITH {PAIRS}
SELECT item_id, doc_id, score, row_number() OVER (ORDER BY score, item_id, doc_id) AS rn,
       CAST(floor((row_number() OVER (ORDER BY score, item_id, doc_id) - 1) / 10.0) AS INTEGER) AS bin FROM best""")
def pipe_pairs_sorted(spark, d):
    """The same pairs in ascending order, numbered and cut into bins of 10."""
    placed = Ordered(best_pairs(spark, d), ["score", "item_id", "doc_id"]).extend(row_number="rn")
    return placed.withColumn("bin", F.floor((F.col("rn") - 1) / 10).cast("int"))


# The two outlines of the training flow, on the grid of labels.
AREAS = {
    "field": [(2.0, 2.0), (12.0, 2.0), (12.0, 9.0), (2.0, 9.0)],
    "wedge": [(14.0, 5.0), (23.0, 11.0), (15.0, 18.0)],
}
AREA_EDGES = "edge(x1, y1, x2, y2, name) AS (VALUES " + ", ".join(
    f"({a[0]}, {a[1]}, {b[0]}, {b[1]}, '{name}')"
    for name, ring in AREAS.items() for a, b in zip(ring, ring[1:] + ring[:1])
) + ")"


@query("pipe_training", f"""WITH {AREA_EDGES},
cell AS (SELECT CAST(vec_id % 25 AS BIGINT) AS x, CAST(vec_id // 25 AS BIGINT) AS y, label FROM embeddings),
blur AS (SELECT a.x, a.y, CAST(floor(avg(b.label) * 10) AS BIGINT) AS v FROM cell a JOIN cell b ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 GROUP BY 1, 2),
slot AS (SELECT dx, dy FROM (SELECT unnest(range(-1, 2)) AS dx) CROSS JOIN (SELECT unnest(range(-1, 2)) AS dy)),
feature AS (SELECT c.x, c.y, string_agg(CAST(coalesce(g.v, 0) AS VARCHAR), ',' ORDER BY s.dy, s.dx) AS features
  FROM blur c CROSS JOIN slot s LEFT JOIN blur g ON g.x = c.x + s.dx AND g.y = c.y + s.dy GROUP BY 1, 2),
hit AS (SELECT x, y, name,
    bool_or((x = x1 AND y = y1) OR (x = x2 AND y = y2) OR (abs((y - y1) * (x2 - x1) - (x - x1) * (y2 - y1)) <= 10
      AND (x - x1) * (x2 - x1) + (y - y1) * (y2 - y1) BETWEEN 0 AND (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS near,
    x BETWEEN min(x1) AND max(x1) AND y BETWEEN min(y1) AND max(y1)
      AND count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x1 - x2) * (y - y2) / nullif(y1 - y2, 0) + x2) % 2 = 1 AS within
  FROM cell CROSS JOIN edge GROUP BY x, y, name),
labelled AS (SELECT DISTINCT features, cls FROM feature JOIN (
  SELECT x, y, CASE WHEN bool_or(near) THEN 1 WHEN bool_or(within) THEN 0 ELSE 2 END AS cls FROM hit GROUP BY 1, 2) USING (x, y))
SELECT features, cls FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5(features), features) AS r FROM labelled)
WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labelled GROUP BY cls))""")
def pipe_training(spark, d):
    """Training set: blur, window features, label by outline, drop repeats, and balance the classes."""
    cells = load(spark, d, "embeddings").select(
        (F.col("vec_id") % 25).alias("x"), F.expr("vec_id div 25").alias("y"), F.col("label").cast("bigint").alias("v")
    )
    blurred = grids.around(cells, ["v"], [F.floor(F.avg("v") * 10).cast("bigint").alias("blur")])
    features = grids.window_features(blurred, "blur").select("x", "y", F.concat_ws(",", F.col("features").cast("array<string>")).alias("features"))
    # Two outlines, known here, so they are constants of the expression.
    near, within = F.lit(False), F.lit(False)
    for ring in AREAS.values():
        vertices = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring])
        near = near | poly.near_edge(vertices, F.col("x"), F.col("y"))
        within = within | poly.inside(vertices, F.col("x"), F.col("y"))
    cls = F.when(near, F.lit(grids.BORDER)).when(within, F.lit(grids.INSIDE)).otherwise(F.lit(grids.OUTSIDE))
    labelled = materialize(features.select("features", cls.alias("cls")).distinct(), "labelled")
    return rep.balanced(labelled, "cls", "features")

"""The registered queries of this package, and the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluiceflow.llm import (
    chat, collocations, decontaminate, findings, lm_scores, media, overlap_join, packed, simhash, sites, url_rules, variants,
)
from sluiceflow.llm.common import keep
from sluiceflow.session import load, small_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_media(spark: SparkSession, directory: str) -> DataFrame:
    return media.features(keep(media.store(load(spark, directory, "documents")), "media", rows=500))


def op2_simhash(spark: SparkSession, directory: str) -> DataFrame:
    return simhash.near_copies(load(spark, directory, "documents"))


def op3_secrets(spark: SparkSession, directory: str) -> DataFrame:
    return findings.scan(load(spark, directory, "documents"))


def op4_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    return decontaminate.contamination(load(spark, directory, "documents"), load(spark, directory, "benchmark"))


def op5_lm_scores(spark: SparkSession, directory: str) -> DataFrame:
    return lm_scores.score(load(spark, directory, "documents"))


RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op6_url_rules(spark: SparkSession, directory: str) -> DataFrame:
    rules = small_table(spark, RULES, "host string, path string, action string")
    return url_rules.judge(load(spark, directory, "pages"), rules)


SAMPLE_TURN = "</s>[INST] ok [/INST]"


def op7_chat_windows(spark: SparkSession, directory: str) -> DataFrame:
    sample = small_table(
        spark, [(-1, 0, "user", SAMPLE_TURN), (-1, 1, "assistant", SAMPLE_TURN)], "conv_id long, turn long, role string, text string",
    )
    turns = load(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(keep(chat.windows(turns.unionByName(sample)), "chat-windows"))


def op8_token_matrices(spark: SparkSession, directory: str) -> DataFrame:
    return packed.pack_ids(load(spark, directory, "documents"))


def op9_grouped_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packed.pack_grouped(load(spark, directory, "documents"))


def op10_site_quality(spark: SparkSession, directory: str) -> DataFrame:
    return sites.quality(load(spark, directory, "documents"), load(spark, directory, "labels"))


def op11_jaccard_join(spark: SparkSession, directory: str) -> DataFrame:
    return overlap_join.similar_sets(load(spark, directory, "documents"))


def op12_spelling_variants(spark: SparkSession, directory: str) -> DataFrame:
    return variants.grouped(load(spark, directory, "documents"))


def op13_collocations(spark: SparkSession, directory: str) -> DataFrame:
    return collocations.collocations(load(spark, directory, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_media, op2_simhash, op3_secrets, op4_decontamination, op5_lm_scores, op6_url_rules,
        op7_chat_windows, op8_token_matrices, op9_grouped_packing, op10_site_quality, op11_jaccard_join,
        op12_spelling_variants, op13_collocations,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4_SQL = f"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM item WHERE len(words) > 0)),
doc AS (SELECT row_number() OVER () AS nr, doc_id, {_WORDS} AS words FROM documents),
starts AS (SELECT nr, words, len(words) AS n, unnest(range(1, len(words) + 1)) AS i FROM doc),
sizes AS (SELECT DISTINCT size FROM windows),
hit AS (
  SELECT s.nr, s.i, w.size, w.item_id
  FROM (SELECT nr, i, size, array_to_string(words[i:i + size - 1], ' ') AS win FROM starts, sizes WHERE i + size - 1 <= n) s
  JOIN windows w ON w.win = s.win AND w.size = s.size),
hits AS (
  SELECT nr, count(DISTINCT place) AS n_hit FROM (SELECT nr, unnest(range(i, i + size)) AS place FROM hit) GROUP BY nr),
names AS (
  SELECT nr, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT nr, item_id FROM hit) GROUP BY nr)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hits USING (nr) LEFT JOIN names USING (nr)"""

OP6_SQL = """
WITH rules(host, path, action) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES) + f"""),
page AS (
  SELECT row_number() OVER () AS nr, page_id,
         {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ranked AS (
  SELECT p.nr, r.host || r.path AS rule, r.action,
         row_number() OVER (PARTITION BY p.nr ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.action DESC) AS k
  FROM page p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM page LEFT JOIN (SELECT * FROM ranked WHERE k = 1) USING (nr)"""

_ESCAPED = r"regexp_replace(replace({}, '\', '\\'), '([<\[])(\||/?s>|/?INST\])', '\1\\\2', 'g')"
_SPACED = r"[^ \t\n\x0b\f\r]+"

OP7_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{SAMPLE_TURN}'), (-1, 1, 'assistant', '{SAMPLE_TURN}')),
escaped AS (
  SELECT *, {chat.TURN_TOKENS} + len(regexp_extract_all(text, '{_SPACED}')) AS size,
         {len(chat.TURN) + len(chat.TEXT) + len(chat.END)}
         + length({_ESCAPED.format('role')})
         + length({_ESCAPED.format('text')}) AS chars
  FROM turns),
counted AS (
  SELECT *, row_number() OVER w AS nr, sum(size) OVER w AS upto, first(CASE WHEN role = 'system' THEN size END) OVER w AS sys,
         first(CASE WHEN role = 'system' THEN chars END) OVER w AS sys_chars
  FROM escaped WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
placed AS (
  SELECT *, upto - size - coalesce(sys, 0) AS before, upto - coalesce(sys, 0) - 1 AS last,
         greatest({chat.BUDGET - chat.HISTORY_TOKENS} - coalesce(sys, 0), 1) AS cell, nr = 1 AND sys IS NOT NULL AS heading
  FROM counted),
spanned AS (
  SELECT *, CASE WHEN NOT heading THEN 2 * (before // cell) + (last // cell > before // cell)::INT END AS span FROM placed),
begun AS (
  SELECT *, NOT heading AND lag(span) OVER w IS DISTINCT FROM span AS begins
  FROM spanned WINDOW w AS (PARTITION BY conv_id ORDER BY nr)),
repeated AS (
  SELECT b.conv_id, sum(h.chars) AS chars FROM begun b JOIN begun h
    ON h.conv_id IS NOT DISTINCT FROM b.conv_id AND h.nr BETWEEN b.nr - {chat.HISTORY_TURNS} AND b.nr - 1
   AND NOT h.heading AND b.before - h.before <= {chat.HISTORY_TOKENS}
  WHERE b.begins GROUP BY b.conv_id)
SELECT b.conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nr) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(b.chars) + coalesce(sum(sys_chars) FILTER (WHERE begins AND nr > 2), 0) + coalesce(any_value(r.chars), 0) AS BIGINT)
         AS formatted_chars
FROM begun b LEFT JOIN repeated r ON r.conv_id IS NOT DISTINCT FROM b.conv_id GROUP BY b.conv_id"""

OP11_SQL = f"""
WITH RECURSIVE doc AS MATERIALIZED (
  SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') AS words FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT nr, array_to_string(words[i:i + 4], ' ') AS s
  FROM (SELECT nr, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM doc WHERE len(words) > 0)),
sizes AS MATERIALIZED (SELECT nr, count(*) AS n FROM shingles GROUP BY nr),
overlap AS (
  SELECT a.nr AS a, b.nr AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.nr <> b.nr GROUP BY a.nr, b.nr),
links AS MATERIALIZED (
  SELECT a, b FROM overlap JOIN sizes x ON x.nr = a JOIN sizes y ON y.nr = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(doc_id) AS low FROM reach JOIN doc ON nr = b GROUP BY a),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN low < doc_id OR doc_id IS NULL THEN low ELSE doc_id END AS component_id,
       coalesce(n_links, 0) AS n_links
FROM doc LEFT JOIN sizes USING (nr) LEFT JOIN least ON least.a = nr LEFT JOIN degree ON degree.a = nr"""

OP13_SQL = f"""
WITH pieces AS (
  SELECT row_number() OVER () AS nr, lang, regexp_extract_all(piece, '[^ \\t]+') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\n\\x0b\\f\\r]')) AS piece
        FROM documents)),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
grams AS MATERIALIZED (
  SELECT lang, words[i:i + size - 1] AS g, size, count(*) AS f
  FROM places, (VALUES (1), (2), (3), (4)) s(size) WHERE i + size - 1 <= len(words) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang),
candidate AS MATERIALIZED (SELECT * FROM grams WHERE size > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.g, c.f, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidate) c
  JOIN grams x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN grams y ON y.lang = c.lang AND y.g = c.g[c.k + 1:c.size]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_part AS (
  SELECT lang, g[i:i + n - 1] AS g, max(f) AS around
  FROM (SELECT lang, g, f, size, n, unnest(range(1, size - n + 2)) AS i FROM candidate, (VALUES (2), (3)) p(n) WHERE n < size) GROUP BY ALL),
stay AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.f AS a, l, r, CAST(score AS BIGINT) AS score
  FROM best b LEFT JOIN inner_part p ON p.lang = b.lang AND p.g = b.g WHERE around IS NULL OR 100 * around < 80 * b.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM stay JOIN totals USING (lang) QUALIFY rank <= 2000"""

ORACLES: dict[str, str] = {
    "op4_decontamination": OP4_SQL, "op6_url_rules": OP6_SQL, "op7_chat_windows": OP7_SQL, "op11_jaccard_join": OP11_SQL, "op13_collocations": OP13_SQL,
}

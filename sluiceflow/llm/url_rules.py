"""URL rules by host suffix and path prefix, matched through an equi-join on short hash prefixes.

Every distinct (host, path) is expanded into its host suffixes, by label, times
its path prefixes, of the lengths that rules have. The first digits of each
expression's digest meet those of the rules in an equi-join; the full digests
then confirm, and the longest rule wins (after that the longer host, then block
before allow). All of it is built-in functions.

A null url, or one without `://`, has an empty host and path and is judged like
any other. Rules without a host or action are left out, a null path is empty.
Repeated rows and ids stay rows; no rules or no pages give no matches or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_DIGITS = 8  # 32 bits
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Host suffixes times path prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))


def judge(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
) -> DataFrame:
    """A row per page: id, host, path, the rule that decides (null if none) and the verdict.

    `rules` has host, path and action (allow or block).
    """
    listed = rules.select(
        F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "action",
    ).where("rule_host IS NOT NULL AND action IS NOT NULL")
    rule = F.concat("rule_host", "rule_path")
    digest = F.sha2(rule, 256)
    listed = listed.select(
        rule.alias("rule"), "action", digest.alias("rule_digest"), F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"),
        # What precedence compares, in order.
        F.struct(F.length(rule), F.length("rule_host"), F.col("action") == "block").alias("rank"),
    )
    # As many numbers as rule paths have different lengths.
    lengths = sorted(r[0] for r in rules.select(F.length(F.coalesce("path", F.lit("")))).distinct().collect())
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not lengths:
        return judged.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    places = judged.select("host", "path").distinct()
    keys = places.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("expression"))
    keys = keys.select("host", "path", F.sha2("expression", 256).alias("digest"))
    keys = keys.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    matches = (
        keys.join(listed, "prefix").where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), "rank").alias("won"))
    )
    return judged.join(matches, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.action", F.lit(default)).alias("verdict"),
    )

"""The n pairs of rows that share the most words, over two whole tables.

Scoring every pair is never needed. A few promising rows of both sides give a
score that n pairs are known to reach. A pair can only reach it if the two rows
share a word among their rarest ones (prefix filtering, Chaudhuri et al., ICDE
2006; top-k form, Xiao et al., ICDE 2009), so only those words are joined on.
Frequent words, which would pair nearly all rows, stay out of the join. Rows
with equal words are joined once, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceflow.operators.verbs import replicated_if_small, top
from sluiceflow.session import materialize

SEEDS = 32
# Largest vocabulary, in words, that is copied to every executor.
WORD_LIMIT = 200_000


def _weighted(words: DataFrame, key: str, frequency: DataFrame) -> DataFrame:
    """(key, words): each row's words that both sides know, rarest first."""
    return (
        words.join(frequency, "word")
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("freq", "word"))).alias("ranked"))
        .select(key, F.transform("ranked", lambda r: r["word"]).alias("words"))
    )


def _distinct_sets(rows: DataFrame, key: str, number: int) -> DataFrame:
    """(first, words, ids): each distinct word list with its `number` smallest keys.

    Pairs of copies all score the same and are ranked by their keys, so further
    copies cannot be among the best; each task drops them before the shuffle.
    """
    digested = rows.withColumn("__set", F.sha2(F.to_json("words"), 256))
    copies = Window.partitionBy("__set").orderBy(key)
    kept = digested.withColumn("__copy", F.row_number().over(copies)).where(F.col("__copy") <= number)
    sets = kept.groupBy("__set").agg(F.sort_array(F.collect_list(key)).alias("ids"), F.min_by("words", key).alias("words"))
    return sets.select(F.element_at("ids", 1).alias("first"), "words", "ids")


def top_overlaps(left: DataFrame, right: DataFrame, left_key: str, right_key: str, number: int) -> DataFrame:
    """(left_key, right_key, score) of the `number` best pairs; each input is (key, words), words distinct."""
    a = left.select(left_key, F.explode("words").alias("word"))
    known = materialize(a.groupBy("word").agg(F.count(F.lit(1)).alias("na")), "known")
    # The long side is cut into words once; only words the other side has are kept.
    b = materialize(
        right.select(right_key, F.explode("words").alias("word"))
        .join(replicated_if_small(known.select("word"), WORD_LIMIT), "word", "left_semi"),
        "words",
    )
    counted = b.groupBy("word").agg(F.count(F.lit(1)).alias("nb")).join(known, "word")
    frequency = counted.select("word", (F.col("na") * F.col("nb")).alias("freq"))
    small = replicated_if_small(frequency, WORD_LIMIT, settle=True)
    a_sets = materialize(_distinct_sets(_weighted(a, left_key, small), left_key, number), "left")
    b_sets = materialize(_distinct_sets(_weighted(b, right_key, small), right_key, number), "right")

    score = F.size(F.array_intersect("lw", "rw")).cast("bigint")

    def longest(sets: DataFrame, words: str) -> DataFrame:
        best = top(sets.withColumn("n", F.size("words")), SEEDS, "n", "first")
        return best.select(F.col("words").alias(words), F.lit(0).alias("j"))

    # SEEDS² pairs at most.
    seeds = longest(a_sets, "lw").join(F.broadcast(longest(b_sets, "rw")), "j")
    reached = seeds.select(score.alias("score")).orderBy(F.desc("score")).limit(number)
    floor, seen = reached.agg(F.min("score"), F.count(F.lit(1))).first()
    least = max(1, floor or 1) if seen == number else 1

    def rare(sets: DataFrame, name: str) -> DataFrame:
        length = F.size("words") - least + 1
        return sets.where(length > 0).select(F.col("first").alias(name), F.explode(F.slice("words", 1, length)).alias("word"))

    def members(sets: DataFrame, name: str, words: str, ids: str) -> DataFrame:
        return sets.select(F.col("first").alias(name), F.col("words").alias(words), F.col("ids").alias(ids))

    candidates = rare(a_sets, "a").join(rare(b_sets, "b"), "word").select("a", "b").distinct()
    scored = (
        candidates.join(members(a_sets, "a", "lw", "lids"), "a")
        .join(members(b_sets, "b", "rw", "rids"), "b")
        .select("a", "b", "lids", "rids", score.alias("score"))
        .where(F.col("score") >= least)
    )
    # The first pair of a set pair comes before its others, so `number` set pairs are enough.
    best = scored.orderBy(F.desc("score"), "a", "b").limit(number)
    needed = F.ceil(F.lit(number) / F.size("rids")).cast("int")
    pairs = best.select(F.explode(F.slice("lids", F.lit(1), needed)).alias(left_key), "rids", "score").select(
        left_key, F.explode("rids").alias(right_key), "score"
    )
    return pairs.orderBy(F.desc("score"), left_key, right_key).limit(number)

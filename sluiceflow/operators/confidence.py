"""Confidence of search results from targets and decoys: a second stage over the merged results of a first.

A decoy is a made-up entry that no true result can match, so the decoys at or
above a score estimate the wrong targets there. The q-value of a row is the
smallest such estimate at its own score or any lower one that still admits it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceflow.operators.ordered import Ordered


def compete(results: DataFrame, keys: Sequence[str], score: str, decoy: str) -> DataFrame:
    """One row per key: its best score and whether that is a decoy's; a decoy wins a tie. Null scores are no results."""
    rank = F.struct(F.col(score).alias("s"), F.col(decoy).cast("int").alias("d"))
    best = results.where(F.col(score).isNotNull() & F.col(decoy).isNotNull()).groupBy(*keys).agg(F.max(rank).alias("__best"))
    return best.select(*keys, F.col("__best.s").alias(score), (F.col("__best.d") == 1).alias(decoy))


def q_values(results: DataFrame, score: str, decoy: str, name: str = "q_value", within: Sequence[str] = ()) -> DataFrame:
    """`results` with the q-value of each row among all rows, or those of its group in `within`; higher scores are better.

    The estimate at a score is (decoys + 1) / targets over all rows of that score or more, 1 at most, and 1 where there
    are no targets. Rows of one score share one value. Rows without a score or a kind get null and are not counted.
    Scores are counted first, so what is put in order is as small as there are different scores, and no group passes
    through one task.
    """
    valid = F.col(score).isNotNull() & F.col(decoy).isNotNull()
    renamed = [F.col(c).alias(f"__of_{i}") for i, c in enumerate(within)]
    groups = [f"__of_{i}" for i in range(len(within))]
    counts = results.where(valid).groupBy(*renamed, F.col(score).alias("__score")).agg(
        F.count_if(F.col(decoy)).alias("__decoys"), F.count_if(~F.col(decoy)).alias("__targets"),
    )
    summed = Ordered(counts, [F.desc("__score")], groups).extend(running={"__d": F.col("__decoys"), "__t": F.col("__targets")})
    rate = F.when(F.col("__t") > 0, F.least(F.lit(1.0), (F.col("__d") + 1) / F.col("__t"))).otherwise(F.lit(1.0))
    rated = summed.select(*groups, "__score", rate.alias("__rate"))
    least = Ordered(rated, [F.desc("__score")], groups).extend(least_after={name: F.col("__rate")})
    found = least.select(*groups, "__score", F.col(name).alias("__q"))
    same: Column = F.col(score) == F.col("__score")
    for column, group in zip(within, groups):
        same = same & F.col(column).eqNullSafe(F.col(group))
    value = F.when(valid, F.col("__q")).alias(name)
    return results.join(found, same, "left").select(*results.columns, value)

"""Quality by hierarchical empirical Bayes: document evidence with host and path posteriors.

A logistic classifier, fitted in numpy on labelled documents, gives each document
a probability. Grouped sums of the labels, and of these where there is no label,
give each host, and each path within it, a posterior share of good documents: a
beta prior at the global share shrinks hosts, and a host's posterior shrinks its paths, each with a
strength fitted to the spread between groups (method of moments), so sparse
sites stay near what is above them. A document's posterior odds are its own
evidence times the odds of its path without it: what it adds to the sums of its
path and host is taken out first, so that nothing is counted twice. The shares in
the result are those of all documents.

Null texts are empty texts and judged by the same features; null hosts and paths
are groups of their own; repeated rows stay. Labels that are null or disagree
are left out of the fit and of the sums, and so are those without an id; all rows
of a labelled id count with its label. Without labels of both kinds the document evidence is
neutral. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from sluiceflow.llm.common import extended, fresh, keep

# Bound on the labelled documents that the classifier is fitted on, spread by hash over all that there are.
FIT_ROWS = 20_000
# A document is rejected when the posterior probability that it is good is below this.
THRESHOLD = 0.5
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[list(b" \t\n\v\f\r")] = 1
_KINDS[list(b"abcdefghijklmnopqrstuvwxyz")] = 2
_KINDS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 3
_KINDS[list(b"0123456789")] = 4
_KINDS[list(b".,;:?'\"-()")] = 5
_KINDS[128:] = 6
_KINDS[10] = 8
# 0: symbols and controls; 7: exclamation marks; 8: line ends
_KINDS[ord("!")] = 7
N_KINDS = 9
WIDTH = 1 + N_KINDS + N_KINDS * N_KINDS + 3


def features(text: str | None) -> np.ndarray:
    """Shares of character kinds and of pairs of kinds, word length, lines and length of a text."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    kinds = _KINDS[data]
    out = np.zeros(WIDTH, dtype=np.float64)
    out[0] = 1.0
    if len(kinds):
        one = np.bincount(kinds, minlength=N_KINDS)
        pairs = np.bincount(kinds[:-1].astype(np.int64) * N_KINDS + kinds[1:], minlength=N_KINDS * N_KINDS)
        out[1 : 1 + N_KINDS] = one / len(kinds)
        out[1 + N_KINDS : 1 + N_KINDS + N_KINDS * N_KINDS] = pairs / len(kinds)
        gaps = one[1] + one[8] + 1
        out[-3:] = np.log1p(len(kinds) / gaps), np.log1p(len(kinds) / (one[8] + 1)), np.log1p(len(kinds)) / 10
    return out


def fit(rows: np.ndarray, good: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps on standardised features; weights for raw features."""
    middle, scale = rows.mean(axis=0), rows.std(axis=0)
    scale[scale < 1e-9] = np.inf  # constant features get no weight
    x = np.nan_to_num((rows - middle) / scale)
    x[:, 0] = 1.0
    weights = np.zeros(x.shape[1])
    penalty = np.full(len(weights), ridge * len(x))
    penalty[0] = 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (good - p) - penalty * weights
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    raw = np.where(np.isfinite(scale), weights / scale, 0.0)
    raw[0] = weights[0] - float((raw[1:] * middle[1:]).sum())
    return raw


def votes(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, good): one row per id whose labels agree."""
    return labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.min(label_col).alias("low"), F.max(label_col).alias("high"),
    ).where("low = high AND id IS NOT NULL").select("id", F.col("low").cast("int").alias("good"))


def classifier(documents: DataFrame, voted: DataFrame, id_col: str, text_col: str, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Weights, and the share of good labels; features are computed in tasks, about `fit_rows` at most come to the driver.

    `voted` is as `votes` gives it. Of several rows of an id the one with the largest features, by their bytes, stands for it.
    """
    n, share = voted.agg(F.count("*"), F.avg("good")).first()
    if not n or share in (0.0, 1.0):
        return np.zeros(WIDTH), share if n else 0.5
    portion = min(1.0, fit_rows / n)
    chosen = voted.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(portion * (1 << 20)))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Some `fit_rows` pairs of numbers, whatever the input.
    joined = texts.join(F.broadcast(chosen), "id").select("id", "good", "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "good": batch.column("good"), "x": pa.array([r.tobytes() for r in rows], pa.binary())})

    kinds = StructType([joined.schema["id"], joined.schema["good"], StructField("x", BinaryType())])
    found = keep(joined.mapInArrow(measured, kinds).groupBy("id", "good").agg(F.max("x").alias("x")), "labelled").select("good", "x").toArrow()
    good = found.column("good").to_numpy().astype(float)
    if not len(good) or good.min() == good.max():
        return np.zeros(WIDTH), share
    return fit(np.stack([np.frombuffer(x, np.float64) for x in found.column("x").to_pylist()]), good), share


def evidence(documents: DataFrame, weights: np.ndarray, share: float, text_col: str, name: str) -> DataFrame:
    """`documents` with the log likelihood ratio of each text: the classifier's log odds less those of the labels."""
    base = float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0
    neutral = not weights.any()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [0.0 if neutral else float(np.clip(features(t) @ weights, -30, 30)) - base for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, name])

    return documents.mapInArrow(score, extended(documents, **{name: "double"}))


def strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength from the spread of the groups' shares around their prior mean, beyond chance, by moments.

    With shares m in groups of n documents and prior mean c the expected square of m - c is
    c(1 - c)(1 / n + (1 - 1 / n) / (s + 1)); the sums over groups, weighted by n, give s.
    """
    row = groups.select(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - mean, 2)).alias("spread"), F.sum(mean * (1 - mean)).alias("chance"),
        F.sum(mean * (1 - mean) * (F.col("n") - 1)).alias("room"),
    ).first()
    if not row["room"] or row["room"] <= 0:
        return 1.0
    between = min(max((row["spread"] - row["chance"]) / row["room"], 1e-4), 0.999)
    return 1 / between - 1


def posteriors(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang",
    label_col: str = "quality", fit_rows: int = FIT_ROWS,
) -> tuple[DataFrame, str]:
    """`documents` with one struct column (its name is returned too): evidence, host and path posteriors, score."""
    voted = keep(votes(labels, id_col, label_col), "votes")
    weights, share = classifier(documents, voted, id_col, text_col, fit_rows)
    ratio, result = fresh(documents, "evidence"), fresh(documents, "judgement")
    scored = evidence(documents, weights, share, text_col, ratio)
    prior = float(np.clip(share, 1e-3, 1 - 1e-3))
    odds = float(np.log(prior / (1 - prior)))
    chance = 1 / (1 + F.exp(-(F.col(ratio) + odds)))
    # Partial sums before each shuffle: an id or a host with a third of all rows is as cheap as any.
    judged_rows = keep(
        scored.select(F.col(id_col).alias("id"), F.col(host).alias("host"), F.col(path).alias("path"), chance.alias("p"))
        .groupBy("id", "host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "chances",
    )
    # What the labels change in the sums: the label of each of an id's rows in place of its probability.
    corrected = judged_rows.join(voted.select("id", F.col("good").alias("label")), "id").select(
        "host", "path", F.lit(0).cast("bigint").alias("n"), (F.col("n") * F.col("label") - F.col("good")).alias("good"),
    )
    sums = keep(
        judged_rows.select("host", "path", "n", "good").unionByName(corrected)
        .groupBy("host", "path").agg(F.sum("n").alias("n"), F.greatest(F.lit(0.0), F.least(F.sum("n"), F.sum("good"))).alias("good")), "sites",
    )
    hosts = sums.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    mean = float(np.clip(total[1] / total[0], 1e-3, 1 - 1e-3)) if total[0] else prior
    of_hosts = strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("of_host"), F.col("n").alias("host_n"), F.col("good").alias("host_good"), ((F.col("good") + of_hosts * mean) / (F.col("n") + of_hosts)).alias("host_share"))
    paths = sums.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host")
    of_paths = strength(paths, F.col("host_share"))
    share_of = (F.col("good") + of_paths * F.col("host_share")) / (F.col("n") + of_paths)
    # Written first, so that Spark knows its size when it chooses between copying it and shuffling the texts.
    sites = keep(paths.select(
        F.col("host").alias("site_host"), F.col("path").alias("site_path"),
        F.struct("host_n", "host_good", "n", "good", "host_share", share_of.alias("path_share")).alias("site"),
    ), "site-shares")
    site, vote = fresh(scored, "site"), fresh(scored, "vote")
    left = scored.join(
        sites.select("site_host", "site_path", F.col("site").alias(site)),
        scored[host].eqNullSafe(F.col("site_host")) & scored[path].eqNullSafe(F.col("site_path")), "left",
    ).join(voted.select(F.col("id").alias("voted_id"), F.col("good").alias(vote)), scored[id_col] == F.col("voted_id"), "left")
    own = F.coalesce(F.col(vote).cast("double"), chance)

    def without(n: str, good: str, strong: float, prior: Column | float) -> Column:
        rest = F.greatest(F.lit(0.0), F.least(F.col(f"{site}.{n}") - 1, F.col(f"{site}.{good}") - own))
        return (rest + strong * prior) / (F.col(f"{site}.{n}") - 1 + strong)

    others = without("n", "good", of_paths, without("host_n", "host_good", of_hosts, mean))
    log_odds = F.col(ratio) + F.log(others / (1 - others))
    judged = F.struct(
        F.col(ratio).alias("evidence"), F.col(f"{site}.host_share").alias("host_share"), F.col(f"{site}.path_share").alias("path_share"),
        (1 / (1 + F.exp(-log_odds))).alias("score"),
    )
    return left.select(*[scored[c] for c in documents.columns], judged.alias(result)), result


def quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **columns: str) -> DataFrame:
    """A row per document: doc_id, evidence, host_share, path_share, score, kept."""
    judged, name = posteriors(documents, labels, **columns)
    return judged.select(
        F.col(columns.get("id_col", "doc_id")).alias("doc_id"), f"{name}.*", (F.col(f"{name}.score") >= threshold).alias("kept"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **columns: str) -> DataFrame:
    """`documents` without the rows whose posterior falls below `threshold`."""
    judged, name = posteriors(documents, labels, **columns)
    return judged.where(F.col(f"{name}.score") >= threshold).drop(name)

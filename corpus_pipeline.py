"""The corpus pipeline: reject poor documents, drop near copies, cut out benchmark passages, redact secrets, pack.

Every stage takes all rows that its predecessor kept and, but for the last,
returns the columns of documents. Rows with nulls and repeated rows pass like
others; the operators' docstrings say what each stage does with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluiceflow.llm import decontaminate, findings, packed, simhash, sites
from sluiceflow.llm.common import keep
from sluiceflow.session import load


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sites.keep_good(docs, load(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fingerprints within the linking distance, and texts whose five-word shingles are similar to 0.8 or more."""
    return simhash.one_of_each(docs, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"), length_col="n_chars")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return findings.redact(docs, length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed.pack_grouped(docs)


STAGES = [
    ("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination),
    ("secret scans", secrets), ("best-fit packing", packing),
]

# A trained classifier, a forest and packing plans are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The pipeline's stages on planted cases, and the registered queries against their SQL."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from sluiceflow.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect
from tests.llm.test_decontaminate import plain

SMALL = "/root/testdata/sf0.001"
SF = "/root/testdata/sf0.01"


def test_stages():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "packing"]
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, name):
    outcome = compare(spark, connect(SMALL), SMALL, QUERIES[name], ORACLES[name])
    assert not outcome.startswith("FAIL"), outcome


def test_every_stage_does_its_work(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    base = docs.where("doc_id = 7").first().text
    words = base.split(" ")
    planted = [
        (10_001, base), (10_002, " ".join([*words[:-2], "changed", *words[-2:]])), (10_003, " ".join([*words[:90:-1], items[3][1], *words[90::-1]])),
        (10_004, items[5][1]), (10_005, "Words before. token = \"00112233445566778899aabbccddeeff00112233\" and after it more words stand."),
        (10_006, None), (10_007, ""), (10_005, "Words before. token = \"00112233445566778899aabbccddeeff00112233\" and after it more words stand."),
    ]
    more = spark.createDataFrame([(i, t, "en", "src3", len(t or "")) for i, t in planted], docs.schema)
    at = docs.unionByName(more).withColumn("row", F.lit("extra")).withColumn("evidence", F.lit(1))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, at, SF)
        path = str(tmp_path / name.replace(" ", "-"))
        result.write.parquet(path)
        columns, at = at.columns, spark.read.parquet(path)
        if name != "best-fit packing":
            assert at.columns == columns
        seen[name] = at.cache()
    ids = {name: {r[0] for r in df.select("doc_id").collect()} for name, df in seen.items()}
    every = {r.doc_id for r in docs.select("doc_id").collect()} | {i for i, _ in planted}
    # Quality: nearly all labelled good ones stay, nearly all bad ones go.
    marks = {r.doc_id: r.quality for r in labels.collect()}
    good, bad = {i for i, q in marks.items() if q == 1}, {i for i, q in marks.items() if q == 0}
    gone = every - ids["quality classifier"]
    assert len(gone & good) <= 0.01 * len(good) and len(gone & bad) >= 0.9 * len(bad)
    # Near copies: the copy and the edited copy of a document go, one of them all stays.
    left = ids["SimHash near-dedup"]
    assert len({7, 10_001, 10_002} & left) == 1 and 10_003 in left
    # Benchmark passages: none is left; documents without any are as they were.
    before = {r.doc_id: r.text for r in seen["SimHash near-dedup"].collect()}
    after = {r.doc_id: r for r in seen["benchmark decontamination"].collect()}
    assert 10_004 not in after and items[3][1] not in after[10_003].text and after[10_003].n_chars == len(after[10_003].text)
    for i, text in before.items():
        hit = plain(text, items, 10)[1] if i % 10 == 0 or i >= 10_000 else None
        if hit == set():
            assert after[i].text == text
    # Secrets: assigned values are replaced, all rows stay.
    clean = {r.doc_id: r.text for r in seen["secret scans"].collect()}
    assert clean.keys() == after.keys() and "00112233" not in clean[10_005] and "<SECRET>" in clean[10_005]
    assert not any(re.search(r"(?i)token = \"[0-9a-f]{40}\"", t or "") for t in clean.values())
    # Packing: every remaining document is whole.
    pieces = seen["best-fit packing"].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in pieces} == clean.keys()


def test_the_whole_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())

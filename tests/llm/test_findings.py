"""Secret scans: held-out labels, false positives, redaction, degenerate rows."""

import numpy as np
from pyspark.sql import functions as F

from sluiceflow.llm import findings

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_forest_learns_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 1] > 0.3) & (x[:, 4] < 0.5)).astype(float)
    forest = findings.grow(x[:2000], y[:2000])
    assert ((forest.predict(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95


def test_held_out_findings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = findings.extract(docs, findings.language(docs, "text"), "doc_id", "text").cache()
    # Other values, not only other rows, are held out.
    fold = F.pmod(F.xxhash64("value_sha"), F.lit(4)) == 0
    forest = findings.train(findings.label_findings(found.where(~fold)))
    rows = found.where(fold).select("named", "x").collect()
    x = np.stack([np.frombuffer(r.x, np.float64) for r in rows])
    bare = x.copy()
    bare[:, findings._SHAPES :] = 0  # the shape alone
    truth = np.array([r.named for r in rows])
    assert truth.sum() > 10 and (~truth).sum() > 30
    for view in (x, bare):
        said = forest.predict(view) >= 0.5
        assert (said & truth).sum() >= 0.95 * truth.sum() and (said & ~truth).sum() <= 0.02 * (~truth).sum() + 1


def test_redaction_and_odd_rows(spark):
    docs = spark.read.parquet(DOCS).withColumn("x", F.lit("clash"))
    odd = [
        (-1, None), (-2, ""), (-3, "a" * 100_000), (-4, 'say token = "0123456789abcdef0123456789abcdef01234567" twice'),
        (-4, 'say token = "0123456789abcdef0123456789abcdef01234567" twice'), (None, "card 4785380592391139 and Thverlangesdeutschesungetuem é"),
    ]
    more = spark.createDataFrame([(i, t, None, None, len(t) if t else None, "clash") for i, t in odd], docs.schema)
    both = docs.unionByName(more).cache()
    clean = findings.redact(both, length_col="n_chars").cache()
    assert clean.columns == both.columns and clean.count() == both.count()
    texts = {r.doc_id: r for r in clean.collect()}
    assert texts[-4].text == 'say token = "<SECRET>" twice' and texts[-4].n_chars == len(texts[-4].text)
    assert texts[-1].text is None and texts[-3].text == "a" * 100_000 and "4785380592391139" in texts[None].text
    before = {r.doc_id: r.text for r in both.collect()}
    changed = {i for i in before if before[i] != texts[i].text}
    assert changed == {i for i, t in before.items() if t and any(findings.ruled(t, a, b) for a, b in findings.candidates(t))}
    rows = findings.scan(both).collect()
    assert sum(r.doc_id == -4 and r.secret for r in rows) == 2 and not any(r.secret for r in rows if r.doc_id is None)
    assert {r.doc_id for r in rows if r.secret} == changed


def test_candidates_of_names_and_prefixes():
    text = "password = hunter22! api_key: 'aB$9.x#y', x=12 token=\"short\" url: //host/a AKIAQWERTYUI secret := a=b:c;d, auth: user:pass99)."
    assert [text[a:b] for a, b in findings.candidates(text)] == ["hunter22!", "aB$9.x#y", "AKIAQWERTYUI", "a=b:c;d", "user:pass99"]
    long = "token=" * 50_000 + "x" * 20 + "1"
    assert findings.candidates(long) == [(6, len(long))]
    assert findings.candidates(None) == findings.candidates("") == [] == findings.candidates("token = ......")


def test_named_values_can_be_false(spark):
    """Labels that contradict the naming rule are learned: placeholders of named values are no secrets."""
    rng = np.random.default_rng(5)
    real = ["".join(rng.choice(list("0123456789abcdefXYZQ"), 24)) for _ in range(300)]
    fake = [f"your_{a}_{b}_here_{n:02d}" for n, (a, b) in enumerate(zip(["secret", "token", "value"] * 100, ["place", "holder", "sample"] * 100))]
    rows = [(i, f"token = '{v}' set", v, int(v in real)) for i, v in enumerate([*real, *fake])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = findings.language(docs, "text")
    found = findings.extract(docs, known, "doc_id", "text")
    truth = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, label int")
    labelled = found.join(truth, "doc_id").where("doc_id % 3 > 0").select("value_sha", "x", "label")
    said = {r.doc_id: r.secret for r in findings.scan(docs, labelled=labelled).where("doc_id % 3 = 0").collect()}
    wrong = [i for i, _, _, y in rows if i % 3 == 0 and said[i] != bool(y)]
    assert len(said) == 200 and len(wrong) <= 4


def test_scan_against_plain_loops(spark):
    """Spans by a search of every text and scores by walking each tree, one finding at a time."""
    docs = spark.read.parquet(DOCS)
    found, forest, known = findings.prepared(docs, "doc_id", "text", None, 500, 300, 40)
    got = {(r.doc_id, r.start, r.length): r.score for r in findings.scan(docs, fit_rows=500, dictionary=300, near=40).collect()}
    want = {}
    for doc, text in docs.select("doc_id", "text").collect():
        for start, end in findings.candidates(text):
            x = findings.describe(text, start, end, known)
            total = 0.0
            for at in forest.roots:
                while forest.left[at] != at:
                    at = forest.left[at] if x[forest.feature[at]] <= forest.cut[at] else forest.right[at]
                total += forest.value[at]
            want[doc, start, end - start] = total / len(forest.roots)
    assert len(want) > 30 and got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_hot_values_are_one_row(spark):
    """A value that fills the table takes one place among the rows that the forest grows from."""
    x = lambda v: np.full(findings.WIDTH, v).tobytes()
    rows = [("hot", bytearray(x(9.0)), 0)] * 5000 + [(f"n{i}", bytearray(x(i / 100)), 0) for i in range(100)] + [(f"p{i}", bytearray(x(2 + i / 100)), 1) for i in range(100)]
    forest = findings.train(spark.createDataFrame(rows, "value_sha string, x binary, label int"), fit_rows=400)
    said = forest.predict(np.stack([np.full(findings.WIDTH, v) for v in (0.5, 2.5)]))
    assert said[0] < 0.2 and said[1] > 0.8


def test_without_rows_or_positives(spark):
    docs = spark.createDataFrame([(1, "card 4785380592391139 only")], "doc_id long, text string")
    assert [r.secret for r in findings.scan(docs).collect()] == [False]
    assert findings.scan(docs.limit(0)).count() == 0 and findings.redact(docs.limit(0)).count() == 0

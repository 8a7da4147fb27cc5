"""Quality: held-out accuracy, shrinkage against its formula, degenerate rows."""

import math

import pytest
from pyspark.sql import functions as F

from sluiceflow.llm import sites

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    seen = labels.where("doc_id % 5 <> 0")
    rows = sites.quality(docs, seen).join(labels.where("doc_id % 5 = 0"), "doc_id").select("score", "kept", "quality").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert len(bad) > 80 and sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_odd_rows(spark):
    good, bad = "plain words in a row, and more of them. ", "### $$$ %%% &&& "
    rows = [(i, (good if i % 3 else bad) * (1 + i % 5), f"h{i % 4}", "en", "x") for i in range(120)]
    rows += [(500, None, None, None, "x"), (501, "", "h0", None, "x"), (None, good, None, "en", "x"), (7, good, "new", "de", "x"), (502, good * 9000, "h1", "en", "x")]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, source string, lang string, evidence string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(100)] + [(100, 0), (100, 1), (101, None), (None, 1)], "doc_id long, quality int")
    got = sites.quality(docs, labels)
    assert got.count() == len(rows) + 2 and got.where("score IS NULL OR isnan(score)").count() == 0
    judged = {r.doc_id: r for r in got.collect()}
    assert all(judged[i].kept == (i % 3 > 0) for i in range(8, 120))
    kept = sites.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 502").count() == 1
    assert sites.quality(docs.limit(0), labels).count() == 0
    assert sites.quality(docs, labels.limit(0)).where("kept").count() == len(rows) + 2  # neutral evidence rejects nothing


def test_sparse_sites_shrink(spark):
    # Labels and texts without evidence: shares come from the hosts alone.
    groups = spark.createDataFrame([("a", 1000.0, 900.0), ("b", 2.0, 0.2), ("c", 500.0, 100.0)], "host string, n double, good double")
    total = 1000.2 / 1502.0
    s = sites.strength(groups, F.lit(total))
    spread = sum(n * (g / n - total) ** 2 for n, g in ((1000, 900), (2, 0.2), (500, 100)))
    chance, room = 3 * total * (1 - total), 1499 * total * (1 - total)
    assert s == pytest.approx(1 / ((spread - chance) / room) - 1)
    shrunk = (0.2 + s * total) / (2 + s)
    assert 0.1 < shrunk < total and abs((900 + s * total) / (1000 + s) - 0.9) < 0.01


def test_posteriors_against_plain_sums(spark):
    """Shares and scores from the evidence and the labels by plain loops; labels count in place of probabilities.

    Each document is scored by what its path and host are without it.
    """
    good, bad = "plain words in a row, and more of them. ", "### $$$ %%% &&& "
    rows = [(i, (good if i % 7 else bad) * (1 + i % 3), f"h{i % 5}" if i % 5 else None, "en" if i % 2 else "de") for i in range(210)]
    rows += [(3, bad, "h3", "en"), (3, bad, "h3", "en"), (None, bad, "h1", "en"), (700, bad, "lone", "xx")]
    votes = {i: int(i % 7 > 0) for i in range(60)} | {i: 0 for i in range(100, 200) if i % 5 == 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([*votes.items(), (61, 0), (61, 1), (None, 0), (62, None)], "doc_id long, quality int")
    judged, name = sites.posteriors(docs, labels)
    got = [r.asDict(recursive=True) for r in judged.collect()]
    share = sum(votes.values()) / len(votes)
    odds = math.log(share / (1 - share))
    chance = lambda r: votes.get(r["doc_id"], 1 / (1 + math.exp(-(r[name]["evidence"] + odds))))

    def sums(key):
        held = {}
        for r in got:
            n, g = held.get(key(r), (0, 0.0))
            held[key(r)] = (n + 1, g + chance(r))
        return held

    def strength(groups):
        spread = sum(n * (g / n - m) ** 2 for n, g, m in groups)
        by_chance, room = sum(m * (1 - m) for _, _, m in groups), sum(m * (1 - m) * (n - 1) for n, _, m in groups)
        return 1 / min(max((spread - by_chance) / room, 1e-4), 0.999) - 1

    hosts, paths = sums(lambda r: r["source"]), sums(lambda r: (r["source"], r["lang"]))
    mean = sum(g for _, g in hosts.values()) / len(got)
    s_host = strength([(n, g, mean) for n, g in hosts.values()])
    of_host = {h: (g + s_host * mean) / (n + s_host) for h, (n, g) in hosts.items()}
    s = strength([(n, g, of_host[h]) for (h, _), (n, g) in paths.items()])
    of_path = {k: (g + s * of_host[k[0]]) / (n + s) for k, (n, g) in paths.items()}
    for r in got:
        host, path = of_host[r["source"]], of_path[r["source"], r["lang"]]
        assert r[name]["host_share"] == pytest.approx(host) and r[name]["path_share"] == pytest.approx(path)
        (n, g), (n_host, g_host) = paths[r["source"], r["lang"]], hosts[r["source"]]
        above = (g_host - chance(r) + s_host * mean) / (n_host - 1 + s_host)
        others = (g - chance(r) + s * above) / (n - 1 + s)
        assert r[name]["score"] == pytest.approx(1 / (1 + math.exp(-(r[name]["evidence"] + math.log(others / (1 - others))))), abs=1e-9)
    # The host whose labels are bad though its texts look plain falls below its like.
    assert of_host["h2"] < min(share for h, share in of_host.items() if h != "h2")


def test_fit_separates():
    import numpy as np

    x = np.stack([sites.features(t) for t in ["aa bb cc", "dd ee ff gg", "### ###", "$$$ ###"] * 5])
    w = sites.fit(x, np.array([1.0, 1, 0, 0] * 5))
    p = 1 / (1 + np.exp(-(x @ w)))
    assert (p[::4] > 0.9).all() and (p[2::4] < 0.1).all() and math.isfinite(w.sum())

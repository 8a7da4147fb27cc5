"""SimHash against brute force: fingerprints bit by bit, every link, components, crowded anchors, degenerate rows."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sluiceflow.llm import simhash

DOCS = "/root/testdata/sf0.01/documents.parquet"


def plain_print(text, size=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    values = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(prints):
    """Smallest index reachable for each of some fingerprints, all pairs compared."""
    values = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    label = np.arange(len(values))
    while True:
        new = np.where(near, label[None, :], len(values)).min(axis=1)
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b", "a b c", "A B c a b C", "é\x0bü  x\x1cy z w", "w " * 3000])
def test_fingerprints(text):
    assert simhash.majority(simhash.hashes(text)) == plain_print(text)


def test_every_close_pair_shares_an_anchor():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    moved = points.copy()
    for _ in range(3):
        moved ^= np.uint64(1) << rng.integers(0, 64, len(points), dtype=np.uint64)
    for a, b in zip(points[:200], points[200:400]):
        both = [set(simhash.anchor_keys(np.array([p]))[1].tolist()) for p in (a, b)]
        assert not both[0] & both[1] or np.bitwise_count(a ^ b) < 40
    index, keys = simhash.anchor_keys(points)
    index2, keys2 = simhash.anchor_keys(moved)
    assert len(keys) <= 128 * len(points)
    mine, theirs = [{} for _ in points], [{} for _ in points]
    for at, ks, out in ((index, keys, mine), (index2, keys2, theirs)):
        for i, k in zip(at.tolist(), ks.tolist()):
            out[i][k] = 1
    assert all(m.keys() & t.keys() for m, t in zip(mine, theirs))


def cluster(n, seed=4):
    """Distinct fingerprints, many of them close to each other and many not."""
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 2**64, dtype=np.uint64)
    near = np.full(n, centre, dtype=np.uint64)
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    return np.unique(np.concatenate([near, rng.integers(0, 2**64, n // 4, dtype=np.uint64)]))


def test_links_with_crowded_anchors(spark):
    values = cluster(600)
    rows = [(i, int(v)) for i, v in enumerate(values.view(np.int64))]
    points = spark.createDataFrame(rows, "id long, fp long")
    want = plain_components(values)
    for block in (4096, 8):
        got = {r.fp: r.component for r in simhash.component_of(points, block=block).collect()}
        assert [got[fp] for _, fp in rows] == want.tolist()


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(DOCS).selectExpr("doc_id", "text", "lang AS fp", "source AS id").limit(400)
    docs = docs.unionByName(spark.createDataFrame(
        [(None, "only this one", "", ""), (-5, None, "", ""), (-6, "", "", ""), (-7, " ", "", ""), (-7, " ", "", "")], docs.schema,
    )).cache()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    prints = [plain_print(r.text) for r in rows]
    want = sorted((str(r.doc_id), f"{p:016x}", str(rows[c].doc_id)) for r, p, c in zip(rows, prints, plain_components(prints)))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_copies(docs).collect())
    assert got == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({c for _, _, c in want})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long")
    got = {r.point: r.root for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == got[1000] == 1000


def test_a_round_of_stars_has_few_joins_and_no_more_links(spark, monkeypatch):
    """The driver holds something for every stage and task, so a round has few of them; it never has more links than the one before."""
    from sluiceflow.llm import graph

    steps, rows, plain = [], [], graph.keep

    def kept(df, label):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        steps.append(plan.count("Aggregate") + plan.count("Join"))
        out = plain(df, label)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "keep", kept)
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(900, k) for k in range(500, 800, 3)] + [(2, 1), (1, 2), (1, 2), (5, 5)]
    got = {r.point: r.root for r in graph.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    want = {p: p for e in edges if e[0] != e[1] for p in e}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert max(steps) <= 7  # it was eleven
    assert rows == sorted(rows, reverse=True)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_copies(docs).count() == 0 and simhash.one_of_each(docs).count() == 0


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_similar_texts_go_and_others_stay(spark):
    docs = spark.read.parquet(DOCS).where("doc_id < 1000")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    prints = {i: plain_print(t) for i, t in texts.items()}
    stay = {r.doc_id for r in simhash.one_of_each(docs, similarity=0.8).collect()}
    similar = {}
    for i in texts:
        for j in texts:
            if i < j and sets[i] & sets[j]:
                s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if s >= 0.6 or (prints[i] ^ prints[j]).bit_count() <= 3:
                    similar[i, j] = s
    assert sum(s >= 0.85 for s in similar.values()) > 20
    assert not [p for p, s in similar.items() if s >= 0.85 and p[0] in stay and p[1] in stay]
    relatives = {i for p in similar for i in p}
    assert all(i in stay for i in texts if i not in relatives)


def test_similarity_in_a_crowded_band(spark):
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    rows = [(i, " ".join(w if k != (7 * i) % 400 else f"new{i}" for k, w in enumerate(base))) for i in range(60)]
    rows += [(100 + i, " ".join(f"u{k}" for k in rng.integers(0, 5000, 100))) for i in range(20)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, wide string").selectExpr("doc_id", "wide AS text", "doc_id AS wide")
    for block in (4096, 8):
        got = sorted(r.doc_id for r in simhash.one_of_each(docs, similarity=0.8, block=block).collect())
        assert got == [0, *range(100, 120), 200]


def test_texts_of_one_fingerprint_keep_their_own_links(spark, monkeypatch):
    """Two different texts with an equal fingerprint: a third one that is similar to the second alone goes too."""
    rng = np.random.default_rng(8)
    first, second = ([f"w{k}" for k in rng.integers(0, 5000, 300)] for _ in range(2))
    third = [w if k % 150 else f"new{k}" for k, w in enumerate(second)]
    texts = [" ".join(words) for words in (first, second, third)]
    same = int(np.uint64(simhash.majority(simhash.hashes(texts[0]))).view(np.int64))

    def forged(df, text_col, fp, *names, **more):
        made = original(df, text_col, fp, *names, **more)
        return made.withColumn(fp, F.when(F.col(text_col) == texts[1], F.lit(same)).otherwise(F.col(fp)))

    original = simhash.with_prints
    monkeypatch.setattr(simhash, "with_prints", forged)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in simhash.one_of_each(docs, similarity=0.8).collect()] == [0]


def test_both_sides_of_the_similarity(spark):
    """Lone pairs: those at exactly 0.8 and above link, those just below stay, short and long, edited here and there or in one place."""
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    rows, want = [], set()
    for size in [9, 13, 40, 94, 300, 900]:
        for _ in range(12):
            for spread in (False, True):
                words = [word() for _ in range(size)]
                places = rng.permutation(size)[: max(1, size // 45)] if spread else []
                other = [word() if k in places else w for k, w in enumerate(words)] if spread else [*words, *[word() for _ in range((size - 4) // 4)]]
                if not spread and rng.random() < 0.5:
                    other.append(word())  # one shingle too many
                a, b = shingle_set(" ".join(words)), shingle_set(" ".join(other))
                close = 5 * len(a & b) >= 4 * len(a | b) or (plain_print(" ".join(words)) ^ plain_print(" ".join(other))).bit_count() <= 3
                want |= {len(rows)} if close else {len(rows), len(rows) + 1}
                rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()}
    assert len(rows) // 2 + 30 < len(want) < len(rows) - 30
    assert got == want

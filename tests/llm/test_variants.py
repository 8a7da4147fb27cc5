"""Spelling variants against all pairs of words: numbered nodes, boundaries between partitions, runs of letters, degenerate rows."""

import random
import re
import zlib
from collections import Counter

from sluiceflow.llm import variants

DOCS = "/root/testdata/sf0.01/documents.parquet"


def plain_counts(rows, deleted=31):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % deleted == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(counts, factor=10):
    # Words with a gap in their place: two with a common one are near if they are near at all.
    cuts = {}
    for w in counts:
        for v in {w[:i] + w[i + 1 :] for i in range(len(w))} | {w}:
            cuts.setdefault(v, []).append(w)
    near = {w: set() for w in counts}
    for group in cuts.values():
        for a in group:
            near[a] |= {b for b in group if is_near(a, b)}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), counts[w], len(near[w]), counts.get(form[w], -1)) for w in counts)


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 5, "w") for i, t in rows], "doc_id long, text string, n long, word string")
    result = found(variants.grouped(df, **options))
    assert result == plain(plain_counts(rows))
    return result


def test_random_words(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))) for _ in range(300)]
    rows = [(k, " ".join(w for w in rng.choices(base, k=60) for _ in range(rng.choice([1, 1, 40])))) for k in range(30)]
    rows += [(100 + k, "chained " * 9 + "chaines " * (k < 100) + "chainos " * (k < 3)) for k in range(200)]
    result = check(spark, rows)
    assert ("chainos", "chaines", "chained") in [r[:3] for r in result]


def test_whole_table(spark):
    docs = spark.read.parquet(DOCS)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(variants.grouped(docs)) == plain(plain_counts(rows))


def test_nodes_are_those_of_one_trie(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(400)} | {"ab" * 40, "ab" * 41})
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(8)
    rows = variants.numbered_nodes(df, "word", "nodes", "rank").collect()
    assert [r.word for r in sorted(rows, key=lambda r: r["rank"])] == words
    assert sorted(r["rank"] for r in rows) == list(range(len(words)))
    ids = {}
    for r in rows:
        for depth, node in enumerate(r.nodes, 1):
            assert ids.setdefault(r.word[:depth], node) == node
        shared = max(variants.common(r.word, w) for w in words if w != r.word)
        assert len(r.nodes) == shared
    assert len(set(ids.values())) == len(ids)


def test_pairs_are_counted_once(spark):
    pairs = [("aabbbcc", "aabbbbcc"), ("banana", "bananas"), ("xbanana", "ybanana"), ("aaaaaaa", "aaaaaaaa"), ("ßgefghi", "×gefghi")]
    check(spark, [(1, " ".join(f"{a} {a} {a} {a} {b} {b} {b} " * 40 for a, b in pairs)), (2, " ".join(f"{b} unrelated" for _, b in pairs))])


def test_odd_rows(spark):
    long = "abcdefghij" * 3000
    check(spark, [(1, None), (2, ""), (3, "123 .,;"), (None, "Wording wording WORDING"), (4, "wording, wordings"), (4, "wording, wordings"),
                  (5, f"{long} {long}x"), (6, f"{long} {long}x"), (7, "ÀÉÎÕÜàé ÀÉÎÕÜàé"), (8, "Żółwiami żółwiami wordin")])
    check(spark, [])

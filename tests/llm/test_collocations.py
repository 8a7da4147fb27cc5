"""Collocations against plain counting: automata, their union and walks, pieces, languages, parts of longer phrases, degenerate rows."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from sluiceflow.llm import collocations, words
from sluiceflow.llm.collocations import Transducer


def plain(rows, least=30, within=80, top=2000):
    f = {}
    for text, lang in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            found = re.findall("[^\x20\x09]+", piece)
            for size in range(1, 5):
                for i in range(len(found) - size + 1):
                    f.setdefault(lang or "und", Counter())[tuple(found[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(c for g, c in counts.items() if len(g) == 1)
        candidates = {g: c for g, c in counts.items() if len(g) > 1 and c >= least}
        around = Counter()
        for g, c in candidates.items():
            for size in range(2, len(g)):
                for i in range(len(g) - size + 1):
                    around[g[i : i + size]] = max(around[g[i : i + size]], c)
        scored = []
        for g, a in candidates.items():
            cuts = [(2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g))]
            score, _, left, right = min(cuts)
            if 100 * around[g] < within * a:
                scored.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def check(spark, rows, **options):
    plain_options = {k: v for k, v in options.items() if k in ("least", "within", "top")}
    df = spark.createDataFrame([(t, v, 1, "p") for t, v in rows], "text string, lang string, n long, phrase string")
    result = sorted(tuple(r) for r in collocations.collocations(df, **options).collect())
    assert result == plain(rows, **plain_options)
    return result


def test_transducers():
    rng = np.random.default_rng(3)
    shards = [rng.integers(1, 6, (500, 4), dtype=np.uint64) for _ in range(3)]
    for shard in shards:
        shard[rng.random(500) < 0.3, 3] = 0
    made = [Transducer.of(list(shard.T)) for shard in shards]
    whole = Transducer.union([Transducer.of_bytes(pa.py_buffer(t.to_bytes())) for t in made])
    counts = Counter(tuple(r) for shard in shards for r in shard.tolist())
    columns, weights = whole.rows()
    assert {tuple(int(c[k]) for c in columns): int(w) for k, w in enumerate(weights)} == counts
    paths = rng.integers(0, 7, (2000, 4), dtype=np.uint64)
    sizes = rng.integers(1, 5, 2000)
    found = Transducer.of_bytes(pa.py_buffer(whole.to_bytes())).find(list(paths.T), sizes)
    want = [sum(c for g, c in counts.items() if g[:s] == tuple(p[:s])) for p, s in zip(paths.tolist(), sizes.tolist())]
    assert found.tolist() == want
    empty = Transducer.of_bytes(pa.py_buffer(Transducer.of([np.zeros(0, np.uint64)] * 2, np.zeros(0, np.int64)).to_bytes()))
    assert len(empty.rows()[1]) == 0


def test_phrases_pieces_and_languages(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "B", "b", "Zz"]
    rows = []
    for k in range(120):
        text = "".join(rng.choice(vocabulary) + rng.choice([" "] * 12 + [". ", "\n", ",", "\t", " ; "]) for _ in range(rng.randrange(80)))
        rows.append((text + rng.choice(["", "new york city hall ", "New York, city hall", "one two one two"]) * rng.randrange(4), rng.choice(["en", "de", None, "und"])))
    assert check(spark, rows, shard=300, range_letters=500)
    check(spark, rows, least=2, top=25, within=50)


def test_odd_rows(spark):
    check(spark, [(None, "en"), ("", None), (" .,\n", "fr"), ("a b " * 20_000, "en"), ("a b c d e" * 50, "en"), ("x y. " * 40, None), ("x y. " * 40, None)])
    check(spark, [])


def test_ranges_of_a_shard_are_sent_on_in_small_batches(monkeypatch):
    class Passed:
        def mapInArrow(self, function, schema):
            passes.append(function)
            return self

        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition

    class Shared:
        value = np.full(1 << 20, 2**64 - 1, dtype=np.uint64)

    passes = []
    monkeypatch.setattr(collocations, "keep", lambda df, *_, **__: df)
    collocations.phrase_counts(Passed(), 4, Shared, Shared, 6, 1, 1 << 30)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 20_000, 1000)) for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * 200})
    sent = list(passes[0](iter([batch])))
    assert sum(b.nbytes for b in sent) > 3 * 2**21
    # A batch ends with the range that takes it over the limit.
    assert max(b.nbytes for b in sent) < 1.5 * 2**21
    slots = [s for b in sent for s in b.column("slot").to_pylist()]
    assert slots == sorted(set(slots))
    made = [Transducer.of_bytes(v.as_buffer()).rows() for b in sent for v in b.column("counts")]
    want = Counter(tuple(map(int, g)) for g in zip(*_quadruples(batch)))
    assert Counter({tuple(int(c[k]) for c in columns): int(w) for columns, weights in made for k, w in enumerate(weights)}) == want


def _quadruples(batch):
    """Names of three words and the one that follows, if any, in texts without pieces."""
    found, named, _ = collocations.named_words(batch)
    at = [i for i in range(len(named) - 2) if found.text[i] == found.text[i + 2]]
    more = [named[i + 3] if i + 3 < len(named) and found.text[i + 3] == found.text[i] else 0 for i in at]
    return [named[i] for i in at], [named[i + 1] for i in at], [named[i + 2] for i in at], more


def test_a_filter_takes_one_python_function(spark, monkeypatch):
    plans = []
    plain_filter = collocations.bit_filter
    monkeypatch.setattr(collocations, "bit_filter", lambda names: plans.append(names._jdf.queryExecution().optimizedPlan().toString()) or plain_filter(names))
    check(spark, [("a b c a b c", "en")] * 40)
    assert len(plans) == 2
    assert max(plan.count("MapInArrow") for plan in plans) == 1


def test_splitting_counts_bytes_in_short_numbers():
    data = pa.array(["one two, three " * 20_000] * 10)
    tracemalloc.start()
    found = words.split(data, collocations._KINDS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found.ids) == 600_000 and len(np.unique(found.piece)) == 200_010
    # Of three million bytes; long numbers per byte took 33 times as much.
    assert peak < 25 * 3_000_000

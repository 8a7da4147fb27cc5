"""Jaccard join against all pairs: random edits, crowded clusters in blocks, both sides of the limit, degenerate rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sluiceflow.llm import overlap_join, words

LETTERS = "abcdefghij"


def plain_set(text, size=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def plain(rows):
    """(id, n, component, links) per row, all pairs compared."""
    sets = [plain_set(t) for _, t in rows]
    near = [[] for _ in rows]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if i != j and x and y and 100 * len(x & y) >= 80 * len(x | y):
                near[i].append(j)
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((key, len(sets[i]), min(ids, default=None), len(near[i])))
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row)


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, point string")
    found = [tuple(r) for r in overlap_join.similar_sets(df, **options).collect()]
    assert sorted(found, key=key) == sorted(plain(rows), key=key)


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"{rng.choice(LETTERS)}{rng.randrange(10**6)}"
    return " ".join(out)


def test_words_as_by_pattern():
    texts = ["A  bB\tc\n\n", None, "", "É\x0bü x\x1cy\x85z", " lead", "a.b,c; d!E?\x0cf", "\n.x"]
    column = pa.chunked_array([texts]).chunk(0)
    found = words.split(column.slice(0), overlap_join._SPACE)
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    wanted = [(k, w.encode()) for k, t in enumerate(lower) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert list(zip(found.text.tolist(), found.distinct.take(pa.array(found.ids)).to_pylist())) == wanted
    assert words.split(column.slice(5, 1), overlap_join._SPACE).distinct.to_pylist() == [b"a.b,c;", b"d!e?", b"f"]
    runs = words.split(column, None)
    wanted = [(k, w.encode()) for k, t in enumerate(lower) for w in re.findall("[A-Za-zÀ-ÿ]+", t)]
    assert list(zip(runs.text.tolist(), runs.distinct.take(pa.array(runs.ids)).to_pylist())) == wanted
    parts = words.split(column, words.byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r"))
    wanted = [
        (k, p, w.encode()) for k, t in enumerate(lower) for p, piece in enumerate(re.split("[.,;:!?\x0a-\x0d]", t))
        for w in re.findall("[^\x20\x09]+", piece)
    ]
    assert [w for *_, w in wanted] == parts.distinct.take(pa.array(parts.ids)).to_pylist()
    same = [a[:2] == b[:2] for a, b in zip(wanted, wanted[1:])]
    assert same == (np.diff(parts.piece) == 0).tolist()


def test_random_edits(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(40):
        base = [f"{rng.choice(LETTERS)}{rng.randrange(3000)}" for _ in range(rng.choice([4, 5, 8, 30, 90]))]
        rows += [(len(rows) + k, edited(rng, base, rng.choice([0, 0, 1, 2, 3]))) for k in range(rng.randrange(1, 6))]
    check(spark, rows)
    check(spark, rows, fragment=64, block=3)


def test_one_crowded_cluster_in_blocks(spark):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, edited(rng, base[: rng.randrange(90, 121)], rng.choice([0, 1, 1, 2, 3]))) for k in range(150)]
    check(spark, rows, block=16)


@pytest.mark.parametrize("extra, linked", [(25, 1), (26, 0)])
def test_both_sides_of_the_limit(spark, extra, linked):
    # 100 shingles against 100 + extra: 100 of 125 is just enough.
    base = [f"w{k}" for k in range(104)]
    rows = [(1, " ".join(base)), (2, " ".join(base + [f"x{k}" for k in range(extra)]))]
    check(spark, rows)
    assert plain(rows)[0][3] == linked


def test_shared_passage_does_not_link(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    check(spark, [(k, passage + " " + " ".join(f"u{k}x{j}" for j in range(30 + k))) for k in range(20)])


def test_odd_rows(spark):
    long = " ".join(f"w{k % 5000}" for k in range(60_000))
    check(spark, [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "one two"), (None, "one"), (None, "alone here"), (7, "a b c d e"),
        (7, "a b c d e"), (8, "A B\nC D E"), (9, "é É"), (10, "é é"), (11, long), (12, long + " end"), (None, None),
    ])
    check(spark, [])


def test_counts_of_a_point_are_sent_on_by_buckets(spark, monkeypatch):
    """A row for every point and task grew with the square of the input, as tasks grow with the points."""
    monkeypatch.setattr(overlap_join, "COUNT_BUCKETS", 8)
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for _ in range(60):
        points = (rng.integers(-300, 300, 90) * 2**40 + 1).tolist()
        counts = rng.integers(1, 9, 90).tolist()
        rows.append((points, counts))
        for p, n in zip(points, counts):
            want[p] = want.get(p, 0) + n
    for held in (2**20, 50):
        monkeypatch.setattr(overlap_join, "HELD_COUNTS", held)
        shared = spark.createDataFrame(rows, "point array<long>, n array<int>").repartition(6)
        found = overlap_join.shared_counts(shared).collect()
        assert len(found) == len(want) and {r.point: r.n for r in found} == want
        if held > 50:
            assert overlap_join.partial_counts(shared).count() <= 6 * 8
    assert overlap_join.shared_counts(shared.where("false")).count() == 0

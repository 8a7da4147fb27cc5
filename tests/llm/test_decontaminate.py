"""Decontamination: the automaton against plain search, reports and cut texts against brute force."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sluiceflow.llm import decontaminate as dc


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(text, items, window):
    """Hit word places and items, by comparing every window with every place."""
    doc, hit, names = words(text), set(), set()
    for name, item in items:
        own = words(item)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for j in range(len(doc) - size + 1):
                if doc[j : j + size] == own[i : i + size]:
                    hit |= set(range(j, j + size))
                    names.add(name)
    return doc, hit, names


small = st.lists(st.sampled_from("abcd"), max_size=25).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(small, st.lists(small, max_size=5), st.integers(1, 4))
def test_matches_are_those_of_plain_search(text, items, window):
    named = [(str(i), t) for i, t in enumerate(items)]
    machine = dc.Automaton([(i, dc.words_of(t)) for i, t in named], window)
    spans, names = machine.match(dc.words_of(text))
    _, hit, want = plain(text, named, window)
    assert {k for a, b in spans for k in range(a, b)} == hit and names == want
    assert spans == sorted(spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


@settings(max_examples=200, deadline=None)
@given(small, st.lists(small.filter(lambda t: len(t) > 4), max_size=4))
def test_cleaned_texts_have_no_hits(text, items):
    named = [(str(i), t) for i, t in enumerate(items)]
    machine = dc.Automaton([(i, dc.words_of(t)) for i, t in named], 4)
    left = dc.cleaned(text, [machine], 1.0)
    assert left is not None and not plain(left, named, 4)[1]
    if not plain(text, named, 4)[1]:
        assert left == text


ITEMS = [
    (1, "One two three, four five six seven eight nine TEN eleven twelve."), (2, "short item here"), (3, None), (4, ""), (5, "..."),
    (None, "nobody owns this very long sentence of more than ten words in all"), (1, "One two three, four five six seven eight nine TEN eleven twelve."),
    (6, "été über ñandú 漢字"), (10, "Short Item Here"),
]
DOCS = [
    (1, "before one two three four five six seven eight nine ten eleven after"), (2, "one two three four five six seven eight nine"),
    (3, None), (4, ""), (5, "a SHORT item-here and short\nitem\there"), (6, "x ÉTÉ été über ñandú 漢字 y"), (6, "x ÉTÉ été über ñandú 漢字 y"),
    (None, "this very long sentence of more than ten words in all, really"), (7, "word " * 50_000 + "short item here"),
]


def tables(spark):
    docs = spark.createDataFrame([(*d, "e") for d in DOCS], "doc_id long, text string, lost string")
    items = spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id long, text string, shard int")
    return docs, items


def test_reports_against_brute_force(spark):
    docs, items = tables(spark)
    named = [(i, t) for i, t in ITEMS if i is not None]
    want = []
    for i, t in DOCS:
        doc, hit, _ = plain(t, ITEMS, 10)
        names = sorted({str(n) for n in plain(t, named, 10)[2]})
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        want.append((i, len(doc), len(hit), len(names), digest, bool(hit)))
    for shard_words in (400_000, 3):  # one automaton or several
        got = [tuple(r) for r in dc.contamination(docs, items, shard_words=shard_words).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert not any(r.contaminated for r in dc.contamination(docs, items.limit(0)).collect())
    assert dc.contamination(docs.limit(0), items).count() == 0


def test_cut_texts(spark):
    docs, items = tables(spark)
    clean = dc.decontaminate(docs, items, max_coverage=0.95)
    assert clean.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert (1, "before  after") in rows and (2, DOCS[1][1]) in rows and (3, None) in rows and (5, "a  and ") in rows
    assert rows.count((6, "x ÉTÉ  y")) == 2 and (7, "word " * 50_000) in rows
    # Spans that cover more than half of a document's words take the whole row.
    kept = {r.doc_id for r in dc.decontaminate(docs, items).collect()}
    assert kept == {2, 3, 4, 7}
    assert dc.decontaminate(docs.limit(0), items).count() == 0

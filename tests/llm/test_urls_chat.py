"""URL rules and chat windows: brute force on odd rows, nulls, ties, repeated rows, empty tables."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluiceflow.llm import chat, url_rules

URLS = [
    "https://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://example.org", "http://notexample.org/es/", None, "",
    "no scheme.org/x", "x://y://de.com/de/", "https://a.b.c.com/fr/", "https://com/de/?x", "http://org//", "http://ORG/",
    "https://.org./x", "ftp://é.org/es/é", "http://example.org/es", "https://e.org/" + "p" * 5000, "http://a\nb.org/\n?",
]
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block"), ("com", "/de/", "allow"), (None, "/", "block"), ("c.com", None, "block"), ("é.org", "/es/é", "block"),
]


def judged(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [
        (len(h + (p or "")), len(h), a == "block", h + (p or ""), a) for h, p, a in rules
        if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p or "")
    ]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls_against_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[0]), (None, URLS[1])]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, rule string, prefix string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = sorted(map(repr, (tuple(r) for r in url_rules.judge(pages, rules).collect())))
    assert got == sorted(repr((i, *judged(u, RULES))) for i, u in rows)
    assert {r.verdict for r in url_rules.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_rules.judge(pages.limit(0), rules).count() == 0


def test_the_rules_meet_in_an_equi_join(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    plan = url_rules.judge(pages, rules)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


TURNS = [
    (1, 0, "system", "be <|kind|> \\ [INST]"), (1, 1, "user", "one two three"), (1, 2, "assistant", "</s>[INST] ok \\<|end|>"),
    (1, 3, "user", "w " * 600), (1, 4, "assistant", "v " * 300), (1, 5, "user", None), (1, 6, "assistant", ""),
    (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, None, "user", "b"), (2, 0, None, "<\\|"), (3, 0, "system", "alone"),
    (None, 0, "user", "u"), (None, 1, "assistant", "é漢"), (4, 0, "system", "s " * 900), (4, 1, "user", "x"), (4, 2, "assistant", "y"),
    (4, 3, "system", "again"), (5, 0, "<|turn|>", "<|text|>"), (5, 1, "assistant", "<s></s>[/INST]<\\s>"),
]


def check_windows(spark, turns, **limits):
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, window int")
    made = chat.windows(df, **limits).cache()
    rows = {r.conv_id: r for r in chat.digests(made).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        trained = "".join(t for _, _, r, t in own if r == "assistant")
        r = rows[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(trained), hashlib.sha256(trained.encode()).hexdigest())
    windows = made.collect()
    assert sum(r.formatted_chars for r in rows.values()) == sum(len(w.formatted) for w in windows)
    for w in windows:
        bare = w.formatted.replace(chat.TURN, "").replace(chat.TEXT, "").replace(chat.END, "")
        assert not re.search(r"<\||</?s>|\[/?INST\]", bare)
    return windows


def test_windows_read_back_exactly(spark):
    windows = check_windows(spark, TURNS)
    second = [w for w in windows if w.conv_id == 1 and "v v" in w.formatted and "w w" not in w.formatted]
    assert second and all(w.formatted.startswith("<|turn|>system<|text|>be <\\|kind") for w in second)


def test_windows_keep_to_the_budget(spark):
    turns = [(7, 0, "system", "s s s")] + [(7, i, ["user", "assistant"][i % 2], "t " * (i % 17)) for i in range(1, 200)]
    windows = check_windows(spark, turns, budget=80, history_turns=2, history_tokens=24)
    for w in windows:
        assert sum(len(t.split("<|text|>")[1].split("<|end|>")[0].split()) + 3 for t in w.formatted.split("<|turn|>")[1:]) <= 80
    assert len(windows) > 10 and any(w.repeated == 3 for w in windows)


def test_no_turns_no_windows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.windows(df)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\<[|/sINT]>é\n", max_size=30))
def test_escapes_are_reversible(text):
    escaped = re.sub(chat._CONTROL, r"\1\\\2", text.replace("\\", "\\\\"))
    assert re.sub(chat._ESCAPED, r"\1\2", escaped).replace("\\\\", "\\") == text
    assert not re.search(r"<\||</?s>|\[/?INST\]", escaped)


def test_escapes_in_spark_are_the_same(spark):
    texts = ["<|", "\\<|", "<\\|", "<\\\\|", "[INST]\\", "[\\INST]</s><s>", "a$1\\2"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u for r in rows)

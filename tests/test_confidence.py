"""Confidence of merged results: competition of targets and decoys, and q-values against a plain loop."""

import random

import pytest

from sluiceflow.operators.confidence import compete, q_values

RESULTS = "k int, score double, decoy boolean"


def plain(rows):
    """q of each counted row: the least estimate over all thresholds that admit it."""
    valid = [(s, d) for _, s, d in rows if s is not None and d is not None]

    def rate(limit):
        decoys = sum(d for s, d in valid if s >= limit)
        targets = sum(not d for s, d in valid if s >= limit)
        return min(1.0, (decoys + 1) / targets) if targets else 1.0

    return {s: min(rate(t) for t, _ in valid if t <= s) for s, _ in valid}


@pytest.mark.parametrize("seed", range(4))
def test_q_values(spark, seed):
    rng = random.Random(seed)
    rows = [(i, float(rng.randrange(12 if seed % 2 else 1000)), rng.random() < 0.3) for i in range(300)]
    rows += [(300, None, True), (301, 5.0, None), (302, None, None)]
    expected = plain(rows)
    got = q_values(spark.createDataFrame(rows, RESULTS), "score", "decoy").collect()
    assert len(got) == len(rows)
    for row in got:
        counted = row.score is not None and row.decoy is not None
        assert row.q_value == (pytest.approx(expected[row.score]) if counted else None)


def test_groups_are_rated_apart(spark):
    one = [(1, 3.0, False), (1, 2.0, False), (1, 1.0, True)]
    two = [(None, 3.0, True), (None, 2.0, False)]
    got = q_values(spark.createDataFrame(one + two, RESULTS), "score", "decoy", "q", ["k"]).collect()
    for key, rows in ((1, one), (None, two)):
        assert {r.score: r.q for r in got if r.k == key} == pytest.approx(plain(rows))


def test_only_decoys_and_nothing(spark):
    assert [r.q_value for r in q_values(spark.createDataFrame([(1, 1.0, True)], RESULTS), "score", "decoy").collect()] == [1.0]
    assert q_values(spark.createDataFrame([], RESULTS), "score", "decoy").collect() == []


def test_competition(spark):
    rows = [(1, 2.0, False), (1, 2.0, True), (2, 3.0, False), (2, 1.0, True), (3, None, True), (3, 0.5, False), (4, None, False)]
    got = compete(spark.createDataFrame(rows, RESULTS), ["k"], "score", "decoy").collect()
    assert sorted((r.k, r.score, r.decoy) for r in got) == [(1, 2.0, True), (2, 3.0, False), (3, 0.5, False)]

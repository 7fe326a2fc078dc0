"""Windowed quantiles against sorting each window."""

import random

import pytest

from opalstream.operators import gate, trailing
from opalstream.operators.trailing import place, trailing_rank

ASKED, SAMPLES = "s string, at long, seq long", "s string, at long, seq long, v long"


def slow(asked, samples, window, q, least):
    out = {}
    for s, t, n in asked:
        near = sorted(v for x, a, b, v in samples if x == s and v is not None and (a, b) < (t, n) and t - a <= window)
        if len(near) >= max(1, least):
            out[s, t, n] = near[place(len(near), q)]
    return out


@pytest.mark.parametrize("q,least,window,bits", [(0.05, 3, 50, 2), (0.5, 1, 20, 1), (1.0, 1, 0, 3), (0.0, 0, 200, 2), (0.9, 20, 10_000, None)])
def test_trailing_rank(spark, q, least, window, bits):
    rng = random.Random(window)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), rng.randrange(300), i) for i in range(700)]
    asked = [r for r in rows if rng.random() < 0.4]
    kept = set(asked)
    samples = [(*r, rng.choice([None, 5, 5, 5, rng.randrange(40), 2**53 + rng.randrange(3)])) for r in rows if r not in kept]
    got = trailing_rank(spark.createDataFrame(asked, ASKED), spark.createDataFrame(samples, SAMPLES).repartition(3), ["s"], "at", "seq", "v", window, q, least, bits=bits).collect()
    assert {tuple(r)[:3]: r.rank_value for r in got} == slow(asked, samples, window, q, least) and got


def test_nothing_to_ask(spark):
    none, some = spark.createDataFrame([], SAMPLES), spark.createDataFrame([("a", 1, 1)], ASKED)
    assert trailing_rank(some, none, ["s"], "at", "seq", "v", 9, 0.5, 0).count() == 0
    assert trailing_rank(some.limit(0), spark.createDataFrame([("a", 1, 1, 5)], SAMPLES), ["s"], "at", "seq", "v", 9, 0.5, 0).count() == 0


def test_a_sample_at_the_same_place_is_not_before(spark):
    asked, samples = spark.createDataFrame([("a", 5, 1), ("a", 5, 2)], ASKED), spark.createDataFrame([("a", 5, 1, 7)], SAMPLES)
    assert [(r.seq, r.rank_value) for r in trailing_rank(asked, samples, ["s"], "at", "seq", "v", 0, 0.5, 1).collect()] == [(2, 7)]


def test_questions_cost_no_timeline(spark, monkeypatch):
    """What is answered one by one are samples' moves; questions, however many, take the last answer before them, across
    parts, and with `every` keep their columns."""
    written = {}

    def noted(df, tag, real=trailing.materialised):
        written[tag] = real(df, tag)
        return written[tag]

    monkeypatch.setattr(trailing, "materialised", noted)
    samples = [(s, 10 * i, 0, i % 7) for s in ("a", "b") for i in range(30)]
    asked = [(s, t, 1) for s in ("a", "b", "c") for t in range(1000)]
    df = spark.createDataFrame(asked, ASKED).selectExpr("*", "at * 2 as more").repartition(5)
    got = trailing_rank(df, spark.createDataFrame(samples, SAMPLES), ["s"], "at", "seq", "v", 100, 0.5, 3, every=True).collect()
    want = slow(asked, samples, 100, 0.5, 3)
    assert written["timeline"].count() == 2 * len(samples)
    assert sorted(map(tuple, got)) == sorted((s, t, n, 2 * t, want.get((s, t, n))) for s, t, n in asked)


def test_sessions_are_shuffled_once(spark):
    rows = spark.createDataFrame([], "s string, arrival long, seq int, kind string, requester long, question long, timestamp long, price long, sender long, tip_gwei long, tx string, confirmed boolean")
    plan = gate.sessions(rows, "s", gate.GateSettings())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1

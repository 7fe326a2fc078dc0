"""Folds over ordered streams against the plain loop over rows, with blocks of a few rows."""

import math
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from opalstream.operators import scans
from opalstream.shared import hadoop_path, scratch, shared_dir

BIG = 2**53 + 1


def streams(seed, n=400):
    """(stream, i, ...) with a null stream and one that holds most rows."""
    rng = random.Random(seed)
    return rng, [(rng.choice(["hot", "hot", "hot", "hot", "a", None]), i) for i in range(n)]


def slow_batches(rows, most_rows, most_bytes):
    out, state = {}, {}
    for s, i, size in rows:
        size = size or 0
        batch, n, used = state.get(s, (0, 0, 0))
        if not batch or n >= most_rows or used + size > most_bytes:
            batch, n, used = batch + 1, 0, 0
        state[s] = (batch, n + 1, used + size)
        out[i] = batch
    return out


@pytest.mark.parametrize("most_rows,most_bytes,bits", [(3, 100, 2), (7, 10**6, 4), (64, 500, 14)])
def test_greedy_batches(spark, most_rows, most_bytes, bits):
    rng, rows = streams(most_rows)
    rows = [(s, i, rng.choice([None, 0, 5, 10, 40, 99, 101, 300])) for s, i in rows]
    df = spark.createDataFrame([(*r, BIG + r[1] if r[1] % 2 else None) for r in rows], "s string, i long, size long, payload long")
    got = scans.greedy_batches(df, ["s"], ["i"], "size", most_rows, most_bytes, bits).collect()
    assert {r.i: r.batch for r in got} == slow_batches(rows, most_rows, most_bytes) and len(got) == len(rows)
    assert all(r.payload == (BIG + r.i if r.i % 2 else None) for r in got)


def test_batches_of_no_rows(spark):
    assert scans.greedy_batches(spark.createDataFrame([], "s string, i long, size long"), ["s"], ["i"], "size").count() == 0


def slow_islands(rows, hold, resolve):
    out, state = [], {}
    for s, t, on in rows:
        since, fired, absent = state.get(s, (None, None, None))
        if on:
            since, absent = t if since is None else since, None
            fired = t if fired is None and t - since >= hold else fired
        elif fired is None:
            since = None
        else:
            absent = t if absent is None else absent
            if t - absent >= resolve:
                out.append((s, since, fired, t))
                since = fired = absent = None
        state[s] = (since, fired, absent)
    return sorted(out + [(s, a, b, None) for s, (a, b, _) in state.items() if b is not None], key=str)


@pytest.mark.parametrize("hold,resolve,bits", [(0, 0, 0), (3, 5, 1), (20, 4, 2), (9, 30, 14)])
def test_islands(spark, hold, resolve, bits):
    rng, rows = streams(hold)
    on, out = True, []
    for s, i in rows:
        on = on if rng.random() < 0.8 else not on
        out.append((s, 3 * i + rng.randrange(3), on if rng.random() < 0.95 else None))
    df = spark.createDataFrame(out, "s string, t long, on boolean")
    got = [tuple(r) for r in scans.islands(df, ["s"], "t", "on", hold, resolve, bits).collect()]
    assert sorted(got, key=str) == slow_islands([r for r in out if r[2] is not None], hold, resolve)


def slow_ring(rows, size):
    out, rings = [], {}
    for s, i, k in rows:
        ring = rings.setdefault(s, OrderedDict())
        if k not in ring:
            out.append(i)
            ring[k] = None
            if len(ring) > size:
                ring.popitem(last=False)
    return out


@pytest.mark.parametrize("size,bits,keys", [(2, 0, 4), (5, 3, 9), (8, 14, 30)])
def test_ring_dedup(spark, size, bits, keys):
    rng, rows = streams(size)
    rows = [(s, i, rng.choice([None, *range(BIG - 1, BIG + keys)])) for s, i in rows]
    df = spark.createDataFrame(rows, "s string, i long, k long").repartition(3)
    assert sorted(r.i for r in scans.ring_dedup(df, ["s"], ["k"], ["i"], size, bits).collect()) == slow_ring(rows, size)


def slow_edge(rows, half_life, alpha=2.0, base_alpha=1.0, vocabulary=2000):
    out = {}
    for s in {r[0] for r in rows}:
        lam, whole, tables, t, bf = 0.5 ** (1 / half_life), [{}, 0], {}, 0, 0.0
        for _, _, a, b in (r for r in rows if r[0] == s and r[2] is not None and r[3] is not None):
            row = tables.setdefault(a, [{}, 0])
            base = (sum(lam ** (whole[1] - x) for x in whole[0].get(b, [])) + base_alpha / vocabulary) / (sum(lam ** (whole[1] - x) for v in whole[0].values() for x in v) + base_alpha)
            n = sum(lam ** (row[1] - x) for v in row[0].values() for x in v)
            bf += math.log10((sum(lam ** (row[1] - x) for x in row[0].get(b, [])) + alpha * base) / (n + alpha) / base)
            t += 1
            for r in (row, whole):
                r[1] = t
                r[0].setdefault(b, []).append(t)
        if t:
            out[s] = (t, bf)
    return out


@pytest.mark.parametrize("half_life,most_rows", [(0.5, 1 << 16), (300, 40)])
def test_decayed_edge(spark, half_life, most_rows):
    rng, rows = streams(3, 500)
    rows = [(s, i, rng.choice(["p", "q", "r", None]), rng.choice([BIG, BIG - 1, 3, None])) for s, i in rows]
    df = spark.createDataFrame(rows, "s string, i long, p string, c long").repartition(3)
    got = {r.s: (r.n, r.log10_bf) for r in scans.decayed_edge(df, ["s"], ["i"], "p", "c", half_life, most_rows=most_rows).collect()}
    want = slow_edge(rows, half_life)
    assert got.keys() == want.keys()
    assert all(got[s][0] == n and math.isclose(got[s][1], bf, rel_tol=1e-9) for s, (n, bf) in want.items())


def test_decayed_edge_reads_rows_twice(spark):
    """Once to sum up, once to weigh, whatever the number of counts; a parent called None is no null, a NaN is itself, -0 is 0."""
    rng, rows = streams(7, 400)
    rows = [(s, i, rng.choice(["None", "null", "q", None]), rng.choice([float("nan"), 0.0, -0.0, 1.5, None])) for s, i in rows]
    out = scans.decayed_edge(spark.createDataFrame(rows, "s string, i long, p string, c double"), ["s"], ["i"], "p", "c", 40, most_rows=30)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and plan.count("Scan parquet") == 2
    want = slow_edge([(s, i, p, c if c is None else str(c + 0.0)) for s, i, p, c in rows], 40)
    got = {r.s: (r.n, r.log10_bf) for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(got[s][0] == n and math.isclose(got[s][1], bf, rel_tol=1e-9) for s, (n, bf) in want.items())


def test_one_hot_stream_is_many_tasks(spark):
    """The rows of one stream go through as many tasks as there are partitions, in each of the steps over rows."""
    df = spark.range(1 << 12).select(F.lit("hot").alias("s"), F.col("id").alias("i"), F.lit(10).alias("size"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as few rows would all be put into one task
    try:
        out = scans.greedy_batches(df, ["s"], ["i"], "size", 8, 10_000, 6)
        per_task = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per_task) > 1 and max(per_task) < 1 << 11


def test_scratch_frees_what_was_written(spark):
    where, fs = hadoop_path(spark, shared_dir(spark))
    held = lambda: len(fs.listStatus(where))
    before = held()
    with scratch(spark) as paths:
        rows = scans.ring_dedup(spark.range(50).select(F.lit(1).alias("s"), (F.col("id") % 7).alias("k"), "id"), ["s"], ["k"], ["id"], 3, 2).collect()
        assert rows and paths and held() > before
    assert held() == before


def test_prequential_bf_sorts_once(spark):
    """Against running counts row by row, a stream longer than an Arrow batch and a null one included; no windows."""
    import math
    import random

    from opalstream.operators import analytics

    rng = random.Random(5)
    rows = [(rng.choice([None, "x", "y"]) if i % 3 else "long", i, rng.choice([None, "p", "q", "r"]), rng.choice([1.0, 2.0, float("nan")])) for i in range(45_000)]
    df = spark.createDataFrame(rows, "s string, i long, p string, c double").repartition(7)
    out = analytics.prequential_bf(df, ["s"], ["i"], "p", "c")
    seen, want = {}, {}
    for s, _, p, c in rows:
        if p is not None:
            t, m, n, b = (seen.get(k, 0) for k in ((s,), (s, 1, str(c)), (s, 2, p), (s, p, str(c))))
            base = (m + 1 / 2000) / (t + 1)
            k, bf = want.get(s, (0, 0.0))
            want[s] = k + 1, bf + math.log10((b + 2 * base) / (n + 2) / base)
            for key in ((s,), (s, 1, str(c)), (s, 2, p), (s, p, str(c))):
                seen[key] = seen.get(key, 0) + 1
    got = {r.s: (r.n, r.log10_bf) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    assert "Window" not in out._jdf.queryExecution().sparkPlan().toString()  # each window would sort, and hold, a task's rows again

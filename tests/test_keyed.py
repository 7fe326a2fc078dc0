"""Typed keyed state against the batch forms, over micro-batches of shuffled rows, with a restart in between."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from opalstream.operators import analytics, console, scans
from opalstream.streaming import keyed

BIG = 2**53 + 1
EPOCH = datetime.datetime(2024, 1, 1)


def when(seconds):
    return EPOCH + datetime.timedelta(seconds=seconds)


def us(seconds):
    return int((when(seconds) - datetime.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


@pytest.fixture()
def run(spark, tmp_path):
    """Runs a stream over files of rows, one a micro-batch, in two runs of the query; gives what came out."""

    def go(batches, schema, query):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"staged/{i}"))
        for part in (range(len(batches) // 2), range(len(batches) // 2, len(batches))):
            for i in part:
                spark.read.parquet(str(tmp_path / f"staged/{i}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            q = query(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            assert q.awaitTermination(240)
        return spark.read.parquet(str(tmp_path / "out")).collect()

    return go


def shuffled(rows, n, flush, seed=1):
    """rows dealt to n batches at random, and a last one far in the future."""
    rng = random.Random(seed)
    parts = [[] for _ in range(n)]
    for r in rows:
        parts[rng.randrange(n)].append(r)
    return [p or [rows[0]][:0] for p in parts if p] + [flush]


def test_ring(run, spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None]), i, rng.choice([None, BIG, BIG - 1, 1, 2, 3])) for i in range(80)]
    schema = "s string, i long, k long"
    got = run([rows[:30], rows[30:31], rows[31:]], schema, lambda x: keyed.dedup_ring(x, ["s"], ["k"], ["i"], 3))
    want = scans.ring_dedup(spark.createDataFrame(rows, schema), ["s"], ["k"], ["i"], 3).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_alerts(run, spark):
    rng = random.Random(4)
    rows = [(k, t, rng.random() < 0.6 if t % 9 else None) for k in ("x", None) for t in range(60)]
    rows.sort(key=lambda r: r[1])
    schema = "k string, t long, on boolean"
    got = run([rows[:20], rows[20:70], rows[70:]], schema, lambda x: keyed.alerts(x, ["k"], "t", "on", 2, 3))
    want = []
    for r in scans.islands(spark.createDataFrame(rows, schema), ["k"], "t", "on", 2, 3).collect():
        want += [(r.k, r.fired_at, "firing")] + ([(r.k, r.resolved_at, "resolved")] if r.resolved_at is not None else [])
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and want


def test_registry(run, spark):
    rng = random.Random(6)
    schema = "node_id string, at timestamp, started_at long, relay boolean, drain boolean"
    rows = [(f"n{rng.randrange(3)}", when(i), *((None, None, rng.random() < 0.6) if rng.random() < 0.3 else (rng.choice([0, BIG, BIG + 1, 7]), rng.random() < 0.1, None))) for i in range(120)]
    got = run(shuffled(rows, 3, [("end", when(10**6), 1, False, None)]), schema, lambda x: keyed.registry(x, "at", "1 hour"))
    want = console.registry(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.node_id, r.at_us, r.restarted, r.desired_drain) for r in got) == sorted((r.node_id, int((r.at - datetime.datetime(1970, 1, 1)).total_seconds()) * 10**6, r.restarted, r.desired_drain) for r in want)
    assert any(r.restarted for r in want) and any(r.desired_drain for r in want)


def test_blocklist(run, spark):
    rng = random.Random(8)
    schema = "match long, conditions array<string>, status string, at timestamp"
    rows = [(BIG + rng.randrange(3), [rng.choice("abcdef") for _ in range(rng.randrange(3))], rng.choice(["failed", "pending", "not_found", "matched"]), when(i * 10)) for i in range(60)]
    ttl = 400
    got = run(shuffled(rows, 3, [(0, [], "failed", when(610))]), schema, lambda x: keyed.blocklist(x, "match", "conditions", "status", "at", ttl * 10**6, "590 seconds"))
    held = {}
    for r in sorted(got, key=lambda r: ["added", "status", "expired"].index(r.change)):
        held.setdefault((r.match, r.condition), set()).add((r.change, r.added))
    flat = spark.createDataFrame(rows, schema).withColumn("at", F.unix_micros("at"))
    first = {(r.match, r.condition): r.added for r in analytics.blocklist(flat, "match", "conditions", "status", "at", F.lit(0).cast("long"), 1 << 60).collect()}
    mark = us(610) - 590 * 10**6
    for k, added in first.items():
        if added <= mark:
            assert ("added", added) in held[k]
    assert all((("expired", added) in held.get(k, ())) == (added + ttl * 10**6 <= mark) for k, added in first.items() if added <= mark)


def test_blocklist_expires_by_timer(run, spark):
    schema = "match long, conditions array<string>, status string, at timestamp"
    rows = [(1, ["a", "b"], "pending", when(0)), (1, ["b", None], "matched", when(50)), (1, ["c"], "failed", when(90)), (1, None, None, when(95))]
    got = run([[rows[1], rows[3]], [rows[0], rows[2]], [(2, [], None, when(1000))]], schema, lambda x: keyed.blocklist(x, "match", "conditions", "status", "at", 500 * 10**6, "100 seconds"))
    at = [us(0), us(90)]
    assert sorted((r.condition, r.added, r.best_status, r.change) for r in got) == sorted([
        ("a", at[0], "pending", "added"), ("b", at[0], "pending", "added"), ("a", at[0], "matched", "status"), ("b", at[0], "matched", "status"),
        ("c", at[1], "matched", "added"), ("a", at[0], "matched", "expired"), ("b", at[0], "matched", "expired"), ("c", at[1], "matched", "expired"),
    ])


def test_settlements(run, spark):
    rng = random.Random(9)
    schema = "request string, at timestamp, kind string"
    rows = []
    for q in range(25):
        t = rng.randrange(500)
        rows.append((f"q{q}", when(t), "signal"))
        if rng.random() < 0.6:
            rows.append((f"q{q}", when(t + rng.randrange(1200)), "truth"))
        for _ in range(rng.choice([0, 0, 1, 2])):
            a = rng.randrange(300)
            rows.append((f"q{q}", when(t + a), "asked"))
            if rng.random() < 0.7:
                rows.append((f"q{q}", when(t + a + rng.randrange(2500)), "answered"))
    got = run(shuffled(rows, 3, [("end", when(10**6), "signal")]), schema, lambda x: keyed.settlements(x, "request", "at", "2 hours"))
    flat = spark.createDataFrame(rows, schema).withColumn("at", F.unix_micros("at"))
    want = analytics.settle_times(flat, "request", "at", "kind", F.lit(us(10**6))).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want) and len(want) == 25 and len({r.settled_at % 10**8 for r in want}) > 5


def test_seats(run, spark):
    rng = random.Random(10)
    schema = "network string, epoch long, peer string, share double, online boolean, silent boolean, observed boolean, seen long, home boolean, at timestamp"
    rows = [(net, 6 * e, f"p{p}", round(rng.random() * 0.03, 4), True, rng.random() < 0.05, rng.random() < 0.8, 50, p == 1, when(6 * e * 3600)) for net in ("m", "n") for e in range(12) for p in range(9) if rng.random() < 0.85]
    rules = analytics.SeatRules(core_max=3, trial_seats=2)
    got = run(shuffled(rows, 3, [("end", 0, "x", 0.0, True, False, False, 0, False, when(10**7))]), schema, lambda x: keyed.seats(x, ["network"], "peer", "at", "4 days", rules))
    want = analytics.seats(spark.createDataFrame(rows, schema), ["network"], "peer", "epoch", rules).collect()
    pick = lambda rs: sorted((r.network, r.epoch, r.peer, r.state, r.reason, r.cooldowns) for r in rs if r.network != "end")
    assert pick(got) == pick(want) and len({r.state for r in want}) > 3

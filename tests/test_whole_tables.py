"""Queries without SQL over whole tables against versions of their own: seats in plain Python, Keccak-256 bit by bit."""

import functools
import operator
import os
import time
from collections import Counter

import pytest

from opalstream.operators import analytics
from opalstream.plans import catalogue

SF = os.environ.get("OPAL_TEST_SF", "/root/testdata/sf0.01")


def keccak(data):
    """The sponge as its definition has it: lanes of 64 bits, 24 rounds, padding 0x01 ... 0x80."""
    mask = (1 << 64) - 1
    turn = lambda x, n: ((x << n) | (x >> (64 - n))) & mask if n % 64 else x

    def lfsr(t):
        r = 1
        for _ in range(t % 255):
            r = (r << 1) ^ (0x171 if r & 0x80 else 0)
        return r & 1

    offsets, x, y = {(0, 0): 0}, 1, 0
    for t in range(24):
        offsets[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5

    def permute(a):
        for rnd in range(24):
            c = [a[x, 0] ^ a[x, 1] ^ a[x, 2] ^ a[x, 3] ^ a[x, 4] for x in range(5)]
            a = {(x, y): v ^ c[(x - 1) % 5] ^ turn(c[(x + 1) % 5], 1) for (x, y), v in a.items()}
            b = {(y, (2 * x + 3 * y) % 5): turn(v, offsets[x, y]) for (x, y), v in a.items()}
            a = {(x, y): b[x, y] ^ (~b[(x + 1) % 5, y] & mask & b[(x + 2) % 5, y]) for x in range(5) for y in range(5)}
            a[0, 0] ^= sum(lfsr(7 * rnd + j) << ((1 << j) - 1) for j in range(7))
        return a

    block = bytearray(data + b"\x01" + bytes(-(len(data) + 1) % 136))
    block[-1] |= 0x80
    a = {(x, y): 0 for x in range(5) for y in range(5)}
    for i in range(0, len(block), 136):
        for j in range(17):
            a[j % 5, j // 5] ^= int.from_bytes(block[i + 8 * j : i + 8 * j + 8], "little")
        a = permute(a)
    return b"".join(a[j % 5, j // 5].to_bytes(8, "little") for j in range(4))


def test_decoded_logs(spark):
    assert keccak(b"abc").hex().startswith("4e03657aea45a94f")
    got = Counter(tuple(r[c] for c in ("market_id", "kind", "error", "question_id", "condition_id")) for r in catalogue.QUERIES["decoded_logs"](spark, SF).collect())
    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect():
        question = keccak(f"title, market_id: {r.doc_id + 1}".encode())
        condition = keccak(r.doc_id.to_bytes(20, "big") + question + (2).to_bytes(32, "big"))
        want[r.doc_id + 1, "propose", None, question.hex().upper(), condition.hex().upper()] += 1
    assert got == want and want


def slow_seats(rows, r):
    """One network's seats, evaluation after evaluation: every rule a pass over all peers by name."""
    seats, out = {}, []
    for now in sorted({x.epoch for x in rows}):
        here = {x.user_id: x for x in rows if x.epoch == now}
        for k in here:
            seats.setdefault(k, {"state": "candidate", "why": "", "cool": 0, "below": 0, "core": None, "until": 0, "lost": 0, "seen": False, "extra": False})

        exploring = any(x.exploring for x in here.values())

        def move(k, state, why):
            seats[k].update(state=state, why=why, below=0, extra=False)

        def rest(k, why, quiet):
            seats[k]["cool"] += 1
            hours = r.cooldown_hours[min(seats[k]["cool"], 3) - 1]
            seats[k]["until"] = now + (max(hours, r.silent_hours) if quiet else hours)
            move(k, "cooldown", why)

        on = lambda state: sorted(k for k in here if seats[k]["state"] == state)
        for k in sorted(seats):
            s = seats[k]
            if k not in here and s["state"] == "core":
                move(k, "lost", "offline")
                s["lost"] = now
            elif k not in here and s["state"] == "trial":
                move(k, "candidate", "offline")
            elif k in here and s["state"] == "lost":
                move(k, "core", "back")
                s["core"] = now if s["core"] is None else s["core"]
        for k in sorted(here):
            full = len(on("trial"))
            if seats[k]["state"] == "candidate" and (full < r.trial_seats or (exploring and full < r.trial_seats + r.explore_seats)):
                move(k, "trial", "admitted")
                seats[k].update(seen=False, extra=full >= r.trial_seats)
        for k in sorted(here):
            if here[k].silent and seats[k]["state"] in ("candidate", "trial", "lost"):
                rest(k, "silent", True)
        for k in sorted(seats):
            if seats[k]["state"] == "cooldown" and seats[k]["until"] <= now:
                move(k, "candidate", "cooled")
        home = sum(here[k].home for k in on("core"))
        for k in on("core"):
            if here[k].seen >= r.least_seen:
                s = seats[k]
                s["below"] = 0 if here[k].share >= r.demote else s["below"] + 1
                if s["below"] >= r.demote_rounds and (not here[k].home or home > r.home_floor):
                    home -= here[k].home
                    move(k, "trial", "demoted")
                    s["seen"] = True
                if s["core"] is not None and now > s["core"] + r.stable_hours:
                    s["cool"] = 0
        for k in sorted(seats):
            if seats[k]["state"] == "lost" and now > seats[k]["lost"] + r.lost_hours:
                move(k, "candidate", "lost")
        for k in on("trial"):
            seats[k]["seen"] |= here[k].observed
            if seats[k]["seen"] and here[k].share >= r.promote:
                move(k, "core", "promoted")
                seats[k]["core"] = now
        if not exploring:
            for k in on("trial"):
                if seats[k]["extra"] and here[k].share < r.promote:
                    move(k, "candidate", "explored")
                seats[k]["extra"] = False
        ranked = sorted(on("core"), key=lambda k: (here[k].share, k))
        for k in ranked[: max(0, len(ranked) - r.core_max)]:
            move(k, "trial", "over the cap")
            seats[k]["seen"] = True
        tried = sorted((here[k].share, k) for k in on("trial") if seats[k]["seen"] and not seats[k]["extra"])
        if tried:
            rest(tried[0][1], "lowest", False)
        out += [(k, now, s["state"], s["why"], s["cool"]) for k, s in seats.items()]
    return out


@pytest.mark.parametrize("query", ["seat_states", "seat_counts"])
def test_seats(spark, query):
    rows = catalogue.seat_rows(catalogue.Data(spark, SF)).collect()
    want = []
    for net in {r.network for r in rows}:
        want += [(net, *x) for x in slow_seats([r for r in rows if r.network == net], catalogue.SEAT_RULES)]
    got = catalogue.QUERIES[query](spark, SF)
    if query == "seat_states":
        assert any(w[4] == "explored" for w in want)
        assert sorted((r.network, r.user_id, r.epoch, r.state, r.reason, r.cooldowns) for r in got.collect()) == sorted(want) and len({w[3] for w in want}) > 2
    else:
        assert {(r.epoch, r.state): r.n for r in got.collect()} == Counter((e, s) for _, _, e, s, _, _ in want)


def test_streak_below_at_the_bar(spark, tmp_path):
    """A mean of exactly 30, whose values' sum in this order is a little less, isn't below the bar."""
    at = [2.5, 32.94, 56.41, 23.49, 13.78, 50.88]
    assert functools.reduce(operator.add, at) / 6 < 30
    rows = [(f"2024-01-0{day} 00:00:00", 1, float(v)) for day, vs in ((1, at), (2, [1]), (3, [2])) for v in vs]
    df = spark.createDataFrame(rows, "ts string, user_id long, value double").selectExpr("1L as event_id", "cast(ts as timestamp) as ts", "user_id", "'x' as event_type", "value", "'' as props")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES["streak_below"](spark, str(tmp_path)).collect()
    assert [(r.day, r.streak) for r in got] == [(19725, 2)]


def test_seats_of_many_peers(spark):
    """An evaluation looks at who is online, not at all peers for each of them: this took minutes."""
    n = 20_000
    rows = spark.range(4 * n).selectExpr("'n' as network", f"id % {n} as user_id", f"(id div {n}) * 6 as epoch", "(id % 7) / 100.0D as share", "true as online", "id % 11 = 3 as silent", "true as observed", "50 as seen", "id % 5 = 0 as home")
    rows = rows.withColumn("exploring", rows.epoch == 6)
    began = time.time()
    got = Counter((r.epoch, r.state) for r in analytics.seats(rows, ["network"], "user_id", "epoch", catalogue.SEAT_RULES).collect())
    assert sum(got.values()) == 4 * n and {s for e, s in got if e == 18} >= {"core", "cooldown", "candidate"}
    assert time.time() - began < 60

"""Raced endpoints, pages and followed files: gaps, restarts, rotation, rows stamped anew."""

import json
import os

import pytest

from opalstream.operators import events
from opalstream.sources import paging, raced, tail


@pytest.fixture()
def follow(spark, tmp_path):
    """Runs a stream until it has nothing new; each call starts the query again from its checkpoint."""

    def go(kind, **options):
        reader = spark.readStream.format(kind)
        for k, v in options.items():
            reader = reader.option(k.removesuffix("_"), v)
        q = reader.load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out"))

    return go


def test_backoff():
    now = [0.0]
    b = raced.Backoff([1, 2, 5], lambda: now[0])
    waits = []
    for _ in range(5):
        waits.append(b.failure())
        assert not b.ready()
        now[0] += waits[-1]
        assert b.ready()
    assert waits == [1, 2, 5, 5, 5]
    b.success()
    assert b.ready() and b.failure() == 1


def test_raced_endpoints(spark, tmp_path, follow):
    spark.dataSource.register(raced.RacedLogs)
    state = tmp_path / "state"
    state.mkdir()

    def run(head, down=()):
        (state / "head").write_text(str(head))
        for name in ("left", "right"):
            (state / f"{name}.down").unlink(missing_ok=True)
            if name in down:
                (state / f"{name}.down").write_text("")
        return follow("raced_logs", client="fake_client:left,fake_client:right", names="left,right", from_=0, batch=4, schedule="0,0", state=str(state), progress=f"file://{tmp_path}/progress")

    block = lambda r: int(r.blockNumber, 16)
    rows = run(9).collect()
    assert sorted({block(r) for r in rows if r.source == "left"}) == [0, 1, 2, 3, 4, 7, 8, 9] and sorted({block(r) for r in rows if r.source == "right"}) == list(range(10))
    rows = run(14, down=["left"]).collect()  # the other goes on alone
    assert max(block(r) for r in rows if r.source == "left") == 9 and max(block(r) for r in rows if r.source == "right") == 14
    out = run(16)
    asked = [json.loads(x) for x in (state / "asked-left").read_text().splitlines()]
    assert sorted(a for a, _ in asked[:3]) == [0, 4, 8] and min(a for a, _ in asked[3:]) >= 9  # on from its own place in the vector, not from the start
    key, race = ["blockNumber", "logIndex"], events.source_race(out, ["blockNumber", "logIndex"], ["received_us", "source"], "source")
    once = events.first_wins(out, key, ["received_us", "source"]).collect()
    assert sorted(block(r) for r in once) == sorted(b for b in range(17) for _ in (0, 1))  # what one lacks the other has
    got = {r.source: (r.received, r.won) for r in race.collect()}
    assert sum(w for _, w in got.values()) == 34 and got["left"][1] > 0 and got["right"][1] > 0


def test_an_endpoint_that_is_back_reads_its_last_block_again(tmp_path):
    (tmp_path / "head").write_text("7")
    reader = raced.RacedReader({"client": "fake_client:left,fake_client:right", "state": str(tmp_path), "schedule": "0"})
    start = reader.latestOffset()
    (tmp_path / "left.down").write_text("")
    (tmp_path / "head").write_text("9")
    middle = reader.latestOffset()
    assert middle["0"]["next"] == 8 and middle["1"]["next"] == 10
    (tmp_path / "left.down").unlink()
    end = reader.latestOffset()
    assert [(p.endpoint, p.first, p.last) for p in reader.partitions(start, middle)] == [(1, 8, 9)]
    assert [(p.endpoint, p.first, p.last) for p in reader.partitions(middle, end)] == [(0, 7, 9)]


def test_keys_in_turn():
    now = [0.0]
    keys = paging.Keys(["a", "b", "c"], 10, lambda: now[0])
    assert [keys.take() for _ in range(4)] == ["a", "b", "c", "a"]
    keys.failed("b")
    assert [keys.take() for _ in range(3)] == ["c", "a", "c"]
    now[0] = 11
    assert "b" in [keys.take() for _ in range(3)]


def test_pages(spark, tmp_path, follow):
    spark.dataSource.register(paging.KeysetPages)
    state = tmp_path / "state"
    state.mkdir()
    rows = {x: [{"id": f"{x}{i:03d}", "updated_at": f"2024-01-01T00:00:{i // 3:02d}"} for i in range(60)] for x in ("open", "closed")}

    def run():
        return {(r.id, r.updated_at) for r in follow("keyset_pages", client="fake_client:listing", listings="open,closed", page=7, keys="bad,good", cooldown=0, state=str(state)).collect()}

    def put():
        for x, some in rows.items():
            (state / f"{x}.json").write_text(json.dumps(some))

    put()
    (state / "stamp").write_text(json.dumps(["open005", "2024-01-01T00:09:00"]))  # in mid-walk
    first = run()
    assert {i for i, _ in first} >= {r["id"] for x in rows.values() for r in x} - {"open005"}
    second = run()
    assert ("open005", "2024-01-01T00:09:00") in second and {i for i, _ in second} == {r["id"] for x in rows.values() for r in x}
    rows = {x: json.loads((state / f"{x}.json").read_text()) for x in rows}
    rows["closed"].append({"id": "new", "updated_at": "2024-01-01T00:00:19"})  # of the very time of the cursor
    rows["closed"].append({"id": "newer", "updated_at": "2024-01-01T00:10:00"})
    put()
    third = run()
    assert {"new", "newer"} <= {i for i, _ in third}
    batch = spark.read.format("keyset_pages").option("client", "fake_client:listing").option("listings", "closed").option("state", str(state)).option("page", 9).option("boundary", "2024-01-01T00:00:15").load()
    got = [r.updated_at for r in batch.collect()]
    assert min(got) < "2024-01-01T00:00:15" and sum(x < "2024-01-01T00:00:15" for x in got) < 9  # the rest of the last page counts


def test_listings_asked_now_and_then(tmp_path):
    put = lambda x, when: (tmp_path / f"{x}.json").write_text(json.dumps([{"id": "a", "updated_at": when}]))
    put("running", "1"), put("past", "1")
    reader = paging.PageStream({"client": "fake_client:listing", "listings": "running,past", "every": "past:3", "state": str(tmp_path)})
    seen = []
    for i in range(1, 5):
        put("running", str(i)), put("past", str(i))
        seen.append(reader.latestOffset())
    assert [x["running"] for x in seen] == ["1", "2", "3", "4"] and [x["past"] for x in seen] == ["1", "1", "1", "4"]
    assert [p.name for p in reader.partitions(seen[0], seen[1])] == ["running"]


def test_tail(spark, tmp_path, follow):
    spark.dataSource.register(tail.TailLines)
    log = tmp_path / "logs/feed.csv"
    log.parent.mkdir()
    lines = lambda: sorted(r.line for r in follow("tail_lines", path=str(log), chunk=16).collect())

    def add(text):
        with open(log, "a") as f:
            f.write(text)

    add("one\ntwo\nthr")
    assert lines() == ["one", "two"]
    add("ee\nfour\nfi")
    assert lines() == ["four", "one", "three", "two"]
    os.rename(log, log.parent / "feed.csv.1")
    with open(log.parent / "feed.csv.1", "a") as f:
        f.write("ve\nsix, the last without an end")
    add("seven\r\n" + "x" * 100 + "\nhal")
    want = sorted(["one", "two", "three", "four", "five", "six, the last without an end", "seven", "x" * 100])
    assert lines() == want
    assert lines() == want  # nothing new
    with open(log, "w") as f:
        f.write("cut\n")
    assert lines() == sorted([*want, "cut"])

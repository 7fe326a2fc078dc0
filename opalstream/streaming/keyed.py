"""Operators with typed state for each key: values and maps of Spark's state store, with time to live and timers.

A `Logic` says what state a key has and what rows do to it.  `arriving` runs it over rows as micro-batches bring them;
`in_order` holds rows back until the watermark has passed them and runs it over them in order of event time, so
its results are those of the batch form, however rows were shuffled among micro-batches within the delay.  Both go
through rows, not pandas, so nulls are values and longs stay longs.  State is in the RocksDB store, which `use_store`
sets for the session.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from opalstream.operators.analytics import LOOKUP_RANK, SEAT_COLUMNS, SETTLE_AFTER_TRUTH, SETTLE_LATEST, SETTLE_WITHOUT, SeatRules, _evaluate, _Seat
from opalstream.operators.scans import Alert, key_text

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark: SparkSession) -> None:
    """Typed state needs the RocksDB store, so the session gets it unless a form of it is set."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, PROVIDER)


class Logic:
    """What a key's rows do.  An instance serves many keys: what it remembers is in its state alone."""

    #: Columns (beside the key's) that the logic reads, and those it gives after the key's.
    reads: list[str] = []
    gives = ""

    def open(self, handle, ttl_ms: int | None) -> None:
        raise NotImplementedError

    def rows(self, key: tuple, rows: list[dict]) -> Iterator[tuple]:
        """rows of one key in order, each with `_us`, its time."""
        raise NotImplementedError

    def until(self, key: tuple, watermark_us: int) -> Iterator[tuple]:
        """What time alone brings about."""
        return iter(())

    def wakes(self) -> int | None:
        """The next time (microseconds) at which `until` has something to do."""
        return None


class _Arriving(StatefulProcessor):
    def __init__(self, logic: Logic, out: list[str], order: list[str], ttl_ms: int | None):
        self.logic, self.out, self.order, self.ttl_ms = logic, out, order, ttl_ms

    def init(self, handle) -> None:
        self.logic.open(handle, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mine = sorted((r.asDict() for r in rows), key=lambda r: tuple((r[c] is not None, r[c]) if r[c] is not None else (False,) for c in self.order))
        for values in self.logic.rows(tuple(key), mine):
            yield Row(*self.out)(*values)

    def close(self) -> None:
        pass


class _InOrder(StatefulProcessor):
    def __init__(self, logic: Logic, out: list[str], schema: str, columns: list[str]):
        self.logic, self.out, self.schema, self.columns = logic, out, schema, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, n long", self.schema)
        self.came = handle.getValueState("came", "n long, timer long")
        self.logic.open(handle, None)

    def _state(self) -> tuple[int, int | None]:
        got = self.came.get() if self.came.exists() else None
        return (got[0], got[1]) if got else (0, None)

    def _set(self, n: int, timer: int | None, wanted: int | None) -> None:
        """One timer a key, at the earliest time that matters."""
        if wanted is not None and (timer is None or wanted < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
            timer = wanted
        self.came.update((n, timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (n, timer), first = self._state(), None
        for r in rows:
            us = r["_us"]
            self.waiting.updateValue((us, n), tuple(r[c] for c in self.columns))
            n += 1
            first = us if first is None else min(first, us)
        self._set(n, timer, None if first is None else -(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        n, timer = self._state()
        held = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()) if self.waiting.exists() else []
        due = [(k, v) for k, v in held if -(-k[0] // 1000) <= mark]
        for k, _ in due:
            self.waiting.removeKey(k)
        yield from (Row(*self.out)(*x) for x in self.logic.rows(tuple(key), [dict(zip(self.columns, v)) | {"_us": k[0]} for k, v in due]))
        yield from (Row(*self.out)(*x) for x in self.logic.until(tuple(key), mark * 1000))
        if timer is not None and timer > mark:
            self.handle.deleteTimer(timer)
        later, wakes = [k[0] for k, _ in held if -(-k[0] // 1000) > mark], self.logic.wakes()
        wanted = min([-(-x // 1000) for x in [*later, *([wakes] if wakes is not None else [])]], default=None)
        self._set(n, None, None if wanted is None else max(wanted, mark + 1))

    def close(self) -> None:
        pass


def _result(stream: DataFrame, key: list[str], logic: Logic) -> StructType:
    types = dict(stream.dtypes)
    return StructType.fromDDL(", ".join([*(f"`{k}` {types[k]}" for k in key), logic.gives]))


def arriving(stream: DataFrame, key: list[str], order: list[str], logic: Logic, remember_hours: float | None = None) -> DataFrame:
    """Each micro-batch's rows of a key, in order, through the logic; with remember_hours, state not written for so long is
    forgotten."""
    use_store(stream.sparkSession)
    ttl = None if remember_hours is None else int(remember_hours * 3_600_000)
    rows = stream.select(*dict.fromkeys([*key, *order, *logic.reads]))
    schema = _result(stream, key, logic)
    return rows.groupBy(*key).transformWithState(_Arriving(logic, schema.names, order, ttl), schema, "append", "none" if ttl is None else "processingTime")


def in_order(stream: DataFrame, key: list[str], at: str, delay: str, logic: Logic, ties: list[str] = ()) -> DataFrame:
    """Rows of a key in order of the timestamp `at` through the logic, once the watermark has passed them.  Rows later than
    the delay are dropped; those of equal time are in order of `ties`, as texts."""
    use_store(stream.sparkSession)
    marked = stream.filter(F.col(at).isNotNull()).withWatermark(at, delay).withColumn("_us", F.unix_micros(at)).withColumn("_tie", key_text(list(ties)))
    columns = [c for c in dict.fromkeys(logic.reads) if c not in key]
    rows = marked.select(*dict.fromkeys([*key, at, "_us", "_tie", *columns]))
    types = dict(stream.dtypes)
    schema = ", ".join(["_tie string", *(f"`{c}` {types[c]}" for c in columns)])
    result = _result(stream, key, logic)
    return rows.groupBy(*key).transformWithState(_InOrder(logic, result.names, schema, ["_tie", *columns]), result, "append", "eventTime")


def _sorted(rows: list[dict]) -> list[dict]:
    return sorted(rows, key=lambda r: (r.get("_us", 0), r.get("_tie", "")))


# --- the last so many keys


class RingLogic(Logic):
    """First arrivals among the last `size` accepted keys: a map from key to number, one from number to key, and the ends."""

    def __init__(self, size: int, columns: list[str]):
        self.size, self.reads, self.columns = size, [*columns, "_key"], columns

    def open(self, handle, ttl_ms) -> None:
        self.seen = handle.getMapState("seen", "k string", "n long", ttl_ms)
        self.line = handle.getMapState("line", "n long", "k string", ttl_ms)
        self.ends = handle.getValueState("ends", "first long, next long", None)

    def rows(self, key, rows):
        first, following = self.ends.get() if self.ends.exists() else (0, 0)
        for r in rows:
            k = (r["_key"],)
            if self.seen.containsKey(k):
                continue
            self.seen.updateValue(k, (following,))
            self.line.updateValue((following,), k)
            following += 1
            while following - first > self.size:
                if self.line.containsKey((first,)):  # not forgotten yet
                    old = self.line.getValue((first,))
                    self.line.removeKey((first,))
                    self.seen.removeKey((old[0],))
                first += 1
            yield tuple(r[c] for c in self.columns)
        self.ends.update((first, following))


def dedup_ring(stream: DataFrame, by: list[str], key: list[str], arrival: list[str], size: int = 10_000, remember_hours: float | None = None) -> DataFrame:
    """First arrival of each key among the last `size` accepted, exactly, one ring for each `by`; null keys are keys."""
    rest = [c for c in stream.columns if c not in by]
    logic = RingLogic(size, rest)
    logic.gives = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes if n in rest)
    out = arriving(stream.withColumn("_key", key_text(key)), by, arrival, _WithKey(logic), remember_hours)
    return out.select(*stream.columns)


class _WithKey(Logic):
    """Puts the key before what a logic gives."""

    def __init__(self, logic: Logic):
        self.logic, self.reads, self.gives = logic, logic.reads, logic.gives

    def open(self, handle, ttl_ms) -> None:
        self.logic.open(handle, ttl_ms)

    def rows(self, key, rows):
        return ((*key, *out) for out in self.logic.rows(key, _sorted(rows) if rows and "_tie" in rows[0] else rows))

    def until(self, key, watermark_us):
        return ((*key, *out) for out in self.logic.until(key, watermark_us))

    def wakes(self):
        return self.logic.wakes()


# --- alerts


class AlertLogic(Logic):
    """What operators.scans.islands does, as changes: `firing` and `resolved`."""

    gives = "at long, change string"

    def __init__(self, at: str, present: str, hold: int, resolve: int):
        self.at, self.present, self.hold, self.resolve, self.reads = at, present, hold, resolve, [at, present]

    def open(self, handle, ttl_ms) -> None:
        self.alert = handle.getValueState("alert", "mode int, at long, fired long", ttl_ms)

    def rows(self, key, rows):
        alert = Alert(*self.alert.get()) if self.alert.exists() else Alert()
        for r in rows:
            if r[self.at] is None or r[self.present] is None:
                continue
            change = alert.step(r[self.at], r[self.present], self.hold, self.resolve)
            if change:
                yield r[self.at], "firing" if change == "fired" else change
        self.alert.update((alert.mode, alert.at, alert.fired))


def alerts(stream: DataFrame, key: list[str], at: str, present: str, hold: int, resolve: int, remember_hours: float | None = None) -> DataFrame:
    """key, at, change ('firing' or 'resolved') as conditions begin and end; rows are evaluations, so a rule
    that isn't evaluated keeps its state, for remember_hours if given."""
    return arriving(stream, key, [at, present], _WithKey(AlertLogic(at, present, hold, resolve)), remember_hours)


# --- the node registry


class RegistryLogic(Logic):
    """What operators.console.registry does: heartbeats and drain commands of a node."""

    reads = ["started_at", "relay", "drain"]
    gives = "at_us long, restarted boolean, desired_drain boolean"

    def open(self, handle, ttl_ms) -> None:
        self.node = handle.getValueState("node", "started long, drain boolean", ttl_ms)

    def rows(self, key, rows):
        started, drain = self.node.get() if self.node.exists() else (None, False)
        for r in rows:
            restarted = False
            if r["drain"] is not None:
                drain = r["drain"]
            else:
                restarted = started not in (None, 0) and started != r["started_at"]
                drain = drain and not restarted and not r["relay"]
                started = r["started_at"]
            yield r["_us"], restarted, drain
        self.node.update((started, drain))


def registry(stream: DataFrame, at: str, delay: str) -> DataFrame:
    """node_id, at_us, restarted, desired_drain for each row (node_id, at, started_at, relay, drain)."""
    return in_order(stream, ["node_id"], at, delay, _WithKey(RegistryLogic()), ["drain", "started_at", "relay"])


# --- the blocklist


class BlocklistLogic(Logic):
    """Conditions of a match, with when each was first learned, until ttl_us after that; the match's best status."""

    gives = "condition string, added long, best_status string, change string"

    def __init__(self, conditions: str, status: str, ttl_us: int):
        self.conditions, self.status, self.ttl_us, self.reads = conditions, status, ttl_us, [conditions, status]

    def open(self, handle, ttl_ms) -> None:
        self.added = handle.getMapState("added", "condition string", "at long")
        self.best = handle.getValueState("best", "place int")

    def _known(self) -> list[tuple[str, int]]:
        return sorted((k[0], v[0]) for k, v in self.added.iterator()) if self.added.exists() else []

    def rows(self, key, rows):
        place = self.best.get()[0] if self.best.exists() else -1
        for r in rows:
            yield from self.until(key, r["_us"])
            now = LOOKUP_RANK.index(r[self.status]) if r[self.status] in LOOKUP_RANK else -1
            if now > place:
                place = now
                self.best.update((place,))
                for c, t in self._known():
                    yield c, t, LOOKUP_RANK[place], "status"
            for c in dict.fromkeys(r[self.conditions] or []):
                if c is not None and not self.added.containsKey((c,)):
                    self.added.updateValue((c,), (r["_us"],))
                    yield c, r["_us"], LOOKUP_RANK[place] if place >= 0 else None, "added"

    def until(self, key, watermark_us):
        place = self.best.get()[0] if self.best.exists() else -1
        for c, t in self._known():
            if t + self.ttl_us <= watermark_us:
                self.added.removeKey((c,))
                yield c, t, LOOKUP_RANK[place] if place >= 0 else None, "expired"

    def wakes(self):
        return min((t + self.ttl_us for _, t in self._known()), default=None)


def blocklist(stream: DataFrame, match: str, conditions: str, status: str, at: str, ttl_us: int, delay: str) -> DataFrame:
    """match, condition, added (microseconds), best_status and change: a condition is added, its match's status gets better,
    it expires ttl_us after it was first learned.  One that comes again after that is learned anew."""
    return in_order(stream, [match], at, delay, _WithKey(BlocklistLogic(conditions, status, ttl_us)), [status])


# --- settlement


class SettleLogic(Logic):
    """What operators.analytics.settle_times does, by timers.  What comes after a request was settled doesn't count."""

    reads = ["kind"]
    gives = "settled_at long, truth_at long"

    def open(self, handle, ttl_ms) -> None:
        self.request = handle.getValueState("request", "first long, last long, truth long, asked long, done boolean")

    def _due(self, first: int, last: int, truth: int | None, asked: int) -> int:
        soon = first + SETTLE_WITHOUT if truth is None else min(truth + SETTLE_AFTER_TRUTH, first + SETTLE_WITHOUT)
        return max(last, first + SETTLE_LATEST if asked > 0 else soon)

    def rows(self, key, rows):
        first, last, truth, asked, done = self.request.get() if self.request.exists() else (None, None, None, 0, False)
        for r in rows:
            if not done and first is not None and (due := self._due(first, last, truth, asked)) < r["_us"]:
                done = True
                yield due, truth
            if not done:
                first, last = r["_us"] if first is None else first, r["_us"]
                truth = last if truth is None and r["kind"] == "truth" else truth
                asked += (r["kind"] == "asked") - (r["kind"] == "answered")
        if first is not None:
            self.request.update((first, last, truth, asked, done))

    def until(self, key, watermark_us):
        if not self.request.exists():
            return
        first, last, truth, asked, done = self.request.get()
        due = self._due(first, last, truth, asked)
        if not done and due < watermark_us:
            self.request.update((first, last, truth, asked, True))
            yield due, truth
        elif done and first + 2 * SETTLE_LATEST < watermark_us:
            self.request.clear()

    def wakes(self):
        if not self.request.exists():
            return None
        first, last, truth, asked, done = self.request.get()
        return first + 2 * SETTLE_LATEST + 1000 if done else self._due(first, last, truth, asked) + 1000


def settlements(stream: DataFrame, request: str, at: str, delay: str) -> DataFrame:
    """request, settled_at, truth_at (microseconds) once each request is settled; rows (request, at, kind)."""
    return in_order(stream, [request], at, delay, _WithKey(SettleLogic()), ["kind"])


# --- seats


class SeatLogic(Logic):
    """What operators.analytics.seats does, evaluation by evaluation: a map from peer to its seat."""

    gives = "epoch long, peer string, state string, reason string, cooldowns long"

    def __init__(self, peer: str, rules: SeatRules):
        self.peer, self.rules, self.reads = peer, rules, [peer, "epoch", *SEAT_COLUMNS]

    def open(self, handle, ttl_ms) -> None:
        fields = "state string, reason string, cooldowns long, until double, below long, since double, lost double, observed boolean, explore boolean"
        self.seats = handle.getMapState("seats", "peer string", fields)

    def rows(self, key, rows):
        peers = {k[0]: _Seat(*v) for k, v in self.seats.iterator()} if self.seats.exists() else {}
        for epoch, here in groupby(rows, key=lambda r: r["epoch"]):
            now = {r[self.peer]: tuple(r[c] for c in SEAT_COLUMNS) for r in here}
            for name, p in sorted(_evaluate(peers, now, epoch, self.rules).items()):
                yield epoch, name, p.state, p.reason, p.cooldowns
        for name, p in peers.items():
            since = None if p.since is None else float(p.since)
            self.seats.updateValue((name,), (p.state, p.reason, p.cooldowns, float(p.until), p.below, since, float(p.lost), p.observed, p.explore))


def seats(stream: DataFrame, network: list[str], peer: str, at: str, delay: str, rules: SeatRules | None = None) -> DataFrame:
    """network, epoch, peer, state, reason, cooldowns as each evaluation is complete; rows as operators.analytics.seats takes
    them, with `at`, the evaluation's time."""
    stream = stream if "exploring" in stream.columns else stream.withColumn("exploring", F.lit(False))
    return in_order(stream, network, at, delay, _WithKey(SeatLogic(peer, rules or SeatRules())), [peer])

"""Folds over ordered streams, in parallel within a stream.

A stream's rows are numbered in order and cut into blocks.  What a block does to whatever state it is entered with is
summed up in parallel, block by block; the summaries, a row a block, are put together in order, which gives the state
that each block is entered with; then the blocks are gone through again, in parallel, from those states.  A task holds
a block, and one stream may hold any share of all rows.

Nulls are values: rows with a null stream are one stream, a null key is a key.  Rows go through Arrow, so no column
changes its type or its values.  Columns whose names begin with an underscore are the operators' own.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalstream.operators.ordered import global_sequence
from opalstream.shared import materialised

BITS = 14
_PLAIN = {"tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}
_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def key_text(columns: list[str]) -> Column:
    """Columns' values as one text, null if there are none: equal for equal values, nulls included."""
    return F.to_json(F.struct(*columns), _JSON) if columns else F.lit("")


def numbered(df: DataFrame, stream: list[str], order: list[str], bits: int = BITS) -> DataFrame:
    """df with _k, the stream, _g, rows' numbers from 0 by stream and order, and _block; a stream's numbers follow each
    other without gaps, and a block of a stream is at most 2^bits of its rows."""
    rows = df.withColumn("_k", key_text(stream))
    # numbers and the like first: sorting compares few bytes of texts at once, and those of _k begin alike
    plain = [c for c, t in df.dtypes if c in stream and t in _PLAIN]
    return global_sequence(rows, [*plain, "_k", *order], "_g", 0).withColumn("_block", F.shiftright("_g", bits))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one _k and _block after the other; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        codes = b.column("_k").dictionary_encode()
        k, block = codes.indices.to_numpy(zero_copy_only=False), b.column("_block").to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero((k[1:] != k[:-1]) | (block[1:] != block[:-1])) + 1).tolist()
        for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
            at = (codes.dictionary[int(k[i])].as_py(), int(block[i]))
            if held and at != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = at
    if held:
        yield pa.Table.from_batches(held)


def _by_block(df: DataFrame, *more: str) -> DataFrame:
    return df.repartition("_k", "_block").sortWithinPartitions("_k", "_block", *more)


def _by_stream(df: DataFrame) -> DataFrame:
    return df.repartition("_k").sortWithinPartitions("_k", "_block")


def _of(table: pa.Table) -> tuple[str, int]:
    return table.column("_k")[0].as_py(), table.column("_block")[0].as_py()


def _whole(table: pa.Table) -> pa.RecordBatch:
    return table.combine_chunks().to_batches()[0]


# --- greedy batches


def _starts(size: np.ndarray, most_rows: int, most_bytes: int) -> np.ndarray:
    """Where the next batch begins if one begins at each row."""
    total = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(len(size))
    return np.minimum(np.maximum(np.searchsorted(total, total[:-1] + most_bytes, "right") - 1, at + 1), at + most_rows)


def greedy_batches(rows: DataFrame, stream: list[str], order: list[str], size: str, most_rows: int = 64, most_bytes: int = 32_768, bits: int = BITS) -> DataFrame:
    """Adds batch, from 1 in each stream: rows in order go to the open batch while it has room for them.

    A row larger than most_bytes is a batch of its own; what doesn't fit opens the next batch; a null or negative size
    counts 0.  From each row the next batch's first row is found by bytes and number; a block's summary says for
    each of its first most_rows rows, as the first of a batch, where the first batch of the next block begins, found by
    pointer doubling."""
    if most_rows >= 1 << bits:
        raise ValueError("a block must hold more rows than a batch")
    own, names = 1 << bits, rows.columns
    placed = materialised(numbered(rows, stream, order, bits), "numbered")
    sizes = placed.select("_k", "_g", "_block", F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("_size"))
    # a block's batches may reach over its end, by most_rows at most
    near = F.when((F.col("_g").bitwiseAND(own - 1) < most_rows) & (F.col("_block") > 0), F.array(F.col("_block"), F.col("_block") - 1)).otherwise(F.array("_block"))
    reach = sizes.withColumn("_block", F.explode(near))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches):
            k, block = _of(t)
            g = t.column("_g").to_numpy()
            n = int((g >> bits == block).sum())
            if not n:
                continue  # a stream that begins with the next block
            jump = np.append(_starts(t.column("_size").to_numpy(), most_rows, most_bytes), np.arange(len(g), len(g) + most_rows))
            jump[n:] = np.arange(n, len(jump))  # the first batch beyond the block
            count = np.concatenate([np.ones(n, np.int64), np.zeros(len(jump) - n, np.int64)])
            while (jump[:n] < n).any():
                count, jump = count + count[jump], jump[jump]
            some = min(most_rows, n)
            yield pa.RecordBatch.from_pydict({"_k": [k], "_block": [block], "n": [n], "to": [(jump[:some] - n).tolist()], "count": [count[:some].tolist()]})

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, at, batch = None, 0, 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["_k"] != mine:
                    mine, at, batch = r["_k"], 0, 0
                out.append((mine, r["_block"], at, batch))
                if at < r["n"]:
                    at, batch = r["to"][at], batch + r["count"][at]
                else:
                    at -= r["n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["_k", "_block", "_at", "_before"]) if out else _no_rows

    _no_rows = pa.RecordBatch.from_pydict({"_k": pa.array([], pa.string()), "_block": pa.array([], pa.int64()), "_at": pa.array([], pa.int64()), "_before": pa.array([], pa.int64())})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches):
            b = _whole(t)
            at, batch = b.column("_at")[0].as_py(), b.column("_before")[0].as_py()
            b = b.slice(1)
            following, new, i = _starts(b.column("_size").to_numpy(), most_rows, most_bytes), np.zeros(b.num_rows, np.int64), at
            while i < len(new):
                new[i] = 1
                i = int(following[i])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(batch + np.cumsum(new))], [*names, "batch"])

    summaries = _by_block(reach, "_g").mapInArrow(summed, "_k string, _block long, n long, to array<long>, count array<long>")
    states = _by_stream(summaries).mapInArrow(entered, "_k string, _block long, _at long, _before long")
    whole = placed.withColumn("_size", F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)))
    both = states.unionByName(whole, allowMissingColumns=True)
    schema = rows.withColumn("batch", F.lit(0).cast("long")).schema
    return _by_block(both, F.col("_g").asc_nulls_first()).mapInArrow(dealt, _nullable(schema))


def _nullable(schema):
    from pyspark.sql.types import StructField, StructType

    return StructType([StructField(f.name, f.dataType, True) for f in schema.fields])


# --- alerts that hold and resolve

IDLE, PENDING, FIRING, FADING = range(4)


class Alert:
    """The state of a condition: nothing, pending since, firing, firing with the condition gone since; and how often it
    has fired."""

    __slots__ = ("mode", "at", "fired")

    def __init__(self, mode: int = IDLE, at: int | None = None, fired: int = 0):
        self.mode, self.at, self.fired = mode, at, fired

    def step(self, t: int, on: bool, hold: int, resolve: int) -> str | None:
        """What changes with an evaluation."""
        if on:
            if self.mode == FADING:
                self.mode, self.at = FIRING, None
            elif self.mode == IDLE:
                self.mode, self.at = PENDING, t
            if self.mode == PENDING and t - self.at >= hold:
                self.mode, self.fired = FIRING, self.fired + 1
                return "fired"
        elif self.mode == PENDING:
            self.mode, self.at = IDLE, None
        elif self.mode in (FIRING, FADING):
            if self.mode == FIRING:
                self.mode, self.at = FADING, t
            if t - self.at >= resolve:
                self.mode, self.at = IDLE, None
                return "resolved"
        return None


def _enter(state: Alert, r: dict, hold: int, resolve: int) -> Alert:
    """The state after a block, from its summary: the first rows of one kind settle what a state becomes, and from
    there on the block does what it does to an idle or a firing one."""
    idle, firing = Alert(r["i_mode"], r["i_at"], state.fired + r["i_fired"]), Alert(r["f_mode"], r["f_at"], state.fired + r["f_fired"])
    if state.mode == IDLE:
        return idle
    if state.mode == FIRING:
        return firing
    if state.mode == PENDING:
        if not r["on"]:
            return idle
        if r["until"] - state.at >= hold:
            firing.fired += 1
            return firing
        return state if r["all_alike"] else idle
    if r["on"]:
        return firing
    if r["until"] - state.at >= resolve:
        return idle
    return state if r["all_alike"] else firing


_STATE = "_k string, _block long, _mode int, _at long, _fired long"


def islands(rows: DataFrame, key: list[str], at: str, present: str, hold: int, resolve: int, bits: int = BITS) -> DataFrame:
    """key, pending_since, fired_at, resolved_at of each alert that fired.

    rows has a row per key and evaluation.  A condition that is present stays pending until it has lasted
    `hold`; before that an absence drops it.  Once firing, it ends at the first evaluation that has been
    absent for `resolve` since the absence began; a presence before that forgets the absence.  Rows without a time or
    a verdict are no evaluations; of evaluations at the same time absences come first."""
    flat = rows.select(*key, F.col(at).cast("long").alias("_t"), F.col(present).alias("_on")).filter("_t is not null and _on is not null")
    placed = materialised(numbered(flat, key, ["_t", "_on"], bits), "numbered")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches):
            k, block = _of(t)
            times, on = t.column("_t").to_pylist(), t.column("_on").to_pylist()
            alike = next((i for i, x in enumerate(on) if x != on[0]), len(on))
            idle, firing = Alert(), Alert(FIRING)
            for x, y in zip(times, on):
                idle.step(x, y, hold, resolve)
                firing.step(x, y, hold, resolve)
            out = {"_k": k, "_block": block, "on": on[0], "until": times[alike - 1], "all_alike": alike == len(on)}
            out |= {"i_mode": idle.mode, "i_at": idle.at, "i_fired": idle.fired, "f_mode": firing.mode, "f_at": firing.at, "f_fired": firing.fired}
            yield pa.RecordBatch.from_pylist([out], _SUMMARY)

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, state = None, Alert()
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["_k"] != mine:
                    mine, state = r["_k"], Alert()
                out.append({"_k": mine, "_block": r["_block"], "_mode": state.mode, "_at": state.at, "_fired": state.fired})
                state = _enter(state, r, hold, resolve)
            yield pa.RecordBatch.from_pylist(out, _ENTRY)

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches):
            b = _whole(t)
            state = Alert(b.column("_mode")[0].as_py(), b.column("_at")[0].as_py(), b.column("_fired")[0].as_py())
            b, took = b.slice(1), []
            for i, (x, y) in enumerate(zip(b.column("_t").to_pylist(), b.column("_on").to_pylist())):
                since = state.at if state.mode == PENDING else x
                change = state.step(x, y, hold, resolve)
                if change == "fired":
                    took.append((i, state.fired, since, x, None))
                elif change == "resolved":
                    took.append((i, state.fired, None, None, x))
            if took:
                i, *columns = zip(*took)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(i)) for c in [*key, "_k"]), *(pa.array(c, pa.int64()) for c in columns)], [*key, "_k", "_fired", "a", "b", "c"])

    summaries = _by_block(placed, "_g").mapInArrow(summed, "_k string, _block long, on boolean, until long, all_alike boolean, i_mode int, i_at long, i_fired long, f_mode int, f_at long, f_fired long")
    states = _by_stream(summaries).mapInArrow(entered, _STATE)
    both = _by_block(states.unionByName(placed, allowMissingColumns=True), F.col("_g").asc_nulls_first())
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in key), "_k string, _fired long, a long, b long, c long"])
    changes = both.mapInArrow(replayed, schema)
    # a key's columns are the same in all rows of its stream
    out = changes.groupBy("_k", "_fired", *key).agg(F.max("a").alias("pending_since"), F.max("b").alias("fired_at"), F.max("c").alias("resolved_at"))
    return out.select(*key, "pending_since", "fired_at", "resolved_at")


_SUMMARY = pa.schema([
    ("_k", pa.string()), ("_block", pa.int64()), ("on", pa.bool_()), ("until", pa.int64()), ("all_alike", pa.bool_()),
    ("i_mode", pa.int32()), ("i_at", pa.int64()), ("i_fired", pa.int64()), ("f_mode", pa.int32()), ("f_at", pa.int64()), ("f_fired", pa.int64()),
])
_ENTRY = pa.schema([("_k", pa.string()), ("_block", pa.int64()), ("_mode", pa.int32()), ("_at", pa.int64()), ("_fired", pa.int64())])


# --- first arrivals by a bounded ring


class Ring:
    """The last `size` keys, oldest out first."""

    def __init__(self, size: int, keys: list[str] = ()):
        self.size, self.keys = size, OrderedDict.fromkeys(keys)

    def add(self, k) -> bool:
        if k in self.keys:
            return False
        self.keys[k] = None
        if len(self.keys) > self.size:
            self.keys.popitem(last=False)
        return True


def ring_dedup(df: DataFrame, by: list[str], key: list[str], order: list[str], size: int = 4096, bits: int | None = None) -> DataFrame:
    """First arrivals: rows whose key isn't among the last `size` accepted keys of their `by`.

    A ring soon forgets how it began, so blocks (of 16 rings at least) are run at once, each from the ring that the
    block before was left with in the round before; blocks whose first ring has changed are run again, until none
    has.  The first block's ring is right from the start, and each round makes the next one's right at least; mostly
    two or three rounds do for all."""
    bits = max(BITS, (16 * size - 1).bit_length()) if bits is None else bits
    placed = materialised(numbered(df, by, order, bits).withColumn("_key", key_text(key)), "numbered")
    keys, names = placed.select("_k", "_block", "_g", "_key"), df.columns
    rings = "_k string, _block long, _ring array<string>"

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ring after each block that has a row with the ring before it."""
        for t in blocks(batches):
            b = _whole(t)
            first = b.column("_ring")[0].as_py()
            if first is None:
                continue
            ring = Ring(size, first)
            for x in b.column("_key").slice(1).to_pylist():
                ring.add(x)
            k, block = _of(t)
            yield pa.RecordBatch.from_pydict({"_k": pa.array([k]), "_block": pa.array([block]), "_ring": pa.array([list(ring.keys)], pa.list_(pa.string()))})

    def ended(before: DataFrame) -> DataFrame:
        both = before.unionByName(keys, allowMissingColumns=True)
        return _by_block(both, F.col("_g").asc_nulls_first()).mapInArrow(left, rings)

    before = materialised(keys.select("_k", "_block").distinct().withColumn("_ring", F.array().cast("array<string>")), "rings")
    after = materialised(ended(before), "rings")
    while True:
        # what each block is entered with by the round before; unlike what it was run from: run it again
        passed = after.select("_k", (F.col("_block") + 1).alias("_block"), F.col("_ring").alias("_new"))
        now = before.join(passed, ["_k", "_block"], "left").select("_k", "_block", "_ring", F.coalesce("_new", "_ring").alias("_new"))
        now = materialised(now, "rings")
        changed = now.filter(~F.col("_ring").eqNullSafe(F.col("_new"))).select("_k", "_block", F.col("_new").alias("_ring"))
        if changed.isEmpty():
            break
        again = materialised(ended(changed), "rings")
        after = materialised(after.join(again.select("_k", "_block"), ["_k", "_block"], "left_anti").unionByName(again), "rings")
        before = now.select("_k", "_block", F.col("_new").alias("_ring"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches):
            b = _whole(t)
            ring, b = Ring(size, b.column("_ring")[0].as_py()), b.slice(1)
            new = pa.array([ring.add(x) for x in b.column("_key").to_pylist()], pa.bool_())
            yield b.select(names).filter(new)

    both = before.unionByName(placed, allowMissingColumns=True)
    return _by_block(both, F.col("_g").asc_nulls_first()).mapInArrow(kept, _nullable(df.schema))


# --- decayed counts


def _carried(half_life: float):
    """What each key of a stretch is entered with, and the number of the key's row before it."""

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, total, last = None, 0.0, None
        for b in batches:
            out = []
            for *k, end, s in zip(*(b.column(c).to_pylist() for c in ("_k", "_a", "_b", "_end", "_sum"))):
                k = [repr(x) for x in k]  # so that a NaN is itself, and a null no text
                if k != mine:
                    mine, total, last = k, 0.0, None
                out.append((total, last))
                total, last = s if last is None else total * 2.0 ** -((end - last) / half_life) + s, end
            carry = [pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_k", "_block", "_a", "_b")), *carry], ["_k", "_block", "_a", "_b", "_carry", "_prev"])

    return carried


def _before(code: np.ndarray, g: np.ndarray, at: np.ndarray, half_life: float, keys: np.ndarray, carry: np.ndarray, prev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of a stretch's keys, in order: the number of the key's rows before, each halved with every half_life rows
    from it to the last of them, and that last one's number; 0 and -1 without any.  at: g within the stretch; keys,
    carry, prev: what keys are entered with."""
    order = np.argsort(code, kind="stable")
    code, g, at = code[order], g[order], at[order]
    inside = pd.Series(np.exp2(at / half_life)).groupby(code, sort=False).cumsum().to_numpy()
    again = np.concatenate([[False], code[1:] == code[:-1]])
    last, total = np.where(again, np.roll(g, 1), -1), np.where(again, np.roll(inside, 1) * np.exp2(-np.roll(at, 1) / half_life), 0.0)
    if len(keys):
        place = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        known = keys[place] == code
        since = np.where(last < 0, 0, last - prev[place])
        total += np.where(known, carry[place] * np.exp2(-np.where(known, since, 0) / half_life), 0.0)
        last = np.where(known & (last < 0), prev[place], last)
    out = np.empty_like(total), np.empty_like(last)
    out[0][order], out[1][order] = total, last
    return out


def _codes(table: pa.Table, name: str) -> np.ndarray:
    """Equal values' numbers from 1, 0 for null."""
    return table.column(name).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def decayed_edge(rows: DataFrame, stream: list[str], order: list[str], parent: str, child: str, half_life: float, alpha: float = 2.0, base_alpha: float = 1.0, vocabulary: int = 2000, most_rows: int = 1 << 16) -> DataFrame:
    """stream, n, log10_bf: as prequential_bf with counts halved every half_life rows; a row's counts decay only when it
    is updated.  Rows without a parent or a child don't count.

    A decayed count is a sum of powers, so counts of children, of parents, of pairs and of all are running sums over
    stretches of a stream (64 half-lives, most_rows at most) with what the stretches before hand on.  Rows are numbered,
    summed up by stretch and pair, and gone through once for all four."""
    span = max(1, min(most_rows, int(64 * half_life)))
    types = dict(rows.dtypes)
    same = lambda c: F.col(c) + F.lit(0.0) if types[c] in ("float", "double") else F.col(c) if types[c] in _PLAIN | {"string", "boolean"} else key_text([c])  # noqa: E731  -0 is 0
    flat = rows.filter(F.col(parent).isNotNull() & F.col(child).isNotNull()).withColumns({"_a": same(parent), "_b": same(child)})
    flat = flat.select(*[F.col(c) for c in dict.fromkeys([*stream, *order, "_a", "_b"])])
    streams = list(dict.fromkeys(stream))
    placed = materialised(numbered(flat, stream, order).select(*streams, "_k", "_g", "_a", "_b"), "numbered").withColumn("_block", F.expr(f"_g div {span}"))
    up = lambda g: F.pow(F.lit(2.0), g / half_life)
    start = F.col("_block") * span
    pairs = placed.groupBy("_k", "_block", "_a", "_b").agg(F.max("_g").alias("_end"), F.sum(up(F.col("_g") - start)).alias("_sum"))
    by = ["_k", "_block", "_a", "_b"]  # a null: of whatever parent, or child
    sums = pairs.groupingSets([by[:2], by[:3], ["_k", "_block", "_b"], by], *by).agg(F.max("_end").alias("_end"), F.sum("_sum").alias("_sum"))
    sums = sums.select(*by, "_end", (F.col("_sum") * up(start - F.col("_end"))).alias("_sum"))
    kinds = dict(placed.dtypes)
    carried = sums.repartition("_k", "_a", "_b").sortWithinPartitions("_k", "_a", "_b", "_block").mapInArrow(_carried(half_life), f"_k string, _block long, _a {kinds['_a']}, _b {kinds['_b']}, _carry double, _prev long")

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out() -> pa.RecordBatch:
            t, sizes = pa.concat_tables(held).combine_chunks(), np.array([len(x) for x in held])
            own, block = t.column("_what").to_numpy() == 1, np.repeat(np.arange(len(held)), sizes)
            a, b = _codes(t, "_a"), _codes(t, "_b")
            code = lambda x, y: (block * (a.max() + 1) + x) * (b.max() + 1) + y
            entered = np.flatnonzero(~own)
            keys = code(a, b)[entered]
            entered, keys = entered[np.argsort(keys)], np.sort(keys)
            carry, prev = (t.column(c).take(pa.array(entered)).to_numpy() for c in ("_carry", "_prev"))
            g = t.column("_g").filter(pa.array(own)).to_numpy()
            none = np.zeros_like(a)
            of = lambda x, y: _before(code(x, y)[own], g, g % span, half_life, keys, carry, prev)
            (t_s, t_g), (m_s, m_g), (n_s, n_g), (c_s, c_g) = of(none, none), of(none, b), of(a, none), of(a, b)
            m = m_s * np.exp2(-(t_g - m_g) / half_life * (m_g >= 0))
            base = (m + base_alpha / vocabulary) / (t_s + base_alpha)
            c = c_s * np.exp2(-(n_g - c_g) / half_life * (c_g >= 0))
            gain = np.log10((c + alpha * base) / (n_s + alpha) / base)
            last = np.cumsum(sizes) - 1  # rows come after what is handed on
            some = t.select(["_k", *streams]).take(pa.array(last)).combine_chunks().to_batches()[0]
            n, bf = np.bincount(block[own], minlength=len(held)), np.bincount(block[own], gain, len(held))
            return pa.RecordBatch.from_arrays([*some.columns, pa.array(n, pa.int64()), pa.array(bf, pa.float64())], ["_k", *streams, "n", "log10_bf"])

        for t in blocks(batches):
            held.append(t)
            if sum(map(len, held)) >= 1 << 16:
                yield out()
                held.clear()
        if held:
            yield out()

    both = placed.withColumn("_what", F.lit(1)).unionByName(carried.filter("_prev is not null").withColumn("_what", F.lit(0)), allowMissingColumns=True)
    schema = ", ".join(["_k string", *(f"`{c}` {types[c]}" for c in streams), "n long, log10_bf double"])
    parts = _by_block(both, "_what", "_g").mapInArrow(weighed, schema)
    return parts.groupBy("_k", *streams).agg(F.sum("n").alias("n"), F.sum("log10_bf").alias("log10_bf")).drop("_k")

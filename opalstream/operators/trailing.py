"""A quantile of the values in a trailing window of time, for each of many questions, without a list of any window.

A window's quantile changes only when a sample comes or goes (when the window leaves it), so these moves alone are
answered, however many questions there are; a question takes the answer of the last move before it, found by one range
shuffle of questions and changes in order of time.

Samples are ranked by value once, so a sample's rank stands for it.  Moves are put on one line of time and cut into
blocks.  While a block passes, a window's population changes by no more than the block's own rows; so whatever is the
quantile there lies among the block's own samples and a short run, in order of value, of the population that the block
begins with.  That run is found by counting: each block's comings and goings by bucket of rank, running totals over
blocks, and the buckets in which the run begins and ends.  The samples of these buckets are looked up, and each block is
gone through with them in order, in parallel.  Blocks and buckets grow with the two-thirds power of the number of
samples, so what is added up one block after the other is its cube root by its cube root of numbers, even if one stream
has all samples.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opalstream.operators.scans import blocks, key_text
from opalstream.shared import materialised

LOWEST, HIGHEST = -1, (1 << 63) - 1
SPREAD = 16


def place(n: int, q: float) -> int:
    """The nearest rank of n values, from 0."""
    return min(math.floor((n - 1) * q + 0.5), n - 1)


def trailing_rank(asked: DataFrame, samples: DataFrame, by: list[str], at: str, seq: str, value: str, window: int, q: float, least: int, name: str = "rank_value", bits: int | None = None, every: bool = False) -> DataFrame:
    """by, at, seq and `name` of the rows of asked whose window holds `least` samples or more: the value of nearest rank q
    among the samples of the same `by` that come before in (at, seq), by no more than `window` in `at`.

    asked and samples have by, at and seq (numbers), samples a value (long); null values are no samples.  With `every`, all
    rows and columns of asked are returned, `name` null for the others."""
    least = max(1, least)
    s = samples.filter(F.col(value).isNotNull()).select(key_text(by).alias("_k"), F.col(at).cast("long").alias("_t"), F.col(seq).cast("long").alias("_seq"), F.col(value).cast("long").alias("_v"))
    order = ["_k", "_v", "_t", "_seq"]
    ranked = materialised(s.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    if bits is None:
        bits = max(12, math.ceil(math.log2(max(ranked.count(), 1)) * 2 / 3))
    both = F.explode(F.array(F.struct(F.col("_t").alias("t"), F.lit(0).alias("g"), F.lit(1).alias("d")), F.struct((F.col("_t") + window).alias("t"), F.lit(1).alias("g"), F.lit(-1).alias("d"))))
    moves = ranked.select("_k", both.alias("x"), "_seq", "_id", "_v").select("_k", F.col("x.t").alias("_t"), F.col("x.g").alias("_gone"), "_seq", F.col("x.d").alias("_d"), "_id", "_v")
    line = ["_k", "_t", "_gone", "_seq", "_d"]  # at one time: what comes and what is asked, by seq, then what goes
    events = moves.repartitionByRange(*line, "_id").sortWithinPartitions(*line, "_id")
    events = materialised(events.withColumn("_at", F.monotonically_increasing_id()), "timeline").withColumn("_block", F.shiftright("_at", bits))

    def sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block that ever has samples enough: how many it begins with, the buckets of its run, and how many lie below."""
        mine, held = None, {}
        for t in blocks(batches):
            k, block = t.column("_k")[0].as_py(), t.column("_block")[0].as_py()
            if k != mine:
                mine, held = k, {}
            come, go = (int(np.sum(t.column(c).to_numpy())) for c in ("come", "go"))
            total = sum(held.values())
            if total + come >= least:
                first = place(max(total - go, 1), q) - come
                last = place(total + come, q) + go
                buckets = sorted(held)
                upto = np.cumsum([held[b] for b in buckets])
                i = 0 if first <= 0 else int(np.searchsorted(upto, first, "right"))
                j = int(np.searchsorted(upto, last, "right"))
                low, high = LOWEST if first <= 0 else buckets[i], HIGHEST if j >= len(buckets) else buckets[j]
                below = int(upto[i - 1]) if i else 0
                yield pa.RecordBatch.from_pylist([{"_k": k, "_block": block, "total": total, "below": below, "low": low, "high": high, "buckets": buckets[i : j + 1]}], _SOUGHT)
            for bucket, d in zip(t.column("bucket").to_pylist(), t.column("d").to_pylist()):
                held[bucket] = held.get(bucket, 0) + d
                if not held[bucket]:
                    del held[bucket]

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The moves of a block after which another value is the quantile, or none (as at the end of a block before one
        that never has samples enough), and the first."""
        for t in blocks(batches):
            got = {c: t.column(c).to_pylist() for c in ("_what", "_id", "_v", "_d", "total", "below", "low", "high")}
            total, below, low, high = (got[c][0] for c in ("total", "below", "low", "high"))
            run, values, rows, found = [], {}, [], []
            for i, (what, x, v, d) in enumerate(zip(got["_what"], got["_id"], got["_v"], got["_d"])):
                if what == 1:
                    run.append(x)
                    values[x] = v
                elif what == 2:
                    total += d
                    bucket = x >> bits
                    if bucket < low:
                        below += d
                    elif bucket <= high:
                        if d > 0:
                            insort(run, x)
                            values[x] = v
                        else:
                            del run[bisect_left(run, x)]
                    now = values[run[place(total, q) - below]] if total >= least else None
                    if not found or now != found[-1]:
                        rows.append(i)
                        found.append(now)
            if rows:
                some = t.select([*line, "_place"]).take(pa.array(rows)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(found, pa.int64())], [*line, "_place", "_now"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Questions with the value of the last change before them in their part; the first stream's before any change there
        are `_open`.  At the end a row for the part: its first and last stream, and the last one's value if it changed there."""
        part, head, k, changed, value = TaskContext.get().partitionId(), None, None, False, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            codes = b.column("_k").dictionary_encode()
            code, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary
            i = np.arange(1, n + 1)  # in `now`, which begins with what the batch before left
            cut = np.concatenate([[names[int(code[0])].as_py() != k], code[1:] != code[:-1]])
            if head is None:
                head = names[int(code[0])].as_py()
            ask = b.column("_d").to_numpy() == 0
            begin = np.maximum.accumulate(np.where(cut, i, 0))
            last = np.maximum.accumulate(np.where(ask, 0, i))
            known = (last >= np.maximum(begin, 1)) | ((begin == 0) & changed)
            now = pa.concat_arrays([pa.array([value], pa.int64()), b.column("_now")]).take(pa.array(np.where(known, last, 0), mask=~known))
            k, changed, value = names[int(code[-1])].as_py(), bool(known[-1]), now[n - 1].as_py()
            if ask.any():
                open_ = ~known & (code == names.index(head).as_py())
                got = pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), now, pa.array(open_)], [*kept, name, "_open"]).filter(pa.array(ask))
                m = got.num_rows
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array([part] * m, pa.int32()), pa.nulls(m, pa.string()), pa.nulls(m, pa.string())], [*got.schema.names, "_part", "_head", "_tail"])
        if head is not None:
            row = [*(pa.nulls(1, b.schema.field(c).type) for c in kept), pa.array([value], pa.int64()), pa.array([changed]), pa.array([part], pa.int32()), pa.array([head]), pa.array([k])]
            yield pa.RecordBatch.from_arrays(row, [*kept, name, "_open", "_part", "_head", "_tail"])

    bucket = F.shiftright("_id", bits)
    moved = events.groupBy("_k", "_block", bucket.alias("bucket")).agg(F.sum("_d").cast("long").alias("d"), F.count_if(F.col("_d") > 0).alias("come"), F.count_if(F.col("_d") < 0).alias("go"))
    wanted = moved.repartition("_k").sortWithinPartitions("_k", "_block").mapInArrow(sought, "_k string, _block long, total long, below long, low long, high long, buckets array<long>")
    wanted = materialised(wanted, "sought")
    begins = events.groupBy("_k", "_block").agg(F.min(F.struct(*line[1:])).alias("_from"))
    # the samples of a bucket are dealt out, and each part is asked by all blocks that need the bucket
    asking = wanted.join(begins, ["_k", "_block"]).select("_k", "_block", "_from", F.explode("buckets").alias("_bucket")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    there = ranked.select("*", bucket.alias("_bucket"), F.pmod(F.xxhash64("_id"), F.lit(SPREAD)).cast("int").alias("_part"))
    came = F.struct(F.col("_t"), F.lit(0).alias("_gone"), F.col("_seq"), F.lit(1).alias("_d"))
    goes = F.struct((F.col("_t") + window).alias("_t"), F.lit(1).alias("_gone"), F.col("_seq"), F.lit(-1).alias("_d"))
    runs = asking.join(there, ["_k", "_bucket", "_part"]).filter((came < F.col("_from")) & (goes >= F.col("_from"))).select("_k", "_block", F.lit(1).alias("_what"), F.col("_id").alias("_place"), "_id", "_v")
    heads = wanted.select("_k", "_block", F.lit(0).alias("_what"), F.lit(0).cast("long").alias("_place"), "total", "below", "low", "high")
    own = events.join(wanted.select("_k", "_block"), ["_k", "_block"], "left_semi").withColumnRenamed("_at", "_place").withColumn("_what", F.lit(2))
    rows = own.unionByName(runs, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
    changes = rows.repartition("_k", "_block").sortWithinPartitions("_k", "_block", "_what", "_place").mapInArrow(answered, "_k string, _t long, _gone int, _seq long, _d int, _place long, _now long")
    kept = asked.columns if every else [*by, at, seq]
    ask = asked.select(key_text(by).alias("_k"), F.col(at).cast("long").alias("_t"), F.lit(0).alias("_gone"), F.col(seq).cast("long").alias("_seq"), F.lit(0).alias("_d"), *kept)
    both = ask.unionByName(materialised(changes, "changes"), allowMissingColumns=True).repartitionByRange(*line, "_place").sortWithinPartitions(*line, "_place")
    types = dict(asked.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"`{name}` long, _open boolean, _part int, _head string, _tail string"])
    found = materialised(both.mapInArrow(filled, schema), "filled")
    # a row a part: what its first stream's last change in the parts before was
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = found.filter("_head is not null").withColumn("_was", F.last(F.when(F.col("_open"), F.struct("_tail", F.col(name).alias("v"))), ignorenulls=True).over(before))
    parts = parts.select("_part", F.when(F.col("_was._tail") == F.col("_head"), F.col("_was.v")).alias("_was"))
    out = found.filter("_head is null").join(F.broadcast(parts), "_part").select(*kept, F.when(F.col("_open"), F.col("_was")).otherwise(F.col(name)).alias(name))
    return out if every else out.filter(F.col(name).isNotNull())


_SOUGHT = pa.schema([(c, pa.string() if c == "_k" else pa.int64()) for c in ("_k", "_block", "total", "below", "low", "high")] + [("buckets", pa.list_(pa.int64()))])

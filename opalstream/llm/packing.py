"""Packing documents into fixed windows with minimum bin slack.

A document's ids are followed by one end id and cut every `window` ids; whole windows are sequences
of their own.  The remainders are packed, a block of them at a time, by minimum bin slack: a bitset of
reachable sums, grown over the multiset of remaining lengths (counts split into powers of two),
gives the fullest window; the multiset that fills it is found by backtracking and used as often as
the counts allow.  Windows without slack are taken at once.  The others come in the same order, the
fullest first, but no more of them than it takes to leave half a block waiting for what is still to come;
at the end of a task all are taken.  No remainder is cut.

Null and empty texts are one piece, the end id.  Very long texts are cut as others are.  Repeated
rows are packed each on their own, ties are broken by arrival.  An empty table gives an empty one.
Other columns of any name are not read.  sequence_id and row, which tells the pieces of one row of the
table from those of a row that repeats it, are the task's number times 2^32 plus a running number, so rows must come in the same order when a task is run again: read them from storage.  A
task holds one block of remainders and one batch of texts, no more.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalstream.llm.common import light_batches
from opalstream.llm.tokens import encoder, vocabulary_path

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, row long"


def best_fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum comes closest to window from below."""
    steps, reach, full = [], [1], 1 << window
    mask = (1 << (window + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], window // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k))
            reach.append((reach[-1] | reach[-1] << (length * k)) & mask)
            if reach[-1] & full:
                break
            left -= k
            k *= 2
        if reach[-1] & full:
            break
    at, used = reach[-1].bit_length() - 1, {}
    for i in range(len(steps) - 1, -1, -1):
        if not reach[i] >> at & 1:  # the sum needs step i
            length, k = steps[i]
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


def plan_windows(counts: dict[int, int], window: int, leave: int = 0) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Fills, the fullest first, with how often each is used, and the counts left.

    Full windows are all planned, those with slack until no more than `leave` remainders are left."""
    counts, plan = {k: v for k, v in counts.items() if v}, []
    left = sum(counts.values())
    while left:
        used = best_fill(counts, window)
        times, each = min(counts[k] // v for k, v in used.items()), sum(used.values())
        if sum(k * v for k, v in used.items()) < window:
            times = min(times, -(-(left - leave) // each))
            if times <= 0:
                break
        plan.append((used, times))
        left -= times * each
        for k, v in used.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]
    return plan, counts


class Packer:
    def __init__(self, window: int, first_sequence: int, block: int):
        self.window, self.sequence, self.row, self.block = window, first_sequence, first_sequence, block
        self.waiting: dict[int, deque] = {}
        self.held = self.size = 0  # remainders that wait; bytes of rows that are ready
        self.rows: list[tuple] = []

    def put(self, piece: tuple, offset: int) -> None:
        doc, start, ids, total, row = piece
        self.rows.append((doc, start, len(ids) // 4, ids, total, self.sequence, offset, row))
        self.size += len(ids)

    def add(self, doc: int | None, ids: bytes) -> None:
        total, w, row = len(ids) // 4, self.window, self.row
        self.row += 1
        for start in range(0, total - w + 1, w):
            self.put((doc, start, ids[4 * start : 4 * (start + w)], total, row), 0)
            self.sequence += 1
        start = total // w * w
        if start < total:
            self.waiting.setdefault(total - start, deque()).append((doc, start, ids[4 * start :], total, row))
            self.held += 1
            if self.held >= self.block:
                self.pack(self.block // 2)

    def pack(self, leave: int = 0) -> None:
        plan, _ = plan_windows({k: len(v) for k, v in self.waiting.items()}, self.window, leave)
        for used, times in plan:
            for _ in range(times):
                offset = 0
                for length in sorted(used, reverse=True):
                    for _ in range(used[length]):
                        self.put(self.waiting[length].popleft(), offset)
                        offset += length
                self.held -= sum(used.values())
                self.sequence += 1
        self.waiting = {k: v for k, v in self.waiting.items() if v}

    def take(self) -> pd.DataFrame:
        out, self.rows, self.size = self.rows, [], 0
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "row"]).astype({"doc_id": "Int64"})


def pack_documents(docs: DataFrame, window: int = 1024, end_id: int = 0, vocabulary: str | None = None, text_col: str = "text", id_col: str = "doc_id", block: int = 8192) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, row."""
    light_batches(docs.sparkSession)
    path, end = vocabulary or vocabulary_path(), np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, packer = encoder(path), Packer(window, TaskContext.get().partitionId() << 32, block)
        for pdf in batches:
            for doc, ids in zip(pdf["doc_id"], own.batch(pdf["text"].tolist())):
                packer.add(None if pd.isna(doc) else int(doc), ids.astype("<u4").tobytes() + end)
                if packer.size > 16_000_000:
                    yield packer.take()
            if packer.rows:
                yield packer.take()
        packer.pack()
        if packer.rows:
            yield packer.take()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(pack, PIECES)


def ids_crc32(ids: Column) -> Column:
    return F.crc32(ids).cast("long")


def packing_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of op1."""
    pieces = pack_documents(docs)
    return pieces.select("doc_id", "start", "length", ids_crc32(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

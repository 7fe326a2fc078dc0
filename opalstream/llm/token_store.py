"""Token-id files: documents' ids in ascending doc_id order, in independently coded, checksummed blocks.

A shard is a file:

    OPALTOK1
    groups: number of blocks, ids per block (uint32 each); per block: bytes of code, crc32 of its ids
            as little-endian uint32 (uint32 each); then the blocks' codes (range_coder)
    document ids (int64; -2^63 for null), their numbers of ids (int64)
    footer: documents, ids, where the lists start (int64 each), crc32 of the lists (uint32), OPALTOK1

all little-endian.  Ids have up to 32 bits.  The last block of a shard is filled up with its last id.  A group of
at most LANES blocks is held in memory, no more; a damaged block fails its checksum and spoils no other.

Null and empty texts are one end id.  Rows that repeat a doc_id are ordered by a hash of their
texts, null ids come first; very long texts run through as many blocks as they need.  An empty table gives no file, and an
empty table when read.  Other columns of any name are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalstream.llm.common import light_batches, make_dir, new_path
from opalstream.llm.range_coder import decode, encode
from opalstream.llm.tokens import encoder, vocabulary_path

MAGIC = b"OPALTOK1"
NO_ID = -(1 << 63)
LANES, BLOCK, LEAST_BLOCK = 2048, 4096, 1024
FOOTER = struct.Struct("<qqqI8s")


class Damaged(ValueError):
    pass


class Writer:
    """Writes beside the file; close() moves it into place, so that a task run again leaves one whole file."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.beside = f"{self.path}.{os.urandom(6).hex()}"
        self.out = self.fs.open_output_stream(self.beside)
        self.out.write(MAGIC)
        self.parts: list[np.ndarray] = []
        self.held = self.written = self.total = 0
        self.ids, self.lens = [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.lens.append(len(ids))
        self.total += len(ids)
        for at in range(0, len(ids), LANES * BLOCK):
            self.parts.append(ids[at : at + LANES * BLOCK])
            self.held += len(self.parts[-1])
            if self.held >= LANES * BLOCK:
                self._flush(LANES * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        now, self.parts = ids[:n], [ids[n:]]
        self.held = len(self.parts[0])
        # short blocks where there are few ids, so that many lanes go in step
        size = int(min(BLOCK, max(LEAST_BLOCK, -(-len(now) // 256))))
        blocks = np.full((-(-len(now) // size), size), now[-1], "<u4")
        blocks.reshape(-1)[: len(now)] = now
        codes = encode(blocks)
        self.out.write(struct.pack("<II", len(blocks), size))
        self.out.write(b"".join(struct.pack("<II", len(c), zlib.crc32(b.tobytes())) for c, b in zip(codes, blocks)))
        self.out.write(b"".join(codes))
        self.written += 8 + 8 * len(codes) + sum(map(len, codes))

    def close(self) -> None:
        while self.held:
            self._flush(min(self.held, LANES * BLOCK))
        lists = np.array(self.ids, "<i8").tobytes() + np.array(self.lens, "<i8").tobytes()
        self.out.write(lists)
        self.out.write(FOOTER.pack(len(self.ids), self.total, len(MAGIC) + self.written, zlib.crc32(lists), MAGIC))
        self.out.close()
        self.fs.move(self.beside, self.path)


def _decoded(codes: list[bytes], length: int, uri: str) -> np.ndarray:
    try:
        return decode(codes, length).astype("<u4", copy=False)
    except (ValueError, IndexError, struct.error) as e:
        raise Damaged(f"a block's list of ids in {uri} is damaged") from e


def read_file(uri: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the file, ids) of each document, a group of blocks at a time."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_file(path) as f:
        size = f.size()
        f.seek(max(0, size - FOOTER.size))
        docs, total, lists_at, crc, magic = FOOTER.unpack(f.read(FOOTER.size))
        f.seek(0)
        if magic != MAGIC or f.read(8) != MAGIC:
            raise Damaged(f"not a token file: {uri}")
        f.seek(lists_at)
        lists = f.read(16 * docs)
        if zlib.crc32(lists) != crc:
            raise Damaged(f"the document list of {uri} is damaged")
        names, lens = np.frombuffer(lists, "<i8").reshape(2, -1)
        f.seek(8)
        have, held, left, doc, start = [], 0, total, 0, 0
        while True:
            while doc < docs and held >= lens[doc]:
                ids = np.concatenate(have) if len(have) != 1 else have[0]
                at = 0
                while doc < docs and len(ids) - at >= lens[doc]:
                    n = int(lens[doc])
                    yield None if names[doc] == NO_ID else int(names[doc]), start, ids[at : at + n]
                    at, start, doc = at + n, start + n, doc + 1
                have, held = [ids[at:]], len(ids) - at
            if doc == docs:
                return
            blocks, length = struct.unpack("<II", f.read(8))
            heads = np.frombuffer(f.read(8 * blocks), "<u4").reshape(-1, 2)
            got = _decoded([f.read(int(n)) for n in heads[:, 0]], length, uri)
            for k, row in enumerate(got):
                if zlib.crc32(row.tobytes()) != heads[k, 1]:
                    raise Damaged(f"block {k} of {uri} is damaged")
            have.append(got.reshape(-1)[:left])
            held, left = held + len(have[-1]), left - len(have[-1])


@dataclass(frozen=True)
class Shard:
    file: str
    start: int  # ids in the shards before
    docs: int
    ids: int


def write_tokens(docs: DataFrame, folder: str, end_id: int = 2, vocabulary: str | None = None) -> list[Shard]:
    """Writes the files, by ranges of doc_id; the driver gets a row per file."""
    light_batches(docs.sparkSession)
    path, end = vocabulary or vocabulary_path(), np.uint32(end_id)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, writer, part = encoder(path), None, TaskContext.get().partitionId()
        file = f"{folder}/tokens-{part:06d}.opt"
        for pdf in batches:
            for doc, ids in zip(pdf["doc_id"], own.batch(pdf["text"].tolist())):
                writer = writer or Writer(file)
                writer.add(None if pd.isna(doc) else int(doc), np.append(ids, end))
        if writer:
            writer.close()
            yield pd.DataFrame({"part": [part], "file": [file], "docs": [len(writer.ids)], "ids": [writer.total]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.hash("text")).sortWithinPartitions("doc_id", F.hash("text"), "text")
    out, start = [], 0
    for r in sorted(rows.mapInPandas(write, "part int, file string, docs long, ids long").collect()):
        out.append(Shard(r["file"], start, r["docs"], r["ids"]))
        start += r["ids"]
    return out


def read_tokens(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    """One row per document: doc_id, start, ids (little-endian uint32), a task per file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"]:
                rows, size = [], 0
                for doc, start, ids in read_file(shards[i].file):
                    rows.append((doc, shards[i].start + start, ids.astype("<u4").tobytes()))
                    size += 4 * len(ids)
                    if size > 16_000_000:
                        yield pd.DataFrame(rows, columns=["doc_id", "start", "ids"]).astype({"doc_id": "Int64"})
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "start", "ids"]).astype({"doc_id": "Int64"})

    n = len(shards)
    return spark.range(0, n, 1, max(n, 1)).mapInPandas(read, "doc_id long, start long, ids binary")


def check_tokens(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    """One row per document, as read back: doc_id, start, n_tokens, ids_crc32; the ids themselves stay where they are read."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"]:
                each = ((doc, shards[i].start + start, len(ids), zlib.crc32(ids.astype("<u4", copy=False))) for doc, start, ids in read_file(shards[i].file))
                while rows := list(islice(each, 10_000)):
                    yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    n = len(shards)
    return spark.range(0, n, 1, max(n, 1)).mapInPandas(check, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of op3, from the files read back."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    make_dir(spark, folder)
    return check_tokens(spark, write_tokens(docs, folder))

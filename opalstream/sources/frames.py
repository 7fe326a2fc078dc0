"""Binary frames and record logs: codecs for foreachBatch writers and readers, and replay."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = struct.Struct(">4sBBHI")
MAGIC, VERSION, ZSTD = b"OPLF", 1, 1


class FrameError(ValueError):
    pass


def encode_frame(payload: bytes, threshold: int = 4096, most: int = 262_144) -> bytes:
    """Header (magic, flags, version, two zero bytes, payload size) and payload, compressed from `threshold` on."""
    if len(payload) > most:
        raise FrameError("payload too large")
    if len(payload) < threshold:
        return HEADER.pack(MAGIC, 0, VERSION, 0, len(payload)) + payload
    import zstandard

    return HEADER.pack(MAGIC, ZSTD, VERSION, 0, len(payload)) + zstandard.ZstdCompressor(level=1).compress(payload)


def decode_frame(frame: bytes, most: int = 262_144) -> bytes:
    if len(frame) < HEADER.size:
        raise FrameError("short frame")
    magic, flags, version, zero, size = HEADER.unpack_from(frame)
    if magic != MAGIC or version != VERSION or zero or flags & ~ZSTD or size > most:
        raise FrameError("bad header")
    body = frame[HEADER.size :]
    if flags & ZSTD:
        import zstandard

        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=most)
    if len(body) != size:
        raise FrameError("size differs")
    return body


def varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise FrameError("bad varint")
        b = data[at]
        at, n, shift = at + 1, n | (b & 0x7F) << shift, shift + 7
        if b < 0x80:
            return n, at


def fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of each field of an encoded message."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            raise FrameError("unknown wire type")
        if at > len(data):
            raise FrameError("field beyond the end")
        yield key >> 3, kind, value


def max_sequence(payload: bytes, events_field: int = 4, sequence_field: int = 1) -> int | None:
    """The largest event sequence of a batch; nothing else of it is decoded."""
    best = None
    for number, kind, value in fields(payload):
        if number == events_field and kind == 2:
            for n, k, v in fields(value):
                if n == sequence_field and k == 0:
                    best = v if best is None else max(best, v)
    return best


def frame_column(payload: Column, threshold: int = 4096) -> Column:
    @F.pandas_udf("binary")
    def encode(x: pd.Series) -> pd.Series:
        return x.map(lambda p: None if p is None else encode_frame(bytes(p), threshold))

    return encode(payload)


def payload_column(frame: Column) -> Column:
    """Null for frames that can't be read."""

    def one(x):
        try:
            return None if x is None else decode_frame(bytes(x))
        except FrameError:
            return None

    @F.pandas_udf("binary")
    def decode(x: pd.Series) -> pd.Series:
        return x.map(one)

    return decode(frame)


def replay_after(frames: DataFrame, after: int, floor: DataFrame) -> DataFrame:
    """Frames whose last sequence is beyond `after`, with lagged: the reader is behind what is still kept."""
    lagged = (F.lit(after) > 0) & (F.lit(after) < F.col("replay_floor"))
    return frames.filter(F.col("last_sequence") > after).crossJoin(F.broadcast(floor)).withColumn("lagged", lagged).drop("replay_floor")  # one row


def encode_records(records: list[bytes], magic: bytes = b"OPLW") -> bytes:
    return magic + b"".join(struct.pack("<II", len(r), zlib.crc32(r)) + r for r in records)


def decode_records(data: bytes, keep: int, magic: bytes = b"OPLW", most: int = 1 << 20) -> list[bytes]:
    """The last `keep` records; reading ends at a record that is cut off, too large or damaged."""
    if data[:4] != magic:
        return []
    out, at = [], 4
    while at + 8 <= len(data):
        size, crc = struct.unpack_from("<II", data, at)
        body = data[at + 8 : at + 8 + size]
        if size > most or len(body) < size or zlib.crc32(body) != crc:
            break
        out.append(body)
        at += 8 + size
    return out[-keep:]

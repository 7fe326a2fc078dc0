"""Keccak-256 and 256-bit numbers: what the JVM has no function for, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_U = np.uint64


def _constants() -> tuple[list[int], list[list[int]]]:
    """Round constants by the algorithm's shift register, rotations by its walk over the lanes."""
    rounds, r = [], 1
    for _ in range(24):
        c = 0
        for j in range(7):
            if r & 1:
                c ^= 1 << ((1 << j) - 1)
            r = (r << 1) ^ (0x171 if r & 0x80 else 0)
        rounds.append(c)
    turn, x, y = [[0] * 5 for _ in range(5)], 1, 0
    for t in range(24):
        turn[x][y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return rounds, turn


_ROUNDS, _TURN = _constants()


def _rotate(v: np.ndarray, n: int) -> np.ndarray:
    return v if n == 0 else (v << _U(n)) | (v >> _U(64 - n))


def _permute(s: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    for c in _ROUNDS:
        col = [s[x][0] ^ s[x][1] ^ s[x][2] ^ s[x][3] ^ s[x][4] for x in range(5)]
        d = [col[x - 1] ^ _rotate(col[(x + 1) % 5], 1) for x in range(5)]
        b = [[None] * 5 for _ in range(5)]
        for x in range(5):
            for y in range(5):
                b[y][(2 * x + 3 * y) % 5] = _rotate(s[x][y] ^ d[x], _TURN[x][y])
        s = [[b[x][y] ^ (~b[(x + 1) % 5][y] & b[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
        s[0][0] = s[0][0] ^ _U(c)
    return s


def keccak256_many(messages: list[bytes]) -> list[bytes]:
    """Messages of the same number of blocks go through the permutation together."""
    out: list[bytes] = [b""] * len(messages)
    by: dict[int, list[int]] = {}
    for i, m in enumerate(messages):
        by.setdefault(len(m) // 136, []).append(i)
    for blocks, where in by.items():
        padded = bytearray()
        for i in where:
            m = messages[i] + b"\x01" + bytes(136 * (blocks + 1) - len(messages[i]) - 1)
            padded += m[:-1] + bytes([m[-1] | 0x80])
        words = np.frombuffer(bytes(padded), "<u8").reshape(len(where), blocks + 1, 17).astype(_U)
        s = [[np.zeros(len(where), _U) for _ in range(5)] for _ in range(5)]
        for k in range(blocks + 1):
            for i in range(17):
                s[i % 5][i // 5] = s[i % 5][i // 5] ^ words[:, k, i]
            s = _permute(s)
        digest = np.stack([s[i][0] for i in range(4)], axis=1).astype("<u8")
        for j, i in enumerate(where):
            out[i] = digest[j].tobytes()
    return out


@F.pandas_udf(T.BinaryType())
def _keccak(x: pd.Series) -> pd.Series:
    known = x.notna().to_numpy()
    out = pd.Series([None] * len(x), dtype=object, index=x.index)
    out[known] = keccak256_many([bytes(v) for v in x[known]])
    return out


def keccak256(x: Column) -> Column:
    return _keccak(x.cast("binary"))


def question_id(ancillary: Column) -> Column:
    return keccak256(ancillary)


def condition_id(oracle: Column, question: Column, slots: int = 2) -> Column:
    """Hash of an oracle's 20 bytes, the question's 32 and the number of outcome slots."""
    return keccak256(F.concat(oracle, question, F.unhex(F.lit(f"{slots:064x}"))))


@F.pandas_udf(T.StringType())
def u256_text(x: pd.Series) -> pd.Series:
    """Decimal text of big-endian bytes."""
    return x.map(lambda v: None if v is None else str(int.from_bytes(v, "big")))


@F.pandas_udf(T.StringType())
def i256_text(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else str(int.from_bytes(v, "big", signed=True)))


def parse_u256(text: str | None) -> bytes | None:
    if text is None or not text.isascii() or not text.isdigit():
        return None
    n = int(text)
    return n.to_bytes(32, "big") if n < 1 << 256 else None


@F.pandas_udf(T.BinaryType())
def u256_bytes(x: pd.Series) -> pd.Series:
    """32 bytes of decimal text; null for other text and above 2^256 - 1."""
    return x.map(parse_u256)


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def u256_list(x: pd.Series) -> pd.Series:
    """As u256_bytes for each entry of a list."""
    return x.map(lambda v: None if v is None else [parse_u256(t) for t in v])

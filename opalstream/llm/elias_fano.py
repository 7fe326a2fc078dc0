"""Elias-Fano sequences and the levels of an n-gram trie, over memory-mapped files."""

from __future__ import annotations

import json
import os
from urllib.parse import urlparse

import numpy as np

U = np.uint64
_ONE, _ALL = U(1), U(0xFFFFFFFFFFFFFFFF)
_B1, _B7, _L1 = U(0x0101010101010101), U(0x8080808080808080), U(0x5555555555555555)
_L2, _L4 = U(0x3333333333333333), U(0x0F0F0F0F0F0F0F0F)
#: Position of the r-th one of a byte, at byte * 8 + r.
_IN_BYTE = np.array([([i for i in range(8) if x >> i & 1] + [0] * 8)[r] for x in range(256) for r in range(8)], np.uint8)


def _select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th (from 0) one of each word: by its bytes' running counts, then within a byte."""
    c = word - (word >> _ONE & _L1)
    c = (c & _L2) + (c >> U(2) & _L2)
    c = (c + (c >> U(4)) & _L4) * _B1  # byte i: ones in bytes 0 to i
    rank = r.astype(U)
    byte = np.bitwise_count(((rank * _B1 | _B7) - c) & _B7).astype(U) << U(3)  # eight times the bytes with no more ones than r
    before = (c << U(8)) >> byte & U(0xFF)
    return (byte + _IN_BYTE[((word >> byte & U(0xFF)) << U(3) | rank - before).astype(np.int64)]).astype(np.int64)


class EliasFano:
    """A sequence of whole numbers, none smaller than the one before: about 2 + log2(range / n) bits each."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.l, self.first, self.last = (int(x) for x in arrays[f"{name}.head"])
        self.low, self.up, self.ranks = (arrays[f"{name}.{k}"] for k in ("low", "up", "ranks"))
        self.zeros = np.arange(len(self.ranks), dtype=np.int64) * 64 - self.ranks  # before each word
        self.mask = U((1 << self.l) - 1)

    @staticmethod
    def build(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        n = len(values)
        first, last = (int(values[0]), int(values[-1])) if n else (0, 0)
        l = max(0, ((last - first + 1) // max(n, 1)).bit_length() - 1)
        x = values.astype(U) - U(first)
        up = np.zeros((n + int(x[-1] >> U(l) if n else 0) + 1) // 64 + 1, U)
        at = (x >> U(l)).astype(np.int64) + np.arange(n)
        np.bitwise_or.at(up, at >> 6, U(1) << (at & 63).astype(U))
        low = np.zeros((n * l + 63) // 64 + 1, U)
        if l:
            bits, v = np.arange(n, dtype=np.int64) * l, x & U((1 << l) - 1)
            shift = (bits & 63).astype(U)
            np.bitwise_or.at(low, bits >> 6, v << shift)
            over = (bits & 63) + l > 64
            np.bitwise_or.at(low, (bits[over] >> 6) + 1, v[over] >> (U(64) - shift[over]))
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(up), dtype=np.int64)[:-1]]).astype(np.int64 if n >= 1 << 31 else np.int32)
        return {f"{name}.head": np.array([n, l, first, last], np.int64), f"{name}.low": low, f"{name}.up": up, f"{name}.ranks": ranks}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), U)
        bit = i * self.l
        word, shift = bit >> 6, (bit & 63).astype(U)
        v = self.low[word] >> shift
        over = (bit & 63) + self.l > 64
        if over.any():
            v = np.where(over, v | self.low[np.minimum(word + 1, len(self.low) - 1)] << (U(63) - np.minimum(shift, U(63))) << U(1), v)
        return v & self.mask

    def _zero(self, k: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.zeros, k, side="right") - 1
        return w * 64 + _select_in_word(~self.up[w], k - self.zeros[w])

    def _next(self, at: np.ndarray, ones: bool) -> np.ndarray:
        """The first one (zero) after each place."""
        out, w = np.empty(len(at), np.int64), at >> 6
        word = self.up[w] if ones else ~self.up[w]
        word &= (_ALL << (at & 63).astype(U)) << _ONE
        open_ = np.flatnonzero(word == 0)
        while len(open_):  # mostly none: places are two apart
            w[open_] += 1
            word[open_] = self.up[w[open_]] if ones else ~self.up[w[open_]]
            open_ = open_[word[open_] == 0]
        low = word & (~word + _ONE)
        np.add(w << 6, np.bitwise_count(low - _ONE), out=out)
        return out

    def _value(self, at: np.ndarray, i: np.ndarray) -> np.ndarray:
        return (((at - i).astype(U) << U(self.l)) | self._low(i)).astype(np.int64) + self.first

    def _place(self, i: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.ranks, i, side="right") - 1
        return w * 64 + _select_in_word(self.up[w], i - self.ranks[w])

    def access(self, i: np.ndarray) -> np.ndarray:
        return self._value(self._place(i), i)

    def access_both(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at i and at i + 1."""
        at = self._place(i)
        return self._value(at, i), self._value(self._next(at, True), i + 1)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x, -1 where it isn't there: the successor within the bucket of x's high bits."""
        out = np.full(len(x), -1, np.int64)
        ok = np.flatnonzero((x >= self.first) & (x <= self.last)) if self.n else np.zeros(0, np.int64)
        if not len(ok):
            return out
        y = (x[ok] - self.first).astype(U)
        h, key = (y >> U(self.l)).astype(np.int64), y & self.mask
        at = np.full(len(h), -1, np.int64)  # of the zero before the bucket
        later = np.flatnonzero(h > 0)
        at[later] = self._zero(h[later] - 1)
        end = np.empty(len(h), np.int64)
        end[later] = self._next(at[later], False)
        if len(later) < len(h):
            end[h == 0] = self._zero(np.zeros(1, np.int64))[0]
        lo, end = at + 1 - h, end - h
        hi, open_ = end.copy(), np.flatnonzero(lo < end)
        found = np.full(len(h), -1, np.int64)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            low, want = self._low(mid), key[open_]
            hit = low == want
            found[open_[hit]] = mid[hit]
            less = low < want
            lo[open_[less]] = mid[less] + 1
            more = ~less
            hi[open_[more]] = mid[more]
            open_ = open_[~hit]
            open_ = open_[lo[open_] < hi[open_]]
        out[ok] = found
        return out


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """A header, then the arrays at multiples of 8 bytes, for memory mapping."""
    at, head, body = 0, {}, []
    for k, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[k] = [a.dtype.str, len(a), at]
        raw += bytes(-len(raw) % 8)
        body.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return b"".join([b"OPALTRIE", len(text).to_bytes(8, "little"), text, *body])


def mappable(uri: str) -> bool:
    return urlparse(uri).scheme in ("", "file")


def load(uri: str) -> dict[str, np.ndarray]:
    """A file's arrays: mapped into memory, or read from a store that can't be mapped."""
    raw = np.memmap(urlparse(uri).path, np.uint8, "r") if mappable(uri) else np.frombuffer(read_file(uri), np.uint8)
    if bytes(raw[:8]) != b"OPALTRIE":
        raise ValueError(f"not a trie level: {uri}")
    n = int.from_bytes(bytes(raw[8:16]), "little")
    head = json.loads(bytes(raw[16 : 16 + n]))
    return {k: raw[16 + n + at : 16 + n + at + size * np.dtype(t).itemsize].view(t) for k, (t, size, at) in head.items()}


def write_file(uri: str, data: bytes) -> None:
    """Written beside and moved, so that a task run twice leaves one whole file."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    beside = f"{path}.{os.urandom(6).hex()}"
    with where.open_output_stream(beside) as f:
        f.write(data)
    where.move(beside, path)


def read_file(uri: str) -> bytes:
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_stream(path) as f:
        return f.read()


CODE = 2048  # steps of a quantised logarithm to a factor of 2


def quantise(x: np.ndarray) -> np.ndarray:
    """Shares of 1 to 16 bits: code c stands for 2^(-c / CODE), the last code for 0."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.rint(-np.log2(np.minimum(x, 1)) * CODE), 65535).astype(np.uint16)


def unquantise(c: np.ndarray) -> np.ndarray:
    return np.where(c == 65535, 0.0, np.exp2(c.astype(np.float64) / -CODE))


class Counts:
    """Whole numbers, most of them small: a byte each, those from 255 on in a list of their own."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.bytes, self.at, self.large = (arrays[f"{name}.{k}"] for k in ("bytes", "at", "large"))

    @staticmethod
    def build(c: np.ndarray, name: str) -> dict[str, np.ndarray]:
        at = np.flatnonzero(c >= 255)
        return {f"{name}.bytes": np.minimum(c, 255).astype(np.uint8), f"{name}.at": at.astype(np.int64), f"{name}.large": c[at].astype(np.int64)}

    def of(self, i: np.ndarray) -> np.ndarray:
        out = self.bytes[i].astype(np.int64)
        large = np.flatnonzero(out == 255)
        out[large] = self.large[np.searchsorted(self.at, i[large])]
        return out


def _bits(parent: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    """A child's place in its level's table of so many bits."""
    h = (parent.astype(U) * U(0x9E3779B97F4A7C15) ^ word.astype(U)) * U(0xC2B2AE3D27D4EB4F)
    return ((h >> U(32)) * U(size) >> U(32)).astype(np.int64)


class Level:
    """A shard of a trie level: the children of a range of nodes.

    parents: the nodes' numbers; pointers: where each one's children start; ids: the children's word
    ids, each node's raised above those of the node before, so that all three are monotone.  A table of
    eight bits a child turns away most of those that aren't there before the search.
    """

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.parents, self.pointers, self.ids = (EliasFano(arrays, k) for k in ("parents", "pointers", "ids"))
        self.share, self.backoff, self.table = arrays["share"], arrays["backoff"], arrays["table"]
        self.counts = Counts(arrays, "counts") if "counts.bytes" in arrays else None

    @staticmethod
    def build(parent: np.ndarray, word: np.ndarray, share: np.ndarray, backoff: np.ndarray) -> dict[str, np.ndarray]:
        """Rows sorted by parent, then word; backoff is the parent's."""
        start = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(parent) else np.zeros(0, np.int64)
        ends = np.concatenate([start[1:], [len(parent)]]) if len(parent) else start
        base = np.concatenate([[0], np.cumsum(word[ends - 1] + 1)[:-1]]) if len(parent) else start
        ids = word + np.repeat(base, ends - start)
        table = np.zeros(max(8, len(parent)), np.uint8)  # at most 2^29 children in a shard
        at = _bits(parent, word, 8 * len(table))
        np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        out = EliasFano.build(parent[start], "parents") | EliasFano.build(np.concatenate([start, [len(parent)]]), "pointers") | EliasFano.build(ids, "ids")
        return out | {"share": quantise(share), "backoff": quantise(backoff[start]), "table": table}

    def find(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index of each child, -1 where there is none: a successor search relative to its context.  Sorted by parent."""
        return self._search(parent, word, np.arange(len(parent)), None)

    def look(self, parent: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As find, and each one's parent, -1 where it has no children here."""
        first = np.concatenate([[True], parent[1:] != parent[:-1]])
        k = self.parents.find(parent[first])[np.cumsum(first) - 1]
        return self._search(parent, word, np.flatnonzero(k >= 0), k), k

    def _search(self, parent: np.ndarray, word: np.ndarray, some: np.ndarray, k: np.ndarray | None) -> np.ndarray:
        out = np.full(len(parent), -1, np.int64)
        bit = _bits(parent[some], word[some], 8 * len(self.table))
        may = some[np.flatnonzero(self.table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)]
        if not len(may):
            return out
        parent, word = parent[may], word[may]
        first = np.concatenate([[True], parent[1:] != parent[:-1]])
        of = np.cumsum(first) - 1
        k = self.parents.find(parent[first]) if k is None else k[may][first]
        there = np.maximum(k, 0)
        begin, end = self.pointers.access_both(there)
        base = np.where(begin > 0, self.ids.access(np.maximum(begin - 1, 0)) + 1, 0)
        ok = np.flatnonzero(k[of] >= 0)
        of = of[ok]
        i = self.ids.find(base[of] + word[ok])
        out[may[ok]] = np.where((i >= begin[of]) & (i < end[of]), i, -1)
        return out


class Sharded:
    """Shards by range of key; opened when first asked.  Of files that can't be mapped the last HELD are kept."""

    HELD = 16

    def __init__(self, shards: list[tuple[int, int, str]], kind):
        """shards: first key, number of the first entry, file; in order."""
        self.firsts = np.array([s[0] for s in shards], np.int64)
        self.bases = np.array([s[1] for s in shards], np.int64)
        self.files, self.kind, self.opened = [s[2] for s in shards], kind, {}

    def shard(self, i: int):
        if i not in self.opened:
            if not mappable(self.files[i]) and len(self.opened) >= self.HELD:
                del self.opened[next(iter(self.opened))]
            self.opened[i] = self.kind(load(self.files[i]))
        return self.opened[i]

    def where(self, keys: np.ndarray) -> np.ndarray:
        """Each key's shard, -1 before the first."""
        return np.searchsorted(self.firsts, keys, side="right") - 1

    def each(self, keys: np.ndarray):
        """(shard, its base, the slice of its keys) for sorted keys."""
        edges = [*np.searchsorted(keys, self.firsts).tolist(), len(keys)]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                yield self.shard(i), int(self.bases[i]), slice(a, b)

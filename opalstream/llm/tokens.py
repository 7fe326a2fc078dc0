"""Token ids by the tokenizers library, with a bounded memo of chunks, for many texts at a time.

Byte-level BPE never joins across pre-tokens, and no pre-token reaches over a space or line end that
follows another character than white space, nor from an ASCII letter, digit or mark to one of another of
these classes.  So a text is cut there into chunks, each distinct chunk is encoded by the library's model
once and remembered, and a text's ids are those of its chunks one after the other.  Chunks are found, hashed
and looked up in NumPy over a batch's bytes, with no object made per word; two chunks of equal 64-bit hash
are taken for the same (among LIMIT remembered chunks: a chance of 4e-8).  A full memo keeps those that
were met again.  The pattern that cuts a chunk into pre-tokens is the vocabulary's own for texts of known letters;
any text that holds a character outside that range, or an added token's string, is encoded whole by the
library.
"""

from __future__ import annotations

import functools
import os
import re
from codecs import charmap_decode
from collections.abc import Sequence
from itertools import chain
from operator import attrgetter

import numpy as np
import pandas as pd

VOCABULARY = "byte_bpe_50k.json"
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ƺƼ-ƿǄ-ʓ"
NUMBERS = "0-9²³¹¼½¾"
PRETOKEN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
#: Characters whose classes the pattern gets right: the controls that both sides call white space, printable Latin, and some marks.
KNOWN = re.compile(r"[\t\n\r\x20-\x7e\xa0-ƺƼ-ƿǄ-ʓ‐-‧‰-⁞₠-₿]*")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The byte-level vocabulary's letter for each byte: printable Latin-1 is itself, the others follow from 256 on."""
    same = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in same)
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """A byte's kind, and by two bytes' kinds whether a chunk may begin at the second."""
    other, letter, digit, mark, apostrophe, space, line, white = range(8)
    kind = np.full(256, mark, np.uint8)
    kind[128:] = other  # parts of wider characters, of any class
    kind[[9, 13]], kind[10], kind[32], kind[ord("'")] = white, line, space, apostrophe
    for c in range(128):
        kind[c] = letter if chr(c).isalpha() else digit if chr(c).isdigit() else kind[c]
    cuts = np.zeros((8, 8), bool)
    for x in (other, letter, digit, mark, apostrophe):
        cuts[x, [space, line]] = True  # white space after anything else
    for x in (letter, digit, mark):
        for y in (letter, digit, mark, apostrophe):
            cuts[x, y] = x != y and not (x == mark and y == apostrophe)
    return kind, cuts.ravel()


_KIND, _CUTS = (x.astype(np.uint8).tobytes().ljust(256, b"\0") for x in _kinds())  # as tables for bytes.translate
_BYTES = np.random.default_rng(77).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


_ID = attrgetter("id")


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1 ... of each run, end to end."""
    at = np.repeat(first - (np.cumsum(size, dtype=np.int64) - size), size)
    at += np.arange(len(at))
    return at


#: A place where a long text may be cut: before a space after a letter.
_SAFE = re.compile(rb"[A-Za-z.,] ")


class Powers:
    """Powers of the hash's base and of its inverse, as far as asked for; kept up to KEEP."""

    KEEP = 1 << 21

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up, self.down
        tables = []
        for base in (_BASE, _BACK):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            tables.append(np.cumprod(x))
        if n <= self.KEEP:
            self.up, self.down = tables
        return tables[0], tables[1]


class Encoder:
    BITS, LIMIT, MOST_IDS, PORTION = 21, 1_200_000, 8_000_000, 1 << 20

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, "".join(c for _, c in sorted(byte_letters().items()))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.powers = Powers()
        self._forget()

    def _forget(self) -> None:
        """The memo: an open hash table of chunks' hashes and entries; an entry is a run of `ids`."""
        self.keys, self.entry = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
        self.first, self.size, self.again = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(1024, bool)
        self.ids, self.used, self.kept = np.zeros(4096, np.uint32), 0, 0

    def _forget_rare(self) -> None:
        """Keeps the chunks that a later portion than their first had, too, if that makes room enough."""
        slots = np.flatnonzero(self.entry >= 0)
        slots = slots[self.again[self.entry[slots]]]
        h, old = self.keys[slots], self.entry[slots]
        size = self.size[old]
        ids = self.ids[_runs(self.first[old], size)]
        self._forget()
        if len(h) <= self.LIMIT // 2 and len(ids) <= self.MOST_IDS // 2:
            self._keep(h, size, ids)

    def _keep(self, h: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Entries of new, distinct hashes, by their runs' sizes and the runs end to end."""
        k, n, used = self.kept, len(h), self.used + len(ids)
        if k + n > len(self.first):
            self.first, self.size, self.again = (np.resize(x, 2 * (k + n)) for x in (self.first, self.size, self.again))
        if used > len(self.ids):
            self.ids = np.resize(self.ids, 2 * used)
        self.ids[self.used : used] = ids
        self.size[k : k + n], self.first[k : k + n], self.again[k : k + n] = size, self.used + np.cumsum(size) - size, False
        entries, at, open_ = np.arange(k, k + n, dtype=np.int32), self._slot(h), np.arange(n)
        while len(open_):
            free = open_[self.entry[at[open_]] < 0]
            self.entry[at[free]] = entries[free]  # of several that want a slot one gets it
            mine = self.entry[at[open_]] == entries[open_]
            got, open_ = open_[mine], open_[~mine]
            self.keys[at[got]] = h[got]
            at[open_] = at[open_] + 1 & len(self.keys) - 1
        self.used, self.kept = used, k + n
        return entries

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """Entries of hashes, -1 where there is none."""
        at = self._slot(h)
        out = self.entry[at]
        other = np.flatnonzero((self.keys[at] != h) & (out >= 0))
        while len(other):
            at[other] = at[other] + 1 & len(self.keys) - 1
            out[other] = self.entry[at[other]]
            other = other[(self.keys[at[other]] != h[other]) & (out[other] >= 0)]
        return out

    def _of_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each has, and all ids end to end."""
        out, tokenize, letters, space = [], self.model.tokenize, self.letters, self.letters[32]
        spelled = lambda b: charmap_decode(b, "strict", letters)[0]
        for chunk in chunks:
            word = chunk[1:] if chunk[0] == 32 else chunk
            if word.isalpha() or word.isdigit():  # ASCII, one pre-token; its bytes are their own letters
                out.append(list(map(_ID, tokenize(space + word.decode() if word is not chunk else word.decode()))))
            elif word.decode().isalpha():
                out.append(list(map(_ID, tokenize(spelled(chunk)))))
            else:
                pieces = PRETOKEN.findall(chunk.decode())
                out.append([t.id for p in pieces for t in tokenize(spelled(p.encode()))])
        size = np.fromiter(map(len, out), np.int32, len(out))
        return size, np.fromiter(chain.from_iterable(out), np.uint32, int(size.sum()))

    def _portion(self, raw: bytes, ends: np.ndarray) -> list[np.ndarray]:
        """The ids of texts of known letters, none empty, laid end to end."""
        a, firsts = np.frombuffer(raw, np.uint8), np.concatenate([[0], ends[:-1]])
        kind = np.frombuffer(raw.translate(_KIND), np.uint8)
        new = np.frombuffer((kind[:-1] * np.uint8(8) + kind[1:]).tobytes().translate(_CUTS), bool).copy()
        wide = np.flatnonzero(new & (a[:-1] == 0xA0))  # the last byte of a no-break space, or of a letter
        new[wide] = a[np.maximum(wide - 1, 0)] != 0xC2
        new = np.concatenate([[True], new])
        new[firsts] = True
        start = np.flatnonzero(new)
        width = np.diff(start, append=len(a))
        up, down = self.powers.of(len(a))
        h = (np.add.reduceat(_BYTES[a] * up[: len(a)], start) * down[start] ^ width.astype(np.uint64)) * _BASE
        if self.kept > self.LIMIT or self.used > self.MOST_IDS:
            self._forget_rare()
        entry = self._look_up(h)
        missing = np.flatnonzero(entry < 0)
        self.again[entry] = True  # -1 marks the last place, which costs nothing but room
        if len(missing):
            codes, u = pd.factorize(h[missing])
            some = np.empty(len(u), np.int64)
            some[codes] = missing
            if self.kept + len(u) > len(self.keys) // 4 * 3:
                self.BITS += 1  # one portion of more new chunks than the table holds
                self._forget()
                return self._portion(raw, ends)
            runs = self._of_chunks([raw[i:j] for i, j in zip(start[some].tolist(), (start[some] + width[some]).tolist())])
            entry[missing] = self._keep(u, *runs)[codes]
        size = self.size[entry]
        total = np.cumsum(size, dtype=np.int64)
        return np.split(self.ids[_runs(self.first[entry], size)], total[np.searchsorted(start, ends[:-1]) - 1])

    def batch(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Each text's ids (uint32); null is as empty."""
        out: list = [[] for _ in texts]
        parts, owners, held = [], [], 0

        def flush() -> None:
            nonlocal parts, owners, held
            if parts:
                for i, ids in zip(owners, self._portion(b"".join(parts), np.cumsum([len(p) for p in parts]))):
                    out[i].append(ids)
            parts, owners, held = [], [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if KNOWN.fullmatch(text) is None or any(a in text for a in self.added):
                out[i].append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            raw, at = text.encode(), 0
            while len(raw) - at > self.PORTION and (m := _SAFE.search(raw, at + self.PORTION // 2)):
                parts, owners, held = [*parts, raw[at : m.end() - 1]], [*owners, i], held + m.end() - 1 - at
                at = m.end() - 1
                flush()
            parts.append(raw[at:])
            owners.append(i)
            held += len(raw) - at
            if held >= self.PORTION:
                flush()
        flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]

    def packed(self, text: str | None) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return self.batch([text])[0].astype("<u4").tobytes()


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The Python worker's, with what it remembers of tasks before."""
    return Encoder(path)

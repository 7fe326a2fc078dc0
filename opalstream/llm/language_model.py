"""LM scoring with an Elias-Fano n-gram trie.

Training tokens are lower-cased words and one end per document.  Every word's count is exact, for all
words of the training documents; they are kept in sorted shards, and every word has an id.  N-grams of
two and three words are counted over all training documents and all are kept, those seen once too.  A
caller may set min_count to keep fewer; an n-gram that is kept then consists of shorter ones that are.
Shares are discounted, (c - discount) / c(context), and what a context's kept children leave goes to the
next lower order: P(w|uv) = share(uvw) + backoff(uv) * (share(vw) + backoff(v) * P(w)), and
P(w) = (c + 0.1) / (N + 0.1 * (V + 1)), the base.  A level's shard holds its nodes as Elias-Fano
sequences with 16-bit quantised shares and backoffs; shards are files in the shared folder that
workers map into memory, opened when first asked, so neither the model nor a shard is sent through
the driver, which gets one row per shard.  Word hashes are 63 bits wide.

Texts are read twice, to count words and to number them; the numbers (32 bits a token, rare words with their
counts) are written, and n-grams are counted and texts scored from them.  N-grams go once through a shuffle,
as sorted blocks of keys and counts, straight to the task that adds them up and writes their shard.  A
sample of keys says only where shards are cut; scores don't depend on it.

Null and empty texts are one end.  A repeated row counts as often as it occurs.  A null doc_id is not
held out.  With an empty table, or no training row, N and V are 0 and an empty one comes back, or base
scores of no counts.  Other columns of any name are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalstream.llm.common import Tables, make_dir, mix, new_path
from opalstream.llm.elias_fano import Counts, EliasFano, Level, Sharded, dump, quantise, unquantise, write_file


@dataclass(frozen=True)
class Settings:
    min_count: int = 1  # more drops rarer n-grams and the ids of rarer words
    discount: float = 0.75
    add: float = 0.1
    words_at_once: int = 1_000_000
    shard_rows: int = 1_500_000


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Random 64-bit numbers for each byte at each of 64 places in a word; a word's hash is their sum.
_PLACES = mix(np.arange(64 * 256, dtype=np.uint64) + np.uint64(12345))
_END_BYTE = b"\xff"  # not in any UTF-8 text: stands for a document's end


def hash_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of a text's words and which of them are ends; by bytes, with no object made per word."""
    a = np.frombuffer(text, np.uint8)
    word = ~_SPACE[a]
    at = np.flatnonzero(word)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    new = np.concatenate([[True], np.diff(at) > 1])
    first = np.flatnonzero(new)
    sizes = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, sizes)
    values = _PLACES[(place & 63) * 256 + a[at]]
    if sizes.max() > 64:
        values = values * ((place >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    h = mix(np.add.reduceat(values, first) ^ (sizes.astype(np.uint64) << np.uint64(40)))
    return (h >> np.uint64(1)).astype(np.int64), a[at[first]] == 0xFF


def _chunks(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids of documents, hashes of their tokens end to end, where each document ends), about `most` tokens at a time."""
    ids, parts, size = [], [], 0

    def out():
        h, end = hash_words(b" ".join(parts))
        return ids, h, np.flatnonzero(end) + 1

    for pdf in batches:
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            ids.append(None if pd.isna(doc) else int(doc))
            parts += [(text or "").encode("utf-8", "surrogatepass").lower(), _END_BYTE]
            size += len(parts[-2]) + 6
            if size >= 6 * most:
                yield out()
                ids, parts, size = [], [], 0
    if ids:
        yield out()


def distinct(x: np.ndarray, many: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and each one's place among them; by hashing, unless many of them differ."""
    if many and len(x):
        order = np.argsort(x)
        x = x[order]
        new = np.concatenate([[True], x[1:] != x[:-1]])
        back = np.empty(len(x), np.int64)
        back[order] = np.cumsum(new) - 1
        return x[new], back
    codes, u = pd.factorize(x)
    order = np.argsort(u)
    place = np.empty(len(u), np.int64)
    place[order] = np.arange(len(u))
    return u[order], place[codes]


def counted(x: np.ndarray) -> pd.DataFrame:
    codes, u = pd.factorize(x)
    return pd.DataFrame({"k": u, "c": np.bincount(codes, minlength=len(u))})


class Words:
    """A shard of the vocabulary: words seen min_count times or more have ids, in order of hash."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.often, self.rare = EliasFano(arrays, "often"), EliasFano(arrays, "rare")
        self.counts, self.rare_counts = Counts(arrays, "often_counts"), Counts(arrays, "rare_counts")

    @staticmethod
    def build(h: np.ndarray, c: np.ndarray, least: int) -> dict[str, np.ndarray]:
        often = c >= least
        return EliasFano.build(h[often], "often") | EliasFano.build(h[~often], "rare") | Counts.build(c[often], "often_counts") | Counts.build(c[~often], "rare_counts")


@dataclass
class Files:
    """What workers need to open the model."""

    vocabulary: list[tuple[int, int, str]]
    width: int  # number of words with ids
    pairs: list[tuple[int, int, str]] | None = None
    triples: list[tuple[int, int, str]] | None = None
    across: tuple[dict[int, float], ...] = ({}, {})  # by level, backoffs of contexts with children in several shards
    tokens: int = 0
    distinct: int = 0


class Trie:
    def __init__(self, files: Files):
        self.width = max(files.width, 1)
        self.vocabulary = Sharded(files.vocabulary, Words)
        self.levels = [Sharded(s or [], Level) for s in (files.pairs, files.triples)]
        self.across = [(np.array(sorted(b), np.int64), np.array([b[p] for p in sorted(b)], float)) for b in files.across]

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's number among the distinct ones (sorted), their counts and ids (-1: rare or unknown)."""
        u, back = distinct(h)
        count, ids = np.zeros(len(u), np.int64), np.full(len(u), -1, np.int64)
        for w, base, at in self.vocabulary.each(u):
            i = w.often.find(u[at])
            hit = i >= 0
            ids[at][hit], count[at][hit] = base + i[hit], w.counts.of(i[hit])
            rest = at.start + np.flatnonzero(~hit)
            j = w.rare.find(u[rest])
            count[rest[j >= 0]] = w.rare_counts.of(j[j >= 0])
        return back, count, ids

    def counts_of(self, order: int, nodes: np.ndarray) -> np.ndarray:
        """Counts of words by id (order 0) or of pairs by number (order 1)."""
        v, out = (self.vocabulary, self.levels[0])[order], np.zeros(len(nodes), np.int64)
        where = np.searchsorted(v.bases, nodes, side="right") - 1
        for i in np.unique(where):
            at = np.flatnonzero(where == i)
            out[at] = v.shard(i).counts.of(nodes[at] - v.bases[i])
        return out

    def children(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Numbers of children (-1: none), for keys in any order."""
        key, back = distinct(parent * self.width + word, level > 0)
        found = np.full(len(key), -1, np.int64)
        for s, base, at in self.levels[level].each(key):
            i = s.find(key[at] // self.width, key[at] % self.width)
            found[at] = np.where(i >= 0, base + i, -1)
        return found[back]

    def follow(self, level: int, parent: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and shares of children (-1 and 0: none; so too for words below 0), and what the parent leaves to
        the lower order (1 without children)."""
        key, back = distinct(parent * self.width + np.where(word < 0, self.width - 1, word), level > 0)
        above = key // self.width
        found, share, rest = np.full(len(key), -1, np.int64), np.zeros(len(key)), np.ones(len(key))
        shards = self.levels[level]
        for s, base, at in shards.each(key):
            i, k = s.look(above[at], key[at] - above[at] * self.width)
            hit, known = i >= 0, k >= 0
            found[at][hit], share[at][hit] = base + i[hit], unquantise(s.share[i[hit]])
            rest[at][known] = unquantise(s.backoff[k[known]])
        # keys before a shard's first one, of the same parent: that parent's last child lies there or later
        cut = shards.firsts // self.width
        begin, end = np.searchsorted(key, cut * self.width), np.searchsorted(key, shards.firsts)
        for j in np.flatnonzero(begin < end):
            s = shards.shard(int(shards.where(cut[j] * self.width + self.width - 1)))
            k = int(s.parents.find(cut[j : j + 1])[0])
            if k >= 0:
                rest[begin[j] : end[j]] = unquantise(s.backoff[k : k + 1])[0]
        contexts, values = self.across[level]
        begin, end = np.searchsorted(key, contexts * self.width), np.searchsorted(key, (contexts + 1) * self.width)
        for j in np.flatnonzero(begin < end):
            rest[begin[j] : end[j]] = values[j]
        found, share = found[back], share[back]
        found[word < 0], share[word < 0] = -1, 0
        return found, share, rest[back]


def _count_words(s: Settings):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, h, _ in _chunks(batches, s.words_at_once):
            yield counted(h)

    return count


def _pairs_of(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a pair of words with ids starts; none crosses a document's end."""
    ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
    ok[ends[:-1] - 1] = False
    return np.flatnonzero(ok)


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones: most of the upper ones are 0, which codecs take away."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(raw: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


NUMBERED = "doc_id long, ids binary"


def _number_words(s: Settings, files: Files):
    """Documents to their tokens' ids; a token without one is -1 - its count."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(files)
        for docs, h, ends in _chunks(batches, s.words_at_once):
            back, count, ids = trie.words(h)
            coded = np.where(ids >= 0, ids, -1 - count)[back].astype(np.int32)
            first = np.concatenate([[0], ends[:-1]])
            yield pd.DataFrame({"doc_id": pd.array(docs, "Int64"), "ids": [_planes(coded[a:b]) for a, b in zip(first, ends)]})

    return number


def _stored(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """As _chunks, from stored ids."""
    docs, parts, size = [], [], 0

    def out():
        return docs, np.concatenate(parts).astype(np.int64), np.cumsum([len(p) for p in parts])

    for pdf in batches:
        for doc, ids in zip(pdf["doc_id"], pdf["ids"]):
            docs.append(None if pd.isna(doc) else int(doc))
            parts.append(_from_planes(ids, np.int32))
            size += len(parts[-1])
            if size >= most:
                yield out()
                docs, parts, size = [], [], 0
    if docs:
        yield out()


def _pair_keys(s: Settings, files: Files):
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for _, ids, ends in _stored(batches, s.words_at_once):
            at = _pairs_of(ids, ends)
            yield ids[at] * files.width + ids[at + 1]

    return keys


def _triple_keys(s: Settings, files: Files):
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        trie = Trie(files)
        for _, ids, ends in _stored(batches, s.words_at_once):
            at = _pairs_of(ids, ends)
            pair = np.full(len(ids), -1, np.int64)
            pair[at] = trie.children(0, ids[at], ids[at + 1])
            at = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
            yield pair[at] * trie.width + ids[at + 2]

    return keys


BLOCKS = "part int, k binary, c binary"


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(_planes(x))


def _unpacked(raw: bytes, kind) -> np.ndarray:
    return _from_planes(zstandard.ZstdDecompressor().decompress(raw), kind)


def _deal(keys: Callable, cuts: np.ndarray):
    """Keys to blocks of distinct ones with counts, one for each shard; cuts: the first key of each shard but the first."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in keys(batches):
            x = np.sort(x)
            at = np.flatnonzero(np.diff(x, prepend=-1))
            k, c = x[at], np.diff(at, append=len(x)).astype(np.uint32)
            edges = [0, *np.searchsorted(k, cuts), len(k)]
            rows = [(i, _packed(np.diff(k[a:b], prepend=0)), _packed(c[a:b])) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            yield pd.DataFrame(rows, columns=["part", "k", "c"])

    return deal


def _some_keys(keys: Callable, every: int):
    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in keys(batches):
            x = np.unique(x)
            yield pd.DataFrame({"k": x[mix(x.astype(np.uint64)) % np.uint64(every) == 0]})

    return some


def _gather(batches: Iterator[pd.DataFrame], names: list[str]) -> list[np.ndarray]:
    parts = [[pdf[n].to_numpy() for n in names] for pdf in batches]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(len(names))]


def _write_words(s: Settings, folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, c = _gather(batches, ["k", "c"])
        if len(h):
            file = f"{folder}/words-{TaskContext.get().partitionId():05d}"
            write_file(file, dump(Words.build(h, c, s.min_count)))
            yield pd.DataFrame({"first": h[:1], "n": [int((c >= s.min_count).sum())], "file": [file]})

    return write


SHARD = "first long, n long, file string, p array<long>, mass array<double>, total array<long>"


def _write_level(s: Settings, files: Files, folder: str, level: int):
    """Blocks to a shard, and to a row with its first and last context, of which other shards may have children."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: dict[int, list] = {}
        for pdf in batches:
            for part, k, c in zip(pdf["part"], pdf["k"], pdf["c"]):
                blocks.setdefault(part, []).append((np.cumsum(_unpacked(k, np.int64)), _unpacked(c, np.uint32)))
        trie = Trie(files)
        for part, x in blocks.items():
            k, c = (np.concatenate(y) for y in zip(*x))
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order].astype(np.int64)
            start = np.flatnonzero(np.diff(k, prepend=-1))
            k, c = k[start], np.add.reduceat(c, start)
            if s.min_count > 1:
                k, c = k[c >= s.min_count], c[c >= s.min_count]
            if not len(k):
                continue
            parent, word = k // trie.width, k % trie.width
            start = np.flatnonzero(np.diff(parent, prepend=-1))
            sizes = np.diff(start, append=len(k))
            # every occurrence of a context is followed by a word or an end
            total, mass = trie.counts_of(level, parent[start]), np.add.reduceat(c, start) - s.discount * sizes
            arrays = Level.build(parent, word, (c - s.discount) / np.repeat(total, sizes), np.repeat(1 - mass / total, sizes))
            if not level:
                arrays |= Counts.build(c, "counts")
            file = f"{folder}/level{level}-{part:05d}"
            write_file(file, dump(arrays))
            at = np.unique([0, len(start) - 1])
            yield pd.DataFrame({"first": k[:1], "n": [len(k)], "file": [file], "p": [parent[start[at]]], "mass": [mass[at]], "total": [total[at]]})

    return write


class Training:
    """Learns from the rows of docs (doc_id, text) for whose doc_id `learn` holds; numbers the words of all rows."""

    def __init__(self, docs: DataFrame, s: Settings, learn: Callable[[Column], Column]):
        self.docs, self.s, self.learn, self.t = docs, s, learn, Tables(docs.sparkSession, "lm")
        self.folder = new_path(docs.sparkSession, "lm-files")
        make_dir(docs.sparkSession, self.folder)

    def counted(self, rows: DataFrame, count, name: str) -> DataFrame:
        out = self.t.write(rows.mapInPandas(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")), name)
        self.t.tidy()
        return out

    def ranged(self, rows: DataFrame, n: int) -> DataFrame:
        return rows.repartitionByRange(max(1, math.ceil(n / self.s.shard_rows)), "k").sortWithinPartitions("k")

    @staticmethod
    def placed(rows: list) -> tuple[list[tuple[int, int, str]], int]:
        """One row per shard: with the number of the first entry."""
        out, base = [], 0
        for first, n, file in sorted(rows):
            out.append((first, base, file))
            base += n
        return out, base

    def cuts(self, train: DataFrame, keys: Callable, tokens: int) -> np.ndarray:
        """Where shards of about shard_rows rows start, by some keys of a fiftieth of the documents (all, if few)."""
        n = math.ceil(tokens / self.s.shard_rows)
        if n < 2:
            return np.zeros(0, np.int64)
        share = 0.02 if tokens > 10_000_000 else 1.0
        every = max(1, int(share * tokens / (200 * n)))
        rows = train.sample(share, seed=8) if share < 1 else train
        k = np.sort(rows.mapInPandas(_some_keys(keys, every), "k long").toPandas()["k"].to_numpy(np.int64))
        return np.unique(k[np.arange(1, n) * len(k) // n]) if len(k) else k

    def level(self, train: DataFrame, keys: Callable, files: Files, level: int) -> tuple[list[tuple[int, int, str]], int, dict[int, float]]:
        """A level's shards, their number of nodes and the backoffs of contexts in several shards."""
        cuts = self.cuts(train, keys, files.tokens)
        blocks = train.mapInPandas(_deal(keys, cuts), BLOCKS).repartitionById(len(cuts) + 1, F.col("part"))
        shards = blocks.mapInPandas(_write_level(self.s, files, self.folder, level), SHARD).collect()
        parts: dict[int, list[tuple[float, int]]] = {}
        for r in shards:
            for p, mass, total in zip(r["p"], r["mass"], r["total"]):
                parts.setdefault(p, []).append((mass, total))
        placed, nodes = self.placed([(r["first"], r["n"], r["file"]) for r in shards])
        del blocks  # tidy keeps what a name refers to
        self.t.tidy()
        across = {p: 1 - sum(m for m, _ in x) / x[0][1] for p, x in parts.items() if len(x) > 1}
        return placed, nodes, dict(zip(across, unquantise(quantise(np.array(list(across.values()), float))).tolist()))

    def run(self) -> tuple[Files, DataFrame]:
        s, chosen = self.s, self.learn(F.col("doc_id"))
        counts = self.counted(self.docs.filter(chosen), _count_words(s), "words")
        n = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
        shards = self.ranged(counts, n["v"]).mapInPandas(_write_words(s, self.folder), "first long, n long, file string").collect()
        vocabulary, width = self.placed([tuple(r) for r in shards])
        files = Files(vocabulary, width, tokens=n["n"], distinct=n["v"])
        if width >= 1 << 31 or width**2 >= 1 << 63:
            raise ValueError("too many words for 31-bit ids: raise min_count")
        # from here on ids are read, not texts
        ids = self.t.write(self.docs.mapInPandas(_number_words(s, files), NUMBERED), "ids", "zstd")
        self.t.drop(counts)
        self.t.tidy()
        if not width:
            return files, ids
        train = ids.filter(chosen)
        files.pairs, nodes, across = self.level(train, _pair_keys(s, files), files, 0)
        files.across = (across, {})
        if nodes * width >= 1 << 63:
            raise ValueError("too many pairs for 63-bit keys: raise min_count")
        files.triples, _, more = self.level(train, _triple_keys(s, files), files, 1)
        files.across = (across, more)
        return files, ids


def _score(s: Settings, files: Files):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(files)
        below = files.tokens + s.add * (files.distinct + 1)
        for docs, ids, ends in _stored(batches, s.words_at_once):
            count = -1 - ids
            often = ids >= 0
            count[often] = trie.counts_of(0, ids[often])
            base, known = (count + s.add) / below, count > 0
            p, first = base.copy(), np.concatenate([[0], ends[:-1]])
            inner = np.ones(len(ids), bool)  # has a word before it in its document
            inner[first] = False
            left = np.flatnonzero(inner & (np.roll(ids, 1) >= 0)) - 1
            pair, share, rest = trie.follow(0, ids[left], ids[left + 1])
            p[left + 1] = p[left + 1] * rest + share
            last = np.zeros(len(ids), bool)
            last[ends - 1] = True
            ok = np.flatnonzero((pair >= 0) & ~last[left + 1])  # a pair that ends with the end is no context
            ctx = left[ok]
            _, share, rest = trie.follow(1, pair[ok], ids[ctx + 2])
            p[ctx + 2] = p[ctx + 2] * rest + share
            sums = lambda x: np.add.reduceat(x, first)
            yield pd.DataFrame({"doc_id": pd.array(docs, "Int64"), "n_tokens": ends - first, "n_known": sums(known.astype(np.int64)), "base_score": sums(np.log10(base)), "score": sums(np.log10(p))})

    return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def train(docs: DataFrame, s: Settings | None = None) -> Files:
    """Learns from all rows."""
    return Training(_rows(docs), s or Settings(), lambda _: F.lit(True)).run()[0]


def _scored(ids: DataFrame, files: Files, s: Settings) -> DataFrame:
    return ids.mapInPandas(_score(s, files), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_texts(docs: DataFrame, files: Files, s: Settings | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, base_score and score (log10 probabilities)."""
    s = s or Settings()
    return _scored(_rows(docs).mapInPandas(_number_words(s, files), NUMBERED), files, s)


def language_scores(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """The contract's columns of op8; learns from the rows that aren't held out."""
    s = s or Settings()
    files, ids = Training(_rows(docs), s, lambda doc_id: ~held_out(doc_id)).run()
    out = _scored(ids, files, s)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(int(files.tokens)).cast("long").alias("train_tokens"), "base_score", "score")

"""Phrase collocation mining: n-grams as rows, counted per language, scored by their weakest cut.

Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words `[^\\x20\\x09]+`.  All
n-grams of one to `max_n` words within pieces become rows (lang, phrase, count), counted within a portion of text
first, and are hash-aggregated per language.  Phrases of two words or more that occur `min_count` times are
candidates.  A candidate cut after k words scores floor(1000 * a * n / (l * r)), with a its own count, n the
language's words, l and r the counts of both parts, in decimals of 38 digits; the lowest cut counts, the
smallest k on ties.  Candidates within a longer one that occurs as often (`cover` per cent of it) are dropped: one
with one word more is enough to look for, as what lies between occurs at least as often.  Each language's first
`top` by score, count and phrase are returned.

A phrase occurs at most as often as any word or pair of words in it.  So words are counted first, then pairs of
frequent words, then longer n-grams of frequent pairs; n-grams that hold a word or pair below min_count become no
rows, as they can't be candidates, nor parts of one.  Whether a word or pair is frequent is asked of a bit table of at
most 2^MOST_BITS bits (8 MB, all that is broadcast, and all that the driver sees): a false yes costs a row more that
the count then drops, never a count; with a full table all n-grams become rows.

Null texts are as empty ones, a null lang is `und`.  Long texts are counted in slices that hand their last words on, so
memory doesn't depend on a text's length.  Repeated rows count as often as they come.  An empty table gives no rows.
Columns other than text and lang aren't read.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalstream.llm.common import Tables

BREAK = b"\xff"  # in no UTF-8 text
_FOLD = bytes.maketrans(b".,;:!?\n\x0b\x0c\r" + bytes(range(65, 91)), BREAK * 10 + bytes(range(97, 123)))
_GAP = re.compile(rb"[ \t\xff]")
MOST_BITS = 26
_SHIFTS = (0, 19, 38)
COUNTS = "lang string, phrase string, c long"


@dataclass(frozen=True)
class Phrases:
    max_n: int = 5
    min_count: int = 100
    top: int = 2000
    cover: int = 100
    portion: int = 1 << 23  # bytes of text counted at a time


def _split(raw: bytes) -> list[bytes]:
    return raw.replace(BREAK, b" \xff ").split()


def slices(texts: list[bytes], portion: int, carry: int) -> Iterator[tuple[list[bytes], int]]:
    """Words and breaks of some `portion` bytes of text, and how many of the first were in the slice before, too."""
    held, size = [], 0
    for raw in texts:
        raw = raw.translate(_FOLD)
        if len(raw) > portion:
            at, before = 0, []
            while at < len(raw):
                m = _GAP.search(raw, at + portion)
                end = m.start() if m else len(raw)
                words = before + _split(raw[at:end])
                yield words, len(before)
                before, at = words[len(words) - carry :] if carry < len(words) else words, end
            continue
        held.append(raw)
        size += len(raw)
        if size > portion:
            yield _split(BREAK.join(held)), 0
            held, size = [], 0
    if held:
        yield _split(BREAK.join(held)), 0


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    out: dict[str, list[bytes]] = defaultdict(list)
    for lang, text in zip(batch.column("lang").to_pylist(), texts):
        if text:
            out[lang].append(text)
    return out


def _rows(lang: str, phrases: list[bytes], counts) -> pa.RecordBatch:
    c = pa.array(counts, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(c), np.int8))), pa.array(phrases, pa.binary()).cast(pa.string()), c], ["lang", "phrase", "c"])


def _words(cfg: Phrases):
    """Each portion's words with their counts; the empty phrase counts all words."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_lang(batch).items():
                for tokens, _ in slices(texts, cfg.portion, 0):
                    got = Counter(tokens)
                    got.pop(BREAK, None)
                    got[b""] = got.total()
                    yield _rows(lang, list(got), list(got.values()))

    return words


def _turn(h):
    """A word's hash turned by 21 bits, for the first of a pair."""
    return (h << np.uint64(21)) | (h >> np.uint64(43))


class Sieve:
    """A bit table of frequent words' or pairs' keys: `has` errs on the side of yes."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for s in _SHIFTS:
            at = (keys >> np.uint64(s)) & self.mask
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def sieve(keys: DataFrame, most_bits: int = MOST_BITS) -> Sieve:
    """Of a table of one column `key` (long); sixteen bits a key, as far as most_bits goes."""
    bits = min(max(keys.count() * 16, 1 << 16).bit_length(), most_bits)
    at = F.explode(F.array(*[F.shiftrightunsigned("key", s).bitwiseAND((1 << bits) - 1) for s in _SHIFTS]))
    places = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.col("at").bitwiseAND(63).cast("int").alias("bit"))
    got = places.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()  # 2^(most_bits - 6) rows at most
    words = np.zeros(1 << bits - 6, np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Sieve(words)


def _word_key(lang: Column, word: Column) -> Column:
    return F.xxhash64(lang, word)


def _pair_key(lang: Column, pair: Column) -> Column:
    first, second = (_word_key(lang, F.split(pair, " ")[i]) for i in (0, 1))
    return F.shiftleft(first, 21).bitwiseOR(F.shiftrightunsigned(first, 43)).bitwiseXOR(second)


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """As Spark's xxhash64(lang, word)."""
    seed, of = xxhash.xxh64_intdigest(lang.encode(), 42), xxhash.xxh64_intdigest
    return np.fromiter((of(w, seed) for w in words), np.uint64, len(words))


def _ngrams(cfg: Phrases, first: int, last: int, words, pairs):
    """n-grams of first to last words, of words (and pairs, if given) that their tables hold."""

    def ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_lang(batch).items():
                for tokens, again in slices(texts, cfg.portion, last - 1):
                    number = defaultdict(itertools.count().__next__)
                    at = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
                    names = list(number)
                    h = _hashes(lang, names)
                    good = words.value.has(h)
                    if BREAK in number:
                        good[number[BREAK]] = False
                    # code: what n-gram begins at each place of `start`; exact, by the n-gram before it and the next word
                    start, code = np.flatnonzero(good[at]), None
                    code = at[start]
                    linked = good[at[:-1]] & good[at[1:]]
                    if pairs is not None:
                        linked[linked] = pairs.value.has((_turn(h[at[:-1]]) ^ h[at[1:]])[linked])
                    for n in range(2, last + 1):
                        in_reach = start + n <= len(at)
                        start, code = start[in_reach], code[in_reach]
                        on = linked[start + n - 2]
                        start, code = start[on], code[on]
                        found, where, code, c = np.unique(code * len(names) + at[start + n - 1], return_index=True, return_inverse=True, return_counts=True)
                        if n < first:
                            continue
                        if again >= n:  # those that end before the new words have been counted
                            new = start + n > again
                            c = np.bincount(code[new], minlength=len(found))
                        some = np.flatnonzero(c)
                        ids = at[start[where[some]][:, None] + np.arange(n)].tolist()
                        if ids:
                            yield _rows(lang, [b" ".join([names[i] for i in g]) for g in ids], c[some])

    return ngrams


def _counted(rows: DataFrame, cfg: Phrases) -> DataFrame:
    counts = rows.groupBy("lang", "phrase").agg(F.sum("c").alias("f"))
    return counts.filter((F.col("f") >= cfg.min_count) | (F.col("phrase") == ""))


def phrase_counts(docs: DataFrame, tables: Tables, cfg: Phrases, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, f of all phrases of up to max_n words with f >= min_count, and of the empty phrase, whose f is the
    language's number of words."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(text).alias("text"), F.coalesce(lang, F.lit("und")).alias("lang"))
    out = tables.write(_counted(rows.mapInArrow(_words(cfg), COUNTS), cfg), "words")
    if cfg.max_n < 2:
        return out
    words = sc.broadcast(sieve(out.filter("phrase <> ''").select(_word_key(F.col("lang"), F.col("phrase")).alias("key"))))
    twos = tables.write(_counted(rows.mapInArrow(_ngrams(cfg, 2, 2, words, None), COUNTS), cfg), "pairs")
    out = out.unionByName(twos)
    if cfg.max_n > 2:
        pairs = sc.broadcast(sieve(twos.select(_pair_key(F.col("lang"), F.col("phrase")).alias("key"))))
        longer = tables.write(_counted(rows.mapInArrow(_ngrams(cfg, 3, cfg.max_n, words, pairs), COUNTS), cfg), "longer")
        out = out.unionByName(longer)
        pairs.unpersist()
    words.unpersist()
    return out


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each candidate, by its lowest cut."""
    total = counts.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    phrases = counts.filter("phrase <> ''")
    w = F.split("phrase", " ")
    cuts = phrases.withColumn("w", w).filter(F.size("w") > 1).select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("rest"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(total, "lang")
    big = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {big('a')} * {big('n')}) div ({big('l')} * {big('r')})")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")


def standing_alone(candidates: DataFrame, cover: int) -> DataFrame:
    """Candidates that aren't part of a longer one that occurs (nearly) as often."""
    w = candidates.select("lang", F.split("phrase", " ").alias("w"), F.col("a").alias("b")).filter(F.size("w") > 2)
    parts = w.select("lang", "b", F.explode(F.expr("array(array_join(slice(w, 1, size(w) - 1), ' '), array_join(slice(w, 2, size(w) - 1), ' '))")).alias("phrase"))
    covers = parts.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    c, x = candidates.alias("c"), covers.alias("x")
    return c.join(x, (F.col("c.lang") == F.col("x.lang")) & (F.col("c.phrase") == F.col("x.phrase")) & (100 * F.col("x.b") >= cover * F.col("c.a")), "left_anti")


def ranked(rows: DataFrame, top: int, spread: int = 32) -> DataFrame:
    """Each language's first `top`, numbered; first within parts of a language, so that none is sorted in one task."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(spread))
    some = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return some.withColumn("rank", rank).filter(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, cfg: Phrases | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    cfg = cfg or Phrases()
    tables = Tables(docs.sparkSession, "phrases")
    candidates = tables.write(scored(phrase_counts(docs, tables, cfg, text, lang)), "scored")
    out = tables.write(ranked(standing_alone(candidates, cfg.cover), cfg.top), "ranked")
    tables.keep(out)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(cfg: Phrases | None = None) -> str:
    cfg = cfg or Phrases()
    return f"""with recursive pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
 w as (select lang, regexp_extract_all(piece, '[^ \\t]+') as ws from pieces),
 grams as (select lang, array_to_string(ws[i : i + n - 1], ' ') as phrase, n from (select lang, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w, (select unnest(range(1, {cfg.max_n + 1})) as n) where len(ws) >= n)),
 f as (select lang, phrase, n as size, count(*) as f from grams group by all),
 total as (select lang, sum(f)::bigint as n from f where size = 1 group by 1),
 cand as (select lang, phrase, size, f as a, string_split(phrase, ' ') as ws from f where size > 1 and f >= {cfg.min_count}),
 cuts as (select lang, phrase, a, k, array_to_string(ws[1 : k], ' ') as p, array_to_string(ws[k + 1 : size], ' ') as q from (select *, unnest(range(1, size)) as k from cand)),
 scores as (select c.lang, c.phrase, a, k, x.f as l, y.f as r, n, ((1000::hugeint * a * n) // (x.f::hugeint * y.f))::bigint as score from cuts c join f x on x.lang = c.lang and x.phrase = p join f y on y.lang = c.lang and y.phrase = q join total t on t.lang = c.lang),
 best as (select lang, phrase, a, arg_min(l, (score, k)) as l, arg_min(r, (score, k)) as r, n, min(score) as score from scores group by lang, phrase, a, n),
 covers as (select lang, unnest([array_to_string(ws[1 : size - 1], ' '), array_to_string(ws[2 : size], ' ')]) as phrase, a as b from cand where size > 2),
 kept as (select * from best c where not exists (select 1 from covers x where x.lang = c.lang and x.phrase = c.phrase and 100 * x.b >= {cfg.cover} * c.a))
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) where rank <= {cfg.top}"""

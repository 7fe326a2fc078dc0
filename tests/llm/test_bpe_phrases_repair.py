"""Byte-level BPE, collocations and conversation repair against the library, brute force and other ways to the same rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opalstream.llm import byte_bpe, collocations, conversation_repair
from opalstream.llm.collocations import Phrases
from opalstream.llm.tokens import vocabulary_path

DOCS = "doc_id long, text string, lang string, ids string, bytes string, phrase string, c long, k string"


def docs_of(spark, texts, langs=("en",)):
    return spark.createDataFrame([(i, t, langs[i % len(langs)], "x", None, "y", 1, None) for i, t in enumerate(texts)], DOCS)


# --- byte-level BPE


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(vocabulary_path(byte_bpe.RANKS), byte_bpe._pattern())


PIECES = ["a", "b's", "'ll", " ", "  ", "\n", "\t", "1", "23", ".", "!?", "é", "中文", "。", "　", " ", "😀", "\x1c", "\x85", "word", "'"]


@given(st.lists(st.sampled_from(PIECES), max_size=60), st.integers(1, 9), st.integers(1, 5))
@settings(max_examples=400, deadline=None)
def test_cuts_change_no_id(codec, pieces, portion, run):
    text = "".join(pieces)
    assert codec.encode(text, portion, run).tolist() == codec.encoding.encode_ordinary(text)
    assert "".join(byte_bpe.safe_parts(text, portion)) == text


def test_ids_by_merges_alone(codec):
    """A plain byte-pair merge of each match of the pattern."""
    import regex

    with open(vocabulary_path(byte_bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}

    def merged(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    text = "It's a Test,  of the\n\n tokenizer: naïve 漢字 12345 ... they'll see\t\tthis 😀 " * 3
    assert codec.encode(text, 16).tolist() == [i for m in regex.findall(byte_bpe._pattern(), text) for i in merged(m.encode())]


def test_long_runs(codec):
    for text in (" " * 1_200_000 + "x", "a" + "\n" * 1_200_000, "y" * 300_000, "q " + "\t" * 400_000 + " z"):
        assert codec.decode(codec.encode(text)) == text.encode()
    assert codec.encode(" " * 400_000 + "x").tolist() == codec.encoding.encode_ordinary(" " * 400_000 + "x")


def test_bpe_digest(spark, codec):
    texts = [None, "", " ", "\n\n", "one", "one", "Ünïcode 漢字 😀, don't", "word " * 60_000, "<|endoftext|>"]
    docs = docs_of(spark, texts).union(docs_of(spark, texts).limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted(map(tuple, byte_bpe.bpe_digest(docs).collect()), key=str)
    want = []
    for i, t in [*enumerate(texts), (None, None)]:
        ids = codec.encoding.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert byte_bpe.bpe_digest(docs.limit(0)).count() == 0


def test_bpe_columns(spark):
    """Other columns stay, the named one is replaced; null and unknown ids give no bytes."""
    out = byte_bpe.encode_texts(docs_of(spark, ["some text", None]))
    assert out.columns == [c for c in DOCS.replace(" long", "").replace(" string", "").split(", ") if c != "ids"] + ["ids"]
    assert [r.ids for r in out.orderBy("doc_id").collect()][1] == []
    rows = spark.createDataFrame([(1, [11, 262]), (2, None), (3, [60_000]), (4, [])], "n int, ids array<int>")
    assert [None if r.bytes is None else bytes(r.bytes) for r in byte_bpe.decode_ids(rows).orderBy("n").collect()] == [b", the", None, None, b""]
    assert [r.text for r in byte_bpe.encode_texts(spark.createDataFrame([("a b",)], "text string"), ids="text").collect()] == [[64, 275]]


# --- collocations


def slow_phrases(rows, cfg):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for size in range(1, cfg.max_n + 1):
                for i in range(len(w) - size + 1):
                    key = (lang, tuple(w[i : i + size]))
                    f[key] = f.get(key, 0) + 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= cfg.min_count}
    out = []
    for (lang, p), a in cand.items():
        inside = any(q != p and x == lang and 100 * b >= cfg.cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (x, q), b in cand.items() if len(q) > len(p))
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    got = []
    for lang in n:
        for rank, (_, s, a, p, l, r, total) in enumerate(sorted(x for x in out if x[0] == lang)[: cfg.top], 1):
            got.append((lang, rank, p.decode(), -a, l, r, total, -s))
    return sorted(got)


def phrase_texts():
    rng = random.Random(8)
    words = ["the", "Of", "new", "york", "ÉTÉ", "été", "x y", "don't", "a", "b"]
    texts = [None, "", "...", "one", "\t \x0b", *(" ".join(rng.choice(words[: rng.choice([4, 10])]) + rng.choice(["", "", "", ".", ",", "\n", "\t"]) for _ in range(rng.randrange(3, 80))) for _ in range(60))]
    return texts + ["new york new york new york"] * 5


@pytest.mark.parametrize("cfg", [Phrases(min_count=5), Phrases(min_count=2, top=30), Phrases(min_count=3, max_n=3, portion=40), Phrases(min_count=2, max_n=2), Phrases(min_count=4, cover=80, portion=200)])
def test_phrases(spark, cfg):
    langs = ["en", None, "fr", "und"]
    texts = phrase_texts()
    got = sorted(map(tuple, collocations.collocations(docs_of(spark, texts, langs), cfg).collect()))
    assert got == slow_phrases([(t, langs[i % 4]) for i, t in enumerate(texts)], cfg) and got


def test_a_long_text_is_counted_in_slices(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice("abc") for _ in range(30_000)) + "." + "z" * 5000 + " a b"
    cfg = Phrases(min_count=50, portion=777)
    assert sorted(map(tuple, collocations.collocations(docs_of(spark, [text]), cfg).collect())) == slow_phrases([(text, "en")], cfg)


def test_a_full_sieve_loses_nothing(spark, monkeypatch):
    """With a table of few bits all n-grams become rows, and counts are the same."""
    few = collocations.sieve
    monkeypatch.setattr(collocations, "sieve", lambda keys: few(keys, 6))
    cfg, texts = Phrases(min_count=3), phrase_texts()
    assert sorted(map(tuple, collocations.collocations(docs_of(spark, texts), cfg).collect())) == slow_phrases([(t, "en") for t in texts], cfg)


def test_keys_are_sparks(spark):
    row = spark.createDataFrame([("dé", "naïve"), ("", "x")], "lang string, w string")
    got = [r[0] & (1 << 64) - 1 for r in row.select(F.xxhash64("lang", "w")).collect()]
    assert got == [int(collocations._hashes("dé", ["naïve".encode()])[0]), int(collocations._hashes("", [b"x"])[0])]


def test_scores_pass_64_bits(spark):
    counts = spark.createDataFrame([("en", "", 9 * 10**17), ("en", "a", 10**15), ("en", "b", 3 * 10**14), ("en", "a b", 2 * 10**14)], "lang string, phrase string, f long")
    r = collocations.scored(counts).first()
    assert r.score == 1000 * 2 * 10**14 * 9 * 10**17 // (10**15 * 3 * 10**14)


def test_no_phrases(spark):
    assert collocations.collocations(docs_of(spark, [])).count() == 0
    assert collocations.collocations(docs_of(spark, [None, ""])).count() == 0


# --- conversation repair


WHITE = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def slow_repair(rows):
    """All cheapest ways, row by row: state to (cost, edits, lines)."""
    convs = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        convs[c] += [(t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return [(c, *slow_report(rs)) for c, rs in convs.items()]


def slow_report(rs):
    rs = sorted(rs, key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2]))
    ts = [t for t, _, _ in rs if t is not None]
    n, seen, faults = Counter(), set(), []
    for _, r, x in rs:
        y = x.rstrip(WHITE)
        faults.append("blank" if not y else "duplicate" if (r, x) in seen else "truncated" if y[-1] not in ".!?" else "")
        n[faults[-1]] += 1
        seen.add((r, x))
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rs, rs[1:]))

    def inserted(ways):
        for _ in range(3):
            for p, (cost, edits, lines) in list(ways.items()):
                for role in ("user", "assistant"):
                    if q := NEXT.get((p, role[0])):
                        keep_best(ways, q, (cost + 3, edits + "I", [*lines, f"{role}:"]))
        return ways

    def keep_best(ways, q, way):
        if q not in ways or way[:2] < ways[q][:2]:
            ways[q] = way

    ways = inserted({"": (0, "", [])})
    for (_, r, x), fault in zip(rs, faults):
        new = {}
        for p, (cost, edits, lines) in ways.items():
            keep_best(new, p, (cost + 4, edits + "D", lines))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if q := NEXT.get((p, r[:1])):
                    keep_best(new, q, (cost + more, edits + "K", [*lines, f"{r}:{x}"]))
                for role in ("user", "assistant"):
                    if q := NEXT.get((p, role[0])):
                        keep_best(new, q, (cost + more + 3, edits + "R", [*lines, f"{role}:{x}"]))
        ways = inserted(new)
    cost, edits, lines = min((ways[p] for p in ("", "a") if p in ways), key=lambda w: w[:2])
    return max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def chat_rows(seed, convs, lengths):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "user", "assistant"]
    texts = ["a.", "b", "c!", "", None, " \t", "d.  ", "e\n", "f?", "ü", "role:x\ny."]
    return [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"{rng.random()}.") for c in [None, *range(convs)] for _ in range(rng.choice(lengths))]


CHATS = "conv_id long, turn long, role string, text string"


def test_repair(spark):
    rows = chat_rows(4, 150, [1, 2, 3, 6, 15])
    chats = spark.createDataFrame([(*r, "x", 1) for r in rows], CHATS + ", k string, at int")
    assert sorted(map(tuple, conversation_repair.repair_digest(chats).collect()), key=str) == sorted(slow_repair(rows), key=str)


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_blocks_are_put_together(spark, bits):
    """Conversations of many blocks, one of them of most rows."""
    rows = [(c, t, r or " ", " " if x is None else x) for c, t, r, x in chat_rows(6, 12, [5, 30]) + [(99, *r[1:]) for r in chat_rows(7, 20, [25])]]
    job = conversation_repair.Repair(spark.createDataFrame(rows, CHATS), bits)
    got = {r.k: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in job.report().collect()}
    by_conv = {}
    for c, *r in rows:
        by_conv.setdefault("" if c is None else f"={c}", []).append(tuple(r))
    empty = hashlib.sha256().hexdigest()
    assert {k: (*v[:-1], v[-1] or empty) for k, v in got.items()} == {k: slow_report(v) for k, v in by_conv.items()}


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "hi."), (1, 1, "user", "hi."), (1, 2, "user", "still there?"), (2, 0, "assistant", "well."), (2, 1, "user", "no"), (3, 0, "user", " ")]
    got = conversation_repair.Repair(spark.createDataFrame(rows, CHATS)).rows().collect()
    assert [tuple(r)[1:] for r in got if r.conv_id == 1] == [("user", "hi.", "K"), ("assistant", "still there?", "R")]
    assert [tuple(r)[1:] for r in got if r.conv_id == 2] == [("user", "", "I"), ("assistant", "well.", "K")]
    assert {r.conv_id for r in got} == {1, 2}


@given(st.lists(st.sampled_from([0, 1, 2, 3, 4, 8, 9, 10, 6]), max_size=9), st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_a_star_is_dijkstra(codes, entry):
    """With the heuristic or without, to any state."""
    exits = tuple(conversation_repair.STATES)
    with_it = conversation_repair.cheapest(bytes(codes), entry, exits, True)
    best = {entry: (0, "")}

    def more(ways):
        for _ in range(3):
            for s, (c, e) in list(ways.items()):
                t = conversation_repair.STEP[s][conversation_repair.added_role(s)]
                if t not in ways or (c + 3, e + "I") < ways[t]:
                    ways[t] = (c + 3, e + "I")
        return ways

    best = more(best)
    for code in codes:
        new = {}
        for s, (c, e) in best.items():
            ways = [(s, c + 4, e + "D")]
            if not code & 4:
                extra = 3 if code & 8 else 0
                for role in (0, 1, 2):
                    t = conversation_repair.STEP[s][role]
                    if t >= 0 and (role or code & 3 == 0):
                        ways.append((t, c + extra + (0 if code & 3 == role else 3), e + ("K" if code & 3 == role else "R")))
            for t, c2, e2 in ways:
                if t not in new or (c2, e2) < new[t]:
                    new[t] = (c2, e2)
        best = more(new)
    assert with_it == best


def test_no_conversations(spark):
    none = spark.createDataFrame([], CHATS)
    assert conversation_repair.repair_digest(none).count() == 0
    lost = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    r = conversation_repair.repair_digest(spark.createDataFrame([(lost, 0, "user", "x")], CHATS)).collect()
    assert [tuple(x) for x in r] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]

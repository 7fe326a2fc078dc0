"""Secret scans: keyed patterns plus sliding-window Shannon entropy.

A text yields spans (kind, start, end) in code points, end exclusive.  The base kinds are
assign, access and hex: leftmost non-overlapping matches of one pattern each, those that are
too short dropped after matching.  The method adds entropy spans: in each maximal run of a
character class, a window slides over the run while its symbol counts and the sum of
c*log2(c) are kept up to date in constant time; windows whose entropy reaches the class's
threshold are merged into a span.  Runs on the allow-list from end to end give no entropy span;
an alphabet inside a run suppresses only the windows that overlap it.

Null and empty texts have no spans.  Rows are independent: repeated rows and ties give equal
results, an empty table gives an empty one, and other columns of any name pass through
unread.  Texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalstream.llm.common import light_batches

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run is matched from its start, so runs of 16 or more are the matches of [0-9a-f]+ that are long enough.
HEX_LONG = re.compile(r"[0-9a-f]{16,}")
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def ascending(chars: str, least: int) -> str:
    """A pattern of the first characters of chars in their order, `least` or more, as many as there are."""
    tail = ""
    for ch in reversed(chars[least:]):
        tail = f"(?:{ch}{tail})?"
    return chars[:least] + tail


@dataclass(frozen=True)
class CharClass:
    kind: str
    run: str  # a pattern of maximal runs
    window: int
    threshold: float  # bits a character
    needs: str  # patterns, blank-separated, that a window must hold


@dataclass(frozen=True)
class Entropy:
    """Thresholds of the entropy search, the allow-list (patterns for a whole run) and alphabets (for parts of a run)."""

    classes: tuple[CharClass, ...] = (
        CharClass("entropy_hex", r"[0-9a-fA-F]{24,}", 24, 3.0, "[0-9] [a-fA-F]"),
        CharClass("entropy_base64", r"[A-Za-z0-9+/_=-]{24,}", 24, 4.0, "[0-9] [A-Za-z]"),
    )
    allow: tuple[str, ...] = (
        r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # a UUID
        r"[A-Za-z]+([-_/][A-Za-z]+)+",  # words joined by marks
        r"[0-9+/_=-]+",  # numbers, dates, rules of a table
    )
    alphabets: tuple[str, ...] = ("0123456789", ascending("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 16), ascending("abcdefghijklmnopqrstuvwxyz", 16))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return out


class EntropyScan:
    def __init__(self, cfg: Entropy):
        self.classes = [(KINDS.index(c.kind), re.compile(c.run), c, [re.compile(p) for p in c.needs.split()]) for c in cfg.classes]
        self.allow = re.compile("|".join(f"(?:{p})" for p in cfg.allow)) if cfg.allow else None
        self.alphabets = re.compile("|".join(f"(?:{p})" for p in cfg.alphabets)) if cfg.alphabets else None
        top = max((c.window for c in cfg.classes), default=1)
        self.clog = [0.0] + [c * math.log2(c) for c in range(1, top + 2)]  # a window holds one more before its oldest goes

    def windows(self, run: str, w: int, threshold: float) -> list[tuple[int, int]]:
        """Merged windows of w characters with at least threshold bits a character."""
        clog, counts, total, out = self.clog, {}, 0.0, []
        most = (math.log2(w) - threshold) * w + 1e-9  # entropy >= threshold iff sum of c log c <= most
        for i, ch in enumerate(run):
            c = counts.get(ch, 0)
            counts[ch] = c + 1
            total += clog[c + 1] - clog[c]
            if i >= w:
                old = run[i - w]
                c = counts[old]
                counts[old] = c - 1
                total += clog[c - 1] - clog[c]
            if i >= w - 1 and total <= most:
                if out and out[-1][1] >= i - w + 1:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((i - w + 1, i + 1))
        return out

    def pieces(self, run: str) -> Iterator[tuple[int, str]]:
        """What lies between a run's alphabets, with where it starts."""
        at = 0
        for m in self.alphabets.finditer(run) if self.alphabets else ():
            yield at, run[at : m.start()]
            at = m.end()
        yield at, run[at:]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        out = []
        for kind, pattern, c, needs in self.classes:
            for m in pattern.finditer(text):
                run = m.group()
                if not all(p.search(run) for p in needs) or self.allow and self.allow.fullmatch(run):
                    continue
                for at, piece in self.pieces(run):
                    for a, b in self.windows(piece, c.window, c.threshold):
                        if all(p.search(piece, a, b) for p in needs):
                            out.append((m.start() + at + a, kind, m.start() + at + b))
        return out


def find_secrets(text: str | None, scan: EntropyScan) -> list[dict]:
    if not text:
        return []
    spans = sorted(base_spans(text) + scan.spans(text))
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]


SPANS = "array<struct<kind:string,start:long,end:long>>"


def secret_spans(text: Column, cfg: Entropy | None = None) -> Column:
    """All spans of a text, sorted by start, then kind."""
    cfg = cfg or Entropy()

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan = EntropyScan(cfg)
        for s in batches:
            yield pd.Series([find_secrets(t, scan) for t in s], dtype=object)

    return spans(text)


def redact_text(text: str | None, spans, mark: str) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    out, at = [], 0
    for s in spans:
        a, b = s["start"], s["end"]
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", cfg: Entropy | None = None) -> DataFrame:
    """The same rows and columns with each span of text_col, overlapping ones as one, replaced by mark."""
    light_batches(docs.sparkSession)
    cfg = cfg or Entropy()

    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan = EntropyScan(cfg)
        for s in batches:
            yield pd.Series([redact_text(t, find_secrets(t, scan), mark) for t in s], dtype=object)

    return docs.withColumn(text_col, redact(F.col(text_col)))


def secrets_digest(docs: DataFrame, cfg: Entropy | None = None) -> DataFrame:
    """The contract's columns of op4 for each row of docs."""
    light_batches(docs.sparkSession)
    found = docs.select("doc_id", secret_spans(F.col("text"), cfg).alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin(*KINDS[:3]))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )


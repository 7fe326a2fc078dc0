"""Document fingerprints: Merkle trees over sections, paragraphs and passages, in SQL functions only.

A text is cut into sections (after blank lines), those into paragraphs (after line ends), those into
passages of 32 characters or more (6 in short paragraphs) that end after a mark or a chosen letter and
a space, so that the cuts after an edit soon fall where they fell before; without such an end they are
cut at a space, or at 120 characters (30).  Nothing is dropped between cuts: passages laid
end to end are the text.  A passage's hash is 32 bits wide; a paragraph's digest covers its passages
in full, a section's its paragraphs' digests and the root the sections'.  The fingerprint is text:

    root:section(paragraph=passage.passage;paragraph=passage)/section(...)

Roots are equal for equal texts, and differ otherwise but for hash collisions; the branches that
differ tell where an edit is.  The likeness of two fingerprints is 1 for equal roots, else
2 * |A & B| / (|A| + |B|) over their sets of passages (0 if one has none).

Null texts are as empty ones: no sections, one root.  Rows that repeat a doc_id have the same next
document; as the next document such rows give the smallest of their texts.  Rows without a doc_id
have an empty next document and are nobody's next.  An empty table gives an empty one.  Other columns
of any name are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalstream.llm.common import Tables

SECTION = r"(?<=\n\n)(?=[^\n])"
PARAGRAPH = r"(?<=\n)"
_ENDS = r"(?s).{%d,%d}?(?:[.!?;:,|dgsxeu] |\n|\z)|.{%d,%d}? |.{1,%d}"
PASSAGE, SHORT_PASSAGE = _ENDS % (32, 120, 32, 120, 120), _ENDS % (6, 30, 6, 30, 30)
SHORT = 128  # characters of a paragraph that is cut into short passages


def tree(text: Column) -> Column:
    """array (sections) of array (paragraphs) of struct (digest, passages: array of int)."""
    some = lambda parts: F.filter(parts, lambda x: x != "")
    cut = lambda p, pattern: F.regexp_extract_all(p, F.lit(pattern), F.lit(0))
    hashes = lambda p: F.transform(F.when(F.length(p) < SHORT, cut(p, SHORT_PASSAGE)).otherwise(cut(p, PASSAGE)), lambda x: F.xxhash64(x))
    paragraphs = lambda s: F.transform(some(F.split(s, PARAGRAPH)), hashes)
    node = lambda h: F.struct(F.substring(F.md5(F.array_join(F.transform(h, lambda x: F.hex(x)), ".")), 1, 16).alias("digest"), F.transform(h, lambda x: x.bitwiseAND(0xFFFFFFFF)).alias("passages"))
    return F.transform(some(F.split(F.coalesce(text, F.lit("")), SECTION)), lambda s: F.transform(paragraphs(s), node))


def sections(t: Column) -> Column:
    """Sections' digests."""
    return F.transform(t, lambda s: F.substring(F.md5(F.array_join(F.transform(s, lambda p: p["digest"]), ".")), 1, 16))


def fingerprint(t: Column) -> Column:
    hex8 = lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))
    paragraph = lambda p: F.concat(p["digest"], F.lit("="), F.array_join(F.transform(p["passages"], hex8), "."))
    body = F.transform(F.arrays_zip(sections(t).alias("d"), t.alias("p")), lambda s: F.concat(s["d"], F.lit("("), F.array_join(F.transform(s["p"], paragraph), ";"), F.lit(")")))
    return F.concat(root(t), F.lit(":"), F.array_join(body, "/"))


def root(t: Column) -> Column:
    return F.substring(F.sha2(F.array_join(sections(t), ".").cast("binary"), 256), 1, 32)


def passages(t: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(t, lambda s: F.flatten(F.transform(s, lambda p: p["passages"])))))


def _dice(same_root: Column, a: Column, b: Column) -> Column:
    both = F.size(a) + F.size(b)
    return F.when(same_root, 1.0).when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints."""
    parts = lambda f: F.array_distinct(F.regexp_extract_all(f, F.lit("[=.]([0-9a-f]{8})(?![0-9a-f])"), F.lit(1)))
    head = lambda f: F.substring_index(f, ":", 1)
    return _dice(head(a) == head(b), parts(a), parts(b))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Numbers, from 0, of the paragraphs of fingerprint b whose digests aren't in a."""
    digests = lambda f: F.regexp_extract_all(f, F.lit("([0-9a-f]{16})="), F.lit(1))
    return F.filter(F.transform(digests(b), lambda d, i: F.when(~F.array_contains(digests(a), d), i)), lambda i: i.isNotNull())


def next_ids(ids: DataFrame, tables: Tables) -> DataFrame:
    """Distinct ids (doc_id, half) to (doc_id, next_id, half) in a ring; nothing is ordered in one task."""
    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("at", F.monotonically_increasing_id())
    ordered = tables.write(ordered, "ordered")
    part = F.shiftright("at", 33)
    # one row for each partition of the sort, a few thousand at most
    sizes = sorted((r["k"], r["n"]) for r in ordered.groupBy(part.alias("k")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for k, n in sizes:
        starts.append((k, total))
        total += n
    if not total:
        return ordered.select("doc_id", F.col("doc_id").alias("next_id"), "half")
    starts = tables.spark.createDataFrame(starts, "k long, first long")
    placed = ordered.withColumn("k", part).join(F.broadcast(starts), "k").select("doc_id", "half", (F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("at"))
    placed = tables.write(placed, "placed")
    after = placed.select(F.col("doc_id").alias("next_id"), F.pmod(F.col("at") - 1, F.lit(total)).alias("at"))
    out = tables.write(placed.join(after, "at").select("doc_id", "next_id", "half"), "next")
    tables.drop(ordered, placed)
    return out


def edited_texts(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, text, n_chars, edited, and the next text's root and passages."""
    tables = Tables(docs.sparkSession, "merkle")
    # an alias of a column that needs no cast would keep the two joins below from sharing one shuffle
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    docs = docs.select(doc_id, F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2)
    ring = next_ids(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max(half).alias("half")), tables)
    # each text goes once to its id, with the id before it and what that needs of it
    needed = ring.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before"), F.col("half").alias("need"))
    named = docs.filter("doc_id is not null")  # the same for both joins, so that one shuffle of the texts serves them
    heads = named.join(needed, "doc_id").withColumn("t", tree(F.col("text")))
    heads = heads.select(F.col("before").alias("doc_id"), F.struct(F.col("text").substr(F.lit(1), F.col("need").cast("int")).alias("head"), root(F.col("t")).alias("root"), passages(F.col("t")).alias("passages")).alias("next"))
    heads = heads.groupBy("doc_id").agg(F.min("next").alias("next"))
    n = F.length("text")
    nameless = docs.filter("doc_id is null").withColumn("next", F.lit(None).cast(heads.schema["next"].dataType))
    out = named.join(heads, "doc_id", "left").unionByName(nameless)
    edited = F.concat(F.col("text").substr(F.lit(1), n - half.cast("int")), F.coalesce(F.col("next.head").substr(F.lit(1), half.cast("int")), F.lit("")))
    return out.select("doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "next")


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of op5."""
    rows = edited_texts(docs).select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), tree(F.col("text")).alias("t"), tree(F.col("edited")).alias("e"), "next")
    rows = rows.select(
        "doc_id", "n_chars", "edited_sha256", "next", fingerprint(F.col("t")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), passages(F.col("t")).alias("tp"), passages(F.col("e")).alias("ep")
    )
    head = lambda c: F.substring_index(c, ":", 1)
    near_next = F.coalesce(_dice(head("fingerprint") == F.col("next.root"), F.col("tp"), F.col("next.passages")), F.lit(0.0))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        _dice(head("fingerprint") == head("edited_fingerprint"), F.col("tp"), F.col("ep")).alias("near_edited"), near_next.alias("near_next"),
    )

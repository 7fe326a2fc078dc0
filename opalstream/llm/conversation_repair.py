"""Conversation structure repair: the cheapest edits that make turns alternate, by A* on the edit lattice.

A conversation is repaired when its roles' initials read `(s?(ua)+)?` and no row is blank (no character but white
space) or a duplicate (role and text of an earlier row).  Keep costs 0, Rerole to user or assistant 3, Delete 4,
Insert (an empty user or assistant turn) 3; a row that ends without one of `.!?` and isn't deleted costs 3 more.  Of
cheapest repairs the one whose string of edits (their initials) is least in ASCII is taken.

Nodes of the lattice are (rows done, state of the pattern).  A* takes them by (cost + heuristic, edits so far); the
heuristic is the suffix sum of what rows cost at least: 4 if blank or duplicate, 3 if truncated.  It never falls by
more than an edit costs, so a node is first taken with its least cost, and with the least edits among those: of two
cheapest ways to one node neither's edits begin with all of the other's, as only Inserts would be left over.

A conversation may hold any share of all rows, so it is cut into blocks of rows: A* solves a block for every state it
may be entered and left in, blocks in parallel; then blocks are put together in order, a string and a cost for each
state.  What meets in one place is a conversation's edits (a byte a row, as the report has them as one string);
its rows pass by in order, once.

Nulls of role and text are taken as one space, a null turn sorts first, rows without conv_id are one conversation.
Rows of the same turn are in order of role and text.  A role without characters has no legal initial.  Repeated rows
are duplicates.  Empty tables give empty ones.  Other columns of any name aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalstream.llm.common import Tables

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"
#: States of the pattern: nothing yet, after s, after u, after a; by state and role (s, u, a), -1 where it doesn't go on.
STEP = ((1, 2, -1), (-1, 2, -1), (-1, -1, 3), (-1, 2, -1))
STATES, ENDS = range(4), (0, 3)
INITIALS, ROLES = "sua", ("system", "user", "assistant")
#: A row's code: its role's place in INITIALS (3 for others), and 4 for each fault before it.
SOUND, GONE, CUT = 0, 4, 8
BLOCK_BITS = 12


def added_role(state: int) -> int:
    """The one of user and assistant that goes on from a state."""
    return 1 if STEP[state][1] >= 0 else 2


def cheapest(codes: bytes, entry: int, exits: tuple[int, ...], all_of_them: bool) -> dict[int, tuple[int, str]]:
    """Exit state to (cost, edits) of the cheapest way through all rows; of the best exit alone, unless all_of_them."""
    n = len(codes)
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (DELETE if codes[i] & GONE else TRUNCATED if codes[i] & CUT else 0)
    heap, done, found = [(least[0], "", 0, entry)], set(), {}
    while heap:
        f, edits, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in exits:
            found[state] = (f, edits)
            if not all_of_them or len(found) == len(exits):
                break
        role = added_role(state)
        after, cost = STEP[state][role], f - least[i]
        if (i, after) not in done:
            heappush(heap, (cost + INSERT + least[i], edits + "I", i, after))
        if i == n:
            continue
        code, rest = codes[i], least[i + 1]
        if (i + 1, state) not in done:
            heappush(heap, (cost + DELETE + rest, edits + "D", i + 1, state))
        if code & GONE:
            continue
        cost += TRUNCATED if code & CUT else 0
        own = code & 3
        if own < 3 and STEP[state][own] >= 0:
            heappush(heap, (cost + KEEP + rest, edits + "K", i + 1, STEP[state][own]))
        if own != role:
            heappush(heap, (cost + REROLE + rest, edits + "R", i + 1, after))
    return found


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with some rows dropped, emptied, without `.!?`, twice, or the user's, by a hash of conv_id and turn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    out = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _key(c: str = "conv_id"):
    """A conversation's key, never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's cheapest ways, by state before and after."""
    for b in batches:
        ways, illegal = [], []
        for codes, head, tail in zip(b.column("codes").to_pylist(), b.column("head").to_pylist(), b.column("tail").to_pylist()):
            exits = ENDS if tail else tuple(STATES)
            ways.append([{"a": s, "b": t, "cost": c, "edits": e} for s in ((0,) if head else STATES) for t, (c, e) in cheapest(bytes(codes), s, exits, not tail).items()])
            # between the first and the last row of the block
            illegal.append(sum(not _legal(x & 3, y & 3) for x, y in zip(codes, codes[1:])))
        ends = [[c[0] & 3, c[-1] & 3] for c in b.column("codes").to_pylist()]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
        yield pa.RecordBatch.from_arrays([b.column("k"), b.column("block"), b.column("first_at"), pa.array(ways, kind), pa.array(illegal, pa.int64()), pa.array(ends, pa.list_(pa.int32()))], ["k", "block", "first_at", "ways", "illegal", "ends"])


def _legal(x: int, y: int) -> bool:
    return (x, y) in ((0, 1), (1, 2), (2, 1))


class _Way:
    """Edits of a block that follow those of the blocks before."""

    __slots__ = ("before", "edits", "entry", "first_at")

    def __init__(self, before, edits, entry, first_at):
        self.before, self.edits, self.entry, self.first_at = before, edits, entry, first_at


def _less(x: _Way, y: _Way) -> bool:
    """Whether the edits of x, from where the two part, are less than those of y."""
    a, b = [x.edits], [y.edits]
    while x.before is not y.before:
        x, y = x.before, y.before
        a.append(x.edits)
        b.append(y.edits)
    return "".join(reversed(a)) < "".join(reversed(b))


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order to a row for each block with its edits, and one for the whole conversation."""
    mine, held, illegal, last = None, {}, 0, None

    def whole() -> Iterator[pa.RecordBatch]:
        cost, way = None, None
        for other, path in (held[state] for state in ENDS if state in held):
            if way is None or other < cost or (other == cost and _less(path, way)):
                cost, way = other, path
        chain = []
        while way is not None:
            chain.append(way)
            way = way.before
        chain.reverse()
        names = ["k", "first_at", "entry", "edits", "cost", "illegal"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        rows = [(mine, w.first_at, w.entry, w.edits, None, None) for w in chain]
        for i in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 1000]), kinds)], names)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((mine, None, None, "".join(w.edits for w in chain), cost, illegal), kinds)], names)

    for b in batches:
        for row in b.to_pylist():
            if row["k"] != mine:
                if mine is not None:
                    yield from whole()
                mine, held, illegal, last = row["k"], {0: (0, None)}, 0, None
            if last is not None:
                illegal += not _legal(last, row["ends"][0])
            illegal, last = illegal + row["illegal"], row["ends"][1]
            new: dict[int, tuple[int, _Way]] = {}
            for w in row["ways"]:
                if w["a"] in held:
                    cost, way = held[w["a"]][0] + w["cost"], _Way(held[w["a"]][1], w["edits"], w["a"], row["first_at"])
                    old = new.get(w["b"])
                    if old is None or cost < old[0] or (cost == old[0] and _less(way, old[1])):
                        new[w["b"]] = (cost, way)
            held = new
    if mine is not None:
        yield from whole()


REPAIRED = "k string, role string, text string, edit string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's edits, then its rows, to the rows of the repaired conversation."""
    edits, at, state, last = "", 0, 0, 0  # last: where the edits of the block's last row end
    for b in batches:
        out = []

        def inserts(k: str) -> None:
            nonlocal at, state
            while at < len(edits) and edits[at] == "I":
                role = added_role(state)
                state = STEP[state][role]
                out.append((k, ROLES[role], "", "I"))
                at += 1

        for row in b.to_pylist():
            if row["edits"] is not None:
                edits, at, state = row["edits"], 0, row["entry"]
                last = len(edits.rstrip("I"))
                continue
            inserts(row["k"])
            edit, role = edits[at], row["role"]
            at += 1
            if edit == "R":
                role = ROLES[added_role(state)]
            if edit != "D":
                state = STEP[state][INITIALS.index(role[0])]
                out.append((row["k"], role, row["text"], edit))
            if at == last:
                inserts(row["k"])
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], ["k", "role", "text", "edit"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k and the SHA-256 of its rows as lines `role:text`; rows of a conversation follow each other."""
    mine, sha = None, None
    for b in batches:
        ks, hashes = [], []
        for k, role, text in zip(b.column("k").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
            if k != mine:
                if mine is not None:
                    ks.append(mine)
                    hashes.append(sha.hexdigest())
                mine, sha = k, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), pa.array(hashes, pa.string())], ["k", "repaired_sha256"])
    if mine is not None:
        yield pa.RecordBatch.from_arrays([pa.array([mine]), pa.array([sha.hexdigest()])], ["k", "repaired_sha256"])


class Repair:
    """The repair of conversations, rows (conv_id, turn, role, text): `report()` and the repaired `rows()`.

    Tables in between are written to the shared folder; `close()` deletes them when nothing reads them any more."""

    def __init__(self, rows: DataFrame, block_bits: int = BLOCK_BITS):
        self.tables = Tables(rows.sparkSession, "repair")
        write = self.tables.write
        space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
        order = ["k", F.col("turn").asc_nulls_first(), "role", "text"]
        flat = rows.select(_key().alias("k"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
        # `at` is in order, and without gaps within a file; a block is a run of one conversation's rows in a file
        self.placed = write(flat.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "rows")
        first = self.placed.groupBy("k", "role", F.sha2("text", 256)).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("_first"))
        end = F.rtrim(F.col("text"), F.lit(WHITE))
        blank = F.length(end) == 0
        seen = self.placed.select("k", "turn", "at", F.substring("role", 1, 1).alias("_i"), blank.alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("_cut"))
        marks = seen.join(first, "at", "left").withColumn("duplicate", ~F.col("blank") & F.col("_first").isNull())
        marks = marks.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("_cut"))
        own = F.coalesce(*[F.when(F.col("_i") == c, i) for i, c in enumerate(INITIALS)], F.lit(3))
        fault = F.when(F.col("blank") | F.col("duplicate"), GONE).when(F.col("truncated"), CUT).otherwise(SOUND)
        self.marks = write(marks.select("k", "turn", "at", F.shiftright("at", block_bits).alias("block"), "blank", "duplicate", "truncated", (own + fault).cast("tinyint").alias("code")), "marks")
        ends = self.marks.groupBy("k").agg(F.min("block").alias("head"), F.max("block").alias("tail"))
        blocks = self.marks.groupBy("k", "block").agg(F.min("at").alias("first_at"), F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]).alias("codes"))
        blocks = blocks.join(ends, "k").select("k", "block", "first_at", "codes", (F.col("block") == F.col("head")).alias("head"), (F.col("block") == F.col("tail")).alias("tail"))
        solved = blocks.mapInArrow(_solve, "k string, block long, first_at long, ways array<struct<a int, b int, cost long, edits string>>, illegal long, ends array<int>")
        self.edits = write(solved.repartition("k").sortWithinPartitions("k", "block").mapInArrow(_join_up, "k string, first_at long, entry int, edits string, cost long, illegal long"), "edits")

    def keyed_rows(self) -> DataFrame:
        """k, role, text, edit of the repaired conversations; within a part of the frame, a conversation's rows follow each other in order."""
        edits = self.edits.filter("first_at is not null").select("k", F.col("first_at").alias("at"), F.lit(0).alias("kind"), "edits", "entry", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
        rows = self.placed.select("k", "at", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("edits"), F.lit(None).cast("int").alias("entry"), "role", "text")
        return edits.unionByName(rows).repartition("k").sortWithinPartitions("k", "at", "kind").mapInArrow(_apply, REPAIRED)

    def rows(self, kind: str = "long") -> DataFrame:
        """conv_id (as `kind`), role, text and edit (K, R or I) of the repaired conversations."""
        return self.keyed_rows().select(F.expr(f"cast(nullif(substring(k, 2), '') as {kind})").alias("conv_id"), "role", "text", "edit")

    def report(self) -> DataFrame:
        """k and its counts of faults, gaps, cost, audit and digest; conversations without rows aren't there."""
        turns = self.marks.groupBy("k", "turn").agg(*[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")])
        span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
        counts = turns.groupBy("k").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
        whole = self.edits.filter("first_at is null").select("k", "illegal", "cost", F.col("edits").alias("audit"))
        return counts.join(whole, "k").join(self.keyed_rows().mapInArrow(_digests, "k string, repaired_sha256 string"), "k", "left")

    def close(self, *but: DataFrame) -> None:
        self.tables.keep(*but)


def repair_digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns of op13: damaged conversations, repaired."""
    job = Repair(damaged(conversations))
    every = conversations.select("conv_id").distinct().withColumn("k", _key())
    out = every.join(job.report(), "k", "left").drop("k")
    out = out.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})
    out = job.tables.write(out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), "report")
    job.close(out)
    return out

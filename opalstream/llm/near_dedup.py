"""MinHash near-dedup: a chosen-path set similarity join, then connected components.

A document's set is its distinct word shingles (A-Z lower-cased; words are [^\\x20\\x09-\\x0D]+); with
fewer words than a shingle has, the whole sequence is one shingle; without words the set is empty
and linked with nothing.  Documents with intersection * den >= num * union are linked, which is
confirmed on full sets; a component is named by its smallest doc_id.

How it is found.  Equal sets form a class; only a class's smallest doc_id goes on.
1. `trees` independent trees branch the classes: a tree's root branches by its first minwise token, a
   node of more than `leaf` members by the next one, down to `depth` tokens; nodes of fewer members are
   leaves where they are, singles are done with.  A linked pair stays together in a tree with probability
   (num/den) a branching, so it is missed by all of them with (1 - (num/den)^depth)^trees at most: 1e-5
   for 12 trees of depth 3 at 0.85, less for closer pairs and smaller nodes.
2. Leaves are compared exhaustively by signature; a pair is likely if its share of equal minwise bytes is
   within 5 standard deviations of the threshold or above.  Members without a likely partner are done with;
   the other pairs are confirmed.  A first round confirms a star around
   each node's centre; pairs that are then in one component need no more work; a second round confirms
   all others.
3. A node that is still larger at the last branching holds groups of near copies, which minwise tokens
   hardly part.  Its centre is the member closest to the coordinate-wise mode of its signatures.  Each
   member's set is compared with the centre's in full.  Members linked to it are connected.  A pair with at
   least one other member is linked only if the members' differences from the centre share tokens: for
   |Du| + |Dy| - 2|Du & Dy| is their distance.  So the node branches on by the tokens of each difference's
   prefix, those that aren't in the centre first, of them those that few sets hold; by the prefix filter's argument
   no linked pair is lost in any order that is the same for all of a node's members.  Frequent tokens, of lines that
   many texts hold, would lead the same texts through level upon level of large nodes.  A set's frequent tokens come
   last, as counts of the tokens of large nodes' members say, in a table of fixed size; two tokens that share a counter
   cost work only.  Children are nodes in their turn, without the centre.  As each level takes no more than the
   centre from texts that are all a little alike, those of up to 8 leaves' members are compared exhaustively
   like leaves, and what is larger after `levels` levels is, too, block by block: each two blocks of its members
   make a node.

Tables in between are small rows: ids, 128-byte signatures, and full sets only of members of nodes
(found in the second pass over the texts by a bit table of fixed size; false hits cost nothing but
work).  No list of pairs of a large group is made, and nothing but that bit table and that of counts is broadcast.

Null texts are as empty ones.  Rows that repeat a doc_id are one document's: whatever one of them is
linked with, all are.  A null doc_id never names a component; ids are below 2^62.  An empty table gives an empty one.
Other columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalstream.llm.common import Tables, lower_words, mix, shingle_hashes, word_hashes
from opalstream.llm.components import components


@dataclass(frozen=True)
class Near:
    shingle: int = 3
    num: int = 85
    den: int = 100
    coordinates: int = 128
    trees: int = 12
    depth: int = 3
    leaf: int = 128
    levels: int = 3  # of children of large nodes
    deviations: float = 5
    once: bool = False  # emit a pair only in the first small tree node that its members share; more to ship, fewer pairs
    bits: int = 23  # log2 of the bit table's bits: 1 MB
    counters: int = 20  # log2 of the counts of tokens, a byte each: 1 MB

    @property
    def likely(self) -> float:
        p = self.num / self.den
        return p - self.deviations * (p * (1 - p) / self.coordinates) ** 0.5


def _family(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = mix(np.arange(1, 2 * k + 1, dtype=np.uint64))
    return (r[:k] >> np.uint64(32)).astype(np.uint32), (r[k:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minwise(hashes: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    x, out = (hashes >> np.uint64(32)).astype(np.uint32), np.full(len(xor), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        h = (x[None, at : at + 2048] ^ xor[:, None]) * mul[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


#: The low bits of a node's path are its tree's number, all ones for children of large nodes.
_TREE = np.uint64(31)


def _child_path(*cols) -> Column:
    return F.xxhash64(*cols).bitwiseOR(int(_TREE))


def _tree_path(tree: Column, *cols) -> Column:
    return F.xxhash64(tree, *cols).bitwiseAND(~int(_TREE)).bitwiseOR(tree.cast("long"))


def _nameless(digest: bytes) -> int:
    """Stands for the class of a set of which all doc_ids are null: a number beyond all ids."""
    return NAMELESS + int.from_bytes(digest[:7], "little")


NAMELESS = 1 << 62


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _sketch(cfg: Near):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xor, mul = _family(cfg.coordinates)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                h = shingle_hashes(word_hashes(lower_words(text)), cfg.shingle)
                if not len(h):
                    rows.append((doc, 0, None, None, None, None))
                    continue
                low, digest = minwise(h, xor, mul), _digest(h)
                sig = (low * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()
                rows.append((doc, len(h), digest, _nameless(digest), sig, low[: cfg.depth * cfg.trees].view(np.int32)))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "digest", "alt", "sig", "tokens"]).astype({"doc_id": "Int64", "alt": "Int64"})

    return sketch


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _signatures(values: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(-1, k)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.StructArray]:
    """Where the lists of structs start, and their members laid end to end."""
    col = batch.column(name)
    sizes = col.value_lengths().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), col.flatten()


def _mode(sigs: np.ndarray) -> np.ndarray:
    k = sigs.shape[1]
    counts = np.bincount((sigs.astype(np.int64) + 256 * np.arange(k)).ravel(), minlength=256 * k)
    return counts.reshape(k, 256).argmax(axis=1).astype(np.uint8)


def _modes(cfg: Near):
    def modes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, m = _lists(batch, "m")
            sigs = _signatures(m.field("sig"), cfg.coordinates) if len(m) else None
            out = [_mode(sigs[a:b]).tobytes() for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], ["path", "mode"])

    return modes


def _candidates(cfg: Near, star: bool):
    """Nodes (m: rep, label, sig) to likely pairs with different labels: with the node's centre only, or all."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, m = _lists(batch, "m")
            if not len(m):
                continue
            rep, label = (m.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "label"))
            sigs = _signatures(m.field("sig"), cfg.coordinates)
            sizes, found = np.diff(starts), []
            once = cfg.once and not star
            if once:
                tree = (_column(batch, "path") & int(_TREE)).astype(np.int64)
                home = m.field("home").flatten().to_numpy(zero_copy_only=False).reshape(-1, cfg.trees)

            def keep(i: np.ndarray, j: np.ndarray) -> None:
                differ = label[i] != label[j]
                i, j = i[differ], j[differ]
                for at in range(0, len(i), 20_000):
                    a, b = i[at : at + 20_000], j[at : at + 20_000]
                    ok = (sigs[a] == sigs[b]).mean(axis=1) >= cfg.likely
                    a, b = a[ok], b[ok]
                    if once:
                        shared = (home[a] == home[b]) & (home[a] != 0)
                        first = np.where(shared.any(axis=1), shared.argmax(axis=1), int(_TREE))
                        here = first == tree[np.searchsorted(starts, a, side="right") - 1]
                        a, b = a[here], b[here]
                    found.append(np.stack([rep[a], rep[b]]))

            for s in np.unique(sizes[sizes >= 2]):
                at = starts[:-1][sizes == s]
                if star:
                    mid = at if s == 2 else np.array([a + (sigs[a : a + s] == _mode(sigs[a : a + s])).sum(axis=1).argmax() for a in at])
                    keep(np.repeat(mid, s), (at[:, None] + np.arange(s)).ravel())
                else:
                    x, y = np.triu_indices(s, 1)
                    step = max(1, 100_000 // len(x))
                    for g in range(0, len(at), step):
                        keep((at[g : g + step, None] + x).ravel(), (at[g : g + step, None] + y).ravel())
            both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            both = np.unique(np.sort(both, axis=0), axis=1)
            both = both[:, both[0] != both[1]]
            yield pa.RecordBatch.from_arrays([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], ["a", "b"])

    return pairs


def _likely(cfg: Near):
    """Nodes (m: rep, sig) to their members that have a likely partner there."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, m = _lists(batch, "m")
            if not len(m):
                continue
            sigs, has = _signatures(m.field("sig"), cfg.coordinates), np.zeros(len(m), bool)
            sizes = np.diff(starts)
            for s in np.unique(sizes[sizes >= 2]):
                at = starts[:-1][sizes == s]
                x, y = np.triu_indices(s, 1)
                step = max(1, 20_000 // len(x))
                for g in range(0, len(at), step):
                    i, j = (at[g : g + step, None] + x).ravel(), (at[g : g + step, None] + y).ravel()
                    ok = (sigs[i] == sigs[j]).mean(axis=1) >= cfg.likely
                    has[i[ok]] = has[j[ok]] = True
            paths = np.repeat(_column(batch, "path"), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(paths[has], pa.int64()), m.field("rep").filter(pa.array(has))], ["path", "rep"])

    return likely


def _sets(cfg: Near, table):
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = table.value
        for pdf in batches:
            named = pdf["doc_id"].notna().to_numpy()
            bit = pdf["bit"].fillna(0).to_numpy(np.int64)
            rows, hit = [], ~named | (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            for doc, text in zip(pdf["doc_id"].to_numpy()[hit], pdf["text"].to_numpy()[hit]):
                h = shingle_hashes(word_hashes(lower_words(text)), cfg.shingle)
                rows.append((_nameless(_digest(h)) if pd.isna(doc) else int(doc), h.tobytes()))
            yield pd.DataFrame(rows, columns=["rep", "set"]).astype({"rep": "int64"})

    return sets


def linked(x: np.ndarray, y: np.ndarray, cfg: Near) -> bool:
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if cfg.den * len(small) < cfg.num * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return cfg.den * both >= cfg.num * (len(x) + len(y) - both)


def _confirm(cfg: Near):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column("sa"), batch.column("sb")
            ok = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), cfg) for x, y in zip(sa, sb)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return confirm


def counter(hashes: np.ndarray, cfg: Near) -> np.ndarray:
    return (hashes >> np.uint64(64 - cfg.counters)).astype(np.int64)


def _counts(cfg: Near):
    """Sets to how many of them hold a token of each counter, in parts."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << cfg.counters, np.int64)
        for batch in batches:
            hashes = np.frombuffer(b"".join(batch.column("set").to_pylist()), np.uint64)
            total += np.bincount(counter(hashes, cfg), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["counter", "n"])

    return counts


def prefix(x: np.ndarray, hub: np.ndarray, near: bool, cfg: Near, counts: np.ndarray | None = None) -> np.ndarray:
    """The tokens of x's difference from hub that a linked pair with a member not near hub must share one of.

    The order of tokens, by counts, depends on them and hub alone; with any such order no pair is lost."""
    added, removed = np.setdiff1d(x, hub, assume_unique=True), np.setdiff1d(hub, x, assume_unique=True)
    if counts is not None:  # what few hold, and what of the hub many hold, few differences hold
        added = added[np.argsort(counts[counter(added, cfg)], kind="stable")]
        removed = removed[np.argsort(-counts[counter(removed, cfg)].astype(np.int64), kind="stable")]
    d = len(added) + len(removed)
    # distance allowed to any partner, whose set is at most den/num times as large
    s = (cfg.den - cfg.num) * len(x) // cfg.num
    least = max(1, d - s)  # tokens that the differences share at least
    if near:  # its partner is further from the hub than allowed; (den-num)/(den+num) is the distance allowed of both sizes
        least = max(least, -int(-d * cfg.num // (cfg.den + cfg.num)))
    return np.concatenate([added, removed])[: max(0, d - least + 1)]


def _stars(cfg: Near, counts):
    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, tokens = [], []
            for x, h in zip(batch.column("set"), batch.column("hset")):
                x, h = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(h.as_py(), np.uint64)
                near.append(linked(x, h, cfg))
                tokens.append(prefix(x, h, near[-1], cfg, counts.value).view(np.int64))
            # a row for the member itself, then one for each token
            each = np.repeat(np.arange(len(near)), [len(t) + 1 for t in tokens])
            own = np.concatenate([[True], each[1:] != each[:-1]]) if len(each) else np.zeros(0, bool)
            values = np.zeros(len(each), np.int64)
            values[~own] = np.concatenate(tokens) if tokens else values[~own]
            rows = batch.select(["hub", "rep"]).take(pa.array(each))
            yield pa.RecordBatch.from_arrays([rows.column("hub"), rows.column("rep"), pa.array(np.array(near, bool)[each], pa.bool_()), pa.array(values, pa.int64(), mask=own)], ["hub", "rep", "near", "token"])

    return stars


class Join:
    """The state of one run."""

    def __init__(self, docs: DataFrame, cfg: Near, text_col: str, id_col: str):
        self.spark, self.cfg, self.t = docs.sparkSession, cfg, Tables(docs.sparkSession, "near")
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sized(self, nodes: DataFrame, name: str) -> DataFrame:
        """nodes (path, rep, u) with their size, those of one member and those without a u left out."""
        size = self.t.write(nodes.groupBy("path").agg(F.count("*").alias("size"), F.max("u").alias("any_u")).filter("size > 1 and any_u").select("path", "size"), f"{name}-sizes")
        return self.t.write(nodes.join(size, "path").select("path", "rep", "size"), name)

    def grouped(self, nodes: DataFrame, label: DataFrame | None) -> DataFrame:
        """Small nodes with their members' labels and signatures; a list has at most some 8 * cfg.leaf members."""
        rows = nodes.select("path", "rep").join(self.members, "rep")
        extra = [c for c in self.members.columns if c != "rep"]
        if label is not None:
            rows = rows.join(label.select(F.col("v").alias("rep"), "root"), "rep", "left").select("path", "rep", *extra, F.coalesce("root", "rep").alias("label"))
        else:
            rows = rows.select("path", "rep", *extra, F.col("rep").alias("label"))
        rows = rows.groupBy("path").agg(F.collect_list(F.struct("rep", "label", *extra)).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        return rows.filter("lo <> hi").select("path", "m")

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        pairs = self.t.write(pairs.distinct(), f"{name}-pairs")
        side = lambda k: self.sets.select(F.col("rep").alias(k), F.col("set").alias(f"s{k}"))
        full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
        out = self.t.write(full.mapInArrow(_confirm(self.cfg), "a long, b long"), name)
        self.t.drop(pairs)
        self.t.tidy()
        return out

    def full_sets(self, reps: DataFrame) -> DataFrame:
        bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << self.cfg.bits))
        words = reps.select(bit(F.col("rep")).alias("bit")).groupBy(F.expr("bit div 32").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("x")).toPandas()
        table = np.zeros(1 << self.cfg.bits - 5, np.uint32)
        table[words["w"].to_numpy(np.int64)] = words["x"].to_numpy(np.int64).astype(np.uint32)
        sent = self.spark.sparkContext.broadcast(table.view(np.uint8))
        rows = self.docs.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), bit(F.col("doc_id"))).alias("bit"))
        return self.t.write(rows.mapInPandas(_sets(self.cfg, sent), "rep long, set binary"), "sets")

    def centres(self, big: DataFrame) -> DataFrame:
        """(path, hub): the member closest to the mode of a sample's signatures; any choice gives right results."""
        rows = self.t.write(big.join(self.classes.select("rep", "sig"), "rep").select("path", "rep", "size", "sig"), "big")
        some = rows.filter(F.expr("pmod(xxhash64(rep, path), cast(ceil(size / 256) as bigint)) = 0"))
        modes = some.groupBy("path").agg(F.collect_list(F.struct("sig")).alias("m")).mapInArrow(_modes(self.cfg), "path long, mode binary")
        modes = self.t.write(modes, "modes")
        k = self.cfg.coordinates

        @F.pandas_udf("int")
        def equal(a: pd.Series, b: pd.Series) -> pd.Series:
            if not len(a):
                return pd.Series([], dtype="int32")
            x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, k) for s in (a, b))
            return pd.Series((x == y).sum(axis=1).astype("int32"))

        scored = rows.join(modes, "path", "left").select("path", "rep", F.when(F.col("mode").isNull(), 0).otherwise(equal("sig", F.coalesce("mode", "sig"))).alias("e"))
        return self.t.write(scored.groupBy("path").agg(F.max(F.struct("e", (-F.col("rep")).alias("r"))).alias("x")).select("path", (-F.col("x.r")).alias("hub")), "hubs")

    def counts(self, sets: DataFrame):
        """The binary logarithms of tokens' counts in sets, in eighths, for each counter."""
        few = self.cfg.leaf // 8
        parts = sets.select("set").mapInArrow(_counts(self.cfg), "counter int, n long")
        # what few sets hold needs no order
        known = parts.groupBy("counter").agg(F.sum("n").alias("n")).filter(F.col("n") > few).select("counter", F.least(F.floor(F.log2("n") * 8), F.lit(255)).cast("short").alias("n")).toPandas()
        table = np.zeros(1 << self.cfg.counters, np.uint8)
        table[known["counter"].to_numpy(np.int64)] = known["n"].to_numpy(np.uint8)
        return self.spark.sparkContext.broadcast(table)

    def branch(self, nodes: DataFrame, sets: DataFrame, counts, level: int) -> tuple[DataFrame, DataFrame]:
        """Large nodes, of members with these sets, to links with their centres and child nodes."""
        hubs = self.centres(nodes)
        pairs = self.t.write(nodes.join(hubs, "path").filter("rep <> hub").select("hub", "rep").distinct(), f"star-pairs{level}")
        hub_sets = self.t.write(sets.join(pairs.select(F.col("hub").alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias("hub"), F.col("set").alias("hset")), f"hub-sets{level}")
        # members spread evenly: they lie as unevenly in the sets' files as near copies in the documents'
        rows = pairs.join(sets, "rep").repartition("rep").join(hub_sets, "hub").select("hub", "rep", "set", "hset")
        stars = self.t.write(rows.mapInArrow(_stars(self.cfg, counts), "hub long, rep long, near boolean, token long"), f"stars{level}")
        self.t.drop(pairs, hub_sets)
        self.t.tidy()
        links = stars.filter("near and token is null").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
        # nodes whose members are all near the centre need no children, which the sizes' filter on u sees to
        child = stars.filter("token is not null").select(_child_path("hub", "token", F.lit(level)).alias("path"), "rep", (~F.col("near")).alias("u"))
        return links, self.sized(child, f"children{level}")

    def blocks(self, nodes: DataFrame) -> DataFrame:
        """Large nodes to small ones (path, rep) in which any two of their members meet: one for each two blocks."""
        few = F.expr(f"cast(ceil(size / {3 * self.cfg.leaf}) as int)")
        rows = nodes.select("path", "rep", few.alias("n"), F.pmod(F.xxhash64("rep"), few).cast("int").alias("mine")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        return rows.filter("mine <> other").select(_child_path("path", F.least("mine", "other"), F.greatest("mine", "other")).alias("path"), "rep")

    def with_homes(self, nodes: DataFrame) -> DataFrame:
        """Members with `home`: the path of their small node in each tree, 0 for none."""
        small = nodes.groupBy("rep").agg(F.collect_list("path").alias("p"))
        of = lambda t: F.coalesce(F.try_element_at(F.filter("p", lambda p: p.bitwiseAND(int(_TREE)) == t), F.lit(1)), F.lit(0))
        none = F.array_repeat(F.lit(0).cast("long"), self.cfg.trees)
        home = F.coalesce(F.transform(F.sequence(F.lit(0), F.lit(self.cfg.trees - 1)), of), none)
        return self.t.write(self.classes.select("rep", "sig").join(small, "rep", "left").select("rep", "sig", home.alias("home")), "members")

    def trees(self) -> list[DataFrame]:
        """Nodes (path, rep, size) of two members or more, a table for each branching; those of more than a leaf's
        members are branched again in the next."""
        cfg, out = self.cfg, []
        rows = self.classes.select("rep", F.posexplode(F.slice("tokens", 1, cfg.trees)).alias("tree", "token"))
        rows = rows.select(_tree_path(F.col("tree"), F.col("token")).alias("path"), "rep", F.lit(True).alias("u"))
        for level in range(1, cfg.depth + 1):
            out.append(self.sized(rows, f"nodes{level}"))
            large = out[-1].filter(f"size > {cfg.leaf}")
            if level == cfg.depth or large.isEmpty():
                break
            tree = F.col("path").bitwiseAND(int(_TREE))
            token = F.element_at("tokens", (tree + level * cfg.trees + 1).cast("int"))
            rows = large.join(self.classes.select("rep", "tokens"), "rep").select(_tree_path(tree, F.col("path"), token).alias("path"), "rep", F.lit(True).alias("u"))
        return out

    def run(self) -> DataFrame:
        cfg, t = self.cfg, self.t
        sketches = t.write(self.docs.mapInPandas(_sketch(cfg), "doc_id long, n long, digest binary, alt long, sig binary, tokens array<int>"), "sketches")
        named = sketches.filter("digest is not null").select("digest", F.struct(F.coalesce("doc_id", "alt").alias("doc_id"), "sig", "tokens").alias("x"))
        classes = named.groupBy("digest").agg(F.min("x").alias("x")).select("digest", F.col("x.doc_id").alias("rep"), "x.sig", "x.tokens")
        self.classes = t.write(classes, "classes")
        levels = self.trees()
        last = levels[-1].filter(f"size > {cfg.leaf}") if len(levels) == cfg.depth else levels[-1].filter("false")
        leaves = levels[0].filter(f"size <= {cfg.leaf}")
        for nodes in levels[1:]:
            leaves = leaves.union(nodes.filter(f"size <= {cfg.leaf}"))
        members = leaves.select("path", "rep").join(self.classes.select("rep", "sig"), "rep").groupBy("path").agg(F.collect_list(F.struct("rep", "sig")).alias("m"))
        leaves = t.write(members.mapInArrow(_likely(cfg), "path long, rep long"), "leaves")
        t.tidy()
        self.sets = self.full_sets(leaves.select("rep").union(last.select("rep")).distinct())
        t.tidy()
        self.members = self.with_homes(leaves) if cfg.once else self.classes.select("rep", "sig")
        links, large, level = None, last, 0
        if not large.isEmpty():
            sets = t.write(self.sets.join(last.select("rep").distinct(), "rep", "left_semi"), "large-sets")
            t.tidy()
            counts = self.counts(sets)
        while not large.isEmpty():
            more, children = self.branch(large, sets, counts, level)
            links = more if links is None else links.union(more)
            leaves = leaves.union(children.filter(f"size <= {8 * cfg.leaf}").select("path", "rep"))
            large, level = children.filter(f"size > {8 * cfg.leaf}"), level + 1
            if level == cfg.levels:
                if not large.isEmpty():
                    leaves = leaves.union(t.write(self.blocks(large), "blocks"))
                break
        label = components(links, t) if links is not None else None
        first = self.confirmed(self.grouped(leaves, label).mapInArrow(_candidates(cfg, True), "a long, b long"), "first")
        links = first if links is None else links.union(first)
        label = components(links, t)
        rest = self.confirmed(self.grouped(leaves, label).mapInArrow(_candidates(cfg, False), "a long, b long"), "rest")
        if not rest.isEmpty():
            label = components(links.union(rest), t)
        root = self.classes.select("digest", "rep").join(label.select(F.col("v").alias("rep"), "root"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("root"))
        root = t.write(root, "roots")
        t.keep(sketches, root)
        out = sketches.select("doc_id", "n", "digest").join(root, "digest", "left")
        out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
        out = out.withColumn("component_id", F.when(F.col("component_id") < NAMELESS, F.col("component_id")))
        return out.withColumn("kept", F.expr("doc_id <=> component_id"))


def near_duplicates(docs: DataFrame, cfg: Near | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    return Join(docs, cfg or Near(), text_col, id_col).run()


def drop_near_duplicates(docs: DataFrame, cfg: Near | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, that name their component; of rows that repeat a doc_id one
    stays.  Rows without a doc_id stay, as nothing can name them."""
    tables = Tables(docs.sparkSession, "near")
    # a row goes along as one struct, so that no name of its columns meets one used here
    rows = docs.select(F.struct("*").alias("doc")).select("doc", F.col("doc.doc_id").alias("id"))
    gone = tables.write(near_duplicates(docs, cfg).filter("not kept").select(F.col("doc_id").alias("id")).distinct(), "gone")
    stay = rows.join(gone, "id", "left_anti")
    again = tables.write(rows.filter("id is not null").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "again")
    if again.isEmpty():
        return stay.select("doc.*")
    once = stay.join(again, "id", "left_semi").groupBy("id").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return stay.join(again, "id", "left_anti").select("doc.*").unionByName(once.select("doc.*"))

"""The market catalog: compaction of raw rows, upsert, cursors, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalstream.functions.columns import U64, hex_bytes, lenient_list
from opalstream.functions.keccak import u256_list
from opalstream.operators import rules
from opalstream.shared import materialised
from opalstream.sources.manifest import Table

RAW_SCHEMA = "id string, updatedAt string, conditionId string, clobTokenIds string, tags array<struct<id:string>>, events array<struct<tags:array<struct<id:string>>>>, negRisk boolean, sportsMarketType string, question string"


def tag_union(tags: Column, events: Column) -> Column:
    """Sorted distinct tag ids of a market and its events; what isn't a number is left out."""
    ids = F.concat(F.coalesce(tags["id"], F.expr("cast(array() as array<string>)")), F.coalesce(F.flatten(F.transform(events, lambda e: F.coalesce(e["tags"]["id"], F.expr("cast(array() as array<string>)")))), F.expr("cast(array() as array<string>)")))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(ids, lambda x: x.try_cast("int")))))


def compact(raw: DataFrame) -> DataFrame:
    """Raw rows to market rows, each on its own (pages overlap, so rows repeat); a bad id, condition or token drops
    the row.  Both forms of the token list are read."""
    tokens = lenient_list(F.col("clobTokenIds")) if dict(raw.dtypes)["clobTokenIds"] == "string" else F.coalesce("clobTokenIds", F.expr("cast(array() as array<string>)"))
    rows = raw.select(
        F.col("id").try_cast(U64).alias("market_id"), hex_bytes(F.col("conditionId"), 32).alias("condition_id"), tokens.alias("tokens"), tag_union(F.col("tags"), F.col("events")).alias("tag_ids"),
        F.coalesce("negRisk", F.lit(False)).alias("neg_risk"), "sportsMarketType", "question", F.col("updatedAt").alias("updated_at"),
    ).filter("market_id is not null and condition_id is not null and tokens is not null")
    back = rows.withColumn("token_ids", u256_list(F.col("tokens"))).filter(~F.exists("token_ids", lambda b: b.isNull()))
    kind = rules.category(F.col("tag_ids"), F.col("question"))
    back = back.withColumn("category", kind)
    return back.withColumn("bet_type", rules.bet_type(F.col("category"), F.col("tag_ids"), F.col("sportsMarketType"), F.col("question"))).select("market_id", "condition_id", "token_ids", "tag_ids", "category", "bet_type", "neg_risk", "updated_at")


def newest_rows(rows: DataFrame, key: str, content: list[str]) -> DataFrame:
    """One row a key: pages overlap, so a walk lists a market more than once.  The last by updated_at counts, where there is
    such a column; of several of that time, or without it, the largest by content."""
    order = F.struct(*(["updated_at"] if "updated_at" in rows.columns else []), *content)
    return rows.groupBy(key).agg(F.max_by(F.struct(*content), order).alias("_n")).select(key, "_n")


def upsert(catalog: DataFrame, incoming: DataFrame, key: str, content: list[str], day: Column) -> DataFrame:
    """catalog (key, content, seen_day; a row a key) with incoming (key, content, maybe updated_at): equal content only
    moves seen_day on, to the later; other content replaces the row and sets seen_day to `day`.  A key that comes more
    than once counts once, by its newest row."""
    new = newest_rows(incoming, key, content)
    old = catalog.select(key, F.struct(*content).alias("_o"), "seen_day")
    both = old.join(new, key, "full_outer")
    row = F.coalesce("_n", "_o")
    seen = F.when(F.col("_n").isNull(), F.col("seen_day")).when(F.col("_o").isNull() | ~F.col("_n").eqNullSafe(F.col("_o")), day).otherwise(F.greatest("seen_day", day))
    return both.select(key, row.alias("_r"), seen.alias("seen_day")).select(key, *[F.col(f"_r.{c}").alias(c) for c in content], "seen_day")


def merge_catalog(table: Table, incoming: DataFrame, key: str, content: list[str], day: int, buckets: int = 64, **cursor) -> int:
    """upsert into a stored catalog, and the cursor with it: only buckets of keys whose row changes, or is seen on a later
    day, are written again.  Returns how many buckets were."""
    state = table.state()
    new = newest_rows(incoming, key, content)
    if state["schema"] is not None:
        old = table.read(state).select(key, F.struct(*content).alias("_o"), "seen_day")
        same = F.col("_o").eqNullSafe(F.col("_n")) & (F.coalesce("seen_day", F.lit(-1)) >= day)
        new = new.join(old, key, "left").filter(~F.coalesce(same, F.lit(False)))
    new = materialised(new.select(key, *[F.col(f"_n.{c}").alias(c) for c in content]), "changes")

    def update(current: DataFrame | None, changes: DataFrame) -> DataFrame:
        if current is None:
            return changes.withColumn("seen_day", F.lit(day))
        return upsert(current, changes, key, content, F.lit(day))

    return table.merge(new, key, buckets, update, **cursor)


def reconcile(catalog: DataFrame, listed: DataFrame, key: str, content: list[str], walk_day: int, retention: int, last_fresh: int = 0) -> tuple[DataFrame, DataFrame]:
    """The catalog after a full walk of all markets, and one row of what it did: fresh (markets the walk listed), gaps
    (markets the incremental passes had missed), changed, evicted.  Cursors aren't touched."""
    new = newest_rows(listed, key, content)
    old = catalog.select(key, F.struct(*content).alias("_o"))
    both = new.join(old, key, "left").select((F.col("_o").isNull()).alias("_gap"), (F.col("_o").isNotNull() & ~F.col("_o").eqNullSafe(F.col("_n"))).alias("_changed"))
    did = both.agg(F.count("*").alias("fresh"), F.count_if("_gap").alias("gaps"), F.count_if("_changed").alias("changed"))
    fresh = did.first()["fresh"]
    merged = upsert(catalog, listed, key, content, F.lit(walk_day))
    kept = evict(merged, walk_day, retention, fresh, last_fresh)
    gone = merged.agg(F.count("*").alias("_all")).crossJoin(F.broadcast(kept.agg(F.count("*").alias("_kept"))))  # a row each
    return kept, did.crossJoin(F.broadcast(gone)).select("fresh", "gaps", "changed", (F.col("_all") - F.col("_kept")).alias("evicted"))


def evict(catalog: DataFrame, today: int, retention: int, fresh: int | None = None, last_fresh: int = 0) -> DataFrame:
    """Rows seen since today - retention.  Rows without a day count as seen retention - 2 days ago, future ones as today;
    nothing goes if retention is 0 or the last pass saw fewer rows than half of the one before."""
    day = F.least(F.coalesce("seen_day", F.lit(today - (retention - 2))), F.lit(today))
    rows = catalog.withColumn("seen_day", day)
    if retention == 0 or (fresh is not None and fresh < max(1, last_fresh // 2)):
        return rows
    return rows.filter(F.col("seen_day") >= today - retention)


def incremental(rows: DataFrame, updated: str, market_id: str, cursor: str, boundary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows not older than the cursor (texts compared) nor the boundary, and the new cursor (updated, market_id).

    Rows of the cursor's own time are read again: writes are idempotent."""
    new = rows.filter(F.col(updated) >= cursor)
    if boundary is not None:
        new = new.filter(F.col(updated) >= boundary)
    top = new.agg(F.max(F.struct(updated, market_id)).alias("x")).select(F.coalesce(f"x.{updated}", F.lit(cursor)).alias(updated), F.col(f"x.{market_id}").alias(market_id))
    return new, top


def newest_ids(rows: DataFrame, market_id: str, known_max: int, page: int = 100, pages: int = 5) -> DataFrame:
    """Rows with larger ids than known, the newest first, at most `pages` pages."""
    return rows.filter(F.col(market_id) > known_max).orderBy(F.col(market_id).desc()).limit(page * pages)


def backfill_start(blocks: DataFrame, checkpoint: int | None, start_block: int | None, days: int = 7) -> DataFrame:
    """start: the checkpoint (inclusive), else the configured block, else the first block of the last days; blocks (number, at in seconds)."""
    head = blocks.agg(F.max("at").alias("_head"))
    edge = blocks.crossJoin(F.broadcast(head)).filter(F.col("at") >= F.col("_head") - days * 86_400).agg(F.min("number").alias("_edge"))  # head: one row
    return edge.select(F.coalesce(F.lit(checkpoint).cast("long"), F.lit(start_block).cast("long"), "_edge").alias("start"))


def first_block_since(blocks: DataFrame, at: int) -> DataFrame:
    return blocks.filter(F.col("at") >= at).agg(F.min("number").alias("number"))


def stall_verdict(covered: DataFrame, number: str, verified: int, head: int, behind: int = 5) -> DataFrame:
    """missed, verdict: rows of the source in (verified, head - behind] that this side hasn't seen."""
    n = covered.filter((F.col(number) > verified) & (F.col(number) <= head - behind)).agg(F.count("*").alias("missed"))
    return n.withColumn("verdict", F.when(F.col("missed") > 0, "Missed").otherwise("Quiet"))


def stall_checks(sessions: DataFrame, logs: DataFrame, number: str, head: int, now_us: int, idle_us: int = 60_000_000, behind: int = 5, max_window: int = 1000) -> DataFrame:
    """source, verdict, first, last, logs of each session that has been idle for idle_us: whether logs lie in the blocks
    that it should have delivered, up to `behind` blocks before the head and max_window of them at most.

    sessions (source, verified, last_us), a row for each configured endpoint.  A session without a verified block has
    nothing to be compared with: it is quiet, up to `last`, from where the next check goes on."""
    to = F.lit(head - behind)
    idle = sessions.filter(F.lit(now_us) - F.col("last_us") >= idle_us)
    first = F.when(F.col("verified") < to, F.greatest(F.col("verified") + 1, to - (max(max_window, 1) - 1)))
    idle = idle.withColumn("first", first)
    counts = logs.filter((F.col(number) <= to)).groupBy(F.col(number).alias("_number")).agg(F.count("*").alias("_n"))
    seen = idle.select("source", "first").filter("first is not null").join(counts, F.col("_number") >= F.col("first")).groupBy("source").agg(F.sum("_n").alias("logs"))
    out = idle.join(seen, "source", "left").withColumn("logs", F.coalesce("logs", F.lit(0)))
    quiet = F.col("logs") == 0
    return out.select("source", F.when(quiet, "Quiet").otherwise("Missed").alias("verdict"), "first", F.when(quiet, F.greatest(to, F.coalesce("verified", F.lit(0)))).otherwise(to).alias("last"), "logs")

"""The event pipeline: first-arrival dedup, enrichment, filters and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: list[str], arrival: list[str]) -> DataFrame:
    """The first row of each key in order of arrival: one aggregate, combined before the shuffle.  Of rows that arrive
    together the least by the other columns is first, in their order; maps, which have no order, aren't compared."""
    ties = [n for n, t in df.dtypes if n not in key and n not in arrival and "map<" not in t and "variant" not in t]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*[c for c in df.columns if c not in key]), F.struct(*arrival, *ties)).alias("_x"))
    return best.select(*[F.col(c) if c in key else F.col(f"_x.{c}").alias(c) for c in df.columns])


def source_race(df: DataFrame, key: list[str], arrival: list[str], source: str) -> DataFrame:
    """source, received, won: every delivery counts as received, the first of a key as won."""
    won = first_wins(df.select(*dict.fromkeys([*key, *arrival, source])), key, arrival).groupBy(source).agg(F.count("*").alias("won"))
    got = df.groupBy(source).agg(F.count("*").alias("received"))
    return got.join(won, source, "left").select(source, "received", F.coalesce("won", F.lit(0)).alias("won"))


def enrich(events: DataFrame, by_id: DataFrame, id_col: str, by_condition: DataFrame, condition_col: str) -> DataFrame:
    """Adds `market`, a struct of the first table's columns but the key, else the second's, and `via`.

    by_id and by_condition have unique keys, named as the events'.  The struct is taken whole: columns of the two
    are never mixed.
    """
    a = by_id.select(id_col, F.struct(*[c for c in by_id.columns if c != id_col]).alias("_a"))
    b = by_condition.select(condition_col, F.struct(*[c for c in by_condition.columns if c != condition_col]).alias("_b"))
    out = events.join(a, id_col, "left").join(b, condition_col, "left")
    via = F.when(F.col("_a").isNotNull(), "id").when(F.col("_b").isNotNull(), "condition").otherwise("miss")
    return out.withColumn("market", F.coalesce("_a", "_b")).withColumn("via", via).drop("_a", "_b")


def id_aliases(upserts: DataFrame, market_id: str, condition: str, order: list[str]) -> DataFrame:
    """market_id, condition: the last write of each id; an id that its condition has left still leads there."""
    return upserts.groupBy(market_id).agg(F.max_by(condition, F.struct(*order)).alias(condition))


def allowed(df: DataFrame, emitters: DataFrame, col: str, empty_accepts_all: bool = True) -> DataFrame:
    """Rows of listed emitters; all of them if the list is empty."""
    if empty_accepts_all and emitters.isEmpty():
        return df
    return df.join(emitters.select(col).distinct(), col, "left_semi")


def off_list(df: DataFrame, emitters: DataFrame, col: str) -> DataFrame:
    return df.join(emitters.select(col).distinct(), col, "left_anti")


def resolved_condition(listed: Column, derived: Column) -> Column:
    """A market's condition: the catalog's, else the one derived from the request."""
    return F.coalesce(listed, derived)


def delivery_counters(df: DataFrame, source: str, key: list[str], arrival: list[str], error: str, foreign: Column, hit: Column) -> DataFrame:
    """Per source: logs received, decoded, decode_errors, foreign (decoded, but not for this service), duplicates
    (keys that came before, from any source), accepted, hits and misses.

    A delivery with an error text stops there, a foreign one next; of the others the first of a key is accepted."""
    rows = df.withColumn("_error", F.col(error).isNotNull()).withColumn("_foreign", ~F.col("_error") & F.coalesce(foreign, F.lit(False))).withColumn("_hit", F.coalesce(hit, F.lit(False)))
    rows = rows.withColumn("_event", ~F.col("_error") & ~F.col("_foreign"))
    won = first_wins(rows.filter("_event").select(*dict.fromkeys([*key, *arrival, source]), "_hit"), key, arrival)
    won = won.groupBy(source).agg(F.count("*").alias("accepted"), F.count_if("_hit").alias("hits"))
    out = rows.groupBy(source).agg(F.count("*").alias("received"), F.count_if(~F.col("_error")).alias("decoded"), F.count_if("_error").alias("decode_errors"), F.count_if("_foreign").alias("foreign"), F.count_if("_event").alias("_events"))
    out = out.join(won, source, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("accepted", "hits")})
    return out.select(source, "received", "decoded", "decode_errors", "foreign", (F.col("_events") - F.col("accepted")).alias("duplicates"), "accepted", "hits", (F.col("accepted") - F.col("hits")).alias("misses"))


def first_leads(a: DataFrame, b: DataFrame, key: list[str], at_a: str, at_b: str) -> DataFrame:
    """key, lead: how long after a's first row b's first one came, either order; null where one has none."""
    x, y = a.groupBy(*key).agg(F.min(at_a).alias("_a")), b.groupBy(*key).agg(F.min(at_b).alias("_b"))
    return x.join(y, key, "full_outer").select(*key, (F.col("_b") - F.col("_a")).alias("lead"))


def look_up_chain(rows: DataFrame, tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """rows with columns of one dimension after the other: (table, its key, the column that names it); misses are null."""
    for table, key, name in tables:
        rows = rows.join(table, rows[name] == table[key], "left")
    return rows


def set_union(rows: DataFrame, key: list[str], sets: Column, name: str) -> DataFrame:
    """key, name: the sorted distinct entries of all its rows' arrays, combined before the shuffle."""
    each = rows.select(*key, F.explode(sets).alias("_x")).groupBy(*key).agg(F.collect_set("_x").alias("_s"))
    return each.select(*key, F.array_sort("_s").alias(name))


def off_list_tally(df: DataFrame, emitter: str, hit: Column, arrival: list[str], requester: str, most: int = 64) -> DataFrame:
    """Per emitter, the first `most` to appear: events, hits, first and last arrival, last requester, last hit's requester."""
    at = F.struct(*arrival)
    out = df.groupBy(emitter).agg(
        F.count("*").alias("events"), F.count_if(hit).alias("hits"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"),
        F.max_by(requester, at).alias("last_requester"), F.max_by(requester, F.when(hit, at)).alias("last_hit"),
    )
    return out.orderBy("first_seen", emitter).limit(most)


def flag_blocked(events: DataFrame, blocklist: DataFrame, condition: str, received: str, added: str) -> DataFrame:
    """Adds stored (true), enriched rows' broadcast unless blocked, blocked and blocked_before (listed when received)."""
    listed = blocklist.groupBy(condition).agg(F.min(added).alias("_added"))
    out = events.join(listed, condition, "left")
    out = out.withColumn("blocked", F.col("_added").isNotNull()).withColumn("blocked_before", F.coalesce(F.col("_added") <= F.col(received), F.lit(False)))
    return out.drop("_added")


def broadcast_flags(df: DataFrame, enriched: Column, blocked: Column) -> DataFrame:
    """All rows are stored; misses and blocked ones aren't broadcast."""
    return df.withColumn("stored", F.lit(True)).withColumn("broadcast", enriched & ~blocked)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Output projection: nulls of a miss become the column's default."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v) if not isinstance(v, Column) else v) for c, v in defaults.items()})


def first_share(df: DataFrame, key: list[str], source: str, at: str) -> DataFrame:
    """Per source: deliveries, firsts, share of keys it was first at, mean lag behind the first."""
    first = Window.partitionBy(*key)
    rows = df.withColumn("_lag", F.col(at) - F.min(at).over(first))
    out = rows.groupBy(source).agg(F.count("*").alias("seen"), F.count_if(F.col("_lag") == 0).alias("first"), F.avg("_lag").alias("mean_lag"))
    return out.withColumn("first_share", F.col("first") / F.col("seen"))


def tie_credit(df: DataFrame, key: list[str], source: str, at: str, tie: int) -> DataFrame:
    """Per source: 1/k for each key where it is one of the k sources within `tie` of the first."""
    each = df.groupBy(*key, source).agg(F.min(at).alias("_at"))
    near = each.withColumn("_first", F.min("_at").over(Window.partitionBy(*key))).filter(F.col("_at") - F.col("_first") <= tie)
    near = near.withColumn("_k", F.count("*").over(Window.partitionBy(*key)))
    return near.groupBy(source).agg(F.sum(1.0 / F.col("_k")).alias("credit"), F.count("*").alias("rounds"))


def decayed_share(df: DataFrame, source: str, at: str, won: Column, now: Column, half_life: float) -> DataFrame:
    """Per source: weight of its wins over that of all its rows, halved every half_life."""
    w = F.pow(F.lit(0.5), (now - F.col(at)) / half_life)
    out = df.groupBy(source).agg(F.sum(w * won.cast("int")).alias("won_weight"), F.sum(w).alias("weight"))
    return out.withColumn("share", F.try_divide("won_weight", "weight"))

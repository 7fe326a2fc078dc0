"""Node status, load balance, alert predicates and token accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("Stale", "Relay", "Disabled", "Draining", "NotReady", "Full", "Serving")


def status(now: Column, stale_after: int) -> Column:
    """Of a node row (last_seen, relay, disabled, desired_drain, draining, ready, clients, max_clients): the first that holds."""
    return (
        F.when(now - F.col("last_seen") > stale_after, "Stale")
        .when(F.col("relay"), "Relay")
        .when(F.col("disabled"), "Disabled")
        .when(F.col("desired_drain") | F.col("draining"), "Draining")
        .when(~F.col("ready"), "NotReady")
        .when(F.col("clients") >= F.col("max_clients"), "Full")
        .otherwise("Serving")
    )


def balance_excess(nodes: DataFrame, spread_pct: int = 20) -> DataFrame:
    """nodes (node_id, status, clients, max_clients) with excess: clients above the emptiest serving node's plus
    spread, at most half the gap and what the other serving nodes can take; 0 unless serving or full."""
    serving = F.col("status") == "Serving"
    room = F.greatest(F.col("max_clients") - F.col("clients"), F.lit(0))
    total = nodes.agg(F.coalesce(F.min(F.when(serving, F.col("clients"))), F.lit(0)).alias("_low"), F.coalesce(F.sum(F.when(serving, room)), F.lit(0)).alias("_room"))
    out = nodes.crossJoin(F.broadcast(total))  # one row
    spare = F.col("_room") - F.when(serving, room).otherwise(0)
    over = F.floor(F.col("clients") - F.col("_low").cast("double") * (1 + spread_pct / 100)).cast("long")
    half = F.floor(F.greatest(F.col("clients") - F.col("_low"), F.lit(0)) / 2).cast("long")
    excess = F.when(serving | (F.col("status") == "Full"), F.when(spare > 0, F.least(over, half, spare)).otherwise(0)).otherwise(0)
    return out.withColumn("excess", excess.cast("long")).drop("_low", "_room")


def busiest(nodes: DataFrame) -> DataFrame:
    """The serving or full node with most clients, the smallest id of such: an aggregate, no sort."""
    best = F.max(F.struct("clients", F.expr("-rank_of_id").alias("r"))) if "rank_of_id" in nodes.columns else None
    rows = nodes.filter(F.col("status").isin("Serving", "Full"))
    if best is not None:
        return rows.agg(best.alias("x")).select(F.col("x.clients"), (-F.col("x.r")).alias("rank_of_id"))
    return rows.orderBy(F.col("clients").desc(), "node_id").limit(1).select("node_id", "clients")


def release_decision(nodes: DataFrame, batch: int = 20, min_excess: int = 5, auto: bool = True) -> DataFrame:
    """nodes (node_id, status, pending_release, desired_drain, excess) with release and reason: manual first, then the busiest alone."""
    top = F.broadcast(busiest(nodes).select(F.col("node_id").alias("_top")))  # one row at most
    out = nodes.join(top, F.col("node_id") == F.col("_top"), "left")
    automatic = F.lit(auto) & ~F.col("desired_drain") & F.col("_top").isNotNull() & (F.col("excess") >= min_excess)
    n = F.when(F.col("pending_release") > 0, F.least("pending_release", F.lit(batch))).when(automatic, F.least("excess", F.lit(batch))).otherwise(0)
    why = F.when(F.col("pending_release") > 0, "manual").when(automatic, "auto-balance").otherwise("")
    return out.withColumn("release", n.cast("long")).withColumn("reason", why).drop("_top")


def node_list(nodes: DataFrame, spread_pct: int = 20, seed: int | None = None) -> DataFrame:
    """Serving nodes with weight, band and place: those nearly as empty as the emptiest first, in random order
    (by id without a seed), then by clients, weight descending, id."""
    rows = nodes.filter(F.col("status") == "Serving").withColumn("weight", F.greatest(F.col("max_clients") - F.col("clients"), F.lit(1)))
    low = rows.agg(F.min("clients").alias("_low"))
    rows = rows.crossJoin(F.broadcast(low))
    band = (F.col("clients") > F.col("_low") + F.expr(f"_low * {spread_pct} div 100")).cast("int")
    shuffled = F.col("node_id") if seed is None else F.xxhash64("node_id", F.lit(seed))
    rows = rows.withColumn("band", band)
    inside = F.when(F.col("band") == 0, F.lit(0))
    # the list of nodes of a service: a few thousand rows
    w = Window.orderBy("band", F.coalesce(inside, F.col("clients")), F.coalesce(inside, -F.col("weight")), shuffled if seed is None else F.when(F.col("band") == 0, shuffled), "node_id")
    return rows.withColumn("place", F.row_number().over(w)).drop("_low")


def token_usage(nodes: DataFrame, tokens: DataFrame, clients: str = "clients_by_token", token: str = "token_id") -> DataFrame:
    """token, clients over all nodes' maps, 0 where nobody uses it."""
    used = nodes.select(F.explode(clients).alias(token, "_n")).groupBy(token).agg(F.sum("_n").alias("_n"))
    return tokens.select(token).distinct().join(used, token, "left").select(token, F.coalesce("_n", F.lit(0)).alias("clients"))


def grants(tokens: DataFrame) -> DataFrame:
    """Enabled tokens: id, version, the first six characters of the secret."""
    return tokens.filter("enabled").select("token_id", "version", F.substring("secret", 1, 6).alias("prefix"))


def rate_alert(rows: DataFrame, key: str, hit: Column, min_hits: int = 5, percent: int = 50) -> DataFrame:
    """key, events, hits of keys with hits >= min_hits and hits * 100 >= events * percent."""
    out = rows.groupBy(key).agg(F.count("*").alias("events"), F.count_if(hit).alias("hits"))
    return out.filter((F.col("hits") >= min_hits) & (F.col("hits") * 100 >= F.col("events") * percent))


def percent_alert(hits: Column, rows: Column, least_rows: int = 200, below: int = 95) -> Column:
    """Whether the share of hits is too low, judged only over enough rows."""
    return (rows >= least_rows) & (hits * 100 < rows * below)


# Rules over the upstream snapshot: name, severity, hold in seconds, condition.
UPSTREAM_RULES = [
    ("rpc_disconnected", "critical", 30, "NOT rpc_connected"),
    ("rpc_sources_degraded", "warning", 300, "rpc_sources > 0 AND rpc_sources < rpc_configured"),
    ("rpc_reconnects", "warning", 0, "inc_reconnects_30m >= 6"),
    ("upstream_silent", "critical", 0, "last_event_ms > 0 AND now_ms - last_event_ms >= 1200000"),
    ("enrichment_recent_low", "warning", 0, "recent_rows >= 200 AND recent_hits * 100 < recent_rows * 95"),
    ("enrichment_misses", "warning", 0, "inc_misses_1h >= 30"),
    ("decode_errors", "warning", 0, "inc_decode_errors_1h >= 30"),
    ("slow_clients", "warning", 0, "inc_slow_10m >= 3"),
    ("cursor_rejected", "warning", 0, "inc_cursor_rejected_10m >= 10"),
    ("storage_dropped", "critical", 0, "inc_storage_dropped_10m >= 1"),
    ("catalog_small", "warning", 300, "markets < 200000"),
]
# Rules over each node; a stale node is judged no further.
NODE_RULES = [
    ("edge_upstream_down", "critical", 60, "NOT upstream_connected"),
    ("edge_sequence_lag", "warning", 60, "latest_sequence > 0 AND node_sequence > 0 AND latest_sequence - node_sequence >= 20"),
    ("edge_link_lag", "warning", 60, "link_lag_ms >= 1000 AND now_ms - last_frame_ms <= 120000"),
    ("edge_churn", "warning", 0, "inc_accepted_1h >= 800"),
    ("edge_slow_clients", "warning", 0, "inc_slow_10m >= 20"),
    ("edge_bad_frames", "warning", 0, "inc_bad_frames_10m >= 1"),
    ("edge_near_full", "warning", 300, "max_clients > 0 AND clients * 100 >= max_clients * 95"),
]
SERVING_RULE = ("cluster_serving_low", "critical", 60, 1)
FEED_RULE = ("panel_feed_down", "warning", 300)
UNREACHABLE_RULE = ("upstream_unreachable", "critical", 60)
STALE_RULE = ("edge_stale", "critical", 30)


def findings(rows: DataFrame, subject: Column, rules: list[tuple[str, str, int, str]]) -> DataFrame:
    """rule, severity, hold_s, subject of each condition that holds: one pass over the rows."""
    each = [F.when(F.expr(test), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.lit(h).alias("hold_s"))) for n, s, h, test in rules]
    return rows.select(subject.cast("string").alias("subject"), F.explode(F.array_compact(F.array(*each))).alias("x")).select("x.rule", "x.severity", "x.hold_s", "subject")


def evaluate(upstream: DataFrame, nodes: DataFrame, emitters: DataFrame, feed_connected: bool) -> DataFrame:
    """All findings.  upstream: one row with `fresh`; nodes with status; emitters (emitter, inc_hits_1h, inc_events_1h).

    Rules over an upstream that isn't fresh aren't evaluated, which must not resolve their alerts."""
    fresh = upstream.filter("fresh")
    out = findings(fresh, F.lit(""), UPSTREAM_RULES)
    name, severity, hold = UNREACHABLE_RULE
    out = out.unionByName(findings(upstream.filter("NOT fresh"), F.lit(""), [(name, severity, hold, "true")]))
    out = out.unionByName(findings(emitters.join(fresh.select(F.lit(1).alias("_f")), how="left_semi"), F.col("emitter"), [("off_list_emitter", "critical", 0, "inc_hits_1h >= 5 AND inc_hits_1h * 100 >= inc_events_1h * 50")]))
    live = nodes.filter("status <> 'Disabled'")
    name, severity, hold = STALE_RULE
    out = out.unionByName(findings(live.filter("status = 'Stale'"), F.col("node_id"), [(name, severity, hold, "true")]))
    out = out.unionByName(findings(live.filter("status <> 'Stale'"), F.col("node_id"), NODE_RULES))
    name, severity, hold, least = SERVING_RULE
    out = out.unionByName(findings(nodes.agg(F.count_if(F.col("status") == "Serving").alias("n")), F.lit(""), [(name, severity, hold, f"n < {least}")]))
    name, severity, hold = FEED_RULE
    return out if feed_connected else out.unionByName(findings(nodes.sparkSession.range(1), F.lit(""), [(name, severity, hold, "true")]))


def alert_view(alerts: DataFrame) -> DataFrame:
    """Firing first, then severity, rule, subject."""
    return alerts.orderBy(F.col("firing").desc(), F.when(F.col("severity") == "critical", 0).otherwise(1), "rule", "subject")


def alert_sections(alerts: DataFrame) -> DataFrame:
    """severity, rule, subjects (sorted), n."""
    return alerts.groupBy("severity", "rule").agg(F.array_sort(F.collect_set("subject")).alias("subjects"), F.count("*").alias("n"))


def due(alerts: DataFrame, now: Column, repeat_after: int) -> DataFrame:
    """Firing alerts to be sent: never notified, or not for repeat_after."""
    return alerts.filter("firing").filter(F.col("notified_at").isNull() | (now - F.col("notified_at") >= repeat_after))


def restarts(beats: DataFrame) -> DataFrame:
    """Heartbeats (node_id, at, started_at, relay) with restarted: started_at differs from the last one, which isn't 0; clears a drain unless a relay."""
    w = Window.partitionBy("node_id").orderBy("at")
    last = F.lag("started_at").over(w)
    out = beats.withColumn("restarted", F.coalesce((last != 0) & (last != F.col("started_at")), F.lit(False)))
    return out.withColumn("clears_drain", F.col("restarted") & ~F.col("relay"))


def registry(rows: DataFrame) -> DataFrame:
    """node_id, at, restarted, desired_drain for each row (node_id, at, started_at, relay, drain): a heartbeat (drain null)
    or a command to drain or not.  A restart, and any heartbeat of a relay, ends a drain."""
    w = Window.partitionBy("node_id").orderBy("at", "drain", "started_at", "relay").rowsBetween(Window.unboundedPreceding, -1)
    beat = F.col("drain").isNull()
    last = F.last(F.when(beat, F.struct("started_at")), ignorenulls=True).over(w)["started_at"]
    out = rows.withColumn("restarted", beat & F.coalesce(last != 0, F.lit(False)) & ~last.eqNullSafe(F.col("started_at")))
    effect = F.coalesce("drain", F.when(F.col("restarted") | F.coalesce("relay", F.lit(False)), F.lit(False)))
    drained = F.last(effect, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.select("node_id", "at", "restarted", F.coalesce(drained, F.lit(False)).alias("desired_drain"))

"""Queries on the driver's tables: each applies operators to whole tables and has SQL that gives the same rows.

Roles: events is the log stream (event_type its source, (user_id, day) the event key, (at, event_id) the order of
arrival), customers of the BUILDING segment and suppliers are the market dimension, orders are rounds of a request
(o_custkey), suppliers with a balance above 0 are the allow-list.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalstream.functions import columns as C
from opalstream.operators import analytics, catalog, console, events, gate, ordered, rules, scans, trailing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Data:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @property
    def log(self) -> DataFrame:
        at = C.micros(F.col("ts"))
        return self.events.select("event_id", at.alias("at"), "user_id", "event_type", "value", "props", C.day_number(at).alias("day"))

    @property
    def rounds(self) -> DataFrame:
        return self.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", C.micros(F.col("o_orderdate")).alias("at"))

    @property
    def emitters(self) -> DataFrame:
        return self.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))

    @property
    def nodes(self) -> DataFrame:
        """Suppliers as nodes, with their number of line items as clients."""
        load = self.lineitem.groupBy(F.col("l_suppkey").alias("node_id")).agg(F.count("*").alias("clients"))
        n = self.supplier.select(F.col("s_suppkey").alias("node_id"), F.col("s_nationkey").alias("k"))
        n = n.join(load, "node_id", "left").withColumn("clients", F.coalesce("clients", F.lit(0)))
        n = n.withColumns({
            "max_clients": F.lit(600) + F.col("k") * 2, "last_seen": F.when(F.col("node_id") % 11 == 0, 0).otherwise(90), "relay": F.col("node_id") % 13 == 0, "disabled": F.col("node_id") % 17 == 0,
            "desired_drain": F.col("node_id") % 19 == 0, "draining": F.col("node_id") % 23 == 0, "ready": F.col("node_id") % 29 != 0, "pending_release": F.when(F.col("node_id") % 7 == 0, F.col("node_id")).otherwise(0).cast("long"),
        })
        return n.withColumn("status", console.status(F.lit(100), 15))


#: The same in SQL.
LOG = "(select event_id, epoch_us(ts) as at, user_id, event_type, value, props, epoch_us(ts) // 86400000000 as day from events)"
ROUNDS = "(select o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) as at from orders)"
NODES = """(select *, case when 100 - last_seen > 15 then 'Stale' when relay then 'Relay' when disabled then 'Disabled' when desired_drain or draining then 'Draining'
 when not ready then 'NotReady' when clients >= max_clients then 'Full' else 'Serving' end as status from (
 select s_suppkey as node_id, coalesce(n, 0) as clients, 600 + s_nationkey * 2 as max_clients, case when s_suppkey % 11 = 0 then 0 else 90 end as last_seen, s_suppkey % 13 = 0 as relay,
 s_suppkey % 17 = 0 as disabled, s_suppkey % 19 = 0 as desired_drain, s_suppkey % 23 = 0 as draining, s_suppkey % 29 <> 0 as ready, case when s_suppkey % 7 = 0 then s_suppkey else 0 end as pending_release
 from supplier left join (select l_suppkey, count(*) as n from lineitem group by 1) on l_suppkey = s_suppkey))"""
EXCESS = f"""(select n.*, case when status in ('Serving', 'Full') and room - case when status = 'Serving' then greatest(max_clients - clients, 0) else 0 end > 0 then
 least(floor(clients - low::double * 1.2)::bigint, greatest(clients - low, 0) // 2, room - case when status = 'Serving' then greatest(max_clients - clients, 0) else 0 end) else 0 end as excess
 from {NODES} n, (select coalesce(min(clients) filter (status = 'Serving'), 0) as low, coalesce(sum(greatest(max_clients - clients, 0)) filter (status = 'Serving'), 0)::bigint as room from {NODES}))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = re.sub(r'(?<![\w"])at(?![\w"])', '"at"', sql)  # a keyword there
        return f

    return add


def dec(c, digits: int = 4):
    """Sums of doubles as decimals, rounded the same way on both sides."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# --- pipeline


@query(f"select event_id, user_id, day from (select *, row_number() over (partition by user_id, day order by at, event_id) as rn from {LOG}) where rn = 1")
def first_wins_dedup(d):
    return events.first_wins(d.log.select("event_id", "at", "user_id", "day"), ["user_id", "day"], ["at", "event_id"]).select("event_id", "user_id", "day")


@query(f"select event_type, count(*) as received, count(*) filter (rn = 1) as won from (select *, row_number() over (partition by user_id, day order by at, event_id) as rn from {LOG}) group by 1")
def source_race(d):
    return events.source_race(d.log, ["user_id", "day"], ["at", "event_id"], "event_type")


@query(f"select event_id, row_number() over (order by at, event_id) as seq from (select *, row_number() over (partition by user_id, day order by at, event_id) as rn from {LOG}) where rn = 1")
def accepted_sequence(d):
    won = events.first_wins(d.log.select("event_id", "at", "user_id", "day"), ["user_id", "day"], ["at", "event_id"])
    return ordered.global_sequence(won, ["at", "event_id"]).select("event_id", "seq")


ENRICHED = f"""(select e.*, case when c_custkey is not null then 'id' when s_suppkey is not null then 'condition' else 'miss' end as via, case when c_custkey is not null then c_name else s_name end as name,
 case when c_custkey is not null then c_acctbal else s_acctbal end as balance from {LOG} e left join (select * from customer where c_mktsegment = 'BUILDING') on c_custkey = user_id left join supplier on s_suppkey = user_id % 150)"""


def enriched(d) -> DataFrame:
    by_id = d.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    by_cond = d.supplier.select(F.col("s_suppkey").alias("cond"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return events.enrich(d.log.withColumn("cond", F.col("user_id") % 150), by_id, "user_id", by_cond, "cond")


@query(f"select event_id, via, name, balance from {ENRICHED}")
def resolve_enrichment(d):
    return enriched(d).select("event_id", "via", "market.name", "market.balance")


@query(f"select event_type, count(*) as logs, count(*) filter (via <> 'miss') as hits, count(*) filter (via = 'id') as hits_via_id, count(*) filter (via = 'miss') as misses, max(event_id) as max_block from {ENRICHED} group by 1")
def enrichment_hit_summary(d):
    hit = F.col("via") != "miss"
    return enriched(d).groupBy("event_type").agg(F.count("*").alias("logs"), F.count_if(hit).alias("hits"), F.count_if(F.col("via") == "id").alias("hits_via_id"), F.count_if(~hit).alias("misses"), F.max("event_id").alias("max_block"))


@query(f"""select event_id, true as stored, via <> 'miss' and added is null as broadcast, added is not null as blocked, coalesce(added <= at, false) as blocked_before from {ENRICHED}
 left join (select o_custkey, min(epoch_us(o_orderdate)) + 900000000000000 as added from orders where o_orderstatus = 'F' group by 1) on o_custkey = user_id""")
def blocklist_flags(d):
    blocked = d.rounds.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id"), (F.col("at") + 900_000_000_000_000).alias("added"))
    out = events.flag_blocked(enriched(d), blocked, "user_id", "at", "added")
    return events.broadcast_flags(out, F.col("via") != "miss", F.col("blocked")).select("event_id", "stored", "broadcast", "blocked", "blocked_before")


@query(f"select event_id, coalesce(name, 'UNSPECIFIED') as category, coalesce(balance, 0) as balance, via <> 'miss' as enriched from {ENRICHED}")
def output_projection(d):
    rows = enriched(d).select("event_id", F.col("market.name").alias("category"), "market.balance", (F.col("via") != "miss").alias("enriched"))
    return events.with_defaults(rows, {"category": "UNSPECIFIED", "balance": 0.0})


@query("select l_returnflag, count(*) as n, sum(l_quantity) as quantity from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal > 0) group by 1")
def allowlist_semi(d):
    return events.allowed(d.lineitem, d.emitters, "l_suppkey", False).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("select l_returnflag, count(*) as n, sum(l_quantity) as quantity from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0) group by 1")
def offlist_anti(d):
    return events.off_list(d.lineitem, d.emitters, "l_suppkey").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""select l_suppkey, count(*) as events, count(*) filter (p_size > 40) as hits, arg_max(l_partkey, (l_orderkey, l_linenumber)) as last_requester, arg_max(l_partkey, (l_orderkey, l_linenumber)) filter (p_size > 40) as last_hit
 from lineitem join part on p_partkey = l_partkey where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0) group by 1 order by min((l_orderkey, l_linenumber)), l_suppkey limit 64""")
def offlist_tally(d):
    rows = events.off_list(d.lineitem.select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"), d.emitters, "l_suppkey").join(d.part.select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    return events.off_list_tally(rows, "l_suppkey", F.col("p_size") > 40, ["l_orderkey", "l_linenumber"], "l_partkey").drop("first_seen", "last_seen")


@query(f"select user_id, arg_max(event_type, (at, event_id)) as condition from {LOG} group by 1")
def stale_alias(d):
    return events.id_aliases(d.log, "user_id", "event_type", ["at", "event_id"]).withColumnRenamed("event_type", "condition")


@query(f"select event_type, count(*) as seen, count(*) filter (lag = 0) as first, count(*) filter (lag = 0) / count(*) as first_share, round(avg(lag), 2) as mean_lag from (select *, at - min(at) over (partition by user_id, day) as lag from {LOG}) group by 1")
def first_seen_share(d):
    return events.first_share(d.log, ["user_id", "day"], "event_type", "at").withColumn("mean_lag", F.round("mean_lag", 2))


@query(f"""select event_type, round(sum(1.0 / k), 6) as credit, count(*) as rounds from (select *, count(*) over (partition by day) as k from (
 select day, event_type, at, min(at) over (partition by day) as f from (select day, event_type, min(at) as at from {LOG} group by 1, 2)) where at - f <= 600000000) group by 1""")
def tie_credit(d):
    return events.tie_credit(d.log, ["day"], "event_type", "at", 600_000_000).withColumn("credit", F.round("credit", 6))


@query(f"""select event_type, round(sum(w * (value > 50)::int), 6) as won_weight, round(sum(w), 6) as weight, round(sum(w * (value > 50)::int) / sum(w), 8) as share from (
 select *, pow(0.5, (m - at) / 432e9) as w from {LOG}, (select max(at) as m from {LOG})) group by 1""")
def decayed_share(d):
    now = d.log.agg(F.max("at").alias("m"))
    out = events.decayed_share(d.log.crossJoin(F.broadcast(now)), "event_type", "at", F.col("value") > 50, F.col("m"), 432e9)  # one row
    return out.select("event_type", dec("won_weight", 6).alias("won_weight"), dec("weight", 6).alias("weight"), dec("share", 8).alias("share"))


# --- ordered


@query(f"select o_orderkey, seq, sum(h) over (order by seq rows between 999 preceding and current row)::bigint as hits, least(seq, 1000) as seen from (select o_orderkey, (o_totalprice > 100000)::int as h, row_number() over (order by at, o_orderkey) as seq from {ROUNDS})")
def trailing_hit_rate(d):
    return ordered.trailing_count(d.rounds, ["at", "o_orderkey"], F.col("o_totalprice") > 100000).select("o_orderkey", "seq", "hits", "seen")


@query("""select l_returnflag, q, list_extract(v, least(floor((len(v) - 1) * q + 0.5)::bigint + 1, len(v))) as l_extendedprice from (select l_returnflag, list_sort(list(l_extendedprice)) as v from lineitem group by 1), (select unnest([0.05, 0.1, 0.5, 0.9, 1.0])::double as q)""")
def nearest_rank_quantile(d):
    return ordered.nearest_rank(d.lineitem, ["l_returnflag"], "l_extendedprice", [0.05, 0.1, 0.5, 0.9, 1.0])


@query("select l_shipmode_stand_in as l_linestatus, list_extract(v, len(v) // 2 + 1) as upper_median from (select l_linestatus as l_shipmode_stand_in, list_sort(list(l_quantity)) as v from lineitem group by 1)")
def upper_median(d):
    return ordered.upper_median(d.lineitem, ["l_linestatus"], "l_quantity").withColumnRenamed("l_quantity", "upper_median")


@query(f"""select user_id, coalesce(sum(case when at >= m - 864000000000 and prev is not null then case when v >= prev then v - prev else v end end), 0)::bigint as increase from (
 select *, lag(v) over (partition by user_id order by at, v) as prev from (select user_id, at, floor(value)::bigint as v, max(at) over () as m from {LOG})) group by 1""")
def counter_increase(d):
    now = d.log.agg(F.max("at").alias("m"))
    rows = d.log.select("user_id", "at", F.floor("value").cast("long").alias("v")).crossJoin(F.broadcast(now))
    return ordered.counter_increase(rows, ["user_id"], "at", "v", F.col("m"), 864_000_000_000)


@query(f"""with e as (select user_id, at, value > 40 as on_ from {LOG}),
g as (select *, sum((not on_)::int) over (partition by user_id order by at rows unbounded preceding) as isl from e),
runs as (select user_id, isl, min(at) filter (on_) as a, max(at) filter (on_) as b from g group by 1, 2 having count(*) filter (on_) > 0)
select user_id, count(*) as runs, max(b - a) as longest from runs group by 1""")
def condition_runs(d):
    """Gaps and islands of a condition, the batch core of hold and resolve."""
    runs = ordered.condition_runs(d.log.select("user_id", "at", (F.col("value") > 40).alias("on_")), ["user_id"], "at", "on_")
    return runs.groupBy("user_id").agg(F.count("*").alias("runs"), F.max(F.col("b") - F.col("a")).alias("longest"))


@query(f"""with recursive e as (select user_id, at, value > 40 as on_, row_number() over (partition by user_id order by at, event_id) as rn from {LOG}),
f as (select user_id, rn, at, case when on_ then at end as since, null::bigint as fired, null::bigint as absent, null::bigint as done_since, null::bigint as done_fired, null::bigint as done_at from e where rn = 1
 union all select user_id, rn, at, case when ends then null else since2 end, case when ends then null else fired2 end, case when ends then null else absent2 end,
  case when ends then since2 end, case when ends then fired2 end, case when ends then at end from (
  select *, not on_ and fired2 is not null and at - absent2 >= 7200000000 as ends from (
   select e.user_id, e.rn, e.at, e.on_, case when e.on_ then coalesce(f.since, e.at) when f.fired is null then null else f.since end as since2,
    case when e.on_ and f.fired is null and e.at - coalesce(f.since, e.at) >= 3600000000 then e.at else f.fired end as fired2,
    case when e.on_ or f.fired is null then null else coalesce(f.absent, e.at) end as absent2 from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)))
select user_id, done_since as pending_since, done_fired as fired_at, done_at as resolved_at from f where done_at is not null
union all select user_id, since, fired, null from (select *, row_number() over (partition by user_id order by rn desc) as last from f) where last = 1 and fired is not null""")
def hold_resolve_islands(d):
    rows = d.log.select("user_id", "at", (F.col("value") > 40).alias("on_"))
    return scans.islands(rows, ["user_id"], "at", "on_", 3_600_000_000, 7_200_000_000)


@query(f"""with recursive r as (select event_id, day, at, (length(props) + 1500)::bigint as size, row_number() over (partition by day order by at, event_id) as rn from {LOG}),
f as (select day, rn, event_id, size, 1::bigint as batch, 1 as n, size as used from r where rn = 1
 union all select r.day, r.rn, r.event_id, r.size, case when f.n >= 64 or f.used + r.size > 32768 then f.batch + 1 else f.batch end, case when f.n >= 64 or f.used + r.size > 32768 then 1 else f.n + 1 end,
 case when f.n >= 64 or f.used + r.size > 32768 then r.size else f.used + r.size end from f join r on r.day = f.day and r.rn = f.rn + 1)
select event_id, day, batch from f""")
def greedy_batches(d):
    rows = d.log.select("event_id", "day", "at", (F.length("props") + 1500).cast("long").alias("size"))
    return scans.greedy_batches(rows, ["day"], ["at", "event_id"], "size").select("event_id", "day", "batch")


@query("select event_id, seq from (select event_id, row_number() over (order by ts, event_id) - 1 as seq, count(*) over () as n from events) where seq % greatest(1, n // 1500) = 0 or seq = n - 1")
def history_thinning(d):
    return ordered.thinned(d.log, ["at", "event_id"], 1500).select("event_id", "seq")


@query("select doc_id from (select unnest(generate_series(min(doc_id), max(doc_id))) as doc_id from labels) where doc_id not in (select doc_id from labels)")
def sequence_gaps(d):
    return ordered.missing_numbers(d.labels, "doc_id")


@query("select before + 1 as first, n - 1 as last from (select n, lag(n) over (order by n) as before from (select distinct o_orderkey * o_orderkey * 1000 as n from orders)) where n - 1 > before")
def gap_intervals(d):
    """Gaps of any length, a row each."""
    return ordered.gaps(d.orders.select((F.col("o_orderkey") * F.col("o_orderkey") * 1000).alias("n")), "n")


@query("""select o_orderkey, l_linenumber, epoch_us(l_shipdate) - epoch_us(o_orderdate) as lead from orders left join (select l_orderkey, l_linenumber, l_shipdate from lineitem where l_returnflag = 'N')
 on l_orderkey = o_orderkey and l_shipdate >= o_orderdate and epoch_us(l_shipdate) - epoch_us(o_orderdate) <= 2592000000000""")
def interval_lead_left(d):
    left = d.rounds.select("o_orderkey", "at", F.lit(None).cast("string").alias("note"))
    right = d.lineitem.filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", C.micros(F.col("l_shipdate")).alias("ship"))
    return ordered.interval_join(left, right, ["o_orderkey"], "at", "ship", 2_592_000_000_000, 2, "left").select("o_orderkey", "l_linenumber", (F.col("ship") - F.col("at")).alias("lead"))

@query("select o_orderkey, l_linenumber, epoch_us(l_shipdate) - epoch_us(o_orderdate) as lead from orders join lineitem on l_orderkey = o_orderkey where l_shipdate >= o_orderdate and epoch_us(l_shipdate) - epoch_us(o_orderdate) <= 2592000000000")
def interval_lead(d):
    left = d.rounds.select("o_orderkey", "at")
    right = d.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", C.micros(F.col("l_shipdate")).alias("ship"))
    return ordered.interval_join(left, right, ["o_orderkey"], "at", "ship", 2_592_000_000_000).select("o_orderkey", "l_linenumber", (F.col("ship") - F.col("at")).alias("lead"))


@query(f"select o_orderkey, round_at, at < round_at as stale from (select *, max(at) over (partition by o_custkey order by o_orderkey rows unbounded preceding) as round_at from {ROUNDS})")
def latest_round(d):
    rows = ordered.latest_so_far(d.rounds, ["o_custkey"], ["o_orderkey"], "at", "round_at")
    return rows.select("o_orderkey", "round_at", (F.col("at") < F.col("round_at")).alias("stale"))


@query("select event_id from events order by ts desc, event_id desc limit 200")
def recent_ring(d):
    return ordered.last_rows(d.log, ["at", "event_id"], 200).select("event_id")


@query("select event_id from (select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso, ts from events) where iso > '2024-01-20T00:00:00' order by ts desc, event_id desc limit 500")
def recent_since(d):
    iso = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    rows = d.events.withColumn("iso", iso).filter(F.col("iso") > "2024-01-20T00:00:00")
    return ordered.last_rows(rows, ["ts", "event_id"], 500).select("event_id")


@query(f"select user_id, event_id from (select *, row_number() over (partition by user_id order by at desc, event_id desc) as rn from {LOG}) where rn <= 5")
def keep_recent(d):
    return ordered.newest_per_key(d.log, ["user_id"], ["at", "event_id"], 5).select("user_id", "event_id")


@query("with b as (select event_id // 64 as frame, min(event_id) as first_sequence, max(event_id) as last_sequence, count(*) as n from events group by 1) select *, 500 > 0 and 500 < (select min(first_sequence) + 200 from b) as lagged from b where last_sequence > 500")
def frame_replay_after(d):
    b = d.events.groupBy(F.expr("event_id div 64").alias("frame")).agg(F.min("event_id").alias("first_sequence"), F.max("event_id").alias("last_sequence"), F.count("*").alias("n"))
    from opalstream.sources import frames

    return frames.replay_after(b, 500, d.events.agg((F.min("event_id") + 200).alias("replay_floor")))


# --- rules and scalars

CASES = "(select doc_id, [1, 64, 84, 2, 21, 596, 100343, 104596, 144, 7][1 + doc_id % 10 : 1 + doc_id % 10 + doc_id % 3 - 1] as tags, case when doc_id % 4 = 0 then ['child_moneyline', 'Totals', 'spreads', 'other'][1 + (doc_id // 4) % 4] end as market_type, case when doc_id % 5 <> 0 then ['Will ' || text || ' win the cup?', 'X vs. Y', 'Will it say \"mog\" 5+ times?', 'Map 2 Winner', 'highest temperature in Z', 'Will Y be the best?', 'Fed moves interest rates', text][1 + doc_id % 8] end as question from documents)"


@query(rules.oracle(CASES, "doc_id"))
def classify_rules(d):
    docs = d.documents.select("doc_id", "text")
    tags = F.slice(F.array(*map(F.lit, [1, 64, 84, 2, 21, 596, 100343, 104596, 144, 7])), (F.col("doc_id") % 10 + 1).cast("int"), (F.col("doc_id") % 3).cast("int"))
    pick = lambda names, i: F.element_at(F.array(*names), (i + 1).cast("int"))
    kinds = [F.lit(x) for x in ("child_moneyline", "Totals", "spreads", "other")]
    texts = [F.concat(F.lit("Will "), F.col("text"), F.lit(" win the cup?")), *map(F.lit, ("X vs. Y", 'Will it say "mog" 5+ times?', "Map 2 Winner", "highest temperature in Z", "Will Y be the best?", "Fed moves interest rates")), F.col("text")]
    rows = docs.select(
        "doc_id", tags.alias("tags"), F.when(F.col("doc_id") % 4 == 0, pick(kinds, F.expr("(doc_id div 4) % 4"))).alias("market_type"), F.when(F.col("doc_id") % 5 != 0, pick(texts, F.col("doc_id") % 8)).alias("question")
    )
    rows = rows.withColumn("category", rules.category(F.col("tags"), F.col("question")))
    return rows.select("doc_id", "category", rules.bet_type(F.col("category"), F.col("tags"), F.col("market_type"), F.col("question")).alias("bet_type"))


@query("""select event_id, list_sort(list_distinct([k, k % 7, k % 11])) as tag_ids from (select event_id, (props->>'k')::int as k from events)""")
def tag_union(d):
    from pyspark.sql import types as T

    k = F.get_json_object("props", "$.k").cast("int")
    tag = lambda x: F.struct(x.cast("string").alias("id"))
    rows = d.events.select("event_id", F.array(tag(k)).alias("tags"), F.array(F.struct(F.array(tag(k % 7), tag(k % 11)).alias("tags"))).alias("events"))
    assert isinstance(rows.schema["tags"].dataType, T.ArrayType)
    return rows.select("event_id", catalog.tag_union(F.col("tags"), F.col("events")).alias("tag_ids"))


@query("""select event_id, case when event_id % 3 = 0 then ['a', (event_id % 7)::varchar] when event_id % 3 = 1 then [] end as tokens from events""")
def lenient_json_list(d):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["a","'), (F.col("event_id") % 7).cast("string"), F.lit('"]'))).when(F.col("event_id") % 3 == 1, F.lit("  ")).otherwise("plain")
    return d.events.select("event_id", C.lenient_list(text).alias("tokens"))


@query("""select event_id, event_id as number, case when event_id % 5 <> 0 then event_id end as market_id, event_id % 10 = 0 as missing from events""")
def hex_and_ids(d):
    hexed = F.concat(F.when(F.col("event_id") % 2 == 0, "0x").otherwise("0X"), F.lpad(F.hex("event_id"), 20, "0"))
    text = F.when(F.col("event_id") % 5 == 0, F.lit("q: market_id: none, market_id: 7")).otherwise(F.concat(F.lit("title: t, market_id: "), F.col("event_id").cast("string"), F.lit(" res_data: p1")))
    rows = d.events.select("event_id", C.hex_u64(hexed).cast("long").alias("number"), C.first_market_id(text).cast("long").alias("market_id"))
    return rows.withColumn("missing", C.missing_id(F.when(F.col("event_id") % 10 != 0, F.lit(1))))


@query("select event_id, ['TOKEN0', 'TOKEN1', 'TIE', 'UNSPECIFIED', 'UNSPECIFIED'][1 + event_id % 5] as outcome from events")
def price_outcomes(d):
    words = [F.unhex(F.lit(w)) for w in C.PRICE_OUTCOMES] + [F.unhex(F.lit("11" * 32)), F.unhex(F.lit("00" * 32))]
    price = F.element_at(F.array(*words), (F.col("event_id") % 5 + 1).cast("int"))
    return d.events.select("event_id", C.price_outcome(F.when(F.col("event_id") % 5 == 4, "dispute").otherwise("propose"), price).alias("outcome"))


@query("""select event_id, case when v < 50 then '<50' when v < 200 then '50-200' when v < 1000 then '200-1k' when v < 5000 then '1k-5k' else '>=5k' end as tip, case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm' || (s % 60) || 's' else (s // 3600) || 'h' || (s % 3600 // 60) || 'm' end as duration
 from (select event_id, value * 20 as v, event_id * 7 as s from events)""")
def buckets_and_durations(d):
    return d.events.select("event_id", C.half_open_bin(F.col("value") * 20, C.TIP_EDGES, C.TIP_NAMES).alias("tip"), C.duration_text(F.col("event_id") * 7000).alias("duration"))


@query("""select page_id, case when page_id % 2 = 0 then 'wss://' else 'ws://' end || case when page_id % 3 = 0 then '[fe80::1]' when page_id % 3 = 1 then 'h' || page_id else '10.0.0.1' end || ':' || case when page_id % 4 = 0 then 8012 else page_id end || '/events' as node, 'ws://h/x' as redacted from pages""")
def node_urls(d):
    host = F.when(F.col("page_id") % 3 == 0, "fe80::1").when(F.col("page_id") % 3 == 1, F.concat(F.lit("h"), F.col("page_id").cast("string"))).otherwise("")
    return d.pages.select(
        "page_id", C.node_url(host, F.lit("10.0.0.1"), F.when(F.col("page_id") % 4 == 0, 0).otherwise(F.col("page_id")), F.lit(""), F.col("page_id") % 2 == 0).alias("node"), C.redact(F.concat(F.lit("ws://h/x?token="), F.col("url"))).alias("redacted")
    )


@query("select conv_id, turn, ['cs2', 'dota2', 'lol', 'chess'][1 + (conv_id % 4)::int] as game, role = 'user' as flag, case when turn % 2 = 0 then turn end as number from conversations")
def aliases_and_casts(d):
    slug = F.element_at(F.array(*map(F.lit, (" CS-GO", "dota-2", "league-of-legends", "Chess "))), (F.col("conv_id") % 4 + 1).cast("int"))
    return d.conversations.select(
        "conv_id", "turn", C.game(slug).alias("game"), C.truthy(F.when(F.col("role") == "user", " Yes")).alias("flag"), C.safe_int(F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), F.col("turn").cast("string"))).otherwise("x")).alias("number")
    )


@query("select l_suppkey, agree, disagree, round(p - 1.645 * sqrt(p * (1 - p) / (n + 3)), 10) as lo, n >= 50 and p - 1.645 * sqrt(p * (1 - p) / (n + 3)) >= 0.4 as trusted from (select *, agree + disagree as n, (agree + 1) / (agree + disagree + 2) as p from (select l_suppkey, count(*) filter (l_returnflag = 'N') as agree, count(*) filter (l_returnflag <> 'N') as disagree from lineitem group by 1))")
def trust_lower_bound(d):
    rows = d.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("agree"), F.count_if(F.col("l_returnflag") != "N").alias("disagree"))
    rows = rows.withColumn("lo", C.lower_bound_trust(F.col("agree"), F.col("disagree")))
    return rows.withColumn("trusted", (F.col("agree") + F.col("disagree") >= 50) & (F.col("lo") >= 0.4)).withColumn("lo", F.round("lo", 10))


# --- catalog


@query(f"select o_orderkey from {ROUNDS} where at >= 820454400000000")
def incremental_cursor(d):
    rows = d.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated"))
    return catalog.incremental(rows, "updated", "o_orderkey", "1996-01-01")[0].select("o_orderkey")


@query("select max(o_orderdate)::date::varchar as updated, arg_max(o_orderkey, (o_orderdate::date, o_orderkey)) as o_orderkey from orders")
def next_cursor(d):
    rows = d.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated"))
    return catalog.incremental(rows, "updated", "o_orderkey", "1992-01-01")[1]


@query("select o_custkey, least(seen, t) as seen_day from (select o_custkey, max(epoch_us(o_orderdate) // 86400000000) as seen from orders group by 1), (select max(epoch_us(o_orderdate) // 86400000000) - 3 as t from orders) where least(seen, t) >= t - 140")
def ttl_eviction(d):
    rows = d.rounds.groupBy("o_custkey").agg(F.max(C.day_number(F.col("at"))).alias("seen_day"))
    today = rows.agg(F.max("seen_day")).first()[0]
    return catalog.evict(rows, (today or 0) - 3, 140)


@query("""with o as (select c_custkey, c_mktsegment as seg, c_acctbal as bal, 10 as seen from customer where c_mktsegment <> 'BUILDING'), n as (select c_custkey, c_mktsegment as seg, case when c_nationkey < 5 then c_acctbal + 1 else c_acctbal end as bal from customer where c_mktsegment <> 'MACHINERY')
select coalesce(n.c_custkey, o.c_custkey) as c_custkey, coalesce(n.bal, o.bal) as bal, case when n.c_custkey is null then o.seen when o.c_custkey is null or o.bal <> n.bal then 9 else greatest(o.seen, 9) end as seen_day from o full join n on o.c_custkey = n.c_custkey""")
def catalog_upsert(d):
    c = d.customer.select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))
    old = c.filter("seg <> 'BUILDING'").withColumn("seen_day", F.lit(10))
    new = c.filter("seg <> 'MACHINERY'").withColumn("bal", F.when(F.col("c_nationkey") < 5, F.col("bal") + 1).otherwise(F.col("bal")))
    new = new.withColumn("updated_at", F.lit("b")).unionByName(new.filter("c_nationkey < 12").withColumn("bal", F.col("bal") - 5).withColumn("updated_at", F.lit("a")))  # pages overlap
    return catalog.upsert(old, new, "c_custkey", ["seg", "bal"], F.lit(9)).select("c_custkey", "bal", "seen_day")


RECONCILED = """(with o as (select c_custkey, c_acctbal as bal, 90 - c_nationkey as seen from customer where c_mktsegment <> 'BUILDING'), n as (select c_custkey, case when c_nationkey < 5 then c_acctbal + 1 else c_acctbal end as bal from customer where c_mktsegment in ('BUILDING', 'MACHINERY'))
 select coalesce(n.c_custkey, o.c_custkey) as c_custkey, coalesce(n.bal, o.bal) as bal, case when n.c_custkey is null then o.seen when o.c_custkey is null or o.bal <> n.bal then 100 else greatest(o.seen, 100) end as seen_day, n.c_custkey is not null as fresh, n.c_custkey is not null and o.c_custkey is null as gap, n.bal <> o.bal as changed from o full join n on o.c_custkey = n.c_custkey)"""


def reconciled(d):
    c = d.customer.select("c_custkey", "c_nationkey", "c_mktsegment", F.col("c_acctbal").alias("bal"))
    old = c.filter("c_mktsegment <> 'BUILDING'").withColumn("seen_day", 90 - F.col("c_nationkey"))
    new = c.filter("c_mktsegment in ('BUILDING', 'MACHINERY')").withColumn("bal", F.when(F.col("c_nationkey") < 5, F.col("bal") + 1).otherwise(F.col("bal")))
    return catalog.reconcile(old, new.unionByName(new.filter("c_nationkey > 9")), "c_custkey", ["bal"], 100, 20)  # pages overlap


@query(f"select c_custkey, bal, seen_day from {RECONCILED} where seen_day >= 80")
def catalog_reconcile(d):
    return reconciled(d)[0].select("c_custkey", "bal", "seen_day")


@query(f"select count(*) filter (fresh) as fresh, count(*) filter (gap) as gaps, count(*) filter (coalesce(changed, false)) as changed, count(*) filter (seen_day < 80) as evicted from {RECONCILED}")
def reconcile_counts(d):
    return reconciled(d)[1]


@query("select p_partkey from part where p_partkey > (select max(c_custkey) from customer) order by 1 desc limit 500")
def newest_ids(d):
    return catalog.newest_ids(d.part, "p_partkey", d.customer.agg(F.max("c_custkey")).first()[0] or 0).select("p_partkey")


@query(f"select min(o_orderkey) as start from {ROUNDS}, (select max(at // 1000000) as h from {ROUNDS}) where at // 1000000 >= h - 604800")
def backfill_boundary(d):
    return catalog.backfill_start(d.rounds.select(F.col("o_orderkey").alias("number"), F.expr("at div 1000000").alias("at")), None, None)


@query(f"select min(o_orderkey) as number from {ROUNDS} where at // 1000000 >= 820454400")
def block_lower_bound(d):
    return catalog.first_block_since(d.rounds.select(F.col("o_orderkey").alias("number"), F.expr("at div 1000000").alias("at")), 820_454_400)


@query("select count(*) as missed, case when count(*) > 0 then 'Missed' else 'Quiet' end as verdict from labels, (select min(doc_id) as verified, max(doc_id) as head from labels) where doc_id > verified and doc_id <= head - 5")
def stall_check(d):
    ends = d.labels.agg(F.min("doc_id"), F.max("doc_id")).first()
    return catalog.stall_verdict(d.labels, "doc_id", ends[0] or 0, ends[1] or 0)


# --- console


@query(f"select node_id, status from {NODES}")
def status_cascade(d):
    return d.nodes.select("node_id", "status")


@query(f"select node_id, excess::bigint as excess from {EXCESS}")
def balance_excess(d):
    return console.balance_excess(d.nodes).select("node_id", "excess")


@query(f"""select node_id, case when pending_release > 0 then least(pending_release, 20) when automatic then least(excess, 20) else 0 end::bigint as release, case when pending_release > 0 then 'manual' when automatic then 'auto-balance' else '' end as reason
 from (select *, node_id = (select node_id from {NODES} where status in ('Serving', 'Full') order by clients desc, node_id limit 1) and not desired_drain and excess >= 5 as automatic from {EXCESS})""")
def release_decision(d):
    return console.release_decision(console.balance_excess(d.nodes)).select("node_id", "release", "reason")


@query(f"""select node_id, weight, band, row_number() over (order by band, case when band = 1 then clients else 0 end, case when band = 1 then -weight else 0 end, node_id) as place from (
 select node_id, clients, greatest(max_clients - clients, 1) as weight, (clients > low + low * 20 // 100)::int as band from {NODES}, (select min(clients) as low from {NODES} where status = 'Serving') where status = 'Serving')""")
def node_list_order(d):
    return console.node_list(d.nodes).select("node_id", "weight", "band", "place")


@query("select c_custkey as token_id, coalesce(n, 0) as clients from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def token_usage(d):
    use = d.orders.groupBy(F.expr("o_orderkey % 20").alias("node"), F.col("o_custkey").cast("string").alias("t")).agg(F.count("*").alias("n"))
    nodes = use.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("clients_by_token"))
    return console.token_usage(nodes, d.customer.select(F.col("c_custkey").cast("string").alias("token_id"))).select(F.col("token_id").cast("long").alias("token_id"), "clients")


@query("select c_custkey as token_id, c_nationkey as version, left(c_name, 6) as prefix from customer where c_acctbal > 0")
def token_grants(d):
    return console.grants(d.customer.select(F.col("c_custkey").alias("token_id"), F.col("c_nationkey").alias("version"), F.col("c_name").alias("secret"), (F.col("c_acctbal") > 0).alias("enabled")))


@query("select user_id, count(*) as events, count(*) filter (value > 60) as hits from events group by 1 having count(*) filter (value > 60) >= 5 and count(*) filter (value > 60) * 100 >= count(*) * 20")
def rate_alert(d):
    return console.rate_alert(d.events, "user_id", F.col("value") > 60, 5, 20)


@query("select event_type, count(*) filter (value > 10) as hits, count(*) as n, count(*) >= 200 and count(*) filter (value > 10) * 100 < count(*) * 95 as low from events group by 1")
def percent_alert(d):
    return d.events.groupBy("event_type").agg(F.count_if(F.col("value") > 10).alias("hits"), F.count("*").alias("n")).withColumn("low", console.percent_alert(F.col("hits"), F.col("n")))


@query(f"""select rule, severity, hold_s, subject from (select 'edge_stale' as rule, 'critical' as severity, 30 as hold_s, node_id::varchar as subject from {NODES} where status = 'Stale'
 union all select 'edge_near_full', 'warning', 300, node_id::varchar from {NODES} where status not in ('Stale', 'Disabled') and clients * 100 >= max_clients * 95
 union all select 'edge_upstream_down', 'critical', 60, node_id::varchar from {NODES} where status not in ('Stale', 'Disabled') and node_id % 31 = 0
 union all select 'catalog_small', 'warning', 300, '' union all select 'panel_feed_down', 'warning', 300, '')""")
def alert_predicates(d):
    zero = {c: F.lit(0) for c in ("latest_sequence", "node_sequence", "link_lag_ms", "now_ms", "last_frame_ms", "inc_accepted_1h", "inc_slow_10m", "inc_bad_frames_10m")}
    nodes = d.nodes.withColumns(zero).withColumn("upstream_connected", F.col("node_id") % 31 != 0)
    names = ("rpc_sources", "rpc_configured", "inc_reconnects_30m", "last_event_ms", "now_ms", "recent_rows", "recent_hits", "inc_misses_1h", "inc_decode_errors_1h", "inc_slow_10m", "inc_cursor_rejected_10m", "inc_storage_dropped_10m")
    up = d.spark.range(1).select(F.lit(True).alias("fresh"), F.lit(True).alias("rpc_connected"), F.lit(1000).alias("markets"), *[F.lit(0).alias(n) for n in names])
    none = d.spark.createDataFrame([], "emitter string, inc_hits_1h long, inc_events_1h long")
    return console.evaluate(up, nodes, none, False)


@query(f"select severity, rule, list_sort(list(distinct subject)) as subjects, count(*) as n from (select case when value > 60 then 'critical' else 'warning' end as severity, event_type as rule, user_id::varchar as subject from {LOG}) group by 1, 2")
def alert_sections(d):
    rows = d.log.select(F.when(F.col("value") > 60, "critical").otherwise("warning").alias("severity"), F.col("event_type").alias("rule"), F.col("user_id").cast("string").alias("subject"))
    return console.alert_sections(rows)


@query(f"select event_id from {LOG}, (select max(at) as m from {LOG}) where value > 50 and (event_id % 3 = 0 or m - at >= 864000000000)")
def repeat_reminder(d):
    rows = d.log.crossJoin(F.broadcast(d.log.agg(F.max("at").alias("m")))).withColumn("firing", F.col("value") > 50).withColumn("notified_at", F.when(F.col("event_id") % 3 != 0, F.col("at")))
    return console.due(rows, F.col("m"), 864_000_000_000).select("event_id")


@query(f"select event_id, coalesce(prev <> 0 and prev <> s, false) as restarted, coalesce(prev <> 0 and prev <> s, false) and event_type <> 'view' as clears_drain from (select *, lag(s) over (partition by user_id order by at) as prev from (select *, day // 3 % 4 as s from {LOG}))")
def node_restarts(d):
    rows = d.log.select("event_id", F.col("user_id").alias("node_id"), "at", F.expr("day div 3 % 4").alias("started_at"), (F.col("event_type") == "view").alias("relay"))
    return console.restarts(rows).select("event_id", "restarted", "clears_drain")


# --- analytics


@query(f"select hour, coalesce(n, 0) as n from (select unnest(generate_series(m // 3600 - 47, m // 3600)) as hour from (select max(at) // 1000000 as m from {LOG})) left join (select at // 3600000000 as hour, count(*) as n from {LOG} group by 1) using (hour)")
def zero_filled_hours(d):
    now = d.log.agg(F.expr("max(at) div 1000000")).first()[0]
    return analytics.hourly(d.log.select(F.expr("at div 1000000").alias("t")), "t", 48, now or 0)


@query("""select *, correct / nullif(correct + wrong, 0) as accuracy, seen / nullif(truths, 0) as coverage from (select l_linestatus, count(*) filter (truth is not null and p = truth) as correct, count(*) filter (truth is not null and p is not null and p <> truth) as wrong, count(*) filter (p is not null and truth is null) as no_truth,
 count(*) filter (l_tax > 0.05) as late, count(p) as seen, count(truth) as truths from (select *, case when l_linenumber <> 3 then l_returnflag end as p, case when l_quantity > 10 then l_linestatus end as truth from lineitem) group by 1)""")
def race_outcome_rates(d):
    p = F.when(F.col("l_linenumber") != 3, F.col("l_returnflag"))
    return analytics.outcome_rates(d.lineitem, ["l_linestatus"], p, F.when(F.col("l_quantity") > 10, F.col("l_linestatus")), F.col("l_tax") > 0.05)


@query("""with a as (select l_orderkey, min(l_quantity) as pending from lineitem where l_returnflag = 'A' group by 1), b as (select l_orderkey, max(l_quantity) as confirmed from lineitem where l_returnflag = 'N' group by 1), s as (select l_orderkey, sum(l_quantity) as signal from lineitem where l_returnflag = 'R' group by 1),
t as (select l_orderkey, arg_min(l_extendedprice, (l_suppkey, l_linenumber, l_extendedprice)) as truth, min(l_suppkey) as truth_block from lineitem where l_linestatus = 'F' group by 1)
select * from a full join b using (l_orderkey) full join s using (l_orderkey) full join t using (l_orderkey)""")
def three_way_race(d):
    li = d.lineitem
    part = lambda flag, f, name: li.filter(F.col("l_returnflag") == flag).groupBy("l_orderkey").agg(f("l_quantity").alias(name))
    truth = analytics.first_truth(li.filter("l_linestatus = 'F'"), ["l_orderkey"], "l_extendedprice", "l_suppkey", "l_linenumber")
    return analytics.race(part("A", F.min, "pending"), part("N", F.max, "confirmed"), part("R", F.sum, "signal"), truth, ["l_orderkey"])


@query("""select o_orderkey, l_linenumber, o_custkey from (select o_orderkey, o_custkey, unnest(range(1, n + 1)) as l_linenumber from orders join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey) join lineitem using (l_linenumber) where l_orderkey = o_orderkey""")
def ordinal_join(d):
    """An order makes as many calls as it has lines."""
    lines = d.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("int").alias("n"))
    calls = d.orders.join(lines, "o_orderkey").select("o_orderkey", "o_custkey", F.posexplode(F.array_repeat("o_custkey", F.col("n"))).alias("i", "x"))
    logs = d.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return calls.withColumn("l_linenumber", F.col("i") + 1).join(logs, ["o_orderkey", "l_linenumber"]).select("o_orderkey", "l_linenumber", "o_custkey")


@query("select l_returnflag, l_linestatus, c as n, round((c + 2.0 * ((m + 1.0 / 2000) / (t + 1.0))) / (n + 2.0), 10) as p, round((c + 2.0 * ((m + 1.0 / 2000) / (t + 1.0))) / (n + 2.0) / ((m + 1.0 / 2000) / (t + 1.0)), 8) as lift from (select *, sum(c) over (partition by l_returnflag)::double as n, sum(c) over (partition by l_linestatus)::double as m, sum(c) over ()::double as t from (select l_returnflag, l_linestatus, count(*) as c from lineitem group by 1, 2))")
def dirichlet_prediction(d):
    return analytics.dirichlet(d.lineitem, "l_returnflag", "l_linestatus").withColumn("p", F.round("p", 10)).withColumn("lift", F.round("lift", 8))


@query("select round(sum(c / t * log2(c * t / (a * b))), 10) as bits from (select c::double as c, sum(c) over ()::double as t, sum(c) over (partition by l_returnflag)::double as a, sum(c) over (partition by l_linestatus)::double as b from (select l_returnflag, l_linestatus, count(*) as c from lineitem group by 1, 2))")
def mutual_information(d):
    return analytics.mutual_information(d.lineitem, "l_returnflag", "l_linestatus").withColumn("bits", F.round("bits", 10))


@query("""select l_suppkey, count(*) as n, round(sum(log10((c + 2.0 * ((m + 1.0 / 2000) / (t + 1.0))) / (n + 2.0) / ((m + 1.0 / 2000) / (t + 1.0)))), 6) as log10_bf from (
 select l_suppkey, count(*) over w0::double as t, count(*) over w1::double as m, count(*) over w2::double as n, count(*) over w3::double as c from lineitem window
 w0 as (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice rows between unbounded preceding and 1 preceding), w1 as (partition by l_suppkey, l_linestatus order by l_orderkey, l_linenumber, l_partkey, l_extendedprice rows between unbounded preceding and 1 preceding),
 w2 as (partition by l_suppkey, l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_extendedprice rows between unbounded preceding and 1 preceding), w3 as (partition by l_suppkey, l_returnflag, l_linestatus order by l_orderkey, l_linenumber, l_partkey, l_extendedprice rows between unbounded preceding and 1 preceding)) group by 1""")
def prequential_bf(d):
    return analytics.prequential_bf(d.lineitem, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_returnflag", "l_linestatus").withColumn("log10_bf", F.round("log10_bf", 6))


@query("""with r as (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as t from lineitem), w as (select *, pow(2, t / 500.0) as w from r),
x as (select l_suppkey, t, pow(2, -(t - 1) / 500.0) as whole, pow(2, -coalesce(max(t) over w2, 0) / 500.0) as own, coalesce(sum(w) over w0, 0) as st, coalesce(sum(w) over w1, 0) as sm, coalesce(sum(w) over w2, 0) as sn, coalesce(sum(w) over w3, 0) as sc from w window
 w0 as (partition by l_suppkey order by t rows between unbounded preceding and 1 preceding), w1 as (partition by l_suppkey, l_linestatus order by t rows between unbounded preceding and 1 preceding),
 w2 as (partition by l_suppkey, l_returnflag order by t rows between unbounded preceding and 1 preceding), w3 as (partition by l_suppkey, l_returnflag, l_linestatus order by t rows between unbounded preceding and 1 preceding)),
y as (select l_suppkey, count(*) as n, sum(log10((sc * own + 2.0 * ((sm * whole + 1.0 / 2000) / (st * whole + 1.0))) / (sn * own + 2.0) / ((sm * whole + 1.0 / 2000) / (st * whole + 1.0)))) as bf from x group by 1)
select l_suppkey, n, round(bf, 6) as log10_bf, case when bf > 2 then 'strong' when bf > 0.5 then 'some' when bf < -1 then 'against' else 'insufficient' end as verdict from y""")
def decayed_edges(d):
    out = scans.decayed_edge(d.lineitem, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_returnflag", "l_linestatus", 500)
    return out.withColumn("verdict", analytics.verdict(F.col("log10_bf"))).withColumn("log10_bf", F.round("log10_bf", 6))


@query("select l_returnflag, r / 2 as half_rtt from (select l_returnflag, r, row_number() over (partition by l_returnflag order by r, l_suppkey) - 1 as i, count(*) over (partition by l_returnflag) as n from (select l_returnflag, l_suppkey, min(l_quantity) as r from lineitem group by 1, 2)) where n >= 2 and i = n // 4")
def quarter_rtt(d):
    return analytics.quarter_rtt(d.lineitem, "l_returnflag", "l_suppkey", "l_quantity")


REGIONS = "(select n_nationkey as observer, r_regionkey as region, 5.0 * ((n_nationkey * (r_regionkey + 3)) % 7) as delay_ms from nation, region)"


@query(f"""with x as (select o_orderkey as block, observer, region, offset_ms - delay_ms as dd from (select o_orderkey, o_custkey % 5 as observer, (o_totalprice::bigint % 50)::double as offset_ms from orders union all select o_orderkey, 5 + o_custkey % 7, (o_totalprice::bigint % 37)::double from orders) join {REGIONS} using (observer)),
l as (select region, sum((c - 2.0 * ln(1 + pow((dd - mean) / 12.0, 2) / 3.0)) / 4.0) as logw from (select *, avg(dd) over (partition by block, region) as mean from x), (select lgamma(2.0) - lgamma(1.5) - 0.5 * ln(3.0 * pi()) - ln(12.0) as c) group by 1)
select region, round(logw, 3) as logw, round(exp(logw - (select max(logw) from l)) / (select sum(exp(logw - (select max(logw) from l))) from l), 6) as p from l""")
def region_posterior(d):
    price = F.floor(F.round("o_totalprice", 0)).cast("long")
    price = F.expr("cast(bround(o_totalprice, 0) as bigint)")
    a = d.orders.select(F.col("o_orderkey").alias("block"), (F.col("o_custkey") % 5).alias("observer"), (price % 50).cast("double").alias("offset_ms"))
    b = d.orders.select(F.col("o_orderkey").alias("block"), (F.col("o_custkey") % 7 + 5).alias("observer"), (price % 37).cast("double").alias("offset_ms"))
    cal = d.nation.crossJoin(F.broadcast(d.region)).select(F.col("n_nationkey").cast("long").alias("observer"), F.col("r_regionkey").alias("region"), (5.0 * ((F.col("n_nationkey") * (F.col("r_regionkey") + 3)) % 7)).alias("delay_ms"))
    out = analytics.region_posterior(a.unionByName(b), cal, "block", "observer", "region")
    return out.select("region", F.round("logw", 3).alias("logw"), F.round("p", 6).alias("p"))


@query(f"""with s as (select user_id, day, avg(value) as share from {LOG} group by 1, 2), g as (select *, sum((share >= 30)::int) over (partition by user_id order by day) as isl from s)
select user_id, day, streak from (select *, sum((share < 30)::int) over (partition by user_id, isl order by day)::bigint as streak from g) where streak >= 2""")
def streak_below(d):
    # a mean at the bar is at the bar, in whatever order its values were added up
    rows = d.log.groupBy("user_id", "day").agg(F.round(F.avg("value"), 10).alias("share"))
    return analytics.streaks_below(rows, "user_id", "day", "share", 30.0, 2)


@query(f"select day, user_id, place, place <= n - 5 as out from (select *, row_number() over (partition by day order by share, user_id) as place, count(*) over (partition by day) as n from (select day, user_id, max(value) as share from {LOG} group by 1, 2))")
def elimination_rank(d):
    rows = d.log.groupBy("day", "user_id").agg(F.max("value").alias("share"))
    return analytics.elimination(rows, "day", "user_id", "share", 5).select("day", "user_id", "place", "out")


#: Networks are small here, so that the caps bind.
SEAT_RULES = analytics.SeatRules(core_max=3, trial_seats=1, explore_seats=2)


def seat_rows(d) -> DataFrame:
    """Users as peers of 16 networks, six-hourly; those seen on a day are online on it."""
    rows = d.log.groupBy((F.col("user_id") % 16).alias("network"), "user_id", F.expr("day * 24 + (at div 21600000000) % 4 * 6").alias("epoch"))
    return rows.agg(
        (F.avg("value") / 5000).alias("share"), F.lit(True).alias("online"), (F.max("value") < 2).alias("silent"), (F.count("*") >= 1).alias("observed"), F.lit(50).alias("seen"), (F.min("value") > 40).alias("home")
    ).withColumn("exploring", F.col("epoch") % 24 == 6)


@query()
def seat_states(d):
    return analytics.seats(seat_rows(d), ["network"], "user_id", "epoch", SEAT_RULES)


@query()
def seat_counts(d):
    return analytics.seat_counts(seat_states(d), ["epoch"])


@query(f"select day, count(*) as seen, count(*) filter (value <= 5) as missed, count(*) filter (value <= 5) / count(*) as miss_ratio, count(*) filter (value <= 5) / count(*) > 0.01 as alert from {LOG} group by 1")
def exploration_report(d):
    return analytics.exploration_report(d.log, "day", F.col("value") > 5)


@query(f"select event_id, coalesce(m - t >= 150, false) or m - at // 1000000 >= case when event_type = 'view' then 3600 else 900 end as settled from (select *, max(at) over () // 1000000 as m, case when value > 50 then at // 1000000 + 60 end as t from {LOG})")
def settlement(d):
    rows = d.log.crossJoin(F.broadcast(d.log.agg(F.expr("max(at) div 1000000").alias("m")))).select("event_id", "m", F.expr("at div 1000000").alias("first_at"), F.when(F.col("value") > 50, F.expr("at div 1000000 + 60")).alias("truth_at"), (F.col("event_type") == "view").alias("waits"))
    return rows.select("event_id", analytics.settled(rows, F.col("m"), "truth_at", "first_at", "waits").alias("settled"))


@query("""select c_custkey as wanted_id, arg_max(-p_partkey, (score, -p_partkey)) * -1 as position, max(score) as score from (select c_custkey, p_partkey, 4 + case when p_type like '%' || d || '%' then 3 else 0 end as score from (select c_custkey, split_part(n, ' ', 1) as a, split_part(n, ' ', 2) as b, d from (select c_custkey, p_name as n, split_part(p_type, ' ', 1) as d from customer join part on p_partkey = c_custkey)) join part on contains(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(a), '[^a-z0-9]', '', 'g')) and contains(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(b), '[^a-z0-9]', '', 'g')) where regexp_replace(lower(a), '[^a-z0-9]', '', 'g') <> '' and regexp_replace(lower(b), '[^a-z0-9]', '', 'g') <> '') group by 1""")
def fuzzy_match_argmax(d):
    part = lambda c, i: F.split_part(F.col(c), F.lit(" "), F.lit(i))
    want = d.customer.join(d.part, F.col("p_partkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("wanted_id"), part("p_name", 1).alias("name_a"), part("p_name", 2).alias("name_b"), part("p_type", 1).alias("date_hint"))
    return analytics.fuzzy_match(want, d.part.select(F.col("p_partkey").alias("position"), F.col("p_name").alias("title"), F.col("p_type").alias("slug")))


@query("select p_partkey as market_id, i, o as outcome, t as token, case when p_partkey % 3 = 0 then 2 end as game_num from (select p_partkey, unnest([0, 1]) as i, unnest([p_brand, p_type]) as o, unnest([p_size, p_size + 1]) as t from part)")
def outcome_tokens(d):
    q = F.when(F.col("p_partkey") % 3 == 0, "A vs B - Map 2 Winner").otherwise("A vs B")
    rows = d.part.select(F.col("p_partkey").alias("market_id"), q.alias("question"), F.array("p_brand", "p_type").alias("outcomes"), F.array(F.col("p_size"), F.col("p_size") + 1).alias("tokens"))
    return analytics.market_games(rows)


@query("""select o_custkey as condition, o_orderpriority as match, added, best_status from (select o_custkey, o_orderpriority, min(at) as added from (select *, epoch_us(o_orderdate) // 1000000 as at from orders) group by 1, 2), (select max(epoch_us(o_orderdate) // 1000000) as m from orders) join (select o_orderpriority as p, ['failed', 'pending', 'not_found', 'matched'][max(1 + o_orderkey % 4)::int] as best_status from orders group by 1) on true where p = o_orderpriority and m - added < 60000000""")
def forfeit_blocklist(d):
    now = d.rounds.agg(F.expr("max(at) div 1000000").alias("m")).first()[0]
    status = F.element_at(F.array(*map(F.lit, analytics.LOOKUP_RANK)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = d.orders.select(F.col("o_orderpriority").alias("match"), F.array("o_custkey").alias("conditions"), status.alias("status"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', cast(o_orderdate as timestamp_ntz))").alias("at"))
    return analytics.blocklist(rows, "match", "conditions", "status", "at", F.lit(now), 60_000_000)


@query("select event_id, case when value > 50 then 'a' when value > 25 then 'b' else '' end as loser, event_type = 'view' as is_series, case when event_type <> 'view' then event_id end as map_number from events")
def forfeit_build(d):
    num = F.when(F.col("event_type") == "view", "series").otherwise(F.col("event_id").cast("string"))
    win = F.when(F.col("value") > 50, "b").when(F.col("value") > 25, "a").otherwise("x")
    rows = d.events.select(
        F.lit("").alias("source"), F.lit("cs-go").alias("game"), F.lit("l").alias("league"), F.lit("m").alias("match_name"), F.lit(" a").alias("team_a"), F.lit("b ").alias("team_b"), num.alias("game_num"), win.alias("winner"),
        F.lit("no").alias("draw"), F.col("event_id").cast("string").alias("match_id"), F.lit("1.5").alias("detect_epoch"), F.lit("e").alias("src_end_at"),
    )
    return analytics.forfeit_events(rows).select(F.col("match_id").alias("event_id"), "loser", "is_series", "map_number")


@query("select event_id from events where event_id % 3 = 0")
def repush_grown(d):
    rows = d.events.select("event_id", F.array(F.lit(1), F.lit(2)).alias("old"), F.when(F.col("event_id") % 3 == 0, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(2))).alias("new"))
    return analytics.grown(rows, "old", "new").select("event_id")


@query("select distinct user_id, event_type from events where user_id not in (select c_custkey from customer where c_acctbal > 0)")
def unseen_keys(d):
    rows = d.events.select("user_id", "event_type")
    old = d.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id")).join(rows, "user_id")
    return analytics.new_rows(rows, old, ["user_id", "event_type"])


@query("select coalesce(e.user_id, o.o_custkey) as user_id, o.first_round - e.first_event as lead from (select user_id, min(ts) as f, epoch_us(min(ts)) as first_event from events group by 1) e full join (select o_custkey, epoch_us(min(o_orderdate)) as first_round from orders group by 1) o on o_custkey = user_id")
def either_order_lead(d):
    rounds = d.rounds.select(F.col("o_custkey").alias("user_id"), F.col("at").alias("round"))
    return events.first_leads(d.log, rounds, ["user_id"], "at", "round")


@query("select user_id, c_name, n_name, r_name from (select distinct user_id from events) left join customer on c_custkey = user_id left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey")
def geo_chain(d):
    chain = [(d.customer, "c_custkey", "user_id"), (d.nation, "n_nationkey", "c_nationkey"), (d.region, "r_regionkey", "n_regionkey")]
    return events.look_up_chain(d.events.select("user_id").distinct(), chain).select("user_id", "c_name", "n_name", "r_name")


@query("select left(n_name, 3) as prefix, round(sum(c_acctbal), 2) as total from customer join nation on n_nationkey = c_nationkey group by 1 order by sum(c_acctbal) desc limit 8")
def country_top8(d):
    rows = d.customer.join(d.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return ordered.top_groups(rows, F.substring("n_name", 1, 3).alias("prefix"), "c_acctbal", 8).withColumn("total", F.round("total", 2))


@query("select event_type, user_id, n from (select *, row_number() over (partition by event_type order by n desc, user_id) as rn from (select event_type, user_id, count(*) as n from events group by 1, 2)) where rn <= 3")
def top_shares(d):
    return ordered.top_per_group(d.events, "event_type", "user_id", 3)


@query("select event_id from (select * from events order by ts desc, event_id desc limit 5000) where value > 60 order by ts desc, event_id desc limit 30")
def newest_bad(d):
    return ordered.newest_matching(d.log, ["at", "event_id"], 5000, F.col("value") > 60, 30).select("event_id")


@query("select event_type, count(*) as n from (select event_type from events union all select o_orderstatus from orders union all select c_mktsegment from customer) group by 1")
def multi_source_union(d):
    rows = d.events.select("event_type").unionByName(d.orders.select(F.col("o_orderstatus").alias("event_type"))).unionByName(d.customer.select(F.col("c_mktsegment").alias("event_type")))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query("select o_custkey, list_sort(list_distinct(flatten(list([o_orderkey % 5, o_orderkey % 7])))) as conditions from orders group by 1")
def condition_union(d):
    return events.set_union(d.orders, ["o_custkey"], F.array(F.expr("o_orderkey % 5"), F.expr("o_orderkey % 7")), "conditions")


@query(f"select event_type, max(event_id) - min(event_id) as sequence_lag, count(*) filter (lag <= 10000000) as close from (select *, at - lag(at) over (partition by event_type order by at, event_id) as lag from {LOG}) group by 1")
def sequence_lag(d):
    rows = ordered.lag_in_group(d.log, ["event_type"], ["at", "event_id"], "at", "lag")
    return rows.groupBy("event_type").agg((F.max("event_id") - F.min("event_id")).alias("sequence_lag"), F.count_if(F.col("lag") <= 10_000_000).alias("close"))


#: Line items as deliveries of a log by a source (l_returnflag): some can't be decoded, some aren't ours.
DELIVERIES = "(select l_returnflag as source, l_orderkey, l_linenumber, l_partkey, l_extendedprice, case when l_tax > 0.07 then 'data' end as error, l_quantity > 48 as is_foreign, l_discount > 0.02 as hit from lineitem)"


@query(f"""select source, count(*) as received, count(*) filter (error is null) as decoded, count(error) as decode_errors, count(*) filter (error is null and is_foreign) as "foreign",
 count(*) filter (error is null and not is_foreign) - count(*) filter (rn = 1) as duplicates, count(*) filter (rn = 1) as accepted, count(*) filter (rn = 1 and hit) as hits, count(*) filter (rn = 1 and not hit) as misses from (
 select *, case when error is null and not is_foreign then row_number() over (partition by l_orderkey, l_linenumber, error is null and not is_foreign order by l_partkey, l_extendedprice) end as rn from {DELIVERIES}) group by 1""")
def delivery_counters(d):
    rows = d.lineitem.select(F.col("l_returnflag").alias("source"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.when(F.col("l_tax") > 0.07, "data").alias("error"), "l_quantity", "l_discount")
    return events.delivery_counters(rows, "source", ["l_orderkey", "l_linenumber"], ["l_partkey", "l_extendedprice"], "error", F.col("l_quantity") > 48, F.col("l_discount") > 0.02)


@query("""select list_extract(v, 1 + floor((n - 1) * 0.1 + 0.5)::bigint) / 1000.0 as lead_ms_p10, list_extract(v, 1 + floor((n - 1) * 0.5 + 0.5)::bigint) / 1000.0 as lead_ms_p50, list_extract(v, 1 + floor((n - 1) * 0.9 + 0.5)::bigint) / 1000.0 as lead_ms_p90, v[1] / 1000.0 as lead_ms_min, v[-1] / 1000.0 as lead_ms_max
 from (select list_sort(list(l)) as v, count(*) as n from (select epoch_us(l_shipdate) - epoch_us(o_orderdate) as l from orders join lineitem on l_orderkey = o_orderkey))""")
def lead_summary(d):
    rows = d.lineitem.join(d.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return ordered.lead_summary(rows.select((C.micros(F.col("l_shipdate")) - C.micros(F.col("o_orderdate"))).alias("lead")), "lead")


@query("""with m as (select max(o_orderkey) * 1000000 as now from orders), p as (select o_orderkey as hash, o_custkey as sender, o_orderkey * 1000000 as first_us, o_totalprice as tip from orders where o_orderstatus <> 'P'),
i as (select l_orderkey as hash, min(l_suppkey) as number, max(l_suppkey) as sender, min(l_quantity) > 5 as in_pool, l_orderkey * 1000000 + 5000000 as at_us, min(l_tax) as tip from lineitem where l_returnflag = 'N' group by 1),
s as (select o_orderkey as hash, case when o_orderpriority like '1%' then 'reverted' else 'success' end as status from orders where o_totalprice > 50000), e as (select l_orderkey as hash, min(l_linestatus) as category, l_orderkey * 1000000 + 7000000 as recv_us from lineitem where l_discount > 0.05 group by 1),
a as (select s_suppkey as number, s_nationkey as author from supplier where s_acctbal > 0),
t as (select coalesce(p.hash, i.hash, e.hash) as hash, p.hash as ph, i.hash as ih, e.hash as eh, p.sender as ps, i.sender as si, p.tip as pt, i.tip as it, status, author, in_pool, category, first_us, recv_us, (now - least(first_us, at_us, recv_us)) / 1e6 as age
 from p full join i on p.hash = i.hash full join e on e.hash = coalesce(p.hash, i.hash) left join s on s.hash = coalesce(p.hash, i.hash, e.hash) left join a on a.number = i.number, m),
o as (select *, ph is not null and coalesce(in_pool, true) as visible, case when ih is not null then case when status is not null and (author is not null or age > 300) and (eh is not null or status <> 'success' or age > 90) then status end
 when age > 600 and ph is not null then 'not_included' end as outcome from t)
select hash, outcome, visible, coalesce(ps, si) as sender, coalesce(pt, it) as tip, author, coalesce(category, case when outcome = 'success' then 'unenriched' end) as category, case when visible then (recv_us - first_us) / 1000.0 end as lead_ms from o where outcome is not null""")
def stitched_transactions(d):
    li = d.lineitem.withColumn("hash", F.col("l_orderkey"))
    public = d.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("sender"), F.lit("m").alias("match"), F.col("o_totalprice").alias("tip"), F.lit("k").alias("peer"), (F.col("o_orderkey") * 1_000_000).alias("first_us"))
    included = li.filter("l_returnflag = 'N'").groupBy("hash").agg(F.max("l_suppkey").alias("sender"), F.lit("m").alias("match"), F.min("l_tax").alias("tip"), F.min("l_suppkey").alias("number"), (F.min("l_quantity") > 5).alias("in_pool")).withColumn("at_us", F.col("hash") * 1_000_000 + 5_000_000)
    status = d.orders.filter("o_totalprice > 50000").select(F.col("o_orderkey").alias("hash"), F.when(F.col("o_orderpriority").startswith("1"), "reverted").otherwise("success").alias("status"))
    seen = li.filter("l_discount > 0.05").groupBy("hash").agg(F.min("l_linestatus").alias("category")).withColumn("recv_us", F.col("hash") * 1_000_000 + 7_000_000)
    authors = d.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("number"), F.col("s_nationkey").alias("author"))
    now = d.orders.agg(F.max("o_orderkey")).first()[0] or 0
    return analytics.stitched(public, included, status, seen, authors, F.lit(now * 1_000_000)).drop("match", "peer")


@query("select p_brand, list(p_partkey order by p_size, p_type, p_partkey) as markets from part group by 1")
def forfeit_view(d):
    view = analytics.forfeit_view(d.part.select("p_brand", F.col("p_size").alias("game_number"), F.col("p_type").alias("market_type"), F.col("p_partkey").alias("market_id")), "p_brand")
    return view.select("p_brand", F.transform("markets", lambda m: m["market_id"]).alias("markets"))


#: Line items, one for each (order, line), as calls: the last line of an order confirms.
CALLS = """(select stream, l_orderkey * 1000000 as arrival, l_linenumber as seq, case when flag = 'R' then 'dispute' else 'propose' end as kind, supp as requester, part % 3 as question, l_orderkey // 500 as timestamp,
 (qty % 5 = 0)::bigint as price, part % 40 as sender, qty as tip_gwei, l_orderkey::varchar as tx, l_linenumber = 7 as confirmed from (
 select l_orderkey, l_linenumber, max(l_linestatus) as stream, max(l_returnflag) as flag, max(l_suppkey) // 10 as supp, max(l_partkey) as part, max(l_quantity)::bigint as qty from lineitem group by 1, 2))"""
GATE = {"trust_min_n": 3, "trust_min_rate": 0.4, "tip_window_us": 300_000_000, "state_ttl_us": 60_000_000}
VERDICTS = f"""(with a as (select *, max(timestamp) over (partition by stream, requester, question order by arrival, seq rows between unbounded preceding and 1 preceding) as mx from {CALLS}),
b as (select *, not confirmed and coalesce(timestamp < mx, false) as stale from a),
c as (select *, arrival - lag(arrival) over (partition by stream, requester, question, timestamp order by arrival, seq) as gap from b where not stale),
r as (select *, sum((coalesce(gap, 0) >= {GATE["state_ttl_us"]})::int) over (partition by stream, requester, question, timestamp order by arrival, seq) as sess from c),
k as (select stream, requester, question, timestamp, sess, min((arrival, seq)) filter (confirmed and kind = 'propose') as p_at, arg_min(price, (arrival, seq)) filter (confirmed and kind = 'propose') as p_price,
 min((arrival, seq)) filter (confirmed and kind = 'dispute') as d_at from r group by all),
p as (select r.*, p_at, p_price, d_at, (arrival, seq) as own, row_number() over (partition by stream, requester, question, timestamp, sess, confirmed, kind order by arrival, seq) as nth from r join k using (stream, requester, question, timestamp, sess)),
score as (select stream, sender, p_at as score_at, price = p_price as agree from p where not confirmed and kind = 'propose' and nth <= 32 and own < p_at),
trust as (select p.stream, p.own, count(*) filter (agree) as x, count(*) filter (not agree) as y from p left join score c on c.stream = p.stream and c.sender = p.sender and c.score_at < p.own where not confirmed group by 1, 2),
pend as (select q.stream, q.own, max((o.arrival, o.seq, o.tip_gwei)) as last from (select *, (arrival, seq) as own from {CALLS} where confirmed and kind = 'propose') q join {CALLS} o on o.stream = q.stream and o.tx = q.tx and not o.confirmed and (o.arrival, o.seq) < q.own group by 1, 2),
tip as (select stream, own, own[1] as tip_arrival, last[3] as tip from pend where own[1] - last[1] < {GATE["tip_window_us"]}),
floors as (select p.stream, p.own, case when count(tip) >= 20 then list_extract(list_sort(list(tip)), 1 + floor((count(tip) - 1) * 0.05 + 0.5)::bigint) end as lowest from p join tip t on t.stream = p.stream and t.own < p.own and p.arrival - tip_arrival <= {GATE["tip_window_us"]} where not confirmed group by 1, 2),
j as (select p.*, coalesce(d_at < p.own, false) as disputed, coalesce(p_at < p.own, false) as proposed, coalesce(tip_gwei < lowest, false) as low, kind = 'dispute' as dispute,
 x + y >= {GATE["trust_min_n"]} and (x + 1) / (x + y + 2) - 1.645 * sqrt((x + 1) / (x + y + 2) * (1 - (x + 1) / (x + y + 2)) / (x + y + 3)) >= {GATE["trust_min_rate"]} as trusted
 from p left join trust on trust.stream = p.stream and trust.own = p.own left join floors on floors.stream = p.stream and floors.own = p.own),
f as (select *, not confirmed and not disputed and not low and (dispute or (not proposed and trusted)) as fit from j),
g as (select *, min(own) filter (fit) over w as f_at, arg_min(price, own) filter (fit) over w as f_price from f window w as (partition by stream, requester, question, timestamp, sess, kind))
select stream, arrival, seq, case when confirmed then null when disputed then 'AlreadyDisputed' when not dispute and proposed then 'AlreadyProposed' when f_at < own then case when dispute or f_price = price then 'Duplicate' else 'Conflict' end
 when not dispute and not trusted then 'Untrusted' when low then 'LowTip' else 'Emit' end as verdict from g
union all select stream, arrival, seq, 'StaleRound' from b where stale)"""


def gate_rows(d) -> DataFrame:
    # shuffled first: texts are aggregated by sorting, which before the shuffle would join hardly any rows
    li = d.lineitem.repartition("l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_linestatus").alias("stream"), F.max("l_returnflag").alias("flag"), F.max("l_suppkey").alias("supp"), F.max("l_partkey").alias("part"), F.max("l_quantity").cast("long").alias("qty"))
    return li.select(
        "stream", (F.col("l_orderkey") * 1_000_000).alias("arrival"), F.col("l_linenumber").alias("seq"), F.when(F.col("flag") == "R", "dispute").otherwise("propose").alias("kind"), F.expr("supp div 10").alias("requester"),
        (F.col("part") % 3).alias("question"), F.expr("l_orderkey div 500").alias("timestamp"), (F.col("qty") % 5 == 0).cast("long").alias("price"), (F.col("part") % 40).alias("sender"), F.col("qty").alias("tip_gwei"), F.col("l_orderkey").cast("string").alias("tx"), (F.col("l_linenumber") == 7).alias("confirmed"),
    )


@query(f"select * from {VERDICTS}")
def gate_verdicts(d):
    return gate.gate(gate_rows(d), "stream", gate.GateSettings(**GATE)).select("stream", "arrival", "seq", "verdict")


@query(f"select verdict, count(*) as n from {VERDICTS} where verdict <> 'Emit' group by 1")
def dropped_by_reason(d):
    return gate_verdicts(d).filter("verdict <> 'Emit'").groupBy("verdict").agg(F.count("*").alias("n"))


@query()
def decoded_logs(d):
    """Calls built from documents, put through synthetic logs and the decoder."""
    from opalstream.functions import abi

    b = lambda x, n: F.unhex(F.lpad(F.hex(x), 2 * n, "0"))
    call = F.struct(F.lit("propose").alias("kind"), F.lit(None).cast("binary").alias("actor"), b(F.col("doc_id"), 20).alias("requester"), b(F.lit(1), 32).alias("identifier"), b(F.col("doc_id"), 32).alias("timestamp"), F.concat(F.lit("title, market_id: "), (F.col("doc_id") + 1).cast("string")).cast("binary").alias("ancillary"), b(F.lit(0), 32).alias("price"))
    rows = d.documents.select(F.lit("0x" + "11" * 20).alias("address"), b(F.col("doc_id"), 20).alias("sender"), b(F.col("doc_id"), 32).alias("tx"), F.lit(0).cast("long").alias("ordinal"), call.alias("call"))
    out = abi.decode_logs(abi.synthetic_logs(rows), ["0x" + "11" * 20])
    return out.select(F.col("market_id").cast("long").alias("market_id"), "kind", "error", F.hex("question_id").alias("question_id"), F.hex("condition_id").alias("condition_id"))


@query("""select doc_id, error, case when error is null then doc_id + 1 end as market_id from (select doc_id, ['address', 'emitter', 'topic', 'topic_count', 'data', 'chain', 'request', 'missing_id', null, null][1 + doc_id % 10] as error from documents)""")
def decode_errors(d):
    """Log records of documents, most of them damaged in one way each: the first check that fails names the error."""
    from opalstream.functions import abi

    n = F.col("doc_id") % 10
    hexed = lambda x, n: F.lower(F.lpad(F.hex(x), 2 * n, "0"))
    said = F.when(n == 7, F.lit("no id")).otherwise(F.concat(F.lit("title, market_id: "), (F.col("doc_id") + 1).cast("string")))
    text = F.when(n == 6, F.lit("ff")).otherwise(F.lower(F.hex(said)))
    size = F.expr("cast(length(text) / 2 as bigint)")
    row = d.documents.select("doc_id", n.alias("n"), text.alias("text"))
    data = F.concat(F.lit("0x"), hexed(F.lit(1), 32), hexed(F.col("doc_id"), 32), hexed(F.lit(192), 32), hexed(F.lit(0), 32), hexed(F.lit(0), 32), hexed(F.lit(0), 32), hexed(size, 32), F.col("text"))
    topics = F.array(F.lit("0x" + abi.topic(abi.PROPOSE_EVENT)), F.concat(F.lit("0x"), hexed(F.col("doc_id"), 32)), F.lit("0x" + "0" * 64))
    logs = row.select(
        "doc_id", F.when(F.col("n") == 0, "0x11").when(F.col("n") == 1, "0x" + "22" * 20).otherwise("0x" + "11" * 20).alias("address"),
        F.when(F.col("n") == 2, F.array(F.lit("0x" + "00" * 32), topics[1], topics[2])).when(F.col("n") == 3, F.slice(topics, 1, 2)).otherwise(topics).alias("topics"),
        F.when(F.col("n") == 4, F.lit("0x00")).otherwise(data).alias("data"), F.when(F.col("n") == 5, F.lit("block")).otherwise("0x1").alias("blockNumber"), F.lit("0x0").alias("logIndex"),
        F.lit("").alias("blockHash"), F.concat(F.lit("0x"), hexed(F.col("doc_id"), 32)).alias("transactionHash"), F.lit(None).cast("string").alias("transactionIndex"), F.lit(False).alias("removed"),
    )
    return abi.decode_logs(logs, ["0x" + "11" * 20]).select("doc_id", "error", F.col("market_id").cast("long").alias("market_id"))


@query("""with r as (select conv_id * 7 % 5 as node_id, conv_id * 1000 + turn as at, case when conv_id % 9 <> 0 then conv_id // 40 % 3 end as started_at, conv_id % 50 = 0 as relay, case when conv_id % 9 = 0 then turn % 2 = 0 end as drain from conversations),
b as (select *, last_value(case when drain is null then started_at end ignore nulls) over (partition by node_id order by at, drain nulls first, started_at nulls first, relay rows between unbounded preceding and 1 preceding) as last from r),
c as (select *, drain is null and coalesce(last <> 0, false) and last is distinct from started_at as restarted from b)
select node_id, at, restarted, coalesce(last_value(coalesce(drain, case when restarted or relay then false end) ignore nulls) over (partition by node_id order by at, drain nulls first, started_at nulls first, relay rows between unbounded preceding and current row), false) as desired_drain from c""")
def node_registry(d):
    c = F.col("conv_id")
    rows = d.conversations.select((c * 7 % 5).alias("node_id"), (c * 1000 + F.col("turn")).alias("at"), F.when(c % 9 != 0, F.expr("conv_id div 40 % 3")).alias("started_at"), (c % 50 == 0).alias("relay"), F.when(c % 9 == 0, F.col("turn") % 2 == 0).alias("drain"))
    return console.registry(rows)


@query("""with r as (select user_id as request, epoch_us(ts) as at, ['truth', 'asked', 'answered', 'signal'][1 + event_id % 4] as kind from events), m as (select max(at) as now from r),
s as (select *, min(at) over (partition by request) as f, min(case when kind = 'truth' then at end) over w as truth, count(*) filter (kind = 'asked') over w - count(*) filter (kind = 'answered') over w as asked, coalesce(lead(at) over (partition by request order by at, kind), (select now from m)) as nxt from r window w as (partition by request order by at, kind rows unbounded preceding)),
d as (select *, greatest(at, case when asked > 0 then f + 3600000000 else least(truth + 150000000, f + 900000000) end) as due from s)
select request, min(due) as settled_at, arg_min(coalesce(truth, -1), (due, at)) as truth_at from d where due < nxt group by 1""")
def settle_times(d):
    rows = d.log.select(F.col("user_id").alias("request"), "at", F.element_at(F.array(*map(F.lit, ("truth", "asked", "answered", "signal"))), (F.col("event_id") % 4 + 1).cast("int")).alias("kind"))
    now = rows.agg(F.max("at")).first()[0]
    return analytics.settle_times(rows, "request", "at", "kind", F.lit(now).cast("long")).withColumn("truth_at", F.coalesce("truth_at", F.lit(-1)))


@query("""with s as (select event_type as source, max(event_id) filter (event_id % 3 > 0) - 400 as verified, epoch_us(max(ts) filter (event_id % 7 = 0)) as last_us from events group by 1), h as (select max(event_id) - 5 as top, epoch_us(max(ts)) as now from events),
r as (select source, case when source = 'view' then null when source = 'cart' then top + 3 else verified end as verified, last_us, top, now from s, h)
select source, verdict, first, case when verdict = 'Quiet' then greatest(top, coalesce(verified, 0)) else top end as last, n as logs from (select *, case when verified is null or top <= verified or n = 0 then 'Quiet' else 'Missed' end as verdict
 from (select *, case when verified < top then greatest(verified + 1, top - 249) end as first, case when verified < top then (select count(*) from events e where e.event_id >= greatest(r.verified + 1, r.top - 249) and e.event_id <= r.top and e.value > 50) else 0 end as n from r)) where now - last_us >= 60000000""")
def stall_checks(d):
    log = d.log
    head = log.agg((F.max("event_id") - 5).alias("top"), F.max("at").alias("now")).first()
    s = log.groupBy(F.col("event_type").alias("source")).agg((F.max(F.when(F.col("event_id") % 3 > 0, F.col("event_id"))) - 400).alias("verified"), F.max(F.when(F.col("event_id") % 7 == 0, F.col("at"))).alias("last_us"))
    s = s.withColumn("verified", F.when(F.col("source") == "view", None).when(F.col("source") == "cart", head.top + 3).otherwise(F.col("verified")))
    return catalog.stall_checks(s, log.filter("value > 50"), "event_id", head.top + 5, head.now, max_window=250)


@query(f"""with e as (select event_id, event_type, at, floor(value * 100)::bigint as v from {LOG}),
j as (select a.event_type, a.at, a.event_id as seq, list_sort(list(s.v)) as v from e a join e s on s.event_type = a.event_type and s.event_id % 2 = 1 and s.at <= a.at and a.at - s.at <= 43200000000 and (s.at < a.at or s.event_id < a.event_id) where a.event_id % 2 = 0 group by all)
select event_type, at, seq, v[1 + least(floor((len(v) - 1) * 0.05 + 0.5)::bigint, len(v) - 1)] as low from j where len(v) >= 20""")
def trailing_quantile(d):
    """A low quantile of the values of the last half day, for every other event of each kind."""
    log = d.log.select("event_type", "at", F.col("event_id").alias("seq"), F.floor(F.col("value") * 100).cast("long").alias("v"))
    return trailing.trailing_rank(log.filter("seq % 2 = 0"), log.filter("seq % 2 = 1"), ["event_type"], "at", "seq", "v", 43_200_000_000, 0.05, 20, "low")

"""The pending gate: which unconfirmed calls are passed on early.

Every rule is a window or a join, so verdicts depend on the rows alone, not on what shares a task:

* a call is stale if its market (requester, question) has seen a later timestamp;
* calls of one request (market and timestamp) form sessions, which end where nothing touches the request
  for `state_ttl_us`; stale calls touch nothing;
* a sender's trust at a call is the count of its earlier proposals that agreed or not with the first
  confirmed one of their session, up to MOST_PENDING of a session, once that is confirmed;
* the tip floor at a call is a quantile of the tips of proposals confirmed within `tip_window_us` before
  whose transaction was seen pending, found by counting (operators.trailing);
* within a session, the first call that is trusted and not below the floor is passed on.

Rows: stream, arrival (microseconds), seq, kind ('propose' or 'dispute'), requester, question, timestamp,
price, sender, tip_gwei, tx, confirmed.  (arrival, seq) orders the rows of a stream and names them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalstream.functions.columns import lower_bound_trust
from opalstream.operators.trailing import trailing_rank
from opalstream.shared import materialised

MOST_PENDING = 32
MARKET = ["requester", "question"]
ORDER = ["arrival", "seq"]
#: Stands for the verdict of a confirmed row in `was`.
CONFIRMED = "confirmed"


@dataclass(frozen=True)
class GateSettings:
    # The service's defaults.
    trust_min_n: int = 50
    trust_min_rate: float = 0.98
    tip_quantile: float = 0.05
    tip_window_us: int = 3_600_000_000
    tip_min_samples: int = 20
    state_ttl_us: int = 7 * 86_400_000_000


def _before(*by: str):
    return Window.partitionBy(*by).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)


def _some(c: Column, w) -> Column:
    return F.coalesce(F.max(c).over(w), F.lit(False))


def sessions(rows: DataFrame, stream: str, s: GateSettings, rounds: DataFrame | None = None) -> DataFrame:
    """Adds _stale, _session (null for stale calls), and what the session has seen before the row.  All windows lie within
    a market, so the rows are shuffled once, and what one window has sorted is all but sorted for the next.

    rounds (stream, requester, question, timestamp): latest rounds known before the first row."""
    market = [*MARKET, stream]
    request = [*market, "timestamp", "_stale"]
    seen = F.max("timestamp").over(_before(*market))
    if rounds is not None:
        rows = rows.join(rounds.select(*market, F.col("timestamp").alias("_known")), market, "left")
        seen = F.greatest(seen, F.col("_known"))
    rows = rows.withColumn("_stale", ~F.col("confirmed") & F.coalesce(F.col("timestamp") < seen, F.lit(False)))
    gap = F.col("arrival") - F.lag("arrival").over(Window.partitionBy(*request).orderBy(*ORDER))
    rows = rows.drop("_known").withColumn("_gap", F.coalesce(gap >= s.state_ttl_us, F.lit(False)).cast("int"))
    rows = rows.withColumn("_session", F.when(~F.col("_stale"), F.sum("_gap").over(Window.partitionBy(*request).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))))
    propose, confirmed = F.col("kind") == "propose", F.col("confirmed")
    w, whole = _before(*request, "_session"), Window.partitionBy(*request, "_session")
    first = F.min(F.when(confirmed & propose, F.struct(*ORDER, "price"))).over(whole)
    rows = rows.drop("_gap").withColumns({
        "_disputed": _some(confirmed & ~propose, w), "_proposed": _some(confirmed & propose, w),
        "_earlier": F.coalesce(F.count_if(~confirmed & propose).over(w), F.lit(0)),
    })
    return rows.withColumn("_truth", first)  # after the others, so that their order serves


def _tips(rows: DataFrame, stream: str, s: GateSettings) -> DataFrame:
    """stream, arrival, seq and tip of the proposals confirmed soon enough after their transaction was last seen pending."""
    some = rows.filter("not confirmed or kind = 'propose'").select(stream, *ORDER, "tx", "confirmed", "tip_gwei")
    pending = F.last(F.when(~F.col("confirmed"), F.struct("arrival", "tip_gwei")), ignorenulls=True).over(_before("tx", stream))
    seen = some.withColumn("_seen", pending).filter("confirmed and _seen is not null").filter(F.col("arrival") - F.col("_seen.arrival") < s.tip_window_us)
    return seen.select(stream, *ORDER, F.col("_seen.tip_gwei").alias("tip"))


def _scores(rows: DataFrame, stream: str) -> DataFrame:
    """Of sessions' rows: stream, sender, arrival, seq (of the confirmation that scores) and agree."""
    pending = ~F.col("confirmed") & ~F.col("_stale") & (F.col("kind") == "propose") & ~F.col("_proposed") & (F.col("_earlier") < MOST_PENDING)
    scored = rows.filter(pending & F.col("_truth").isNotNull())
    return scored.select(stream, "sender", F.col("_truth.arrival").alias("arrival"), F.col("_truth.seq").alias("seq"), F.col("price").eqNullSafe(F.col("_truth.price")).alias("agree"))


def sender_scores(rows: DataFrame, stream: str, settings: GateSettings | None = None) -> DataFrame:
    """stream, sender, agree, disagree over all rows."""
    scores = _scores(sessions(rows, stream, settings or GateSettings()), stream)
    return scores.groupBy(stream, "sender").agg(F.count_if("agree").alias("agree"), F.count_if(~F.col("agree")).alias("disagree"))


def _trust(asked: DataFrame, scores: DataFrame, stream: str, s: GateSettings, known: DataFrame | None) -> DataFrame:
    """asked (stream, sender, arrival, seq) with trusted: by the scores before."""
    by = [stream, "sender"]
    both = asked.withColumn("agree", F.lit(None).cast("boolean")).unionByName(scores)
    w = Window.partitionBy(*by).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({"_a": F.count_if("agree").over(w), "_d": F.count_if(~F.col("agree")).over(w)}).filter("agree is null")
    if known is not None:
        out = out.join(known.select(*by, F.col("agree").alias("_ka"), F.col("disagree").alias("_kd")), by, "left")
        out = out.withColumns({"_a": F.col("_a") + F.coalesce("_ka", F.lit(0)), "_d": F.col("_d") + F.coalesce("_kd", F.lit(0))})
    return out.select(stream, *ORDER, ((F.col("_a") + F.col("_d") >= s.trust_min_n) & (lower_bound_trust(F.col("_a"), F.col("_d")) >= s.trust_min_rate)).alias("_trusted"))


def tip_floors(asked: DataFrame, tips: DataFrame, stream: str, s: GateSettings) -> DataFrame:
    """The rows of asked (stream, arrival, seq and others) with _floor, null without samples enough; tips (stream, arrival,
    seq, tip)."""
    return trailing_rank(asked, tips, [stream], "arrival", "seq", "tip", s.tip_window_us, s.tip_quantile, s.tip_min_samples, "_floor", every=True)


def delivered_once(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: what a feed delivers again is no new row.  Of rows that differ the one that was judged
    before counts, else the least of them, column by column."""
    some = [n for n, t in rows.dtypes if n not in key and not t.startswith("map")]
    w = Window.partitionBy(*key).orderBy(*([F.col("was").isNull()] if "was" in some else []), *some)
    # shuffled first: hardly any row is delivered twice, so nothing is gained by a sort before the shuffle
    return rows.repartition(*key).withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def gate(rows: DataFrame, stream: str, settings: GateSettings | None = None, rounds: DataFrame | None = None, trust: DataFrame | None = None) -> DataFrame:
    """rows with `verdict`, null for confirmed ones: Emit, or why a call is dropped.  A row delivered twice is judged, and
    returned, once.

    rounds and trust (stream, sender, agree, disagree): what is known from before the first row.  A column `was`
    holds the verdicts of rows that have been judged before; they stand."""
    s = settings or GateSettings()
    key = [*ORDER, stream]
    seen = materialised(sessions(delivered_once(rows, key), stream, s, rounds), "sessions")  # five uses below
    asked = seen.filter("not confirmed and not _stale and not _disputed")
    trusted = _trust(asked.filter("kind = 'propose' and not _proposed").select(stream, "sender", *ORDER), _scores(seen, stream), stream, s, trust)
    # a floor matters for disputes and for proposals of trusted senders
    able = trusted.filter("_trusted").unionByName(asked.filter("not kind <=> 'propose'").select(stream, *ORDER, F.lit(False).alias("_trusted")))
    # range shuffles look at their rows twice
    able, tips = materialised(able, "able"), materialised(_tips(seen, stream, s), "tips")
    out = seen.join(tip_floors(able, tips, stream, s), key, "left")
    propose = F.col("kind") == "propose"
    low = F.coalesce(F.col("tip_gwei") < F.col("_floor"), F.lit(False))
    open_ = ~F.col("confirmed") & ~F.col("_stale") & ~F.col("_disputed")
    fit = open_ & ~low & F.when(propose, ~F.col("_proposed") & F.coalesce("_trusted", F.lit(False))).otherwise(True)
    if "was" in rows.columns:
        fit = F.coalesce(F.col("was") == "Emit", fit)
    w = _before("timestamp", *MARKET, stream, "_stale", "_session", "kind")
    passed = F.first(F.when(fit, F.struct("price")), ignorenulls=True).over(w)
    out = out.withColumns({"_passed": passed, "_low": low})
    verdict = (
        F.when(F.col("confirmed"), F.lit(None).cast("string")).when(F.col("_stale"), "StaleRound").when(F.col("_disputed"), "AlreadyDisputed").when(propose & F.col("_proposed"), "AlreadyProposed")
        .when(F.col("_passed").isNotNull(), F.when(~propose | F.col("_passed.price").eqNullSafe(F.col("price")), "Duplicate").otherwise("Conflict"))
        .when(propose & ~F.coalesce("_trusted", F.lit(False)), "Untrusted").when(F.col("_low"), "LowTip").otherwise("Emit")
    )
    return out.withColumn("verdict", verdict).select(*rows.columns, "verdict")


def carried(rows: DataFrame, stream: str, settings: GateSettings, now: int, rounds: DataFrame, trust: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the next rows need of rows up to `now`: the rows of sessions and transactions that aren't over, and
    rounds and trust brought up to date with those that are."""
    s = sessions(rows, stream, settings, rounds)
    request = [stream, *MARKET, "timestamp", "_stale", "_session"]
    s = s.withColumn("_last", F.max("arrival").over(Window.partitionBy(*request)))
    live = F.when(F.col("_stale"), F.lit(now) - F.col("arrival") < settings.tip_window_us).otherwise(F.lit(now) - F.col("_last") < settings.state_ttl_us)
    # a session's tip may still count, and a transaction may still be confirmed, for the length of the tip window
    live = live | (F.lit(now) - F.col("arrival") <= 2 * settings.tip_window_us)
    whole = F.max(live).over(Window.partitionBy(*request))
    s = s.withColumn("_live", F.when(F.col("_stale"), live).otherwise(whole))
    over = s.filter(~F.col("_live"))
    done = _scores(over, stream).groupBy(stream, "sender").agg(F.count_if("agree").alias("agree"), F.count_if(~F.col("agree")).alias("disagree"))
    trust = trust.unionByName(done).groupBy(stream, "sender").agg(F.sum("agree").alias("agree"), F.sum("disagree").alias("disagree"))
    market = [stream, *MARKET]
    rounds = rounds.unionByName(over.select(*market, "timestamp")).groupBy(*market).agg(F.max("timestamp").alias("timestamp"))
    return s.filter("_live").select(*rows.columns), rounds, trust

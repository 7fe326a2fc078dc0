"""Races against ground truth, Bayesian edges, triangulation, peer seats, forfeits and matching."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush, nsmallest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalstream.operators.scans import key_text
from opalstream.shared import materialised
from opalstream.functions.columns import game, normal_name, ratio, safe_int, truthy


# --- races


def first_truth(rows: DataFrame, key: list[str], price: str, block: str, index: str) -> DataFrame:
    """key, truth: the price at the smallest (block, index), the smallest such."""
    return rows.groupBy(*key).agg(F.min_by(price, F.struct(block, index, price)).alias("truth"), F.min(block).alias("truth_block"))


def race(pending: DataFrame, confirmed: DataFrame, signal: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join of the three paths and the truth by request key (unique in each)."""
    return pending.join(confirmed, key, "full_outer").join(signal, key, "full_outer").join(truth, key, "full_outer")


def outcome_rates(rows: DataFrame, by: list[str], predicted: Column, truth: Column, late: Column) -> DataFrame:
    """correct, wrong, no_truth, late, coverage and accuracy; rates are null where there is nothing to divide by."""
    known = truth.isNotNull()
    out = rows.groupBy(*by).agg(
        F.count_if(known & (predicted == truth)).alias("correct"), F.count_if(known & predicted.isNotNull() & (predicted != truth)).alias("wrong"), F.count_if(predicted.isNotNull() & ~known).alias("no_truth"),
        F.count_if(late).alias("late"), F.count_if(predicted.isNotNull()).alias("seen"), F.count_if(known).alias("truths"),
    )
    return out.withColumn("accuracy", ratio(F.col("correct"), F.col("correct") + F.col("wrong"))).withColumn("coverage", ratio(F.col("seen"), F.col("truths")))


# A request is settled so many microseconds after its truth, after it began, and at the latest.
SETTLE_AFTER_TRUTH, SETTLE_WITHOUT, SETTLE_LATEST = 150_000_000, 900_000_000, 3_600_000_000


def settle_times(rows: DataFrame, request: str, at_us: str, kind: str, now: Column) -> DataFrame:
    """request, settled_at, truth_at of the requests that are settled before `now`, from rows of kinds 'truth', 'asked' and
    'answered' (receipts) and others.

    Between one row and the next a request is settled 150 s after its truth or 900 s after it began, but at 3600 s while
    receipts are outstanding, if the next row isn't there first (one of the same time is)."""
    order = Window.partitionBy(request).orderBy(at_us, kind)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda k: F.col(kind) == k
    out = rows.filter(F.col(at_us).isNotNull()).withColumns({
        "_first": F.min(at_us).over(Window.partitionBy(request)), "_truth": F.min(F.when(is_("truth"), F.col(at_us))).over(so_far),
        "_asked": F.count_if(is_("asked")).over(so_far) - F.count_if(is_("answered")).over(so_far), "_next": F.coalesce(F.lead(at_us).over(order), now),
    })
    soon = F.least(F.col("_truth") + SETTLE_AFTER_TRUTH, F.col("_first") + SETTLE_WITHOUT)
    due = F.greatest(F.col(at_us), F.when(F.col("_asked") > 0, F.col("_first") + SETTLE_LATEST).otherwise(soon))
    out = out.withColumn("_due", due).filter("_due < _next")
    return out.groupBy(request).agg(F.min("_due").alias("settled_at"), F.min_by("_truth", F.struct("_due", at_us)).alias("truth_at"))


def settled(rows: DataFrame, now: Column, truth_at: str, first_at: str, outstanding: str) -> Column:
    """Whether a request is settled: 150 s after its truth, or 900 s after it began, or 3600 s while receipts are outstanding (seconds)."""
    age = now - F.col(first_at)
    return F.coalesce(now - F.col(truth_at) >= 150, F.lit(False)) | (age >= F.when(F.col(outstanding), 3600).otherwise(900))


def hourly(rows: DataFrame, at: str, hours: int, now: int) -> DataFrame:
    """hour (of the epoch), n for the last hours, 0 where there is nothing; at and now in seconds."""
    last = now // 3600
    every = rows.sparkSession.range(last - hours + 1, last + 1).select(F.col("id").alias("hour"))
    seen = rows.select(F.expr(f"{at} div 3600").alias("hour")).groupBy("hour").agg(F.count("*").alias("n"))
    return every.join(seen, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


# --- Bayesian edges


def dirichlet(rows: DataFrame, parent: str, child: str, alpha: float = 2.0, base_alpha: float = 1.0, vocabulary: int = 2000) -> DataFrame:
    """parent, child, n, p, lift: (c + alpha * base) / (n + alpha), base being the child's own smoothed share."""
    rows = rows.filter(F.col(parent).isNotNull() & F.col(child).isNotNull())
    cell = rows.groupBy(parent, child).agg(F.count("*").alias("c"))
    per_parent = cell.groupBy(parent).agg(F.sum("c").alias("n"))
    per_child = cell.groupBy(child).agg(F.sum("c").alias("m"))
    total = cell.agg(F.sum("c").alias("t"))
    out = cell.join(per_parent, parent).join(per_child, child).crossJoin(F.broadcast(total))  # one row
    base = (F.col("m") + base_alpha / vocabulary) / (F.col("t") + base_alpha)
    out = out.withColumn("base", base).withColumn("p", (F.col("c") + alpha * F.col("base")) / (F.col("n") + alpha))
    return out.select(parent, child, F.col("c").alias("n"), "p", (F.col("p") / F.col("base")).alias("lift"))


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """bits shared by two columns, over rows where both are there."""
    cell = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("c"))
    pa, pb, t = cell.groupBy(a).agg(F.sum("c").alias("ca")), cell.groupBy(b).agg(F.sum("c").alias("cb")), cell.agg(F.sum("c").alias("t"))
    each = cell.join(pa, a).join(pb, b).crossJoin(F.broadcast(t))
    return each.agg(F.coalesce(F.sum(F.col("c") / F.col("t") * F.log2(F.col("c") * F.col("t") / (F.col("ca") * F.col("cb")))), F.lit(0.0)).alias("bits"))


def _before(codes: np.ndarray) -> np.ndarray:
    """How often each element has come before."""
    order = np.argsort(codes, kind="stable")
    at = codes[order]
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    out = np.empty(len(codes), np.int64)
    out[order] = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    return out


def prequential_bf(rows: DataFrame, stream: list[str], order: list[str], parent: str, child: str, alpha: float = 2.0, base_alpha: float = 1.0, vocabulary: int = 2000) -> DataFrame:
    """stream, n, log10_bf: sum over rows of log10 of the conditional over the marginal prediction, each from the rows
    before it in its stream; without decay these are running counts.

    Rows are sorted once and gone through batch by batch; what is held of a stream is how often each parent, child and
    pair has come."""
    names = list(dict.fromkeys(stream))
    rows = rows.filter(F.col(parent).isNotNull() & F.col(child).isNotNull())
    rows = rows.select(*dict.fromkeys([*stream, *order]), key_text(stream).alias("_k"), F.col(parent).alias("_a"), F.col(child).alias("_b"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, first, n, total, seen = None, None, 0, 0.0, {}

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*first.columns, pa.array([n], pa.int64()), pa.array([total])], [*names, "n", "log10_bf"])

        for batch in batches:
            if not batch.num_rows:
                continue
            done = []
            k, a, b = (batch.column(c).dictionary_encode() for c in ("_k", "_a", "_b"))
            ks = k.indices.to_numpy(zero_copy_only=False)
            x, y = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (a, b))
            xs, ys = ([str(v) for v in c.dictionary.to_pylist()] for c in (a, b))  # so that a NaN is itself
            kinds = [(x, lambda i: (0, xs[i])), (y, lambda i: (1, ys[i])), (x * len(ys) + y, lambda i: (xs[i // len(ys)], ys[i % len(ys)], 2))]
            cuts = (np.flatnonzero(ks[1:] != ks[:-1]) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, len(ks)]):
                if (key := k.dictionary[int(ks[i])].as_py()) != mine or first is None:
                    if first is not None:
                        done.append(ended())
                    mine, first, n, total, seen = key, batch.select(names).slice(i, 1), 0, 0.0, {}
                counts = []
                for codes, name in kinds:
                    some, where, times = np.unique(codes[i:j], return_inverse=True, return_counts=True)
                    keys = [name(int(c)) for c in some]
                    had = np.array([seen.get(c, 0) for c in keys], np.int64)
                    counts.append((had[where] + _before(where)).astype(float))
                    seen.update(zip(keys, (had + times).tolist()))
                of_parent, of_child, of_both = counts
                base = (of_child + base_alpha / vocabulary) / (n + np.arange(j - i) + base_alpha)
                total += float(np.log10((of_both + alpha * base) / (of_parent + alpha) / base).sum())
                n += j - i
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if first is not None:
            yield ended()

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), "n long, log10_bf double"])
    return rows.repartition("_k").sortWithinPartitions("_k", *order).mapInArrow(fold, schema)


def beta_interval(a: Column, b: Column, draws: int = 1500, seed: int = 7) -> Column:
    """struct(low, high): the 5 and 95 per cent points of seeded draws."""

    @F.pandas_udf("low double, high double")
    def interval(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        s = np.sort(rng.beta(x.to_numpy()[:, None], y.to_numpy()[:, None], (len(x), draws)), axis=1) if len(x) else np.zeros((0, draws))
        return pd.DataFrame({"low": s[:, int(0.05 * draws)], "high": s[:, int(0.95 * draws)]})

    return interval(a, b)


def verdict(log10_bf: Column) -> Column:
    return F.when(log10_bf > 2, "strong").when(log10_bf > 0.5, "some").when(log10_bf < -1, "against").otherwise("insufficient")


# --- triangulation


def quarter_rtt(rows: DataFrame, observer: str, peer: str, rtt: str) -> DataFrame:
    """observer, half_rtt: half the element number n // 4 of its peers' least round trips; at least two peers."""
    least = rows.groupBy(observer, peer).agg(F.min(rtt).alias("_r"))
    ranked = least.withColumn("_i", F.row_number().over(Window.partitionBy(observer).orderBy("_r", peer)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(observer)))
    return ranked.filter((F.col("_n") >= 2) & (F.col("_i") == F.expr("_n div 4"))).select(observer, (F.col("_r") / 2).alias("half_rtt"))


def region_posterior(arrivals: DataFrame, calibration: DataFrame, block: str, observer: str, region: str, sigma: float = 12.0, nu: float = 3.0, temper: float = 4.0, weight: Column | None = None) -> DataFrame:
    """region, logw, p: Student-t log likelihoods of arrival offsets (ms, from the first) less the calibrated delay,
    each block's centred on its mean, tempered, weighted and summed, as a share."""
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(sigma)
    rows = arrivals.join(calibration, observer)
    rows = rows.withColumn("_d", F.col("offset_ms") - F.col("delay_ms"))
    mean = rows.groupBy(block, region).agg(F.avg("_d").alias("_mean"))
    x = (F.col("_d") - F.col("_mean")) / sigma
    ll = rows.join(mean, [block, region]).groupBy(region).agg(F.sum((F.lit(1.0) if weight is None else weight) * (const - (nu + 1) / 2 * F.log1p(x * x / nu)) / temper).alias("logw"))
    top = ll.agg(F.max("logw").alias("_m"))
    w = F.exp(F.col("logw") - F.col("_m"))
    out = ll.crossJoin(F.broadcast(top)).withColumn("_w", w)
    return out.crossJoin(F.broadcast(out.agg(F.sum("_w").alias("_z")))).select(region, "logw", (F.col("_w") / F.col("_z")).alias("p"))


def region_posterior_recent(arrivals: DataFrame, calibration: DataFrame, block: str, order: str, observer: str, region: str, half_life: float = 2000, keep: int = 3000, **kind) -> DataFrame:
    """As region_posterior over the last `keep` blocks by order, a block's evidence halved with every half_life blocks
    that came after it.  All kept blocks are scored by the calibration given, so a new one rescores them.  Observers
    that lack a region's delay and blocks seen by fewer than two observers count for nothing."""
    regions = calibration.select(region).distinct().agg(F.count("*").alias("_regions"))
    known = calibration.groupBy(observer).agg(F.count("*").alias("_n")).crossJoin(F.broadcast(regions)).filter("_n = _regions").select(observer)
    rows = arrivals.join(known, observer, "left_semi")
    seen = rows.groupBy(block).agg(F.min(order).alias("_order"), F.count("*").alias("_n")).filter("_n >= 2")
    last = seen.orderBy(F.col("_order").desc(), F.col(block).desc()).limit(keep)  # the window below holds no more
    age = F.row_number().over(Window.orderBy(F.col("_order").desc(), F.col(block).desc())) - 1
    weight = last.select(block, F.pow(F.lit(0.5), age / half_life).alias("_weight"))
    return region_posterior(rows.join(weight, block), calibration, block, observer, region, weight=F.col("_weight"), **kind)


# --- stitching


def stitched(public: DataFrame, included: DataFrame, status: DataFrame, events: DataFrame, authors: DataFrame, now: Column) -> DataFrame:
    """One row for each transaction whose fate is settled: hash, outcome, visible, sender, match, tip, peer, author,
    category, lead_ms.

    public (hash, sender, match, tip, peer, first_us), included (hash, sender, match, tip, number, in_pool, at_us),
    status (hash, status), events (hash, category, recv_us), unique by hash; authors (number, author).  Times in
    microseconds; a transaction's age counts from what came first.  An included one is settled once its status is
    known, with its author or after 300 s, and with its event, a failure, or after 90 s; one that isn't is given up
    after 600 s: `not_included` if it was public, else it is left out.
    """
    name = lambda df, tag, keep=(): df.select("hash", *[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c != "hash"], F.lit(True).alias(tag))
    t = name(public, "p").join(name(included, "i"), "hash", "full_outer").join(name(events, "e"), "hash", "full_outer")
    t = t.join(status, "hash", "left").join(authors.select(F.col("number").alias("i_number"), "author"), "i_number", "left")
    age = (now - F.least("p_first_us", "i_at_us", "e_recv_us")) / 1e6
    good = F.col("status") == "success"
    known = F.col("status").isNotNull() & (F.col("author").isNotNull() | (age > 300)) & (F.col("e").isNotNull() | ~good | (age > 90))
    visible = F.col("p").isNotNull() & F.coalesce("i_in_pool", F.lit(True))
    outcome = F.when(F.col("i").isNotNull(), F.when(known, F.col("status"))).when((age > 600) & visible, "not_included")
    out = t.withColumn("visible", visible).withColumn("outcome", outcome).filter("outcome is not null")
    lead = F.when(F.col("visible"), (F.col("e_recv_us") - F.col("p_first_us")) / 1000.0)
    category = F.coalesce("e_category", F.when(F.col("outcome") == "success", "unenriched"))
    return out.select(
        "hash", "outcome", "visible", F.coalesce("p_sender", "i_sender").alias("sender"), F.coalesce("p_match", "i_match").alias("match"), F.coalesce("p_tip", "i_tip").alias("tip"),
        F.when(F.col("visible"), F.col("p_peer")).alias("peer"), "author", category.alias("category"), lead.alias("lead_ms"),
    )


# --- peer seats


def streaks_below(rows: DataFrame, peer: str, epoch: str, share: str, below: float, rounds: int) -> DataFrame:
    """peer, epoch of each row that is the rounds-th or later in a row below the bar."""
    w = Window.partitionBy(peer).orderBy(epoch)
    rows = rows.withColumn("_ok", (F.col(share) >= below).cast("int")).withColumn("_g", F.sum("_ok").over(w))
    run = rows.withColumn("streak", F.sum(1 - F.col("_ok")).over(Window.partitionBy(peer, "_g").orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)))
    return run.filter(F.col("streak") >= rounds).select(peer, epoch, "streak")


def elimination(rows: DataFrame, trial: str, peer: str, share: str, keep: int) -> DataFrame:
    """rows with place from the worst, and out: not among the best `keep` of its trial."""
    w = Window.partitionBy(trial)
    out = rows.withColumn("place", F.row_number().over(w.orderBy(share, peer))).withColumn("_n", F.count("*").over(w))
    return out.withColumn("out", F.col("place") <= F.col("_n") - keep).drop("_n")


SEAT_COLUMNS = ["share", "online", "silent", "observed", "seen", "home", "exploring"]


@dataclass(frozen=True)
class SeatRules:
    # Seat rules, in hours and shares.
    promote: float = 0.01
    demote: float = 0.007
    demote_rounds: int = 2
    core_max: int = 30
    trial_seats: int = 5
    least_seen: int = 20
    lost_hours: int = 24
    cooldown_hours: tuple[int, ...] = (24, 72, 168)
    silent_hours: int = 72
    stable_hours: int = 168
    home_floor: int = 2
    explore_seats: int = 0  # trial seats more while exploring


def seats(rows: DataFrame, network: list[str], peer: str, epoch: str, rules: SeatRules | None = None) -> DataFrame:
    """network, epoch, peer, state, reason, cooldowns at each evaluation.

    rows, one for each peer that is known at an evaluation: epoch (hours), share (the best of its shares), online,
    silent (online, forwarded nothing), observed (its trial is long enough), seen (what there was to see), home
    (counts towards home_floor), and maybe exploring (whether the evaluation lies in an exploration).  A peer without a
    row is offline.

    At an evaluation, in this order: a core that is offline is lost, a trial candidate again; who comes online and
    was lost is core again, others fill free trial seats in order of name; who is silent and not core cools down;
    cooldowns end as candidate; a core below `demote` for `demote_rounds` evaluations goes back to trial, observed,
    unless the home floor needs it, and one stable for `stable_hours` forgets its cooldowns; a core lost for more
    than `lost_hours` is a candidate; observed trials at `promote` or above become core; beyond `core_max` the
    lowest shares go to trial; of the observed trials that are left the one with the lowest share cools down, 24
    hours the first time, 72 the second, 168 from then on.  While exploring there are `explore_seats` trial seats more;
    who takes one isn't cooled down as the lowest, and when the exploration is over stays on trial with `promote` or
    more, else is a candidate again, without a cooldown.

    Caps bind all peers of a network, so a network is folded evaluation by evaluation, one after the other; its
    peers are what is held.  An evaluation looks at who is online, core, trial, lost or due, not at all peers; what all
    are in after it is returned from arrays.
    """
    r = rules or SeatRules()
    columns = [*network, epoch, peer, *SEAT_COLUMNS]
    rows = rows if "exploring" in rows.columns else rows.withColumn("exploring", F.lit(False))
    n = len(network)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, now, here, all_ = None, None, {}, _Standing(r)
        for b in batches:
            fields = b.schema
            for row in zip(*(b.column(c).to_pylist() for c in columns)):
                net, at = row[:n], row[n]
                if at != now or net != mine:
                    if mine is not None:
                        yield all_.evaluated(here, mine, now, fields, names)
                    if net != mine:
                        all_ = _Standing(r)
                    mine, now, here = net, at, {}
                here[row[n + 1]] = row[n + 2 :]
        if mine is not None:
            yield all_.evaluated(here, mine, now, fields, names)

    names = [*network, epoch, peer, "state", "reason", "cooldowns"]
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in names[:-3]) + ", state string, reason string, cooldowns long"
    return rows.select(*columns).repartition(*network).sortWithinPartitions(*network, epoch, peer).mapInArrow(fold, schema)


@dataclass
class _Seat:
    state: str = "candidate"
    reason: str = ""
    cooldowns: int = 0
    until: float = 0
    below: int = 0
    since: float | None = None  # core since
    lost: float = 0
    observed: bool = False
    explore: bool = False


SEAT_STATES = ["candidate", "trial", "core", "lost", "cooldown"]


class _Network:
    """The seats of a network, and which peers are in which state, so that an evaluation needn't look at all of them."""

    def __init__(self, peers: dict, r: SeatRules):
        self.peers, self.rules = peers, r
        self.by_state: dict[str, set] = {s: set() for s in SEAT_STATES}
        for k, p in peers.items():
            self.by_state[p.state].add(k)
        self.due = [(peers[k].until, k) for k in self.by_state["cooldown"]]
        heapify(self.due)
        self.changed: set = set()

    def go(self, k, state: str, reason: str, **also) -> None:
        p = self.peers[k]
        self.by_state[p.state].discard(k)
        self.by_state[state].add(k)
        self.changed.add(k)
        p.state, p.reason, p.below, p.explore = state, reason, 0, False
        for name, v in also.items():
            setattr(p, name, v)

    def cool(self, k, reason: str, silent: bool, now: float) -> None:
        r, n = self.rules, self.peers[k].cooldowns + 1
        hours = r.cooldown_hours[min(n, len(r.cooldown_hours)) - 1]
        until = now + (max(hours, r.silent_hours) if silent else hours)
        self.go(k, "cooldown", reason, cooldowns=n, until=until)
        heappush(self.due, (until, k))

    def evaluate(self, here: dict, now: float) -> None:
        peers, r, go = self.peers, self.rules, self.go
        candidates, trial, core, lost, _ = (self.by_state[s] for s in SEAT_STATES)
        for k in here:
            if k not in peers:
                peers[k] = _Seat()
                candidates.add(k)
                self.changed.add(k)
        share = lambda k: here[k][0]
        exploring = any(v[6] for v in here.values())
        room = r.trial_seats + (r.explore_seats if exploring else 0)
        online = {k for k, v in here.items() if v[1]}
        lowest = lambda ks: min(ks, key=lambda k: (share(k), k))

        back = lost & online
        for k in core - online:
            go(k, "lost", "offline", lost=now)
        for k in trial - online:
            go(k, "candidate", "offline")
        for k in back:
            go(k, "core", "back", since=now if peers[k].since is None else peers[k].since)
        # whoever is core or trial is online from here on
        for k in nsmallest(max(0, room - len(trial)), online & candidates):
            go(k, "trial", "admitted", observed=False, explore=len(trial) >= r.trial_seats)
        for k in online:
            if here[k][2] and peers[k].state not in ("core", "cooldown"):
                self.cool(k, "silent", True, now)
        while self.due and now >= self.due[0][0]:
            until, k = heappop(self.due)
            if peers[k].state == "cooldown" and peers[k].until == until:
                go(k, "candidate", "cooled")
        homes = sum(here[k][5] for k in core)
        for k in sorted(core):
            p, home = peers[k], here[k][5]
            if here[k][4] < r.least_seen:
                continue
            p.below = p.below + 1 if share(k) < r.demote else 0
            if p.below >= r.demote_rounds and not (home and homes <= r.home_floor):
                homes -= home
                go(k, "trial", "demoted", observed=True)
            if p.since is not None and now - p.since > r.stable_hours:
                p.cooldowns = 0
                self.changed.add(k)
        for k in list(lost):
            if now - peers[k].lost > r.lost_hours:
                go(k, "candidate", "lost")
        for k in list(trial):
            peers[k].observed = peers[k].observed or here[k][3]
            if peers[k].observed and share(k) >= r.promote:
                go(k, "core", "promoted", since=now)
        for k in list(trial):
            if peers[k].explore and not exploring:
                peers[k].explore = False
                if share(k) < r.promote:
                    go(k, "candidate", "explored")
        if len(core) > r.core_max:
            for k in nsmallest(len(core) - r.core_max, core, key=lambda k: (share(k), k)):
                go(k, "trial", "over the cap", observed=True)
        if last := [k for k in trial if peers[k].observed and not peers[k].explore]:
            self.cool(lowest(last), "lowest", False, now)


class _Standing:
    """A network and, as arrays in the order in which its peers came, what they are in."""

    def __init__(self, r: SeatRules):
        self.network, self.at, self.labels = _Network({}, r), {}, {}
        self.state, self.reason, self.cooldowns = (np.zeros(64, t) for t in (np.int8, np.int8, np.int64))

    def evaluated(self, here: dict, net: tuple, now, fields: pa.Schema, names: list[str]) -> pa.RecordBatch:
        self.network.evaluate(here, now)
        for k in self.network.changed:
            i = self.at.setdefault(k, len(self.at))
            if i == len(self.state):
                self.state, self.reason, self.cooldowns = (np.concatenate([x, np.zeros_like(x)]) for x in (self.state, self.reason, self.cooldowns))
            p = self.network.peers[k]
            self.state[i], self.reason[i], self.cooldowns[i] = SEAT_STATES.index(p.state), self.labels.setdefault(p.reason, len(self.labels)), p.cooldowns
        self.network.changed.clear()
        n = len(self.at)
        types = [fields.field(c).type for c in names[:-3]]
        fixed = [pa.repeat(pa.scalar(v, t), n) for v, t in zip([*net, now], types)]
        text = lambda values, codes: pa.array(values, pa.string()).take(pa.array(codes[:n]))
        return pa.RecordBatch.from_arrays([*fixed, pa.array(list(self.at), types[-1]), text(SEAT_STATES, self.state), text(list(self.labels), self.reason), pa.array(self.cooldowns[:n])], names)


def _evaluate(peers: dict[str, _Seat], here: dict, now: float, r: SeatRules) -> dict[str, _Seat]:
    _Network(peers, r).evaluate(here, now)
    return peers


def seat_counts(seats: DataFrame, by: list[str]) -> DataFrame:
    """by, state, n."""
    return seats.groupBy(*by, "state").agg(F.count("*").alias("n"))


def exploration_report(rows: DataFrame, window: str, hit: Column, bar: float = 0.01) -> DataFrame:
    """window, seen, missed, miss_ratio, alert."""
    out = rows.groupBy(window).agg(F.count("*").alias("seen"), F.count_if(~hit).alias("missed"))
    return out.withColumn("miss_ratio", ratio(F.col("missed"), F.col("seen"))).withColumn("alert", F.coalesce(F.col("miss_ratio") > bar, F.lit(False)))


# --- forfeits and matching


def forfeit_events(rows: DataFrame) -> DataFrame:
    """Probe rows (all text) to events: series flag, map number, loser, numbers where they are numbers."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    a, b, won, num = text("team_a"), text("team_b"), text("winner"), text("game_num")
    loser = F.when(won == a, b).when(won == b, a).otherwise("")
    return rows.select(
        F.coalesce(F.nullif("source", F.lit("")), F.lit("pandascore")).alias("source"), game(F.col("game")).alias("game"), "league", "match_name", a.alias("team_a"), b.alias("team_b"), num.alias("game_num"),
        (num == "series").alias("is_series"), F.when(num != "series", safe_int(num)).alias("map_number"), won.alias("winner"), loser.alias("loser"), truthy(F.col("draw")).alias("draw"),
        safe_int(F.col("match_id")).alias("match_id"), F.trim("detect_epoch").try_cast("double").alias("detect_epoch"), "src_end_at",
    )


def new_rows(rows: DataFrame, history: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't in the history, once."""
    return rows.join(history.select(*key).distinct(), key, "left_anti").dropDuplicates(key)


# What a match's lookup has come to; it only improves.
LOOKUP_RANK = ["failed", "pending", "not_found", "matched"]


def blocklist(events: DataFrame, match: str, conditions: str, status: str, at: str, now: Column, ttl: int) -> DataFrame:
    """condition, match, added (first learned) of rows still within ttl, and the match's best status."""
    rank = F.array_position(F.array(*map(F.lit, LOOKUP_RANK)), F.col(status))
    best = events.groupBy(match).agg(F.max(rank).alias("_r")).select(match, F.element_at(F.array(*map(F.lit, LOOKUP_RANK)), F.col("_r").cast("int")).alias("best_status"))
    rows = events.select(match, at, F.explode(conditions).alias("condition")).groupBy("condition", match).agg(F.min(at).alias("added"))
    return rows.filter(now - F.col("added") < ttl).join(best, match)


def grown(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Rows whose new set isn't within the old one."""
    return rows.filter(F.size(F.array_except(new, old)) > 0)


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters."""
    some = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))
    return F.when(F.length(text) >= n, some).otherwise(F.array().cast("array<string>"))


def fuzzy_match(wanted: DataFrame, titles: DataFrame, spread: int = 16, hot: int = 10_000) -> DataFrame:
    """wanted (wanted_id, name_a, name_b, date_hint) to the best of titles (position, title, slug): both names must occur,
    a date in the slug is worth more, the first wins on ties.

    A title that holds a name holds all runs of three characters (of two or one, for shorter names) of it, so titles
    and names meet at one run of the longer name, the one that the fewest titles hold.  Distinct titles and distinct
    pairs of names are matched, each once; runs that more than `hot` titles hold are spread over `spread` tasks.
    """
    a, b = normal_name(F.col("name_a")), normal_name(F.col("name_b"))
    want = wanted.withColumn("_a", a).withColumn("_b", b).filter("_a <> '' and _b <> ''")
    pairs = want.select("_a", "_b").distinct().withColumn("_l", F.when(F.length("_a") >= F.length("_b"), F.col("_a")).otherwise(F.col("_b")))
    pairs = pairs.withColumn("_k", F.least(F.length("_l"), F.lit(3)))
    texts = titles.withColumn("_t", normal_name(F.col("title")))
    kinds = sorted(r[0] for r in pairs.select("_k").distinct().collect())  # 1, 2 and 3 at most
    if not kinds:
        return want.select("wanted_id", F.lit(None).cast(dict(titles.dtypes)["position"]).alias("position"), F.lit(None).cast("int").alias("score")).limit(0)
    runs = F.flatten(F.array(*[_grams(F.col("_t"), n) for n in kinds]))
    held = materialised(texts.select("_t").distinct().select("_t", F.explode(runs).alias("_g")), "runs")
    counts = held.groupBy("_g").agg(F.count("*").alias("_n"))
    asked = F.when(F.col("_k") == 3, _grams(F.col("_l"), 3)).otherwise(F.array("_l"))
    rare = pairs.select("_a", "_b", F.explode(asked).alias("_g")).join(counts, "_g").groupBy("_a", "_b").agg(F.min(F.struct("_n", "_g")).alias("_x"))
    rare = rare.select("_a", "_b", F.col("_x._g").alias("_g"), F.when(F.col("_x._n") > hot, spread).otherwise(1).alias("_s"))
    rare = rare.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    held = held.join(rare.select("_g", "_s").distinct(), "_g").withColumn("_part", F.pmod(F.xxhash64("_t"), F.col("_s")).cast("int"))
    found = held.select("_g", "_part", "_t").join(rare, ["_g", "_part"]).filter(F.expr("contains(_t, _a) and contains(_t, _b)")).select("_a", "_b", "_t")
    # of rows with the same title, the first without a date, and by date the first whose slug holds it
    first = texts.groupBy("_t").agg(F.min("position").alias("position"))
    plain = found.join(first, "_t").groupBy("_a", "_b").agg(F.min("position").alias("position"))
    dated = want.filter("date_hint <> ''").select("_a", "_b", "date_hint").distinct().join(found, ["_a", "_b"])
    slugs = texts.groupBy("_t", "slug").agg(F.min("position").alias("position"))
    dated = dated.join(slugs, "_t").filter(F.col("slug").contains(F.col("date_hint"))).groupBy("_a", "_b", "date_hint").agg(F.min("position").alias("_dated"))
    out = want.join(plain, ["_a", "_b"]).join(dated, ["_a", "_b", "date_hint"], "left")
    return out.select("wanted_id", F.coalesce("_dated", "position").alias("position"), F.when(F.col("_dated").isNotNull(), 7).otherwise(4).alias("score"))


def newest_forfeits(view: DataFrame, detected: str, limit: int) -> DataFrame:
    """Matches by time of detection, the last first."""
    return view.orderBy(F.col(detected).desc()).limit(limit)


def forfeit_view(markets: DataFrame, match: str) -> DataFrame:
    """match, markets: each match's blocked markets in order of game number, then kind of market."""
    rest = [c for c in markets.columns if c not in (match, "game_number", "market_type")]
    return markets.groupBy(match).agg(F.array_sort(F.collect_list(F.struct("game_number", "market_type", *rest))).alias("markets"))


def market_games(markets: DataFrame) -> DataFrame:
    """markets (market_id, question, outcomes, tokens) to one row per outcome: outcome i belongs to token i; game_num from
    the question, null for the whole match."""
    number = F.regexp_extract("question", r"(?i)\b(?:Game|Map)\s*(\d+)\b", 1)
    rows = markets.select("market_id", F.when(number != "", number.cast("int")).alias("game_num"), F.posexplode(F.arrays_zip("outcomes", "tokens")).alias("i", "x"))
    return rows.select("market_id", "game_num", "i", F.col("x.outcomes").alias("outcome"), F.col("x.tokens").alias("token"))

"""Readers of landed feeds, batch and stream, with explicit schemas; nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "address string, topics array<string>, data string, blockNumber string, logIndex string, blockHash string, transactionHash string, transactionIndex string, removed boolean, received_us long, source string"
PENDING = "kind string, hash string, `from` string, `to` string, input string, first_us long, announce_us long, tip_gwei long"
HEARTBEAT = "node_id string, started_at long, at long, advertise_host string, port int, path string, tls boolean, ready boolean, draining boolean, clients long, max_clients long, upstream_connected boolean, node_sequence long, last_frame_ms long, accepted long, slow_clients long, bad_frames long, clients_by_token map<string,bigint>"
PROBE = "source string, detect_iso string, detect_epoch string, game string, league string, match_name string, team_a string, team_b string, game_num string, winner string, src_end_at string, detect_lag_vs_end_s string, length string, forfeit string, status string, draw string, match_id string, match_begin_at string"
FORFEIT = "type string, source string, detect_iso string, detect_epoch double, game string, league string, match_name string, team_a string, team_b string, game_num string, winner string, loser string, src_end_at string, status string, match_begin_at string, emitted_at string, is_series boolean, forfeit boolean, draw boolean, map_number int, length_s int, match_id long, seq long"
MATCHES = "id long, name string, modified_at string, status string, games array<struct<position:int,winner:struct<id:long>,forfeit:boolean,finished:boolean,end_at:string>>, opponents array<struct<opponent:struct<id:long,name:string>>>"
PROBE_KINDS = {
    "p2p_match": PENDING,
    "incl": "kind string, hash string, block long, idx int, at_us long",
    "signal": "kind string, hash string, log_index int, seq long, recv_us long",
    "block": "kind string, hash string, number long, author string, obs string, first_us long",
    "rtt": "kind string, obs string, peer string, ms double, at_us long",
    "peer_decision": "kind string, peer string, epoch long, decision string, share double",
    "explore_report": "kind string, window long, seen long, missed long",
}


@dataclass(frozen=True)
class Settings:
    """Parameters that change results, with their defaults."""

    # Defaults of the service.
    event_ring: int = 10_000
    frame_ring: int = 2048
    batch_events: int = 64
    batch_bytes: int = 32_768
    zstd_threshold: int = 4096
    max_payload: int = 262_144
    backfill_days: int = 7
    blocks_per_batch: int = 1000
    closed_lookback_days: int = 3
    retention_days: int = 14
    require_market_id: bool = True
    blocklist_ttl_days: int = 30
    blocklist_backfill: int = 5000
    emitters: tuple[str, ...] = field(default_factory=tuple)

    @staticmethod
    def from_env(env: dict[str, str], prefix: str = "OPAL_") -> Settings:
        """Fields named in the environment, read as the default's kind; lists are comma-separated."""
        out = {}
        for name, default in Settings().__dict__.items():
            raw = env.get(prefix + name.upper())
            if raw is None:
                continue
            if isinstance(default, bool):
                out[name] = raw.strip().lower() in ("1", "true", "yes")
            elif isinstance(default, int):
                out[name] = int(raw)
            else:
                out[name] = tuple(dict.fromkeys(x.strip() for x in raw.split(",") if x.strip()))
        return Settings(**out)


def ordered_distinct(*lists: Column) -> Column:
    """Lists end to end, each entry where it comes first."""
    return F.array_distinct(F.concat(*lists))


def reader(spark: SparkSession, stream: bool, schema: str, files_per_trigger: int | None = None):
    r = (spark.readStream if stream else spark.read).schema(schema)
    return r.option("maxFilesPerTrigger", files_per_trigger) if stream and files_per_trigger else r


def ndjson(spark: SparkSession, path: str, schema: str, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Lines that aren't JSON are left out; missing fields are null, unknown ones ignored."""
    return reader(spark, stream, schema, files_per_trigger).option("mode", "DROPMALFORMED").json(path)


def logs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Raw log records with the defaults of fields that may be missing."""
    rows = ndjson(spark, path, LOG, stream)
    return rows.withColumns({"removed": F.coalesce("removed", F.lit(False)), "blockHash": F.coalesce("blockHash", F.lit(""))})


def pending(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Pending transactions with call data."""
    return ndjson(spark, path, PENDING, stream).filter("kind = 'p2p_match' and length(input) > 2")


def probe_kind(spark: SparkSession, path: str, kind: str, stream: bool = False) -> DataFrame:
    return ndjson(spark, path, PROBE_KINDS[kind], stream).filter(F.col("kind") == kind)


def heartbeats(spark: SparkSession, path: str, stream: bool = False, most_bytes: int = 65_536) -> DataFrame:
    """Bodies, a line each; longer ones and those that aren't JSON are refused."""
    lines = (spark.readStream if stream else spark.read).text(path).filter(F.octet_length("value") <= most_bytes)
    return lines.select(F.from_json("value", HEARTBEAT).alias("b")).filter("b.node_id is not null").select("b.*")


def probe_rows(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Result probe CSV with a header, all text."""
    return reader(spark, stream, PROBE).option("header", True).option("mode", "DROPMALFORMED").csv(path)


def forfeit_store(spark: SparkSession, path: str) -> DataFrame:
    """Stored events, the first of each key."""
    from opalstream.operators.events import first_wins

    return first_wins(ndjson(spark, path, FORFEIT), ["match_id", "game_num", "src_end_at"], ["seq"])


def forfeit_frames(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Landed frames of the forfeit feed, a JSON line each: {"hello": {...}} or {"event": {...}}, to their kind, the
    server's last sequence as far as the frame tells, and the event; lines that are neither are left out."""
    schema = f"hello struct<last_sequence:long>, event struct<sequence:long,backfill:boolean,condition_ids:array<string>,{_fields(FORFEIT)}>"
    rows = ndjson(spark, path, schema, stream).filter("hello is not null or event is not null")
    kind = F.when(F.col("hello").isNotNull(), "hello").otherwise("event")
    return rows.select(kind.alias("kind"), F.coalesce("hello.last_sequence", "event.sequence").alias("sequence"), "event")


def _fields(schema: str) -> str:
    return ",".join(f"{n}:{t}" for n, t in (x.strip().rsplit(" ", 1) for x in schema.split(",")))


def feed_state(frames: DataFrame) -> DataFrame:
    """One row: frames, server_last_sequence, last_event, in_sync (the last event is the server's last)."""
    event = F.col("kind") == "event"
    out = frames.agg(F.count("*").alias("frames"), F.max("sequence").alias("server_last_sequence"), F.max(F.when(event, F.col("sequence"))).alias("last_event"))
    return out.withColumn("in_sync", F.coalesce(F.col("last_event") >= F.col("server_last_sequence"), F.lit(False)))


def polled(matches: DataFrame, now: str, page: int = 100) -> DataFrame:
    """Matches in the order the past round asks for them: the last modified first, a page of them."""
    return matches.filter(F.col("modified_at") <= now).orderBy(F.col("modified_at").desc(), F.col("id").desc()).limit(page)


def announced(rows: DataFrame, kinds: list[int], largest: int, ask_once: bool = True) -> DataFrame:
    """Announcements (peer, hash, kind, size, at_us) worth fetching: of the kinds asked for, no larger than `largest`
    bytes (sizes that aren't told are), each hash from the peer that announced it first."""
    from opalstream.operators.events import first_wins

    fit = rows.filter(F.coalesce(F.col("kind").isin(kinds), F.lit(True)) & F.coalesce(F.col("size") <= largest, F.lit(True)))
    return first_wins(fit, ["hash"], ["at_us", "peer"]) if ask_once else fit


def match_games(matches: DataFrame) -> DataFrame:
    """One row for each finished game of a match, with its forfeit flag and the winner's name."""
    g = matches.select("id", "name", "opponents", F.explode("games").alias("g")).filter("g.finished")
    won = F.filter("opponents", lambda o: o["opponent"]["id"] == F.col("g.winner.id"))
    return g.select(F.col("id").alias("match_id"), "name", F.col("g.position").alias("game_num"), "g.forfeit", F.col("g.end_at").alias("src_end_at"), F.try_element_at(won, F.lit(1))["opponent"]["name"].alias("winner"))


def transaction_class(to: Column, data: Column, watched: list[str], selectors: list[str]) -> Column:
    """Target on the watch list, else a selector at the start, else one anywhere in the call data."""
    to, data = F.lower(to), F.lower(data)
    starts, holds = F.lit(False), F.lit(False)
    for s in selectors:
        starts, holds = starts | data.startswith("0x" + s), holds | F.substring(data, 3, 1 << 30).contains(s)
    target = to.isin([w.lower() for w in watched]) if watched else F.lit(False)
    return F.when(target, "target").when(starts, "direct").when(holds, "embedded")


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows of all sources with their name."""
    out = None
    for name, df in sources.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out

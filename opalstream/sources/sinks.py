"""Writers and report texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opalstream.shared import hadoop_path
from opalstream.sources.manifest import Table


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def numbered(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that have a folder."""
    p, fs = hadoop_path(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(int(f.getPath().getName().removeprefix("batch=")) for f in fs.listStatus(p) if f.getPath().getName().startswith("batch="))


def save_catalog(catalog: DataFrame, path: str, cursor: str | None = None) -> None:
    """The catalog, sorted by id, and its cursor, by one manifest: neither is ever there without the other."""
    rows = catalog.repartitionByRange("market_id").sortWithinPartitions("market_id")
    Table(catalog.sparkSession, path).overwrite(rows, **({} if cursor is None else {"cursor": cursor}))


def load_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The optional seen_day of older tables is null."""
    table = Table(spark, path)
    state = table.state()
    rows = table.read(state) if state["schema"] is not None else spark.createDataFrame([], schema)
    return rows if "seen_day" in rows.columns else rows.withColumn("seen_day", F.lit(None).cast("int"))


def load_cursor(spark: SparkSession, path: str) -> str | None:
    return Table(spark, path).state()["properties"].get("cursor")


def append_records(df: DataFrame, path: str, batch: int) -> None:
    """A micro-batch of the record log, in a folder of its own: written twice it is there once."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch:012d}")


def last_records(spark: SparkSession, path: str, order: str, n: int) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.col(order).desc()).limit(n)


def compact_records(spark: SparkSession, path: str, order: str, capacity: int, to: str) -> bool:
    """Rewrites the log with its last `capacity` records once it holds more than twice as many; `to` is a Table."""
    rows = spark.read.parquet(path)
    if rows.count() <= 2 * capacity:
        return False
    Table(spark, to).overwrite(rows.orderBy(F.col(order).desc()).limit(capacity))
    return True


def save_if_changed(new: DataFrame, path: str, key: list[str]) -> bool:
    """Counters, only if one differs from what is stored."""
    table = Table(new.sparkSession, path)
    state = table.state()
    if state["schema"] is not None:
        old = table.read(state).select(*new.columns)
        if new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty():
            return False
    table.overwrite(new.orderBy(*key))
    return True


def resume_counters(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Stored all-time counters plus those of this run."""
    sums = [F.sum(c).alias(c) for c in fresh.columns if c not in key]
    return stored.select(*fresh.columns).unionByName(fresh).groupBy(*key).agg(*sums)


def daily_rows(df: DataFrame, path: str, at_us: str, batch: tuple[str, int], keep_days: int | None = None, now_us: int | None = None) -> bool:
    """Rows by day into a Table: a batch (writer, number) run again is there once, and days that have passed go, files too
    (those a reader may still use, after an hour)."""
    table = Table(df.sparkSession, path)
    day = lambda c: F.date_format((c / 1e6).cast("timestamp"), "yyyy-MM-dd")
    added = table.append(df.withColumn("day", day(F.col(at_us))), "day", batch)
    if keep_days is not None:
        first = df.sparkSession.range(1).select(day(F.lit(now_us - keep_days * 86_400_000_000)).alias("d")).first().d
        if table.drop_parts(first):
            table.vacuum()
    return added


def export_json(table: DataFrame, path: str) -> None:
    """A table's rows as compressed JSON lines by day, for those who read such files; the folder is written anew."""
    table.write.mode("overwrite").partitionBy("day").option("compression", "gzip").json(path)


def recent(df: DataFrame, order: str, limit: int, since: str | None = None, since_col: str = "detect_iso") -> DataFrame:
    """The last `limit` rows, in order, of those later than since (texts compared); none for 0."""
    rows = df if since is None else df.filter(F.col(since_col) > since)
    return rows.orderBy(F.col(order).desc()).limit(max(limit, 0)).orderBy(order)


def health(counters: DataFrame, sources: DataFrame, catalog: DataFrame, off_list: DataFrame, ring: DataFrame, forfeits: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row, the service's snapshot.

    counters: events.delivery_counters; sources (source, connected, reconnects, stalls, last_us, latest_block); catalog
    (market_id, ...); off_list: events.off_list_tally; ring (sequence); forfeits (condition, blocked: events held back).
    extra: what only the host knows (subscribers, dropped clients, ...), as columns of literals."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    one = counters.agg(
        total("received", "logs_received_total"), total("decoded", "events_decoded_total"), total("decode_errors", "decode_errors_total"), total("foreign", "foreign_requests_skipped_total"),
        total("duplicates", "duplicates_total"), total("accepted", "events_accepted_total"), total("hits", "enrichment_hits_total"), total("misses", "enrichment_misses_total"),
    )
    parts = [
        sources.agg(
            F.count("*").alias("sources_configured"), F.count_if("connected").alias("sources_connected"), total("reconnects", "reconnects_total"), total("stalls", "stall_reconnects_total"),
            F.max("last_us").alias("last_upstream_received_at_us"), F.max("latest_block").alias("latest_block"),
        ),
        catalog.agg(F.count("*").alias("catalog_markets")),
        off_list.agg(F.count("*").alias("off_list_emitters"), total("events", "off_list_events_total"), total("hits", "off_list_catalog_hits_total")),
        ring.agg(F.min("sequence").alias("event_ring_oldest_sequence"), F.max("sequence").alias("event_ring_latest_sequence")),
        forfeits.agg(F.countDistinct("condition").alias("forfeit_blocked_condition_ids"), total("blocked", "forfeit_blocked_events_total")),
    ]
    for p in parts:
        one = one.crossJoin(F.broadcast(p))  # a row each
    one = one.withColumn("status", F.when(F.col("sources_connected") > 0, "ok").otherwise("degraded")).withColumn("hit_percent", F.try_divide(F.col("enrichment_hits_total") * 100.0, F.col("events_accepted_total")))
    return one.withColumns(extra or {})


def metrics_text(health: DataFrame, prefix: str = "opal_") -> DataFrame:
    """One row: the snapshot's numbers as lines of name and value."""
    numbers = [n for n, t in health.dtypes if t in ("bigint", "int", "double")]
    lines = [F.concat(F.lit(f"{prefix}{n} "), F.coalesce(F.col(n).cast("string"), F.lit("0"))) for n in numbers]
    return health.select(F.array_join(F.array(*lines), "\n").alias("text"))


def compact_json(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row: all rows as a JSON array without blanks, nulls left out; for lists of bounded size (peers, seats)."""
    entry = F.struct(*order, F.to_json(F.struct(*rows.columns)).alias("_json"))
    return rows.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["_json"]), ","), F.lit("]")).alias("text"))


def worth_keeping(seats: DataFrame) -> DataFrame:
    """Seats that tell something: no candidates that never had a share or a cooldown."""
    return seats.filter("state <> 'candidate' or coalesce(share, 0) > 0 or cooldowns > 0")


def scores_json(scores: DataFrame, sender: str = "sender") -> DataFrame:
    """One row: {"sender": [agree, disagree], ...} without blanks, in order of sender; senders are a bounded list of
    addresses."""
    entry = F.struct(F.col(sender).cast("string").alias("k"), F.concat(F.lit('":['), F.col("agree").cast("string"), F.lit(","), F.col("disagree").cast("string"), F.lit("]")).alias("v"))
    return scores.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.concat(F.lit('"'), x["k"], x["v"])), ","), F.lit("}")).alias("text"))


def load_scores(text: DataFrame) -> DataFrame:
    """sender, agree, disagree of such a text."""
    each = text.select(F.explode(F.from_json("text", "map<string,array<long>>")).alias("sender", "n"))
    return each.select("sender", F.col("n")[0].alias("agree"), F.col("n")[1].alias("disagree"))


def alert_text(sections: DataFrame) -> DataFrame:
    """One row: the message of grouped alerts, critical ones first."""
    line = F.concat(F.upper("severity"), F.lit(" "), F.col("rule"), F.lit(" ("), F.col("n").cast("string"), F.lit("): "), F.array_join("subjects", ", "))
    place = F.when(F.col("severity") == "critical", 0).otherwise(1)
    return sections.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("rule"), line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def markdown(df: DataFrame, columns: list[str], order: str, limit: int = 50) -> DataFrame:
    """One row: a table of the top rows of a report."""
    top = df.orderBy(F.col(order).desc()).limit(limit)
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col(order)).alias("o"), row.alias("r")))), lambda x: x["r"])
    return top.agg(F.concat(F.lit(head), F.array_join(lines, "\n")).alias("text"))

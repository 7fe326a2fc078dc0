"""Structured Streaming forms of operators that need no state of their own; those with typed state are in `keyed`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalstream.operators import gate as gates
from opalstream.operators.gate import GateSettings
from opalstream.shared import scratch
from opalstream.sources import sinks

def dedup_within(stream: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """First arrival of each key; keys are remembered for the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def gate_feed(stream: DataFrame, by: str, state: str, out: str, checkpoint: str, settings: GateSettings | None = None, trigger: dict | None = None):
    """Verdicts as operators.gate gives over all rows, batch by batch: new rows are judged together with those that
    may still matter (rows of open sessions, with the verdicts they got), and rounds and trust of all others.

    state and out are folders on shared storage, written by batch number, so a batch run again overwrites its own."""
    s = settings or GateSettings()

    def write(df: DataFrame, batch: int) -> None:
        with scratch(df.sparkSession):  # what the gate writes on its way goes with the batch
            judge(df, batch)

    def judge(df: DataFrame, batch: int) -> None:
        spark, at = df.sparkSession, lambda b, name: f"{state}/batch={b:012d}/{name}"
        now = df.agg(F.max("arrival")).first()[0]
        if now is None:
            return
        rounds = df.limit(0).select(by, *gates.MARKET, "timestamp")
        trust = df.limit(0).select(by, "sender", F.lit(0).cast("long").alias("agree"), F.lit(0).cast("long").alias("disagree"))
        rows = df.withColumn("was", F.lit(None).cast("string"))
        before = [b for b in sinks.numbered(spark, state) if b < batch]
        if before:
            last = max(before)
            rows = spark.read.schema(rows.schema).parquet(at(last, "rows")).unionByName(rows)
            rounds, trust = (spark.read.schema(x.schema).parquet(at(last, name)) for x, name in ((rounds, "rounds"), (trust, "trust")))
        judged = gates.gate(rows, by, s, rounds, trust)
        verdicts = at(batch, "verdicts")
        judged.write.mode("overwrite").parquet(verdicts)
        judged = spark.read.schema(judged.schema).parquet(verdicts)
        judged.filter("was is null").drop("was").write.mode("overwrite").parquet(f"{out}/batch={batch:012d}")
        known = judged.withColumn("was", F.coalesce("was", "verdict", F.lit(gates.CONFIRMED))).drop("verdict")
        for x, name in zip(gates.carried(known, by, s, now, rounds, trust), ("rows", "rounds", "trust")):
            x.write.mode("overwrite").parquet(at(batch, name))
        for b in before:
            if b < batch - 1:
                sinks.remove(spark, f"{state}/batch={b:012d}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return q.trigger(**(trigger or {"availableNow": True})).start()


def matched_within(pending: DataFrame, confirmed: DataFrame, key: str, at: str, other: str, wait: str) -> DataFrame:
    """Pending rows with their confirmation within `wait`, or null once that time has passed; timestamps."""
    a = pending.withWatermark(at, "1 second")
    b = confirmed.withColumnRenamed(key, "_k").withWatermark(other, "1 second")
    near = (F.col(key) == F.col("_k")) & (F.col(other) >= F.col(at)) & (F.col(other) <= F.col(at) + F.expr(f"interval {wait}"))
    return a.join(b, near, "left_outer").drop("_k")


def store_and_broadcast(stream: DataFrame, store: str, broadcast: str, enrich: Callable[[DataFrame], DataFrame], checkpoint: str):
    """All rows go to the store, those flagged `broadcast` also to the feed; a batch run again overwrites its own folder."""

    def write(df: DataFrame, batch: int) -> None:
        rows = enrich(df).persist()
        rows.write.mode("overwrite").parquet(f"{store}/batch={batch:012d}")
        rows.filter("broadcast").write.mode("overwrite").parquet(f"{broadcast}/batch={batch:012d}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

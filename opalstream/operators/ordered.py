"""Order-dependent operators that never bring all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalstream.operators.selection import by_rank, nearest_place
from opalstream.shared import materialised


def global_sequence(df: DataFrame, order: list[str], name: str = "seq", start: int = 1) -> DataFrame:
    """Numbers rows by `order` (which should be total): a range shuffle, then each part's number of rows before it.

    The sorted rows are written to the shared folder once: numbers and sizes must be of the same parts, and
    another evaluation of the range shuffle may draw other bounds.  The parts' sizes (a row each, as many as
    shuffle partitions) are all that meets in one place.
    """
    placed = materialised(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "sequence")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    out = placed.withColumn("_part", part).join(F.broadcast(firsts), "_part")
    return out.withColumn(name, F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1) + start).drop("_at", "_part", "_first")


def nearest_rank(df: DataFrame, group: list[str], value: str, qs: list[float]) -> DataFrame:
    """group, q, value: the element number floor((n - 1) * q + 0.5), from 0, of each group in order."""
    return by_rank(df, group, value, {q: (lambda n, q=q: nearest_place(F.lit(q), n)) for q in dict.fromkeys(qs)}, "q")


def running_total(df: DataFrame, order: list[str], value: Column, name: str, block: int = 4096) -> DataFrame:
    """Sum of value over all rows up to this one, by numbered blocks; adds the row's number, `seq`, too."""
    rows = global_sequence(df.withColumn("_v", value), order, "seq").withColumn("_block", F.floor((F.col("seq") - 1) / block))
    sums = rows.groupBy("_block").agg(F.sum("_v").alias("_s"))
    # blocks of blocks: the window below holds a 4096th of the rows' number at most, by its 4096th each
    sums = sums.withColumn("_upper", F.floor(F.col("_block") / block))
    upper = sums.groupBy("_upper").agg(F.sum("_s").alias("_us"))
    upper = upper.select("_upper", F.coalesce(F.sum("_us").over(Window.orderBy("_upper").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ub"))
    inner = Window.partitionBy("_upper").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.join(upper, "_upper").select("_block", (F.col("_ub") + F.coalesce(F.sum("_s").over(inner), F.lit(0))).alias("_before"))
    own = Window.partitionBy("_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(before, "_block").withColumn(name, F.col("_before") + F.sum("_v").over(own)).drop("_v", "_block", "_before")


def trailing_count(df: DataFrame, order: list[str], hit: Column, rows: int = 1000) -> DataFrame:
    """Adds seq, hits and seen: of this row and the rows - 1 before it, over the whole stream in order."""
    total = running_total(df, order, hit.cast("long"), "_total")
    past = total.select((F.col("seq") + rows).alias("seq"), F.col("_total").alias("_past"))
    out = total.join(past, "seq", "left")
    return out.withColumn("hits", F.col("_total") - F.coalesce("_past", F.lit(0))).withColumn("seen", F.least("seq", F.lit(rows))).drop("_total", "_past")


def counter_increase(samples: DataFrame, key: list[str], at: str, value: str, now: Column, window: int) -> DataFrame:
    """key, increase: growth of a counter since now - window; a fall is a restart from 0.

    The last sample before the window is the baseline, a first sample within it adds nothing.
    """
    w = Window.partitionBy(*key).orderBy(at, value)
    step = F.col(value) - F.lag(value).over(w)
    rows = samples.filter(F.col(at) <= now).withColumn("_prev", F.lag(value).over(w)).withColumn("_step", F.when(step >= 0, step).otherwise(F.col(value)))
    inside = (F.col(at) >= now - window) & F.col("_prev").isNotNull()
    return rows.groupBy(*key).agg(F.coalesce(F.sum(F.when(inside, F.col("_step"))), F.lit(0)).alias("increase"))


def thinned(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """Every step-th row in order and the last, with step so that about `most` stay; adds seq."""
    rows = global_sequence(df, order, "seq", 0)
    n = rows.agg(F.count("*").alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return rows.crossJoin(F.broadcast(n)).filter((F.col("seq") % step == 0) | (F.col("seq") == F.col("_n") - 1)).drop("_n")


def last_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows by order: a top-k in each task, then of those."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def gaps(df: DataFrame, number: str) -> DataFrame:
    """first, last of each run of numbers that are missing between two that are there, however long it is.

    Distinct numbers are sorted by ranges; neighbours within a part are compared there, and the parts' first and last
    numbers, a row a part, with each other."""
    n = F.col(number)
    seen = df.filter(n.isNotNull()).select(n.cast("long").alias("n")).distinct()
    placed = materialised(seen.repartitionByRange("n").sortWithinPartitions("n").withColumn("_at", F.monotonically_increasing_id()), "numbers")
    part = F.shiftright("_at", 33)
    # blocks of a part by number of row: each block's first number is the neighbour of the last of the block before
    rows = placed.withColumn("_block", F.shiftright("_at", 14))
    inner = rows.withColumn("before", F.lag("n").over(Window.partitionBy("_block").orderBy("n")))
    ends = rows.groupBy(part.alias("_part"), "_block").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    edges = ends.withColumn("before", F.lag("b").over(Window.partitionBy("_part").orderBy("_block"))).select("_part", "a", "before", "b")
    parts = ends.groupBy("_part").agg(F.min("a").alias("n"), F.max("b").alias("b"))
    across = parts.withColumn("before", F.lag("b").over(Window.orderBy("_part")))  # a row a part
    pairs = inner.select("before", "n").unionByName(edges.select("before", F.col("a").alias("n"))).unionByName(across.select("before", "n"))
    return pairs.filter("before is not null and n - 1 > before").select((F.col("before") + 1).alias("first"), (F.col("n") - 1).alias("last"))


def missing_numbers(df: DataFrame, number: str, width: int = 1 << 16) -> DataFrame:
    """Each missing number between the smallest and the largest that are there.  Gaps are cut into pieces of `width`, and
    those of very long gaps are listed piece by piece, too, so no row holds more than `width` numbers; ask for gaps where
    they may be too long to be spelled out."""
    pieces = gaps(df, number).withColumn("_many", F.expr(f"(last - first) div {width}"))
    for level in (2, 1):  # pieces of pieces: a gap of width ** 3 numbers at most in one list
        step = width**level
        pieces = pieces.select("last", F.explode(F.expr(f"sequence(first, last, {step}L)")).alias("first")).select("first", F.least("last", F.col("first") + (step - 1)).alias("last"))
    return pieces.select(F.explode(F.expr("sequence(first, last)")).alias(number))


def interval_join(left: DataFrame, right: DataFrame, key: list[str], at: str, other: str, longest: int, salt: int = 1, how: str = "inner") -> DataFrame:
    """Pairs with 0 <= other - at <= longest: an equi-join on the key and buckets of that width.  With salt > 1 each
    (key, bucket) is shared among so many tasks: right's rows are dealt out, left's go to all.  how may be "left": rows
    of left that have no partner come once each, with nulls, whatever is null in them."""
    if how == "left":
        rows = materialised(left.withColumn("_row", F.monotonically_increasing_id()), "left")
        pairs = materialised(interval_join(rows, right, key, at, other, longest, salt), "pairs")
        alone = rows.join(pairs.select("_row").distinct(), "_row", "left_anti")
        return pairs.drop("_row").unionByName(alone.drop("_row"), allowMissingColumns=True)
    if salt > 1:
        left = left.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        right = right.withColumn("_s", F.pmod(F.xxhash64(*right.columns), F.lit(salt)).cast("int"))
        return interval_join(left, right, [*key, "_s"], at, other, longest).drop("_s")
    a = left.withColumn("_b", F.explode(F.array(F.floor(F.col(at) / longest), F.floor(F.col(at) / longest) + 1)))
    b = right.withColumn("_b", F.floor(F.col(other) / longest))
    return a.join(b, [*key, "_b"]).filter((F.col(other) >= F.col(at)) & (F.col(other) - F.col(at) <= longest)).drop("_b")


def newest_per_key(df: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key by order; Spark keeps n a key before the shuffle, too."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def top_per_group(df: DataFrame, group: str, name: str, n: int) -> DataFrame:
    """group, name, n: the n most frequent names of each group, ties by name."""
    counts = df.groupBy(group, name).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), name)
    return counts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def top_groups(df: DataFrame, group: Column | str, value: str, n: int) -> DataFrame:
    """group, total: the n groups with the largest sums of value."""
    return df.groupBy(group).agg(F.sum(value).alias("total")).orderBy(F.col("total").desc()).limit(n)


def newest_matching(df: DataFrame, order: list[str], scan: int, match: Column, n: int) -> DataFrame:
    """The last n matching rows among the last `scan` rows."""
    return last_rows(last_rows(df, order, scan).filter(match), order, n)


def upper_median(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, value: the element number n // 2, from 0, of each group in order."""
    return by_rank(df, group, value, {0.5: lambda n: F.floor(n / 2)}, "_q").drop("_q")


def latest_so_far(df: DataFrame, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the largest value of the key up to and with this row."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.max(value).over(w))


def lag_in_group(df: DataFrame, key: list[str], order: list[str], at: str, name: str) -> DataFrame:
    """Adds how long after the row before it in its group a row comes."""
    return df.withColumn(name, F.col(at) - F.lag(at).over(Window.partitionBy(*key).orderBy(*order)))


def condition_runs(df: DataFrame, key: list[str], at: str, on: str) -> DataFrame:
    """key, a, b: first and last time of each unbroken run of a condition."""
    w = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_isl", F.sum((~F.col(on)).cast("int")).over(w))
    return rows.filter(F.col(on)).groupBy(*key, "_isl").agg(F.min(at).alias("a"), F.max(at).alias("b")).drop("_isl")


def lead_summary(df: DataFrame, lead_us: str) -> DataFrame:
    """One row: p10, p50, p90, least and most lead in milliseconds, by nearest rank; null without rows."""
    names = {0.1: "lead_ms_p10", 0.5: "lead_ms_p50", 0.9: "lead_ms_p90", 0.0: "lead_ms_min", 1.0: "lead_ms_max"}
    leads = materialised(df.select(lead_us), "leads")  # read several times, and mostly a join's
    got = nearest_rank(leads, [], lead_us, list(names))
    return got.agg(*[F.max(F.when(F.col("q") == q, F.col(lead_us) / 1000.0)).alias(n) for q, n in names.items()])

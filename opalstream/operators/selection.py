"""Values by their rank within groups, exactly, without sorting the rows.

A wanted rank is narrowed down: a pass finds some splitters of the values that are left (approximate quantiles, of
which nothing but the balance depends), another counts values by splitter, at it or up to the next one, and the
stretch that holds the rank is what is left; until few values are left, or one value alone.  Those are then counted
value by value.  All passes are aggregates that combine before their shuffle, so no value's rows, nor a group's, meet
in one task, and what is shuffled is a few numbers for each group and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalstream.shared import materialised

SPLITTERS = 32
FEW = 1 << 16


def nearest_place(q: Column, n: Column) -> Column:
    """floor((n - 1) * q + 0.5), n - 1 at most."""
    return F.least(F.floor((n - 1) * q + 0.5), n - 1)


def by_rank(df: DataFrame, group: list[str], value: str, wanted: dict[object, object], name: str, few: int = FEW) -> DataFrame:
    """group, `name`, value: for each entry of wanted, its key as `name` and the value whose place in order, from 0, the
    entry gives as a column of n, the number of the group's values.  Nulls aren't counted; NaN is the largest."""
    keys = [f"_g{i}" for i in range(len(group))]
    stretch = [*keys, "_lo", "_hi"]
    rows = df.filter(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(group, keys)], F.col(value).alias("_v"))
    fractions = [i / SPLITTERS for i in range(SPLITTERS + 1)]
    splitters = F.array_sort(F.array_distinct(F.percentile_approx("_v", fractions, 1000))).alias("_cuts")
    sizes = materialised(rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), splitters).filter("_n > 0"), "sizes")
    cuts = sizes.select(*stretch, "_cuts")
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("_name"), place(F.col("_n")).cast("long").alias("_place")) for k, place in wanted.items()]))
    # _place: among the values that are left, of which there are _n, from _lo to _hi
    left = materialised(sizes.withColumn("_x", places).select(*keys, "_x._name", "_x._place", "_n", "_lo", "_hi"), "ranks")
    found = []
    while True:
        done = left.filter("_lo = _hi").select(*keys, "_name", F.col("_lo").alias("_v"))
        found.append(done)
        left = left.filter("not (_lo <=> _hi)")
        many = left.filter(F.col("_n") > few)
        if many.isEmpty():
            break
        small = left.filter(F.col("_n") <= few)
        if cuts is None:  # several ranks may share a stretch
            cuts = materialised(_inside(rows, many.select(*stretch).distinct(), keys).groupBy(*stretch).agg(splitters), "cuts")
        # bucket 2i + 1: at splitter i; 2i: between splitter i - 1 and i
        below = F.size(F.filter("_cuts", lambda x: x < F.col("_v")))
        bucket = 2 * below + F.exists("_cuts", lambda x: x == F.col("_v")).cast("int")
        counts = _inside(rows, cuts, keys, "_cuts").withColumn("_b", bucket).groupBy(*stretch, "_b").agg(F.count("*").alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        order = Window.partitionBy(*stretch).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)  # 2 * SPLITTERS + 3 at most
        counts = counts.withColumn("_upto", F.sum("_c").over(order))
        now = _joined(many.drop("_n"), counts, stretch).filter("_place < _upto and _place >= _upto - _c")
        now = now.select(*keys, "_name", (F.col("_place") - (F.col("_upto") - F.col("_c"))).alias("_place"), F.col("_c").alias("_n"), F.col("_from").alias("_lo"), F.col("_to").alias("_hi"))
        left, cuts = materialised(now.unionByName(small), "ranks"), None
    each = _inside(rows, left.select(*stretch).distinct(), keys).groupBy(*stretch, "_v").agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*stretch).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)  # `few` values at most
    last = _joined(left, each.withColumn("_upto", F.sum("_c").over(order)), stretch).filter("_place < _upto and _place >= _upto - _c").select(*keys, "_name", "_v")
    out = last
    for f in found:
        out = out.unionByName(f)
    return out.select(*[F.col(k).alias(c) for c, k in zip(group, keys)], F.col("_name").alias(name), F.col("_v").alias(value))


def _joined(a: DataFrame, b: DataFrame, keys: list[str], on: Column | None = None) -> DataFrame:
    """An inner join on keys, nulls being equal, with a's keys."""
    b = b.withColumnsRenamed({k: f"_of{k}" for k in keys})
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_of{k}"))
        on = same if on is None else on & same
    return a.join(b, on).drop(*[f"_of{k}" for k in keys])


def _inside(rows: DataFrame, ranks: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """Values between _lo and _hi, for each such stretch of their group."""
    near = ranks.select(*keys, "_lo", "_hi", *more)
    return _joined(rows, near, keys, (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))

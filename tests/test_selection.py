"""Values by rank against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from opalstream.operators import ordered
from opalstream.operators.selection import by_rank


@pytest.mark.parametrize("few", [4, 100, 1 << 13])
def test_nearest_rank(spark, few):
    rng = random.Random(few)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, 7, 7, 7, rng.randrange(1000), rng.randrange(-(2**62), 2**62), 2**53 + 1, 2**53])) for _ in range(3000)] + [("one", 5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(5)
    places = {q: (lambda n, q=q: F.least(F.floor((n - 1) * q + 0.5), n - 1)) for q in (0.0, 0.05, 0.5, 0.99, 1.0)}
    got = sorted((tuple(r) for r in by_rank(df, ["g"], "v", places, "q", few).collect()), key=str)
    want = []
    for g in {r[0] for r in rows}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        want += [(g, q, v[min(math.floor((len(v) - 1) * q + 0.5), len(v) - 1)]) for q in places if v]
    assert got == sorted(want, key=str)


def test_doubles_dates_and_no_groups(spark):
    rng = random.Random(1)
    v = [rng.choice([0.0, math.inf, -math.inf, rng.gauss(0, 1e-300), rng.gauss(0, 1e300), rng.random()]) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for few in (10, 10_000):
        got = {r.q: r.v for r in by_rank(df, [], "v", {0.25: lambda n: F.floor(n / 4), 0.9: lambda n: F.floor(n * 9 / 10)}, "q", few).collect()}
        assert got == {0.25: sorted(v)[500], 0.9: sorted(v)[1800]}
    days = spark.range(999).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    assert str(ordered.upper_median(days, [], "d").first().d) == "2025-05-14"
    assert ordered.nearest_rank(df.limit(0), [], "v", [0.5]).count() == 0 and ordered.lead_summary(df.limit(0), "v").count() == 1


def test_no_sort_of_all_rows(spark):
    """Nothing is dealt out by ranges, and no more than splitters and counts are shuffled."""
    df = spark.range(100_000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("v"))
    plan = ordered.nearest_rank(df, ["g"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    got = {r.g: r.v for r in ordered.nearest_rank(df, ["g"], "v", [0.5]).collect()}
    assert got == {g: sorted(r.v for r in df.filter(F.col("g") == g).collect())[math.floor((n - 1) * 0.5 + 0.5)] for g, n in ((0, 33_334), (1, 33_333), (2, 33_333))}


def test_lead_summary_reads_its_rows_once(spark):
    """Leads mostly come from a join, which passes over them mustn't repeat."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    n = 200_000
    got = ordered.lead_summary(spark.range(n).select(counted("id").alias("lead")), "lead").first()
    assert (got.lead_ms_min, got.lead_ms_max) == (0.0, (n - 1) / 1000) and seen.value == n

"""Tables of one manifest: every step a writer may die at, batches run again, merges that touch what changed."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from opalstream.operators import catalog, ordered
from opalstream.sources import manifest, sinks
from opalstream.sources.manifest import ManifestSink, Table


def rows_of(table):
    return sorted(tuple(r) for r in table.read().collect())


class Killed(Exception):
    pass


def test_a_writer_dies_at_any_step(spark, tmp_path, monkeypatch):
    """Readers find the old state until the rename, the new one after it, and the next writer goes on."""
    table = Table(spark, str(tmp_path / "t"))
    table.overwrite(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), cursor="old")
    old, new = rows_of(table), [(1, "c")]
    real = manifest.open_folder

    class Dies:
        """A file system that dies at its n-th change."""

        def __init__(self, where, left):
            self.where, self.left = where, left

        def __getattr__(self, name):
            def call(*args, **kwargs):
                if name in ("create_dir", "open_output_stream", "move"):
                    self.left[0] -= 1
                    if self.left[0] < 0:
                        raise Killed
                return getattr(self.where, name)(*args, **kwargs)

            return call

    died = 0
    for steps in range(10):
        left = [steps]
        monkeypatch.setattr(manifest, "open_folder", lambda path, left=left: (lambda w, r: (Dies(w, left), r))(*real(path)))
        try:
            table.overwrite(spark.createDataFrame(new, "k int, v string"), cursor="new")
        except Killed:
            died += 1
            monkeypatch.setattr(manifest, "open_folder", real)
            assert rows_of(table) == old and table.state()["properties"]["cursor"] == "old"
            continue
        monkeypatch.setattr(manifest, "open_folder", real)
        assert rows_of(table) == new and table.state()["properties"]["cursor"] == "new"
        break
    assert died == 3  # the folder, the file beside, the rename
    assert table.vacuum(keep=1, grace_s=0) and rows_of(table) == new


def test_half_a_manifest_is_passed_over(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    table.append(spark.range(3))
    (tmp_path / "t/manifests/000000000002.json").write_text('{"version": 2, "files": [')
    assert len(rows_of(table)) == 3
    table.append(spark.range(2))
    assert len(rows_of(table)) == 5 and table.state()["version"] == 3


def test_two_writers(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    table.append(spark.range(3))
    seen = table.state()
    table.append(spark.range(2))
    with pytest.raises(manifest.Conflict):
        manifest.publish(table.path, seen, files=[])
    assert len(rows_of(table)) == 5


def test_batches_and_days(spark, tmp_path):
    us = lambda d: int(datetime.datetime(2024, 1, d, 12, tzinfo=datetime.timezone.utc).timestamp() * 1e6)
    path = str(tmp_path / "t")
    put = lambda d, n, **kw: sinks.daily_rows(spark.createDataFrame([(us(d), d)], "at long, v int"), path, "at", ("q", n), **kw)
    assert put(1, 0) and put(2, 1) and not put(2, 1) and not put(1, 0) and put(9, 2, keep_days=3, now_us=us(9))
    table = Table(spark, path)
    assert [r[1] for r in rows_of(table)] == [9] and dict(table.read().dtypes)["day"] == "string"
    table.vacuum(keep=1, grace_s=0)
    left = [f for _, _, fs in os.walk(tmp_path / "t/data") for f in fs if f.endswith(".parquet")]
    assert len(left) == 1
    sinks.export_json(table.read(), str(tmp_path / "json"))
    assert os.listdir(tmp_path / "json/day=2024-01-09")


def test_sink(spark, tmp_path):
    """Batch and stream; a stream's batch that is committed twice is there once; of a dead task nothing is."""
    spark.dataSource.register(ManifestSink)
    path = str(tmp_path / "t")
    df = spark.range(10).select("id", F.when(F.col("id") % 2 == 0, F.col("id") + 2**53).alias("v"))
    save = lambda mode: df.write.format("manifest_table").option("path", path).mode(mode).save()
    save("append"), save("append")
    assert len(rows_of(Table(spark, path))) == 20
    save("overwrite")
    assert sorted(tuple(r) for r in Table(spark, path).read().collect()) == sorted(tuple(r) for r in df.collect())
    src = str(tmp_path / "src")
    spark.range(5).write.parquet(src)
    out = str(tmp_path / "s")

    def run(checkpoint):
        stream = spark.readStream.schema("id long").parquet(src)
        stream.writeStream.format("manifest_table").option("path", out).option("writer", "q").option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()

    run("c1")
    assert len(rows_of(Table(spark, out))) == 5 and Table(spark, out).state()["batches"] == {"q": 0}
    run("c2")  # the same batch again, by a query that lost its checkpoint
    assert len(rows_of(Table(spark, out))) == 5

    def broken(x):
        raise ValueError(x)

    bad = spark.range(8, numPartitions=2).select(F.udf(lambda x: broken(x) if x == 7 else x, "long")("id").alias("id"), F.lit(1).cast("long").alias("v"))
    with pytest.raises(Exception):
        bad.write.format("manifest_table").option("path", path).mode("append").save()
    assert len(rows_of(Table(spark, path))) == 10


def test_merge_writes_what_changes(spark, tmp_path):
    table, content = Table(spark, str(tmp_path / "t")), ["v", "w"]
    base = spark.range(2000).select(F.col("id").alias("k"), F.lit("x").alias("v"), F.lit(None).cast("string").alias("w"))
    assert catalog.merge_catalog(table, base, "k", content, 10, 32, cursor="a") == 32
    first = table.state()
    assert catalog.merge_catalog(table, base.filter("k < 900"), "k", content, 10, 32, cursor="b") == 0  # nothing new
    assert table.state()["files"] == first["files"] and table.state()["properties"]["cursor"] == "b"
    change = spark.createDataFrame([(7, "y", "z", "b"), (7, "old", None, "a"), (5000, "n", None, "a")], "k long, v string, w string, updated_at string")
    assert catalog.merge_catalog(table, change, "k", content, 11, 32) == 2
    kept = {f["path"] for f in table.state()["files"]} & {f["path"] for f in first["files"]}
    assert len(kept) >= 30 - 2 and sum(f["bytes"] for f in table.state()["files"] if f["path"] not in kept) < sum(f["bytes"] for f in first["files"]) / 8
    want = catalog.upsert(base.withColumn("seen_day", F.lit(10)), change, "k", content, F.lit(11))
    assert rows_of(table) == sorted(tuple(r) for r in want.select(*table.read().columns).collect())


def test_repeated_listings(spark):
    content, day = ["v"], F.lit(5)
    old = spark.createDataFrame([(1, "a", 3)], "k int, v string, seen_day int")
    new = spark.createDataFrame([(1, "b", "t1"), (1, "c", "t2"), (2, None, "t1"), (2, None, "t1")], "k int, v string, updated_at string")
    assert sorted(tuple(r) for r in catalog.upsert(old, new, "k", content, day).collect()) == [(1, "c", 5), (2, None, 5)]
    kept, did = catalog.reconcile(old, new, "k", content, 5, 0)
    assert kept.count() == 2 and tuple(did.first()) == (2, 1, 1, 0)


def test_left_interval_join_with_nulls(spark):
    left = spark.createDataFrame([(1, 10, None), (1, 10, None), (2, 10, "p"), (None, 10, "q")], "k int, at long, payload string")
    right = spark.createDataFrame([(1, 12), (None, 11)], "k int, other long")
    for salt in (1, 3):
        got = sorted((tuple(r) for r in ordered.interval_join(left, right, ["k"], "at", "other", 5, salt, "left").collect()), key=str)
        assert got == sorted([(1, 10, None, 12), (1, 10, None, 12), (2, 10, "p", None), (None, 10, "q", None)], key=str)


def test_gaps(spark):
    numbers = [1, 2, 5, 5, None, 10**14, 10**14 + 2, -4]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    assert sorted(tuple(r) for r in ordered.gaps(df, "n").collect()) == [(-3, 0), (3, 4), (6, 10**14 - 1), (10**14 + 1, 10**14 + 1)]
    near = spark.createDataFrame([(n,) for n in (1, 4, 40, 41)], "n long")
    for width in (2, 3, 65_536):
        assert sorted(r.n for r in ordered.missing_numbers(near, "n", width).collect()) == [2, 3, *range(5, 40)]
    many = spark.range(0, 60_000, 3).withColumnRenamed("id", "n")
    assert ordered.gaps(many, "n").count() == 19_999 and ordered.missing_numbers(many, "n").count() == 39_998
    assert ordered.gaps(df.limit(0), "n").count() == 0

"""Shared folders, materialised tables and word hashing."""

from __future__ import annotations

import contextlib
import gc

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from opalstream.shared import hadoop_path, new_path

def remove(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    with contextlib.suppress(Exception):
        fs.delete(p, True)


def make_dir(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.mkdirs(p)


def light_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Whole texts go to Python: batches of Spark's default of 10,000 rows would hold tens of MB several
    times over, on both sides, and with very long texts far more.  Values that the user has set stay."""
    for key, default, value in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


class Tables:
    """Tables written to the shared folder to cut lineage; drop() deletes those no longer read."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.written = spark, tag, []
        light_batches(spark)

    def write(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = new_path(self.spark, f"{self.tag}-{name}")
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._opal_path = path
        self.written.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if t is not None and getattr(t, "_opal_path", None):
                remove(self.spark, t._opal_path)

    def keep(self, *tables: DataFrame) -> None:
        """Drops all tables written but these."""
        self.drop(*(t for t in self.written if not any(t is k for k in tables)))
        self.written = list(tables)

    def tidy(self) -> None:
        """Lets Spark delete the shuffle files of plans that nothing refers to."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each; hashing a word costs less than keeping it, as vocabularies are large."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def lower_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; bytes.lower and bytes.split know ASCII only, as wanted."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S32, _S29 = np.uint64(32), np.uint64(29)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S32)) * M1
    return (h ^ (h >> _S29)) * M2 ^ (h >> _S32)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the distinct k-word shingles, sorted; a text with fewer words is one shingle."""
    n = len(words)
    if not n:
        return words
    m = n - k + 1
    if m < 1:
        k, m = n, 1
    h = np.full(m, np.uint64(k))
    for i in range(k):
        h = (h ^ words[i : i + m]) * M3
        h = h ^ (h >> _S29)
    h = np.sort(mix(h))
    first = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=first[1:])
    return h[first]

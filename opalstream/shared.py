"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_DIRS: dict[str, str] = {}


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, deleted when the application ends.

    Where that is unset a temporary folder does for a driver that runs all tasks itself; on a cluster, executors
    would not find each other's files, so it must be set there."""
    app = spark.sparkContext.applicationId
    if app not in _DIRS:
        where, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not where:
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            where = "file://" + tempfile.mkdtemp(prefix="opalstream-")
        p, fs = hadoop_path(spark, f"{where.rstrip('/')}/opalstream-{app}")
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _DIRS[app] = f"{where.rstrip('/')}/opalstream-{app}"
    return _DIRS[app]


_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("opalstream_scope", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables and files that operators write to the shared folder within this block are deleted at its end, so their
    results must have been written or collected by then.  Without it they stay until the application ends."""
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield paths
    finally:
        _SCOPE.reset(token)
        for path in paths:
            p, fs = hadoop_path(spark, path)
            fs.delete(p, True)


def new_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder, freed with the scratch it is asked for in."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return path


def materialised(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df, written once and read from there: whatever depends on where rows came to lie, or on their
    order, stays the same however often it is used, and when executors are lost."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

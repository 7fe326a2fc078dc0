"""Tables whose state is the newest manifest: files are written beside, then one small file makes them the table.

A table's folder has `data/`, with Parquet files that are never changed, and `manifests/`, a numbered JSON file for each
state, which lists the files of the state, the last batch of each writer, and properties (a cursor, say).  A manifest
is written under another name and renamed, so a reader finds the old state or the new one, whole, whatever a writer dies
of; a manifest that doesn't end as it should is passed over.  One writer at a time is meant: a state that another has
published in between is not overwritten, the commit fails.

`Table` writes and reads by Spark's own Parquet code; `ManifestSink` is a data source for `df.write` and
`writeStream`, whose tasks write Arrow batches and whose commit publishes them.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

END = "end of manifest"


class Conflict(Exception):
    """Another writer has published a state since this one was read."""


def open_folder(path: str):
    """A file system and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


def _versions(path: str) -> list[tuple[int, str]]:
    from pyarrow import fs

    where, root = open_folder(path)
    found = where.get_file_info(fs.FileSelector(posixpath.join(root, "manifests"), allow_not_found=True))
    return sorted((int(f.base_name.removesuffix(".json")), f.path) for f in found if f.base_name.endswith(".json"))


def _load(path: str, file: str) -> dict | None:
    where, _ = open_folder(path)
    with where.open_input_stream(file) as f:
        try:
            got = json.loads(f.read())
        except ValueError:
            return None
    return got if isinstance(got, dict) and got.get("end") == END else None


def newest(path: str) -> dict:
    """The newest whole manifest; one of no files where there is none."""
    for _, file in reversed(_versions(path)):
        if (got := _load(path, file)) is not None:
            return got
    return {"version": 0, "files": [], "schema": None, "batches": {}, "properties": {}}


def publish(path: str, before: dict, **changes) -> dict:
    """The state after `before`, with changes.  The last step, a rename, makes it so."""
    from pyarrow import fs

    where, root = open_folder(path)
    folder = posixpath.join(root, "manifests")
    where.create_dir(folder, recursive=True)
    after = {**before, **changes, "version": (_versions(path) or [(0, "")])[-1][0] + 1, "end": END}
    if newest(path)["version"] != before["version"]:
        raise Conflict(f"{path} has gone on from version {before['version']}")
    beside, place = posixpath.join(folder, f".{uuid.uuid4().hex}"), posixpath.join(folder, f"{after['version']:012d}.json")
    with where.open_output_stream(beside) as f:
        f.write(json.dumps(after).encode())
    if where.get_file_info(place).type != fs.FileType.NotFound:
        raise Conflict(place)
    where.move(beside, place)
    return after


def vacuum(path: str, keep: int = 2, grace_s: float = 3600) -> list[str]:
    """Deletes manifests but the last `keep`, and files that none of those lists and that are older than grace_s, which
    are what writers that died have left and what is no longer of the table."""
    import time

    from pyarrow import fs

    where, root = open_folder(path)
    versions = _versions(path)
    old, kept = versions[:-keep], versions[-keep:]
    listed = {f["path"] for _, file in kept if (m := _load(path, file)) is not None for f in m["files"]}
    for _, file in old:
        where.delete_file(file)
    gone = []
    for f in where.get_file_info(fs.FileSelector(posixpath.join(root, "data"), recursive=True, allow_not_found=True)):
        name = posixpath.relpath(f.path, root)
        if f.type == fs.FileType.File and name not in listed and time.time() - f.mtime.timestamp() >= grace_s:
            where.delete_file(f.path)
            gone.append(name)
    return gone


class Table:
    """A table in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def state(self) -> dict:
        return newest(self.path)

    def read(self, state: dict | None = None, only=None) -> DataFrame:
        """The rows of a state, or of those of its files that `only` accepts."""
        state = self.state() if state is None else state
        if state["schema"] is None:
            raise FileNotFoundError(f"{self.path} has no manifest")
        schema = StructType.fromJson(json.loads(state["schema"]))
        files = [f"{self.path}/{f['path']}" for f in state["files"] if only is None or only(f)]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, by: str | None) -> list[dict]:
        """Files beside the table, one folder for each value of `by`."""
        folder, (where, root) = f"data/{uuid.uuid4().hex}", open_folder(self.path)
        rows = df if by is None else df.withColumn(f"_{by}", F.col(by)).drop(*([by] if by == "_bucket" else []))
        writer = rows.write if by is None else rows.write.partitionBy(f"_{by}")
        writer.parquet(f"{self.path}/{folder}")
        from pyarrow import fs

        files = []
        for f in where.get_file_info(fs.FileSelector(posixpath.join(root, folder), recursive=True)):
            if f.base_name.endswith(".parquet"):
                part = posixpath.basename(posixpath.dirname(f.path))
                files.append({"path": posixpath.relpath(f.path, root), "bytes": f.size, "part": part.partition("=")[2] if "=" in part else None})
        return files

    def _schema(self, df: DataFrame, state: dict) -> str:
        new = json.loads(df.schema.json())
        for f in new["fields"]:
            f["nullable"] = True
        if state["schema"] is not None and [(f["name"], f["type"]) for f in json.loads(state["schema"])["fields"]] != [(f["name"], f["type"]) for f in new["fields"]]:
            raise ValueError("columns differ from the table's")
        return json.dumps(new)

    def append(self, df: DataFrame, by: str | None = None, batch: tuple[str, int] | None = None, **properties) -> bool:
        """Adds rows, in files by the values of a column if one is given.  A batch (writer, number) that the table already
        has is left out: False."""
        state = self.state()
        if batch is not None and state["batches"].get(batch[0], -1) >= batch[1]:
            return False
        schema = self._schema(df, state)
        files = state["files"] + self._write(df, by)
        publish(self.path, state, files=files, schema=schema, batches=state["batches"] | (dict([batch]) if batch else {}), properties=state["properties"] | properties)
        return True

    def overwrite(self, df: DataFrame, by: str | None = None, **properties) -> None:
        state = self.state()
        publish(self.path, state, files=self._write(df, by), schema=self._schema(df, {"schema": None}), properties=state["properties"] | properties)

    def drop_parts(self, before: str) -> int:
        """Takes the files of parts (as text) before one out of the table, as days that have passed; how many."""
        state = self.state()
        kept = [f for f in state["files"] if f["part"] is None or f["part"] >= before]
        if len(kept) < len(state["files"]):
            publish(self.path, state, files=kept)
        return len(state["files"]) - len(kept)

    def merge(self, changes: DataFrame, key: str, buckets: int, update, **properties) -> int:
        """Replaces the buckets of keys that change: update(current rows, changes) gives the rows of these buckets.  The
        number of buckets is the table's from its first merge on.  Returns how many were written."""
        state = self.state()
        buckets = state["properties"].get("buckets", buckets)
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        touched = {str(r[0]) for r in changes.select(bucket).distinct().collect()}  # at most `buckets`
        if not touched:
            publish(self.path, state, properties=state["properties"] | properties)
            return 0
        current = self.read(state, lambda f: f["part"] in touched) if state["schema"] is not None else None
        new = update(current, changes)
        files = self._write(new.withColumn("_bucket", bucket).repartition("_bucket"), "_bucket")
        publish(self.path, state, files=[f for f in state["files"] if f["part"] not in touched] + files, schema=self._schema(new, state), properties=state["properties"] | properties | {"buckets": buckets})
        return len(touched)

    def vacuum(self, keep: int = 2, grace_s: float = 3600) -> list[str]:
        return vacuum(self.path, keep, grace_s)


# --- a sink


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class _Tasks:
    def __init__(self, options, schema: StructType):
        self.path, self.schema, self.writer = options["path"].rstrip("/"), schema, options.get("writer", "stream")
        self.run = uuid.uuid4().hex

    def put(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """One file beside the table, if there are rows; of a task run again each run has its own."""
        import pyarrow.parquet as pq

        where, root = open_folder(self.path)
        file, out, n = f"data/{self.run}/{uuid.uuid4().hex}.parquet", None, 0
        for b in batches:
            if b.num_rows:
                if out is None:
                    where.create_dir(posixpath.join(root, f"data/{self.run}"), recursive=True)
                    out = pq.ParquetWriter(posixpath.join(root, file), b.schema, filesystem=where)
                out.write_batch(b)
                n += b.num_rows
        if out is None:
            return Written([])
        out.close()
        return Written([{"path": file, "rows": n, "bytes": where.get_file_info(posixpath.join(root, file)).size, "part": None}])

    def publish(self, messages, state: dict, files: list[dict], **more) -> None:
        schema = json.loads(self.schema.json())
        for f in schema["fields"]:
            f["nullable"] = True
        publish(self.path, state, files=files + [f for m in messages if m is not None for f in m.files], schema=json.dumps(schema), **more)

    def drop(self, messages) -> None:
        where, root = open_folder(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            where.delete_file(posixpath.join(root, f["path"]))


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, tasks: _Tasks, overwrite: bool):
        self.tasks, self.overwrite = tasks, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.tasks.put(iterator)

    def commit(self, messages) -> None:
        state = newest(self.tasks.path)
        self.tasks.publish(messages, state, [] if self.overwrite else state["files"])

    def abort(self, messages) -> None:
        self.tasks.drop(messages)


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, tasks: _Tasks):
        self.tasks = tasks

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.tasks.put(iterator)

    def commit(self, messages, batchId: int) -> None:
        state = newest(self.tasks.path)
        if state["batches"].get(self.tasks.writer, -1) >= batchId:
            self.tasks.drop(messages)  # a batch run again
            return
        self.tasks.publish(messages, state, state["files"], batches=state["batches"] | {self.tasks.writer: batchId})

    def abort(self, messages, batchId: int) -> None:
        self.tasks.drop(messages)


class ManifestSink(DataSource):
    """df.write.format("manifest_table").option("path", ...): mode append or overwrite; as a stream with `writer`, a name
    of the query that outlives it."""

    @classmethod
    def name(cls) -> str:
        return "manifest_table"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(_Tasks(self.options, schema), overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(_Tasks(self.options, schema))

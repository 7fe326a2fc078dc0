"""A Python data source over a log client: block ranges as partitions, batch and stream.

    spark.dataSource.register(BlockLogs)
    spark.read.format("block_logs").option("client", "module:function").option("from", 0).option("to", 999).load()

The client is called as function(options) and has head() -> int and logs(first, last) -> list of dicts with
LOG's fields.  Ranges of `batch` blocks are read by one task each, so a retried task reads its own range again.
A stream goes from `from` (inclusive) to the head; after a restart it goes on from where its checkpoint says.  With
`progress` (a file of its own for each query, on storage that outlives the driver) it takes at most
`blocks_per_trigger` blocks at a time, and offsets never go back, though an endpoint's head does.  `client` may name several endpoints, separated by commas: a range is read from
the first that answers, beginning with another one at each attempt (`attempts` rounds, 3 by default), and the head
is the highest of those that answer.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "address string, topics array<string>, data string, blockNumber string, logIndex string, blockHash string, transactionHash string, transactionIndex string, removed boolean"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]


def read_number(path: str) -> int | None:
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(path)
    if where.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with where.open_input_stream(path) as f:
        return int(f.read())


def write_number(path: str, n: int) -> None:
    """Written beside and moved, so that what is there is always whole."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(path)
    where.create_dir(os.path.dirname(path), recursive=True)
    with where.open_output_stream(path + ".new") as f:
        f.write(str(n).encode())
    where.move(path + ".new", path)


class Blocks(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def clients(options) -> list:
    """Functions that make a client, an endpoint each."""
    out = []
    for endpoint in options["client"].split(","):
        module, _, name = endpoint.strip().partition(":")
        out.append(getattr(importlib.import_module(module), name))
    return out


def head(options) -> int:
    got, last = [], None
    for make in clients(options):
        try:
            got.append(make(options).head())
        except Exception as e:  # an endpoint that is down must not stop the others
            last = e
    if not got:
        raise last
    return max(got)


def logs(options, first: int, last: int) -> list[dict]:
    """From one of the endpoints; a fresh connection for each attempt."""
    makers, error = clients(options), None
    for attempt in range(int(options.get("attempts", 3)) * len(makers)):
        try:
            return makers[(first + attempt) % len(makers)](options).logs(first, last)
        except Exception as e:
            error = e
    raise error


def split(first: int, last: int, batch: int) -> list[Blocks]:
    return [Blocks(a, min(a + batch - 1, last)) for a in range(first, last + 1, batch)]


def rows_of(options, part: Blocks) -> Iterator[tuple]:
    try:
        got = logs(options, part.first, part.last)
    except Exception:
        if options.get("skip_failed", "false").lower() != "true":
            raise
        return  # a backfill that only completes what is known may leave a range out
    for r in sorted(got, key=lambda r: (int(r["blockNumber"], 16), int(r["logIndex"], 16))):
        yield tuple(r.get(f, False if f == "removed" else "" if f == "blockHash" else None) for f in FIELDS)


class RangeReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self) -> list[Blocks]:
        last = self.options.get("to")
        last = head(self.options) if last is None else int(last)
        return split(int(self.options.get("from", 0)), last, int(self.options.get("batch", 1000)))

    def read(self, partition: Blocks) -> Iterator[tuple]:
        return rows_of(self.options, partition)


class HeadReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options, self.at = options, None

    def initialOffset(self) -> dict:
        return {"next": int(self.options.get("from", 0))}

    def latestOffset(self) -> dict:
        """Spark doesn't say where its checkpoint is, so `progress` keeps the last offset given, which is never
        before the checkpoint's.  Without it the head is given, however far away."""
        end, path = head(self.options) + 1, self.options.get("progress")
        if path is None:
            self.at = max(end, self.at or 0)
            return {"next": self.at}
        if self.at is None:
            self.at = read_number(path)
        start = self.initialOffset()["next"] if self.at is None else self.at
        self.at = max(start, min(end, start + int(self.options.get("blocks_per_trigger", 100_000))))
        write_number(path, self.at)
        return {"next": self.at}

    def partitions(self, start: dict, end: dict) -> list[Blocks]:
        return split(start["next"], end["next"] - 1, int(self.options.get("batch", 1000)))

    def read(self, partition: Blocks) -> Iterator[tuple]:
        return rows_of(self.options, partition)


class BlockLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)

    def streamReader(self, schema) -> HeadReader:
        return HeadReader(self.options)

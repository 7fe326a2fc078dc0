"""A raced subscription: several endpoints give the same logs, each at its own pace, and every delivery comes out.

    spark.dataSource.register(RacedLogs)
    spark.readStream.format("raced_logs").option("client", "module:left,module:right").option("from", 0).load()

Clients are those of `ranges`.  A stream's offset is a vector, the next block of each endpoint; a micro-batch has a
partition for each endpoint (ranges of `batch` blocks of it).  An endpoint that doesn't answer stays where it is, and is
asked again after 1, 2, 5, 10, then every 30 seconds (`schedule`), while the others go on; once it is back it reads
from the last block it has seen, that one again.  Rows have `source`, the endpoint's place or its name in `names`, and
`received_us`, so that a race can be run and repeats dropped (`events.source_race`, `events.first_wins`).

A range that fails within a task is tried along the same schedule before the task fails.  `progress`, a file of its own
for each query on storage that outlives the driver, keeps the vector: without it an endpoint that is down when a query
starts again begins at `from` once more, and its rows come again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from opalstream.sources.manifest import open_folder
from opalstream.sources.ranges import FIELDS, SCHEMA, clients, split

# Seconds before an endpoint is tried again.
SCHEDULE = "1,2,5,10,30"


class Backoff:
    """When to try again: the schedule's steps, its last one for good; from the beginning after a success."""

    def __init__(self, steps: list[float], clock=time.monotonic):
        self.steps, self.clock, self.failed, self.at = steps, clock, 0, None

    def ready(self) -> bool:
        return self.at is None or self.clock() >= self.at

    def failure(self) -> float:
        wait = self.steps[min(self.failed, len(self.steps) - 1)]
        self.failed, self.at = self.failed + 1, self.clock() + wait
        return wait

    def success(self) -> None:
        self.failed, self.at = 0, None


def schedule(options) -> list[float]:
    return [float(x) for x in options.get("schedule", SCHEDULE).split(",")]


class Part(InputPartition):
    def __init__(self, endpoint: int, first: int, last: int):
        self.endpoint, self.first, self.last = endpoint, first, last


def _saved(path: str | None) -> dict | None:
    from pyarrow import fs

    if path is None:
        return None
    where, file = open_folder(path)
    if where.get_file_info(file).type == fs.FileType.NotFound:
        return None
    with where.open_input_stream(file) as f:
        return json.loads(f.read())


def _save(path: str | None, vector: dict) -> None:
    if path is None:
        return
    where, file = open_folder(path)
    where.create_dir(file.rpartition("/")[0], recursive=True)
    with where.open_output_stream(file + ".new") as f:
        f.write(json.dumps(vector).encode())
    where.move(file + ".new", file)


class RacedReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options, self.makers = options, clients(options)
        self.backoff = [Backoff(schedule(options)) for _ in self.makers]
        self.vector: dict | None = None

    def initialOffset(self) -> dict:
        return {str(i): {"next": int(self.options.get("from", 0)), "back": 0} for i in range(len(self.makers))}

    def latestOffset(self) -> dict:
        if self.vector is None:
            self.vector = self.initialOffset() | (_saved(self.options.get("progress")) or {})
        most = int(self.options.get("blocks_per_trigger", 100_000))
        for i, make in enumerate(self.makers):
            own, pause = self.vector[str(i)], self.backoff[i]
            if not pause.ready():
                continue
            try:
                end = make(self.options).head() + 1
            except Exception:  # this endpoint waits, the others don't
                pause.failure()
                continue
            back = own["back"] + (pause.failed > 0)
            pause.success()
            self.vector[str(i)] = {"next": max(own["next"], min(end, own["next"] + most)), "back": back}
        _save(self.options.get("progress"), self.vector)
        return json.loads(json.dumps(self.vector))

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for i in range(len(self.makers)):
            a, b = start.get(str(i), self.initialOffset()[str(i)]), end[str(i)]
            first = a["next"] - (b["back"] > a["back"] and a["next"] > int(self.options.get("from", 0)))
            if b["next"] > a["next"] or (b["back"] > a["back"] and first < a["next"]):
                out += [Part(i, x.first, x.last) for x in split(first, b["next"] - 1, int(self.options.get("batch", 1000)))]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        name = self.options.get("names", ",".join(map(str, range(len(self.makers))))).split(",")[partition.endpoint].strip()
        steps = schedule(self.options)
        for wait in [*steps, None]:
            try:
                got = self.makers[partition.endpoint](self.options).logs(partition.first, partition.last)
                break
            except Exception:
                if wait is None:
                    raise
                time.sleep(wait)
        now = time.time_ns() // 1000
        for r in sorted(got, key=lambda r: (int(r["blockNumber"], 16), int(r["logIndex"], 16))):
            yield (*(r.get(f, False if f == "removed" else "" if f == "blockHash" else None) for f in FIELDS), name, r.get("received_us", now))


class RacedLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raced_logs"

    def schema(self) -> str:
        return SCHEMA + ", source string, received_us long"

    def streamReader(self, schema) -> RacedReader:
        return RacedReader(self.options)

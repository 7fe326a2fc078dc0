"""Listings that are read page by page, each page's key coming from the page before.

    spark.dataSource.register(KeysetPages)
    spark.readStream.format("keyset_pages").option("client", "module:function").option("listings", "open,closed").load()

The client, function(options), has page(listing, after, size): rows (dicts with `id` and `updated_at`, texts), the last
updated first, those after the row (updated_at, id) given, or from the newest.  A listing is one partition, as its pages
follow from each other; listings are read side by side.

A stream's offset is each listing's newest time when its micro-batch began.  A walk goes down from the newest row until a
page holds a row older than where the micro-batch before began (`boundary` at first); the rest of that page still counts,
and rows of that very time come again, as more of them may have been written.  A row stamped anew while a walk is on its
way leaves the pages to come, but its new time is beyond the offset, so the next walk finds it; so none is lost, and
rows that come twice are for an upsert to merge.  A page is tried `attempts` times (3), on keys in turn (`keys`): a key
that fails rests for `cooldown` seconds.  With `every` ("past:5") a listing is asked only in every so many rounds,
the first included.

In batch form all pages down to `boundary` are read, all there are without one.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from opalstream.sources.ranges import clients

SCHEMA = "listing string, id string, updated_at string, body string"


class Keys:
    """Keys in turn; one that has failed rests.  If all rest, the one that has rested longest is taken."""

    def __init__(self, keys: list[str], cooldown: float, clock=time.monotonic):
        self.keys, self.cooldown, self.clock, self.turn, self.rests = keys, cooldown, clock, 0, {}

    def take(self) -> str:
        for i in range(len(self.keys)):
            k = self.keys[(self.turn + i) % len(self.keys)]
            if self.rests.get(k, float("-inf")) <= self.clock():
                self.turn = (self.turn + i + 1) % len(self.keys)
                return k
        return min(self.keys, key=self.rests.__getitem__)

    def failed(self, key: str) -> None:
        self.rests[key] = self.clock() + self.cooldown


class Pager:
    def __init__(self, options):
        self.options, self.make = options, clients(options)[0]
        self.size, self.attempts = int(options.get("page", 100)), int(options.get("attempts", 3))
        self.keys = Keys(options.get("keys", "").split(","), float(options.get("cooldown", 60)))

    def page(self, listing: str, after: tuple[str, str] | None) -> list[dict]:
        for attempt in range(self.attempts):
            key = self.keys.take()
            try:
                return self.make({**self.options, "key": key}).page(listing, after, self.size)
            except Exception:
                self.keys.failed(key)
                if attempt + 1 == self.attempts:
                    raise
        return []

    def walk(self, listing: str, oldest: str | None) -> Iterator[dict]:
        """Rows from the newest down, page by page, to the end of the first page that has one older than `oldest`."""
        after = None
        while rows := self.page(listing, after):
            yield from rows
            if len(rows) < self.size or (oldest is not None and any(r["updated_at"] < oldest for r in rows)):
                return
            after = (rows[-1]["updated_at"], rows[-1]["id"])


class Listing(InputPartition):
    def __init__(self, name: str, oldest: str | None):
        self.name, self.oldest = name, oldest


def listings(options) -> list[str]:
    return [x.strip() for x in options.get("listings", "all").split(",")]


def _rows(options, part: Listing) -> Iterator[tuple]:
    for r in Pager(options).walk(part.name, part.oldest):
        yield part.name, str(r["id"]), r["updated_at"], json.dumps(r)


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self) -> list[Listing]:
        return [Listing(x, self.options.get("boundary")) for x in listings(self.options)]

    def read(self, partition: Listing) -> Iterator[tuple]:
        return _rows(self.options, partition)


class PageStream(DataSourceStreamReader):
    def __init__(self, options):
        self.options, self.pager, self.round, self.last = options, Pager(options), 0, {}
        self.every = {x.partition(":")[0].strip(): int(x.partition(":")[2]) for x in options.get("every", "").split(",") if x}

    def initialOffset(self) -> dict:
        return {x: self.options.get("boundary", "") for x in listings(self.options)}

    def latestOffset(self) -> dict:
        """The newest time of each listing, before any page of the micro-batch is read."""
        out = self.initialOffset() | self.last
        for x in out:
            if self.round % self.every.get(x, 1) == 0:
                rows = self.pager.page(x, None)
                out[x] = max([out[x], *(r["updated_at"] for r in rows[:1])])
        self.round, self.last = self.round + 1, out
        return dict(out)

    def partitions(self, start: dict, end: dict) -> list[Listing]:
        return [Listing(x, start.get(x) or None) for x in listings(self.options) if end[x] > start.get(x, "")]

    def read(self, partition: Listing) -> Iterator[tuple]:
        return _rows(self.options, partition)


class KeysetPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyset_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)

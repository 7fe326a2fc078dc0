"""Following a file that grows, is cut short, or is moved away and begun anew.

    spark.dataSource.register(TailLines)
    spark.readStream.format("tail_lines").option("path", "/mount/log.csv").load()      # line string, at long

An offset is the file's inode and the byte after its last whole line; half a line waits until its end has come.  If the
inode has changed, the old file's rest is read first, where it is still in the folder under any name, to its very end,
then the new file from its start.  A file that is shorter than before is read from its start.  The path is one that
driver and executors see (a shared mount); ranges of `chunk` bytes, cut at line ends, are read by a task each.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 1 << 16


class Bytes(InputPartition):
    def __init__(self, path: str, inode: int, first: int, end: int):
        self.path, self.inode, self.first, self.end = path, inode, first, end


def last_line_end(path: str) -> tuple[int, int]:
    """The inode and the byte after the last line end, 0 if there is none."""
    with open(path, "rb") as f:
        inode, at = os.fstat(f.fileno()).st_ino, f.seek(0, os.SEEK_END)
        while at > 0:
            first = max(0, at - BLOCK)
            f.seek(first)
            found = f.read(at - first).rfind(b"\n")
            if found >= 0:
                return inode, first + found + 1
            at = first
    return inode, 0


def by_inode(folder: str, inode: int) -> str | None:
    with os.scandir(folder) as files:
        return next((f.path for f in files if f.is_file() and f.inode() == inode), None)


def line_cuts(path: str, first: int, end: int, chunk: int) -> list[int]:
    """Places at line ends, at least `chunk` bytes apart."""
    cuts = [first]
    with open(path, "rb") as f:
        while end - cuts[-1] > chunk:
            f.seek(cuts[-1] + chunk - 1)
            f.readline()
            cuts.append(min(f.tell(), end))
    return cuts + [end] if cuts[-1] < end else cuts


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.chunk = options["path"], int(options.get("chunk", 1 << 26))

    def initialOffset(self) -> dict:
        return {"inode": 0, "at": 0}

    def latestOffset(self) -> dict:
        try:
            inode, at = last_line_end(self.path)
        except FileNotFoundError:  # between a move and the new file
            return getattr(self, "last", self.initialOffset())
        self.last = {"inode": inode, "at": at}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Bytes]:
        out, inode = [], end["inode"]
        path = by_inode(os.path.dirname(self.path) or ".", inode) or self.path
        if start["inode"] not in (0, inode):
            old = by_inode(os.path.dirname(self.path) or ".", start["inode"])
            if old is not None and os.path.getsize(old) > start["at"]:
                out += self._cut(old, start["inode"], start["at"], os.path.getsize(old))
        first = start["at"] if start["inode"] == inode and end["at"] >= start["at"] else 0
        return out + (self._cut(path, inode, first, end["at"]) if end["at"] > first else [])

    def _cut(self, path: str, inode: int, first: int, end: int) -> list[Bytes]:
        cuts = line_cuts(path, first, end, self.chunk)
        return [Bytes(path, inode, a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: Bytes) -> Iterator[tuple]:
        path = partition.path
        if not os.path.exists(path) or os.stat(path).st_ino != partition.inode:  # moved since the ranges were made
            path = by_inode(os.path.dirname(path) or ".", partition.inode)
        with open(path, "rb") as f:
            f.seek(partition.first)
            at = partition.first
            while at < partition.end and (line := f.readline(partition.end - at)):
                yield line.rstrip(b"\r\n").decode("utf-8", "replace"), at
                at += len(line)


class TailLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def schema(self) -> str:
        return "line string, at long"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)

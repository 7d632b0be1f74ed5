"""A streaming source that follows files by byte offset.

Spark's own file source reads each file once and misses what is appended
later. Here the offset of a batch is {path: bytes read}, always after a line
feed, so a line that is still being written waits for its end. A file that
has become smaller than its offset is read from the start again; one that is
missing or can't be read keeps its offset.

The driver only looks at sizes and at the ends of files; the tasks read, each
the lines that begin in its range, so a long backlog spreads over executors.
Where they are on other machines, the files must be on a folder all of them see.

    spark.dataSource.register(ByteTail)
    spark.readStream.format("bytetail").option("paths", "/var/log/*.log").load()
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logquarry.config import Positions

#: Bytes of a file that one task reads.
RANGE_BYTES = 64 << 20
_BLOCK = 1 << 16


class ByteTail(DataSource):
    """Options: paths (comma-separated, globs allowed), startingOffset (latest or earliest), positions (a JSON file of offsets), rangeBytes, maxBytesPerBatch (of each file; 0: no limit)."""

    @classmethod
    def name(cls) -> str:
        return "bytetail"

    def schema(self) -> str:
        return "source string, line string, at long"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


@dataclass
class ByteRange(InputPartition):
    """Lines of a file that begin in [start, stop); the batch begins at ``first`` and ends at ``end``."""

    path: str
    first: int
    start: int
    stop: int
    end: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.patterns = [p.strip() for p in options.get("paths", "").split(",") if p.strip()]
        self.latest = options.get("startingOffset", "latest") == "latest"
        self.positions = options.get("positions", "")
        self.range = int(options.get("rangeBytes", RANGE_BYTES))
        self.most = int(options.get("maxBytesPerBatch", 0))
        #: Offsets that files had last: one that can't be read for a while goes on from there.
        self.known: dict[str, int] = {}
        #: Those that only the log of an earlier run knows.
        self.away: dict[str, int] = {}

    def _files(self) -> list[str]:
        """Paths as written, or what a glob finds now."""
        return sorted({f for p in self.patterns for f in (glob.glob(p) or ([] if glob.has_magic(p) else [p]))})

    def initialOffset(self) -> dict:
        saved = Positions(self.positions).load().offsets
        start = {}
        for p in self._files():
            end = _last_line_end(p)
            start[p] = saved[p] if p in saved else (end or 0) if self.latest else 0
        return self._seen(start)

    def latestOffset(self) -> dict:
        ends = {p: _last_line_end(p) for p in self._files()}
        return self._seen({p: self._capped(p, e) for p, e in ends.items() if e is not None})

    def _capped(self, path: str, end: int) -> int:
        """Of a backlog as many lines as the limit allows, one at least; a file that was cut has none."""
        last = self.known.get(path, 0)
        if not self.most or end - last <= self.most:
            return end
        try:
            with open(path, "rb") as f:
                f.seek(last)
                at = f.read(self.most).rfind(b"\n") + 1
                if not at:
                    f.seek(last)
                    at = len(f.readline())
        except OSError:
            return last
        return min(last + at, end)

    def _seen(self, ends: dict) -> dict:
        self.known |= ends
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        self.away |= {p: at for p, at in start.items() if p not in end}
        self.known = {**self.away, **self.known}
        found = []
        for path, stop in end.items():
            first = start.get(path, self.away.get(path, 0))
            first = first if first <= stop else 0  # the file was cut
            found += [ByteRange(path, first, a, min(a + self.range, stop), stop) for a in range(first, stop, self.range)]
        return found

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        return lines(partition)

    def commit(self, end: dict) -> None:
        Positions(self.positions, dict(end)).save()


def lines(p: ByteRange) -> Iterator[tuple]:
    """(path, line, offset); one carriage return at the end goes, and empty lines do.

    Reading a range again gives the same lines. Where a file was cut
    meanwhile, the bytes are gone and nothing takes their place.
    """
    try:
        with open(p.path, "rb") as f:
            if os.fstat(f.fileno()).st_size < p.end:
                return
            f.seek(p.start)
            at = p.start
            if p.start > p.first:
                f.seek(p.start - 1)
                at += len(f.readline()) - 1  # to the first line that begins in the range
            while at < p.stop:
                raw = f.readline()
                text = raw.removesuffix(b"\n").removesuffix(b"\r")
                if text:
                    yield p.path, text.decode("utf-8", "replace"), at
                at += len(raw)
                if not raw:
                    return
    except FileNotFoundError:
        return


def _last_line_end(path: str) -> int | None:
    """The offset after the last line feed, found from the end; none if the file can't be read."""
    try:
        with open(path, "rb") as f:
            stop = f.seek(0, os.SEEK_END)
            while stop > 0:
                start = max(0, stop - _BLOCK)
                f.seek(start)
                at = f.read(stop - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                stop = start
            return 0
    except OSError:
        return None

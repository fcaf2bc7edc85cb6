"""A streaming source for growing line files: reads on from (inode, byte offset), so a log need not be rotated into a folder first.

Offsets hold, for each file, its device and inode and the byte after the last complete line that was read. A last line without
its line end is left for later. A file whose inode changed, or that is shorter than what was read of it, is read
from its beginning; if the file that was read before is found under another name in the same folder, what it
had still to give is read first. A backlog is read in ranges of `rangeBytes`, one task each.

The files lie where driver and executors see them under the same path.

    spark.dataSource.register(TailSource)
    spark.readStream.format("tail_lines").option("path", "/logs/events*.jsonl").load()  # file, offset, line
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import ship_code

#: Bytes of a task's range, and of a step when looking for a line end.
RANGE_BYTES, STEP = 64 << 20, 1 << 16


@dataclass
class Range(InputPartition):
    """Lines that begin in [begin, end) of a file. `inode`: the file must still be that one, under this or another name of its folder."""

    path: str
    inode: str
    begin: int
    end: int


def inode_of(path: str) -> str | None:
    try:
        st = os.stat(path)
    except FileNotFoundError:
        return None
    return f"{st.st_dev}:{st.st_ino}"


def renamed(path: str, inode: str) -> str | None:
    """The name in the path's folder under which the file with that inode is now."""
    folder = os.path.dirname(path) or "."
    if inode_of(path) == inode:
        return path
    return next((p for name in sorted(os.listdir(folder)) if os.path.isfile(p := os.path.join(folder, name)) and inode_of(p) == inode), None)


def last_line_end(path: str, size: int) -> int:
    """The byte after the last line end within the first `size` bytes; 0 without one."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            begin = max(0, at - STEP)
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return 0


def state_of(path: str) -> dict | None:
    """inode and complete bytes of a file, both of one open file."""
    try:
        with open(path, "rb") as f:
            st = os.fstat(f.fileno())
            return {"inode": f"{st.st_dev}:{st.st_ino}", "offset": last_line_end(path, st.st_size) if inode_of(path) == f"{st.st_dev}:{st.st_ino}" else 0}
    except FileNotFoundError:
        return None


def cut(path: str, inode: str, begin: int, end: int, size: int) -> list[Range]:
    return [Range(path, inode, at, min(at + size, end)) for at in range(begin, end, size)]


def lines_of(part: Range) -> Iterator[tuple[str, int, str]]:
    """The lines that begin in the range: a line belongs to the range that has its first byte."""
    now = renamed(part.path, part.inode)
    if now is None:
        raise FileNotFoundError(f"{part.path} with inode {part.inode} is gone before it was read")
    with open(now, "rb") as f:
        at = part.begin
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1  # up to the first line end at begin - 1 or later
        while at < part.end:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            yield part.path, at, line[:-1].decode("utf-8", "replace")
            at += len(line)


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str, size: int):
        self.pattern, self.size = pattern, size

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        states = {path: state_of(path) for path in sorted(glob.glob(self.pattern))}
        return {path: s for path, s in states.items() if s}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, now in sorted(end.items()):
            old, begin = start.get(path), 0
            if old and old["inode"] == now["inode"]:
                begin = old["offset"] if old["offset"] <= now["offset"] else 0
            elif old and (rest := renamed(path, old["inode"])) and rest not in end:
                out += cut(path, old["inode"], old["offset"], last_line_end(rest, os.path.getsize(rest)), self.size)
            elif not old and (before := next((s for p, s in start.items() if s["inode"] == now["inode"] and p not in end), None)):
                begin = before["offset"]  # the same file under another name that matches
            out += cut(path, now["inode"], begin, now["offset"], self.size)
        return out

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        yield from lines_of(partition)


class TailSource(DataSource):
    """Rows of file, offset (first byte of the line) and line."""

    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def streamReader(self, schema) -> TailReader:  # noqa: N802
        if not self.options.get("path"):
            raise ValueError("option path: a file or a pattern of files")
        return TailReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def tail_lines(spark: SparkSession, pattern: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of file, offset, line of all files that match the pattern, now and later."""
    ship_code(spark)
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail_lines").option("path", pattern).option("rangeBytes", range_bytes).load()

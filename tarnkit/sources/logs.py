"""The end of a log, read from the end: a data source that plans byte ranges.

However long a log is, only its last bytes are read; a line that the first range starts
within is left out. Where the log is shorter than that, as after a rotation, the range
goes on in the file rotated last (path.1), then in the one before it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TAIL_BYTES = 256 << 10
MOST_LINES, ROTATED = 500, 9


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    base: int  # bytes of older files before this one's first


def _open(path: str):
    """A file's file system and its path there; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _size(path: str) -> int | None:
    system, place = _open(path)
    info = system.get_file_info(place)
    return info.size if info.is_file else None


class TailReader(DataSourceReader):
    def __init__(self, path: str, most: int, split: int) -> None:
        self.path, self.most, self.split = path, most, split

    def partitions(self) -> list[Range]:
        """The last bytes of the log and, if it has fewer, of those rotated before it; oldest first."""
        if _size(self.path) is None:
            raise FileNotFoundError(self.path)
        files, left = [], self.most
        for name in (self.path, *(f"{self.path}.{k}" for k in range(1, ROTATED + 1))):
            size = _size(name)
            if size is None or not left:
                break
            take = min(size, left)
            files.append((name, size - take, size))
            left -= take
        out, base = [], 0
        for name, start, end in reversed(files):
            out += [Range(name, a, min(a + self.split, end), base) for a in range(start, end, self.split)]
            base += end
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        """The lines that begin in a range; the last may end beyond it, within the next."""
        system, place = _open(partition.path)
        with system.open_input_file(place) as file:
            size = file.size()
            before = max(0, partition.start - 1)
            file.seek(before)
            body = file.read(partition.end - before)
            at = body.find(b"\n") + 1 if partition.start and body else 0  # the line that goes on from before, or the byte before this one
            if partition.start and not at:
                return
            end = partition.end
            while end < size and not body.endswith(b"\n"):
                more = file.read(4096)
                stop = more.find(b"\n")
                body += more if stop < 0 else more[: stop + 1]
                end += len(more)
        for line in body[at:].split(b"\n"):
            if line.strip():
                yield partition.base + before + at, line.rstrip(b"\r").decode("utf-8", "replace")
            at += len(line) + 1


class LogTail(DataSource):
    """Options path, bytes (TAIL_BYTES) and split, the bytes of a task; columns at, which orders the lines, and line."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "at long, line string"

    def reader(self, schema: object) -> TailReader:
        most = int(self.options.get("bytes", TAIL_BYTES))
        return TailReader(self.options["path"], most, int(self.options.get("split", most)))


def log_tail(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    """The last n lines of a log that aren't empty, oldest first; n is at most 500 and at least 1."""
    spark.dataSource.register(LogTail)
    lines = spark.read.format("log_tail").option("path", path).load()
    last = lines.orderBy(F.desc("at")).limit(min(max(n, 1), MOST_LINES))
    return last.orderBy("at").select("line")

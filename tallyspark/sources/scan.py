"""A data source over growing logs: each line once, named by its file and the byte at which it begins.

`spark.read.format("log_lines")` reads every whole line of the files under a root. `spark.readStream.format("log_lines")` reads
what has been added since: it keeps a mark (size, modified) for each file and plans each batch from the marks.

- An unchanged file isn't opened. A grown one is read from the size it had. One that is shorter than it was has been
  rewritten and is read from its start. One that was only touched moves its mark.
- A file seen for the first time that nobody wrote to for `days` is marked as consumed and never opened.
- Marks of files that are gone are dropped.

A line belongs to the range of bytes that holds its newline. So a half-written last line is nobody's until it is whole, and
then the next range finds its beginning by looking back; and ranges of one file can be read by different tasks. A line's
number is the offset of its first byte, so a line has the same name whatever files are added and however files are split, and
a replay changes nothing that is known by it. Empty lines are left out.

The stream's offset is a version number. What a version reads, and the marks after it, are a small file in the folder
`marks`, written before the version is announced: a batch that runs again after a failure reads the same bytes. Files of
versions that are done are removed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from fnmatch import fnmatch
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "value string, file string, line long, modified timestamp"
#: Bytes of one task's range; lines given out at once; bytes looked back at once for a line's beginning.
RANGE, LINES, BACK = 32 << 20, 20_000, 1 << 16
DAYS = 366

#: (path, first byte, byte behind the last, modified in microseconds)
Piece = tuple[str, int, int, int]
#: path -> [size, modified in microseconds]
Marks = dict[str, list[int]]


@dataclass(frozen=True)
class Range(InputPartition):
    piece: Piece


def now_micros(now: str | None) -> int:
    at = datetime.fromisoformat(now) if now else datetime.now(timezone.utc)
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return int((at - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


class Root:
    """The files of a root on any file system that pyarrow reaches."""

    def __init__(self, path: str, glob: str) -> None:
        self.files, self.path = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.glob = glob

    def listed(self) -> Marks:
        """Size and time of each log; nothing hidden, nor in hidden folders."""
        found: Marks = {}
        selector = fs.FileSelector(self.path, recursive=True, allow_not_found=True)
        for f in self.files.get_file_info(selector):
            inner = f.path[len(self.path.rstrip("/")) :]
            if f.type == fs.FileType.File and fnmatch(f.base_name, self.glob) and "/." not in inner:
                found[f.path] = [f.size, (f.mtime_ns or 0) // 1000]
        return found

    def lines(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        """The lines whose newline lies in the piece."""
        path, first, last, modified = piece
        with self.files.open_input_file(path) as file:
            data = file.read_at(last - first, first)
            ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
            if not len(ends):
                return
            head, at = b"", first  # what stands before the piece of its first line
            while at > 0 and b"\n" not in head:
                step = min(BACK, at)
                at -= step
                head = file.read_at(step, at) + head
            head = head[head.rfind(b"\n") + 1 :]
        data = head + data
        ends = ends + len(head)
        starts = np.concatenate([[0], ends[:-1] + 1])
        full = ends > starts
        starts, ends = starts[full], ends[full]
        for i in range(0, len(starts), LINES):
            a, b = starts[i : i + LINES], ends[i : i + LINES]
            values = pa.array([data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()).view(pa.string())
            k = len(a)
            times = pa.array(np.full(k, modified), pa.int64()).cast(pa.timestamp("us", tz="UTC"))
            yield pa.RecordBatch.from_arrays([values, pa.array([path] * k), pa.array(a + (first - len(head))), times], names=["value", "file", "line", "modified"])


def ranges(pieces: list[Piece], size: int) -> list[Range]:
    return [Range((path, a, min(a + size, last), modified)) for path, first, last, modified in pieces for a in range(first, last, size)]


def planned(marks: Marks, listed: Marks, cutoff: int) -> tuple[Marks, list[Piece]]:
    """The marks after a scan, and what it reads."""
    after, pieces = {}, []
    for path, (size, modified) in sorted(listed.items()):
        mark = marks.get(path)
        if mark is None:
            start = size if modified < cutoff else 0
        elif mark == [size, modified]:
            start = size
        else:
            start = 0 if size < mark[0] else mark[0]
        after[path] = [size, modified]
        if start < size:
            pieces.append((path, start, size, modified))
    return after, pieces


class _Whole(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.size = Root(options["path"], options.get("glob", "*.jsonl")), int(options.get("range", RANGE))
        self.since = now_micros(options.get("now")) - int(options.get("days", DAYS)) * 86_400_000_000 if "now" in options else 0

    def partitions(self) -> list[InputPartition]:
        return ranges(planned({}, self.root.listed(), self.since)[1], self.size) or [Range(("", 0, 0, 0))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.root.lines(partition.piece) if partition.piece[0] else iter(())


class _Marked(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.size = Root(options["path"], options.get("glob", "*.jsonl")), int(options.get("range", RANGE))
        self.now, self.days = options.get("now"), int(options.get("days", DAYS))
        self.marks = options["marks"]

    @cached_property
    def folder(self) -> tuple[fs.FileSystem, str]:
        files, path = fs.FileSystem.from_uri(self.marks) if "://" in self.marks else (fs.LocalFileSystem(), self.marks)
        files.create_dir(path, recursive=True)
        return files, path

    def versions(self) -> list[int]:
        files, path = self.folder
        names = (f.base_name for f in files.get_file_info(fs.FileSelector(path)))
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[: -len(".json")].isdigit())

    def load(self, version: int) -> dict:
        files, path = self.folder
        with files.open_input_stream(f"{path}/{version}.json") as f:
            return json.loads(f.read())

    def save(self, version: int, marks: Marks, pieces: list[Piece]) -> None:
        files, path = self.folder
        with files.open_output_stream(f"{path}/{version}.new") as f:
            f.write(json.dumps({"marks": marks, "pieces": pieces}).encode())
        files.move(f"{path}/{version}.new", f"{path}/{version}.json")

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        version = max(self.versions(), default=0)
        held = self.load(version) if version else {"marks": {}, "pieces": []}
        cutoff = now_micros(self.now) - self.days * 86_400_000_000
        marks, pieces = planned(held["marks"], self.root.listed(), cutoff)
        if pieces:
            version += 1
            self.save(version, marks, pieces)
        elif version and marks != held["marks"]:  # marks that moved, or went, read nothing
            self.save(version, marks, held["pieces"])
        elif not version and marks:
            self.save(version := 1, marks, [])
        return {"version": version}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        pieces = [tuple(p) for v in range(start["version"] + 1, end["version"] + 1) for p in self.load(v)["pieces"]]
        return ranges(pieces, self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.root.lines(partition.piece)

    def commit(self, end: dict) -> None:
        files, path = self.folder
        for v in self.versions():
            if v < end["version"]:
                files.delete_file(f"{path}/{v}.json")


class LogLines(DataSource):
    """Options: path (the root), glob, days, now (ISO; files untouched for `days` before it aren't opened), range (bytes of a
    task); for a stream also marks (a folder)."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Whole(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Marked(self.options)


def _options(root: str, now: datetime | None, days: int, glob: str) -> dict[str, str]:
    return {"path": root, "glob": glob, "days": str(days)} | ({"now": now.isoformat()} if now else {})


def lines(spark: SparkSession, root: str, now: datetime | None = None, days: int = DAYS, glob: str = "*.jsonl", range_: int = RANGE) -> DataFrame:
    """value, file, line and modified of all whole lines under `root`; with `now`, not of files untouched for `days` before."""
    spark.dataSource.register(LogLines)
    return spark.read.format("log_lines").options(**_options(root, now, days, glob), range=str(range_)).load()


def added_lines(spark: SparkSession, root: str, marks: str, now: datetime | None = None, days: int = DAYS, glob: str = "*.jsonl", range_: int = RANGE) -> DataFrame:
    """The stream of lines that are added under `root`. `marks` is a folder of its own for each stream."""
    spark.dataSource.register(LogLines)
    return spark.readStream.format("log_lines").options(**_options(root, now, days, glob), range=str(range_), marks=marks).load()

"""`spark.read.format("exposition")` and `spark.readStream.format("exposition")`: metric samples from exposition text files.

    from tessella.sources.exposition import register
    register(spark)
    spark.read.format("exposition").load("s3://bucket/scrapes")

A row is a sample line: file (relative to the path), at (the byte at which its line begins, which orders the lines of a file whoever reads them), key (name
with labels as written), name, value. Comments, blanks and lines without a readable number have no row.

A batch is planned as stretches of files of `stretch` bytes (64 MB unless the option says otherwise); a line belongs to the stretch in which it begins, so a
large file is many tasks' work. Filters on name by equality, set or prefix, and on file by equality, are pushed: other files are never opened, other lines never
parsed. A stream takes the new files of each trigger as a batch; its offset is the last name taken, so files must appear whole and under rising
names, as scrapes named by their time do.

Files are opened through pyarrow's file systems, on the executors by the same path as on the driver; hidden names (by _ or .) are passed over.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

SCHEMA = "file string, at bigint, key string, name string, value double"
NUMBER = re.compile(rb"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[Ii]nf(?:inity)?)\Z|[Nn]a[Nn]\Z")
ROWS = 8192


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ExpositionSource)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """Names, relative to the path, and sizes of its files, by name."""
    system, base = opened(path)
    if system.get_file_info(base).type == fs.FileType.File:
        return [("", system.get_file_info(base).size)]
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    names = [(f.path[len(base.rstrip("/")) + 1 :], f.size) for f in found if f.is_file]
    return sorted((n, s) for n, s in names if not re.search(r"(^|/)[_.]", n))


class Stretch(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class Wanted:
    """What pushed filters leave."""

    def __init__(self) -> None:
        self.files: set[str] | None = None
        self.names: set[bytes] | None = None
        self.prefixes: list[bytes] = []

    def take(self, f: Filter) -> bool:
        """Whether the filter is one that is dealt with here."""
        column = getattr(f, "attribute", None)
        if isinstance(f, IsNotNull) and len(column) == 1:
            return True  # no column is ever null
        values = [f.value] if isinstance(f, (EqualTo, StringStartsWith)) else list(f.value) if isinstance(f, In) else None
        if values is None or not all(isinstance(v, str) for v in values):
            return False
        if column == ("file",) and not isinstance(f, StringStartsWith):
            self.files = set(values) if self.files is None else self.files & set(values)
        elif column == ("name",) and isinstance(f, StringStartsWith):
            self.prefixes.append(values[0].encode())
        elif column == ("name",):
            new = {v.encode() for v in values}
            self.names = new if self.names is None else self.names & new
        else:
            return False
        return True

    def name(self, name: bytes) -> bool:
        return (self.names is None or name in self.names) and all(name.startswith(p) for p in self.prefixes)


def samples(path: str, part: Stretch, wanted: Wanted) -> Iterator[pa.RecordBatch]:
    system, base = opened(path)
    out: list[list] = [[], [], [], []]

    def made() -> pa.RecordBatch:
        columns = [pa.array([part.file] * len(out[0]), pa.string()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64())]
        for x in out:
            x.clear()
        return pa.RecordBatch.from_arrays(columns, names=["file", "at", "key", "name", "value"])

    with io.BufferedReader(system.open_input_file(f"{base.rstrip('/')}/{part.file}" if part.file else base), 1 << 20) as f:
        # The line that the byte before the stretch is in began earlier.
        at = max(0, part.start - 1)
        f.seek(at)
        if part.start:
            at += len(f.readline())
        while at < part.end:
            line = f.readline()
            if not line:
                break
            words = line.split()
            if len(words) and not words[0].startswith(b"#") and NUMBER.match(words[-1]):
                name = words[0].partition(b"{")[0]
                if wanted.name(name):
                    for column, x in zip(out, (at, words[0].decode("utf-8", "replace"), name.decode("utf-8", "replace"), float(words[-1])), strict=True):
                        column.append(x)
                    if len(out[0]) >= ROWS:
                        yield made()
            at += len(line)
    yield made()


def stretches(path: str, files: Sequence[tuple[str, int]], stretch: int) -> list[Stretch]:
    return [Stretch(name, start, min(size, start + stretch)) for name, size in files for start in range(0, size, stretch)]


class ExpositionReader(DataSourceReader):
    def __init__(self, path: str, stretch: int):
        self.path, self.stretch, self.wanted = path, stretch, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return stretches(self.path, [f for f in listed(self.path) if self.wanted.files is None or f[0] in self.wanted.files], self.stretch)

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from samples(self.path, partition, self.wanted)


class ExpositionStream(DataSourceStreamReader):
    def __init__(self, path: str, stretch: int):
        self.path, self.stretch = path, stretch

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max((name for name, _ in listed(self.path)), default="")}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return stretches(self.path, [f for f in listed(self.path) if start["after"] < f[0] <= end["after"]], self.stretch)

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from samples(self.path, partition, Wanted())

    def commit(self, end: dict) -> None:
        pass


class ExpositionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "exposition"

    def schema(self) -> str:
        return SCHEMA

    def _stretch(self) -> int:
        return int(self.options.get("stretch", 64 << 20))

    def reader(self, schema) -> DataSourceReader:
        return ExpositionReader(self.options["path"], self._stretch())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ExpositionStream(self.options["path"], self._stretch())

"""Files of lines as a Spark data source: a partition for each range of a file, exact places, and a stream that goes on where it stopped.

Register it with `register(spark)`, then read `spark.read.format("numbered_lines").load(folder)` or the same with readStream.
Paths are those that pyarrow's file systems open: local or mounted folders, hdfs:// and s3://.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a range, rows of a batch, bytes read back at once in search of the last whole line.
RANGE, BATCH, BACK = 64 << 20, 4096, 1 << 16
SCHEMA = "file string, range int, n long, at long, line string"
ARROW = pa.schema([("file", pa.string()), ("range", pa.int32()), ("n", pa.int64()), ("at", pa.int64()), ("line", pa.string())])


def _listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """(file, bytes) of the files below a folder, by name; hidden ones and those with another suffix are left out."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith((".", "_")))


def _opened(path: str, file: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)[0].open_input_file(file)


def last_line_end(path: str, file: str, start: int, size: int) -> int:
    """Place after the last line end between start and size, start if there is none."""
    with _opened(path, file) as f:
        at = size
        while at > start:
            a = max(start, at - BACK)
            f.seek(a)
            found = f.read(at - a).rfind(b"\n")
            if found >= 0:
                return a + found + 1
            at = a
    return start


class Range(InputPartition):
    """The lines of a file that begin in [start, end); `number` counts the file's ranges."""

    def __init__(self, file: str, number: int, start: int, end: int):
        self.file, self.number, self.start, self.end = file, number, start, end


def ranges(file: str, start: int, end: int, size: int) -> list[Range]:
    return [Range(file, k, a, min(a + size, end)) for k, a in enumerate(range(start, end, size))]


def lines_of(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    """Batches of a range's lines, without their ends; n counts from 0 in the range, at is a line's first byte in the file."""
    with _opened(path, part.file) as raw:
        f = io.BufferedReader(raw, 1 << 20)
        at = part.start
        if at:  # a line that begins before the range belongs to the one before
            f.seek(at - 1)
            at += len(f.readline()) - 1
        else:
            f.seek(0)
        rows, n = [], 0
        while at < part.end and (line := f.readline()):
            rows.append((part.file, part.number, n, at, line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")))
            at, n = at + len(line), n + 1
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix, self.size = options["path"], options.get("suffix", ""), int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[Range]:
        return [r for file, size in _listed(self.path, self.suffix) for r in ranges(file, 0, size, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return lines_of(self.path, partition)


class LinesStream(DataSourceStreamReader):
    """Offsets are the bytes of whole lines of each file, so files may grow, and a line is read once it is ended."""

    def __init__(self, options: dict):
        self.path, self.suffix, self.size = options["path"], options.get("suffix", ""), int(options.get("rangebytes", RANGE))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        for file, size in _listed(self.path, self.suffix):
            start = self.known.get(file, 0)
            self.known[file] = last_line_end(self.path, file, start, size) if size > start else start
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.known = {**self.known, **end}
        return [r for file, to in sorted(end.items()) if to > start.get(file, 0) for r in ranges(file, start.get(file, 0), to, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return lines_of(self.path, partition)


class NumberedLines(DataSource):
    """Columns file, range, n (place in the range), at (first byte in the file), line. Options: suffix, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LinesReader:
        return LinesReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> LinesStream:  # noqa: N802
        return LinesStream({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NumberedLines)


def read_lines(spark: SparkSession, folder: str, suffix: str = ".jsonl", size: int = RANGE) -> DataFrame:
    """(file, line_number, at, line) of all lines of the files below a folder; line_number counts from 1 in its file.

    Lines are counted by range first; a line's number is its place in the range and the lines of the ranges before.
    """
    register(spark)
    rows = spark.read.format("numbered_lines").option("suffix", suffix).option("rangeBytes", size).load(folder)
    counts = rows.groupBy("file", "range").agg(F.count("*").alias("n_lines"))
    before = F.coalesce(F.sum("n_lines").over(W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(counts.select("file", "range", before.alias("before")), ["file", "range"]).select("file", (F.col("before") + F.col("n") + 1).alias("line_number"), "at", "line")

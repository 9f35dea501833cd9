"""A streaming source for files that grow: telemetry that a sampler appends to, row by row.

Spark's own file source reads a file once, when it appears. Here the offset of a stream is the end of each file in bytes, as far as whole lines go. A
batch reads the ranges between two offsets, so a row is read once however often the stream starts again, a line that is still being
written waits for its end, and a large range is cut into pieces that tasks read side by side.

    spark.dataSource.register(GrowingCsv)
    spark.readStream.format("growing_csv").schema("epoch string, power_w string").option("path", folder).load()
"""

from __future__ import annotations

import csv
import fnmatch
import io
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructType

#: Bytes that a task reads, about; bytes that are searched for the end of the last whole line at once.
RANGE, TAIL = 8 << 20, 1 << 16


class Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class GrowingCsv(DataSource):
    """Options: path (a folder), pattern (of names; ``*.csv``). Columns are found by the file's header; all are strings, what isn't there is null."""

    @classmethod
    def name(cls) -> str:
        return "growing_csv"

    def schema(self) -> str:
        return "epoch string, power_w string"

    def streamReader(self, schema: StructType) -> GrowingReader:
        if any(not isinstance(f.dataType, StringType) for f in schema.fields):
            raise ValueError("columns of a growing file are strings: cast them after")
        return GrowingReader([f.name for f in schema.fields], self.options["path"], self.options.get("pattern", "*.csv"))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, columns: list[str], path: str, pattern: str):
        self.columns, self.path, self.pattern = columns, path if "://" in path else f"file://{path}", pattern

    def initialOffset(self) -> dict:
        return {"ends": {}}

    def latestOffset(self) -> dict:
        fs, root = pafs.FileSystem.from_uri(self.path)
        files = [f for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern)]
        return {"ends": {f.base_name: end for f in sorted(files, key=lambda f: f.base_name) if (end := _whole_lines(fs, f.path, f.size))}}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, last in end["ends"].items():
            first = start["ends"].get(name, 0)
            if last < first:
                raise ValueError(f"{name} has become shorter: it isn't the file that was read")
            out += [Range(name, a, min(a + RANGE, last)) for a in range(first, last, RANGE)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        """The rows whose lines begin in the range; the header is no row. Values may have spaces around them."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(f"{root}/{partition.path}") as f:
            header = [h.strip() for h in next(csv.reader([_line(f, 0).decode()]), [])]
            at = partition.first
            if at:  # a line that began before is another range's
                f.seek(at - 1)
                at = at - 1 + len(_line(f, at - 1)) if f.read(1) != b"\n" else at
            while at < partition.last:
                raw = _line(f, at)
                begin, at = at, at + len(raw)
                if not begin or not raw.strip():
                    continue
                found = dict(zip(header, (v.strip() for v in next(csv.reader(io.StringIO(raw.decode("utf-8", "replace"))), [])), strict=False))
                yield tuple(found.get(c) for c in self.columns)

    def commit(self, end: dict) -> None:
        pass


def _line(f, at: int) -> bytes:
    """The line from this byte on, with its line feed."""
    f.seek(at)
    out = b""
    while more := f.read(4096):
        cut = more.find(b"\n")
        if cut >= 0:
            return out + more[: cut + 1]
        out += more
    return out


def _whole_lines(fs: pafs.FileSystem, path: str, size: int) -> int:
    """Where the last whole line of a file ends."""
    with fs.open_input_file(path) as f:
        end = size
        while end > 0:
            begin = max(0, end - TAIL)
            f.seek(begin)
            cut = f.read(end - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            end = begin
    return 0


def growing_power(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Power samples (epoch, power_w, at) of CSV files as rows are added to them; bad rows are left out."""
    spark.dataSource.register(GrowingCsv)
    raw = spark.readStream.format("growing_csv").option("path", folder).option("pattern", pattern).load()
    rows = raw.select(F.col("epoch").try_cast("double").alias("epoch"), F.col("power_w").try_cast("double").alias("power_w")).where("epoch is not null and power_w is not null")
    return rows.withColumn("at", F.timestamp_micros((F.col("epoch") * 1e6).cast("bigint")))

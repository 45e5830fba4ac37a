"""Lines appended to text files, as a streaming source: offsets are bytes for each file.

    spark.dataSource.register(TailedLines)
    spark.readStream.format("tailed_lines").option("path", "/var/log/dns").option("start", "end").load()

A row is a line that has ended, with its file and the byte that it starts at. What a file gains is cut into blocks, so that
many tasks read a large gain; a line belongs to the block that it starts in.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, path string, offset long"


class TailedLines(DataSource):
    """Options: path (a file or a folder), start (beginning or end), block (bytes of a partition at most), marks (a file in
    shared storage that keeps where start=end began, for a query that stops before its first trigger is done)."""

    @classmethod
    def name(cls) -> str:
        return "tailed_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


@dataclass
class Piece(InputPartition):
    path: str
    low: int
    high: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.start = options["path"], options.get("start", "beginning")
        self.block, self.marks = int(options.get("block", 64 << 20)), options.get("marks")
        if self.start not in ("beginning", "end"):
            raise ValueError(f"start is beginning or end, not {self.start}")

    def initialOffset(self) -> dict:
        if self.start == "beginning":
            return {"files": "{}"}
        if self.marks:
            fs, name = FileSystem.from_uri(self.marks)
            if fs.get_file_info(name).type == FileType.File:
                with fs.open_input_stream(name) as f:
                    return {"files": f.read().decode()}
            now = self.latestOffset()
            fs.create_dir(name.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(name) as f:
                f.write(now["files"].encode())
            return now
        return self.latestOffset()

    def latestOffset(self) -> dict:
        fs, base = FileSystem.from_uri(self.path)
        infos = fs.get_file_info(FileSelector(base, allow_not_found=True)) if fs.get_file_info(base).type != FileType.File else [fs.get_file_info(base)]
        shown = [i for i in infos if i.type == FileType.File and not i.base_name.startswith(("_", "."))]
        return {"files": json.dumps({i.path: line_end(fs, i.path, i.size) for i in sorted(shown, key=lambda i: i.path)})}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        before, out = json.loads(start["files"]), []
        for path, high in json.loads(end["files"]).items():
            low = before.get(path, 0)
            low = 0 if low > high else low  # the file was replaced by a shorter one
            out += [Piece(path, at, min(high, at + self.block)) for at in range(low, high, self.block)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        fs, _ = FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.path) as file:
            at = max(0, partition.low - 1)
            file.seek(at)
            values, offsets, size = [], [], 0
            for k, line in enumerate(lines(file)):
                if partition.low and not k:  # ends what starts in the block before
                    at += len(line)
                    continue
                if at >= partition.high:
                    break
                values.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                offsets.append(at)
                at, size = at + len(line), size + len(line)
                if size > 4 << 20:
                    yield batch(values, offsets, partition.path)
                    values, offsets, size = [], [], 0
            yield batch(values, offsets, partition.path)


def lines(file, step: int = 1 << 20) -> Iterator[bytes]:
    """The lines from here on that have ended, with their line ends."""
    rest = b""
    while got := file.read(step):
        *whole, rest = (rest + got).split(b"\n")
        yield from (line + b"\n" for line in whole)


def line_end(fs: FileSystem, path: str, size: int, step: int = 1 << 16) -> int:
    """The byte after the last line end among the first `size` bytes."""
    with fs.open_input_file(path) as file:
        while size > 0:
            low = max(0, size - step)
            file.seek(low)
            k = file.read(size - low).rfind(b"\n")
            if k >= 0:
                return low + k + 1
            size = low
    return 0


def batch(values: list[str], offsets: list[int], path: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array([path] * len(values), pa.string()), pa.array(offsets, pa.int64())], ["value", "path", "offset"])

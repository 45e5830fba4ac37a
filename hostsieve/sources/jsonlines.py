"""JSON lines in a folder, as a sink with commits, for batches and streams.

    spark.dataSource.register(JsonLines)
    alerts.write.format("json_lines").mode("append").option("path", "/out/alerts").option("trigger", "17").save()

A task writes a file of its own below _staging and the write's own folder there, a group of rows at a time. The driver moves the files of successful tasks to
names made of the trigger and the partition. What an earlier, unfinished commit of the same trigger left is removed first,
so a task or a trigger that runs again leaves each row once. A reader that skips names with an underscore sees no staged
file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage


class JsonLines(DataSource):
    """Options: path, rows (a group of rows that is written at once, 50 unless told), trigger (the number of a batch write
    that may run again; without it each write stands for itself)."""

    @classmethod
    def name(cls) -> str:
        return "json_lines"

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> StreamLinesWriter:
        return StreamLinesWriter(dict(self.options))


@dataclass
class Staged(WriterCommitMessage):
    name: str
    partition: int
    rows: int


class Lines:
    """What both writers do; `trigger` names a commit."""

    def __init__(self, options: dict[str, str]):
        self.path, self.group, self.trigger = options["path"], int(options.get("rows", 50)), options.get("trigger")
        self.job = uuid.uuid4().hex  # of this write, or of this run of a stream

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, base = FileSystem.from_uri(self.path)
        fs.create_dir(f"{base}/_staging/{self.job}", recursive=True)
        staged = Staged(f"{base}/_staging/{self.job}/{uuid.uuid4().hex}.json", TaskContext.get().partitionId(), 0)
        group: list[str] = []
        with fs.open_output_stream(staged.name) as out:
            for row in iterator:
                group.append(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False) + "\n")
                staged.rows += 1
                if len(group) == self.group:
                    out.write("".join(group).encode())
                    group = []
            out.write("".join(group).encode())
        return staged

    def move(self, messages: list[WriterCommitMessage | None], trigger: str) -> None:
        fs, base = FileSystem.from_uri(self.path)
        prefix = f"part-{trigger}-"
        for old in fs.get_file_info(FileSelector(base, allow_not_found=True)):
            if old.type == FileType.File and old.base_name.startswith(prefix):
                fs.delete_file(old.path)
        for m in messages:
            if m is not None and m.rows:
                fs.move(m.name, f"{base}/{prefix}{m.partition:05d}.json")
        self.drop()

    def drop(self) -> None:
        """Removes what this write has staged, also by tasks that failed and told nothing."""
        fs, base = FileSystem.from_uri(self.path)
        if fs.get_file_info(f"{base}/_staging/{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{base}/_staging/{self.job}")


class LinesWriter(Lines, DataSourceWriter):
    def commit(self, messages) -> None:
        self.move(messages, f"{int(self.trigger):010d}" if self.trigger else uuid.uuid4().hex)

    def abort(self, messages) -> None:
        self.drop()


class StreamLinesWriter(Lines, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:
        self.move(messages, f"{batchId:010d}")

    def abort(self, messages, batchId: int) -> None:
        self.drop()

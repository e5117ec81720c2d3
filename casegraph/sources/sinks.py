"""Texts written by tasks and published by a commit: event batches in a folder, and documents as one file.

A Spark data source (``LineSink``). Tasks write the texts of their rows, as they are, to files that no reader
sees; what is published is decided by the messages of the tasks that Spark has committed, so files of failed, repeated or
speculative attempts never count.

* as ``batches`` a commit renames one folder into the path: all texts of a batch appear together or not at all. A
  stream's batch has its number as name, so one that is committed again after a restart appears once.
* as ``document`` the commit joins the tasks' files in the order of their partitions into one file, a block at a
  time, and renames it: the order is the DataFrame's, sorted by range.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from casegraph.sources.files import file_system

BATCHES, DOCUMENT = "batches", "document"
_BLOCK = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """A task's file and its place in the order."""

    partition: int
    file: str


class _Pending:
    """Files that are written but not published, in a folder that readers pass over.

    The driver makes the folder and drops it; tasks don't, so one that is still at work when a write is given up can't bring it back.
    """

    def __init__(self, folder: str, name: str):
        self.folder = folder.rstrip("/")
        self.pending = f"{self.folder}/_pending-{name}"
        system, place = file_system(self.pending)
        system.create_dir(place, recursive=True)

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        system, place = file_system(self.pending)
        file = uuid.uuid4().hex
        with system.open_output_stream(f"{place}/{file}") as out:
            for batch in iterator:
                for text in batch.column("text").to_pylist():
                    out.write((text or "").encode())
        return Written(TaskContext.get().partitionId(), file)

    def files(self, messages: list[Written | None]) -> list[str]:
        return [m.file for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition)]

    def publish_folder(self, messages: list[Written | None], name: str) -> None:
        system, place = file_system(self.pending)
        target = f"{file_system(self.folder)[1]}/{name}"
        kept = self.files(messages)
        if kept and system.get_file_info(target).type.name == "NotFound":
            system.create_dir(f"{place}/{name}", recursive=True)
            for k, file in enumerate(kept):
                system.move(f"{place}/{file}", f"{place}/{name}/part-{k:05}.json")
            system.move(f"{place}/{name}", target)
        else:
            self.forget(messages)

    def publish_document(self, messages: list[Written | None], name: str) -> None:
        system, place = file_system(self.pending)
        with system.open_output_stream(f"{place}/whole") as out:
            for file in self.files(messages):
                with system.open_input_stream(f"{place}/{file}") as part:
                    while block := part.read(_BLOCK):
                        out.write(block)
        system.move(f"{place}/whole", f"{file_system(self.folder)[1]}/{name}")

    def forget(self, messages: list[Written | None]) -> None:
        system, place = file_system(self.pending)
        for file in self.files(messages):
            system.delete_file(f"{place}/{file}")

    def drop(self) -> None:
        system, place = file_system(self.pending)
        if system.get_file_info(place).type.name != "NotFound":
            system.delete_dir(place)


class LineWriter(DataSourceArrowWriter):
    def __init__(self, path: str, shape: str):
        self.shape = shape
        folder, self.name = path.rsplit("/", 1) if shape == DOCUMENT else (path, f"b{uuid.uuid4().hex}")
        self.pending = _Pending(folder, uuid.uuid4().hex)

    def write(self, iterator: Iterator) -> Written:
        return self.pending.write(iterator)

    def commit(self, messages: list) -> None:
        (self.pending.publish_document if self.shape == DOCUMENT else self.pending.publish_folder)(messages, self.name)
        self.pending.drop()

    def abort(self, messages: list) -> None:
        self.pending.drop()


class LineStreamWriter(DataSourceStreamArrowWriter):
    """Tasks and commits of a stream have writers of their own, so they meet in one folder; each commit takes the files it was told of."""

    def __init__(self, path: str):
        self.pending = _Pending(path, "stream")

    def write(self, iterator: Iterator) -> Written:
        return self.pending.write(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        self.pending.publish_folder(messages, f"b{batchId:09}")

    def abort(self, messages: list, batchId: int) -> None:
        self.pending.forget(messages)


class LineSink(DataSource):
    """``df.write.format("casegraph_lines")`` with a column ``text``; options: path, shape (``batches`` or ``document``)."""

    @classmethod
    def name(cls) -> str:
        return "casegraph_lines"

    def schema(self) -> str:
        return "text string"

    def writer(self, schema: StructType, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"], self.options.get("shape", BATCHES))

    def streamWriter(self, schema: StructType, overwrite: bool) -> LineStreamWriter:
        return LineStreamWriter(self.options["path"])


def _known(spark: SparkSession) -> None:
    spark.dataSource.register(LineSink)


def json_lines(rows: DataFrame) -> DataFrame:
    """``rows`` as text, one JSON object a line."""
    return rows.select(F.concat(F.to_json(F.struct(*rows.columns)), F.lit("\n")).alias("text"))


def append_batch(rows: DataFrame, folder: str) -> None:
    """All of ``rows`` as JSON lines into ``folder``, or none of them; a task leaves one file."""
    _known(rows.sparkSession)
    json_lines(rows).write.format("casegraph_lines").mode("append").option("shape", BATCHES).save(folder)


def append_stream(rows: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """The stream ``rows`` as JSON lines into ``folder``, each batch once."""
    _known(rows.sparkSession)
    return json_lines(rows).writeStream.format("casegraph_lines").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")


def write_document(pieces: DataFrame, path: str, *order: str) -> None:
    """``pieces`` (text, ...) joined in the order of the columns ``order`` into one file; it appears when it is whole."""
    _known(pieces.sparkSession)
    ordered = pieces.repartitionByRange(*order).sortWithinPartitions(*order).select("text")
    ordered.write.format("casegraph_lines").mode("append").option("shape", DOCUMENT).save(path)

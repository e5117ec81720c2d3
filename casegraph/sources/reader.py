"""Repositories as a Spark data source: ``spark.read.format("casegraph_repository").load(root)``.

Rows are (rel_path, content) of the files that the size and folder rules keep, as ``read_contents`` gives them. Planning
walks down from the root until there are enough folders to share out, or ``PLANNED_FOLDERS`` have been listed; tasks
list what is below their folders and read files one by one. Conditions on ``rel_path`` (equal to, one of, starting or
ending with a text) reach the reader: folders that cannot hold such a path are not listed, and no byte of another file is read.

``read_contents`` deals folders anew as they are met, and suits a whole scan; this source suits parts of a repository.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from casegraph import schemas as S
from casegraph.sources.files import IGNORED_PARTS, file_system

#: Folders that planning lists at most, and parts that it makes at most.
PLANNED_FOLDERS, PARTS = 300, 64
#: Bytes of one batch, about.
BATCH_BYTES = 8 << 20


@dataclass
class Share(InputPartition):
    """Folders to be walked, and files, by path relative to the root."""

    folders: list[str]
    files: list[str]


class RepositoryReader(DataSourceReader):
    def __init__(self, root: str, parts: int):
        self.root, self.parts = root.rstrip("/"), parts
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith) and f.attribute == ("rel_path",):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        for f in self.filters:
            fits = (
                path == f.value if isinstance(f, EqualTo) else path in f.value if isinstance(f, In)
                else path.startswith(f.value) if isinstance(f, StringStartsWith) else path.endswith(f.value)
            )
            if not fits:
                return False
        return True

    def _may_hold(self, folder: str) -> bool:
        """Whether a file below ``folder`` can pass the filters."""
        below = folder + "/"
        for f in self.filters:
            if isinstance(f, EqualTo | In):
                values = [f.value] if isinstance(f, EqualTo) else f.value
                if not any(isinstance(v, str) and v.startswith(below) for v in values):
                    return False
            elif isinstance(f, StringStartsWith) and not (f.value.startswith(below) or below.startswith(f.value)):
                return False
        return True

    def _list(self, folder: str) -> tuple[list[str], list[str]]:
        """Folders to enter and files to read in one folder."""
        from pyarrow import fs

        system, place = file_system(f"{self.root}/{folder}" if folder else self.root)
        folders, files = [], []
        for found in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            path = f"{folder}/{found.base_name}" if folder else found.base_name
            if found.type == fs.FileType.Directory:
                if found.base_name not in IGNORED_PARTS and self._may_hold(path):
                    folders.append(path)
            elif found.type == fs.FileType.File and found.base_name not in IGNORED_PARTS and (found.size or 0) <= S.MAX_FILE_BYTES and self._wanted(path):
                files.append(path)
        return folders, files

    def partitions(self) -> list[Share]:
        waiting, files, listed = deque([""]), [], 0
        while waiting and listed < PLANNED_FOLDERS and len(waiting) < 4 * self.parts:
            folders, own = self._list(waiting.popleft())
            waiting.extend(folders)
            files.extend(own)
            listed += 1
        shares = [Share(list(waiting)[k :: self.parts], files[k :: self.parts]) for k in range(self.parts)]
        return [s for s in shares if s.folders or s.files] or [Share([], [])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        contents: list[bytes] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["rel_path", "content"])
            names.clear()
            contents.clear()
            return out

        waiting, files = deque(partition.folders), list(partition.files)
        while files or waiting:
            if not files:
                folders, files = self._list(waiting.popleft())
                waiting.extendleft(reversed(folders))
                continue
            path = files.pop(0)
            system, place = file_system(f"{self.root}/{path}")
            with system.open_input_stream(place) as stream:
                names.append(path)
                contents.append(stream.read())
            if sum(map(len, contents)) > BATCH_BYTES or len(names) >= 1000:
                yield batch()
        if names:
            yield batch()


class RepositorySource(DataSource):
    """Options: path (the root), parts."""

    @classmethod
    def name(cls) -> str:
        return "casegraph_repository"

    def schema(self) -> str:
        return "rel_path string, content binary"

    def reader(self, schema: StructType) -> RepositoryReader:
        return RepositoryReader(self.options["path"], int(self.options.get("parts", PARTS)))


def open_repository(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, content) of a repository; the session is set to hand conditions to the reader."""
    spark.dataSource.register(RepositorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("casegraph_repository").load(root)

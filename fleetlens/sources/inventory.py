"""File inventories as a data source of Spark: a partition for each folder, empty files included."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "folder string, path string, size bigint, mtime timestamp"
ROWS = 10_000  # files of a batch


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if ":" in path.split("/", 1)[0]:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Folder(InputPartition):
    """A folder to list, with all below it or only its own files."""

    def __init__(self, name: str, path: str, deep: bool) -> None:
        self.name, self.path, self.deep = name, path, deep


class InventoryReader(DataSourceReader):
    """Lists one folder for each task; which folders and what endings is settled beforehand."""

    def __init__(self, path: str, folders: set[str] | None, ending: str) -> None:
        self.path, self.folders, self.ending = path.rstrip("/"), folders, ending

    def partitions(self) -> list[Folder]:
        store, base = opened(self.path)
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        inner = [Folder(x.base_name, x.path, True) for x in found if x.type == fs.FileType.Directory]
        every = [Folder("", base, False), *sorted(inner, key=lambda f: f.name)]
        return [f for f in every if self.folders is None or f.name in self.folders]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        names, kinds = ["folder", "path", "size", "mtime"], [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC")]
        rows: list[tuple] = []
        for item in store.get_file_info(fs.FileSelector(partition.path, allow_not_found=True, recursive=partition.deep)):
            if item.type == fs.FileType.File and item.path.endswith(self.ending):
                rows.append((partition.name, item.path, item.size, item.mtime_ns // 1000 if item.mtime_ns else None))
            if len(rows) == ROWS:
                yield _batch(rows, names, kinds)
                rows = []
        if rows:
            yield _batch(rows, names, kinds)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


class InventorySource(DataSource):
    """``spark.read.format("fleet-inventory").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "fleet-inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> InventoryReader:
        folders = self.options.get("folders")
        return InventoryReader(self.options["path"], None if folders is None else set(json.loads(folders)), self.options.get("ending", ""))


def listed_files(spark: SparkSession, path: str, folders: Sequence[str] | None = None, ending: str = "") -> DataFrame:
    """``(folder, path, size, mtime)`` of every file below ``path``, empty marker files too.

    ``folder`` is the one directly below ``path`` that a file is in, a unit's name, say, and
    empty for files in ``path`` itself. Each folder is listed by a task of its own.
    ``folders`` leaves the others out, and only files with that ``ending`` are sent. A
    path that isn't there has no files.

    These are arguments and no filters that Spark pushes: what is pushed to a data source
    in Python stays with the frame, so two filters of one frame would give one answer.
    """
    spark.dataSource.register(InventorySource)
    some = {} if folders is None else {"folders": json.dumps(list(folders))}
    files = spark.read.format("fleet-inventory").options(ending=ending, **some).load(path)
    return files.withColumn("mtime", files["mtime"].cast("timestamp_ntz"))

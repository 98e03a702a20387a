"""Gauge lines of a stream as files, each trigger's once: staged by tasks, put in place when all are done."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from fleetlens.fixed import GAUGE_PREFIX
from fleetlens.operators.metrics import gauge_lines
from fleetlens.sources.inventory import opened

STAGED, DONE = "_staged", "_done"


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written; nothing if it had no lines."""

    path: str | None


class GaugeWriter(DataSourceStreamWriter):
    """Tasks write below ``_staged``, which no reader looks at. When a trigger's tasks are all
    done its files move to a folder of the trigger's number, and a mark is put there last. A
    trigger that comes again finds the mark and drops what was staged; one that was
    stopped between the moves and the mark is put in place anew."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, base = opened(self.path)
        sink, path = None, f"{base}/{STAGED}/{uuid.uuid4().hex}"
        for row in iterator:
            if sink is None:
                store.create_dir(f"{base}/{STAGED}", recursive=True)
                sink = store.open_output_stream(path)
            sink.write(row[0].encode() + b"\n")
        if sink is None:
            return Staged(None)
        sink.close()
        return Staged(path)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        store, base = opened(self.path)
        place = f"{base}/trigger={batchId}"
        staged = [m.path for m in messages if m is not None and m.path]
        if store.get_file_info(f"{place}/{DONE}").type == fs.FileType.File:
            self._drop(store, staged)
            return
        store.create_dir(place, recursive=True)
        store.delete_dir_contents(place)
        for i, path in enumerate(staged):
            store.move(path, f"{place}/part-{i:05d}.txt")
        store.open_output_stream(f"{place}/{DONE}").close()

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        store, _ = opened(self.path)
        self._drop(store, [m.path for m in messages if m is not None and m.path])

    @staticmethod
    def _drop(store: fs.FileSystem, paths: list[str]) -> None:
        for path in paths:
            if store.get_file_info(path).type == fs.FileType.File:
                store.delete_file(path)


class GaugeSink(DataSource):
    """``df.writeStream.format("fleet-gauges")`` for rows of one text column."""

    @classmethod
    def name(cls) -> str:
        return "fleet-gauges"

    def streamWriter(self, schema: object, overwrite: bool) -> GaugeWriter:
        return GaugeWriter(self.options["path"])


def write_gauge_triggers(
    gauges: DataFrame, path: str, checkpoint: str, prefix: str = GAUGE_PREFIX, unit_col: str | None = None, **trigger: str | bool
) -> StreamingQuery:
    """Start writing a stream's gauge lines to ``path``, a folder for each trigger with a line once.

    ``trigger`` is that of ``writeStream``. Files are complete as soon as they can be seen.
    """
    gauges.sparkSession.dataSource.register(GaugeSink)
    writer = gauge_lines(gauges, prefix, unit_col).writeStream.format("fleet-gauges")
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.option("path", path).option("checkpointLocation", checkpoint).start()

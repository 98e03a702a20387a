"""Statistics views of live servers as a data source of Spark: a connection for each partition."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from fleetlens.specs import StatSpec

ROWS = 1000  # rows fetched at once
OWN = ("unit", "datname")  # columns that say where a row is from


class Target(InputPartition):
    """A database of a unit, and what to connect to it with."""

    def __init__(self, unit: str, datname: str | None, connect: dict) -> None:
        self.unit, self.datname, self.connect = unit, datname, connect


class ServerReader(DataSourceReader):
    def __init__(self, schema: StructType, module: str, relation: str, targets: list[dict], marker: str) -> None:
        self.schema, self.module, self.relation, self.marker = schema, module, relation, marker
        self.targets = [Target(t["unit"], t.get("datname"), t["connect"]) for t in targets]

    def partitions(self) -> list[Target]:
        return self.targets

    def read(self, partition: Target) -> Iterator[tuple]:
        if not isinstance(partition, Target):  # no target is left
            return
        names = [f.name for f in self.schema if f.name not in OWN]
        query, values = self._query(names, partition)
        connection = import_module(self.module).connect(**partition.connect)
        try:
            cursor = connection.cursor()
            cursor.execute(query, values)
            while rows := cursor.fetchmany(ROWS):
                for row in rows:
                    found = dict(zip(names, row, strict=True)) | {"unit": partition.unit, "datname": partition.datname}
                    yield tuple(found[f.name] for f in self.schema)
        finally:
            connection.close()

    def _query(self, names: Sequence[str], target: Target) -> tuple[str, tuple]:
        columns = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
        where = f" WHERE datname = {self.marker}" if self.marker else ""
        return f"SELECT {columns} FROM {self.relation}{where}", (target.datname,) if self.marker else ()


class ServerSource(DataSource):
    """Options: ``module`` (a driver that follows the DB-API), ``relation``, ``targets`` (JSON list of
    ``unit``, ``datname`` and ``connect``, the driver's arguments), and ``marker``, the driver's
    mark for a value, if the relation is to be cut to the target's database."""

    @classmethod
    def name(cls) -> str:
        return "fleet-servers"

    def reader(self, schema: StructType) -> ServerReader:
        o = self.options
        return ServerReader(schema, o["module"], o["relation"], json.loads(o["targets"]), o.get("marker", ""))


def live_snapshot(
    spark: SparkSession, spec: StatSpec, columns: str, targets: Sequence[dict], module: str = "psycopg2", marker: str = "%s",
    datname: str | None = None,
) -> DataFrame:
    """``(unit, datname, *columns)``: the spec's view as every target has it now.

    ``columns`` is a schema text of what to read of the view. Each target is a partition
    that opens one connection, in the task, and reads as it goes. With ``datname`` no
    connection is made to other databases. A spec's ``source``, a view of all databases, is
    cut to the target's own by the server.
    """
    spark.dataSource.register(ServerSource)
    targets = [t for t in targets if datname is None or t.get("datname") == datname]
    reader = spark.read.format("fleet-servers").schema(f"unit string, datname string, {columns}")
    cut = {"marker": marker} if spec.source else {}
    return reader.options(module=module, relation=spec.relation, targets=json.dumps(list(targets)), **cut).load()

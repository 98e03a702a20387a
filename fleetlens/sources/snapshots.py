"""Statistics snapshots, from files or straight from a server."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.specs import StatSpec


def snapshot(
    spark: SparkSession, folder: str, spec: StatSpec, datname: str | None = None
) -> DataFrame:
    """The snapshot ``<folder>/<relation>.parquet``, of one database if named.

    The filter on ``datname`` reaches the parquet scan.
    """
    df = spark.read.parquet(f"{folder.rstrip('/')}/{spec.relation}.parquet")
    return df if datname is None else df.where(F.col("datname") == datname)


def jdbc_options(
    url: str, spec: StatSpec, datname: str | None = None, fetch_size: int = 10_000
) -> dict[str, str]:
    """Reader options for one server. The database filter runs on the server."""
    options = {"url": url, "fetchsize": str(fetch_size)}
    if spec.table or datname is None:
        return {**options, "dbtable": spec.relation}
    quoted = datname.replace("'", "''")
    return {**options, "query": f"SELECT * FROM {spec.relation} WHERE datname = '{quoted}'"}


def snapshot_jdbc(
    spark: SparkSession, url: str, spec: StatSpec, unit: str, datname: str | None = None
) -> DataFrame:
    """One server's snapshot with its unit name; needs a JDBC driver on the class path."""
    df = spark.read.format("jdbc").options(**jdbc_options(url, spec, datname)).load()
    return df.withColumn("unit", F.lit(unit))

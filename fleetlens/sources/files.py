"""File inventories, backup listings, settings texts, catalogues and relation documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.fixed import INTERNAL_CONTEXT

INVENTORY_SCHEMA = "unit string, path string, size bigint, mtime_s double"

CATALOGUE_RECORD = (
    "name string, unit string, category string, short_desc string, extra_desc string, "
    "context string, vartype string, min_val string, max_val string, "
    "enumvals array<string>, boot_val string"
)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated listing ``unit, path, size, mtime in seconds``.

    Listings carry zero-byte marker files, which Spark's own file sources skip.
    """
    raw = spark.read.csv(path, sep="\t", schema=INVENTORY_SCHEMA)
    return raw.select(
        "unit",
        "path",
        "size",
        F.timestamp_micros((F.col("mtime_s") * 1_000_000).cast("bigint"))
        .cast("timestamp_ntz")
        .alias("mtime"),
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Sizes and times of the non-empty files below ``path``, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path",
        F.col("length").alias("size"),
        F.col("modificationTime").cast("timestamp_ntz").alias("mtime"),
    )


def read_backup_list(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated listing with a header; every column is text."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(path, text)`` per settings or rules file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def _usable(records: DataFrame) -> DataFrame:
    return records.where(F.col("context") != INTERNAL_CONTEXT).withColumn("name", F.lower("name"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Settings catalogue written one record per line; internal settings are left out."""
    return _usable(spark.read.schema(CATALOGUE_RECORD).json(path))


def read_catalogue_document(spark: SparkSession, path: str) -> DataFrame:
    """Settings catalogue kept as one JSON object ``name -> record`` per file."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(
        F.explode(F.from_json("value", f"map<string,struct<{_struct(CATALOGUE_RECORD)}>>")).alias("key", "rec")
    )
    return _usable(entries.select("rec.*"))


def _struct(ddl: str) -> str:
    return ",".join(":".join(field.split(" ", 1)) for field in ddl.split(", "))


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """Relation documents, one JSON object per line, as ``relations`` text."""
    return spark.read.text(path).withColumnRenamed("value", "relations")

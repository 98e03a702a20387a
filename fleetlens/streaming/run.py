"""Running a stream over what is there now."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.session import DEFAULTS, work_folder


def read_folder(
    spark: SparkSession,
    path: str,
    max_files: int | None = None,
    max_bytes: str | None = None,
) -> DataFrame:
    """A parquet file or folder as a stream; the limits bound one trigger's input."""
    # Written as a pattern, since a plain stream path must be a folder.
    pattern = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(pattern)


def drain(
    stream: DataFrame,
    purpose: str,
    each: Callable[[DataFrame, int], None] | None = None,
    partition_by: str | None = None,
    base: str | None = None,
) -> str:
    """Process everything available, append it to a folder and return that folder.

    With ``each`` the function writes the batches itself. ``base`` is where output and
    checkpoint are; a run that is given the same one again goes on where the last ended.
    """
    spark = stream.sparkSession
    base = base or work_folder(spark, purpose)
    writer = (
        stream.writeStream.trigger(availableNow=True)
        .outputMode("append")
        .option("checkpointLocation", f"{base}/checkpoint")
    )
    # Keyed state needs a store that can hold more than one column family per key; joins then need one per partition.
    stores = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.join.stateFormatVersion")
    before = {name: spark.conf.get(name) for name in stores}
    for name in stores:
        spark.conf.set(name, DEFAULTS[name])
    try:
        if each is not None:
            query = writer.foreachBatch(each).start()
        else:
            if partition_by:
                writer = writer.partitionBy(partition_by)
            query = writer.format("parquet").option("path", f"{base}/out").start()
    finally:
        for name in stores:
            spark.conf.set(name, before[name])
    query.awaitTermination()
    return f"{base}/out"

"""Writing gauge lines, dotted pairs, exports, catalogues and routed logs.

Every function here runs a job.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.fixed import GAUGE_PREFIX
from fleetlens.operators.metrics import gauge_lines
from fleetlens.sources.files import list_files

# Compression tool -> (writer codec, file ending).
CODECS = {
    "gzip": ("gzip", ".gz"),
    "pigz": ("gzip", ".gz"),
    "bzip2": ("bzip2", ".bz2"),
    "none": ("none", ""),
}
_LEVEL_NAMES = {1: "BEST_SPEED", 2: "TWO", 3: "THREE", 4: "FOUR", 5: "FIVE", 6: "SIX", 7: "SEVEN", 8: "EIGHT", 9: "BEST_COMPRESSION"}


def write_gauges(
    gauges: DataFrame, path: str, prefix: str = GAUGE_PREFIX, unit_col: str | None = None
) -> None:
    """Gauge lines as text files."""
    gauge_lines(gauges, prefix, unit_col).write.text(path)


def write_catalogue(catalogue: DataFrame, path: str) -> None:
    """Settings catalogue, one JSON record per line, names in lower case."""
    catalogue.withColumn("name", F.lower("name")).write.json(path)


def write_rules(lines: DataFrame, path: str) -> None:
    """Lines ``(cluster, line_no, line)`` as a folder of text files for each cluster.

    Files of a cluster, in the order of their names, are its lines in order; there is one
    unless the cluster has more lines than a partition.
    """
    dealt = lines.repartitionByRange("cluster", "line_no").sortWithinPartitions("cluster", "line_no")
    dealt.select("cluster", "line").write.partitionBy("cluster").text(path)


def write_backup_list(backups: DataFrame, path: str) -> None:
    """Backup listing with tabs and a header."""
    backups.write.csv(path, sep="\t", header=True)


def write_routed(lines: DataFrame, path: str) -> None:
    """Routed log lines as text, one folder per destination.

    The rebalance keeps files large while splitting a destination that gets most
    of the lines over several tasks.
    """
    lines.select("destination", "line").hint("rebalance", "destination").write.partitionBy(
        "destination"
    ).text(path)


def _is_complete(spark: SparkSession, folder: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def export(
    df: DataFrame,
    folder: str,
    by: str,
    stamp: str,
    tool: str = "gzip",
    level: int | None = None,
) -> DataFrame:
    """Write ``df`` compressed to ``<folder>/<stamp>``, one sub-folder per ``by`` value.

    An export that exists already is left alone. Returns ``(by, files, bytes, mb, status)``
    from the files found there. The status is ``written``, ``skipped`` if a whole export was
    there before, or ``incomplete`` if what was there has no mark of success.
    """
    if tool not in CODECS:
        raise ValueError(f"The compression tool must be one of {', '.join(CODECS)}")
    if level is not None and not 1 <= level <= 9:
        raise ValueError(f"The compression level must be between 1 and 9: {level}")
    codec, _ = CODECS[tool]
    target = f"{folder.rstrip('/')}/{stamp}"
    writer = df.hint("rebalance", by).write.partitionBy(by).mode("errorifexists")
    if level is not None and codec == "gzip":
        writer = writer.option("zlib.compress.level", _LEVEL_NAMES[level])
    status = "written"
    try:
        writer.csv(target, header=True, compression=codec)
    except AnalysisException as error:
        if error.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        status = "skipped" if _is_complete(df.sparkSession, target) else "incomplete"
    name = F.url_decode(F.regexp_extract("path", rf"/{by}=([^/]*)/", 1))
    return (
        list_files(df.sparkSession, target)
        .groupBy(name.alias(by))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
        .withColumn("mb", F.round(F.col("bytes") / 1048576, 2))
        .withColumn("status", F.lit(status))
    )

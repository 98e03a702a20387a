"""How old the oldest unshipped archive file or the last backup is."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.fixed import ARCHIVE_CRIT, ARCHIVE_ROOT, ARCHIVE_WARN, BACKUP_CRIT, BACKUP_WARN
from fleetlens.functions.numbers import age_seconds, nice_age

LEVELS = ("OK", "WARNING", "CRITICAL")


def ready_files(inventory: DataFrame, root: str = ARCHIVE_ROOT) -> DataFrame:
    """Files that still wait to be archived, below ``<root>/<version>/<cluster>``."""
    name = r"[^/.][^/]*"
    pattern = rf"^{re.escape(root)}/{name}/{name}/pg_(xlog|wal)/archive_status/{name}\.ready$"
    return inventory.where(F.col("path").rlike(pattern))


def max_age(units: DataFrame, files: DataFrame, as_of: Column) -> DataFrame:
    """Age in whole seconds of each unit's oldest file: 0 without files, never negative."""
    oldest = files.groupBy("unit").agg(F.min("mtime").alias("_oldest"))
    age = F.greatest(age_seconds(F.col("_oldest"), as_of), F.lit(0))
    return units.join(oldest, "unit", "left").select(
        *units.columns, F.coalesce(age, F.lit(0)).alias("age_s")
    )


def status_code(value: Column, warn: int, crit: int) -> Column:
    """2 above ``crit``, 1 above ``warn``, else 0. Two zero limits switch the check off."""
    if not warn and not crit:
        return F.lit(0)
    return F.when(value > crit, 2).when(value > warn, 1).otherwise(0)


def classify(
    df: DataFrame, value: str = "age_s", warn: int = ARCHIVE_WARN, crit: int = ARCHIVE_CRIT
) -> DataFrame:
    """Add ``status``, ``level`` and ``message`` for an archive age."""
    status = status_code(F.col(value), warn, crit)
    level = F.element_at(F.array(*[F.lit(n) for n in LEVELS]), status + 1)
    late = F.concat(
        level, F.lit(": Last successful WAL archive was "), nice_age(F.col(value)), F.lit(" ago")
    )
    return df.select(
        "*",
        status.alias("status"),
        level.alias("level"),
        F.when(status == 0, F.lit("OK: No stale WAL archival found"))
        .otherwise(late)
        .alias("message"),
    )


def heartbeat(
    df: DataFrame, as_of: Column, warn: int = BACKUP_WARN, crit: int = BACKUP_CRIT
) -> DataFrame:
    """Backup age check per unit row ``(unit, is_master, last_success)``.

    Only a master takes backups, so every other unit is OK. A master that never
    succeeded is CRITICAL.
    """
    age = age_seconds(F.col("last_success"), as_of)
    status = (
        F.when(~F.col("is_master"), 0)
        .when(F.col("last_success").isNull(), 2)
        .otherwise(status_code(age, warn, crit))
    )
    return df.select(
        "*",
        age.alias("age_s"),
        status.alias("status"),
        F.element_at(F.array(*[F.lit(n) for n in LEVELS]), status + 1).alias("level"),
    )

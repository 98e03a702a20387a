"""Dump inventories: naming, sizes, retention, listings and restore points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.fixed import KEEP_BASE_BACKUPS, KEEP_DUMPS, LATEST, STAMP_FORMAT
from fleetlens.functions.capture import fits, group, with_groups
from fleetlens.functions.numbers import age_seconds, whole_div
from fleetlens.functions.ordered import ROWS_PER_SLICE, look_back
from fleetlens.functions.skew import spread_join, top_rows

# Globals stamp; or database, its stamp and a compression ending.
_NAME = r"^(?:.*/)?(?:globals\.(\d{8}_\d{6})\.sql|([^/]+)\.(\d{8}_\d{6})\.dump(?:\.(gz|bz2|xz))?)$"
_GLOBALS = r"(?:^|/)globals\.\d{8}_\d{6}\.sql$"


def decode_dumps(files: DataFrame) -> DataFrame:
    """Add ``kind`` (database, globals or null), ``datname``, ``stamp`` and ``codec``."""
    whole, database = fits(4) & (group(1) != ""), fits(4) & (group(2) != "")
    stamp = F.when(whole, group(1)).when(database, group(3))
    return with_groups(files, F.col("path"), _NAME, 4).select(
        *[c for c in files.columns if c != "datname"],
        F.when(whole, F.lit("globals")).when(database, F.lit("database")).alias("kind"),
        F.when(database, group(2)).alias("datname"),
        F.try_to_timestamp(stamp, F.lit(STAMP_FORMAT)).cast("timestamp_ntz").alias("stamp"),
        F.when(database, group(4)).alias("codec"),
    )


def latest_dump(dumps: DataFrame) -> DataFrame:
    """Size of the newest dump per unit and exact database."""
    return (
        dumps.where(F.col("datname").isNotNull())
        .groupBy("unit", "datname")
        .agg(
            F.max_by("size", F.struct("mtime", "path", "size")).alias("size"),
            F.max("mtime").alias("mtime"),
        )
    )


def space_forecast(latest: DataFrame, free: DataFrame) -> DataFrame:
    """KiB the next run needs (1.3 times the last sizes) against ``free_kib`` per unit.

    A unit without dumps passes. Each step truncates to whole numbers.
    """
    total = latest.groupBy("unit").agg(F.sum("size").alias("_total"))
    need = whole_div(whole_div(F.coalesce("_total", F.lit(0)) * 13, 10), 1024)
    return free.join(total, "unit", "left").select(
        "unit",
        "free_kib",
        need.alias("need_kib"),
        (need <= F.col("free_kib")).alias("fits"),
    )


def prune_by_run(files: DataFrame, as_of: Column, keep: int = KEEP_DUMPS) -> DataFrame:
    """Files older than the ``keep``-th newest globals dump of their unit.

    That dump's age is rounded up to whole minutes, as is the reach of the
    pruning. With fewer dumps the oldest one counts; without any nothing goes.
    """
    if keep <= 0:
        raise ValueError("keep must be positive")
    runs = files.where(F.col("path").rlike(_GLOBALS)).select("unit", "path", "mtime")
    minutes = whole_div(age_seconds(F.col("mtime"), as_of), 60) + 1
    limit = (
        top_rows(runs, ["unit"], ["path", "mtime"], keep)
        .groupBy("unit")
        .agg(F.max_by(minutes, "_rn").alias("_minutes"))
    )
    kept = files.where(~F.contains("path", F.lit("lost+found/")))
    return (
        spread_join(kept, limit, ["unit"])
        .where(age_seconds(F.col("mtime"), as_of) > F.col("_minutes") * 60)
        .select(*files.columns)
    )


def prune_keep_n(
    backups: DataFrame,
    keep: int = KEEP_BASE_BACKUPS,
    key: str = "store",
    order: Sequence[str] = ("started", "name"),
) -> DataFrame:
    """Backups beyond the ``keep`` newest of their store. ``order`` must be unique per store.

    Only the ``keep``-th newest row of each store travels as a limit, so a store
    holding most of the rows is never sorted in one task.
    """
    limit = (
        top_rows(backups.select(key, *order), [key], order, keep)
        .where(F.col("_rn") == keep)
        .select(key, F.struct(*order).alias("_limit"))
    )
    return (
        spread_join(backups, limit, [key])
        .where(F.struct(*order) < F.col("_limit"))
        .select(*backups.columns)
    )


def flatten_kv(df: DataFrame, key: str) -> DataFrame:
    """``<key>.<field>`` / value pairs for every column, ``_`` as ``-``, key in lower case."""
    fields = df.columns
    stem = F.lower(F.translate(F.col(key).cast("string"), "_", "-"))
    wide = df.select(
        stem.alias("_stem"), *[F.col(c).cast("string").alias(c.replace("_", "-")) for c in fields]
    )
    return wide.unpivot("_stem", [f"`{c.replace('_', '-')}`" for c in fields], "_field", "value").select(
        F.concat_ws(".", "_stem", "_field").alias("key"), "value"
    )


def _normal(name: Column) -> Column:
    return F.lower(F.translate(name, "_", "-"))


def resolve_backup(
    requests: DataFrame, backups: DataFrame, limit: int = ROWS_PER_SLICE
) -> DataFrame:
    """The backup each restore request ``(request_id, store, backup, target_time)`` uses.

    ``LATEST``, which a null or blank ``backup`` also means, takes the newest backup
    started before the target; a named one must exist and have started before it.
    Names and the newest of each store come from aggregates, in one pass over the
    requests. Those for the latest before a target are merged with the backups into one
    timeline per store and look back along it, so no pairs of the two are ever formed.
    """
    stores = backups.groupBy("store").agg(
        F.lit(True).alias("known_store"), F.max_by("name", F.struct("started", "name")).alias("newest")
    )
    known = (
        backups.withColumn("_name", _normal(F.col("name")))
        .groupBy("store", "_name")
        .agg(F.min_by("name", F.struct("started", "name")).alias("name"), F.min("started").alias("started"))
    )
    asked = requests.withColumn("backup", F.coalesce(F.nullif(F.trim("backup"), F.lit("")), F.lit(LATEST)))
    latest, targeted = F.col("backup") == LATEST, F.col("target_time").isNotNull()

    direct = asked.where(~(latest & targeted)).withColumn("_name", _normal(F.col("backup")))
    early = ~targeted | (F.col("started") < F.col("target_time"))
    answered = spread_join(spread_join(direct, stores, ["store"], "left"), known, ["store", "_name"], "left").select(
        "request_id",
        "store",
        "backup",
        F.when(latest, F.col("newest")).when(early, F.col("name")).alias("resolved"),
        F.when(F.col("known_store").isNull(), F.lit("no backups"))
        .when(latest, F.lit(None).cast("string"))
        .when(F.col("name").isNull(), F.lit("not found"))
        .when(~early, F.lit("not before target"))
        .alias("reason"),
    )

    # At equal times a request comes first, so a backup must be strictly older.
    timeline = asked.where(latest & targeted).select(
        "store",
        F.col("target_time").alias("at"),
        F.lit(0).alias("side"),
        F.lit(None).cast("string").alias("name"),
        "request_id",
        "backup",
    ).unionByName(
        backups.select("store", F.col("started").alias("at"), F.lit(1).alias("side"), "name"),
        allowMissingColumns=True,
    )
    found = look_back(
        timeline, ["store"], "at", ["side", "name"], F.col("name"), "resolved", True, limit
    ).where(F.col("side") == 0)
    looked = spread_join(found, stores.drop("newest"), ["store"], "left").select(
        "request_id",
        "store",
        "backup",
        "resolved",
        F.when(F.col("known_store").isNull(), F.lit("no backups"))
        .when(F.col("resolved").isNull(), F.lit("none before target"))
        .alias("reason"),
    )
    return answered.unionByName(looked)

"""Finding sessions that sit idle inside a transaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.fixed import IDLE_SECONDS, IDLE_STATE, OLD_ACTIVITY_COLUMNS, OLD_IDLE_STATE
from fleetlens.functions.numbers import age_seconds, epoch_micros
from fleetlens.functions.ordered import ROWS_PER_SLICE, look_along, slice_busy_keys


def from_old_activity(df: DataFrame) -> DataFrame:
    """Activity of a server older than 9.2 under today's names and idle state."""
    renamed = df.withColumnsRenamed(OLD_ACTIVITY_COLUMNS)
    return renamed.withColumn(
        "state",
        F.when(F.col("state") == OLD_IDLE_STATE, F.lit(IDLE_STATE)).otherwise(F.col("state")),
    )


def idle_sessions(
    activity: DataFrame,
    as_of: Column,
    max_idle_s: int = IDLE_SECONDS,
    self_pid: int | None = None,
) -> DataFrame:
    """Sessions idle in a transaction for longer than ``max_idle_s``; 0 keeps every session.

    The limit is a constant timestamp, so it reaches the scan as a pushed filter.
    """
    kept = activity if self_pid is None else activity.where(F.col("pid") != self_pid)
    if max_idle_s == 0:
        return kept
    limit = as_of - F.make_dt_interval(secs=F.lit(max_idle_s))
    return kept.where((F.col("state") == IDLE_STATE) & (F.col("state_change") < limit))


def ignore_sessions(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop sessions whose user or application is listed.

    A null application next to an unlisted user drops the row too, as the
    three-valued ``NOT IN`` of the monitored servers does.
    """
    for name in names:
        df = df.where(~F.lit(name).isin(F.col("usename"), F.col("application_name")))
    return df


def with_age(df: DataFrame, as_of: Column) -> DataFrame:
    """Report columns plus ``age_s``, youngest first."""
    return df.select(
        "usename",
        "application_name",
        "datname",
        "pid",
        "backend_start",
        "state_change",
        age_seconds(F.col("state_change"), as_of).alias("age_s"),
    ).orderBy("age_s", "pid")


def idle_runs(
    activity: DataFrame, gap_s: int, keys: Sequence[str] = ("usename",), limit: int = ROWS_PER_SLICE
) -> DataFrame:
    """Runs of activity per key, closed by ``gap_s`` of silence, that ended idle in a transaction.

    Each row looks back for the row before it and then for the start of its run,
    so a key that holds most of the activity is still shared out.
    """
    order = ["state_change", "pid"]
    slim = slice_busy_keys(activity.select(*keys, *order, "state"), keys, "state_change", limit, "pid")
    looked = look_along(
        slim, keys, "state_change", ["pid"], F.col("state_change"), "_before", False
    )
    gap = epoch_micros(F.col("state_change")) - epoch_micros(F.col("_before"))
    opens = F.coalesce(gap >= gap_s * 1_000_000, F.lit(True))
    runs = look_along(
        looked,
        keys,
        "state_change",
        ["pid"],
        F.when(opens, F.col("state_change")),
        "run_start",
        True,
    )
    return (
        runs.groupBy(*keys, "run_start")
        .agg(
            F.max_by("state", F.struct(*order)).alias("_last"),
            F.max("state_change").alias("idle_since"),
            F.count(F.lit(1)).alias("n_events"),
        )
        .where(F.col("_last") == IDLE_STATE)
        .drop("_last")
    )


def last_states(activity: DataFrame, gap_s: int, keys: Sequence[str] = ("usename",)) -> DataFrame:
    """``idle_runs`` for a stream whose watermark is on ``state_change``."""
    runs = activity.groupBy(
        *keys, F.session_window("state_change", f"{gap_s} seconds").alias("_w")
    ).agg(
        F.max_by("state", F.struct("state_change", "pid")).alias("state"),
        F.max("state_change").alias("idle_since"),
        F.count(F.lit(1)).alias("n_events"),
    )
    return runs.where(F.col("state") == IDLE_STATE).select(
        *keys, F.col("_w.start").alias("run_start"), "idle_since", "n_events"
    )

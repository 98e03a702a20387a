"""Gauges from statistics snapshots and session tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from fleetlens.fixed import (
    GAUGE_PREFIX,
    SAMPLE_MINUTES,
    SESSION_STATES,
    SYSTEM_DATABASES,
)
from fleetlens.functions.numbers import at_least
from fleetlens.specs import StatSpec


# A server of the fleet; database names repeat across servers.
SERVER = ("unit",)


def databases(
    df: DataFrame, exclude: Sequence[str] = SYSTEM_DATABASES, keys: Sequence[str] = SERVER
) -> DataFrame:
    """Distinct databases of each server without the excluded names and without null."""
    return df.select(*keys, "datname").where(~F.col("datname").isin(*exclude)).distinct()


def to_gauges(
    df: DataFrame, spec: StatSpec, dbname: str | None = None, ids: Sequence[str] = ()
) -> DataFrame:
    """Wide to long: one ``(metric, value)`` row per remaining column, null as 0.

    Columns outside ``spec`` are cut before the unpivot, so a parquet scan reads
    only what becomes a gauge. ``ids`` columns ride along unchanged. Times, dates and
    whatever else is neither a number, a boolean nor a text are no gauges. The gauge of a
    text that is no number is null.
    """
    named = {*spec.key, *spec.exclude, *ids, *([dbname] if dbname else [])}
    counted = (NumericType, BooleanType, StringType)
    values = [f.name for f in df.schema if f.name not in named and isinstance(f.dataType, counted)]

    def quoted(name: str) -> str:
        return f"`{name.replace('`', '``')}`"
    stem: list[Column] = []
    if dbname:
        stem += [F.lit("databases"), F.col(dbname)]
    if spec.label:
        stem.append(F.lit(spec.label))
    stem += [F.col(k) for k in spec.key]
    wide = df.select(
        *ids,
        F.concat_ws(".", *stem).alias("_stem") if stem else F.lit(None).cast("string").alias("_stem"),
        *[
            F.when(F.col(quoted(c)).isNull(), F.lit(0.0)).otherwise(F.col(quoted(c)).try_cast("double")).alias(c)
            if kind == "string"
            else F.coalesce(F.col(quoted(c)).cast("double"), F.lit(0.0)).alias(c)
            for c, kind in df.dtypes
            if c in values
        ],
    )
    return wide.unpivot([*ids, "_stem"], [quoted(c) for c in values], "_column", "_value").select(
        *ids,
        F.concat_ws(".", "_stem", "_column").alias("metric"),
        F.col("_value").alias("value"),
    )


def _with_zeroes(dbs: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    by = [*keys, "datname"]
    named = [c for c in counts.columns if c not in by]
    return dbs.join(counts, by, "left").select(*by, *[F.coalesce(c, F.lit(0)).alias(c) for c in named])


def session_totals(dbs: DataFrame, activity: DataFrame, keys: Sequence[str] = SERVER) -> DataFrame:
    """Sessions per listed database, zero where there are none."""
    counts = activity.groupBy(*keys, "datname").agg(F.count(F.lit(1)).alias("connections"))
    return _with_zeroes(dbs, counts, keys)


def session_states(dbs: DataFrame, activity: DataFrame, keys: Sequence[str] = SERVER) -> DataFrame:
    """Sessions per listed database and state, in one pass over ``activity``.

    The counts are aggregated before the join, so a database that holds most of
    the sessions costs one partial count per map task.
    """
    counts = activity.groupBy(*keys, "datname").agg(
        F.count_if("waiting").alias("connections_waiting"),
        *[F.count_if(F.col("state") == state).alias(g) for g, state in SESSION_STATES.items()],
    )
    return _with_zeroes(dbs, counts, keys)


def session_counts(dbs: DataFrame, activity: DataFrame, keys: Sequence[str] = SERVER) -> DataFrame:
    """``session_totals`` and ``session_states`` together, still one pass."""
    counts = activity.groupBy(*keys, "datname").agg(
        F.count(F.lit(1)).alias("connections"),
        F.count_if("waiting").alias("connections_waiting"),
        *[F.count_if(F.col("state") == state).alias(g) for g, state in SESSION_STATES.items()],
    )
    return _with_zeroes(dbs, counts, keys)


def gate(df: DataFrame, version_col: str, required: str | None) -> DataFrame:
    """Rows from servers at ``required`` or newer; all rows when nothing is required."""
    if required is None:
        return df
    return df.where(at_least(F.col(version_col), required))


def collect_gauges(
    snapshots: Sequence[tuple[StatSpec, DataFrame]], keys: Sequence[str] = SERVER, version: str = "version"
) -> DataFrame:
    """Gauges ``(keys, metric, value)`` of all snapshots together.

    Each snapshot comes with the server's ``keys`` and its ``version``, which gates the
    specs that need a newer one, and with ``datname`` if it is of a database.
    """
    parts = []
    for spec, df in snapshots:
        gated = gate(df, version, spec.version_required).drop(version)
        parts.append(to_gauges(gated, spec, "datname" if "datname" in df.columns else None, keys))
    return reduce(DataFrame.unionByName, parts)


def gauge_line(
    metric: Column, value: Column, prefix: str = GAUGE_PREFIX, unit: Column | None = None
) -> Column:
    """``<prefix>.<metric>:<value>|g``; whole values carry no fraction."""
    head: Column = F.lit(prefix)
    if unit is not None:
        head = F.replace(head, F.lit("$UNIT"), F.translate(unit, "/.", "--"))
    number = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(
        value.cast("string")
    )
    return F.concat(head, F.lit("."), metric, F.lit(":"), number, F.lit("|g"))


def gauge_lines(
    gauges: DataFrame, prefix: str = GAUGE_PREFIX, unit_col: str | None = None
) -> DataFrame:
    """One ``line`` per gauge; those without a name or a value have none."""
    unit = F.col(unit_col) if unit_col else None
    known = gauges.where(F.col("metric").isNotNull() & F.col("value").isNotNull())
    return known.select(gauge_line(F.col("metric"), F.col("value"), prefix, unit).alias("line")).where("line is not null")


def sample(
    gauges: DataFrame,
    every: str = f"{SAMPLE_MINUTES} minutes",
    keys: Sequence[str] = ("metric",),
    ts: str = "sampled_at",
    tie: str = "sample_id",
) -> DataFrame:
    """Last value per key and interval. Works on a batch and on a watermarked stream."""
    return (
        gauges.groupBy(*keys, F.window(ts, every).alias("_w"))
        .agg(F.max_by("value", F.struct(ts, tie)).alias("value"))
        .select(*keys, F.col("_w.start").alias("bucket"), "value")
    )

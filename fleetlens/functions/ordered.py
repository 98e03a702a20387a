"""Looking back along an ordered history without putting a busy key in one task.

A ``lag`` or ``last`` window partitioned by key sends each key's whole history to
one task. That is right for the many small keys and wrong for a key that holds a
large share of all rows. So one slim job counts rows per key first. When no key is
above a limit the plain window is used and nothing else. Otherwise the history of
the keys above it is cut into slices of about equal row counts, the window runs
per key and slice, and the closing value of each slice is handed to the slices
after it. The answer equals the plain window's.

Keys above the limit number at most ``rows / limit``, and so, up to a small
factor, do their cut points and slices; whether these small tables are broadcast is
left to Spark's check of their size. Cut points are approximate quantiles, which may come out differently when
computed again, so they are written to the shared folder once and read from there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from fleetlens.functions.numbers import epoch_micros, whole_div
from fleetlens.session import work_folder

ROWS_PER_SLICE = 5_000_000

# Most slices one key can have; a power of two.
FAN = 4096

SLICE = "_slice"


def _slice_of(at: Column, cuts: Column) -> Column:
    """How many of the sorted ``cuts`` are not after ``at``, by halving."""
    most = 4 * FAN  # the quantiles, and two for each crowded time
    steps = F.array(*[F.lit(most >> i) for i in range(1, most.bit_length())])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda seen, step: F.when(F.get(cuts, seen + step - 1) <= at, seen + step).otherwise(seen),
    )


def _cut_points(timed: DataFrame, keys: Sequence[str], busy: DataFrame, limit: int) -> DataFrame:
    """Quantiles of each busy key's times, one for every ``limit`` rows up to ``FAN``."""
    return _quantiles(timed.join(busy, list(keys)), keys, "_at", limit, "_cuts")


def _quantiles(rows: DataFrame, by: Sequence[str], value: str, limit: int, into: str) -> DataFrame:
    """``(*by, into)``: quantiles of ``value``, one for every ``limit`` of the ``_n`` rows, up to ``FAN``."""
    # One text literal keeps the plan small; an array of literals would be a node each.
    quantiles = F.split(F.lit(",".join(str(i / FAN) for i in range(1, FAN))), ",")
    stride = F.greatest(whole_div(F.lit(FAN * limit), F.max("_n")), F.lit(1))
    every = F.percentile_approx(value, quantiles.cast("array<double>"), 4 * FAN)
    found = rows.groupBy(*by).agg(every.alias("_all"), stride.alias("_stride"))
    return found.select(*by, F.filter("_all", lambda _, i: (i + 1) % F.col("_stride") == 0).alias(into))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as read back from a file in the shared folder, so that what follows doesn't compute it again."""
    folder = work_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def slice_busy_keys(df: DataFrame, keys: Sequence[str], ts: str, limit: int, tie: str | None = None) -> DataFrame:
    """Add ``_slice``, growing with ``ts`` inside a key and null for keys within ``limit``.

    Runs a job that counts rows per key; without any busy key ``df`` is returned as
    it is. A burst is cut as finely as it is dense. A time that more than ``limit`` rows of
    a key share is a slice of its own, and if ``tie``, the next column of the order, is a
    number, it is cut again at quantiles of that.
    """
    numeric = tie is not None and isinstance(df.schema[tie].dataType, IntegralType)
    ties = [F.col(tie).cast("bigint").alias("_tie")] if numeric else []
    timed = df.select(*keys, epoch_micros(F.col(ts)).alias("_at"), *ties)
    busy = timed.groupBy(*keys).agg(F.count("_at").alias("_n")).where(F.col("_n") > limit)
    if busy.isEmpty():
        return df
    points = _cut_points(timed, keys, busy, limit)
    inner = None
    if numeric:
        shared = timed.join(busy.withColumnRenamed("_n", "_of"), list(keys)).groupBy(*keys, "_at")
        most = F.greatest(F.lit(limit).cast("bigint"), whole_div(F.col("_of"), FAN))
        crowded = shared.agg(F.count(F.lit(1)).alias("_n"), F.max("_of").alias("_of")).where(F.col("_n") > most).drop("_of")
        crowded = written(crowded, "crowded")
        if not crowded.isEmpty():
            edges = crowded.groupBy(*keys).agg(F.flatten(F.collect_list(F.array("_at", F.col("_at") + 1))).alias("_edges"))
            both = F.array_sort(F.array_distinct(F.concat("_cuts", F.coalesce("_edges", F.array().cast("array<bigint>")))))
            points = points.join(edges, list(keys), "left").select(*keys, both.alias("_cuts"))
            inner = _quantiles(timed.join(crowded, [*keys, "_at"]), [*keys, "_at"], "_tie", limit, "_tie_cuts")
            inner = written(inner, "tie-cuts")
    cuts = written(points, "cuts")
    found = F.when(F.col("_cuts").isNotNull(), _slice_of(epoch_micros(F.col(ts)), F.col("_cuts"))).cast("bigint")
    sliced = df.join(cuts, list(keys), "left")
    if inner is None:
        return sliced.withColumn(SLICE, found).drop("_cuts")
    within = F.coalesce(_slice_of(F.col(tie).cast("bigint"), F.col("_tie_cuts")), F.lit(0)).cast("bigint")
    placed = sliced.withColumn("_at", epoch_micros(F.col(ts))).join(inner, [*keys, "_at"], "left")
    return placed.withColumn(SLICE, found * FAN + within).select(*df.columns, SLICE)


def look_along(
    sliced: DataFrame,
    keys: Sequence[str],
    ts: str,
    ties: Sequence[str],
    value: Column,
    into: str,
    inclusive: bool,
) -> DataFrame:
    """``look_back`` over rows that ``slice_busy_keys`` has seen; its mark is kept."""
    order = [ts, *ties]
    frame = (Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    if SLICE not in sliced.columns:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*frame)
        return sliced.withColumn(into, F.last(value, ignorenulls=True).over(whole))

    valued = sliced.withColumn("_v", value)
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(*frame)
    seen = valued.withColumn("_seen", F.last("_v", ignorenulls=True).over(inside))

    along = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    inherited = (
        valued.where(F.col(SLICE).isNotNull())
        .groupBy(*keys, SLICE)
        .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_close"))
        .select(*keys, SLICE, F.last("_close", ignorenulls=True).over(along).alias("_carried"))
    )
    return (
        seen.join(inherited, [*keys, SLICE], "left")
        .withColumn(into, F.coalesce("_seen", "_carried"))
        .drop("_v", "_seen", "_carried")
    )


def look_back(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ties: Sequence[str],
    value: Column,
    into: str,
    inclusive: bool,
    limit: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add ``into``: the latest non-null ``value`` before each row of its key.

    ``ties`` completes the order after ``ts``. ``inclusive`` lets the row itself
    count. Keys and ``ts`` must not be null. Runs the counting job of ``slice_busy_keys``.
    """
    sliced = slice_busy_keys(df, keys, ts, limit, ties[0] if ties else None)
    return look_along(sliced, keys, ts, ties, value, into, inclusive).drop(SLICE)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ties: Sequence[str],
    value: str,
    into: str,
    limit: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add ``into``: a struct holding the previous row's ``value``, null on the first row.

    The struct keeps a previous null apart from no previous row.
    """
    return look_back(df, keys, ts, ties, F.struct(F.col(value).alias("was")), into, False, limit)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str) -> DataFrame:
    """Add ``into``: 1 for the first row of its key by ``order``, and so on, nulls first.

    Rows are dealt by ranges of key and order, so a key of any size is shared out. Each
    range numbers its own rows; how many of the key come before it is summed over the
    ranges, of which there are no more than partitions and keys. The ranges are written once, as others
    might come out when they are taken again.
    """
    by = [*keys, *order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    kept = written(dealt, "numbered").withColumn("_part", F.shiftright("_row", 33))
    ranges = kept.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first") + 1
    ranges = ranges.select(F.struct(*keys).alias("_key"), F.col("_part").alias("_of"), shift.alias("_shift"))
    same = F.struct(*[kept[k] for k in keys]).eqNullSafe(F.col("_key")) & (kept["_part"] == F.col("_of"))
    return kept.join(ranges, same).withColumn(into, F.col("_row") + F.col("_shift")).select(*df.columns, into)

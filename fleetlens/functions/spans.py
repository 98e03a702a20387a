"""Points in time next to the spans that hold them, without comparing all of a key.

A join on a key and two bounds compares every point of the key with every span of it. Here
points and spans get cells as well, to be joined on too: a point is in a cell, a span has
each cell that a point inside it can be in. So a pair meets once at most, and what meets is
near. The bounds must still be compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import epoch_micros, whole_div
from fleetlens.functions.ordered import ROWS_PER_SLICE, look_back, numbered, written

CELL = "_cell"

POINTS_PER_CELL = 64

# Microseconds of a cell at each level: 8 seconds, 68 minutes, 24 days, 34 years.
WIDTHS = [8_000_000 * 512**level for level in range(4)]

# Most cells of a span at its level, and at the last one.
FEW, MANY = 64, 1024


def cells_by_rank(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    size: int = POINTS_PER_CELL,
    limit: int = ROWS_PER_SLICE,
) -> tuple[DataFrame, DataFrame]:
    """Both with ``_cell``: each key's points by time, ``size`` to a cell; a span is a row for each of its cells.

    However points and spans lie, a span is compared with no more than ``2 * size`` points
    that it doesn't hold. Spans are from ``start`` up to but not at ``end``. Rows without
    key or time, and spans that hold no time or end before any point, are left out. Numbered points
    and spans are written once; spans look back at the first points of the cells.
    """
    known = points.dropna(subset=[*keys, at])
    placed = numbered(known, keys, [at], "_n").withColumn(CELL, whole_div(F.col("_n") - 1, size))
    firsts = placed.where((F.col("_n") - 1) % size == 0).select(*keys, F.col(at).alias("_at"), CELL, F.lit(1).alias("_kind"))
    firsts = written(firsts, "cell-starts")
    found = written(spans.dropna(subset=[*keys, start, end]).where(F.col(start) < F.col(end)), "spans")
    # A cell whose first point is before the start may have points from there on, one whose first is not before the end has none.
    for bound, into in ((start, "_first"), (end, "_last")):
        timed = found.withColumns({"_at": F.col(bound), "_kind": F.lit(0)})
        both = timed.unionByName(firsts, allowMissingColumns=True)
        looked = look_back(both, keys, "_at", ["_kind"], F.col(CELL), into, False, limit)
        found = looked.where(F.col("_kind") == 0).select(*found.columns, into)
    cells = F.sequence(F.coalesce("_first", F.lit(0).cast("bigint")), F.col("_last"))
    return placed.select(*points.columns, CELL), found.where(F.col("_last").isNotNull()).select(*spans.columns, F.explode(cells).alias(CELL))


def _levels(longest: str | None) -> Column:
    """How many levels spans up to ``longest`` need, as a constant for the plan."""
    if not longest:
        return F.lit(len(WIDTHS))
    day = "TIMESTAMP'2000-01-01 00:00:00Z'"
    span = F.expr(f"unix_micros({day} + INTERVAL {longest}) - unix_micros({day})")
    return sum(((span > MANY * width).cast("int") for width in WIDTHS[:-1]), F.lit(1))


def cells_by_time(
    points: DataFrame, spans: DataFrame, at: str, start: str, end: str, longest: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both with ``_cell``, of fixed widths, for streams, where nothing is known of what will come.

    A span has its cells at the level that fits its length, a point is a row for each level
    that spans up to ``longest`` need: two for 30 days. A cell is at most a few times as wide as its spans are
    long, but for the first level's, so what a point meets beyond its spans are the short ones within some seconds.
    """
    n, levels = len(WIDTHS), _levels(longest)

    def cell(micros: Column, level: int) -> Column:
        return whole_div(micros, WIDTHS[level]) * n + level

    every = F.slice(F.array(*[cell(epoch_micros(F.col(at)), k) for k in range(n)]), F.lit(1), levels)
    first, last = epoch_micros(F.col(start)), epoch_micros(F.col(end)) - 1
    cells = F.sequence(cell(first, n - 1), cell(last, n - 1), F.lit(n))
    for level in reversed(range(n - 1)):
        fits = (last - first < FEW * WIDTHS[level]) | (levels <= level + 1)
        cells = F.when(fits, F.sequence(cell(first, level), cell(last, level), F.lit(n))).otherwise(cells)
    held = spans.where(F.col(start) < F.col(end))
    return points.withColumn(CELL, F.explode(every)), held.withColumn(CELL, F.explode(cells))

"""Log lines, value changes and unit status."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.fixed import LINE_PREFIX, STATUS_STATES
from fleetlens.functions.capture import fits, group, with_groups
from fleetlens.functions.ordered import ROWS_PER_SLICE, look_back, previous
from fleetlens.functions.skew import spread_join, top_rows
from fleetlens.functions.spans import CELL, cells_by_rank, cells_by_time

# What each escape of a line prefix looks like, and the field it fills.
ESCAPES = {
    "t": ("ts", r"(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d \w+)"),
    "p": ("pid", r"(\d+)"),
    "l": ("line_no", r"(\d+)"),
    "d": ("datname", r"(.*?)"),
    "u": ("usename", r"(.*?)"),
}


def prefix_pattern(prefix: str) -> tuple[str, list[str]]:
    """Regular expression for a line prefix, and the fields of its groups."""
    pattern, fields = "", []
    for token in re.findall(r"%.|[^%]+|%$", prefix):
        if token == "%%":
            pattern += "%"
        elif token[0] == "%" and token[1:] in ESCAPES:
            field, expr = ESCAPES[token[1:]]
            pattern += expr
            fields.append(field)
        elif token[0] == "%" and len(token) == 2:
            pattern += ".*?"
        else:
            pattern += re.sub(r"([^\w\s,=:;/@#-])", r"\\\1", token)
    return f"^{pattern}(.*)$", [*fields, "message"]


def decode_logs(df: DataFrame, prefix: str = LINE_PREFIX, line: str = "line") -> DataFrame:
    """Fields of each log line; a line that does not fit keeps its text as ``message``.

    The prefix becomes one pattern when the plan is built and is matched once per line.
    """
    pattern, fields = prefix_pattern(prefix)
    n = len(fields)

    def field(name: str, kind: str = "string") -> Column:
        if name not in fields:
            return F.lit(None).cast(kind)
        return F.when(fits(n), group(fields.index(name) + 1)).try_cast(kind)

    stamp = F.try_to_timestamp(field("ts"), F.lit("yyyy-MM-dd HH:mm:ss z"))
    return with_groups(df, F.col(line), pattern, n).select(
        *[c for c in df.columns if c != line],
        stamp.cast("timestamp_ntz").alias("ts"),
        field("pid", "bigint").alias("pid"),
        field("line_no", "bigint").alias("line_no"),
        field("datname").alias("datname"),
        field("usename").alias("usename"),
        F.coalesce(field("message"), F.col(line)).alias("message"),
    )


def route(lines: DataFrame, routes: DataFrame) -> DataFrame:
    """Lines whose program has a destination, one row per destination.

    ``routes(program, destination)``; a unit's program is its name with ``/`` as ``_``.
    """
    return spread_join(lines, routes.select("program", "destination").distinct(), ["program"])


def route_history(lines: DataFrame, routes: DataFrame, longest: str | None = None) -> DataFrame:
    """Lines with the destination that their program had at their time.

    ``lines(program, ts, ...)``; ``routes(program, destination, valid_from, valid_to)`` hold from
    ``valid_from`` up to but not at ``valid_to``. A line outside all routes is left out, one
    within several goes to each. No route holds for longer than ``longest``, if given: what
    is later of it doesn't count. Lines and routes meet by cells of time, of a few lines each; to
    cut these, the lines are written once. Works on two watermarked streams, whose state that bounds; their
    cells have fixed widths.
    """
    until = F.col("valid_from") + F.expr(f"INTERVAL {longest}") if longest else F.col("valid_to")
    held = routes.where(F.col("valid_to").isNotNull())
    named = held.select("program", "destination", "valid_from", "valid_to", F.least("valid_to", until).alias("_end"))
    if lines.isStreaming or routes.isStreaming:
        placed, spread = cells_by_time(lines, named, "ts", "valid_from", "_end", longest)
    else:
        placed, spread = cells_by_rank(lines, named, ["program"], "ts", "valid_from", "_end")
    spread = spread.withColumnsRenamed({"program": "_program", CELL: "_of"})
    holds = (F.col("program") == F.col("_program")) & (F.col(CELL) == F.col("_of"))
    holds = holds & (F.col("ts") >= F.col("valid_from")) & (F.col("ts") < F.col("valid_to"))
    if longest:
        holds = holds & (F.col("ts") < until)
    return placed.join(spread, holds).select(*lines.columns, "destination", "valid_from")


def program_of(unit: Column) -> Column:
    return F.translate(unit, "/", "_")


def tail(df: DataFrame, n: int = 100, key: str = "program", order: Sequence[str] = ("event_id",)) -> DataFrame:
    """Last ``n`` rows per log."""
    return top_rows(df, [key], order, n).drop("_rn")


def changes(
    df: DataFrame,
    key: str,
    value: str,
    ts: str = "ts",
    tie: str = "event_id",
    limit: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Rows whose ``value`` differs from the one before it for the key; a first value counts."""
    slim = df.select(key, ts, tie, value)
    looked = previous(slim, [key], ts, [tie], value, "_prev", limit)
    return looked.where(
        F.col("_prev").isNull() | ~F.col(value).eqNullSafe(F.col("_prev.was"))
    ).select(key, ts, tie, value, F.col("_prev.was").alias("previous"))


def status_flags(events: DataFrame, limit: int = ROWS_PER_SLICE) -> DataFrame:
    """Status of each unit after each event, one-hot.

    A null state keeps the one before it; before any state it means maintenance.
    Input: ``event_id, unit, ts, state``.
    """
    looked = look_back(
        events, ["unit"], "ts", ["event_id"], F.col("state"), "_state", True, limit
    )
    state = F.coalesce("_state", F.lit("maintenance"))
    return looked.select(
        "event_id",
        "unit",
        "ts",
        state.alias("status"),
        *[(state == s).alias(f"is_{s}") for s in STATUS_STATES],
        F.when(state == "blocked", F.lit("WARNING")).otherwise(F.lit("INFO")).alias("level"),
    )

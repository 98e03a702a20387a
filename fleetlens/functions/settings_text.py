"""Decoding the lines of a settings file.

A line is blank, a comment, or a name and a value with an optional ``=`` between them and
an optional comment after them. A value is a plain word, or any text in single quotes,
where a quote is doubled or follows a backslash. The line is read from left to right in
two steps, the name and what is after it. Repetitions never give back what they took, so
the work is linear in the line, and its length costs no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.capture import fits, group, with_groups

# Blanks; a name that an equals sign or a blank follows, if there is one; the rest.
NAME_AND_REST = r"(?s)^\s*+(?:(\w++)(?:\s*+=|\s)\s*+)?+(.*+)$"

# A quoted or a plain value, if there is one; the rest, blanks before it left out.
VALUE_AND_REST = r"(?s)^('(?:[^'\\]++|''|\\.)*+'(?!'))?+([\w.\-]++)?+\s*+(.*+)$"


def _is_over(text: Column) -> Column:
    """Nothing but a comment is left."""
    return (text == "") | F.startswith(text, F.lit("#"))


def decode_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``key``, ``value`` and ``error``; blanks and comments drop out. A null line is blank."""
    kept = lines.columns
    named = with_groups(lines, F.col(line), NAME_AND_REST, 2, "_named").where(F.col(line).isNotNull())
    name, rest = group(1, "_named"), group(2, "_named")
    told = with_groups(named, F.coalesce(rest, F.col(line)), VALUE_AND_REST, 3, "_told")
    quoted, plain, more = (group(i, "_told") for i in range(1, 4))
    # A word right after a closing quote doesn't belong to the value.
    left = F.when((quoted != "") & (plain != ""), F.concat(plain, more)).otherwise(more)
    inside = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    value = F.when(quoted != "", F.regexp_replace(inside, r"''|\\'", "'")).otherwise(plain)
    error = (
        F.when(~fits(2, "_named") | ~fits(3, "_told"), F.lit("Invalid line"))
        .when(name == "", F.lit("Missing key"))
        .when(~_is_over(left), F.lit("Badly quoted value"))
        .when(value == "", F.when(quoted == "", F.lit("Missing value")))
    )
    nothing = fits(2, "_named") & fits(3, "_told") & (name == "") & (quoted == "") & (plain == "") & _is_over(more)
    return told.where(~nothing).select(
        *kept,
        F.when(error.isNull(), F.lower(name)).alias("key"),
        F.when(error.isNull(), value).alias("value"),
        error.alias("error"),
    )

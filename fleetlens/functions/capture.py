"""Cutting a text into the groups of a pattern, matching once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEP = "\x01"


def with_groups(df: DataFrame, text: Column, pattern: str, n: int, into: str = "_groups") -> DataFrame:
    """Add ``into``: the ``n`` groups of a pattern that must fit the whole text.

    A group that took no part is the empty string. A text that does not fit has a
    single element instead of ``n``. Spark would copy the expression into every
    later use and match again each time, so the groups pass through a generator,
    which computes them once per row and stays inside code generation.
    """
    marked = F.regexp_replace(text, pattern, _SEP.join(f"${i + 1}" for i in range(n)))
    one_by_one = F.array(*[F.regexp_extract(text, pattern, i + 1) for i in range(n)])
    groups = (
        F.when(~F.contains(text, F.lit(_SEP)), F.split(marked, _SEP))
        .when(text.rlike(pattern), one_by_one)
        .otherwise(F.array(text))
    )
    return df.select("*", F.explode(F.array(groups)).alias(into))


def group(i: int, groups: str = "_groups") -> Column:
    """Group ``i``, counted from 1; null where the text did not fit."""
    return F.get(F.col(groups), F.lit(i - 1))


def fits(n: int, groups: str = "_groups") -> Column:
    return F.size(F.col(groups)) == n

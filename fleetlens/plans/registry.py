"""Queries next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.plans.adapters import Tables, oracle_text


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    using: tuple[str, ...]
    sql: str | None

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.run(Tables(spark, folder))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        views = ", ".join(f"{name} AS ({oracle_text(name)})" for name in self.using)
        if not views:
            return self.sql
        body = self.sql.strip()
        return f"WITH {views}, {body[5:]}" if body.startswith("WITH ") else f"WITH {views} {body}"


# SQL for the lines of each text of ``{source}(doc_id, text)`` without its managed block, in
# whose place is an empty line; then, with lines marked ``hit``, for the texts with these commented out.
OUTSIDE_BLOCK = r"""cut AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {source})),
      bared AS (SELECT *, ltrim(line, chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) AS bare FROM cut),
      ends AS (SELECT doc_id, min(i) FILTER (upper(bare) LIKE '### BEGIN JUJU SETTINGS ###%') AS a,
          max(i) FILTER (upper(rtrim(bare)) = '### END JUJU SETTINGS ###') AS z FROM bared GROUP BY doc_id),
      near AS (SELECT b.doc_id, any_value(a) AS a, max(i) FILTER (bare <> '' AND i < a) AS h, min(i) FILTER (bare <> '' AND i > z) AS t
        FROM bared b JOIN ends e ON e.doc_id = b.doc_id WHERE a <= z GROUP BY b.doc_id),
      outside AS (SELECT b.doc_id, i, line, bare FROM bared b LEFT JOIN near n ON n.doc_id = b.doc_id WHERE n.a IS NULL OR i <= h OR i >= t
        UNION ALL SELECT doc_id, a, '', '' FROM near)"""
COMMENTED_OUT = """ahead AS (SELECT *, lead(CASE WHEN bare <> '' THEN hit END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM told_lines),
      body AS (SELECT doc_id, string_agg(CASE WHEN hit THEN concat('# juju # ', bare) ELSE line END, chr(10) ORDER BY i) AS text
        FROM ahead WHERE bare <> '' OR next IS NOT TRUE GROUP BY doc_id)"""

QUERIES: dict[str, Query] = {}


def query(*using: str, sql: str | None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of ``Tables``; ``using`` names the adapters its SQL reads."""

    def add(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[run.__name__] = Query(run.__name__, run, using, sql)
        return run

    return add


def moment(text: str) -> Column:
    """A fixed clock for ages; never the time of the run."""
    return F.lit(text).cast("timestamp_ntz")

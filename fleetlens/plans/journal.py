"""Queries over logs, changes and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import events
from fleetlens.plans.adapters import Tables
from fleetlens.plans.registry import query
from fleetlens.session import work_folder
from fleetlens.streaming.jobs import change_stream
from fleetlens.streaming.jobs import route_history_stream as route_history_stream_job
from fleetlens.streaming.jobs import route_stream as route_stream_job
from fleetlens.streaming.run import drain, read_folder

_PREFIX = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d \w+) \[(\d+)\]: \[(\d+)-1\] db=(.*?),user=(.*?) (.*)$"


def _group(i: int) -> str:
    return f"regexp_extract(line, '{_PREFIX}', {i})"


@query(
    "logs",
    sql=f"""
    SELECT event_id, program, CASE WHEN ok THEN strptime(substring({_group(1)}, 1, 19), '%Y-%m-%d %H:%M:%S') END AS ts,
      CASE WHEN ok THEN CAST({_group(2)} AS BIGINT) END AS pid, CASE WHEN ok THEN CAST({_group(3)} AS BIGINT) END AS line_no,
      CASE WHEN ok THEN {_group(4)} END AS datname, CASE WHEN ok THEN {_group(5)} END AS usename,
      CASE WHEN ok THEN {_group(6)} ELSE line END AS message
    FROM (SELECT *, regexp_matches(line, '{_PREFIX}') AS ok FROM logs)""",
)
def decode_logs(t: Tables) -> DataFrame:
    return events.decode_logs(t["logs"])


_ROUTED = "SELECT l.program, l.event_id, l.line, r.destination FROM logs l JOIN routes r ON r.program = l.program"


@query("logs", "routes", sql=_ROUTED)
def route_logs(t: Tables) -> DataFrame:
    return events.route(t["logs"], t["routes"])


@query("logs", "routes", sql=_ROUTED)
def route_stream(t: Tables) -> DataFrame:
    """The streaming form, written to one folder per destination."""
    lines = t.adapt("logs", events=read_folder(t.spark, t.path("events")))
    folder = drain(route_stream_job(lines, t["routes"]), "routed", partition_by="destination")
    return t.spark.read.option("basePath", folder).parquet(folder).withColumn(
        "destination", F.col("destination").cast("string")
    )


_ROUTED_THEN = """SELECT l.event_id, l.program, l.ts, l.line, r.destination, r.valid_from FROM timed_logs l
    JOIN route_changes r ON r.program = l.program AND l.ts >= r.valid_from AND l.ts < r.valid_to AND l.ts < r.valid_from + INTERVAL '30' DAY"""


@query("timed_logs", "route_changes", sql=_ROUTED_THEN)
def route_history(t: Tables) -> DataFrame:
    """Where each line went by the routes of its time."""
    return events.route_history(t["timed_logs"], t["route_changes"], "30 days")


@query("timed_logs", "route_changes", sql=_ROUTED_THEN)
def route_history_stream(t: Tables) -> DataFrame:
    """The same from two streams, of lines and of routes."""
    folder = work_folder(t.spark, "route-changes")
    t["route_changes"].write.parquet(folder)
    routes = t.spark.readStream.schema(t["route_changes"].schema).parquet(folder)
    lines = t.adapt("timed_logs", events=read_folder(t.spark, t.path("events")))
    found = route_history_stream_job(lines, routes)
    out = t.spark.read.schema(found.schema).parquet(drain(found, "routed-then"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "valid_from")})


@query(
    "logs",
    sql="""
    SELECT event_id, program, line FROM logs
    QUALIFY row_number() OVER (PARTITION BY program ORDER BY event_id DESC) <= 100""",
)
def tail(t: Tables) -> DataFrame:
    return events.tail(t["logs"], 100)


_CHANGES = """WITH looked AS (SELECT *, lag(target) OVER w AS previous, row_number() OVER w AS rn FROM target_values
        WINDOW w AS (PARTITION BY unit ORDER BY ts, event_id))
    SELECT unit, ts, event_id, target, previous FROM looked WHERE rn = 1 OR target IS DISTINCT FROM previous"""


@query("target_values", sql=_CHANGES)
def changes(t: Tables) -> DataFrame:
    return events.changes(t["target_values"], "unit", "target")


@query("target_values", sql=_CHANGES)
def changes_stream(t: Tables) -> DataFrame:
    stream = t.adapt("target_values", events=read_folder(t.spark, t.path("events")))
    found = change_stream(stream, "unit", "target")
    return t.spark.read.schema(found.schema).parquet(drain(found, "changes"))


@query(
    "status_events",
    sql="""WITH s AS (SELECT *, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY unit ORDER BY ts, event_id
        ROWS UNBOUNDED PRECEDING), 'maintenance') AS status FROM status_events)
    SELECT event_id, unit, ts, status, status = 'maintenance' AS is_maintenance, status = 'blocked' AS is_blocked,
      status = 'waiting' AS is_waiting, status = 'active' AS is_active, status = 'unknown' AS is_unknown,
      CASE WHEN status = 'blocked' THEN 'WARNING' ELSE 'INFO' END AS level
    FROM s""",
)
def status_flags(t: Tables) -> DataFrame:
    return events.status_flags(t["status_events"])

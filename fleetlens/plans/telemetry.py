"""Queries over metrics, sessions and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.fixed import OLD_IDLE_STATE, SESSION_STATES
from fleetlens.operators import freshness, metrics, sessions
from fleetlens.plans.adapters import AS_OF, Tables
from fleetlens.plans.registry import moment, query
from fleetlens.sources.snapshots import snapshot
from fleetlens.specs import (
    DATABASE_SPECS,
    SERVER_SPECS,
    SESSION_STATE_SPEC,
    SESSION_TOTAL_SPEC,
    StatSpec,
)
from fleetlens.streaming.jobs import idle_stream as idle_stream_job
from fleetlens.streaming.jobs import sample_stream
from fleetlens.streaming.run import drain, read_folder

SQL_NOW = f"TIMESTAMP '{AS_OF}'"
IDLE_GAP_S = 6 * 3600

_LISTED = "SELECT DISTINCT unit, datname FROM databases WHERE datname NOT IN ('postgres', 'template0', 'template1')"
_STATE_COUNTS = ", ".join(
    f"count(*) FILTER (a.state = '{state}') AS {gauge}" for gauge, state in SESSION_STATES.items()
)


def _counted(columns: str) -> str:
    return f"""counted AS (SELECT d.unit, d.datname, {columns}
      FROM ({_LISTED}) d LEFT JOIN activity a ON a.unit = d.unit AND a.datname = d.datname GROUP BY d.unit, d.datname)"""


_ALL_COUNTS = ["connections", "connections_waiting", *SESSION_STATES]


@query(
    sql="""
    SELECT concat('orders.', o_orderkey, '.', name) AS metric, coalesce(value, 0) AS value
    FROM (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice FROM orders)
    UNPIVOT INCLUDE NULLS (value FOR name IN (o_custkey, o_totalprice))"""
)
def snapshot_scan(t: Tables) -> DataFrame:
    """A whole snapshot as per-server gauges."""
    spec = StatSpec(
        table="orders",
        key=("o_orderkey",),
        exclude=("o_orderdate", "o_orderstatus", "o_orderpriority"),
    )
    return metrics.to_gauges(snapshot(t.spark, t.folder, spec), spec)


@query("databases", sql=_LISTED)
def database_list(t: Tables) -> DataFrame:
    return metrics.databases(t["databases"])


@query(
    "activity",
    "databases",
    sql=f"""WITH {_counted(f"count(a.pid) AS connections, count(*) FILTER (a.waiting) AS connections_waiting, {_STATE_COUNTS}")}
    SELECT unit, concat('databases.', datname, '.', name) AS metric, CAST(value AS DOUBLE) AS value
    FROM counted UNPIVOT (value FOR name IN ({', '.join(_ALL_COUNTS)}))""",
)
def session_gauges(t: Tables) -> DataFrame:
    """Session counts of every listed database as gauges."""
    counts = metrics.session_counts(metrics.databases(t["databases"]), t["activity"])
    return metrics.to_gauges(counts, SESSION_STATE_SPEC, "datname", ("unit",))


@query(
    "activity",
    "databases",
    sql=f"WITH {_counted('count(a.pid) AS connections')} SELECT unit, datname, connections FROM counted",
)
def session_totals(t: Tables) -> DataFrame:
    return metrics.session_totals(metrics.databases(t["databases"]), t["activity"])


@query(
    "activity",
    "databases",
    sql=f"""WITH {_counted(f"count(*) FILTER (a.waiting) AS connections_waiting, {_STATE_COUNTS}")}
    SELECT * FROM counted""",
)
def session_states(t: Tables) -> DataFrame:
    return metrics.session_states(metrics.databases(t["databases"]), t["activity"])


@query(
    "table_stats",
    sql="""
    SELECT concat('databases.', datname, '.tables.', schemaname, '.', relname, '.', name) AS metric,
      coalesce(value, 0) AS value
    FROM (SELECT datname, schemaname, relname, CAST(n_tup_ins AS DOUBLE) AS n_tup_ins,
            CAST(n_tup_upd AS DOUBLE) AS n_tup_upd, CAST(n_dead_tup AS DOUBLE) AS n_dead_tup FROM table_stats)
    UNPIVOT INCLUDE NULLS (value FOR name IN (n_tup_ins, n_tup_upd, n_dead_tup))""",
)
def table_gauges(t: Tables) -> DataFrame:
    return metrics.to_gauges(t["table_stats"], DATABASE_SPECS[2], "datname")


@query(
    "servers",
    sql="""
    SELECT unit, version, connections FROM servers
    WHERE CAST(string_split(version, '.') AS INTEGER[]) >= [9, 3]""",
)
def gated_gauges(t: Tables) -> DataFrame:
    return metrics.gate(t["servers"], "version", SESSION_STATE_SPEC.version_required).select(
        "unit", "version", "connections"
    )


_FLEET_SESSIONS = f"""fleet AS (SELECT a.unit, a.datname, any_value(v.version) AS version, count(*) AS connections,
        count(*) FILTER (waiting) AS connections_waiting, {_STATE_COUNTS} FROM activity a JOIN fleet_versions v ON v.unit = a.unit GROUP BY ALL)"""


@query(
    "activity",
    "fleet_versions",
    "fleet_writers",
    sql=f"""WITH {_FLEET_SESSIONS}
    SELECT unit, concat('databases.', datname, '.connections') AS metric, CAST(connections AS DOUBLE) AS value FROM fleet
    UNION ALL SELECT unit, concat('databases.', datname, '.', name), CAST(value AS DOUBLE)
      FROM (SELECT * FROM fleet WHERE CAST(string_split(version, '.') AS INTEGER[]) >= [9, 3])
      UNPIVOT (value FOR name IN (connections_waiting, {', '.join(SESSION_STATES)}))
    UNION ALL SELECT unit, concat('pg_stat_bgwriter.', name), value
      FROM (SELECT unit, coalesce(CAST(checkpoints AS DOUBLE), 0) AS checkpoints, coalesce(TRY_CAST(note AS DOUBLE), CASE WHEN note IS NULL THEN 0 END) AS note FROM fleet_writers)
      UNPIVOT INCLUDE NULLS (value FOR name IN (checkpoints, note))""",
)
def collected_gauges(t: Tables) -> DataFrame:
    """Session totals of every server, states of those new enough for them, and writer statistics."""
    versions = t["fleet_versions"]
    activity = t["activity"]
    seen = activity.select("unit", "datname").distinct()
    totals = metrics.session_totals(seen, activity).join(versions, "unit")
    states = metrics.session_states(seen, activity).join(versions, "unit")
    return metrics.collect_gauges(
        [(SESSION_TOTAL_SPEC, totals), (SESSION_STATE_SPEC, states), (SERVER_SPECS[0], t["fleet_writers"])]
    )


@query(
    "part_gauges",
    sql="""
    SELECT concat('dev.', replace(replace(unit, '/', '-'), '.', '-'), '.postgresql.', metric, ':',
      CAST(value AS BIGINT), '|g') AS line
    FROM part_gauges""",
)
def gauge_lines(t: Tables) -> DataFrame:
    return metrics.gauge_lines(t["part_gauges"], unit_col="unit")


@query(
    "gauges",
    sql="""
    SELECT metric, time_bucket(INTERVAL '5 minutes', sampled_at) AS bucket,
      arg_max(value, (sampled_at, sample_id)) AS value
    FROM gauges GROUP BY 1, 2""",
)
def sampled_gauges(t: Tables) -> DataFrame:
    return metrics.sample(t["gauges"])


@query(
    "gauges",
    sql="""
    SELECT metric, time_bucket(INTERVAL '5 minutes', sampled_at) AS bucket,
      arg_max(value, (sampled_at, sample_id)) AS value
    FROM gauges GROUP BY 1, 2
    HAVING time_bucket(INTERVAL '5 minutes', any_value(sampled_at)) + INTERVAL '5 minutes'
      <= (SELECT max(sampled_at) FROM gauges) - INTERVAL '10 minutes'""",
)
def sampled_stream(t: Tables) -> DataFrame:
    """The streaming form; intervals the last watermark has not passed stay open."""
    stream = t.adapt("gauges", events=read_folder(t.spark, t.path("events")))
    out = t.spark.read.parquet(drain(sample_stream(stream), "samples"))
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


_REPORT = f"""usename, application_name, datname, pid, backend_start, state_change,
      date_diff('microsecond', state_change, {SQL_NOW}) // 1000000 AS age_s"""


@query(
    "activity",
    sql=f"""
    SELECT {_REPORT} FROM activity
    WHERE pid <> 12 AND state = 'idle in transaction' AND state_change < {SQL_NOW} - INTERVAL 900 SECOND
      AND 'u3' NOT IN (usename, application_name) AND 'app2' NOT IN (usename, application_name)""",
)
def idle_sessions(t: Tables) -> DataFrame:
    idle = sessions.idle_sessions(t["activity"], moment(AS_OF), 900, self_pid=12)
    return sessions.with_age(sessions.ignore_sessions(idle, ["u3", "app2"]), moment(AS_OF))


@query("activity", sql=f"SELECT {_REPORT} FROM activity WHERE pid <> 7")
def idle_sessions_all(t: Tables) -> DataFrame:
    """A limit of 0 keeps every other session."""
    return sessions.with_age(sessions.idle_sessions(t["activity"], moment(AS_OF), 0, self_pid=7), moment(AS_OF))


@query(
    "activity",
    sql=f"""
    SELECT {_REPORT} FROM activity
    WHERE state = 'idle in transaction' AND state_change < {SQL_NOW} - INTERVAL 600 SECOND""",
)
def idle_sessions_old_server(t: Tables) -> DataFrame:
    """The same report from the column names of servers older than 9.2."""
    old = t["activity"].select(
        "usename",
        "application_name",
        "datname",
        "backend_start",
        F.col("pid").alias("procpid"),
        F.when(F.col("state") == "idle in transaction", F.lit(OLD_IDLE_STATE))
        .otherwise(F.col("state"))
        .alias("current_query"),
        F.col("state_change").alias("query_start"),
    )
    idle = sessions.idle_sessions(sessions.from_old_activity(old), moment(AS_OF))
    return sessions.with_age(idle, moment(AS_OF))


def _runs(bound: str) -> str:
    return f"""WITH marked AS (SELECT *, CASE WHEN date_diff('microsecond', lag(state_change) OVER w, state_change)
          < {IDLE_GAP_S}000000 THEN 0 ELSE 1 END AS opens FROM activity
        WINDOW w AS (PARTITION BY usename ORDER BY state_change, pid)),
      numbered AS (SELECT *, sum(opens) OVER (PARTITION BY usename ORDER BY state_change, pid) AS run FROM marked)
    SELECT usename, min(state_change) AS run_start, max(state_change) AS idle_since, count(*) AS n_events
    FROM numbered GROUP BY usename, run
    HAVING arg_max(state, (state_change, pid)) = 'idle in transaction' {bound}"""


@query("activity", sql=_runs(""))
def idle_runs(t: Tables) -> DataFrame:
    return sessions.idle_runs(t["activity"], IDLE_GAP_S)


@query(
    "activity",
    sql=_runs(
        f"""AND max(state_change) + INTERVAL {IDLE_GAP_S} SECOND
      <= (SELECT max(state_change) FROM activity) - INTERVAL 1 MINUTE"""
    ),
)
def idle_stream(t: Tables) -> DataFrame:
    stream = t.adapt("activity", events=read_folder(t.spark, t.path("events")))
    out = t.spark.read.parquet(drain(idle_stream_job(stream, IDLE_GAP_S), "idle"))
    return out.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("run_start", "idle_since")}
    )


_READY = r"""ready AS (SELECT * FROM file_inventory
      WHERE regexp_full_match(path, '/data/[^/.][^/]*/[^/.][^/]*/pg_(xlog|wal)/archive_status/[^/.][^/]*\.ready')),
    aged AS (SELECT u.unit, coalesce(greatest(date_diff('microsecond', min(f.mtime), TIMESTAMP '2001-11-01 12:00:00') // 1000000, 0), 0) AS age_s
      FROM units u LEFT JOIN ready f ON f.unit = u.unit GROUP BY u.unit)"""
ARCHIVE_NOW = "2001-11-01 12:00:00"
ARCHIVE_LIMITS = (214_000_000, 215_000_000)


@query("units", "file_inventory", sql=f"WITH {_READY} SELECT unit, age_s FROM aged")
def archive_age(t: Tables) -> DataFrame:
    ready = freshness.ready_files(t["file_inventory"], "/data")
    return freshness.max_age(t["units"], ready, moment(ARCHIVE_NOW))


@query(
    "units",
    "file_inventory",
    sql=f"""WITH {_READY}, judged AS (SELECT *, CAST(CASE WHEN age_s > {ARCHIVE_LIMITS[1]} THEN 2
        WHEN age_s > {ARCHIVE_LIMITS[0]} THEN 1 ELSE 0 END AS INTEGER) AS status FROM aged)
    SELECT unit, age_s, status, CASE status WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'OK' END AS level,
      CASE status WHEN 0 THEN 'OK: No stale WAL archival found' ELSE concat(
        CASE status WHEN 2 THEN 'CRITICAL' ELSE 'WARNING' END, ': Last successful WAL archive was ',
        age_s // 86400, ' days, ', age_s % 86400 // 3600, ' hours, ', age_s % 3600 // 60, ' minutes and ',
        age_s % 60, ' seconds ago') END AS message
    FROM judged""",
)
def archive_status(t: Tables) -> DataFrame:
    return freshness.classify(archive_age(t), "age_s", *ARCHIVE_LIMITS)


@query(
    "backup_runs",
    sql="""WITH aged AS (SELECT *, date_diff('second', last_success, TIMESTAMP '2001-08-02 02:00:00') AS age_s FROM backup_runs),
      judged AS (SELECT *, CAST(CASE WHEN NOT is_master THEN 0 WHEN last_success IS NULL THEN 2 WHEN age_s > 194400 THEN 2
        WHEN age_s > 172800 THEN 1 ELSE 0 END AS INTEGER) AS status FROM aged)
    SELECT *, CASE status WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'OK' END AS level FROM judged""",
)
def heartbeat(t: Tables) -> DataFrame:
    return freshness.heartbeat(
        t["backup_runs"], moment("2001-08-02 02:00:00")
    )

"""Queries over dumps, base backups and restore points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import backups
from fleetlens.plans.adapters import Tables
from fleetlens.plans.registry import moment, query
from fleetlens.session import work_folder
from fleetlens.sources.files import read_backup_list
from fleetlens.sources.sinks import export, write_backup_list

NOW = "2001-09-01 00:00:00"
SQL_NOW = f"TIMESTAMP '{NOW}'"

_DUMP = r"(?:^|/)([^/]+)\.(\d{8}_\d{6})\.dump(\.gz|\.bz2|\.xz)?$"
_GLOBALS = r"(?:^|/)globals\.(\d{8}_\d{6})\.sql$"
_DECODED = f"""decoded AS (SELECT unit, path, size, mtime, file_id,
      CASE WHEN regexp_matches(path, '{_GLOBALS}') THEN 'globals' WHEN regexp_matches(path, '{_DUMP}') THEN 'database' END AS kind,
      nullif(regexp_extract(path, '{_DUMP}', 1), '') AS datname,
      strptime(coalesce(nullif(regexp_extract(path, '{_GLOBALS}', 1), ''), regexp_extract(path, '{_DUMP}', 2)), '%Y%m%d_%H%M%S') AS stamp,
      CASE WHEN regexp_matches(path, '{_DUMP}') THEN ltrim(regexp_extract(path, '{_DUMP}', 3), '.') END AS codec
    FROM backup_files)"""
_LATEST = """latest AS (SELECT unit, datname, arg_max(size, (mtime, path, size)) AS size, max(mtime) AS mtime
      FROM decoded WHERE datname IS NOT NULL GROUP BY 1, 2)"""


@query("backup_files", sql=f"WITH {_DECODED} SELECT * FROM decoded")
def dump_names(t: Tables) -> DataFrame:
    return backups.decode_dumps(t["backup_files"])


@query("backup_files", sql=f"WITH {_DECODED}, {_LATEST} SELECT * FROM latest")
def latest_dump(t: Tables) -> DataFrame:
    return backups.latest_dump(backups.decode_dumps(t["backup_files"]))


@query(
    "backup_files",
    "free_space",
    sql=f"""WITH {_DECODED}, {_LATEST},
      need AS (SELECT unit, CAST(sum(size) AS BIGINT) * 13 // 10 // 1024 AS need_kib FROM latest GROUP BY 1)
    SELECT f.unit, f.free_kib, coalesce(n.need_kib, 0) AS need_kib, coalesce(n.need_kib, 0) <= f.free_kib AS fits
    FROM free_space f LEFT JOIN need n ON n.unit = f.unit""",
)
def space_forecast(t: Tables) -> DataFrame:
    return backups.space_forecast(latest_dump(t), t["free_space"])


@query(
    "backup_files",
    sql=f"""WITH runs AS (SELECT unit, mtime, row_number() OVER (PARTITION BY unit ORDER BY path DESC, mtime DESC) AS rn
        FROM backup_files WHERE path LIKE '%/globals.%.sql'),
      lim AS (SELECT unit, date_diff('second', arg_max(mtime, rn), {SQL_NOW}) // 60 + 1 AS minutes
        FROM runs WHERE rn <= 7 GROUP BY unit)
    SELECT b.* FROM backup_files b JOIN lim ON lim.unit = b.unit
    WHERE date_diff('second', b.mtime, {SQL_NOW}) > minutes * 60""",
)
def prune_by_run(t: Tables) -> DataFrame:
    return backups.prune_by_run(t["backup_files"], moment(NOW), 7)


@query(
    "base_backups",
    sql="""
    SELECT store, name, started, size_bytes FROM base_backups
    QUALIFY row_number() OVER (PARTITION BY store ORDER BY started DESC, name DESC) > 2""",
)
def prune_keep_n(t: Tables) -> DataFrame:
    return backups.prune_keep_n(t["base_backups"], 2)


def _listing(t: Tables) -> DataFrame:
    path = work_folder(t.spark, "listing")
    text = t["base_backups"].withColumn("started", F.col("started").cast("string"))
    write_backup_list(text, path)
    return read_backup_list(t.spark, path)


_TEXT = "SELECT store, name, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, CAST(size_bytes AS VARCHAR) AS size_bytes FROM base_backups"


@query("base_backups", sql=_TEXT)
def backup_list(t: Tables) -> DataFrame:
    """A tab-separated listing, written and read back."""
    return _listing(t)


@query(
    "base_backups",
    sql=f"""
    SELECT concat(lower(replace(name, '_', '-')), '.', replace(field, '_', '-')) AS key, value
    FROM (SELECT name AS stem, * FROM ({_TEXT})) UNPIVOT (value FOR field IN (store, name, started, size_bytes)),
    LATERAL (SELECT stem AS name)""",
)
def backup_pairs(t: Tables) -> DataFrame:
    return backups.flatten_kv(_listing(t), "name")


@query(
    "restore_requests",
    "base_backups",
    sql="""WITH known AS (SELECT store, lower(replace(name, '_', '-')) AS norm, arg_min(name, started) AS name, min(started) AS started
        FROM base_backups GROUP BY 1, 2),
      stores AS (SELECT DISTINCT store FROM base_backups),
      newest AS (SELECT r.request_id, arg_max(b.name, (b.started, b.name)) AS name FROM restore_requests r
        JOIN base_backups b ON b.store = r.store AND (r.target_time IS NULL OR b.started < r.target_time) GROUP BY 1)
    SELECT r.request_id, r.store, r.backup, n.name AS resolved,
      CASE WHEN s.store IS NULL THEN 'no backups' WHEN n.name IS NULL THEN 'none before target' END AS reason
    FROM restore_requests r LEFT JOIN newest n ON n.request_id = r.request_id LEFT JOIN stores s ON s.store = r.store
    WHERE r.backup = 'LATEST'
    UNION ALL
    SELECT r.request_id, r.store, r.backup,
      CASE WHEN r.target_time IS NULL OR k.started < r.target_time THEN k.name END AS resolved,
      CASE WHEN s.store IS NULL THEN 'no backups' WHEN k.name IS NULL THEN 'not found'
        WHEN k.started >= r.target_time THEN 'not before target' END AS reason
    FROM restore_requests r LEFT JOIN known k ON k.store = r.store AND k.norm = lower(replace(r.backup, '_', '-'))
      LEFT JOIN stores s ON s.store = r.store
    WHERE r.backup <> 'LATEST'""",
)
def resolve_backup(t: Tables) -> DataFrame:
    return backups.resolve_backup(t["restore_requests"], t["base_backups"])


@query(
    "exact_requests",
    "base_backups",
    sql="""
    SELECT r.request_id, r.store, r.backup, CASE WHEN b.started < r.target_time THEN b.name END AS resolved,
      CASE WHEN b.name IS NULL THEN 'not found' WHEN b.started >= r.target_time THEN 'not before target' END AS reason
    FROM exact_requests r LEFT JOIN base_backups b ON b.store = r.store AND lower(replace(b.name, '_', '-')) = r.backup""",
)
def resolve_named_backup(t: Tables) -> DataFrame:
    """Requests by the names a listing shows, around the target time."""
    return backups.resolve_backup(t["exact_requests"], t["base_backups"])


@query(
    sql="""
    SELECT o_orderstatus, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS keys, true AS has_bytes
    FROM orders GROUP BY 1"""
)
def export_sizes(t: Tables) -> DataFrame:
    """A compressed export per status, read back and set against its file sizes."""
    folder = work_folder(t.spark, "export")
    stamp = "20240201_000000"
    sizes = export(t["orders"], folder, "o_orderstatus", stamp, "gzip", 6)
    back = t.spark.read.csv(f"{folder}/{stamp}", header=True).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("o_orderkey").cast("bigint")).alias("keys"),
    )
    return back.join(sizes, "o_orderstatus").select(
        "o_orderstatus", "n_rows", "keys", (F.col("bytes") > 0).alias("has_bytes")
    )

"""Operator inputs derived from the test tables, as SQL that Spark and DuckDB both run.

Each text reads whole tables named in braces.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-02-01 00:00:00"

ADAPTERS = {
    "activity": """
SELECT concat('h', user_id % 3) AS unit, event_id AS pid, concat('u', user_id) AS usename,
  CASE WHEN event_type = 'signup' THEN NULL ELSE concat('app', event_id % 5) END AS application_name,
  concat('db', user_id % 7) AS datname,
  CASE event_type WHEN 'click' THEN 'active' WHEN 'view' THEN 'idle'
    WHEN 'error' THEN 'idle in transaction' WHEN 'purchase' THEN 'idle in transaction (aborted)'
    ELSE 'fastpath function call' END AS state,
  event_id % 11 = 0 AS waiting, ts - INTERVAL '1' HOUR AS backend_start, ts AS state_change
FROM {events}""",
    "databases": """
SELECT DISTINCT concat('h', user_id % 3) AS unit, concat('db', user_id % 7) AS datname FROM {events}
UNION ALL SELECT 'h0', 'db_empty' UNION ALL SELECT 'h1', 'db_empty' UNION ALL SELECT 'h1', 'postgres'
UNION ALL SELECT 'h2', 'template0' UNION ALL SELECT 'h3', 'template1'""",
    "table_stats": """
SELECT concat('db', l_suppkey % 7) AS datname, concat('s', l_suppkey % 3) AS schemaname,
  concat('t', l_partkey % 50) AS relname, count(*) AS n_tup_ins,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n_tup_upd,
  nullif(count(CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 1 END), 0) AS n_dead_tup,
  max(l_shipdate) AS last_vacuum
FROM {lineitem} GROUP BY 1, 2, 3""",
    "servers": """
SELECT concat('h', c_custkey) AS unit, c_nationkey AS connections,
  CASE c_custkey % 6 WHEN 0 THEN '9.1' WHEN 1 THEN '9.3' WHEN 2 THEN '9.10' WHEN 3 THEN '10'
    WHEN 4 THEN '9.2.24' ELSE '12.1' END AS version
FROM {customer}""",
    "fleet_versions": """
SELECT DISTINCT concat('h', user_id % 3) AS unit, CASE user_id % 3 WHEN 0 THEN '9.1' WHEN 1 THEN '9.3' ELSE '12.1' END AS version
FROM {events}""",
    "fleet_writers": """
SELECT concat('h', s_suppkey) AS unit, '9.1' AS version, s_nationkey AS checkpoints,
  CASE s_suppkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN '1.5' ELSE NULL END AS note, s_name AS stats_reset
FROM {supplier}""",
    "part_gauges": """
SELECT concat('app.', p_brand, '/', p_partkey) AS unit, concat('parts.', p_type, '.size') AS metric,
  CAST(p_size AS DOUBLE) AS value
FROM {part}""",
    "gauges": """
SELECT concat('databases.db', user_id % 7, '.u', user_id) AS metric, value, ts AS sampled_at,
  event_id AS sample_id
FROM {events}""",
    "units": "SELECT concat('h', s_suppkey) AS unit FROM {supplier}",
    "file_inventory": """
SELECT concat('h', l_suppkey) AS unit,
  concat('/data/', CASE WHEN l_linenumber % 2 = 0 THEN '9.5/main/pg_xlog' ELSE '12/main/pg_wal' END,
    '/archive_status/', l_orderkey, '-', l_linenumber,
    CASE WHEN l_returnflag = 'R' THEN '.ready' ELSE '.done' END) AS path,
  l_shipdate + (l_partkey % 86400) * INTERVAL '1' SECOND AS mtime
FROM {lineitem}""",
    "backup_runs": """
SELECT concat('h', c_custkey) AS unit, c_mktsegment <> 'MACHINERY' AS is_master,
  max(o_orderdate) AS last_success
FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY 1, 2""",
    "backup_files": """
SELECT concat('h', o_custkey % 20) AS unit,
  concat('/backups/', CASE WHEN o_orderkey % 5 = 4 THEN 'globals' ELSE concat('db', o_orderkey % 5) END, '.',
    year(o_orderdate), lpad(CAST(month(o_orderdate) AS STRING), 2, '0'),
    lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '_', lpad(CAST(o_orderkey % 24 AS STRING), 2, '0'), '0000',
    CASE WHEN o_orderkey % 5 = 4 THEN '.sql' WHEN o_orderkey % 3 = 0 THEN '.dump'
      WHEN o_orderkey % 3 = 1 THEN '.dump.gz' ELSE '.dump.xz' END) AS path,
  CAST(floor(o_totalprice * 100) AS BIGINT) AS size,
  o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS mtime, o_orderkey AS file_id
FROM {orders}""",
    "free_space": """
SELECT concat('h', c_custkey % 20) AS unit,
  CAST(sum(CAST(floor(abs(c_acctbal)) AS BIGINT)) AS BIGINT) % 150000 AS free_kib
FROM {customer} GROUP BY 1""",
    "base_backups": """
SELECT concat('s', o_custkey) AS store, concat('base_', hex(o_orderkey)) AS name,
  o_orderdate AS started, CAST(floor(o_totalprice * 100) AS BIGINT) AS size_bytes
FROM {orders}""",
    "restore_requests": """
SELECT event_id AS request_id, concat('s', user_id * 11 % 1700) AS store,
  CASE WHEN event_id % 3 = 0 THEN concat('base_', hex(event_id)) ELSE 'LATEST' END AS backup,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts - INTERVAL '9300' DAY END AS target_time
FROM {events}""",
    "exact_requests": """
SELECT o_orderkey AS request_id, concat('s', o_custkey) AS store,
  concat('base-', lower(hex(o_orderkey))) AS backup,
  o_orderdate + (o_orderkey % 3 - 1) * INTERVAL '1' DAY AS target_time
FROM {orders}""",
    "replicas": """
SELECT concat('c', o_custkey % 50) AS cluster, concat('c', o_custkey % 50, '/', o_orderkey) AS unit,
  o_orderkey AS number, CASE WHEN o_orderkey % 13 = 0 THEN NULL
    WHEN o_orderkey % 29 = 0 THEN 'zz/1' WHEN o_orderkey % 31 = 0 THEN '1/2/3' WHEN o_orderkey % 37 = 0 THEN '/'
    ELSE concat(hex(o_custkey % 4096), '/', hex(o_orderkey * 65536)) END AS position,
  CASE o_orderstatus WHEN 'P' THEN concat('c', o_custkey % 50, '/0') WHEN 'O' THEN '' ELSE NULL END AS following
FROM {orders}""",
    "masters": """
SELECT concat('c', o_custkey % 50) AS cluster,
  concat(hex(max(o_custkey) % 4096), '/', hex(CAST(floor(avg(o_orderkey)) AS BIGINT) * 65536)) AS position
FROM {orders} WHERE o_custkey % 50 <> 7 GROUP BY 1""",
    "position_samples": """
SELECT concat('h', user_id) AS unit, ts, event_id AS sample_id,
  CASE WHEN event_type = 'signup' THEN NULL
    ELSE concat(hex(user_id % 16), '/', hex(length(event_type) * 4096)) END AS position
FROM {events}""",
    "following_units": """
SELECT concat('h', s_suppkey) AS unit, concat('n', s_nationkey) AS parent,
  concat('10.0.0.', s_suppkey) AS address
FROM {supplier}""",
    "stat_replication": """
SELECT concat('n', o_custkey % 25) AS unit, concat('10.0.0.', o_orderkey % 1000) AS client_addr
FROM {orders}""",
    "master_rows": """
SELECT concat('c', o_custkey % 5) AS cluster, CASE WHEN o_orderkey % 41 > 0 THEN o_orderkey END AS token FROM {orders}""",
    "listed_units": """
SELECT DISTINCT concat('c', o_custkey % 5) AS cluster, concat('copy/', o_orderkey % 3 + 1) AS unit FROM {orders}""",
    "copied_rows": """
SELECT concat('c', o_custkey % 5) AS cluster, 'copy/1' AS unit, CASE WHEN o_orderkey % 41 > 0 THEN o_orderkey END AS token FROM {orders}
UNION ALL SELECT concat('c', o_custkey % 5), 'gone/9', o_orderkey FROM {orders} WHERE o_orderstatus = 'P'
UNION ALL SELECT concat('c', o_custkey % 5), 'copy/2', CASE WHEN o_orderkey % 41 > 0 THEN o_orderkey END FROM {orders} WHERE o_orderstatus <> 'P' AND o_custkey % 5 <> 3
UNION ALL SELECT concat('c', o_custkey % 5), 'copy/3', o_orderkey FROM {orders} WHERE o_totalprice > 20000""",
    "cluster_units": """
SELECT b.cluster, concat(b.cluster, '/', c_custkey) AS unit, c_custkey AS number,
  c_nationkey % 7 = 3 AS manual,
  CASE WHEN c_nationkey % 5 = 0 THEN concat(b.cluster, '/gone') ELSE concat(b.cluster, '/', low) END AS master,
  CASE c_nationkey % 4 WHEN 1 THEN concat(b.cluster, '/', high) WHEN 2 THEN concat(b.cluster, '/gone') ELSE NULL END AS anointed,
  CASE WHEN c_nationkey % 11 = 4 THEN NULL ELSE concat('10.0.', c_nationkey, '.', c_custkey % 250) END AS host,
  concat(b.cluster, '/', high, ' ', b.cluster, '/', mid) AS allowed_units,
  CASE WHEN c_custkey % 17 <> 5 THEN c_custkey <> low AND c_custkey % 9 <> 4 END AS in_recovery,
  CASE WHEN c_custkey % 19 <> 2 THEN c_custkey % 3 <> 1 END AS was_cloned, CASE WHEN c_custkey % 23 <> 3 THEN c_custkey % 2 = 0 END AS had_peers
FROM (SELECT c_custkey, c_nationkey,
        CASE WHEN c_acctbal > 9000 THEN concat('solo', c_custkey) ELSE concat('n', c_nationkey) END AS cluster
      FROM {customer}) b
JOIN (SELECT CASE WHEN c_acctbal > 9000 THEN concat('solo', c_custkey) ELSE concat('n', c_nationkey) END AS cluster,
        min(c_custkey) AS low, max(c_custkey) AS high,
        max(CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey ELSE 0 END) AS mid
      FROM {customer} GROUP BY 1) m ON b.cluster = m.cluster""",
    "published_states": """
SELECT concat('c', o_custkey % 50) AS cluster, concat('c', o_custkey % 50, '/', o_orderkey) AS unit,
  o_orderkey AS number,
  CASE WHEN o_totalprice > 150000 THEN 'master' ELSE 'hot standby' END AS state,
  CASE o_custkey % 50 % 3 WHEN 0 THEN concat('c', o_custkey % 50, '/1') WHEN 1 THEN '' ELSE NULL END AS recorded
FROM {orders}""",
    "setting_layers": """
SELECT concat('h', l_orderkey % 200) AS unit, concat('opt', l_partkey % 40) AS name, l_linenumber % 4 AS layer,
  l_orderkey * 10 + l_linenumber AS ord,
  CASE l_linenumber % 5 WHEN 0 THEN 'on' WHEN 1 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' MB')
    WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS STRING) WHEN 3 THEN concat('0.', CAST(CAST(l_quantity AS INT) AS STRING))
    ELSE l_linestatus END AS value
FROM {lineitem}""",
    "catalogue": """
SELECT concat('opt', p_partkey % 35) AS name,
  CASE p_partkey % 35 % 5 WHEN 0 THEN 'bool' WHEN 1 THEN 'enum' WHEN 2 THEN 'integer' WHEN 3 THEN 'real' ELSE 'string' END AS vartype,
  CASE WHEN p_partkey % 35 % 10 = 2 THEN '8kB' ELSE NULL END AS unit,
  CASE WHEN p_partkey % 35 % 5 IN (2, 3) THEN '1' ELSE NULL END AS min_val,
  CASE WHEN p_partkey % 35 % 5 IN (2, 3) THEN CAST(CAST(floor(avg(p_size)) AS BIGINT) AS STRING) ELSE NULL END AS max_val,
  CASE WHEN p_partkey % 35 % 5 = 1 THEN 'o,f' ELSE NULL END AS enumvals_csv,
  CASE WHEN p_partkey % 35 % 4 = 0 THEN 'postmaster' ELSE 'sighup' END AS context
FROM {part} GROUP BY p_partkey % 35""",
    "catalogue_records": """
SELECT concat('Opt', p_partkey) AS name, CASE WHEN p_size > 25 THEN 'kB' ELSE NULL END AS unit,
  p_type AS category, p_name AS short_desc,
  CASE p_type WHEN 'SMALL' THEN 'internal' WHEN 'PROMO' THEN 'postmaster' ELSE 'sighup' END AS context,
  'integer' AS vartype, CAST(p_size AS STRING) AS max_val
FROM {part}""",
    "setting_lines": """
SELECT concat('h', l_orderkey % 200) AS unit, l_orderkey * 10 + l_linenumber AS lineno,
  CASE l_linenumber WHEN 1 THEN concat('Key_', l_partkey % 9, ' = ', l_suppkey)
    WHEN 2 THEN concat('key_', l_partkey % 9, '=''it''''s ', l_suppkey, '''  # note') WHEN 3 THEN '# comment'
    WHEN 4 THEN concat('key_', l_partkey % 9, '=') WHEN 5 THEN '='
    WHEN 6 THEN concat('key_', l_partkey % 9, '=''open') ELSE '' END AS line
FROM {lineitem}""",
    "setting_texts": """
SELECT l_orderkey, l_linenumber, l_partkey,
  concat('# some', chr(10), CASE l_linenumber % 3 WHEN 0 THEN concat(' Port = ', l_suppkey, ' # x')
    WHEN 1 THEN concat('port=''', l_partkey, '''') ELSE 'shared_buffers = 4' END, chr(10), 'end = 1') AS text
FROM {lineitem}""",
    "quantities": """
SELECT p_partkey,
  concat(CASE WHEN p_partkey % 19 = 0 THEN 'x' ELSE '' END, p_size, CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE '' END,
    CASE p_partkey % 12 WHEN 0 THEN 'kB' WHEN 1 THEN '' WHEN 2 THEN 'MB' WHEN 3 THEN 'GB' WHEN 4 THEN 'TB'
      WHEN 5 THEN 'ms' WHEN 6 THEN 's' WHEN 7 THEN 'min' WHEN 8 THEN 'h' WHEN 9 THEN 'd' WHEN 10 THEN 'KB' ELSE '8kB' END) AS text,
  CASE WHEN p_partkey % 12 BETWEEN 5 AND 9 THEN CASE WHEN p_partkey % 7 = 0 THEN 'MB' ELSE 'min' END
    ELSE CASE WHEN p_partkey % 7 = 0 THEN 'ms' WHEN p_partkey % 7 < 4 THEN '8kB' ELSE 'MB' END END AS unit
FROM {part}""",
    "unit_profile": """
SELECT concat('app/', p_partkey) AS unit, CASE WHEN p_partkey % 43 <> 0 THEN p_partkey * 37 % 50000 END AS ram_mb,
  CASE WHEN p_partkey % 47 = 0 THEN NULL WHEN p_partkey % 53 = 0 THEN 'devel' ELSE CASE p_partkey % 4 WHEN 0 THEN '9.3' WHEN 1 THEN '9.5' WHEN 2 THEN '10' ELSE '12' END END AS version,
  CASE WHEN p_partkey % 59 <> 0 THEN CAST(p_size % 4 AS BIGINT) END AS standbys,
  CASE WHEN p_size > 30 THEN CAST(p_size AS BIGINT) ELSE NULL END AS max_wal_senders,
  CASE WHEN p_size > 10 THEN CAST(p_size AS BIGINT) * 5 ELSE NULL END AS max_connections,
  CASE WHEN p_size > 20 THEN CAST(p_size AS BIGINT) * 20 ELSE NULL END AS wal_keep_segments,
  CAST(500 AS BIGINT) AS replicated_wal_keep_segments,
  CASE WHEN p_size > 40 THEN 's3://bucket' WHEN p_size > 35 THEN '' ELSE NULL END AS archive_uri,
  p_type = 'PROMO' AS forwards_logs
FROM {part}""",
    "live_settings": """
SELECT concat(CASE o_orderstatus WHEN 'P' THEN 'p' ELSE 'h' END, o_custkey) AS unit,
  concat('opt', o_orderkey % 40) AS name, max(o_orderpriority) AS value
FROM {orders} GROUP BY 1, 2""",
    "current_settings": """
SELECT concat(CASE o_orderpriority WHEN '5-LOW' THEN 'q' ELSE 'h' END, o_custkey) AS unit,
  concat('opt', o_orderkey % 40) AS name,
  max(CASE WHEN o_totalprice > 400000 THEN 'moved' ELSE o_orderpriority END) AS value
FROM {orders} WHERE o_orderstatus <> 'P' GROUP BY 1, 2""",
    "option_values": """
SELECT concat('h', p_partkey) AS unit,
  CASE p_partkey % 7 WHEN 0 THEN 'max_connections' WHEN 1 THEN 'listen_port' WHEN 2 THEN 'collapse_limit'
    WHEN 3 THEN 'work_mem' WHEN 4 THEN 'checkpoint_segments' WHEN 5 THEN 'backup_dir' ELSE 'fsync' END AS name,
  CAST(p_size % 5 - 1 AS STRING) AS value
FROM {part}""",
    "options": """
SELECT CASE p_partkey % 7 WHEN 0 THEN 'max_connections' WHEN 1 THEN 'listen_port' WHEN 2 THEN 'collapse_limit'
    WHEN 3 THEN 'work_mem' WHEN 4 THEN 'checkpoint_segments' WHEN 5 THEN 'backup_dir' ELSE 'fsync' END AS name,
  CAST(min(p_size) % 3 AS STRING) AS "default",
  CASE WHEN p_partkey % 7 = 5 THEN 'A folder.' ELSE 'DEPRECATED. Use another.' END AS description
FROM {part} GROUP BY p_partkey % 7""",
    "known_settings": """
SELECT CASE p_partkey % 4 WHEN 0 THEN 'max_connections' WHEN 1 THEN 'work_mem' WHEN 2 THEN 'fsync' ELSE 'port' END AS name
FROM {part} GROUP BY p_partkey % 4""",
    "managed_texts": """
SELECT doc_id, concat('Port = 1', chr(10), text, chr(10), ' work_mem = 4MB # keep', chr(10),
  '### BEGIN JUJU SETTINGS ###', chr(10), 'port = ', doc_id, chr(10), '### END JUJU SETTINGS ###', chr(10), chr(10), 'fsync on') AS text
FROM {documents}""",
    "managed_settings": """
SELECT doc_id, 'port' AS name, CAST(n_chars AS STRING) AS value FROM {documents}
UNION ALL SELECT doc_id, CASE lang WHEN 'en' THEN 'fsync' ELSE 'work_mem' END, concat('it''s ', CASE WHEN doc_id % 50 = 7 THEN chr(10) ELSE '' END, source) FROM {documents}
WHERE n_chars > 500""",
    "version_facts": """
SELECT concat('h', c_custkey) AS unit, CASE WHEN c_custkey % 5 = 0 THEN '9.6' WHEN c_custkey % 5 = 1 THEN '' ELSE NULL END AS cached,
  CASE c_custkey % 3 WHEN 0 THEN '10' WHEN 1 THEN '9.5,11' ELSE '' END AS installed_csv,
  CASE WHEN c_acctbal > 5000 THEN '12' WHEN c_acctbal > 2500 THEN '' ELSE NULL END AS configured,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'xenial' WHEN 'MACHINERY' THEN 'bionic' WHEN 'HOUSEHOLD' THEN 'focal' ELSE 'trusty' END AS release
FROM {customer}""",
    "option_changes": """
SELECT concat('h', c_custkey) AS unit,
  CASE c_custkey % 7 WHEN 0 THEN '9.5' WHEN 1 THEN '10' WHEN 2 THEN '8.4' WHEN 3 THEN NULL ELSE '' END AS version,
  CASE c_custkey % 7 WHEN 0 THEN '9.5' WHEN 1 THEN '9.6' WHEN 2 THEN '8.4' ELSE '' END AS prev_version,
  CASE WHEN c_nationkey < 12 THEN '9.6' ELSE '' END AS running_version,
  CASE c_custkey % 6 WHEN 0 THEN 'HOLD' WHEN 1 THEN 'drop' ELSE 'install' END AS package_status,
  CASE WHEN c_custkey % 8 = 0 THEN 'en' ELSE 'C' END AS locale, 'C' AS prev_locale,
  'UTF-8' AS encoding, CASE WHEN c_custkey % 9 = 0 THEN 'ASCII' ELSE 'UTF-8' END AS prev_encoding,
  c_custkey % 10 = 0 AS manual_replication, false AS prev_manual_replication,
  CASE WHEN c_acctbal > 5000 THEN 'stats:8125' WHEN c_acctbal > 2500 THEN ' stats ' ELSE '' END AS metrics_target,
  CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 5 END AS metrics_sample_interval,
  c_mktsegment <> 'BUILDING' AS installed
FROM {customer}""",
    "stores": """
SELECT concat('h', c_custkey) AS unit,
  CASE c_custkey % 6 WHEN 0 THEN concat('s3://b/', c_custkey) WHEN 1 THEN 'swift://c/d' WHEN 2 THEN 'WABS://e' WHEN 3 THEN 'ftp://f'
    WHEN 4 THEN '' ELSE NULL END AS uri,
  CASE WHEN c_acctbal > 3000 THEN 'x' ELSE ' ' END AS v1,
  CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 'y' END AS v2,
  CASE WHEN c_nationkey < 10 THEN '' ELSE 'z' END AS v3
FROM {customer}""",
    "relations": """
SELECT concat('r', n_regionkey) AS cluster,
  CASE c_custkey % 4 WHEN 0 THEN 'db' WHEN 1 THEN 'db-admin' WHEN 2 THEN 'master' ELSE 'replication' END AS relname,
  c_nationkey AS relid, lower(replace(n_name, '_', '-')) AS service, c_custkey AS number,
  concat(lower(replace(n_name, '_', '-')), '/', c_custkey) AS unit,
  CASE c_custkey % 5 WHEN 0 THEN concat('10.', c_nationkey, '.0.0/16, 10.0.', c_custkey % 250, '.0/24') WHEN 1 THEN '' ELSE NULL END AS egress,
  CASE WHEN c_custkey % 5 = 2 THEN concat('fe80::', c_custkey) ELSE NULL END AS ingress,
  CASE WHEN c_custkey % 5 <> 4 THEN concat('192.168.', c_nationkey, '.', c_custkey % 250) ELSE NULL END AS private,
  CASE WHEN c_nationkey % 6 = 5 THEN NULL ELSE concat('data "', c_nationkey, '"') END AS database,
  CASE WHEN c_nationkey % 8 = 7 THEN NULL ELSE concat('login_', c_nationkey) END AS user,
  CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE concat('schema_', c_nationkey) END AS schema_user
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "peers": """
SELECT concat('r', n_regionkey) AS cluster, concat('pg/', s_suppkey) AS unit, s_suppkey AS number,
  CASE WHEN s_acctbal > 7000 THEN concat('10.9.', s_suppkey % 250, '.1/32') ELSE NULL END AS egress,
  CASE WHEN s_acctbal > 5000 THEN concat('10.8.', s_suppkey % 250, '.1') ELSE NULL END AS ingress,
  CASE WHEN s_acctbal > 0 THEN concat('10.7.', s_suppkey % 250, '.1') ELSE NULL END AS private
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "cluster_config": """
SELECT concat('r', n_regionkey) AS cluster,
  concat('192.168.', n_regionkey, '.0/24,,10.0.0.', max(n_nationkey)) AS admin_addresses,
  CASE WHEN n_regionkey % 2 = 0 THEN concat('local all sso', n_regionkey, ' md5,local all x md5')
    ELSE concat('host a', n_regionkey, ' b, c d', chr(10), '# done') END AS extra_rules,
  CASE WHEN n_regionkey = 2 THEN 'ALL' ELSE 'CONNECT,,TEMPORARY,CONNECT' END AS privileges
FROM {nation} GROUP BY n_regionkey""",
    "endpoints": """
SELECT concat('r', CAST(floor(c_nationkey / 5) AS INT)) AS cluster,
  CASE c_custkey % 3 WHEN 0 THEN 'db' WHEN 1 THEN 'db-admin' ELSE 'master' END AS relname, c_nationkey % 5 AS relid,
  concat('pg/', c_custkey) AS unit, c_custkey AS number, c_custkey = low AS is_master,
  concat('10.1.', c_nationkey, '.', c_custkey % 250) AS host,
  CASE WHEN c_custkey % 11 = 3 THEN '' ELSE '5432' END AS port, concat('db', c_nationkey) AS database,
  CASE WHEN c_custkey % 13 = 5 THEN NULL ELSE 'app' END AS user, concat('p w''', c_nationkey) AS password
FROM {customer} JOIN (SELECT c_nationkey AS nk, c_custkey % 3 AS kind, min(c_custkey) AS low FROM {customer} GROUP BY 1, 2) m
  ON c_nationkey = nk AND c_custkey % 3 = kind""",
    "wanted_roles": """
SELECT concat('r', c_custkey % 3) AS cluster, concat('a', CAST(floor(c_custkey / 3) AS BIGINT)) AS account, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '1-URGENT,,5-LOW'
  WHEN 2 THEN '2-HIGH,reader' ELSE '3-MEDIUM,5-LOW' END AS roles
FROM {customer}""",
    "roles": """
SELECT concat('r', c_custkey % 3) AS cluster, CAST(floor(c_custkey / 3) AS BIGINT) AS oid, concat('a', CAST(floor(c_custkey / 3) AS BIGINT)) AS rolname FROM {customer}
UNION ALL SELECT DISTINCT concat('r', o_custkey % 3), -CAST(substring(o_orderpriority, 1, 1) AS BIGINT), o_orderpriority FROM {orders}""",
    "memberships": """
SELECT concat('r', o_custkey % 3) AS cluster, CAST(floor(o_custkey / 3) AS BIGINT) AS member, -CAST(substring(o_orderpriority, 1, 1) AS BIGINT) AS roleid FROM {orders}""",
    "wanted_extensions": """
SELECT concat('db', s_suppkey % 40) AS datname, CASE s_suppkey % 3 WHEN 0 THEN ' Brand#1, Brand#2(SMALL)'
  WHEN 1 THEN concat('Brand#3(LARGE),,citext,(x, ,Brand#4(SMALL PROMO),Brand#1 ( SMALL ),Brand#5', chr(9), '(PROMO) x') ELSE 'Brand#5 (PROMO),Brand#4' END AS extensions
FROM {supplier}""",
    "installed_extensions": """
SELECT DISTINCT concat('db', p_partkey % 40) AS datname, p_brand AS extname,
  CASE WHEN p_size < 30 THEN 'public' ELSE p_type END AS extnamespace
FROM {part}""",
    "namespaces": """
SELECT DISTINCT concat('db', p_partkey % 40) AS datname, p_type AS oid, p_type AS nspname FROM {part}
UNION ALL SELECT DISTINCT concat('db', p_partkey % 40), 'public', 'public' FROM {part}""",
    "known_accounts": """
SELECT DISTINCT concat('r', c_custkey % 5) AS cluster, concat(CASE c_custkey % 4 WHEN 0 THEN 'juju_' WHEN 1 THEN 'jujuadmin_' ELSE 'jujurepl_' END,
  'nation-', c_nationkey) AS account
FROM {customer} WHERE c_acctbal > 9500""",
    "rule_texts": """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat('local all a', p_partkey, ' md5,local all b md5')
  WHEN 1 THEN concat('local all sso md5,', chr(10), 'local all c', p_partkey, ' md5')
  WHEN 2 THEN concat('host x y, z ', p_size, chr(10), '# note') WHEN 3 THEN concat('host ', p_name) ELSE '' END AS text
FROM {part}""",
    "database_requests": """
SELECT concat('r', CAST(floor(c_nationkey / 5) AS INT)) AS cluster,
  CASE c_custkey % 3 WHEN 0 THEN 'db' WHEN 1 THEN 'db-admin' ELSE 'master' END AS relname, c_nationkey % 5 AS relid,
  concat(lower(replace(n_name, '_', '-')), '/', c_custkey) AS unit, c_custkey AS number,
  CASE WHEN c_acctbal > 4000 THEN concat('asked_', c_custkey) ELSE NULL END AS requested,
  CASE WHEN c_nationkey % 4 = 1 THEN 'all' WHEN c_nationkey % 2 = 0 THEN concat('published_', c_nationkey) ELSE NULL END AS published
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "published_keys": """
SELECT concat('r', CAST(floor(c_nationkey / 5) AS INT)) AS cluster,
  CASE c_custkey % 3 WHEN 0 THEN 'db' WHEN 1 THEN 'db-admin' ELSE 'master' END AS relname, c_nationkey % 5 AS relid,
  concat('pg/', c_custkey) AS unit, concat('pg/', low) AS leader, concat('db', c_nationkey) AS database,
  concat('u', c_custkey) AS user, concat('p', c_custkey) AS password, c_mktsegment AS roles,
  concat('su', c_custkey) AS schema_user, concat('sp', c_custkey) AS schema_password,
  CASE WHEN c_custkey % 2 = 0 THEN 'citext' ELSE NULL END AS extensions
FROM {customer} JOIN (SELECT c_nationkey AS nk, min(c_custkey) AS low FROM {customer} GROUP BY 1) m ON c_nationkey = nk""",
    "ident_texts": """
SELECT concat('h', s_suppkey) AS unit, concat('# map', chr(10), CASE WHEN s_acctbal > 5000 THEN ' juju_charm  root postgres ' ELSE 'juju_charm root postgresql' END,
  chr(10), CASE WHEN s_suppkey % 2 = 0 THEN 'juju_charm postgres postgres' ELSE '# juju_charm postgres postgres' END) AS text
FROM {supplier}""",
    "rules_files": """
SELECT doc_id, concat(text, chr(10), '### BEGIN JUJU SETTINGS ###', chr(10), 'local all all peer', chr(10),
  '### END JUJU SETTINGS ###', chr(10), chr(10), '  host all all all md5', chr(10), '# kept') AS text
FROM {documents}""",
    "logs": """
SELECT event_id, concat('unit_', user_id % 5) AS program,
  concat(year(ts), '-', lpad(CAST(month(ts) AS STRING), 2, '0'), '-', lpad(CAST(day(ts) AS STRING), 2, '0'), ' ',
    lpad(CAST(hour(ts) AS STRING), 2, '0'), ':', lpad(CAST(minute(ts) AS STRING), 2, '0'), ':',
    lpad(CAST(CAST(floor(second(ts)) AS INT) AS STRING), 2, '0'), ' UTC [', event_id, ']: [', event_id % 9 + 1,
    '-1] db=db', user_id % 7, CASE WHEN event_type = 'view' THEN ';' ELSE ',' END, 'user=u', user_id, ' LOG:  ', event_type) AS line
FROM {events}""",
    "routes": """
SELECT DISTINCT concat('unit_', s_suppkey % 7) AS program, concat('10.3.', s_nationkey % 3, '.1') AS destination
FROM {supplier}""",
    "route_changes": """
SELECT concat('unit_', user_id % 5) AS program, concat('10.4.', event_id % 3, '.1') AS destination, ts AS valid_from,
  coalesce(lead(ts) OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id), ts + INTERVAL '2' DAY) AS valid_to
FROM {events} WHERE event_type = 'signup'""",
    "timed_logs": """
SELECT event_id, concat('unit_', user_id % 5) AS program, ts, event_type AS line FROM {events}""",
    "status_events": """
SELECT event_id, concat('h', user_id) AS unit, ts,
  CASE event_type WHEN 'click' THEN 'active' WHEN 'view' THEN 'waiting' WHEN 'error' THEN 'blocked'
    WHEN 'purchase' THEN 'maintenance' ELSE NULL END AS state
FROM {events}""",
    "role_events": """
SELECT event_id, concat('h', user_id) AS unit, ts, event_type IN ('click', 'purchase') AS is_primary,
  event_type = 'click' AND event_id % 5 = 0 AS is_master, event_id % 7 = 0 AS is_anointed,
  CASE WHEN event_id % 11 <> 0 THEN event_id % 4 <> 0 AND event_id > 60 END AS has_peers, event_id % 3 = 0 AS master_peered
FROM {events}""",
    "target_values": """
SELECT event_id, concat('h', user_id) AS unit, ts,
  CASE WHEN event_type IN ('click', 'view') THEN 'stats:8125' WHEN event_type = 'error' THEN NULL ELSE '' END AS target
FROM {events}""",
}

BASE_TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
)


def tables_of(name: str) -> list[str]:
    """Base tables an adapter reads."""
    return sorted({f for _, f, _, _ in string.Formatter().parse(ADAPTERS[name]) if f})


def oracle_text(name: str) -> str:
    """An adapter as DuckDB SQL over the registered views."""
    return ADAPTERS[name].format(**{t: t for t in tables_of(name)})


class Tables:
    """Frames of one data folder: base tables by name, adapters by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def path(self, table: str) -> str:
        return f"{self.folder.rstrip('/')}/{table}.parquet"

    def __getitem__(self, name: str) -> DataFrame:
        if name in ADAPTERS:
            return self.adapt(name)
        return self.spark.read.parquet(self.path(name))

    def adapt(self, name: str, **frames: DataFrame) -> DataFrame:
        """An adapter over the base tables, with some of them replaced (by a stream, say)."""
        text = ADAPTERS[name].replace('"default"', "`default`")
        base = {t: frames[t] if t in frames else self[t] for t in tables_of(name)}
        return self.spark.sql(text, **base)

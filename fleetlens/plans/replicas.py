"""Queries over replication health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import lsn_bytes as lsn
from fleetlens.operators import replication
from fleetlens.plans.adapters import Tables
from fleetlens.plans.registry import query


def _bytes(column: str, scale: int = 255) -> str:
    def half(i: int) -> str:
        return f"CAST(TRY_CAST(concat('0x', split_part({column}, '/', {i})) AS UBIGINT) AS HUGEINT)"

    return f"CAST(CASE WHEN length({column}) - length(replace({column}, '/', '')) = 1 THEN {half(1)} * 16777216 * {scale} + {half(2)} END AS DECIMAL(38,0))"


@query(
    "replicas",
    sql=f"""
    SELECT cluster, unit, {_bytes('position')} AS offset_bytes, {_bytes('position', 256)} AS wide_bytes FROM replicas""",
)
def lsn_bytes(t: Tables) -> DataFrame:
    position = F.col("position")
    return t["replicas"].select(
        "cluster",
        "unit",
        lsn(position).alias("offset_bytes"),
        lsn(position, legacy=False).alias("wide_bytes"),
    )


@query(
    "replicas",
    "masters",
    sql=f"""WITH p AS (SELECT r.cluster, r.unit, {_bytes('r.position')} AS here, {_bytes('m.position')} AS there
      FROM replicas r LEFT JOIN masters m ON m.cluster = r.cluster)
    SELECT cluster, unit, CAST(there - here AS DECIMAL(38,0)) AS lag, coalesce(here >= there, false) AS in_sync FROM p""",
)
def lag_bytes(t: Tables) -> DataFrame:
    return replication.lag_bytes(t["replicas"], t["masters"])


@query(
    "position_samples",
    sql="""WITH looked AS (SELECT *, lag(position) OVER (PARTITION BY unit ORDER BY ts, sample_id) AS prev FROM position_samples)
    SELECT unit, arg_min(position, (ts, sample_id)) AS position, min(ts) AS settled_at
    FROM looked WHERE position = prev GROUP BY unit""",
)
def settled(t: Tables) -> DataFrame:
    return replication.settled(t["position_samples"])


@query(
    "replicas",
    sql=f"""WITH p AS (SELECT *, {_bytes('position')} AS o FROM replicas)
    SELECT cluster, arg_max(unit, (o, -number)) FILTER (o IS NOT NULL) AS elected, max(o) AS "offset", count(o) = 0 AS blocked
    FROM p GROUP BY cluster""",
)
def elect(t: Tables) -> DataFrame:
    return replication.elect(t["replicas"])


@query(
    "replicas",
    sql="""
    SELECT cluster, count(*) FILTER (following <> '') AS n_waiting, count(*) FILTER (following <> '') = 0 AS proceed
    FROM replicas GROUP BY cluster""",
)
def barrier(t: Tables) -> DataFrame:
    return replication.barrier(t["replicas"])


@query(
    "replicas",
    sql="""
    SELECT DISTINCT cluster, unit, number FROM replicas WHERE following <> ''""",
)
def waiting_on(t: Tables) -> DataFrame:
    return replication.waiting_on(t["replicas"])


@query(
    "replicas",
    sql="""
    SELECT cluster, unit, position FROM replicas
    WHERE position IS NOT NULL AND (len(string_split(position, '/')) <> 2 OR TRY_CAST(concat('0x', split_part(position, '/', 1)) AS UBIGINT) IS NULL
      OR TRY_CAST(concat('0x', split_part(position, '/', 2)) AS UBIGINT) IS NULL)""",
)
def malformed_positions(t: Tables) -> DataFrame:
    return replication.malformed_positions(t["replicas"])


@query(
    "following_units",
    "stat_replication",
    sql="""
    SELECT u.*, EXISTS (SELECT 1 FROM stat_replication s WHERE s.unit = u.parent AND s.client_addr = u.address) AS replicating
    FROM following_units u""",
)
def is_replicating(t: Tables) -> DataFrame:
    return replication.is_replicating(t["following_units"], t["stat_replication"])


@query(
    "cluster_units",
    sql="""WITH n AS (SELECT *, CASE WHEN NOT manual THEN master END AS m, CASE WHEN NOT manual THEN anointed END AS a FROM cluster_units),
      f AS (SELECT u.*,
          EXISTS (SELECT 1 FROM n p WHERE p.cluster = u.cluster AND p.unit <> u.unit) AS peers,
          EXISTS (SELECT 1 FROM n p WHERE p.cluster = u.cluster AND p.unit <> u.unit AND p.unit = u.m) AS peered,
          EXISTS (SELECT 1 FROM n p WHERE p.cluster = u.cluster AND p.unit <> u.unit AND p.unit = u.m AND p.host IS NOT NULL
            AND list_contains(string_split(p.allowed_units, ' '), u.unit)) AS authorized,
          CASE WHEN EXISTS (SELECT 1 FROM n p WHERE p.cluster = u.cluster AND p.unit = u.a) THEN a END AS known
        FROM n u),
      g AS (SELECT *, coalesce(unit = m, false) AS is_m, known IS NOT NULL AND known IS DISTINCT FROM m AS sw FROM f),
      h AS (SELECT *, sw AND known = unit AS is_a, coalesce(NOT in_recovery, false) AS prim, CASE WHEN in_recovery IS DISTINCT FROM false
          THEN coalesce(was_cloned, false) WHEN is_m THEN true WHEN sw AND known = unit THEN coalesce(was_cloned, false) ELSE false END AS cl FROM g)
    SELECT cluster, unit, manual, peers AS has_peers, peers OR coalesce(had_peers, false) AS had_peers, is_m AS is_master, peered AS master_peered,
      authorized AS master_authorized, is_m OR authorized AS has_master, sw AS switchover, is_a AS is_anointed,
      prim AS is_primary, cl AS cloned, NOT is_m AND peers AND NOT peered AND cl AS failover,
      CASE WHEN in_recovery IS NULL THEN 'unknown' WHEN in_recovery THEN 'hot standby' WHEN peers THEN 'master' ELSE 'standalone' END AS state,
      CASE WHEN in_recovery IS NULL THEN 'unknown' WHEN is_m THEN 'Live master' WHEN NOT in_recovery THEN 'Live primary' ELSE 'Live secondary' END AS message
    FROM h""",
)
def role_flags(t: Tables) -> DataFrame:
    return replication.role_flags(t["cluster_units"])


@query(
    "role_events",
    sql="""WITH s AS (SELECT *, coalesce(is_primary, false) AS p, coalesce(is_master, false) AS m, coalesce(is_anointed, false) AS a,
        count(*) FILTER (has_peers) OVER w > 0 AS had FROM role_events
        WINDOW w AS (PARTITION BY unit ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
      c AS (SELECT *, coalesce(arg_max(m, (ts, event_id)) FILTER (p AND (m OR NOT a)) OVER w, false) AS cloned FROM s
        WINDOW w AS (PARTITION BY unit ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT unit, ts, event_id, cloned, had AS had_peers,
      NOT m AND coalesce(has_peers, false) AND NOT coalesce(master_peered, false) AND cloned AS failover FROM c""",
)
def role_history(t: Tables) -> DataFrame:
    return replication.role_history(t["role_events"])


@query(
    "master_rows",
    "copied_rows",
    "listed_units",
    sql="""
    SELECT DISTINCT m.cluster, u.unit, m.token FROM master_rows m JOIN listed_units u ON u.cluster = m.cluster
    WHERE NOT EXISTS (SELECT 1 FROM copied_rows c WHERE c.cluster = m.cluster AND c.unit = u.unit AND c.token IS NOT DISTINCT FROM m.token)""",
)
def missing_rows(t: Tables) -> DataFrame:
    """One of the units that hold copies has left its cluster and doesn't count."""
    return replication.missing_rows(t["master_rows"], t["copied_rows"], t["listed_units"], ["token"])


@query(
    "published_states",
    sql="""
    SELECT u.cluster, u.unit, coalesce(nullif(any_value(u.recorded), ''), arg_min(o.unit, o.number), u.unit) AS leader
    FROM published_states u LEFT JOIN published_states o ON o.cluster = u.cluster AND o.unit <> u.unit AND o.state = 'master'
    GROUP BY u.cluster, u.unit""",
)
def discover_leader(t: Tables) -> DataFrame:
    return replication.discover_leader(t["published_states"])

"""Replication positions, leader choice, barriers and role flags."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import is_position, lsn_bytes
from fleetlens.functions.ordered import ROWS_PER_SLICE, look_along, previous, slice_busy_keys
from fleetlens.functions.skew import spread_join, top_rows
from fleetlens.session import work_folder


def lag_bytes(standbys: DataFrame, masters: DataFrame) -> DataFrame:
    """Bytes each standby trails its master by, and whether it has caught up.

    ``standbys(cluster, unit, position)`` against one row per cluster in
    ``masters(cluster, position)``. An unknown position, or no master row at all, means
    an unknown lag and not in sync.
    """
    local, remote = lsn_bytes(F.col("_local")), lsn_bytes(F.col("_remote"))
    return (
        spread_join(
            standbys.select("cluster", "unit", F.col("position").alias("_local")),
            masters.select("cluster", F.col("position").alias("_remote")),
            ["cluster"],
            "left",
        )
        .select(
            "cluster",
            "unit",
            (remote - local).cast("decimal(38,0)").alias("lag"),
            F.coalesce(local >= remote, F.lit(False)).alias("in_sync"),
        )
    )


def settled(
    samples: DataFrame,
    key: str = "unit",
    ts: str = "ts",
    tie: str = "sample_id",
    limit: int = ROWS_PER_SLICE,
) -> DataFrame:
    """First sample per unit whose known position equals the one just before it."""
    looked = previous(
        samples.select(key, ts, tie, "position"), [key], ts, [tie], "position", "_prev", limit
    )
    still = looked.where(F.col("position") == F.col("_prev.was"))
    return still.groupBy(key).agg(
        F.min_by("position", F.struct(ts, tie)).alias("position"), F.min(ts).alias("settled_at")
    )


def elect(units: DataFrame) -> DataFrame:
    """Per cluster, the reachable unit that replayed most; ties go to the lowest number.

    A cluster with no known position is reported as blocked with no unit.
    """
    offset = lsn_bytes(F.col("position"))
    ranked = units.select("cluster", "unit", "number", offset.alias("_offset"))
    return ranked.groupBy("cluster").agg(
        F.max_by(
            "unit",
            F.when(F.col("_offset").isNotNull(), F.struct("_offset", -F.col("number"))),
        ).alias("elected"),
        F.max("_offset").alias("offset"),
        (F.count("_offset") == 0).alias("blocked"),
    )


def _follows() -> Column:
    return F.coalesce(F.col("following") != "", F.lit(False))


def waiting_units(units: DataFrame) -> DataFrame:
    """One row per unit that still follows the lost master."""
    return units.where(_follows()).select("cluster", "unit", "number")


def barrier(units: DataFrame) -> DataFrame:
    """Per cluster: how many units still follow, and whether failover may proceed."""
    waiting = F.count_if(_follows())
    return units.groupBy("cluster").agg(
        waiting.alias("n_waiting"), (waiting == 0).alias("proceed")
    )


def waiting_on(units: DataFrame) -> DataFrame:
    """The waiting units of each cluster: a row for each, in order of ``number, unit``."""
    return waiting_units(units).distinct()


def is_replicating(units: DataFrame, stat_replication: DataFrame) -> DataFrame:
    """Flag units whose parent lists their address among its replication clients."""
    listed = stat_replication.select(
        F.col("unit").alias("parent"), F.col("client_addr").alias("address")
    ).distinct()
    return units.join(
        listed.withColumn("_listed", F.lit(True)), ["parent", "address"], "left"
    ).select(*units.columns, F.coalesce("_listed", F.lit(False)).alias("replicating"))


def role_flags(units: DataFrame) -> DataFrame:
    """Role flags of every unit, from what the units of its cluster publish.

    Input, one row per unit: ``cluster, unit, manual, master, anointed, host,
    allowed_units, in_recovery, was_cloned, had_peers``. ``master`` and
    ``anointed`` are the recorded names; ``was_cloned`` and ``had_peers`` are the
    previous values of the two sticky flags.

    The cluster's facts come from one aggregate, and the master's allowed list is
    turned into rows, so no list is copied to every unit. Flags are never null: a unit
    that doesn't say whether it is in recovery is no primary, but has the state and the
    message ``unknown``, and unknown previous values count as false.
    """
    named = units.withColumns(
        {
            "_master": F.when(~F.col("manual"), F.col("master")),
            "_anointed": F.when(~F.col("manual"), F.col("anointed")),
        }
    )
    facts = named.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col("unit") == F.col("_master"), F.col("unit"))).alias("_present_master"),
        F.max(F.when(F.col("unit") == F.col("_anointed"), F.col("unit"))).alias("_present_anointed"),
    )
    allowed = (
        named.where((F.col("unit") == F.col("_master")) & F.col("host").isNotNull())
        .select("cluster", F.explode(F.split("allowed_units", r"\s+")).alias("unit"))
        .where(F.col("unit") != "")
        .distinct()
        .withColumn("_allowed", F.lit(True))
    )

    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    unit, master, anointed = F.col("unit"), F.col("_master"), F.col("_known_anointed")
    has_peers = F.col("_n") > 1
    is_master = yes(unit == master)
    peered = has_peers & yes(F.col("_present_master") == master) & ~is_master
    authorized = peered & yes(F.col("_allowed"))
    switchover = anointed.isNotNull() & ~anointed.eqNullSafe(master)
    is_anointed = switchover & (anointed == unit)
    is_primary = yes(~F.col("in_recovery"))

    flagged = (
        spread_join(named, facts, ["cluster"], "left")
        .join(allowed, ["cluster", "unit"], "left")
        .withColumn(
            "_known_anointed",
            F.when(F.col("_present_anointed") == F.col("_anointed"), F.col("_anointed")),
        )
        .select(
            "cluster",
            "unit",
            "manual",
            yes(F.col("was_cloned")).alias("was_cloned"),
            F.col("in_recovery").isNull().alias("_unsaid"),
            has_peers.alias("has_peers"),
            (has_peers | yes(F.col("had_peers"))).alias("had_peers"),
            is_master.alias("is_master"),
            peered.alias("master_peered"),
            authorized.alias("master_authorized"),
            (is_master | authorized).alias("has_master"),
            switchover.alias("switchover"),
            is_anointed.alias("is_anointed"),
            is_primary.alias("is_primary"),
        )
    )
    cloned = (
        F.when(~F.col("is_primary"), F.col("was_cloned"))
        .when(F.col("is_master"), True)
        .when(F.col("is_anointed"), F.col("was_cloned"))
        .otherwise(False)
    )
    gone = ~F.col("is_master") & F.col("has_peers") & ~F.col("master_peered")
    return (
        flagged.withColumn("cloned", cloned)
        .withColumn("failover", gone & F.col("cloned"))
        .withColumn(
            "state",
            F.when(F.col("_unsaid"), F.lit("unknown"))
            .when(~F.col("is_primary"), F.lit("hot standby"))
            .when(F.col("has_peers"), F.lit("master"))
            .otherwise(F.lit("standalone")),
        )
        .withColumn(
            "message",
            F.when(F.col("_unsaid"), F.lit("unknown"))
            .when(F.col("is_master"), F.lit("Live master"))
            .when(F.col("is_primary"), F.lit("Live primary"))
            .otherwise(F.lit("Live secondary")),
        )
        .drop("was_cloned", "_unsaid")
    )


def role_history(events: DataFrame, limit: int = ROWS_PER_SLICE) -> DataFrame:
    """The two sticky flags of every unit after each of its events, and whether it fails over.

    Input: ``unit, ts, event_id, is_primary, is_master, is_anointed, has_peers,
    master_peered``, all flags of the event itself. An event is a map on the four states
    that the two flags can have. Each such map keeps a flag or sets it, whatever it was: a
    standby or an anointed unit keeps ``cloned``, a master sets it, any other primary
    clears it; peers set ``had_peers``. Such maps compose to the last one that sets the flag,
    in any grouping, so slices of a busy unit's history are composed each for itself and
    then with each other. Both flags start as false; a null flag counts as false.
    """

    def yes(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    keeps = ~yes("is_primary") | (yes("is_anointed") & ~yes("is_master"))
    slim = events.select("unit", "ts", "event_id", "is_primary", "is_master", "is_anointed", "has_peers", "master_peered")
    sliced = slice_busy_keys(slim, ["unit"], "ts", limit, "event_id")
    for value, into in ((F.when(~keeps, yes("is_master")), "_cloned"), (F.when(yes("has_peers"), True), "_had_peers")):
        sliced = look_along(sliced, ["unit"], "ts", ["event_id"], value, into, True)
    cloned = F.coalesce("_cloned", F.lit(False))
    return sliced.select(
        "unit",
        "ts",
        "event_id",
        cloned.alias("cloned"),
        F.coalesce("_had_peers", F.lit(False)).alias("had_peers"),
        (~yes("is_master") & yes("has_peers") & ~yes("master_peered") & cloned).alias("failover"),
    )


# Parts of a cluster's rows that copies are compared by.
BUCKETS = 1024


def _digests(rows: DataFrame, by: Sequence[str], columns: Sequence[str], buckets: int, into: str) -> DataFrame:
    """Per ``by`` and ``_bucket``, a digest of the rows that doesn't depend on their order."""
    hashed = rows.select(*by, *_bucketed(columns, buckets), F.xxhash64(F.lit(1), *_with_nulls(columns)).alias("_h"))
    low, high = F.col("_h").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("_h", 32)
    digest = F.struct(F.count(F.lit(1)), F.sum(low), F.sum(high), F.bit_xor("_h"))
    return hashed.groupBy(*by, "_bucket").agg(digest.alias(into))


def _with_nulls(columns: Sequence[str]) -> list[Column]:
    """Columns to hash, and which are null: a hash passes over nulls."""
    return [*(F.col(c).isNull() for c in columns), *(F.col(c) for c in columns)]


def _bucketed(columns: Sequence[str], buckets: int) -> list[Column]:
    return [F.pmod(F.xxhash64(*_with_nulls(columns)), F.lit(buckets)).alias("_bucket")]


def missing_rows(
    master: DataFrame, copies: DataFrame, units: DataFrame, keys: Sequence[str], buckets: int = BUCKETS
) -> DataFrame:
    """Rows of ``master(cluster, *keys)`` that a copy ``(cluster, unit, *keys)`` lacks.

    Only copies on the cluster's ``units(cluster, unit)`` count; a row that is there more
    than once is told once, and keys may be null. Each copy is compared with the master by
    digests (count, sums and exclusive or of hashes) of ``buckets`` parts of the cluster's
    rows, which are added up before anything is shuffled. They are written first, so only
    those parts of a copy that differ are opened: copies that are equal send no row, and
    one gap of one unit sets one part of the rows against that unit alone.
    """
    row = ["cluster", *keys]
    members = units.select("cluster", "unit").distinct()
    want = _digests(master, ["cluster"], row, buckets, "_want")
    have = _digests(copies, ["cluster", "unit"], row, buckets, "_have")
    compared = spread_join(want, members, ["cluster"]).join(have, ["cluster", "unit", "_bucket"], "left")
    found = compared.where(~F.col("_want").eqNullSafe(F.col("_have"))).select("cluster", "unit", "_bucket")
    folder = work_folder(master.sparkSession, "differing")
    found.write.parquet(folder)
    opened = master.sparkSession.read.schema(found.schema).parquet(folder)

    wanted = master.select(*row, *_bucketed(row, buckets)).join(opened, ["cluster", "_bucket"]).select("unit", *row).distinct()
    there = copies.select("unit", *row, *_bucketed(row, buckets)).join(opened, ["cluster", "unit", "_bucket"], "left_semi")
    held = there.select("unit", *[F.col(c).alias(f"_{i}") for i, c in enumerate(row)])
    same = reduce(lambda a, b: a & b, [wanted[c].eqNullSafe(held[f"_{i}"]) for i, c in enumerate(row)], wanted["unit"] == held["unit"])
    return wanted.join(held, same, "left_anti").select("cluster", "unit", *keys)


def malformed_positions(units: DataFrame) -> DataFrame:
    """Rows ``(cluster, unit, position)`` whose position is a text that is no position."""
    return units.where(F.col("position").isNotNull() & ~is_position(F.col("position"))).select("cluster", "unit", "position")


def discover_leader(units: DataFrame) -> DataFrame:
    """Each unit's idea of the leader ``(cluster, unit, number, state, recorded)``.

    The recorded leader, else the first other unit publishing ``master``, else
    the unit itself. Two candidates per cluster suffice: a unit skips itself.
    """
    publishing = units.where(F.col("state") == "master").select("cluster", "unit", "number")
    top = (
        top_rows(publishing, ["cluster"], ["number", "unit"], 2, descending=False)
        .groupBy("cluster")
        .agg(
            F.max(F.when(F.col("_rn") == 1, F.col("unit"))).alias("_first"),
            F.max(F.when(F.col("_rn") == 2, F.col("unit"))).alias("_second"),
        )
    )
    other = F.when(F.col("_first") != F.col("unit"), F.col("_first")).otherwise(F.col("_second"))
    return spread_join(units, top, ["cluster"], "left").select(
        "cluster",
        "unit",
        F.coalesce(F.nullif(F.col("recorded"), F.lit("")), other, F.col("unit")).alias("leader"),
    )

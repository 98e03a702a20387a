"""Descriptions of statistics snapshots: which columns name a gauge, which are dropped."""

from __future__ import annotations

from dataclasses import dataclass

from fleetlens.fixed import SESSION_STATE_VERSION


@dataclass(frozen=True)
class StatSpec:
    """One statistics snapshot.

    ``table`` is scanned whole; otherwise ``source`` is scanned and filtered to
    one database. ``key`` columns become name parts, ``exclude`` columns vanish.
    """

    table: str | None = None
    source: str | None = None
    key: tuple[str, ...] = ()
    alias: str | None = None
    exclude: tuple[str, ...] = ()
    version_required: str | None = None

    @property
    def label(self) -> str | None:
        return self.alias or self.table

    @property
    def relation(self) -> str:
        return self.table or self.source or ""


# The snapshots every server offers.
SERVER_SPECS = (StatSpec(table="pg_stat_bgwriter", exclude=("stats_reset",)),)

DATABASE_SPECS = (
    StatSpec(source="pg_stat_database", exclude=("datid", "datname", "stats_reset")),
    StatSpec(source="pg_stat_database_conflicts", exclude=("datid", "datname")),
    StatSpec(
        table="pg_stat_user_tables",
        key=("schemaname", "relname"),
        alias="tables",
        exclude=("relid", "last_vacuum", "last_autovacuum", "last_analyze", "last_autoanalyze"),
    ),
    StatSpec(
        table="pg_stat_user_indexes",
        key=("schemaname", "relname", "indexrelname"),
        alias="indexes",
        exclude=("relid", "indexrelid"),
    ),
    StatSpec(
        table="pg_statio_user_tables",
        key=("schemaname", "relname"),
        alias="tables",
        exclude=("relid",),
    ),
    StatSpec(
        table="pg_statio_user_indexes",
        key=("schemaname", "relname", "indexrelname"),
        alias="indexes",
        exclude=("relid", "indexrelid"),
    ),
    StatSpec(
        table="pg_statio_user_sequences",
        key=("schemaname", "relname"),
        alias="sequences",
        exclude=("relid",),
    ),
    StatSpec(
        table="pg_stat_user_functions",
        key=("schemaname", "funcname"),
        alias="user_functions",
        exclude=("funcid",),
    ),
)

SESSION_TOTAL_SPEC = StatSpec(source="pg_stat_activity", exclude=("datname",))
SESSION_STATE_SPEC = StatSpec(
    source="pg_stat_activity", exclude=("datname",), version_required=SESSION_STATE_VERSION
)

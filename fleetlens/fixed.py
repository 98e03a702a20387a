"""Names, limits and formats that results must agree with."""

# Databases that never produce gauges or dumps.
SYSTEM_DATABASES = ("postgres", "template0", "template1")

# Session states counted per database, with the gauge each one feeds.
SESSION_STATES = {
    "connections_active": "active",
    "connections_idle": "idle",
    "connections_idle_in_transaction": "idle in transaction",
    "connections_idle_in_transaction_aborted": "idle in transaction (aborted)",
    "connections_fastpath_function_call": "fastpath function call",
    "connections_disabled": "disabled",
}
SESSION_STATE_VERSION = "9.3"

# Gauge lines.
GAUGE_PREFIX = "dev.$UNIT.postgresql"
SAMPLE_MINUTES = 5

# Idle sessions, in seconds.
IDLE_STATE = "idle in transaction"
IDLE_SECONDS = 600
REAP_SECONDS = 900

# Column names of servers older than 9.2 -> today's names.
OLD_ACTIVITY_COLUMNS = {
    "procpid": "pid",
    "current_query": "state",
    "query_start": "state_change",
}
OLD_IDLE_STATE = "<IDLE> in transaction"

# Archive and backup freshness, in seconds.
ARCHIVE_ROOT = "/var/lib/postgresql"
ARCHIVE_WARN, ARCHIVE_CRIT = 300, 600
BACKUP_WARN, BACKUP_CRIT = 172800, 194400

# Backups.
KEEP_DUMPS = 7
KEEP_BASE_BACKUPS = 2
LATEST = "LATEST"
STAMP_FORMAT = "yyyyMMdd_HHmmss"

# One unit of the high half of a log position, historical and current.
LEGACY_SEGMENT = 16 * 1024 * 1024 * 255
SEGMENT = 16 * 1024 * 1024 * 256

# Quantities: factor of each unit within its family.
MEMORY_UNITS = {
    "kB": 1024,
    "8kB": 8 * 1024,
    "MB": 1024**2,
    "GB": 1024**3,
    "TB": 1024**4,
}
TIME_UNITS = {"ms": 1, "s": 1000, "min": 60_000, "h": 3_600_000, "d": 86_400_000}

BOOLEAN_WORDS = ("on", "off", "true", "false", "yes", "no", "0", "1")

# Settings.
DEFAULT_PORT = 5432
LINE_PREFIX = "%t [%p]: [%l-1] db=%d,user=%u "
BEGIN_MARK = "### BEGIN JUJU SETTINGS ###"
END_MARK = "### END JUJU SETTINGS ###"
COMMENTED_OUT = "# juju # "
RESTART_CONTEXT = "postmaster"
# Characters of a setting's value that needs no quotes.
SIMPLE_VALUE = "-._0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
# What ships a finished log file; the folder holds the tool's settings.
ARCHIVE_COMMAND = "/snap/bin/wal-e.envdir {folder} /snap/bin/wal-e wal-push %p"
ARCHIVE_FOLDER = "wal-e.env"
# Settings of a standby, included from version 12 on.
STANDBY_FILE = "juju_recovery.conf"
INTERNAL_CONTEXT = "internal"
RELEASE_VERSIONS = {"xenial": "9.5", "bionic": "10", "focal": "12"}
ALLOWED_VERSIONS = ("", "9.5", "9.6", "10", "11", "12")
ALLOWED_PACKAGE_STATUS = ("install", "hold")
FROZEN_OPTIONS = ("locale", "encoding", "manual_replication")

# Old options that map straight to a setting of the same name.
SIMPLE_OPTIONS = (
    "max_connections",
    "max_prepared_transactions",
    "ssl",
    "log_min_duration_statement",
    "log_checkpoints",
    "log_connections",
    "log_disconnections",
    "log_temp_files",
    "log_line_prefix",
    "log_lock_waits",
    "log_timezone",
    "log_autovacuum_min_duration",
    "autovacuum",
    "autovacuum_analyze_threshold",
    "autovacuum_vacuum_scale_factor",
    "autovacuum_analyze_scale_factor",
    "autovacuum_vacuum_cost_delay",
    "search_path",
    "standard_conforming_strings",
    "hot_standby",
    "hot_standby_feedback",
    "wal_level",
    "max_wal_senders",
    "wal_keep_segments",
    "archive_mode",
    "archive_command",
    "work_mem",
    "maintenance_work_mem",
    "shared_buffers",
    "effective_cache_size",
    "default_statistics_target",
    "temp_buffers",
    "wal_buffers",
    "checkpoint_segments",
    "checkpoint_completion_target",
    "checkpoint_timeout",
    "fsync",
    "synchronous_commit",
    "full_page_writes",
    "random_page_cost",
)

# Credentials each backup store needs, by URI scheme.
STORE_KEYS = {
    "swift": ("SWIFT_AUTHURL", "SWIFT_USER", "SWIFT_PASSWORD"),
    "s3": ("AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY", "AWS_REGION"),
    "wabs": ("WABS_ACCOUNT_NAME", "WABS_ACCESS_KEY"),
}

# Access rules.
ACCOUNT_PREFIX = {"plain": "juju_", "admin": "jujuadmin_", "replication": "jujurepl_"}
ACCOUNT_LIMIT, ACCOUNT_KEPT = 63, 31
IDENT_MAP = "juju_charm"
IDENT_PAIRS = (("root", "postgres"), ("postgres", "postgres"))
REPLICATION_ACCOUNT = "_juju_repl"
MONITOR_ACCOUNT = "nagios"
OWNER_ACCOUNT = "postgres"
PUBLIC_SCHEMA = "public"
MIRRORED_KEYS = (
    "database",
    "user",
    "password",
    "roles",
    "schema_user",
    "schema_password",
    "extensions",
)

# Unit status.
STATUS_STATES = ("maintenance", "blocked", "waiting", "active", "unknown")

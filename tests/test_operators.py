"""Operators on small hand-made tables, from what each is meant to do."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import access, backups, events, freshness, metrics, replication, sessions, settings
from fleetlens.specs import DATABASE_SPECS, SERVER_SPECS, SESSION_STATE_SPEC, StatSpec

DAY = dt.datetime(2024, 1, 1)


def at(**delta):
    return DAY + dt.timedelta(**delta)


def lit(ts):
    return F.lit(ts).cast("timestamp_ntz")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=str)


# Metrics and sessions


def test_gauge_names_follow_the_spec(frame):
    server = frame([(3, 4.5, DAY)], "a int, b double, stats_reset timestamp_ntz")
    assert rows(metrics.to_gauges(server, SERVER_SPECS[0])) == [
        ("pg_stat_bgwriter.a", 3.0),
        ("pg_stat_bgwriter.b", 4.5),
    ]
    tables = frame([("d", 1, "s", "t", None)], "db string, relid int, schemaname string, relname string, n int")
    assert rows(metrics.to_gauges(tables, DATABASE_SPECS[2], "db")) == [
        ("databases.d.tables.s.t.n", 0.0)
    ]
    nameless = frame([("d", 9)], "datname string, n int")
    assert rows(metrics.to_gauges(nameless, StatSpec(source="x"), "datname")) == [("databases.d.n", 9.0)]


def test_sessions_are_counted_with_zeroes(frame):
    act = frame(
        [("h1", "a", "active", True), ("h1", "a", "idle", False), ("h1", "a", None, False), ("h1", "x", "idle", False),
         ("h2", "a", "idle", False)],
        "unit string, datname string, state string, waiting boolean",
    )
    listed = [("h1", "a"), ("h1", "b"), ("h1", "a"), ("h1", "postgres"), ("h1", None), ("h2", "a")]
    dbs = metrics.databases(frame(listed, "unit string, datname string"))
    got = {(r.unit, r.datname): r for r in metrics.session_counts(dbs, act).collect()}
    assert set(got) == {("h1", "a"), ("h1", "b"), ("h2", "a")}
    a, b = got["h1", "a"], got["h1", "b"]
    assert (a.connections, a.connections_waiting, a.connections_active) == (3, 1, 1)
    assert b.connections == b.connections_idle == 0 and got["h2", "a"].connections == 1


def test_all_snapshots_together(frame):
    shots = []
    for spec in (*SERVER_SPECS, *DATABASE_SPECS):
        columns = ["unit", "version", *(["datname"] if spec not in SERVER_SPECS else []), *spec.key, "n", "note"]
        row = [("h1", "9.1", *(["db"] if spec not in SERVER_SPECS else []), *spec.key, 3, "text")]
        kinds = ["int" if c == "n" else "string" for c in columns]
        shots.append((spec, frame(row, ", ".join(f"{c} {k}" for c, k in zip(columns, kinds)))))
    shots.append((SESSION_STATE_SPEC, frame([("h1", "9.1", "db", 1), ("h2", "9.3", "db", 1)], "unit string, version string, datname string, idle int")))
    got = metrics.collect_gauges(shots).collect()
    assert len(got) == 9 * 2 + 1
    assert [r.unit for r in got if r.metric == "databases.db.idle"] == ["h2"]
    assert ("h1", "databases.db.indexes.schemaname.relname.indexrelname.n", 3.0) in {tuple(r) for r in got}
    assert all(r.value is None for r in got if r.metric.endswith(".note"))


def test_gauge_lines(frame):
    df = frame([("a.b/0", "m", 5.0), ("a.b/0", "n", 0.25)], "unit string, metric string, value double")
    assert rows(metrics.gauge_lines(df, unit_col="unit")) == [
        ("dev.a-b-0.postgresql.m:5|g",),
        ("dev.a-b-0.postgresql.n:0.25|g",),
    ]


def test_sampling_keeps_the_last_value(frame):
    df = frame(
        [("m", at(minutes=1), 1, 1.0), ("m", at(minutes=1), 2, 2.0), ("m", at(minutes=5), 3, 3.0)],
        "metric string, sampled_at timestamp_ntz, sample_id bigint, value double",
    )
    assert rows(metrics.sample(df)) == [("m", DAY, 2.0), ("m", at(minutes=5), 3.0)]


def test_idle_limit_is_strict_and_zero_means_all(frame):
    act = frame(
        [
            (1, "u", "a", "idle in transaction", at(seconds=-600)),
            (2, "u", "a", "idle in transaction", at(seconds=-601)),
            (3, "u", "a", "idle", at(seconds=-9000)),
        ],
        "pid bigint, usename string, application_name string, state string, state_change timestamp_ntz",
    )
    assert rows(sessions.idle_sessions(act, lit(DAY)), "pid") == [(2,)]
    assert rows(sessions.idle_sessions(act, lit(DAY), 0, self_pid=2), "pid") == [(1,), (3,)]


def test_ignored_names_are_three_valued(frame):
    df = frame(
        [("u", "a"), ("u", None), ("x", "a"), ("y", "x"), ("x", None)],
        "usename string, application_name string",
    )
    assert rows(sessions.ignore_sessions(df, ["x"])) == [("u", "a")]


# Freshness


def test_ready_files(frame):
    good = ["/r/9.5/main/pg_xlog/archive_status/0001.ready", "/r/12/c/pg_wal/archive_status/a.b.ready"]
    bad = [
        "/r/12/c/pg_wal/archive_status/.ready",
        "/r/12/c/pg_wal/archive_status/0001.done",
        "/r/12/pg_wal/archive_status/0001.ready",
        "/s/12/c/pg_wal/archive_status/0001.ready",
        "/r/12/c/pg_clog/archive_status/0001.ready",
    ]
    got = freshness.ready_files(frame([(p,) for p in good + bad], "path string"), "/r")
    assert sorted(r.path for r in got.collect()) == sorted(good)


def test_archive_age_and_message(frame):
    units = frame([("a",), ("b",), ("c",)], "unit string")
    files = frame(
        [("a", at(seconds=-123456)), ("a", at(seconds=-5)), ("b", at(seconds=60))],
        "unit string, mtime timestamp_ntz",
    )
    aged = freshness.max_age(units, files, lit(DAY))
    assert rows(aged) == [("a", 123456), ("b", 0), ("c", 0)]
    got = {r.unit: r for r in freshness.classify(aged).collect()}
    assert got["a"].status == 2
    assert got["a"].message == (
        "CRITICAL: Last successful WAL archive was 1 days, 10 hours, 17 minutes and 36 seconds ago"
    )
    assert got["b"].message == "OK: No stale WAL archival found"


def test_thresholds_are_strict(frame):
    df = frame([(300,), (301,), (600,), (601,)], "age_s bigint")
    assert [r.status for r in freshness.classify(df).orderBy("age_s").collect()] == [0, 1, 1, 2]
    off = freshness.classify(df, "age_s", 0, 0)
    assert {r.status for r in off.collect()} == {0}


def test_heartbeat(frame):
    df = frame(
        [("m", True, at(seconds=-172801)), ("s", False, None), ("n", True, None), ("o", True, at(seconds=-172800))],
        "unit string, is_master boolean, last_success timestamp_ntz",
    )
    got = {r.unit: r.level for r in freshness.heartbeat(df, lit(DAY)).collect()}
    assert got == {"m": "WARNING", "s": "OK", "n": "CRITICAL", "o": "OK"}


# Backups


def test_dump_names(frame):
    paths = ["/b/my.db.20240102_030405.dump.gz", "globals.20240102_030405.sql", "/b/db.dump", "x.20240102_030405.dump"]
    got = {r.path: r for r in backups.decode_dumps(frame([(p,) for p in paths], "path string")).collect()}
    first = got[paths[0]]
    assert (first.kind, first.datname, first.stamp, first.codec) == (
        "database", "my.db", dt.datetime(2024, 1, 2, 3, 4, 5), "gz")
    assert (got[paths[1]].kind, got[paths[1]].datname) == ("globals", None)
    assert got[paths[2]].kind is None
    assert got[paths[3]].codec == ""


def test_forecast_truncates_each_step(frame):
    dumps = frame([("u", "a", 787, DAY, "p1"), ("u", "b", 1, DAY, "p2"), ("u", "a", 9999, at(days=-1), "p0")],
                  "unit string, datname string, size bigint, mtime timestamp_ntz, path string")
    free = frame([("u", 0), ("v", 5)], "unit string, free_kib bigint")
    got = {r.unit: r for r in backups.space_forecast(backups.latest_dump(dumps), free).collect()}
    assert (got["u"].need_kib, got["u"].fits) == (1, False)
    assert (got["v"].need_kib, got["v"].fits) == (0, True)


def test_pruning_by_run(frame):
    files = [("u", f"/d/globals.2024010{i}_000000.sql", at(days=i)) for i in range(1, 5)]
    files += [("u", "/d/a.dump", at(days=3, seconds=-61)), ("u", "/d/b.dump", at(days=3, seconds=-60)),
              ("u", "/d/lost+found/c", DAY), ("v", "/d/z.dump", DAY)]
    df = frame(files, "unit string, path string, mtime timestamp_ntz")
    gone = backups.prune_by_run(df, lit(at(days=5)), 2)
    assert sorted(r.path for r in gone.collect()) == [
        "/d/a.dump", "/d/globals.20240101_000000.sql", "/d/globals.20240102_000000.sql"]
    assert backups.prune_by_run(df, lit(at(days=5)), 9).count() == 0
    with pytest.raises(ValueError):
        backups.prune_by_run(df, lit(DAY), 0)


def test_keeping_n(frame):
    df = frame([("s", at(days=i), f"b{i}") for i in range(5)] + [("t", DAY, "c")],
               "store string, started timestamp_ntz, name string")
    assert rows(backups.prune_keep_n(df, 2), "name") == [("b0",), ("b1",), ("b2",)]


@pytest.mark.parametrize("limit", [2, 10_000])
def test_restore_points(frame, limit):
    have = frame([("s", "base_A", at(days=1)), ("s", "base_B", at(days=2)), ("s", "base_C", at(days=3))],
                 "store string, name string, started timestamp_ntz")
    want = [
        (1, "s", "LATEST", None, "base_C", None),
        (2, "s", "LATEST", at(days=2), "base_A", None),
        (3, "s", "LATEST", at(days=1), None, "none before target"),
        (4, "t", "LATEST", None, None, "no backups"),
        (5, "s", "base-b", None, "base_B", None),
        (6, "s", "base_B", at(days=2), None, "not before target"),
        (7, "s", "other", None, None, "not found"),
        (8, "t", "base_B", None, None, "no backups"),
        (9, "s", "LATEST", at(days=2, seconds=1), "base_B", None),
    ]
    asked = frame([w[:4] for w in want], "request_id bigint, store string, backup string, target_time timestamp_ntz")
    got = backups.resolve_backup(asked, have, limit)
    assert rows(got, "request_id", "resolved", "reason") == [(w[0], w[4], w[5]) for w in want]


def test_pairs(frame):
    df = frame([("Base_1", 7)], "name string, size_bytes int")
    assert rows(backups.flatten_kv(df, "name")) == [("base-1.name", "Base_1"), ("base-1.size-bytes", "7")]


# Replication


def test_lag(frame):
    standbys = frame([("c", "a", "0/10"), ("c", "b", "0/20"), ("c", "d", None)], "cluster string, unit string, position string")
    standbys = standbys.union(frame([("lost", "e", "0/1")], standbys.schema))
    masters = frame([("c", "0/20")], "cluster string, position string")
    assert rows(replication.lag_bytes(standbys, masters), "unit", "lag", "in_sync") == [
        ("a", 16, False), ("b", 0, True), ("d", None, False), ("e", None, False)]


def test_settled_needs_a_repeat(frame):
    df = frame([("u", at(seconds=i), i, p) for i, p in enumerate(["0/1", None, None, "0/2", "0/2", "0/2"])],
               "unit string, ts timestamp_ntz, sample_id bigint, position string")
    assert rows(replication.settled(df), "position", "settled_at") == [("0/2", at(seconds=4))]


def test_election_prefers_most_replayed(frame):
    df = frame([("c", "c/1", 1, "0/5"), ("c", "c/10", 10, "0/9"), ("c", "c/2", 2, "0/9"), ("c", "c/3", 3, None), ("d", "d/1", 1, None)],
               "cluster string, unit string, number bigint, position string")
    assert rows(replication.elect(df), "cluster", "elected", "blocked") == [("c", "c/2", False), ("d", None, True)]


def test_barrier(frame):
    df = frame([("c", "c/1", 1, "m"), ("c", "c/2", 2, ""), ("c", "c/3", 3, None), ("d", "d/1", 1, "")],
               "cluster string, unit string, number bigint, following string")
    assert rows(replication.barrier(df)) == [("c", 1, False), ("d", 0, True)]
    assert rows(replication.waiting_on(df), "cluster", "unit", "number") == [("c", "c/1", 1)]


ROLE = ("cluster string, unit string, manual boolean, master string, anointed string, host string, "
        "allowed_units string, in_recovery boolean, was_cloned boolean, had_peers boolean")


def roles_of(frame, units):
    return {r.unit: r for r in replication.role_flags(frame(units, ROLE)).collect()}


def test_roles_in_a_healthy_cluster(frame):
    got = roles_of(frame, [
        ("c", "c/0", False, "c/0", None, "h0", "c/1 x", False, False, False),
        ("c", "c/1", False, "c/0", None, "h1", "", True, True, True),
        ("c", "c/2", False, "c/0", None, "h2", "", True, False, True)])
    m, s, late = got["c/0"], got["c/1"], got["c/2"]
    assert m.is_master and m.has_master and m.cloned and not m.master_peered and m.had_peers
    assert (m.state, m.message) == ("master", "Live master")
    assert s.master_peered and s.master_authorized and s.has_master and not s.failover
    assert late.master_peered and not late.master_authorized and not late.has_master
    assert (s.state, s.message) == ("hot standby", "Live secondary")


def test_roles_when_the_master_is_gone(frame):
    got = roles_of(frame, [
        ("c", "c/1", False, "c/0", None, "h1", "", True, True, True),
        ("c", "c/2", False, "c/0", None, "h2", "", True, False, True),
        ("d", "d/1", False, "d/0", None, "h1", "", True, True, True)])
    assert got["c/1"].failover and not got["c/2"].failover
    assert not got["d/1"].failover and not got["d/1"].has_peers


def test_roles_in_switchover_and_manual_mode(frame):
    got = roles_of(frame, [
        ("c", "c/0", False, "c/0", "c/1", "h", "c/1", False, True, True),
        ("c", "c/1", False, "c/0", "c/1", "h", "", False, True, True),
        ("d", "d/0", True, "d/0", "d/1", "h", "", False, True, False),
        ("d", "d/1", True, "d/0", "d/1", "h", "", True, True, False),
        ("e", "e/0", False, "e/0", "e/9", "h", "", False, True, True)])
    assert got["c/0"].switchover and not got["c/0"].is_anointed
    assert got["c/1"].is_anointed and got["c/1"].cloned
    assert not got["d/0"].is_master and not got["d/0"].switchover and not got["d/0"].cloned
    assert got["d/0"].message == "Live primary"
    assert not got["e/0"].switchover and got["e/0"].state == "standalone"


def test_missing_rows(frame):
    master = frame([("c", 1), ("c", 2), ("d", 1)], "cluster string, token int")
    copies = frame([("c", "c/1", 1), ("c", "c/1", 1), ("c", "c/2", 1), ("c", "c/2", 2), ("d", "d/1", 1), ("c", "gone/1", 1), ("c", "gone/2", 2), ("c", "gone/2", 1)], "cluster string, unit string, token int")
    units = frame([("c", "c/1"), ("c", "c/2"), ("c", "c/3"), ("d", "d/1")], "cluster string, unit string")
    assert rows(replication.missing_rows(master, copies, units, ["token"])) == [
        ("c", "c/1", 2), ("c", "c/3", 1), ("c", "c/3", 2)]


def test_leader_discovery_skips_the_unit_itself(frame):
    df = frame([("c", "c/1", 1, "master", None), ("c", "c/2", 2, "hot standby", ""), ("c", "c/10", 10, "master", "c/7"), ("d", "d/1", 1, "master", None)],
               "cluster string, unit string, number bigint, state string, recorded string")
    assert rows(replication.discover_leader(df), "unit", "leader") == [
        ("c/1", "c/10"), ("c/10", "c/7"), ("c/2", "c/1"), ("d/1", "d/1")]


# Settings


def test_texts_become_settings(frame):
    texts = frame([("u", "A = 1\r\n# x\na = 2\n\nb='x'\n=\n")], "unit string, text string")
    parsed = settings.parse_settings(settings.settings_lines(texts))
    assert rows(parsed, "lineno", "error") == [(1, None), (3, None), (5, None), (6, "Missing key")]
    assert rows(settings.effective_settings(parsed)) == [("u", "a", "2"), ("u", "b", "x")]


def test_derived_settings(frame):
    cols = ("unit string, ram_mb bigint, version string, standbys bigint, max_wal_senders bigint, max_connections bigint, "
            "wal_keep_segments bigint, replicated_wal_keep_segments bigint, archive_uri string, forwards_logs boolean")
    got = {r.unit: r for r in settings.derive_settings(frame([
        ("a/0", 10, "9.3", 0, None, None, None, 500, "", False),
        ("b/0", 1001, "9.6", 3, 10, 200, 600, 500, "s3://x", True),
        ("c/0", 100000, "10", 1, 3, 50, 20, 500, None, False)], cols)).collect()}
    a, b, c = got["a/0"], got["b/0"], got["c/0"]
    assert (a.shared_buffers, a.effective_cache_size, a.max_wal_senders, a.max_connections) == ("16 MB", "1 MB", 5, 100)
    assert (a.wal_level, a.wal_keep_segments, a.archive_mode, a.password_encryption) == ("hot_standby", None, None, "true")
    assert (b.shared_buffers, b.effective_cache_size, b.max_wal_senders, b.max_connections) == ("251 MB", "750 MB", 11, 200)
    assert (b.wal_level, b.wal_keep_segments, b.archive_mode, b.syslog_ident) == ("logical", 600, "on", "b_0")
    assert b.archive_command == "/snap/bin/wal-e.envdir /etc/postgresql/9.6/main/wal-e.env /snap/bin/wal-e wal-push %p"
    assert a.archive_command is None
    assert (c.shared_buffers, c.wal_keep_segments, c.password_encryption) == ("8192 MB", 500, "md5")


def test_validation_reasons(frame):
    cat = frame([
        ("b", "bool", None, None, None, None), ("e", "enum", None, ["x", "y"], None, None),
        ("i", "integer", None, None, "1", "5"), ("m", "integer", "8kB", None, "0", "128"), ("r", "real", None, None, "0", "1"), ("s", "string", None, None, None, None)],
        "name string, vartype string, unit string, enumvals array<string>, min_val string, max_val string")
    cases = {("b", "Tru"): None, ("b", "o"): "Invalid boolean 'o'", ("e", "X"): None, ("e", "z"): "Must be one of x,y. Got z",
             ("i", "0"): "below minimum 1", ("i", "5"): None, ("i", "6"): "above maximum 5", ("i", "1.5"): "Invalid integer '1.5'",
             ("m", "1MB"): None, ("m", "2 MB"): "above maximum 128", ("m", "1d"): "Invalid integer w/unit '1d'", ("m", "129"): "above maximum 128",
             ("r", "1e-1"): None, ("r", "x"): "Invalid real 'x'", ("r", "1d"): "Invalid real '1d'", ("s", "any"): None, ("q", "1"): "Unknown option q"}
    got = settings.validate(frame([("u", n, v) for n, v in cases], "unit string, name string, value string"), cat)
    assert {(r.name, r.value): r.reason for r in got.collect()} == {k: v for k, v in cases.items() if v}


def test_change_class(frame):
    schema = "unit string, name string, value string"
    live = frame([("same", "p", "1"), ("re", "p", "1"), ("re", "q", "1"), ("full", "p", "1"), ("gone", "q", "1")], schema)
    now = frame([("same", "p", "1"), ("re", "p", "1"), ("re", "q", "2"), ("full", "p", "2"), ("new", "q", "1")], schema)
    cat = frame([("p", "postmaster"), ("q", "sighup")], "name string, context string")
    assert rows(settings.change_class(live, now, cat), "unit", "change") == [
        ("full", "restart"), ("gone", "restart"), ("new", "restart"), ("re", "reload"), ("same", "unchanged")]
    assert settings.drift(live, now).count() == 4


def test_old_options(frame):
    options = frame([("listen_port", "-1", "DEPRECATED."), ("collapse_limit", "-1", "DEPRECATED."), ("work_mem", "1", "DEPRECATED."), ("fsync", "1", "deprecated"), ("gone", "1", "DEPRECATED.")],
                    "name string, default string, description string")
    values = frame([("u", "listen_port", "5433"), ("u", "collapse_limit", "8"), ("u", "work_mem", "2"), ("u", "fsync", "2"), ("u", "gone", "2"), ("v", "listen_port", "-1"), ("v", "work_mem", "1")],
                   "unit string, name string, value string")
    cat = frame([("work_mem",), ("fsync",)], "name string")
    assert rows(settings.map_options(values, options, cat)) == [
        ("u", "from_collapse_limit", "8"), ("u", "join_collapse_limit", "8"), ("u", "port", "5433"), ("u", "work_mem", "2")]


def test_rewriting_a_managed_text(frame):
    old = "port = 1\n# port = 2\n\n  PORT=3 # x\nports = 4\n### BEGIN JUJU SETTINGS ###\nport = 9\n### END JUJU SETTINGS ###\n"
    texts = frame([(1, old), (2, "a = 1")], "doc_id int, text string")
    chosen = frame([(1, "port", "5"), (1, "x", "it's"), (1, "x", "it's")], "doc_id int, name string, value string")
    got = {r.doc_id: r.text for r in settings.rewrite_managed(texts, chosen).collect()}
    assert got[1] == ("# juju # port = 1\n# port = 2\n# juju # PORT=3 # x\nports = 4\n\n"
                      "### BEGIN JUJU SETTINGS ###\nport = 5\nx = 'it''s'\n### END JUJU SETTINGS ###")
    assert got[2] == "a = 1\n### BEGIN JUJU SETTINGS ###\n### END JUJU SETTINGS ###"


def test_versions(frame):
    df = frame([("a", "9.6", ["10"], "12", "focal"), ("b", None, ["10"], "12", "focal"), ("c", None, ["10", "11"], "12", "focal"), ("d", "", [], "", "focal"), ("e", None, [], None, "trusty")],
               "unit string, cached string, installed array<string>, configured string, release string")
    assert rows(settings.resolve_version(df), "unit", "version") == [("a", "9.6"), ("b", "10"), ("c", "12"), ("d", "12"), ("e", None)]


def test_store_credentials(frame):
    df = frame([("a", "s3://b", {"AWS_REGION": "x", "AWS_ACCESS_KEY_ID": " "}), ("b", "", {}), ("c", "ftp://x", {}), ("d", "wabs://x", {"WABS_ACCOUNT_NAME": "n", "WABS_ACCESS_KEY": "k"})],
               "unit string, uri string, credentials map<string,string>")
    assert rows(settings.store_check(df), "unit", "result", "missing") == [
        ("a", "missing", "AWS_ACCESS_KEY_ID,AWS_SECRET_ACCESS_KEY"), ("b", "disabled", None), ("c", "invalid uri", None), ("d", "ok", None)]


# Access


ADDR = "egress string, ingress string, private string"


@pytest.mark.parametrize(("egress", "ingress", "private"), [(None, None, "1.2.3.4"), (None, "1.2.3.4", "9.9.9.9"), ("1.2.3.4/32", "8.8.8.8", None)])
def test_peer_rules(frame, egress, ingress, private):
    clusters = frame([("c", "192.168.1.0/24,10.0.0.0/8,1.2.3.4", "local all sso md5,local all ssoadmin md5")], "cluster string, admin_addresses string, extra_rules string")
    peers = frame([("c", "pg/1", 1, egress, ingress, private)], f"cluster string, unit string, number bigint, {ADDR}")
    rels = frame([("c", "db", 1, "app/1", 1, None, None, "1.2.3.4", "database", "user", "schema_user"),
                  ("c", "db-admin", 2, "app/1", 1, None, None, "1.2.3.4", None, "user", None),
                  ("c", "master", 3, "app/1", 1, None, None, "1.2.3.4", "database", "user", None),
                  ("c", "db", 4, "app/2", 2, None, None, "1.2.3.4", "database", None, None)],
                 f"cluster string, relname string, relid bigint, unit string, number bigint, {ADDR}, database string, user string, schema_user string")
    got = access.access_rules(clusters, peers, rels).orderBy(*access.RULE_ORDER)
    assert [r.rule for r in got.collect()] == [
        "local all postgres peer map=juju_charm",
        "local all nagios password",
        "local all all peer",
        'host replication _juju_repl "1.2.3.4/32" md5',
        'host postgres _juju_repl "1.2.3.4/32" md5',
        'host "database" "user" "1.2.3.4/32" md5',
        'host "database" "schema_user" "1.2.3.4/32" md5',
        'host all all "1.2.3.4/32" md5',
        'host replication "user" "1.2.3.4/32" md5',
        'host "database" "user" "1.2.3.4/32" md5',
        'host all all "192.168.1.0/24" md5',
        'host all all "10.0.0.0/8" md5',
        'host all all "1.2.3.4/32" md5',
        "local all sso md5",
        "local all ssoadmin md5",
        "local all all reject",
        "host all all all reject",
    ]


def test_empty_egress_gives_no_address(frame):
    df = frame([("u", "", "1.2.3.4", "1.2.3.4"), ("v", None, None, None), ("w", " 10.0.0.0/8 ,, 1.1.1.1/32", None, None)], f"unit string, {ADDR}")
    assert rows(access.incoming(df)) == [("w", 0, "10.0.0.0/8"), ("w", 1, "1.1.1.1/32")]


def test_relations_flatten(frame):
    doc = '{"db":{"db:1":{"app/2":{"private-address":"1.2.3.4","gone":null}},"db:2":{}},"master":{}}'
    flat = access.flatten_relations(frame([("c", doc)], "cluster string, relations string"))
    assert [tuple(r) for r in flat.collect()] == [("c", "db", "db:1", "app/2", {"private-address": "1.2.3.4"})]


def test_rules_file_is_retired(frame):
    old = "local all all peer\n\n# keep\n### BEGIN JUJU SETTINGS ###\nhost x\n### END JUJU SETTINGS ###\n"
    ((text,),) = access.retire_rules(frame([(old,)], "text string")).collect()
    assert text == "# juju # local all all peer\n\n# keep\n"


def test_roles_and_extensions(frame):
    wanted = frame([("c", "u", "B,,C"), ("d", "u", "B")], "cluster string, account string, roles string")
    roles = frame([("c", 1, "u"), ("c", 2, "A"), ("c", 3, "B"), ("d", 1, "B"), ("d", 3, "u")], "cluster string, oid int, rolname string")
    members = frame([("c", 1, 2), ("c", 1, 3)], "cluster string, member int, roleid int")
    assert rows(access.missing_grants(wanted, roles, members)) == [("c", "u", "C"), ("d", "u", "B")]
    assert rows(access.missing_roles(wanted, roles)) == [("c", "C")]
    ext = frame([("d", "A", 1), ("d", "B", 1)], "datname string, extname string, extnamespace int")
    ns = frame([("d", 1, "public"), ("e", 1, "other")], "datname string, oid int, nspname string")
    missing = access.missing_extensions(frame([("d", "B, C(custom)")], "datname string, extensions string"), ext, ns)
    assert rows(missing) == [("d", "C", "custom")]
    assert rows(access.missing_schemas(missing)) == [("d", "custom")]


def test_connection_strings(frame):
    df = frame([("db", 1, "pg/1", 1, True, "h1", "5432", "d", "u", "p"), ("db", 1, "pg/2", 2, False, "h2", "5432", "d", "u", "a b"),
                ("db", 1, "pg/3", 3, False, "h3", "", "d", "u", "p"), ("db", 2, "pg/1", 1, True, "h1", "5432", "d", None, "p")],
               "relname string, relid int, unit string, number bigint, is_master boolean, host string, port string, database string, user string, password string")
    df = df.withColumn("cluster", F.lit("c"))
    assert rows(access.connection_strings(df), "relid", "role", "unit", "conn") == [
        (1, "master", "pg/1", "dbname=d host=h1 password=p port=5432 user=u"),
        (1, "standby", "pg/2", "dbname=d host=h2 password='a b' port=5432 user=u"), (2, "master", "pg/1", None)]


def test_database_of_a_relation(frame):
    df = frame([("db", 1, "app/10", 10, "late", None), ("db", 1, "app/9", 9, None, "shown"), ("db", 2, "web/1", 1, None, None), ("db", 3, "x/1", 1, "asked", "shown")],
               "relname string, relid int, unit string, number bigint, requested string, published string")
    df = df.union(frame([("db-admin", 4, "adm/1", 1, None, "all")], df.schema)).withColumn("cluster", F.lit("c"))
    assert rows(access.relation_database(df), "relid", "database") == [(1, "shown"), (2, "web"), (3, "asked"), (4, "adm")]


def test_natural_order(frame):
    df = frame([("b/1",), ("a/10",), ("a/9",)], "unit string")
    assert [r.unit for r in access.unit_order(df).collect()] == ["a/9", "a/10", "b/1"]


def test_identity_map(frame):
    df = frame([("a", "x\n juju_charm  root postgres \njuju_charm postgres postgres"), ("b", "# juju_charm root postgres")], "unit string, text string")
    assert rows(access.missing_ident(df)) == [("b", "postgres", "postgres"), ("b", "root", "postgres")]


# Events


def test_log_lines(frame):
    df = frame([("2024-01-02 03:04:05 UTC [77]: [3-1] db=d,user=u LOG:  hi, there",), ("2024-01-02 03:04:05 UTC [77]: [3-1] db=,user= start",), ("odd",)], "line string")
    got = events.decode_logs(df).collect()
    assert (got[0].ts, got[0].pid, got[0].line_no, got[0].datname, got[0].usename, got[0].message) == (
        dt.datetime(2024, 1, 2, 3, 4, 5), 77, 3, "d", "u", "LOG:  hi, there")
    assert (got[1].datname, got[1].usename, got[1].message) == ("", "", "start")
    assert (got[2].ts, got[2].message) == (None, "odd")


def test_other_prefixes(frame):
    df = frame([("100% d@u (9) text",)], "line string")
    (row,) = events.decode_logs(df, "100%% %d@%u (%p) ").collect()
    assert (row.datname, row.usename, row.pid, row.message) == ("d", "u", 9, "text")


def test_first_value_is_a_change(frame):
    df = frame([("k", at(seconds=i), i, v) for i, v in enumerate([None, None, "a", "a", None, "a"])], "k string, ts timestamp_ntz, event_id bigint, v string")
    assert rows(events.changes(df, "k", "v"), "event_id", "v", "previous") == [
        (0, None, None), (2, "a", None), (4, None, "a"), (5, "a", None)]


def test_status_keeps_and_guesses(frame):
    df = frame([(i, "u", at(seconds=i), s) for i, s in enumerate([None, "blocked", None, "active"])], "event_id bigint, unit string, ts timestamp_ntz, state string")
    got = events.status_flags(df).orderBy("event_id").collect()
    assert [(r.status, r.level) for r in got] == [("maintenance", "INFO"), ("blocked", "WARNING"), ("blocked", "WARNING"), ("active", "INFO")]
    assert [r.is_blocked for r in got] == [False, True, True, False]


def test_tail(frame):
    df = frame([("p", i) for i in range(10)] + [("q", 1)], "program string, event_id bigint")
    assert rows(events.tail(df, 2)) == [("p", 8), ("p", 9), ("q", 1)]

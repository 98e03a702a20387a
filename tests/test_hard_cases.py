"""Single rows that once stopped a job, lost a row or gave a wrong answer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.numbers import convert_unit, quantity_error
from fleetlens.functions.text import extract_setting
from fleetlens.operators import access, backups, metrics, replication, settings
from fleetlens.specs import StatSpec


def one(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("k='" + "a" * 1_000_000 + "'", ("k", "a" * 1_000_000, None)),
        ("k = 'it''s' # x", ("k", "it's", None)),
        (r"k 'a\'b'", ("k", "a'b", None)),
        ("k = 'open", (None, None, "Badly quoted value")),
        ("k = a b", (None, None, "Badly quoted value")),
        ("k =", (None, None, "Missing value")),
        ("word", (None, None, "Missing key")),
        ("k = ''", ("k", "", None)),
        ("K " + " " * 200_000 + "1", ("k", "1", None)),
    ],
)
def test_settings_lines(frame, line, want):
    assert one(settings.parse_settings(frame([(line,)], "line string")).select("key", "value", "error")) == [want]


def test_blank_lines_drop_out(frame):
    lines = [(" " * 300_000,), ("# x = 1",), ("",), (None,), ("\t#",)]
    assert one(settings.parse_settings(frame(lines, "line string"))) == []


def test_large_numbers(frame):
    df = frame([("99999999999999999999 MB",), ("99999999999999999999",), ("3 kB",), ("1 M B",)], "t string")
    got = one(df.select(convert_unit(F.col("t"), F.lit("kB")), quantity_error(F.col("t"), F.lit("kB"))))
    assert got == [(1.024e23, None), (1e20, None), (3.0, None), (None, "Invalid number or unit")]
    catalogue = frame([("n", "integer", None, None, "0", "100")], "name string, vartype string, unit string, enumvals array<string>, min_val string, max_val string")
    values = frame([("u", "n", "99999999999999999999")], "unit string, name string, value string")
    assert one(settings.validate(values, catalogue).select("reason")) == [("above maximum 100",)]
    assert one(frame([("port = 99999999999999999999",)], "t string").select(extract_setting(F.col("t"), "port"))) == [(5432,)]


def test_null_defaults_and_values_are_reported(frame):
    options = frame([("a", None, "DEPRECATED."), ("b", "x", "DEPRECATED.")], "name string, default string, description string")
    values = frame([("u", "a", "1"), ("u", "b", None), ("v", "a", None), ("v", "b", "x")], "unit string, name string, value string")
    assert sorted(one(settings.deprecated_in_use(values, options).select("unit", "name"))) == [("u", "a"), ("u", "b")]


def test_restore_requests_without_a_backup_name(frame):
    day = dt.datetime
    kept = frame([("s", "base_1", day(2024, 1, 1)), ("s", "base_2", day(2024, 1, 2)), ("s", "base_3", day(2024, 1, 2))], "store string, name string, started timestamp_ntz")
    asked = frame([(1, "s", None, None), (2, "s", " ", day(2024, 1, 2)), (3, "t", None, None), (4, "s", "LATEST", None), (5, "s", "base-1", None)],
                  "request_id int, store string, backup string, target_time timestamp_ntz")
    got = {r.request_id: (r.resolved, r.reason) for r in backups.resolve_backup(asked, kept).collect()}
    assert got == {1: ("base_3", None), 2: ("base_1", None), 3: (None, "no backups"), 4: ("base_3", None), 5: ("base_1", None)}


def test_many_members_come_as_rows(frame):
    n = 12_000
    rows = [("c", "db", 1, i, f"u/{i}", None, None, f"host{i}") for i in range(n)]
    df = frame(rows, "cluster string, relname string, relid int, number bigint, unit string, egress string, ingress string, private string")
    assert access.allowed_units(df).count() == access.allowed_subnets(df).count() == n


def test_a_value_with_a_line_break_is_refused(frame):
    texts = frame([(1, "x"), (2, "y\n Port=2\nPORTS = 3")], "doc_id int, text string")
    chosen = frame([(1, "port", "1\nfsync = off"), (2, "port", "1")], "doc_id int, name string, value string")
    got = {r.doc_id: (r.text, r.error) for r in settings.rewrite_managed(texts, chosen).collect()}
    assert got[1] == ("x", "Invalid value of port: it breaks the line")
    assert got[2] == ("y\n# juju # Port=2\nPORTS = 3\n### BEGIN JUJU SETTINGS ###\nport = 1\n### END JUJU SETTINGS ###", None)


def test_relations_of_clusters_are_kept_apart(frame):
    schema = "cluster string, relname string, relid int, service string, user string, schema_user string"
    df = frame([("c", "db", 1, "app", "old", "old_s"), ("d", "db", 1, "web", "old", None), ("d", "db", 2, "web", "juju_web", "")], schema)
    assert sorted(one(access.accounts_to_rename(df))) == [
        ("c", "db", 1, "old", "juju_app"), ("c", "db", 1, "old_s", "juju_app"), ("d", "db", 1, "old", "juju_web")]


def test_what_is_no_position_has_no_number(frame):
    texts = ["zz/1", "1/2/3", "/", "1/", "/1", "12", "0x1/2", "1/2 ", "1/2\n", "", None, "A/b"]
    units = frame([("c", f"u{i}", i, t) for i, t in enumerate(texts)], "cluster string, unit string, number int, position string")
    assert one(replication.elect(units).select("elected", "blocked")) == [("u11", False)]
    assert sorted(r.position for r in replication.malformed_positions(units).collect()) == sorted(t for t in texts[:-2])
    lag = replication.lag_bytes(units, frame([("c", "A/b")], "cluster string, position string"))
    assert {(r.lag, r.in_sync) for r in lag.collect()} == {(None, False), (0, True)}
    only = replication.elect(units.where("unit <> 'u11'")).collect()[0]
    assert only.blocked and only.elected is None


UNIT = ("unit string, ram_mb int, version string, standbys bigint, max_wal_senders bigint, max_connections bigint, wal_keep_segments bigint, "
        "replicated_wal_keep_segments bigint, archive_uri string, forwards_logs boolean")  # fmt: skip


def test_nothing_is_derived_from_what_is_not_known(frame):
    df = frame([("a/1", *[None] * 9), ("a/2", 100, "devel", 1, None, None, 3, None, "s3://x", None)], UNIT)
    got = {r.unit: r.asDict() for r in settings.derive_settings(df).collect()}
    known = {k: v for k, v in got["a/1"].items() if v is not None}
    assert known == {"unit": "a/1", "max_connections": 100, "hot_standby": "true"}
    assert (got["a/2"]["wal_level"], got["a/2"]["password_encryption"], got["a/2"]["max_wal_senders"], got["a/2"]["wal_keep_segments"]) == (None, None, 7, 3)
    assert (got["a/2"]["shared_buffers"], got["a/2"]["archive_mode"]) == ("25 MB", "on")
    forced = settings.derived_rows(settings.derive_settings(df), 9).where("unit = 'a/1'")
    assert sorted(r.name for r in forced.collect()) == ["hot_standby", "max_connections"]


def test_roles_of_units_that_say_nothing(frame):
    rows = [("c", "a/1", False, "a/1", None, "h", "a/2", None, None, None), ("c", "a/2", None, None, None, None, None, True, None, None)]
    df = frame(rows, "cluster string, unit string, manual boolean, master string, anointed string, host string, allowed_units string, "
               "in_recovery boolean, was_cloned boolean, had_peers boolean")  # fmt: skip
    got = {r.unit: r for r in replication.role_flags(df).collect()}
    assert (got["a/1"].state, got["a/1"].message, got["a/1"].is_primary, got["a/1"].cloned) == ("unknown", "unknown", False, False)
    flags = ["has_peers", "had_peers", "is_master", "master_peered", "master_authorized", "has_master", "switchover", "is_anointed", "is_primary", "cloned", "failover"]
    assert all(r[f] is not None for r in got.values() for f in flags)


def test_missing_rows_with_null_keys_and_repeats(frame, tmp_path, spark):
    master = frame([("c", 1, "x"), ("c", None, "x"), ("c", 1, None), ("c", 1, "x"), ("c", 5, "y"), ("d", 1, None)], "cluster string, k int, v string")
    units = frame([("c", "u1"), ("c", "u2"), ("c", "u3"), ("d", "w")], "cluster string, unit string")
    copies = frame(
        [("c", "u1", 1, "x"), ("c", "u1", None, "x"), ("c", "u1", 1, None), ("c", "u1", 5, "y"), ("c", "u2", 1, "x"), ("c", "u2", None, None),
         ("c", "u2", 5, "y"), ("d", "w", None, None), ("c", "gone", 1, "x")], "cluster string, unit string, k int, v string")
    want = {("c", "u2", None, "x"), ("c", "u2", 1, None), ("d", "w", 1, None),
            *(("c", "u3", k, v) for k, v in [(1, "x"), (None, "x"), (1, None), (5, "y")])}
    for buckets in (1, 3, 1024):
        got = one(replication.missing_rows(master, copies, units, ["k", "v"], buckets))
        assert len(got) == len(want) and set(got) == want


def test_equal_copies_are_compared_by_digests_alone(spark, tmp_path):
    rows = spark.range(5000).selectExpr("'c' AS cluster", "id AS k")
    rows.write.parquet(f"{tmp_path}/m")
    rows.crossJoin(spark.range(4).selectExpr("concat('u', id) AS unit")).where("unit <> 'u2' OR k <> 77").write.parquet(f"{tmp_path}/c")
    rows.limit(1).crossJoin(spark.range(4).selectExpr("concat('u', id) AS unit")).select("cluster", "unit").write.parquet(f"{tmp_path}/u")
    frames = [spark.read.parquet(f"{tmp_path}/{x}") for x in "mcu"]
    found = replication.missing_rows(*frames, ["k"])
    assert one(found) == [("c", "u2", 77)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("Initial Plan")[0].splitlines() if "FileScan" in line]
    assert sum(f"{tmp_path}/m" in s or f"{tmp_path}/c" in s for s in scans) <= 2  # each once more, for the opened part alone


def test_gauges_of_odd_columns(frame):
    df = frame([(dt.date(2024, 1, 1), dt.datetime(2024, 1, 1), 5, "x", "7", True, None)], "d date, t timestamp_ntz, `a.b` int, s string, n string, f boolean, `q``c` double")
    gauges = metrics.to_gauges(df, StatSpec(source="x"))
    assert sorted(one(gauges), key=str) == sorted([("a.b", 5.0), ("s", None), ("n", 7.0), ("f", 1.0), ("q`c", 0.0)], key=str)
    lines = metrics.gauge_lines(gauges.unionByName(frame([(None, 1.0)], "metric string, value double")), "p")
    assert sorted(r.line for r in lines.collect()) == ["p.a.b:5|g", "p.f:1|g", "p.n:7|g", "p.q`c:0|g"]


def test_relation_values_that_are_no_texts(frame):
    doc = '{"db":{"db:1":{"a/0":{"port":5432,"x":{"y":1},"n":null,"t":"ok","l":[1],"b":true,"e":""}}}}'
    df = frame([("c", doc), ("d", "junk"), ("e", None)], "cluster string, relations string")
    assert [(r.cluster, r.unit, r.settings) for r in access.flatten_relations(df).collect()] == [("c", "a/0", {"t": "ok", "e": ""})]
    assert sorted((r.key, r.kind) for r in access.rejected_settings(df).collect()) == [("b", "boolean"), ("l", "array"), ("port", "number"), ("x", "object")]


def test_status_documents(frame):
    new = ('{"model":{},"applications":{"pg":{"units":{"pg/0":{"workload-status":{"current":"active","message":"Live master (9.5)"},"leader":true},'
           '"pg/1":{"workload-status":{"message":"Live secondary"}},"pg/2":{},"pg/3":{"workload-status":{"message":7}}}},"idle":{}}}')  # fmt: skip
    old = '{"services":{"pg":{"units":{"pg/9":{"workload-status":{"current":"blocked","message":"Live"},"leader":"no"}}}}}'
    df = frame([(1, new), (2, old), (3, "{"), (4, None), (5, "[]"), (6, '{"applications":{"x":3}}')], "id int, status string")
    got = sorted(access.status_units(df).collect(), key=lambda r: (r.id, r.unit))
    assert [tuple(r) for r in got] == [
        (1, "pg", "pg/0", "active", "Live master (9.5)", True, "master"), (1, "pg", "pg/1", None, "Live secondary", False, "secondary"),
        (1, "pg", "pg/2", None, None, False, None), (1, "pg", "pg/3", None, None, False, None), (2, "pg", "pg/9", "blocked", "Live", False, None),
    ]


def test_extension_items(frame):
    items = "(x,a(b c),hstore ( x ),cube\t(s1) z, , citext(é), plain tail,w(ok"
    df = frame([("d", items)], "datname string, extensions string")
    assert sorted((r.extension, r.schema) for r in access.wanted_extensions(df).collect()) == [
        ("a", "public"), ("citext", "é"), ("cube", "s1"), ("hstore", "public"), ("plain", "public"), ("w", "public")]
    assert sorted(r.item for r in access.refused_extensions(df).collect()) == [" ", "(x"]


def test_assigned_numbers_by_line(frame):
    texts = ["#port = 1\nPort='7'", "x = 1\n  PORT =  8 # y", "port 9", "port = x\nport = 10", "my port = 1", "port==5", "", None, "port=" + "1" * 30 + "\nport=2"]
    df = frame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(one(df.select("i", extract_setting(F.col("t"), "port", 0))))
    assert got == {0: 7, 1: 8, 2: 0, 3: 10, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0}

"""Readers and writers."""

import datetime as dt
import json
import sqlite3

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fleetlens.functions.ordered import numbered
from fleetlens.operators import access, freshness

from fleetlens.session import work_folder
from fleetlens.sources import files, gauge_files, inventory, servers, sinks, snapshots
from fleetlens.specs import DATABASE_SPECS, StatSpec


def test_snapshot_filter_reaches_the_scan(spark, tmp_path, frame):
    spec = DATABASE_SPECS[0]
    frame([("a", 1), ("b", 2)], "datname string, n int").write.parquet(str(tmp_path / f"{spec.relation}.parquet"))
    df = snapshots.snapshot(spark, str(tmp_path), spec, "a")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(datname,a)" in plan
    assert [r.n for r in df.collect()] == [1]
    assert snapshots.snapshot(spark, str(tmp_path), spec).count() == 2


def test_jdbc_options():
    whole = snapshots.jdbc_options("jdbc:x", DATABASE_SPECS[2], "a")
    assert whole["dbtable"] == "pg_stat_user_tables"
    one = snapshots.jdbc_options("jdbc:x", DATABASE_SPECS[0], "o'a")
    assert one["query"] == "SELECT * FROM pg_stat_database WHERE datname = 'o''a'"
    assert StatSpec(table="t", alias="a").label == "a"


def test_inventory(spark, tmp_path):
    listing = tmp_path / "list.tsv"
    listing.write_text("u\t/a b/c.ready\t0\t1704067200.5\n")
    (row,) = files.read_inventory(spark, str(listing)).collect()
    assert tuple(row) == ("u", "/a b/c.ready", 0, dt.datetime(2024, 1, 1, 0, 0, 0, 500000))


def test_backup_listing(spark, tmp_path):
    listing = tmp_path / "list.tsv"
    listing.write_text("name\texpanded_size_bytes\nbase_1\t007\n")
    df = files.read_backup_list(spark, str(listing))
    assert df.dtypes == [("name", "string"), ("expanded_size_bytes", "string")]
    assert [tuple(r) for r in df.collect()] == [("base_1", "007")]


def test_texts(spark, tmp_path):
    (tmp_path / "a.conf").write_text("x = 1\ny = 2\n")
    (row,) = files.read_texts(spark, str(tmp_path / "a.conf")).collect()
    assert row.text == "x = 1\ny = 2\n" and row.path.endswith("a.conf")


def test_catalogue_forms(spark, tmp_path, frame):
    records = {
        "port": {"name": "port", "context": "postmaster", "vartype": "integer", "enumvals": None},
        "wal_level": {"name": "wal_level", "context": "postmaster", "vartype": "enum", "enumvals": ["a", "b"]},
        "block_size": {"name": "block_size", "context": "internal", "vartype": "integer"},
        "datestyle": {"name": "DateStyle", "context": "user", "vartype": "string"},
    }
    document = tmp_path / "one.json"
    document.write_text(json.dumps(records, indent=4))
    whole = files.read_catalogue_document(spark, str(document))
    assert sorted(r.name for r in whole.collect()) == ["datestyle", "port", "wal_level"]
    lines = str(tmp_path / "lines")
    sinks.write_catalogue(whole, lines)
    back = files.read_catalogue(spark, lines)
    assert back.columns == whole.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, whole.collect()))


def test_relations_document(spark, tmp_path):
    path = tmp_path / "rel.json"
    path.write_text('{"db":{"db:1":{"a/1":{"k":"v"}}}}\n')
    assert files.read_relations(spark, str(path)).columns == ["relations"]


def test_gauge_files(spark, tmp_path, frame):
    out = str(tmp_path / "g")
    sinks.write_gauges(frame([("m", 1.0)], "metric string, value double"), out, prefix="p")
    assert [r.value for r in spark.read.text(out).collect()] == ["p.m:1|g"]


def test_routed_files(spark, tmp_path, frame):
    out = str(tmp_path / "r")
    sinks.write_routed(frame([("10.0.0.1", "x"), ("10.0.0.2", "y")], "destination string, line string"), out)
    assert {(r.destination, r.value) for r in spark.read.text(out).collect()} == {("10.0.0.1", "x"), ("10.0.0.2", "y")}


@pytest.mark.parametrize(("tool", "ending"), [("gzip", ".gz"), ("pigz", ".gz"), ("bzip2", ".bz2"), ("none", ".csv")])
def test_export(spark, tmp_path, frame, tool, ending):
    df = frame([("a b", 1), ("a b", 2), ("c", 3)], "datname string, x int")
    done = sinks.export(df, str(tmp_path), "datname", "20240101_000000", tool, 9 if tool == "gzip" else None)
    got = {r.datname: r for r in done.collect()}
    assert set(got) == {"a b", "c"} and got["c"].bytes > 0 and got["c"].status == "written"
    listed = files.list_files(spark, str(tmp_path)).where(F.contains("path", F.lit("part-")))
    assert all(r.path.endswith(ending) for r in listed.collect())
    again = sinks.export(df.limit(0), str(tmp_path), "datname", "20240101_000000", tool)
    assert {(r.datname, r.bytes, r.status) for r in again.collect()} == {(k, v.bytes, "skipped") for k, v in got.items()}


def test_a_broken_export_is_not_taken_for_a_whole_one(spark, tmp_path, frame):
    df = frame([("a", 1)], "datname string, x int")
    sinks.export(df, str(tmp_path), "datname", "s", "none")
    (tmp_path / "s" / "_SUCCESS").unlink()
    assert {r.status for r in sinks.export(df, str(tmp_path), "datname", "s", "none").collect()} == {"incomplete"}


def test_export_options(frame):
    df = frame([("a", 1)], "datname string, x int")
    with pytest.raises(ValueError, match="level"):
        sinks.export(df, "/nowhere", "datname", "s", "gzip", 10)
    with pytest.raises(ValueError, match="tool"):
        sinks.export(df, "/nowhere", "datname", "s", "xz")


class Session:
    """Just enough of a session to ask for a folder."""

    def __init__(self, master, shared):
        self.conf = {"spark.checkpoint.dir": shared}
        self.sparkContext = self
        self.master, self.applicationId = master, f"app-{master}"


def test_work_folder_uses_the_shared_setting():
    shared = Session("spark://x:1", "/shared/place/")
    assert work_folder(shared, "x").startswith("/shared/place/x-")
    assert work_folder(shared, "x") != work_folder(shared, "x")


def test_work_folder_is_local_only_for_local_sessions():
    local = Session("local[2]", None)
    first, second = work_folder(local, "x"), work_folder(local, "y")
    assert first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(Session("spark://x:1", None), "x")


def test_listing_with_empty_markers(spark, tmp_path):
    base = tmp_path / "logs"
    for name, size in [("u1/pg_wal/archive_status/01.ready", 0), ("u1/pg_wal/archive_status/02.done", 0), ("u1/01", 7), ("u2/pg_wal/archive_status/03.ready", 0), ("top.ready", 0)]:
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(b"x" * size)
    (base / "u3").mkdir()
    df = inventory.listed_files(spark, str(base))
    got = {(r.folder, r.path.removeprefix(f"{base}/"), r.size) for r in df.collect()}
    assert got == {("u1", "u1/pg_wal/archive_status/01.ready", 0), ("u1", "u1/pg_wal/archive_status/02.done", 0), ("u1", "u1/01", 7),
                   ("u2", "u2/pg_wal/archive_status/03.ready", 0), ("", "top.ready", 0)}
    assert df.rdd.getNumPartitions() == 4 and df.where("mtime is null").count() == 0
    one = inventory.listed_files(spark, str(base), ["u2"])
    assert one.rdd.getNumPartitions() == 1 and [r.folder for r in one.collect()] == ["u2"]
    ready = freshness.ready_files(inventory.listed_files(spark, str(base), ["u1", "u2"], ".ready").withColumnRenamed("folder", "unit"), str(tmp_path))
    assert {r.unit for r in ready.collect()} == {"u1", "u2"}
    assert [df.where(F.col("folder") == f).count() for f in ("u1", "u2", "none", "u1")] == [3, 1, 0, 3]
    assert inventory.listed_files(spark, f"file://{base}").count() == 5
    assert inventory.listed_files(spark, str(tmp_path / "none")).count() == 0


def test_snapshots_of_live_databases(spark, tmp_path):
    """Database files that only the tasks open, one connection for each that is not left out."""
    targets = []
    for unit in ("u1", "u2"):
        for name in ("a", "b"):
            path = tmp_path / f"{unit}-{name}.db"
            with sqlite3.connect(path) as db:
                db.execute("CREATE TABLE pg_stat_database (datname TEXT, numbackends INT, note TEXT)")
                db.executemany("INSERT INTO pg_stat_database VALUES (?, ?, ?)", [("a", 1, unit), ("b", 2, None)])
                db.execute("CREATE TABLE pg_stat_user_tables (relname TEXT, n_tup_ins INT)")
                db.executemany("INSERT INTO pg_stat_user_tables VALUES (?, ?)", [(f"t{i}", i) for i in range(2500)])
            targets.append({"unit": unit, "datname": name, "connect": {"database": str(path)}})
    targets.append({"unit": "u3", "datname": "a", "connect": {"database": str(tmp_path / "none" / "x.db")}})
    columns = "numbackends bigint, note string"
    with pytest.raises(Exception, match="unable to open"):
        servers.live_snapshot(spark, DATABASE_SPECS[0], columns, targets, "sqlite3", "?").collect()
    df = servers.live_snapshot(spark, DATABASE_SPECS[0], columns, targets[:4], "sqlite3", "?")
    assert df.rdd.getNumPartitions() == 4
    assert sorted(tuple(r) for r in df.collect()) == [(u, d, n, u if d == "a" else None) for u in ("u1", "u2") for d, n in (("a", 1), ("b", 2))]
    assert [df.where(F.col("unit") == u).count() for u in ("u1", "nobody", "u2")] == [2, 0, 2]
    some = servers.live_snapshot(spark, DATABASE_SPECS[0], columns, targets, "sqlite3", "?", datname="b")
    assert some.rdd.getNumPartitions() == 2 and {r.datname for r in some.collect()} == {"b"}
    assert servers.live_snapshot(spark, DATABASE_SPECS[0], columns, targets, "sqlite3", "?", datname="x").count() == 0
    tables = servers.live_snapshot(spark, DATABASE_SPECS[2], "relname string, n_tup_ins bigint", targets[:4], "sqlite3", "?")
    assert tables.groupBy("unit", "datname").count().where("count = 2500").count() == 4


def test_a_trigger_that_comes_again_writes_its_lines_once(tmp_path):
    def lines():
        return sorted(x for f in tmp_path.glob("trigger=*/*.txt") for x in f.read_text().split())

    writer = gauge_files.GaugeWriter(str(tmp_path))
    first = [writer.write(iter([Row("a"), Row("b")])), writer.write(iter([])), writer.write(iter([Row("c")]))]
    assert lines() == []
    lost = writer.write(iter([Row("a")]))  # an attempt of a task whose other attempt counts
    writer.commit([*first, None], 0)
    assert lines() == ["a", "b", "c"]
    writer.commit([writer.write(iter([Row("a"), Row("b"), Row("c")]))], 0)  # the same trigger after a restart
    assert lines() == ["a", "b", "c"]
    (tmp_path / "trigger=1").mkdir()
    (tmp_path / "trigger=1" / "part-00000.txt").write_text("d\n")  # stopped before its mark
    writer.commit([writer.write(iter([Row("d")])), writer.write(iter([Row("e")]))], 1)
    failed = writer.write(iter([Row("f")]))
    writer.abort([failed, None], 2)
    assert lines() == ["a", "b", "c", "d", "e"]
    assert [f"{tmp_path}/_staged/{f.name}" for f in (tmp_path / "_staged").iterdir()] == [lost.path]


def test_gauge_triggers_of_a_stream(spark, tmp_path):
    frame = spark.createDataFrame([(f"m{i}", float(i)) for i in range(50)], "metric string, value double")
    for part in (frame.where("value < 20"), frame.where("value >= 20")):
        part.repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
        gauge_files.write_gauge_triggers(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "p", availableNow=True).awaitTermination()
    got = [x for f in (tmp_path / "out").glob("trigger=*/*.txt") for x in f.read_text().split()]
    assert sorted(got) == sorted(f"p.m{i}:{i}|g" for i in range(50))


def test_rules_are_written_in_order(spark, frame, tmp_path):
    rows = [(f"c{i % 3}", i % 7, f"rule {i}") for i in range(300)] + [("c0", 1, "rule 0")]
    rules = frame(rows, "cluster string, section int, rule string").selectExpr("*", "0L AS relid", "0L AS number", "0L AS pos", "0 AS item")
    lines = access.rules_lines(rules.repartition(5))
    sinks.write_rules(lines, f"{tmp_path}/out")
    for c in ("c0", "c1", "c2"):
        own = sorted((s, r) for k, s, r in rows if k == c)
        want = ["### BEGIN JUJU SETTINGS ###", *(r for _, r in own), "### END JUJU SETTINGS ###"]
        found = [x for f in sorted((tmp_path / "out" / f"cluster={c}").glob("*.txt")) for x in f.read_text().splitlines()]
        assert found == want
        assert [r.line_no for r in lines.where(f"cluster = '{c}'").orderBy("line_no").collect()] == list(range(1, len(want) + 1))


def test_numbers_of_any_rows(spark, frame):
    rows = [(k, v) for k in (None, "a", "b") for v in (3, 1, None, 1, 2)] + [("busy", i) for i in range(500)]
    got = numbered(frame(rows, "k string, v int").repartition(6), ["k"], ["v"], "n").collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r.k, []).append((r.n, r.v))
    for k, found in by_key.items():
        own = sorted((v for x, v in rows if x == k), key=lambda v: (v is not None, v or 0))
        assert sorted(found, key=lambda p: p[0]) == list(enumerate(own, 1))

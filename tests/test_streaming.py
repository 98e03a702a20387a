"""Streams over split files against the batch form."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import events, metrics, replication, sessions
from fleetlens.plans.adapters import Tables
from fleetlens.session import work_folder
from fleetlens.streaming.jobs import change_stream, idle_stream, route_history_stream, route_stream, sample_stream, settled_stream, write_gauge_stream
from fleetlens.streaming.run import drain, read_folder


@pytest.fixture(scope="module")
def tables(spark, small):
    return Tables(spark, small)


@pytest.fixture(scope="module")
def split_events(spark, tables):
    """The events cut by time into files that arrive one after the other."""
    folder = work_folder(spark, "split")
    df = tables["events"].orderBy("ts")
    bounds = df.selectExpr("percentile_approx(event_id, array(0.25, 0.5, 0.75)) AS b").first().b
    edges = [None, *bounds, None]
    for lo, hi in zip(edges, edges[1:]):
        part = df
        if lo is not None:
            part = part.where(F.col("event_id") >= lo)
        if hi is not None:
            part = part.where(F.col("event_id") < hi)
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder


def text(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_changes_across_triggers(spark, tables, split_events):
    stream = tables.adapt("target_values", events=read_folder(spark, split_events, max_files=1))
    out = drain(change_stream(stream, "unit", "target"), "run")
    assert text(spark.read.parquet(out)) == text(events.changes(tables["target_values"], "unit", "target"))


def test_changes_after_a_restart(spark, tables):
    """Three runs from one checkpoint: each finds the last values of the one before, and only new rows."""
    df, folder, base = tables["target_values"], work_folder(spark, "arriving"), work_folder(spark, "restarted")
    cuts = df.selectExpr("percentile_approx(event_id, array(0.3, 0.6)) AS b").first().b
    parts = [df.where(F.col("event_id") < cuts[0]), df.where(F.col("event_id").between(cuts[0], cuts[1] - 1)), df.where(F.col("event_id") >= cuts[1])]
    ordered = df.selectExpr("event_id", "row_number() OVER (ORDER BY ts, event_id) AS n", "row_number() OVER (ORDER BY event_id) AS m")
    assert ordered.where("n <> m").count() == 0  # arrival is in the order of time
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(df.schema).parquet(folder)
        out = drain(change_stream(stream, "unit", "target"), "", base=base)
    assert text(spark.read.parquet(out)) == text(events.changes(df, "unit", "target"))


def test_changes_of_odd_values(spark, frame):
    """Null keys, values and times, negative ids, large numbers, and rows of one time."""
    day = lambda n: datetime(2024, 1, n)
    rows = [
        ("a", day(1), -5, 1 << 60), ("a", day(2), -4, (1 << 60) + 1), ("a", None, 3, None), ("a", day(2), -4, None),
        (None, day(1), 1, 7), (None, day(2), 2, 7), (None, day(3), 3, None), ("b", day(9), 2, 1), ("b", day(9), 1, 1),
    ]
    df = frame(rows, "k string, ts timestamp_ntz, id bigint, v bigint")
    folder = work_folder(spark, "odd")
    df.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    got = spark.read.parquet(drain(change_stream(stream, "k", "v", tie="id"), "odd-run")).collect()
    assert sorted((str(r.k), r.id, r.v, r.previous) for r in got if r.k != "a") == [("None", 1, 7, None), ("None", 3, None, 7), ("b", 1, 1, None)]
    mine = [(r.id, r.v) for r in got if r.k == "a"]
    assert (3, None) in mine and (-5, 1 << 60) in mine and len(mine) >= 3


def test_positions_that_settle_and_that_do_not(spark, frame):
    """Three triggers; the last one only moves the watermark on, so that the time limit passes."""
    at = lambda s: datetime(2024, 1, 1, 0, s // 60, s % 60)
    parts = [
        [("a", at(0), 1, "0/1"), ("a", at(2), 2, "0/2"), ("b", at(1), 3, "0/9"), ("c", at(1), 4, None), ("c", at(2), 5, None)],
        [("a", at(4), 6, "0/2"), ("b", at(30), 7, "0/A"), ("d", at(31), 9, "0/5"), ("d", at(31), 8, "0/5"), ("e", None, 10, "0/1")],
        [("z", at(600), 11, "0/1"), ("a", at(500), 12, "0/3"), ("a", at(501), 13, "0/3")],
    ]
    df, folder, base = frame(sum(parts, []), "unit string, ts timestamp_ntz, sample_id bigint, position string"), work_folder(spark, "in"), work_folder(spark, "run")
    for part in parts:
        frame(part, df.schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(df.schema).parquet(folder)
        out = drain(settled_stream(stream, 60), "", base=base)
    got = {r.unit: (r.position, r.settled_at and r.settled_at.second, r.settled) for r in spark.read.parquet(out).collect()}
    assert got == {"a": ("0/2", 4, True), "d": ("0/5", 31, True), "b": (None, None, False), "c": (None, None, False)}
    batch = {r.unit: (r.position, r.settled_at.second) for r in replication.settled(df.where("ts is not null")).collect()}
    assert batch == {u: v[:2] for u, v in got.items() if v[2]}


def test_samples(spark, tables, split_events):
    stream = tables.adapt("gauges", events=read_folder(spark, split_events, max_files=1))
    out = spark.read.parquet(drain(sample_stream(stream), "samples"))
    got = out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    limit = tables["gauges"].agg(F.max("sampled_at") - F.expr("INTERVAL 10 MINUTES")).first()[0]
    batch = metrics.sample(tables["gauges"])
    closed = batch.where(F.col("bucket") + F.expr("INTERVAL 5 MINUTES") <= F.lit(limit))
    assert text(got) == text(closed)


def test_idle_runs(spark, tables, split_events):
    gap = 6 * 3600
    stream = tables.adapt("activity", events=read_folder(spark, split_events, max_files=2))
    out = spark.read.parquet(drain(idle_stream(stream, gap), "idle"))
    got = out.select(
        "usename",
        F.col("run_start").cast("timestamp_ntz").alias("run_start"),
        F.col("idle_since").cast("timestamp_ntz").alias("idle_since"),
        "n_events",
    )
    limit = tables["activity"].agg(F.max("state_change") - F.expr("INTERVAL 1 MINUTE")).first()[0]
    batch = sessions.idle_runs(tables["activity"], gap)
    closed = batch.where(F.col("idle_since") + F.expr(f"INTERVAL {gap} SECONDS") <= F.lit(limit))
    assert text(got) == text(closed)


def test_routes(spark, tables, split_events):
    stream = tables.adapt("logs", events=read_folder(spark, split_events, max_files=1))
    folder = drain(route_stream(stream, tables["routes"]), "routed", partition_by="destination")
    got = spark.read.parquet(folder)
    assert text(got) == text(events.route(tables["logs"], tables["routes"]))


def test_routes_that_change(spark, frame):
    """Late routes, late lines and a gap between routes, over three triggers of each stream."""
    at = lambda m: datetime(2024, 1, 1, 10 + m // 60, m % 60)
    lines = [[(1, "p", at(5)), (2, "q", at(6))], [(3, "p", at(40)), (4, "p", at(61))], [(5, "p", at(20)), (6, "q", at(90)), (7, "x", at(90))]]
    routes = [[("p", "A", at(0), at(30))], [("q", "B", at(0), at(80)), ("p", "C", at(35), at(60))], [("q", "D", at(85), at(200)), ("q", "E", at(85), at(86))]]
    line_type, route_type = "event_id int, program string, ts timestamp_ntz", "program string, destination string, valid_from timestamp_ntz, valid_to timestamp_ntz"
    base, folders = work_folder(spark, "routed"), [work_folder(spark, "lines"), work_folder(spark, "routes")]
    for some in zip(lines, routes, strict=True):
        for part, kind, folder in zip(some, (line_type, route_type), folders, strict=True):
            frame(part, kind).coalesce(1).write.mode("append").parquet(folder)
        streams = [spark.readStream.schema(k).parquet(f) for k, f in zip((line_type, route_type), folders, strict=True)]
        out = drain(route_history_stream(*streams, "2 hours"), "", base=base)
    got = spark.read.parquet(out).select("event_id", "destination")
    want = events.route_history(frame(sum(lines, []), line_type), frame(sum(routes, []), route_type)).select("event_id", "destination")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, "A"), (2, "B"), (3, "C"), (5, "A"), (6, "D")]


def test_gauge_lines_as_files(spark, tables, split_events, tmp_path):
    stream = tables.adapt("gauges", events=read_folder(spark, split_events, max_files=1))
    out = str(tmp_path / "lines")
    write_gauge_stream(
        stream, out, str(tmp_path / "checkpoint"), prefix="p", availableNow=True
    ).awaitTermination()
    lines = metrics.gauge_lines(tables["gauges"], prefix="p")
    assert text(spark.read.text(out)) == text(lines.withColumnRenamed("line", "value"))


def test_trigger_limits_reach_the_source(spark, split_events):
    stream = read_folder(spark, split_events, max_bytes="1m")
    assert stream.isStreaming

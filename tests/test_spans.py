"""Lines and the routes of their time: the cells they meet by, and that these change no result."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.spans import CELL, cells_by_rank, cells_by_time
from fleetlens.operators.events import route_history
from fleetlens.session import work_folder
from fleetlens.streaming.jobs import route_history_stream
from fleetlens.streaming.run import drain

START = dt.datetime(1969, 12, 30)  # cells on both sides of 1970
LINES = "event_id int, program string, ts timestamp_ntz"
ROUTES = "program string, destination string, valid_from timestamp_ntz, valid_to timestamp_ntz"
LENGTHS = (0, 1, 7, 60, 511, 513, 4000, 90_000, 262_143, 262_145, 2_500_000, 40_000_000)  # seconds, on both sides of each level's limits


@pytest.fixture(scope="module")
def rows():
    """Busy and quiet programs, bursts, shared times, rows that come twice, nulls, empty and reversed routes."""
    pick = random.Random(3)

    def moment():
        return START + dt.timedelta(seconds=pick.choice([pick.randrange(5 * 86_400), 86_400 + pick.randrange(20), pick.randrange(300)]), microseconds=pick.choice([0, 0, pick.randrange(10**6)]))

    def program():
        return pick.choice(["p", "p", "p", "q", "r", None])

    lines = [(i, program(), moment() if i % 40 else None) for i in range(1500)] + [(-1, "p", START)] * 3
    routes = [("p", "all", START, dt.datetime(9999, 1, 1)), ("only_routes", "x", START, START + dt.timedelta(days=9)), ("p", "back", START + dt.timedelta(days=2), START)]
    for i in range(300):
        start = moment()
        end = start + dt.timedelta(seconds=pick.choice(LENGTHS))
        routes.append((program(), f"d{i % 9}", None if i % 50 == 1 else start, None if i % 50 == 2 else end))
    return lines, routes + routes[3:20]


@pytest.fixture
def frames(frame, rows):
    return frame(rows[0], LINES).repartition(3), frame(rows[1], ROUTES).repartition(3)


def plain(lines, routes, longest=None):
    """Every line of a program with every route of it."""
    holds = "l.program = r.program AND l.ts >= r.valid_from AND l.ts < r.valid_to"
    if longest:
        holds += f" AND l.ts < r.valid_from + INTERVAL {longest}"
    return lines.alias("l").join(routes.alias("r"), F.expr(holds)).select("l.*", "r.destination", "r.valid_from")


def text(df):
    return sorted(str(tuple(r[c] for c in ("event_id", "program", "ts", "destination", "valid_from"))) for r in df.collect())


@pytest.mark.parametrize("longest", [None, "30 days", "70 seconds", "2 months", "-1 days"])
def test_routes_of_a_time_equal_the_plain_join(frames, longest):
    want = plain(*frames, longest)
    got = route_history(*frames, longest)
    assert got.columns == want.columns and text(got) == text(want)


def test_empty_sides(frames):
    lines, routes = frames
    assert route_history(lines.limit(0), routes).count() == route_history(lines, routes.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [20, 5_000_000])
def test_a_span_is_compared_with_few_points_that_it_does_not_hold(frames, limit):
    size = 8
    points, spans = frames
    spans = spans.withColumn("span", F.monotonically_increasing_id()).localCheckpoint()
    placed, spread = cells_by_rank(points, spans, ["program"], "ts", "valid_from", "valid_to", size, limit)
    assert placed.groupBy("program", CELL).count().agg(F.max("count")).first()[0] == size
    met = placed.join(spread, ["program", CELL]).withColumn("held", F.expr("ts >= valid_from AND ts < valid_to"))
    assert text(met.where("held")) == text(plain(*frames))
    beyond = met.groupBy("span").agg(F.count_if(~F.col("held")).alias("n")).agg(F.max("n"), F.count("n")).first()
    assert beyond[0] <= 2 * size and beyond[1] > 100


@pytest.mark.parametrize("longest,copies", [("2 hours", 1), ("30 days", 2), ("2 months", 3), (None, 4)])
def test_cells_of_fixed_widths(frames, longest, copies):
    """A line is a row for each level; a pair meets once, and a route has a limited number of cells."""
    lines, routes = frames
    until = F.least("valid_to", F.col("valid_from") + F.expr(f"INTERVAL {longest}")) if longest else F.col("valid_to")
    spans = routes.where("valid_to IS NOT NULL").withColumn("end", until).withColumn("span", F.monotonically_increasing_id()).localCheckpoint()
    placed, spread = cells_by_time(lines, spans, "ts", "valid_from", "end", longest)
    assert placed.count() == copies * lines.count()
    assert spread.groupBy("span").count().agg(F.max("count")).first()[0] <= 1025
    met = placed.join(spread, ["program", CELL]).where("ts >= valid_from AND ts < end")
    assert text(met) == text(plain(lines, routes, longest))


def test_lines_and_routes_meet_by_cells(spark, frames, rows):
    """Not by their programs alone, which compares each line with each route of its program."""
    lines, routes = frames
    folders = [work_folder(spark, "lines"), work_folder(spark, "routes")]
    for df, folder in zip(frames, folders, strict=True):
        df.write.parquet(folder)
    streams = [spark.readStream.schema(df.schema).parquet(f) for df, f in zip(frames, folders, strict=True)]
    for found in (route_history(lines, routes, "30 days"), route_history_stream(*streams)):
        joins = [x for x in found._jdf.queryExecution().analyzed().toString().splitlines() if re.search(r"Join Inner.*_program#", x)]
        assert len(joins) == 1 and re.search(rf"\({CELL}#\d+L? = ", joins[0])


@pytest.mark.parametrize("first", ["lines", "routes"])
def test_streams_of_short_and_long_routes(spark, frame, rows, first):
    """Two triggers, with all lines before all routes or after them, and a delay within which none is late: the plain join's rows."""
    later = dt.timedelta(days=10_000)  # a stream begins at 1970
    lines = [(i, p, t and t + later) for i, p, t in rows[0]]
    routes = [(p, d, a and a + later, b and (b + later if b.year < 9999 else b)) for p, d, a, b in rows[1]]
    base, folders = work_folder(spark, "routed"), [work_folder(spark, "lines"), work_folder(spark, "routes")]
    steps = [(lines, []), ([], routes)] if first == "lines" else [([], routes), (lines, [])]
    for step in steps:
        for some, kind, folder in zip(step, (LINES, ROUTES), folders, strict=True):
            frame(some, kind).coalesce(1).write.mode("append").parquet(folder)
        streams = [spark.readStream.schema(kind).parquet(f) for kind, f in zip((LINES, ROUTES), folders, strict=True)]
        out = drain(route_history_stream(*streams, "30 days", "9 days"), "", base=base)
    got = spark.read.parquet(out).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "valid_from")})
    assert text(got) == text(plain(frame(lines, LINES), frame(routes, ROUTES), "30 days"))

"""Busy keys: the split forms must give what the plain forms give."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.functions.ordered import look_back, previous, slice_busy_keys
from fleetlens.functions import skew
from fleetlens.functions.skew import spread_join, top_rows
from fleetlens.operators.replication import role_history
from fleetlens.operators.sessions import idle_runs

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def history(spark):
    """One key with a third of the rows, most of them in one burst, and shared times."""
    pick = random.Random(5)
    rows = []
    for i in range(3000):
        if i < 200:
            key, at = "busy", START + dt.timedelta(minutes=pick.randrange(40_000))
        elif i < 1000:
            key, at = "busy", START + dt.timedelta(days=9, milliseconds=pick.randrange(400))
        else:
            key, at = f"k{pick.randrange(60)}", START + dt.timedelta(minutes=pick.randrange(40_000))
        rows.append((key, at, i, pick.choice(["a", "b", None])))
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, id bigint, v string").repartition(5)


@pytest.mark.parametrize("limit", [10, 100, 10_000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_look_back_equals_the_plain_window(history, limit, inclusive):
    w = Window.partitionBy("k").orderBy("ts", "id")
    w = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = history.withColumn("was", F.last("v", ignorenulls=True).over(w))
    got = look_back(history, ["k"], "ts", ["id"], F.col("v"), "was", inclusive, limit)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_one_time_is_cut_by_the_tie(spark):
    """A key of which every row has one time: 64 slices of about equal size, and the plain answer."""
    rows = [("busy", START, i, ["a", None, "b"][i * 7 % 3]) for i in range(6400)] + [("busy", START + dt.timedelta(seconds=s), 9000 + s, "c") for s in (-1, 1)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id bigint, v string").repartition(4)
    sizes = [r["count"] for r in slice_busy_keys(df, ["k"], "ts", 100, "id").groupBy("_slice").count().collect()]
    assert 60 <= len(sizes) <= 68 and max(sizes) <= 200
    for inclusive in (True, False):
        w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        want = df.withColumn("was", F.last("v", ignorenulls=True).over(w))
        got = look_back(df, ["k"], "ts", ["id"], F.col("v"), "was", inclusive, 100)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("limit", [10, 10_000])
def test_previous_equals_lag(history, limit):
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = history.select(
        "id", F.lag("v").over(w).alias("was"), (F.row_number().over(w) == 1).alias("first")
    )
    got = previous(history, ["k"], "ts", ["id"], "v", "p", limit).select(
        "id", F.col("p.was").alias("was"), F.col("p").isNull().alias("first")
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_slices_are_small_and_in_order(history):
    limit = 50
    sliced = slice_busy_keys(history, ["k"], "ts", limit)
    sizes = sliced.where("_slice is not null").groupBy("k", "_slice").agg(
        F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )
    rows = sorted(sizes.collect(), key=lambda r: r._slice)
    assert {r.k for r in rows} == {"busy"}
    assert max(r.n for r in rows) <= 2 * limit
    assert len(rows) > 5
    assert all(a.hi < b.lo for a, b in zip(rows, rows[1:]))
    assert sum(r.n for r in rows) == 1000


@pytest.mark.parametrize("limit", [40, 10_000])
def test_idle_runs_split_or_not(history, limit):
    activity = history.select(
        F.col("k").alias("usename"),
        F.col("ts").alias("state_change"),
        F.col("id").alias("pid"),
        F.when(F.col("v") == "a", "idle in transaction").otherwise("idle").alias("state"),
    )
    gap = 3600
    w = Window.partitionBy("usename").orderBy("state_change", "pid")
    seconds = (F.col("state_change").cast("timestamp").cast("double"))
    marked = activity.withColumn(
        "opens", F.coalesce((seconds - F.lag(seconds).over(w)) >= gap, F.lit(True)).cast("int")
    )
    want = (
        marked.withColumn("run", F.sum("opens").over(w))
        .groupBy("usename", "run")
        .agg(
            F.min("state_change").alias("run_start"),
            F.max_by("state", F.struct("state_change", "pid")).alias("state"),
            F.max("state_change").alias("idle_since"),
            F.count("*").alias("n_events"),
        )
        .where("state = 'idle in transaction'")
        .select("usename", "run_start", "idle_since", "n_events")
    )
    got = idle_runs(activity, gap, limit=limit)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_a_join(history, frame, how):
    side = frame([("busy", 1), ("busy", 2), ("k1", 3), ("nobody", 4), (None, 5)], "k string, x int")
    nulls = history.limit(1).withColumn("k", F.lit(None).cast("string")).unionByName(history)
    got = spread_join(nulls, side, ["k"], how)
    want = nulls.join(side, ["k"], how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_busy_keys_of_an_aggregate_are_split(spark, frame):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        big = spark.range(40_000, numPartitions=8).selectExpr("if(id % 2 = 0, -1, id % 50) AS k", "sha(cast(id AS string)) AS v")
        joined = spread_join(big, big.groupBy("k").agg(F.count("v").alias("n")), ["k"])
        assert joined.count() == 40_000
        plain = joined.groupBy().agg(F.max("v"), F.sum("n"))
        plain.collect()
        assert "skew=true" in plain._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("small_top", [1, 1000])
def test_top_rows(history, monkeypatch, small_top):
    monkeypatch.setattr(skew, "SMALL_TOP", small_top)
    w = Window.partitionBy("k").orderBy(F.desc("ts"), F.desc("id"))
    want = history.withColumn("_rn", F.row_number().over(w)).where("_rn <= 7")
    got = top_rows(history, ["k"], ["ts", "id"], 7)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_role_history_of_a_busy_unit(spark):
    """Each event as a map on the two flags, applied one after the other in plain Python."""
    pick = random.Random(8)
    flag = lambda: pick.choice([True, False, None])
    rows = [("busy" if i % 3 else f"u{i % 7}", START + dt.timedelta(seconds=i // 5), i, flag(), pick.random() < 0.1, flag(), i > 90 and flag(), flag()) for i in range(900)]
    df = spark.createDataFrame(rows, "unit string, ts timestamp_ntz, event_id bigint, is_primary boolean, is_master boolean, is_anointed boolean, has_peers boolean, master_peered boolean")
    want, state = [], {}
    for unit, ts, i, primary, master, anointed, peers, peered in rows:
        cloned, had = state.get(unit, (False, False))
        if primary and master:
            cloned = True
        elif primary and not anointed:
            cloned = False
        had = had or bool(peers)
        state[unit] = cloned, had
        want.append((unit, ts, i, cloned, had, bool(not master and peers and not peered and cloned)))
    for limit in (20, 10_000):
        assert sorted(tuple(r) for r in role_history(df.repartition(3), limit).collect()) == sorted(want)

"""What the physical plans must and must not contain."""

import re

import pytest

from fleetlens.plans.catalog import QUERIES

# Their plan only reads what a job or stream has written.
WRITTEN_FIRST = {
    "sampled_stream",
    "idle_stream",
    "route_stream",
    "changes_stream",
    "route_history_stream",
    "export_sizes",
    "backup_list",
    "backup_pairs",
    "catalogue",
}


def plan_of(spark, folder, name):
    return QUERIES[name].frame(spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WRITTEN_FIRST])
def test_no_python_and_no_cross_joins(name, spark, small):
    plan = plan_of(spark, small, name)
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "Exchange SinglePartition"):
        assert node not in plan, node


@pytest.mark.parametrize("name", ["session_states", "session_totals", "session_gauges"])
def test_sessions_take_one_pass(name, spark, small):
    plan = plan_of(spark, small, name)
    assert len(re.findall("FileScan parquet", plan)) == 2  # the database list and the sessions


def test_idle_filter_is_pushed_and_columns_pruned(spark, small):
    plan = plan_of(spark, small, "idle_sessions")
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "LessThan(ts" in scan
    assert "props" not in scan and "value" not in scan


@pytest.mark.parametrize("name", ["tail", "prune_keep_n", "prune_by_run", "discover_leader"])
def test_top_rows_are_cut_before_the_shuffle(name, spark, small):
    assert "WindowGroupLimit" in plan_of(spark, small, name)


@pytest.mark.parametrize("name", ["changes", "status_flags"])
def test_without_busy_keys_the_plain_window_is_left(name, spark, small):
    plan = plan_of(spark, small, name)
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan


# Most scans of all inputs together; an adapter's own unions count, and so do scans of small tables
# written on the way: five of those of missing rows.
MOST_SCANS = {"resolve_backup": 6, "resolve_named_backup": 6, "missing_rows": 10, "connection_strings": 2,
              "role_flags": 6, "allowed_units": 2, "standby_counts": 5, "lag_bytes": 2, "validate": 2}


@pytest.mark.parametrize("name", sorted(MOST_SCANS))
def test_inputs_are_not_read_over_and_over(name, spark, small):
    assert len(re.findall("FileScan parquet", plan_of(spark, small, name))) <= MOST_SCANS[name]

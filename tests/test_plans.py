"""Plan shape: the physical strategies the design relies on."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from runlens import operators as op
from runlens.plans.registry import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_global_newest_is_take_ordered(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    assert "TakeOrderedAndProject" in plan(op.newest(o, None, "o_orderdate", limit=5, tiebreak=["o_orderkey"]))


def test_top_k_per_key_limits_before_shuffle(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    p = plan(op.newest(o, "o_custkey", "o_orderdate", limit=1, tiebreak=["o_orderkey"]))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_missing_runs_is_anti_join_without_cartesian(spark):
    p = plan(QUERIES["sweep_missing"](spark, SF_SMALL))
    assert "LeftAnti" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_prunes_columns(spark):
    p = plan(QUERIES["derived"](spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in p


def test_filter_is_pushed_to_parquet(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    p = plan(op.latest_by_prefix(o, "o_custkey", "o_orderpriority", "o_orderdate", "1-"))
    assert "PushedFilters: [IsNotNull(o_orderpriority), StringStartsWith(o_orderpriority,1-)]" in p


def test_group_position_never_windows_a_whole_group(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    p = plan(op.phase_durations(ev, "user_id", "ts", tiebreak=["event_id"], skew_safe=True))
    assert "rangepartitioning(user_id" in p
    assert "hashpartitioning(user_id#" in p and "_rl_seg" in p


def test_split_plan_moves_rows_twice_at_most(spark):
    """Even with broadcasts off, the boundary fixes (at most 2 (n - 1) rows)
    are broadcast; the sliced rows are not shuffled a third time."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = op.phase_durations(ev, "user_id", "ts", tiebreak=["event_id"], skew_safe=True)
        df.collect()
        p = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.catalog.clearCache()
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    assert "Exchange hashpartitioning(coalesce(user_id" not in p   # no third shuffle of the rows


def test_fix_table_is_broadcast_only_within_its_bound(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    spark.conf.set("spark.runlens.maxBroadcastFixBytes", "64")    # 2 (n - 1) = 14 rows need more
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = op.phase_durations(ev, "user_id", "ts", tiebreak=["event_id"], skew_safe=True)
        got = sorted(tuple(r) for r in df.collect())
        p = df._jdf.queryExecution().executedPlan().toString()
        ref = op.phase_durations(ev, "user_id", "ts", tiebreak=["event_id"], skew_safe=False)
        assert got == sorted(tuple(r) for r in ref.collect())
    finally:
        for k in ("spark.runlens.maxBroadcastFixBytes", "spark.sql.autoBroadcastJoinThreshold",
                  "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)
        spark.catalog.clearCache()
    assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p


def test_no_builder_runs_a_job(spark):
    """Building a query never measures the data, so its plan cannot depend on the data's size."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "builders")
    try:
        op.phase_durations(ev, "user_id", "ts", tiebreak=["event_id"])
        op.run_stats(ev, ["user_id"], "value")
        op.readiness_barrier(ev, "user_id", "ts", "event_type", 5)
        op.assign_ids(ev.withColumn("host", F.col("event_type")), "user_id", "host")
        assert list(tracker.getJobIdsForGroup("build")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_repeated_value_is_one_row_per_slice(spark):
    """Nine of ten readings are equal: the exchange that orders values sees each value of a group once."""
    df = spark.range(20_000).select((F.col("id") % 1).alias("k"), F.when(F.col("id") % 10 != 0, 5.0).otherwise(F.col("id")).alias("v"))
    out = op.run_stats(df, ["k"], "v")
    p = plan(out)
    assert "rangepartitioning(k" in p and "partial_count(1)" in p
    r = out.first()
    assert (r.n, r.p50, r.p90) == (20_000, 5.0, 5.0)


def test_placeholders_move_the_texts_once(spark):
    p = plan(QUERIES["placeholders"](spark, SF_SMALL))
    assert p.count("SortMergeJoin") + p.count("BroadcastHashJoin") == 3      # one builds the variables, one finds values, one brings them to the texts


def test_placeholders_gather_no_environment(spark):
    """Variables are only aggregated by key and name, and no subquery brings them through the driver."""
    for name in ("placeholders_hot_key", "placeholders_global"):
        p = plan(QUERIES[name](spark, SF_SMALL))
        assert "Subquery" not in p and "_rl_name" in p
        for line in p.splitlines():
            if "collect_list" in line and "keys=" in line:
                assert "o_orderkey" in line or "text" in line


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_outcome", "stream_barrier", "stream_deadline"}))
def test_no_python_in_plans(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"):
        assert node not in p, f"{name} runs Python: {node}"
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_sweep_grid_is_generated_not_joined(spark):
    g = op.sweep_grid(spark, 20, {"cores": [48, 96], "fw": ["spark"]})
    p = plan(g)
    assert "Generate" in p and "Join" not in p
    assert g.count() == 40
    _ = F  # noqa


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if q.endswith("_hot") and not q.startswith("stream")))
def test_hot_queries_take_the_split_plan(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert "rangepartitioning(" in p and "_rl_seg" in p
    spark.catalog.clearCache()


def test_hosts_are_made_distinct_after_they_are_dealt(spark):
    """No task that expands expressions keeps a table of the hosts it made (below the exchange there is no aggregate)."""
    df = spark.createDataFrame([(1, "n[1-3]c[1-2],n1"), (1, "n1"), (2, "n1")], "alloc_id int, expr string")
    out = op.expand_hostlist(df)
    plan = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    dealt = next(i for i, line in enumerate(plan) if "RepartitionBy" in line or "Exchange" in line)
    assert not any("Aggregate" in line for line in plan[dealt:]) and any("Aggregate" in line for line in plan[:dealt])
    assert sorted(map(tuple, out.collect())) == [(1, "n1"), *[(1, f"n{a}c{b}") for a in (1, 2, 3) for b in (1, 2)], (2, "n1")]

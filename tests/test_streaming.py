"""Stream = batch for the readiness operators over several micro-batches."""

import os
import time

from pyspark.sql import functions as F

from conftest import SF_SMALL
from runlens import operators as op
from runlens.streaming import event_stream, stream_barrier_table, stream_outcome_table


def _events_in_files(spark, tmp_dir, n=5):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    path = os.path.join(tmp_dir, "events")
    ev.repartition(n).write.parquet(path)
    return ev, path


def _rows(df, cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_stream_outcome_equals_batch(spark, tmp_dir):
    ev, path = _events_in_files(spark, tmp_dir)
    ready = [F.col("event_type") == "signup", F.col("event_type") == "purchase"]
    failed = F.col("event_type") == "error"
    stream = event_stream(spark, path, ev.schema, max_files_per_trigger=1)
    got = stream_outcome_table(spark, stream, "user_id", "ts", ready, failed)
    want = op.first_outcome(ev, "user_id", "ts", ready, failed)
    cols = ["user_id", "outcome", "outcome_ts", "ready_ts", "failed_ts"]
    assert _rows(got, cols) == _rows(want, cols)


def test_stream_barrier_equals_batch(spark, tmp_dir):
    ev, path = _events_in_files(spark, tmp_dir)
    stream = event_stream(spark, path, ev.schema, max_files_per_trigger=2)
    got = stream_barrier_table(spark, stream, "user_id", "ts", "event_type", 4)
    want = op.readiness_barrier(ev, "user_id", "ts", "event_type", 4)
    cols = ["user_id", "expected", "n_members", "start_ts", "ready_ts"]
    assert _rows(got, cols) == _rows(want, cols)


def test_stream_deadline_equals_batch_in_time_order(spark, tmp_dir):
    from runlens.streaming import stream_deadline_table
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    path = os.path.join(tmp_dir, "ordered")
    bucket = F.floor((F.dayofmonth("ts") - 1) / 6)      # five time slices of six days
    for k in range(5):       # written in time order; distinct mtimes keep the file order
        ev.where(bucket == k).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    deadline = 2 * 86400
    stream = event_stream(spark, path, ev.schema, max_files_per_trigger=1)
    failed = F.col("event_type") == "error"
    got = stream_deadline_table(spark, stream, "user_id", "ts", "event_type", 4, deadline,
                                retention_s=40 * 86400,   # users emit events for 30 days
                                failed=failed)
    want = op.barrier_within_deadline(ev, "user_id", "ts", "event_type", 4, deadline, failed=failed)
    last_ms = ev.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).collect()[0][0] // 1000
    want = want.where((F.unix_micros(F.col("start_ts").cast("timestamp")) + deadline * 1_000_000)
                      / 1000 <= F.lit(last_ms - 3_600_000))
    cols = ["user_id", "start_ts", "n_members", "ready_ts", "failed_ts", "outcome", "met"]
    assert _rows(got, cols) == _rows(want, cols)
    assert {r.outcome for r in got.collect()} >= {"ready", "failed"}


def test_stream_deadline_releases_state(spark, tmp_dir):
    """After the verdicts, no job keeps its member table; with a short
    retention the finished-job markers are gone too (state data source)."""
    from runlens.streaming import stream_deadline_barrier
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    for retention, markers_left in ((40 * 86400, True), (86400, False)):
        base = os.path.join(tmp_dir, f"r{retention}")
        stream = event_stream(spark, SF_SMALL, ev.schema, glob="events.parquet")
        out = stream_deadline_barrier(stream, "user_id", "ts", "event_type", 5, 3 * 86400,
                                      retention_s=retention)
        q = (out.writeStream.format("parquet").option("checkpointLocation", f"{base}/ck")
             .trigger(availableNow=True).start(f"{base}/out"))
        q.awaitTermination()
        emitted = spark.read.parquet(f"{base}/out").count()
        assert emitted == ev.select("user_id").distinct().count()
        state = spark.read.format("statestore")
        assert state.option("stateVarName", "info").load(f"{base}/ck").count() == 0
        done = state.option("stateVarName", "done").load(f"{base}/ck").count()
        assert (done == emitted) if markers_left else (done == 0)

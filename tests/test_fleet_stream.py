"""E1-E3 over a stream with a job's members dealt over buckets."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from runlens import operators as op
from runlens.plans.registry import _fleet_events
from runlens.streaming import event_stream, stream_deadline_table, stream_fleet_deadline, stream_fleet_deadline_table
from runlens.streaming.fleet import verdict

COLS = ["job_id", "start_ts", "n_members", "ready_ts", "failed_ts", "outcome", "met"]


@pytest.fixture()
def ordered(spark, tmp_dir):
    """Events of the small table in five time slices, the files in time order."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    path = os.path.join(tmp_dir, "ordered")
    bucket = F.floor((F.dayofmonth("ts") - 1) / 6)
    for k in range(5):
        ev.where(bucket == k).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return ev, path


@pytest.mark.parametrize("buckets,files", [(1, 1), (7, 1), (64, 2)])
def test_equals_batch_for_every_cut(spark, ordered, buckets, files):
    ev, path = ordered
    days = 2
    stream = _fleet_events(event_stream(spark, path, ev.schema, max_files_per_trigger=files)).withColumn("expected", F.lit(4))
    got = stream_fleet_deadline_table(spark, stream, "job_id", "ts", "member", "expected", days * 86400, retention_s=40 * 86400,
                                      failed=F.col("fail"), buckets=buckets)
    want = op.barrier_within_deadline(_fleet_events(ev).withColumn("expected", F.lit(4)), "job_id", "ts", "member", "expected", days * 86400, F.col("fail"))
    rows = lambda df: sorted(map(tuple, df.select(*COLS).collect()), key=repr)
    assert rows(got) == rows(want)
    assert {r.outcome for r in want.collect()} >= {"ready", "failed"}


def test_a_hot_jobs_state_is_spread_and_released(spark, tmp_dir):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    hot = ev.where("event_id % 3 = 0").count()
    assert hot > ev.count() // 4
    held = {}
    for days in (400, 3):        # a deadline that stays open, one that passes
        base = os.path.join(tmp_dir, f"d{days}")
        stream = _fleet_events(event_stream(spark, SF_SMALL, ev.schema, glob="events.parquet"))
        out = stream_fleet_deadline(stream, "job_id", "ts", "member", "expected", days * 86400, retention_s=40 * 86400, failed=F.col("fail"))
        out.writeStream.format("parquet").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
        state = spark.read.format("statestore").option("operatorId", 1).option("stateVarName", "info").load(f"{base}/ck")
        held[days] = state.select("partition_id", "key.*", "value.start_us", F.size("value.members").alias("n")).collect()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mine = [r for r in held[400] if r.job_id == "-1"]
    members = _fleet_events(ev).where("job_id = -1").select("member").distinct().count()
    assert len({r.partition_id for r in mine}) == parts and sum(r.n for r in mine) == members
    assert max(r.n for r in mine) < members / 8
    last = ev.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] - 3_600_000_000
    assert len(held[3]) < 5 and all(r.start_us + 3 * 86_400_000_000 > last for r in held[3])     # only buckets that began in the last days


def test_verdict_equals_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        firsts = [rng.randint(0, 20) for _ in range(rng.randint(0, 8))]
        expected, failed = rng.choice([None, 0, 1, 3, 9]), rng.choice([None, 3, 9, 19])
        n, ready, fail, outcome = verdict(0, expected, failed, np.array(firsts, np.int64), 10)
        kept = sorted(f for f in firsts if f <= 10)
        assert n == len(kept) and ready == (kept[expected - 1] if expected and expected <= len(kept) else None)
        assert fail == (failed if failed is not None and failed <= 10 else None)
        assert outcome == ("ready" if ready is not None and (fail is None or ready <= fail) else "failed" if fail is not None else "timed_out")


def test_rows_without_member_time_or_job(spark, tmp_dir):
    rows = [(None, "2024-01-01 00:00:00", "a", False), (None, "2024-01-01 00:00:05", "b", False), (1, "2024-01-01 00:00:00", None, False),
            (1, "2024-01-01 00:00:01", "a", False), (1, "2024-01-01 00:00:02", "a", True), (2, "2024-01-01 00:00:00", "x", True),
            (2, None, "y", False), (9, "2024-01-09 00:00:00", "z", False)]
    df = spark.createDataFrame(rows, "job_id long, t string, member string, fail boolean").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    path = os.path.join(tmp_dir, "odd")
    df.write.parquet(path)
    got = stream_fleet_deadline_table(spark, event_stream(spark, path, df.schema), "job_id", "ts", "member", 2, 60, failed=F.col("fail"), buckets=4)
    plain = stream_deadline_table(spark, event_stream(spark, path, df.schema), "job_id", "ts", "member", 2, 60, failed=F.col("fail"), partitions=1)
    assert {(r.job_id, r.n_members, r.outcome) for r in plain.collect()} == {(None, 2, "ready"), (1, 1, "failed"), (2, 1, "failed"), (9, 1, "open")}
    assert {(r.job_id, r.n_members, r.outcome) for r in got.collect()} == {(None, 2, "ready"), (1, 1, "failed"), (2, 1, "failed"), (9, 1, "open")}


class _Calls:
    """Stands in for the handle and its states; counts the calls."""

    def __init__(self):
        self.n, self.value, self.timers = 0, {}, []

    def getValueState(self, name, schema):
        calls = self

        class State:
            def exists(self):
                calls.n += 1
                return name in calls.value

            def get(self):
                calls.n += 1
                return calls.value.get(name)

            def update(self, value):
                calls.n += 1
                calls.value[name] = value

            def clear(self):
                calls.n += 1
                calls.value.pop(name, None)
        return State()

    def registerTimer(self, ms):
        self.n += 1
        self.timers.append(ms)

    def deleteTimer(self, ms):
        self.n += 1
        self.timers.remove(ms)


def test_a_bucket_takes_rows_and_makes_few_calls():
    """Keys with a few rows are most of the keys: plain rows in and out, four calls for a new key, two for one that waits."""
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
    from runlens.streaming.fleet import MemberBucket
    handle, bucket = _Calls(), MemberBucket(1_000_000, 5000)
    bucket.init(handle)
    cols = Row("job_id", "b", "us", "member", "expected", "failed")
    key, at = ("1", 0), TimerValues(0, 0)
    assert list(bucket.handleInputRows(key, iter([cols("1", 0, 500, "a", None, False), cols("1", 0, None, "z", 9, False)]), at)) == []
    assert handle.n == 4 and handle.timers == [1001]
    assert list(bucket.handleInputRows(key, iter([cols("1", 0, 900, "b", 2, True), cols("1", 0, 700, "a", None, None)]), at)) == []
    assert handle.n == 6 and handle.timers == [1001]
    out = list(bucket.handleExpiredTimer(key, TimerValues(0, 1001), ExpiredTimerInfo(1001)))
    assert [r.asDict() | {"ets": r.ets.timestamp()} for r in out] == [
        {"job": "1", "ets": 1.002, "start_us": 500, "expected": 2, "failed_us": 900, "firsts": [500, 900]}]
    assert set(handle.value) == {"done"} and handle.timers == [1001, 6001]
    assert list(bucket.handleInputRows(key, iter([cols("1", 0, 950, "c", 3, False)]), at)) == [] and set(handle.value) == {"done"}

"""The deadline barrier (E1-E3) for jobs of any size: a job's members are dealt over buckets.

``runlens.streaming.deadline`` keeps a job's member table in one state value, in one task. Here two stateful operators
are chained in one append-mode query:

1. keyed by (job, bucket of the member's hash): each bucket keeps its members' first registrations, its first event, first
   failure and the expected number. A hot job's table is spread over all state partitions, and a micro-batch rewrites only the
   buckets it touches. When the watermark passes the bucket's first event + deadline, the bucket passes one row on: its
   times by then, in order. Its state is cleared.
2. keyed by job: each bucket's row is appended to a list (never rewritten). When the watermark passes the job's
   start + 2 deadlines, every bucket that began by the deadline has passed its row on; the ordered times are
   merged once (plain long arrays) and one verdict is emitted. Its state is cleared.

So a verdict comes one deadline later than from the one-operator form; its content is the same, for every number of
buckets and every cut of the input into micro-batches. Finished buckets and jobs leave a one-field marker until ``retention`` has passed.

Most keys have a few rows, so both operators take and give plain rows: a data frame per key costs more than the key's state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues,
)

from runlens.functions.ordering import join_on_keys
from runlens.session import scratch_path
from runlens.streaming.deadline import _Fold, _use_rocksdb
from runlens.streaming.readiness import as_key, state_partitions

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 64
PART = "start_us long, expected int, failed_us long, firsts array<long>"


def least(a, b):
    return b if a is None else a if b is None else min(a, b)


def most(a, b):
    return b if a is None else a if b is None else max(a, b)


def verdict(start: int, expected, failed, firsts: np.ndarray, deadline_us: int) -> tuple:
    """(members by the deadline, time of the ``expected``-th, failure by the deadline, outcome)."""
    limit = start + deadline_us
    firsts = np.sort(firsts[firsts <= limit])
    ready = int(firsts[expected - 1]) if expected and 0 < expected <= len(firsts) else None
    failed = failed if failed is not None and failed <= limit else None
    if ready is not None and (failed is None or ready <= failed):
        return len(firsts), ready, failed, "ready"
    return len(firsts), ready, failed, "failed" if failed is not None else "timed_out"


class _Released(StatefulProcessor):
    """A value that is released by a timer, and the marker that stays behind for ``retention_ms``."""

    def finish(self, end_ms: int, now_ms: int) -> None:
        clear_ms = end_ms + self.retention_ms
        if clear_ms > now_ms:
            self.handle.registerTimer(clear_ms)
            self.done.update((clear_ms,))

    def move_timer(self, old, new) -> None:
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)

    def close(self) -> None:
        pass


class MemberBucket(_Released):
    """One bucket of a job's members; the last four input columns are ``(event micros, member, expected, failed)``."""

    def __init__(self, deadline_us: int, retention_ms: int):
        self.deadline_us, self.retention_ms = deadline_us, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.info = handle.getValueState("info", "start_us long, expected int, failed_us long, timer_ms long, members array<string>, firsts array<long>")
        self.done = handle.getValueState("done", "clear_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        acc = _Fold()
        acc.take(row[-4:] for row in rows)
        if acc.start is None:
            return iter([])
        start, expected, failed, timer, firsts = acc.start, acc.expected, acc.failed, None, acc.firsts
        old = self.info.get()
        if old is None:
            if self.done.exists():
                return iter([])
        else:
            start, expected, failed, timer = least(start, old[0]), most(expected, old[1]), least(failed, old[2]), old[3]
            for member, us in zip(old[4], old[5]):
                if us < firsts.get(member, us + 1):
                    firsts[member] = us
        end = -(-(start + self.deadline_us) // 1000)
        self.move_timer(timer, end)
        self.info.update((start, expected, failed, end, list(firsts), list(firsts.values())))
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        info = self.info.get()
        if info is None:
            self.done.clear()
            return iter([])
        start, expected, failed, end, _, firsts = info
        now = timerValues.getCurrentWatermarkInMs()
        self.info.clear()
        self.finish(end, now)
        limit = start + self.deadline_us
        ets = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=now + 1)
        return iter([Row(job=key[0], ets=ets, start_us=start, expected=expected, failed_us=failed, firsts=sorted(f for f in firsts if f <= limit))])


class JobMerge(_Released):
    """Merges the buckets' rows of one job; the last four input columns are those of ``PART``."""

    def __init__(self, deadline_us: int, retention_ms: int):
        self.deadline_us, self.retention_ms = deadline_us, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", PART)
        self.info = handle.getValueState("info", "start_us long, timer_ms long")
        self.done = handle.getValueState("done", "clear_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        got = [tuple(row[-4:]) for row in rows]
        if not got:
            return iter([])
        old = self.info.get()
        if old is None:
            if self.done.exists():
                return iter([])
            old = (None, None)
        start = least(min(g[0] for g in got), old[0])
        end = -(-(start + 2 * self.deadline_us) // 1000)
        self.move_timer(old[1], end)
        self.info.update((start, end))
        self.parts.appendList(got)
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        info = self.info.get()
        if info is None:
            self.done.clear()
            return iter([])
        start, end = info
        expected = failed = None
        firsts = []
        for _, e, f, times in self.parts.get():
            expected, failed = most(expected, e), least(failed, f)
            firsts.append(np.asarray(times, np.int64))
        n, ready, failed, outcome = verdict(start, expected, failed, np.concatenate(firsts), self.deadline_us)
        self.info.clear()
        self.parts.clear()
        self.finish(end, timerValues.getCurrentWatermarkInMs())
        return iter([Row(job=key[0], start_us=start, n_members=n, ready_us=ready, failed_us=failed, outcome=outcome, met=outcome == "ready")])


def stream_fleet_deadline(stream: DataFrame, job: str, ts: str, member: str, expected: str | int, deadline_s: float,
                          delay: str = "1 hour", retention_s: float | None = None, failed: Column | None = None,
                          buckets: int = BUCKETS) -> DataFrame:
    """Streaming E1-E3 in append mode, with a job's members spread over ``buckets`` state keys.

    Columns as ``stream_deadline_barrier``. Jobs keep at most ``buckets`` keys; small jobs have as many as members.
    """
    _use_rocksdb(stream.sparkSession)
    ts_type, job_type = (stream.schema[c].dataType.simpleString() for c in (ts, job))
    exp = F.lit(expected) if isinstance(expected, int) else F.col(expected)
    rows = (stream.withColumn("_rl_ets", F.col(ts).cast("timestamp")).withWatermark("_rl_ets", delay)
            .select(as_key(job), F.pmod(F.hash(F.col(member).cast("string")), F.lit(buckets)).alias("_rl_bucket"), "_rl_ets",
                    F.unix_micros("_rl_ets").alias("_rl_us"), F.col(member).cast("string").alias("_rl_member"),
                    exp.cast("int").alias("_rl_expected"),
                    F.coalesce(failed if failed is not None else F.lit(False), F.lit(False)).alias("_rl_failed")))
    limits = int(round(deadline_s * 1_000_000)), int(1000 * (retention_s if retention_s is not None else deadline_s))
    parts = rows.groupBy(job, "_rl_bucket").transformWithState(
        MemberBucket(*limits), f"job string, ets timestamp, {PART}", "Append", "EventTime", eventTimeColumnName="ets")
    out = parts.groupBy("job").transformWithState(
        JobMerge(*limits), "job string, start_us long, n_members long, ready_us long, failed_us long, outcome string, met boolean",
        "Append", "EventTime")

    def time(c):
        return F.timestamp_micros(c).cast(ts_type)
    return out.select(F.col("job").cast(job_type).alias(job), time("start_us").alias("start_ts"), "n_members", time("ready_us").alias("ready_ts"),
                      time("failed_us").alias("failed_ts"), "outcome", "met")


def stream_fleet_deadline_table(spark: SparkSession, stream: DataFrame, job: str, ts: str, member: str, expected: str | int,
                                deadline_s: float, delay: str = "1 hour", retention_s: float | None = None, failed: Column | None = None,
                                buckets: int = BUCKETS, timeout_s: float | None = None, partitions: int | None = None) -> DataFrame:
    """Run it to the end of the available input. Jobs without a verdict by then get a row from the state both operators left:
    the verdict if their deadline has passed or it is certain, else ``open``."""
    base = scratch_path(spark, "fleet")
    out = stream_fleet_deadline(stream, job, ts, member, expected, deadline_s, delay, retention_s, failed, buckets)
    with state_partitions(spark, partitions):
        q = (out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start(f"{base}/out"))
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError(f"stream did not finish in {timeout_s}s")
    if q.exception():
        raise q.exception()
    marks = [p["eventTime"]["watermark"] for p in q.recentProgress if "watermark" in p.get("eventTime", {})]
    done = spark.read.schema(out.schema).parquet(f"{base}/out")
    return done.unionByName(open_fleet_jobs(spark, f"{base}/checkpoint", done, job, deadline_s, max(marks, default=None)))


def open_fleet_jobs(spark: SparkSession, checkpoint: str, done: DataFrame, job: str, deadline_s: float, watermark: str | None) -> DataFrame:
    """Rows, in the columns of ``done``, of the jobs that only the operators' state holds."""
    def state(operator: int, var: str):
        df = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", var).load(checkpoint)
        return df.withColumn(job, F.col("key").getField(df.schema["key"].dataType.names[0]).cast(done.schema[job].dataType))

    merge, bucket = 0, 1       # operators are numbered from the sink
    waiting = state(bucket, "info").select(job, "value.start_us", "value.expected", "value.failed_us", "value.firsts")
    passed = state(merge, "parts").select(job, "list_element.*")
    over = state(merge, "done").select(job).distinct()
    parts = join_on_keys(waiting.unionByName(passed), over, [job], how="left_anti")
    jobs = parts.groupBy(job).agg(F.min("start_us").alias("start_us"), F.max("expected").alias("expected"), F.min("failed_us").alias("failed_us"))
    limit = F.col("start_us") + F.lit(int(round(deadline_s * 1_000_000)))
    times = join_on_keys(parts.select(job, F.explode("firsts").alias("us")), jobs.select(job, limit.alias("limit")), [job]) \
        .where(F.col("us") <= F.col("limit")).groupBy(job).agg(F.sort_array(F.collect_list("us")).alias("seen"))
    s = join_on_keys(jobs, times, [job], how="left").withColumn("seen", F.coalesce("seen", F.array().cast("array<bigint>")))
    ready = F.when(F.col("expected") > 0, F.get("seen", F.col("expected") - 1))
    failed = F.when(F.col("failed_us") <= limit, F.col("failed_us"))
    over_now = F.lit(watermark).cast("timestamp") if watermark else F.lit(None).cast("timestamp")
    late = F.coalesce(F.unix_micros(over_now) >= limit, F.lit(False))
    outcome = F.when(ready.isNotNull() & (failed.isNull() | (ready <= failed)), "ready") \
        .when(failed.isNotNull(), "failed").when(late, "timed_out").otherwise("open")

    def time(us: Column, name: str) -> Column:
        return F.timestamp_micros(us).cast(done.schema[name].dataType).alias(name)

    return s.select(job, time(F.col("start_us"), "start_ts"), F.size("seen").cast("long").alias("n_members"), time(ready, "ready_ts"),
                    time(failed, "failed_ts"), outcome.alias("outcome"), (outcome == "ready").alias("met"))

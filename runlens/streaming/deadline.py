"""Barrier with a deadline over a stream, with state that is released (E2 + E3).

The native streaming aggregates in ``runlens.streaming.readiness`` keep a few
values per job forever. Here each job's state lives only until its verdict
is final: the watermark has passed ``start + deadline``, so no event that
could change the answer can still arrive. Then one row is emitted and the
job's state is cleared; only a one-field "done" marker stays, so later
events of a finished job do not open a new one. The marker is removed by a
second event-time timer, ``retention`` after the deadline (processing-time
TTL is not available in event-time mode).

State per job (RocksDB), one value: start time, first failure, the
registered timer and the member -> first registration table (bounded by the
job's members), so each job costs one state read and one write per batch. The per-job logic runs in
``transformWithStateInPandas`` on Arrow batches; it only updates minima and,
at the deadline, takes the n-th smallest of at most ``#members`` values.

Verdict (deterministic, independent of micro-batch boundaries):

* ``start_ts``  first event of the job,
* ``n_members`` distinct members first seen by ``start + deadline``,
* ``ready_ts``  time the ``expected``-th distinct member first appeared, if
  that was by the deadline, else NULL,
* ``failed_ts`` first failure event, if by the deadline, else NULL,
* ``outcome``   ``ready`` (ready no later than any failure), ``failed``
  (a failure came first) or ``timed_out`` (neither by the deadline) - the
  wait loop's three exits (E1),
* ``met``       ``outcome = 'ready'``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues,
)

from runlens.streaming.readiness import _run_append, as_key

# The processor is the only Python that runs on executors: ship it by value,
# so workers need no copy of this package (no --py-files step).
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Rows of one list-state element: a key's waiting rows are kept in columns, so an arrival costs one call per so many rows.
CHUNK = 4096


def chunks(*columns: list) -> list[tuple]:
    """The columns cut into tuples of at most ``CHUNK`` values each."""
    return [tuple(c[k:k + CHUNK] for c in columns) for k in range(0, len(columns[0]), CHUNK)]


class _Fold:
    """Minima and maxima of one job's rows: first event, first failure, the
    largest ``expected`` and each member's first time (rows without a time
    are ignored). Data columns arrive by position: the last four are
    ``(event micros, member, expected, failed)``."""

    def __init__(self):
        self.start = self.expected = self.failed = None
        self.firsts: dict[str, int] = {}

    def add(self, pdf: pd.DataFrame) -> None:
        self.take(zip(*(pdf.iloc[:, i].tolist() for i in (-4, -3, -2, -1))))

    def take(self, rows) -> None:
        firsts = self.firsts
        for us, member, exp, fail in rows:
            if us is None or us != us:          # NULL arrives as None or NaN
                continue
            us = int(us)
            if self.start is None or us < self.start:
                self.start = us
            if fail is True or (fail is not None and fail == fail and bool(fail)):
                if self.failed is None or us < self.failed:
                    self.failed = us
            if exp is not None and exp == exp:
                e = int(exp)
                if self.expected is None or e > self.expected:
                    self.expected = e
            if member is not None and member == member:
                old = firsts.get(member)
                if old is None or us < old:
                    firsts[member] = us


class DeadlineBarrier(StatefulProcessor):
    """Per-job state machine; the last four input columns are
    ``(event micros, member, expected, failed)``."""

    def __init__(self, deadline_us: int, retention_ms: int):
        self.deadline_us = deadline_us
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value per job (one state round trip per job and batch); the member
        # table is bounded by the job's members.
        self.info = handle.getValueState(
            "info", "start_us long, expected int, timer_ms long, failed_us long, "
                    "members array<string>, firsts array<long>")
        self.done = handle.getValueState("done", "clear_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame],
                        timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            for _ in rows:   # finished job: later events change nothing
                pass
            return iter([])
        acc = _Fold()
        for pdf in rows:
            acc.add(pdf)
        start, expected, failed, firsts = acc.start, acc.expected, acc.failed, acc.firsts
        if start is None:
            return iter([])
        old_info = self.info.get()
        if old_info is not None:
            start = min(start, old_info[0])
            if old_info[1] is not None:
                expected = old_info[1] if expected is None else max(expected, old_info[1])
            if old_info[3] is not None:
                failed = old_info[3] if failed is None else min(failed, old_info[3])
            for member, us in zip(old_info[4] or [], old_info[5] or []):
                if member not in firsts or us < firsts[member]:
                    firsts[member] = us
        timer_ms = (start + self.deadline_us) // 1000
        if old_info is None or old_info[2] != timer_ms:
            if old_info is not None:
                self.handle.deleteTimer(old_info[2])
            self.handle.registerTimer(timer_ms)
        # Order does not matter (the verdict sorts the times once, at the deadline).
        self.info.update((start, expected, timer_ms, failed, list(firsts), list(firsts.values())))
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues,
                           expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        info = self.info.get()
        if info is None:
            # The retention timer of a finished job: forget it entirely.
            self.done.clear()
            return iter([])
        start, expected, timer_ms, failed, _, member_firsts = info
        limit = start + self.deadline_us
        firsts = sorted(v for v in (member_firsts or []) if v <= limit)
        ready = firsts[expected - 1] if expected and len(firsts) >= expected else None
        if failed is not None and failed > limit:
            failed = None
        if ready is not None and (failed is None or ready <= failed):
            outcome = "ready"
        elif failed is not None:
            outcome = "failed"
        else:
            outcome = "timed_out"
        self.info.clear()
        clear_ms = timer_ms + self.retention_ms
        if clear_ms > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(clear_ms)
            self.done.update((clear_ms,))
        # else the retention has already passed in event time: keep nothing.
        out = pd.DataFrame({"job": [key[0]], "start_us": [start], "n_members": [len(firsts)],
                            "ready_us": [ready], "failed_us": [failed], "outcome": [outcome],
                            "met": [outcome == "ready"]})
        out["ready_us"] = out["ready_us"].astype("Int64")
        out["failed_us"] = out["failed_us"].astype("Int64")
        return iter([out])

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _use_rocksdb(spark: SparkSession) -> None:
    """``transformWithState`` keeps several state variables per key, which only
    the RocksDB state store supports; select it when the session uses the
    default provider (read when a query starts; existing checkpoints keep the
    provider they were created with)."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, None) != ROCKSDB:
        spark.conf.set(key, ROCKSDB)


def stream_deadline_barrier(stream: DataFrame, job: str, ts: str, member: str,
                            expected: str | int, deadline_s: float, delay: str = "1 hour",
                            retention_s: float | None = None,
                            failed: Column | None = None) -> DataFrame:
    """Streaming E2 + E3 with bounded state; append mode, one row per finished job.

    ``delay`` is the watermark delay (how late an event may arrive);
    ``retention_s`` (default: the deadline) is how long after its deadline a
    finished job's marker is kept: events of the job up to then are ignored,
    a job id seen again later starts a new job (and gets its own verdict).
    Pick it at least as long as jobs keep emitting events. The output keeps
    the input's timestamp type for ``start_ts`` / ``ready_ts``.
    """
    _use_rocksdb(stream.sparkSession)
    ts_type = stream.schema[ts].dataType.simpleString()
    job_type = stream.schema[job].dataType.simpleString()
    exp = F.lit(expected) if isinstance(expected, int) else F.col(expected)
    prepared = (stream
                .withColumn("_rl_ets", F.col(ts).cast("timestamp"))
                .withWatermark("_rl_ets", delay)
                .select(as_key(job), "_rl_ets",
                        F.unix_micros("_rl_ets").alias("_rl_us"),
                        F.col(member).cast("string").alias("_rl_member"),
                        exp.cast("int").alias("_rl_expected"),
                        F.coalesce(failed if failed is not None else F.lit(False),
                                   F.lit(False)).alias("_rl_failed")))
    deadline_us = int(round(deadline_s * 1_000_000))
    retention_ms = int(1000 * (retention_s if retention_s is not None else deadline_s))
    out = prepared.groupBy(job).transformWithStateInPandas(
        DeadlineBarrier(deadline_us, retention_ms),
        "job string, start_us long, n_members long, ready_us long, failed_us long, "
        "outcome string, met boolean",
        "Append", "EventTime")
    return out.select(F.col("job").cast(job_type).alias(job),
                      F.timestamp_micros("start_us").cast(ts_type).alias("start_ts"),
                      "n_members",
                      F.timestamp_micros("ready_us").cast(ts_type).alias("ready_ts"),
                      F.timestamp_micros("failed_us").cast(ts_type).alias("failed_ts"),
                      "outcome", "met")


def stream_deadline_table(spark: SparkSession, stream: DataFrame, job: str, ts: str, member: str,
                          expected: str | int, deadline_s: float, delay: str = "1 hour",
                          retention_s: float | None = None, failed: Column | None = None,
                          timeout_s: float | None = None, partitions: int | None = None) -> DataFrame:
    """Run the deadline barrier to the end of the available input; return its table.

    Jobs whose deadline the last watermark has not passed have emitted nothing
    yet. They get a row from the state they left in the checkpoint: ``ready`` or
    ``failed`` if that is already certain from the events so far, else ``open``.
    """
    base = _run_append(spark, stream_deadline_barrier(stream, job, ts, member, expected,
                                                      deadline_s, delay, retention_s, failed),
                       "deadline", timeout_s, partitions)
    done = spark.read.parquet(f"{base}/out")
    return done.unionByName(open_jobs(spark, f"{base}/checkpoint", done, job, deadline_s))


def open_jobs(spark: SparkSession, checkpoint: str, done: DataFrame, job: str, deadline_s: float) -> DataFrame:
    """Rows, in the columns of ``done``, of the jobs that the stream's state still holds."""
    state = spark.read.format("statestore").option("stateVarName", "info").load(checkpoint)
    limit = F.col("value.start_us") + F.lit(int(round(deadline_s * 1_000_000)))
    s = state.select(F.col("key").getField(state.schema["key"].dataType.names[0]).cast(done.schema[job].dataType).alias(job), "value.*", limit.alias("limit"))
    s = s.withColumn("seen", F.sort_array(F.filter("firsts", lambda x: x <= F.col("limit"))))
    ready = F.when(F.col("expected") > 0, F.get("seen", F.col("expected") - 1))
    failed = F.when(F.col("failed_us") <= F.col("limit"), F.col("failed_us"))
    outcome = F.when(ready.isNotNull() & (failed.isNull() | (ready <= failed)), "ready") \
        .when(failed.isNotNull(), "failed").otherwise("open")

    def time(us: Column, name: str) -> Column:
        return F.timestamp_micros(us).cast(done.schema[name].dataType).alias(name)

    return s.select(job, time(F.col("start_us"), "start_ts"), F.size("seen").cast("long").alias("n_members"),
                    time(ready, "ready_ts"), time(failed, "failed_ts"), outcome.alias("outcome"),
                    (outcome == "ready").alias("met"))

"""E1 by job states over a stream: the wait loop as an event-time state machine whose state is released.

Events may arrive in any order within the watermark's delay. A job's unreleased events wait in its list state (appended to in
chunks of columns, never rewritten by an arrival); when the watermark passes them they are replayed in time order, as the wait loop would have seen them:

* the job's state is the one entered last (of several at one instant the last by ``seq``),
* ``ready`` at the first instant at which it is ``Running`` and the marker has been written,
* ``failed`` at the first instant at which it is ``Failed``.

At the first exit one row is emitted (append mode) and the job's state is cleared; a one-field marker that a second timer
removes after ``retention`` keeps later events of a finished job from opening it again. So the state holds the open jobs: their current state, whether the
marker is there, and the events of the last ``delay``. The verdict does not depend on micro-batch boundaries
and equals ``runlens.operators.state_outcome``.

Most jobs have a few events, so the operator takes and gives plain rows: a data frame per job costs more than its state. The events of
one job come in packs (``runlens.streaming.packs``), so a busy job costs its task little per event. Events later than the delay
are dropped, unless they share a pack with others and the job has not been replayed past them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues,
)

from runlens.operators.readiness import state_outcome
from runlens.streaming.deadline import _use_rocksdb, chunks
from runlens.streaming.packs import packed, unpacked
from runlens.streaming.readiness import _run_append, as_key

cloudpickle.register_pickle_by_value(sys.modules[__name__])

INFO = "now string, marked_us long, timer_ms long, seen_us long"
EVENTS = "us array<long>, seq array<long>, state array<string>, mark array<boolean>"
PIECE = 1 << 16
PACKS = 16              # appended at once
EMITTED = "outcome string, outcome_us long"


def replay(now, marked, events, limit: int, running: str, failed: str):
    """Replay ``(us, seq, state, mark)`` up to ``limit``: (state, marker time, outcome, its time, events left)."""
    events = sorted(events, key=lambda e: (e[0], e[1], e[2] or ""))
    i = 0
    while i < len(events) and events[i][0] <= limit:
        us = events[i][0]
        while i < len(events) and events[i][0] == us:
            _, _, state, mark = events[i]
            if state is not None:
                now = state
            if mark and marked is None:
                marked = us
            i += 1
        if now == running and marked is not None:
            return now, marked, "ready", us, []
        if now == failed:
            return now, marked, "failed", us, []
    return now, marked, None, None, events[i:]


class StateOutcome(StatefulProcessor):
    """Per-job machine; the last input column is a pack of ``(event micros, seq, state, mark)``."""

    def __init__(self, running: str, failed: str, retention_ms: int):
        self.running, self.failed, self.retention_ms = running, failed, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.info = handle.getValueState("info", INFO)
        self.waiting = handle.getListState("waiting", EVENTS)
        self.done = handle.getValueState("done", "clear_ms long")

    def keep(self, old_timer, now, marked, first_us, seen_us) -> None:
        """Store the machine, replayed up to ``seen_us``; a timer stands at its first waiting event."""
        timer = None if first_us is None else -(-first_us // 1000)
        if timer != old_timer:
            if old_timer is not None:
                self.handle.deleteTimer(old_timer)
            if timer is not None:
                self.handle.registerTimer(timer)
        self.info.update((now, marked, timer, seen_us))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        old = self.info.get()
        if old is None and self.done.exists():
            for _ in rows:
                pass
            return iter([])
        now, marked, timer, seen_us = old or (None, None, None, None)
        first_us, got = None, []
        for row in rows:
            events = unpacked(row[-1])
            if seen_us is not None and min(events[0]) <= seen_us:
                events = list(zip(*(e for e in zip(*events) if e[0] > seen_us)))
                if not events:
                    continue
            got.append(tuple(events))           # a pack is a chunk of the list
            if len(got) == PACKS:
                self.waiting.appendList(got)
                got = []
            first_us = min(events[0]) if first_us is None else min(first_us, min(events[0]))
        if got:
            self.waiting.appendList(got)
        if first_us is not None and (timer is None or -(-first_us // 1000) < timer):
            self.keep(timer, now, marked, first_us, seen_us)
        return iter([])

    def replayed(self, now, marked, limit: int):
        """``replay`` over what waits, in time order and a piece at a time, none cut within an instant; the columns that are left."""
        parts = [[np.asarray(c, d) for c, d in zip(e, (np.int64, np.int64, object, bool))] for e in self.waiting.get()]
        if not parts:
            return now, marked, None, None, None
        us, seq, state, mark = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(us, kind="stable")
        at, end, k = us[order], int(np.searchsorted(us[order], limit, "right")), 0
        while k < end:
            stop = min(int(np.searchsorted(at, at[min(k + PIECE, end) - 1], "right")), end)
            here = order[k:stop]
            events = list(zip(at[k:stop].tolist(), seq[here].tolist(), state[here].tolist(), mark[here].tolist()))
            now, marked, outcome, when, _ = replay(now, marked, events, limit, self.running, self.failed)
            if outcome is not None:
                return now, marked, outcome, when, None
            k = stop
        rest = order[end:]
        return now, marked, None, None, tuple(c[rest].tolist() for c in (us, seq, state, mark)) if len(rest) else None

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        info = self.info.get()
        if info is None:
            self.done.clear()
            return iter([])
        mark_ms = timerValues.getCurrentWatermarkInMs()
        now, marked, outcome, us, left = self.replayed(info[0], info[1], mark_ms * 1000)
        if left:
            self.waiting.put(chunks(*left))
        else:
            self.waiting.clear()
        if outcome is None:
            self.keep(None, now, marked, left[0][0] if left else None, mark_ms * 1000)
            return iter([])
        self.info.clear()
        clear_ms = us // 1000 + self.retention_ms
        if clear_ms > mark_ms:
            self.handle.registerTimer(clear_ms)
            self.done.update((clear_ms,))
        return iter([Row(job=key[0], outcome=outcome, outcome_us=us)])

    def close(self) -> None:
        pass


def stream_state_outcome(stream: DataFrame, job: str, ts: str, state: str, marker: Column, seq: str | None = None,
                         running: str = "Running", failed: str = "Failed", delay: str = "1 hour",
                         retention_s: float = 86400) -> DataFrame:
    """Streaming E1 by states: one row ``(job, outcome, outcome_ts)`` per finished job, in append mode.

    ``delay`` is how late an event may arrive; ``retention_s`` is how long after its exit a finished job's events are still ignored.
    """
    _use_rocksdb(stream.sparkSession)
    ts_type, job_type = (stream.schema[c].dataType.simpleString() for c in (ts, job))
    rows = stream.where(F.col(ts).isNotNull()).select(
        as_key(job), F.unix_micros(F.col(ts).cast("timestamp")).alias("_rl_us"),
        F.coalesce(F.col(seq).cast("long") if seq else F.lit(0).cast("long"), F.lit(0).cast("long")).alias("_rl_seq"),
        F.col(state).cast("string").alias("_rl_state"), F.coalesce(marker, F.lit(False)).alias("_rl_mark"))
    packs = packed(rows).select(F.col("key").alias(job), F.timestamp_micros("us").alias("_rl_ets"), "pack").withWatermark("_rl_ets", delay)
    out = packs.groupBy(job).transformWithState(
        StateOutcome(running, failed, int(1000 * retention_s)), f"job string, {EMITTED}", "Append", "EventTime")
    return out.select(F.col("job").cast(job_type).alias(job), "outcome", F.timestamp_micros("outcome_us").cast(ts_type).alias("outcome_ts"))


def stream_state_outcome_table(spark: SparkSession, stream: DataFrame, job: str, ts: str, state: str, marker: Column,
                               seq: str | None = None, running: str = "Running", failed: str = "Failed", delay: str = "1 hour",
                               retention_s: float = 86400, timeout_s: float | None = None, partitions: int | None = None) -> DataFrame:
    """Run it to the end of the available input. Jobs without an exit by the last watermark get a row from the state they
    left: the batch operator over what waits there."""
    base = _run_append(spark, stream_state_outcome(stream, job, ts, state, marker, seq, running, failed, delay, retention_s),
                       "state_outcome", timeout_s, partitions)
    done = spark.read.parquet(f"{base}/out")
    return done.unionByName(open_states(spark, f"{base}/checkpoint", done, job, running, failed))


def open_states(spark: SparkSession, checkpoint: str, done: DataFrame, job: str, running: str, failed: str) -> DataFrame:
    """Rows, in the columns of ``done``, of the jobs whose machine the stream's state still holds."""
    def state(var: str) -> DataFrame:
        df = spark.read.format("statestore").option("stateVarName", var).load(checkpoint)
        return df.withColumn(job, F.col("key").getField(df.schema["key"].dataType.names[0]).cast(done.schema[job].dataType))

    info = state("info").select(job, "value.now", "value.marked_us")
    e = F.col("list_element")
    rows = state("waiting").select(job, F.inline(F.arrays_zip(e["us"].alias("us"), e["seq"].alias("seq"), e["state"].alias("state"),
                                                              e["mark"].alias("mark"))).alias("us", "seq", "state", "mark"))
    known = info.select(job, F.coalesce(F.col("marked_us"), F.lit(-(1 << 62))).cast("long").alias("us"), F.lit(0).cast("long").alias("seq"),
                        F.col("now").alias("state"), F.col("marked_us").isNotNull().alias("mark"))   # released: before all that waits
    rows = rows.unionByName(known)
    out = state_outcome(rows, job, "us", "state", F.col("mark"), "seq", running, failed)
    kind = done.schema["outcome_ts"].dataType
    return out.select(job, "outcome", F.timestamp_micros("outcome_ts").cast(kind).alias("outcome_ts"))

"""D3 over a stream: the clock differences of each run's readings, in order, with state that is released.

Readings may arrive in any order within the watermark's delay. Time is cut into spans as long as the delay, and runs are dealt over
shards, so that neither a busy run nor the number of runs decides how many state keys there are or how large one is. Two
operators work in one query, both on columns of whole shards:

1. ``RunClock``, keyed by shard: adds up each run's readings of each span (how many, the first, the last). When the watermark has passed
   a span it tells, for every run of it, where the span starts: the run's readings so far, its first and its last. The run
   then carries only these three.
2. ``PhaseClock``, keyed by (shard, span): the readings themselves wait here (appended to in chunks of columns, never rewritten by an
   arrival). When the starts come, the span's readings are released in time order, each with its position, the difference to the
   reading before it and to the run's first.

So the state of a run is three numbers and the readings of the last two ``delay``, and the spans of a busy run are released by different
tasks. What is emitted does not depend on micro-batch boundaries and equals ``runlens.operators.phase_durations``. A run
without a reading for ``retention`` is forgotten; a later reading of the same run is the first of a new count.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues,
)

from runlens.functions.ordering import join_on_keys
from runlens.operators.recency import phase_durations
from runlens.streaming.deadline import _use_rocksdb, chunks
from runlens.streaming.readiness import _run_append, as_key

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARDS = 64             # of the runs' clocks
WAIT_SHARDS = 4         # of the readings of one span; divides SHARDS
READINGS = "run array<string>, us array<long>, tie array<long>, row array<string>"
COUNTS = "run array<string>, end_us array<long>, n array<long>, first_us array<long>, last_us array<long>"
CLOCKS = "run array<string>, n array<long>, first_us array<long>, last_us array<long>"
OUT_ROWS = 1 << 16


def release(clock: tuple, readings: list[tuple], limit: int, retention_us: int) -> tuple[tuple, list[tuple], list[tuple]]:
    """``(clock after, rows, readings left)``: the readings up to ``limit`` in order; ``clock`` is (readings so far, first, last)."""
    n, first, last = clock
    readings = sorted(readings, key=lambda r: (r[0], r[1]))
    rows = []
    for k, (us, _, row) in enumerate(readings):
        if us > limit:
            return (n, first, last), rows, readings[k:]
        if last is None or us - last > retention_us:
            n, first, last = 0, us, None
        rows.append((n, us, None if last is None else us - last, us - first, row))
        n, last = n + 1, us
    return (n, first, last), rows, []


def walk(run: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, clock: tuple[np.ndarray, ...],
         retention_us: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``release`` over many runs and whole groups of readings: what each group starts from, ``(readings so far, first, last)``.

    ``run`` numbers the runs and ascends; a run's groups of ``n`` readings from ``lo`` to ``hi`` follow one another in time.
    ``clock`` holds (readings so far, first, last) by run number, none so far meaning a run that begins here. A group
    that begins a count starts from (0, its ``lo``, its ``lo``).
    """
    so_far, firsts, lasts = (c[run] for c in clock)
    begin = np.diff(run, prepend=-1) != 0
    last = np.where(begin, lasts, np.roll(hi, 1))
    fresh = np.where(begin, so_far == 0, False) | (lo - last > retention_us)
    at = np.maximum.accumulate(np.where(begin | fresh, np.arange(len(run)), 0))
    before = np.cumsum(n) - n
    return before - before[at] + np.where(fresh, 0, so_far)[at], np.where(fresh, lo, firsts)[at], np.where(fresh, lo, last)


def positions(clock: tuple, us: np.ndarray, retention_us: int) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray]:
    """``release`` over the times of one run's readings in order: ``(clock after, position, difference (-1: none), since the first)``."""
    one = np.zeros(len(us), np.int64)
    n, first, last = walk(one, one + 1, us, us, tuple(np.array([v or 0], np.int64) for v in clock), retention_us)
    return (int(n[-1]) + 1, int(first[-1]), int(us[-1])), n, np.where(n == 0, -1, us - last), us - first


def texts(values) -> np.ndarray:
    """Texts as an array of objects, NULL as None."""
    out = np.empty(len(values), object)
    out[:] = [v if isinstance(v, str) else None for v in values]
    return out


def numbered(*runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Numbers of the runs (NULL is a run), the run of each number, and the numbers again for each array given."""
    codes, names = pd.factorize(np.concatenate(runs), use_na_sentinel=False)
    return codes, texts(names), np.split(codes, np.cumsum([len(r) for r in runs])[:-1])


def columns(state, types: list) -> list[np.ndarray]:
    """The columns of a list state's chunks, joined."""
    parts = [[] for _ in types]
    for chunk in state.get():
        for part, values, kind in zip(parts, chunk, types):
            part.append(texts(values) if kind is object else np.asarray(values, kind))
    return [np.concatenate(p) if p else np.empty(0, t) for p, t in zip(parts, types)]


def summed(run: np.ndarray, end: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry per (run, span), ascending: the readings, the first and the last."""
    order = np.lexsort((end, run))
    run, end = run[order], end[order]
    at = np.flatnonzero((np.diff(run, prepend=-1) != 0) | (np.diff(end, prepend=0) != 0))
    return run[at], end[at], np.add.reduceat(n[order], at), np.minimum.reduceat(lo[order], at), np.maximum.reduceat(hi[order], at)


class RunClock(StatefulProcessor):
    """The clocks of a shard's runs; the last two input columns are run and micros."""

    def __init__(self, span_us: int, retention_us: int):
        self.span_us, self.retention_us = span_us, retention_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", COUNTS)
        self.clock = handle.getListState("clock", CLOCKS)
        self.timer = handle.getValueState("timer", "timer_ms long")

    def set_timer(self, old, new) -> None:
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
            self.timer.update((new,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        least = None
        for pdf in rows:
            if not len(pdf):
                continue
            us = pdf.iloc[:, -1].to_numpy()
            codes, names, _ = numbered(pdf.iloc[:, -2].to_numpy())
            run, end, n, lo, hi = summed(codes, us - us % self.span_us + self.span_us, np.ones(len(us), np.int64), us, us)
            self.open.appendList(chunks(names[run].tolist(), *(c.tolist() for c in (end, n, lo, hi))))
            least = int(end.min()) if least is None else min(least, int(end.min()))
        if least is not None:
            old = self.timer.get()
            due = -(-least // 1000)
            self.set_timer(old and old[0], due if old is None else min(due, old[0]))
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        limit = now_ms * 1000
        text, end, *counts = columns(self.open, [object] + [np.int64] * 4)
        known, *clock = columns(self.clock, [object] + [np.int64] * 3)
        _, names, (run, old) = numbered(text, known)
        state = tuple(np.zeros(len(names), np.int64) for _ in clock)
        for into, values in zip(state, clock):
            into[old] = values
        over = end <= limit
        rest = [c[~over] for c in (run, end, *counts)]
        out = iter([])
        if over.any():
            run, end, n, lo, hi = summed(*(c[over] for c in (run, end, *counts)))
            start = walk(run, n, lo, hi, state, self.retention_us)
            final = np.flatnonzero(np.diff(run, append=-1) != 0)
            for into, values in zip(state, (start[0] + n, start[1], hi)):
                into[run[final]] = values[final]
            out = self.starts(key[0], now_ms, names, run, end, start)
        keep = np.flatnonzero((state[0] > 0) & (state[2] + self.retention_us + self.span_us > limit))
        self.put(self.open, names[rest[0]], *rest[1:])
        self.put(self.clock, names[keep], *(c[keep] for c in state))
        due = [int(rest[1].min())] if len(rest[1]) else []
        if len(keep):       # the next run to be forgotten; every span that ends sooner has its own time
            due.append(int(state[2][keep].min()) + self.retention_us + self.span_us)
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))
            self.timer.update((-(-min(due) // 1000),))
        else:
            self.timer.clear()
        return out

    @staticmethod
    def put(state, run: np.ndarray, *cols: np.ndarray) -> None:
        if len(run):
            state.put(chunks(run.tolist(), *(c.tolist() for c in cols)))
        else:
            state.clear()

    @staticmethod
    def starts(shard, now_ms: int, names, run, end, start) -> Iterator[pd.DataFrame]:
        """One row per span (several if it has many runs): the runs and where they start, as the bytes of four columns (as arrays
        they would cost each row of a batch the whole batch, because Spark measures a batch after every row)."""
        order = np.argsort(end, kind="stable")
        cuts = np.flatnonzero(np.diff(end[order], prepend=end[order[0]] - 1) != 0)
        cuts = np.unique(np.concatenate([cuts, np.arange(0, len(end), OUT_ROWS), [len(end)]]))
        held, rows = 0, []
        ets = pd.Timestamp(now_ms + 1, unit="ms", tz="UTC")
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = order[a:b]
            rows.append((shard, int(end[part[0]]), ets, pickle.dumps((names[run[part]], *(c[part] for c in start)))))
            held += b - a
            if held >= OUT_ROWS or b == len(end):
                yield pd.DataFrame(rows, columns=["shard", "end", "ets", "starts"])
                held, rows = 0, []

    def close(self) -> None:
        pass


class PhaseClock(StatefulProcessor):
    """The waiting readings of one (shard, span); the last five input columns are run, micros, tie, the carried columns as JSON
    and the starts that ``RunClock`` tells (NULL in a row that is a reading)."""

    def __init__(self, retention_us: int):
        self.retention_us = retention_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", READINGS)
        self.clock = handle.getValueState("clock", "n long, first_us long, last_us long")      # of what waits

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        starts, seen = [], None
        for pdf in rows:
            told = pdf.iloc[:, -1].notna().to_numpy()
            if told.any():
                starts += [pickle.loads(s) for s in pdf.iloc[:, -1][told]]
                pdf = pdf[~told]
                if not len(pdf):
                    continue
            run, us, tie, row = (pdf.iloc[:, i].tolist() for i in (-5, -4, -3, -2))
            self.waiting.appendList(chunks(run, us, tie, row))
            seen = seen or [0, us[0], us[0]]
            seen = [seen[0] + len(us), min(seen[1], min(us)), max(seen[2], max(us))]
        if seen or starts:
            old = self.clock.get()
            if old is not None:
                seen = [old[0] + seen[0], min(old[1], seen[1]), max(old[2], seen[2])] if seen else old
        if not starts:
            if seen:
                self.clock.update(tuple(seen))
            return iter([])
        run, us, tie, row = self.held()
        self.waiting.clear()
        self.clock.clear()
        return self.released(run, us, tie, row, starts)

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.ChunkedArray]:
        """The waiting readings in columns: never Python objects all at once."""
        run, us, tie, row = [np.empty(0, object)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
        for r, u, t, w in self.waiting.get():
            run.append(texts(r))
            us.append(np.asarray(u, np.int64))
            tie.append(np.asarray(t, np.int64))
            row.append(pa.array(w, pa.large_string()))
        return np.concatenate(run), np.concatenate(us), np.concatenate(tie), pa.chunked_array(row, pa.large_string())

    def released(self, run, us, tie, row, starts) -> Iterator[pd.DataFrame]:
        told = [np.concatenate(c) for c in zip(*starts)]
        _, names, (code, of) = numbered(run, told[0])
        clock = tuple(np.zeros(len(names), np.int64) for _ in range(3))
        for into, values in zip(clock, told[1:]):
            into[of] = values
        order = np.lexsort((tie, us, code))
        code, us = code[order], us[order]
        n, first, last = walk(code, np.ones(len(us), np.int64), us, us, clock, self.retention_us)
        step = us - last
        row = row.combine_chunks()
        for k in range(0, len(us), OUT_ROWS):
            part = slice(k, k + OUT_ROWS)
            yield pd.DataFrame({"run": pd.Series(names[code[part]], dtype=object), "n": n[part], "us": us[part],
                                "step": pd.arrays.IntegerArray(step[part], n[part] == 0), "total": (us - first)[part],
                                "row": row.take(pa.array(order[part])).to_pylist()})

    def close(self) -> None:
        pass


def _carried(df: DataFrame, run: str, ts: str) -> list[str]:
    return [c for c in df.columns if c not in (run, ts)]


def _carried_back(row: str) -> Column:
    return F.from_json(row, "array<string>")


def _span_us(spark: SparkSession, delay: str, retention_us: int) -> int:
    """The length of a span: the watermark's delay, a second at least, and not more than a run is remembered."""
    delay_us = spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {delay}) AS us").head().us
    return max(1, min(max(delay_us, 1_000_000), retention_us))


def stream_phase_durations(stream: DataFrame, run: str, ts: str, tiebreak: str, seq: str = "seq", step: str = "step_us",
                           total: str = "total_us", delay: str = "1 hour", retention_s: float = 7 * 86400) -> DataFrame:
    """Streaming D3 in append mode: the columns of ``stream`` and ``seq, step, total`` as ``phase_durations`` gives them.

    ``tiebreak`` is a whole-number column that orders readings of one instant (NULL first). ``delay`` is how late a reading may
    arrive; ``retention_s``, not less than it, how long a quiet run is remembered. Readings without a time give no row. The other
    columns travel as text and come back in their own type, so they must be atomic types that a cast to text keeps
    (numbers, text, booleans, dates, times).
    """
    _use_rocksdb(stream.sparkSession)
    kind = {f.name: f.dataType for f in stream.schema}
    rest = _carried(stream, run, ts)
    for c in rest:
        if kind[c].typeName() in ("array", "map", "struct", "binary", "variant"):
            raise TypeError(f"column {c} of type {kind[c].simpleString()} cannot travel as text")
    retention_us = int(retention_s * 1_000_000)
    span_us = _span_us(stream.sparkSession, delay, retention_us)
    rows = (stream.where(F.col(ts).isNotNull()).withColumn("_rl_ets", F.col(ts).cast("timestamp")).withWatermark("_rl_ets", delay)
            .withColumn("_rl_us", F.unix_micros("_rl_ets")).withColumn("_rl_run", F.col(run).cast("string"))
            .withColumn("_rl_shard", F.pmod(F.hash("_rl_run"), F.lit(SHARDS)))
            .withColumn("_rl_end", F.col("_rl_us") - F.pmod("_rl_us", F.lit(span_us)) + F.lit(span_us)))
    clocks = rows.select("_rl_shard", "_rl_ets", "_rl_run", "_rl_us").groupBy("_rl_shard").transformWithStateInPandas(
        RunClock(span_us, retention_us), "shard int, end long, ets timestamp, starts binary", "Append", "EventTime", eventTimeColumnName="ets")
    shard = F.pmod("_rl_shard", F.lit(WAIT_SHARDS)).alias("_rl_shard")
    readings = rows.select(shard, "_rl_end", "_rl_ets", "_rl_run", "_rl_us",
                           F.coalesce(F.col(tiebreak).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("_rl_tie"),
                           F.to_json(F.array(*[F.col(c).cast("string") for c in rest]).cast("array<string>")).alias("_rl_row"),
                           F.lit(None).cast("binary").alias("_rl_starts"))
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("string")
    starts = clocks.select(F.pmod("shard", F.lit(WAIT_SHARDS)).alias("_rl_shard"), F.col("end").alias("_rl_end"), F.col("ets").alias("_rl_ets"),
                           null.alias("_rl_run"), zero.alias("_rl_us"), zero.alias("_rl_tie"), null.alias("_rl_row"),
                           F.col("starts").alias("_rl_starts"))
    out = readings.unionByName(starts).groupBy("_rl_shard", "_rl_end").transformWithStateInPandas(
        PhaseClock(retention_us), "run string, n long, us long, step long, total long, row string", "Append", "EventTime") \
        .withColumn("row", _carried_back("row"))
    back = {c: F.get("row", F.lit(i)).cast(kind[c]) for i, c in enumerate(rest)}
    back |= {run: F.col("run").cast(kind[run]), ts: F.timestamp_micros("us").cast(kind[ts])}
    return out.select(*[back[c].alias(c) for c in stream.columns], F.col("n").alias(seq), F.col("step").alias(step), F.col("total").alias(total))


def stream_phase_table(spark: SparkSession, stream: DataFrame, run: str, ts: str, tiebreak: str, seq: str = "seq", step: str = "step_us",
                       total: str = "total_us", delay: str = "1 hour", retention_s: float = 7 * 86400, timeout_s: float | None = None,
                       partitions: int | None = None) -> DataFrame:
    """Run it to the end of the available input. Readings whose span the last watermark has not passed get their rows from the state they
    wait in: the batch operator over them, going on from what the run carries."""
    out = stream_phase_durations(stream, run, ts, tiebreak, seq, step, total, delay, retention_s)
    base = _run_append(spark, out, "phases", timeout_s, partitions)
    done = spark.read.schema(out.schema).parquet(f"{base}/out")
    return done.unionByName(waiting_readings(spark, f"{base}/checkpoint", done, _carried(stream, run, ts), run, ts, seq, step, total,
                                             int(retention_s * 1_000_000)))


def waiting_readings(spark: SparkSession, checkpoint: str, done: DataFrame, rest: list[str], run: str, ts: str, seq: str, step: str,
                     total: str, retention_us: int) -> DataFrame:
    """Rows, in the columns of ``done``, of the readings that wait in the stream's state."""
    def state(operator: int, var: str, *cols: str) -> DataFrame:
        df = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", var).load(checkpoint)
        return df.select(F.inline(F.arrays_zip(*[f"list_element.{c}" for c in cols])).alias(*[f"_rl_{c}" if c == "run" else c for c in cols]))

    wait, clocks = 0, 1       # operators are numbered from the sink
    clock = state(clocks, "clock", "run", "n", "first_us", "last_us")
    held = state(wait, "waiting", "run", "us", "tie", "row") \
        .withColumn("_rl_at", F.timestamp_micros("us")).withColumn("row", _carried_back("row"))
    own = phase_durations(held, "_rl_run", "_rl_at", tiebreak=["tie"], seq="_rl_seq", step="_rl_step", total="_rl_total")
    both = join_on_keys(own, clock, ["_rl_run"], how="left")
    start = F.col("us") - F.col("_rl_total")
    goes_on = F.coalesce(start - F.col("last_us") <= retention_us, F.lit(False))
    kind = {f.name: f.dataType for f in done.schema}
    back = {c: F.get("row", F.lit(i)).cast(kind[c]) for i, c in enumerate(rest)}
    back |= {run: F.col("_rl_run").cast(kind[run]), ts: F.col("_rl_at").cast(kind[ts]),
             seq: F.col("_rl_seq") + F.when(goes_on, F.col("n")).otherwise(0),
             step: F.coalesce("_rl_step", F.when(goes_on, F.col("us") - F.col("last_us"))),
             total: F.when(goes_on, F.col("us") - F.col("first_us")).otherwise(F.col("_rl_total"))}
    return both.select(*[back[c].cast(kind[c]).alias(c) for c in done.columns])

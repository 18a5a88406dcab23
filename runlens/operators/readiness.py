"""Job readiness from state events (E1-E3), batch form.

The aggregate expressions are shared with ``runlens.streaming``, so a
stream and a batch over the same events give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.ordering import join_on_keys, with_group_position


def _as_list(c: Column | Sequence[Column]) -> list[Column]:
    return [c] if isinstance(c, Column) else list(c)


def outcome_aggs(ts: str, ready: Column | Sequence[Column], failed: Column | None) -> list[Column]:
    """Per-job aggregates: first time each ready condition held, first failure."""
    aggs = [F.min(F.when(c, F.col(ts))).alias(f"_rl_ready_{i}")
            for i, c in enumerate(_as_list(ready))]
    fail = failed if failed is not None else F.lit(False)
    aggs.append(F.min(F.when(fail, F.col(ts))).alias("failed_ts"))
    return aggs


def outcome_columns(job: str, n_ready: int) -> list[Column]:
    """Stateless projection after ``outcome_aggs``.

    Ready = every ready condition has been seen (at the latest of their
    first times) no later than the first failure; failed = a failure came
    first; open = neither (still polling).
    """
    parts = [F.col(f"_rl_ready_{i}") for i in range(n_ready)]
    seen = parts[0].isNotNull()
    for p in parts[1:]:
        seen = seen & p.isNotNull()
    ready_ts = F.when(seen, F.greatest(*parts) if len(parts) > 1 else parts[0])
    failed_ts = F.col("failed_ts")
    is_ready = ready_ts.isNotNull() & (failed_ts.isNull() | (ready_ts <= failed_ts))
    outcome = F.when(is_ready, "ready").when(failed_ts.isNotNull(), "failed").otherwise("open")
    outcome_ts = F.when(is_ready, ready_ts).otherwise(failed_ts)
    return [F.col(job), outcome.alias("outcome"), outcome_ts.alias("outcome_ts"),
            ready_ts.alias("ready_ts"), failed_ts]


def first_outcome(df: DataFrame, job: str, ts: str, ready: Column | Sequence[Column],
                  failed: Column | None = None) -> DataFrame:
    """First terminal outcome per job (E1): ``ready``, ``failed`` or ``open``.

    ``ready`` is one predicate or a list that must all have held at some time:
    conditions that stay true once seen (marker files, registrations). For a
    job *state*, which can be left again, use ``state_outcome``. One hash
    aggregate of minima: map-side partial, so a hot job costs no more than any other.
    """
    n = len(_as_list(ready))
    return df.groupBy(job).agg(*outcome_aggs(ts, ready, failed)).select(*outcome_columns(job, n))


def state_outcome(df: DataFrame, job: str, ts: str, state: str, marker: Column,
                  seq: str | None = None, running: str = "Running", failed: str = "Failed") -> DataFrame:
    """The wait loop's exit per job (E1): ``ready`` at the first instant at which the job **is** ``running`` and its marker
    is there, ``failed`` at the first instant at which it is ``failed``, whichever comes first; ``open`` without either.

    ``state`` holds the state a job enters at ``ts`` (NULL on rows that change none), ``marker`` tells the rows that write
    the marker, which stays. A state lasts until the next one; of several at one instant only the last by ``seq`` counts
    (without ``seq`` the greatest name). ``ready_ts`` and ``failed_ts`` are the two exits' times on their own. Rows without a
    time are ignored; a NULL job is a job.

    Plan: one aggregate per (job, instant), one per job for the marker and the failure, the as-of match as a third: the state
    at the marker and the first run after it. All three combine map-side, and the per-job times are joined back on the job
    (AQE broadcasts them if they are small and splits a hot job's side if not), so no task ever orders a job's events.
    """
    order = F.struct(F.col(seq), F.col(state)) if seq else F.col(state)
    at = df.where(F.col(ts).isNotNull()).groupBy(job, ts).agg(
        F.max_by(F.when(F.col(state).isNotNull(), F.col(state)), F.when(F.col(state).isNotNull(), order)).alias("_rl_state"),
        F.max(F.coalesce(marker, F.lit(False))).alias("_rl_mark"))
    t, now = F.col(ts), F.col("_rl_state")
    times = at.groupBy(job).agg(F.min(F.when(F.col("_rl_mark"), t)).alias("_rl_marked"),
                                F.min(F.when(now == failed, t)).alias("failed_ts"))
    seen = F.col("_rl_marked")
    by_job = join_on_keys(at, times, [job]).groupBy(job).agg(
        F.max_by(now, F.when(now.isNotNull() & (t <= seen), t)).alias("_rl_then"),
        F.min(F.when((now == running) & (t > seen), t)).alias("_rl_later"),
        F.first("_rl_marked").alias("_rl_marked"), F.first("failed_ts").alias("failed_ts"))
    ready = F.when(F.col("_rl_then") == running, seen).otherwise(F.col("_rl_later"))
    won = ready.isNotNull() & (F.col("failed_ts").isNull() | (ready < F.col("failed_ts")))
    return by_job.select(
        job, F.when(won, "ready").when(F.col("failed_ts").isNotNull(), "failed").otherwise("open").alias("outcome"),
        F.when(won, ready).otherwise(F.col("failed_ts")).alias("outcome_ts"), ready.alias("ready_ts"), "failed_ts")


def first_seen(df: DataFrame, job: str, ts: str, member: str,
               expected: str | int) -> DataFrame:
    """Earliest registration of every member of every job."""
    exp = F.lit(expected) if isinstance(expected, int) else F.col(expected)
    return df.groupBy(job, member).agg(F.min(ts).alias("first_ts"),
                                       F.max(exp).cast("int").alias("expected"))


def barrier_from_first_seen(first: DataFrame, job: str, member: str,
                            skew_safe: bool = True) -> DataFrame:
    """Time the ``expected``-th distinct member registered, per job."""
    pos = with_group_position(first, [job], [F.col("first_ts"), F.col(member)],
                              pos_col="_rl_pos", skew_safe=skew_safe)
    return pos.groupBy(job).agg(
        F.max("expected").alias("expected"),
        F.count(F.lit(1)).alias("n_members"),
        F.min("first_ts").alias("start_ts"),
        F.min(F.when(F.col("_rl_pos") == F.col("expected") - 1, F.col("first_ts"))).alias("ready_ts"))


def readiness_barrier(df: DataFrame, job: str, ts: str, member: str,
                      expected: str | int, skew_safe: bool = True) -> DataFrame:
    """When did each job have all its expected members (E2)?

    ``ready_ts`` is when the ``expected``-th distinct member first appeared
    (repeats and overshoot do not matter); NULL if that never happened.
    """
    first = first_seen(df, job, ts, member, expected)
    return barrier_from_first_seen(first, job, member, skew_safe=skew_safe)


def within_deadline(df: DataFrame, start: str, ready: str, seconds: float,
                    out: str = "met") -> DataFrame:
    """``ready - start <= seconds``; a job that never got ready missed it."""
    limit_us = int(round(seconds * 1_000_000))
    diff = F.timestamp_diff("MICROSECOND", F.col(start), F.col(ready))
    return df.withColumn(out, F.coalesce(diff <= F.lit(limit_us), F.lit(False)))


def barrier_within_deadline(df: DataFrame, job: str, ts: str, member: str,
                            expected: str | int, deadline_s: float,
                            failed: Column | None = None, skew_safe: bool = True) -> DataFrame:
    """Batch form of the streaming deadline barrier: the wait loop's verdict.

    Only events by ``start + deadline`` count. ``ready_ts`` is the
    ``expected``-th distinct member's first time (NULL if fewer), ``failed_ts``
    the first event matching ``failed``; ``outcome`` is ``ready``, ``failed``
    or ``timed_out`` and ``met`` is ``outcome = 'ready'``. Equals
    ``runlens.streaming.stream_deadline_barrier`` on every job whose deadline
    the watermark has passed.
    """
    limit_us = F.lit(int(round(deadline_s * 1_000_000)))
    fail = failed if failed is not None else F.lit(False)
    per_job = df.groupBy(job).agg(F.min(ts).alias("_rl_start"),
                                  F.min(F.when(fail, F.col(ts))).alias("_rl_fail"))
    first = first_seen(df, job, ts, member, expected)
    kept = join_on_keys(first, per_job.select(job, "_rl_start"), [job]).where(
        F.timestamp_diff("MICROSECOND", F.col("_rl_start"), F.col("first_ts")) <= limit_us) \
        .drop("_rl_start")
    b = barrier_from_first_seen(kept, job, member, skew_safe=skew_safe)
    fails = per_job.select(job, F.when(
        F.timestamp_diff("MICROSECOND", F.col("_rl_start"), F.col("_rl_fail")) <= limit_us,
        F.col("_rl_fail")).alias("failed_ts"))
    out = join_on_keys(b, fails, [job])
    ready, failed_ts = F.col("ready_ts"), F.col("failed_ts")
    outcome = F.when(ready.isNotNull() & (failed_ts.isNull() | (ready <= failed_ts)), "ready") \
        .when(failed_ts.isNotNull(), "failed").otherwise("timed_out")
    return out.select(job, "start_ts", "n_members", "ready_ts", "failed_ts",
                      outcome.alias("outcome"), (outcome == "ready").alias("met"))

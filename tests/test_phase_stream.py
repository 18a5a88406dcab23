"""D3 over a stream: equal to batch with late and reordered readings; what a run keeps in state."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens import operators as op
from runlens.streaming import event_stream, stream_phase_durations, stream_phase_table
from runlens.streaming.phases import WAIT_SHARDS, positions, release, walk

SCHEMA = "run long, phase string, cost decimal(9,3), tie long, t long"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros(F.col("t") * 1000 + 7).cast("timestamp_ntz")).drop("t")


def deliver(df, path, slice_of, n):
    for k in range(n):
        df.where(slice_of == k).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


def readings(seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 0, 0, 0, 1, 2, 3]), rng.choice(["a", None, "", "c,\"d\""]), None, k if rng.random() < 0.9 else None,
             rng.randint(0, 6_000_000)) for k in range(500)]
    return rows + [(7, "same", None, k, 5_000_000) for k in (3, 1, 2)] + [(8, "end", None, 1, 9_000_000), (0, "end", None, 999, 9_000_000)]


def key(r):
    return tuple(str(x) for x in r)


def test_stream_equals_batch_and_releases_state(spark, tmp_dir):
    df = rows_of(spark, readings()).withColumn("cost", F.col("tie").cast("decimal(9,3)") / 7).withColumn("cost", F.col("cost").cast("decimal(9,3)"))
    path = os.path.join(tmp_dir, "in")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    deliver(df, path, F.floor((ms + F.pmod(F.hash("tie", "ts"), F.lit(100_000))) / 2_000_000), 5)     # up to 100 s late, across files

    def stream():
        return event_stream(spark, path, df.schema, max_files_per_trigger=1)
    got = stream_phase_table(spark, stream(), "run", "ts", "tie", delay="5 minutes", partitions=4)
    want = op.phase_durations(df, "run", "ts", tiebreak=["tie"])
    assert got.dtypes == [(c, dict(want.dtypes)[c]) for c in got.columns] and set(got.columns) == set(want.columns)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.select(*got.columns).collect()))
    base = os.path.join(tmp_dir, "q")
    q = stream_phase_durations(stream(), "run", "ts", "tie", delay="5 minutes", retention_s=600).writeStream.format("parquet")
    q.option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start(f"{base}/out").awaitTermination()

    def held(var):
        return spark.read.format("statestore").option("stateVarName", var).load(f"{base}/ck").count()
    assert held("waiting") == 2 and held("clock") == 2      # the runs that end at the last instant; quiet ones are forgotten


def test_released_rows_do_not_depend_on_the_watermark():
    rng = random.Random(2)
    for _ in range(300):
        all_rows = [(rng.randint(0, 200), k, ["x"]) for k in range(rng.randint(0, 15))]
        whole = release((0, None, None), all_rows, 10 ** 6, 50)[1]
        clock, left, out = (0, None, None), all_rows, []
        for limit in sorted(rng.randint(0, 220) for _ in range(4)) + [10 ** 6]:
            clock, rows, left = release(clock, left, limit, 50)
            out += rows
        assert out == whole and len(out) == len(all_rows)


def test_a_quiet_run_starts_again():
    rows = release((0, None, None), [(0, 0, ["a"]), (50, 0, ["b"]), (101, 0, ["c"])], 1000, 50)[1]
    assert rows == [(0, 0, None, 0, ["a"]), (1, 50, 50, 50, ["b"]), (0, 101, None, 0, ["c"])]


def test_no_readings_and_columns_that_cannot_travel(spark, tmp_dir):
    path = os.path.join(tmp_dir, "empty")
    df = rows_of(spark, [])
    df.write.parquet(path)
    s = event_stream(spark, path, df.schema)
    assert stream_phase_table(spark, s, "run", "ts", "tie").collect() == []
    with pytest.raises(TypeError):
        stream_phase_durations(s.withColumn("bad", F.array("run")), "run", "ts", "tie")


def test_positions_equal_release():
    rng = np.random.default_rng(3)
    for _ in range(300):
        us = np.sort(rng.integers(0, 200, rng.integers(1, 12)))
        clock = [(0, None, None), (4, -30, -5), (1, -90, -90)][rng.integers(3)]
        after, rows, left = release(clock, [(int(u), k, k) for k, u in enumerate(us)], 1000, 50)
        got, seq, step, total = positions(clock, us, 50)
        assert got == after and not left
        assert [(int(n), int(u), None if s < 0 else int(s), int(t)) for n, u, s, t in zip(seq, us, step, total)] == [r[:4] for r in rows]


def test_a_busy_run_waits_in_chunks(spark, tmp_dir):
    rows = [(1, "ab"[k % 2], None, k, 7 * ((k * 7919) % 9000)) for k in range(9000)]
    df = rows_of(spark, rows)
    path, base = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "q")
    df.coalesce(1).write.parquet(path)
    for delay in ("1 day", "20 seconds"):      # all wait at the end; most are released
        got = stream_phase_table(spark, event_stream(spark, path, df.schema), "run", "ts", "tie", delay=delay, partitions=2)
        want = op.phase_durations(df, "run", "ts", tiebreak=["tie"]).select(*got.columns)
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    stream_phase_durations(event_stream(spark, path, df.schema), "run", "ts", "tie", delay="1 day").writeStream.format("parquet").option(
        "checkpointLocation", f"{base}/ck").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{base}/ck").selectExpr("size(list_element.us) AS n").collect()
    assert sum(r.n for r in held) == 9000 and len(held) < 10


def test_walk_over_groups_of_many_runs_equals_release():
    rng = np.random.default_rng(4)
    for _ in range(200):
        runs = [(np.sort(rng.integers(0, 400, rng.integers(1, 15))), [(0, None, None), (4, -30, -5), (1, -90, -90)][rng.integers(3)]) for _ in range(4)]
        rows, want = [], []
        for r, (us, clock) in enumerate(runs):
            told = release(clock, [(int(u), k, k) for k, u in enumerate(us)], 1000, 50)[1]
            at = np.flatnonzero(np.diff(us // 40, prepend=-1) != 0)              # groups as long as 40, so no gap over 50 inside one
            for a, b in zip(at, [*at[1:], len(us)]):
                rows.append((r, b - a, us[a], us[b - 1]))
                n, u, step, total, _ = told[a]
                want.append((n, u - total, u if step is None else u - step))
        clock = tuple(np.array([c[1][i] or 0 for c in runs]) for i in range(3))
        assert list(zip(*(c.tolist() for c in walk(*(np.array(c) for c in zip(*rows)), clock, 50)))) == want


def test_state_keys_follow_neither_the_runs_nor_a_busy_one(spark, tmp_dir):
    """600 runs and one with most readings: what waits lies in a few keys, and the busy run's readings in several of them."""
    rows = [(k % 600 + 10, "a", None, k, (k * 7919) % 7_200_000) for k in range(1800)] + [(1, "b", None, k, 1440 * k) for k in range(5000)]
    df = rows_of(spark, rows)
    path, base = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "q")
    df.coalesce(1).write.parquet(path)
    s = event_stream(spark, path, df.schema)
    got = stream_phase_table(spark, s, "run", "ts", "tie", delay="30 minutes", partitions=4)
    want = op.phase_durations(df, "run", "ts", tiebreak=["tie"]).select(*got.columns)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    stream_phase_durations(s, "run", "ts", "tie", delay="40 minutes").writeStream.format("parquet").option(
        "checkpointLocation", f"{base}/ck").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{base}/ck").select(
        F.col("key"), F.explode("list_element.run").alias("run")).distinct()
    keys = held.select("key").distinct().count()
    assert held.select("run").distinct().count() > 400 and keys <= 2 * WAIT_SHARDS
    assert spark.read.parquet(f"{base}/out").where("run = 1").count() > 1000


def test_readings_later_than_the_delay_reach_neither_operator(spark, tmp_dir):
    hour = 3_600_000
    parts = [[(1, "a", None, k, k * 1000) for k in range(50)] + [(2, "a", None, 0, 5)], [(1, "b", None, 100 + k, 10 * hour + k) for k in range(3)],
             [(2, "b", None, 2, 10 * hour + 9)],       # what the watermark passed before the batch before is late
             [(1, "late", None, 200, hour), (3, "late", None, 200, hour), (1, "b", None, 201, 10 * hour - 60_000)], [(2, "c", None, 1, 14 * hour)],
             [(2, "late", None, 9, 4 * hour), (1, "d", None, 300, 14 * hour)]]
    path = os.path.join(tmp_dir, "late")
    for p in parts:
        rows_of(spark, p).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    df = rows_of(spark, [r for p in parts for r in p])
    got = stream_phase_table(spark, event_stream(spark, path, df.schema, max_files_per_trigger=1), "run", "ts", "tie", delay="1 hour", partitions=2)
    want = op.phase_durations(df.where("phase <> 'late'"), "run", "ts", tiebreak=["tie"]).select(*got.columns)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))

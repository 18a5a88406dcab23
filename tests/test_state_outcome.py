"""E1 by job states: the wait loop's exits, in batch and over a stream, with state that is released."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from runlens import operators as op
from runlens.streaming import event_stream, stream_state_outcome, stream_state_outcome_table
from runlens.streaming.outcome import replay
from runlens.streaming.packs import packed, unpacked

ROWS = "job string, ts timestamp, seq long, state string, mark boolean"


def at(s):
    return f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"


def frame(spark, rows):
    return spark.createDataFrame([(j, at(t) if t is not None else None, n, s, m) for n, (j, t, s, m) in enumerate(rows)],
                                 "job string, ts string, seq long, state string, mark boolean") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def poll(rows):
    """The wait loop, polled at every second of each job's own events."""
    out = {}
    for job in {r[0] for r in rows}:
        mine = sorted(((t, n, s, m) for n, (j, t, s, m) in enumerate(rows) if j == job and t is not None), key=lambda e: e[:2])
        out[job] = ("open", None)
        for now in sorted({e[0] for e in mine}):
            seen = [e for e in mine if e[0] <= now]
            state = next((e[2] for e in reversed(seen) if e[2] is not None), None)
            if state == "Running" and any(e[3] for e in seen):
                out[job] = ("ready", at(now))
                break
            if state == "Failed":
                out[job] = ("failed", at(now))
                break
    return {j: v for j, v in out.items()}


CASES = [
    ("queued again before the marker, then failed", [("a", 1, "Running", False), ("a", 2, "Queued", False), ("a", 3, None, True), ("a", 4, "Failed", False)], ("failed", 4)),
    ("running when the marker comes", [("a", 1, "Running", False), ("a", 3, None, True), ("a", 4, "Failed", False)], ("ready", 3)),
    ("marker before it runs", [("a", 1, None, True), ("a", 2, "Queued", False), ("a", 5, "Running", False)], ("ready", 5)),
    ("failed before the marker", [("a", 1, "Running", False), ("a", 2, "Failed", False), ("a", 3, "Running", False), ("a", 4, None, True)], ("failed", 2)),
    ("never a marker", [("a", 1, "Running", False)], ("open", None)),
    ("marker in the row of the state", [("a", 2, "Running", True)], ("ready", 2)),
    ("left at the same instant", [("a", 1, None, True), ("a", 2, "Running", False), ("a", 2, "Queued", False)], ("open", None)),
    ("failure taken back at the same instant", [("a", 1, None, True), ("a", 2, "Failed", False), ("a", 2, "Running", False)], ("ready", 2)),
    ("without a time", [("a", None, "Failed", True)], None),
]


@pytest.mark.parametrize("name,rows,want", CASES, ids=[c[0] for c in CASES])
def test_cases(spark, name, rows, want):
    got = op.state_outcome(frame(spark, rows), "job", "ts", "state", F.col("mark"), "seq").collect()
    assert [(r.outcome, r.outcome_ts and r.outcome_ts.second) for r in got] == ([want] if want else [])


def test_random_jobs_equal_the_polled_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "x", "y", *"abcdefghijklmnop"]), rng.randint(0, 300),
             rng.choice([None, "Running", "Running", "Queued", "Done"] + ["Failed"] * (rng.random() < 0.2)), rng.random() < 0.08) for _ in range(700)]
    got = op.state_outcome(frame(spark, rows), "job", "ts", "state", F.col("mark"), "seq").collect()
    want = poll(rows)
    assert {r.job: (r.outcome, r.outcome_ts and str(r.outcome_ts)) for r in got} == want
    assert {v[0] for v in want.values()} >= {"ready", "failed"}


def test_no_task_orders_a_jobs_events(spark):
    df = op.state_outcome(frame(spark, CASES[0][1]), "job", "ts", "state", F.col("mark"), "seq")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Python" not in plan


def test_empty_table(spark):
    empty = spark.createDataFrame([], ROWS)
    assert op.state_outcome(empty, "job", "ts", "state", F.col("mark"), "seq").collect() == []


def test_replay_does_not_depend_on_where_the_watermark_stood():
    rng = random.Random(2)
    for _ in range(300):
        events = [(rng.randint(0, 30), n, rng.choice([None, "Running", "Queued", "Failed"]), rng.random() < 0.2) for n in range(rng.randint(0, 12))]
        whole = replay(None, None, events, 100, "Running", "Failed")
        now = marked = outcome = us = None
        left = list(events)
        for limit in sorted(rng.sample(range(100), 3)) + [100]:
            rng.shuffle(left)
            now, marked, outcome, us, left = replay(now, marked, left, limit, "Running", "Failed")
            if outcome:
                break
        assert (outcome, us) == whole[2:4]


def test_stream_equals_batch_with_late_events_and_releases_state(spark, tmp_dir):
    rng = random.Random(4)
    rows = []
    for j in range(60):
        t0 = rng.randint(0, 1500)
        rows += [(f"j{j}", t0 + rng.randint(0, 900), rng.choice([None, "Running", "Queued", "Failed" if j % 3 else "Queued"]), rng.random() < 0.1 and j % 5 > 0)
                 for _ in range(12)]
    df = frame(spark, rows)
    path = os.path.join(tmp_dir, "states")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    slice_of = F.floor((start + F.pmod(F.hash("seq"), F.lit(240))) / 480)     # up to four minutes late, across files
    for k in range(6):
        df.where(slice_of == k).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    cols = ["job", "outcome", "outcome_ts"]
    want = op.state_outcome(df, "job", "ts", "state", F.col("mark"), "seq").select(*cols).collect()
    read = lambda: event_stream(spark, path, df.schema, max_files_per_trigger=1)
    got = stream_state_outcome_table(spark, read(), "job", "ts", "state", F.col("mark"), "seq", delay="5 minutes").select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r.outcome for r in want} == {"ready", "failed", "open"}

    for retention, markers_left in ((86400, True), (60, False)):
        base = os.path.join(tmp_dir, f"r{retention}")
        out = stream_state_outcome(read(), "job", "ts", "state", F.col("mark"), "seq", delay="5 minutes", retention_s=retention)
        out.writeStream.format("parquet").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
        emitted = {r.job for r in spark.read.parquet(f"{base}/out").collect()}
        state = spark.read.format("statestore")
        held = state.option("stateVarName", "info").load(f"{base}/ck").selectExpr("key.job").collect()
        done = state.option("stateVarName", "done").load(f"{base}/ck").count()
        if markers_left:
            assert {r.job for r in held} == {f"j{j}" for j in range(60)} - emitted and done == len(emitted)
        else:
            assert done < len(emitted)


def test_a_busy_jobs_events_wait_in_chunks(spark, tmp_dir):
    """Thousands of events of one job: appended in chunks, replayed in pieces (also when no instant may be cut)."""
    rows = [("hot", (k * 7919) % 1700, "Queued" if k % 3 else None, False) for k in range(9000)]
    rows += [("hot", 1500, None, True), ("hot", 1500, "Running", False), ("late", 1799, "Running", False)]
    df = frame(spark, rows)
    path, base = os.path.join(tmp_dir, "hot"), os.path.join(tmp_dir, "q")
    df.coalesce(1).write.parquet(path)
    cols = ["job", "outcome", "outcome_ts"]
    want = op.state_outcome(df, "job", "ts", "state", F.col("mark"), "seq").select(*cols).collect()
    for delay in ("1 minute", "1 day"):
        got = stream_state_outcome_table(spark, event_stream(spark, path, df.schema), "job", "ts", "state", F.col("mark"), "seq", delay=delay)
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want))
    stream_state_outcome(event_stream(spark, path, df.schema), "job", "ts", "state", F.col("mark"), "seq", delay="1 day").writeStream.format(
        "parquet").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{base}/ck").selectExpr("size(list_element.us) AS n").collect()
    assert sum(r.n for r in held) == len(rows) and len(held) < 10


def test_a_jobs_events_reach_its_state_in_packs(spark, tmp_dir):
    """What the operator is given per job is a few packs, whatever the number of its events; nothing is lost on the way."""
    rows = [(j, k, k * 10, random.Random(k).choice([None, "Running", "Queued"]), k % 9 == 0) for j, n in (("hot", 9000), (None, 5), ("x", 3)) for k in range(n)]
    path = os.path.join(tmp_dir, "in")
    df = spark.createDataFrame(rows, "job string, us long, seq long, state string, mark boolean")
    df.coalesce(1).write.parquet(path)
    packs = packed(spark.read.parquet(path)).collect()
    assert sorted((r.key or "") for r in packs) == ["", "hot", "hot", "hot", "x"]
    back = [(r.key, *e) for r in packs for e in zip(*unpacked(r.pack))]
    assert sorted(map(str, back)) == sorted(map(str, rows))
    assert all(r.us == max(unpacked(r.pack)[0]) for r in packs)
    times = df.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz"))
    times.coalesce(1).write.parquet(path + "2")
    out = stream_state_outcome(event_stream(spark, path + "2", times.schema), "job", "ts", "state", F.col("mark"), "seq")
    assert "MapInArrow" in out._jdf.queryExecution().analyzed().toString()


def test_an_event_before_the_replayed_ones_changes_nothing(spark, tmp_dir):
    """A late event that shares its pack with one in time is not replayed out of order."""
    path = os.path.join(tmp_dir, "late")
    parts = [[("a", 0, "Queued", False), ("b", 0, "Queued", False)], [("a", 1500, "Queued", False), ("b", 1500, None, True)], [("c", 1600, "Queued", False)],
             [("a", 60, "Failed", False), ("a", 1700, None, True), ("b", 70, "Failed", False), ("b", 1701, "Running", False)]]
    for p in parts:
        frame(spark, p).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    got = stream_state_outcome_table(spark, event_stream(spark, path, frame(spark, parts[0]).schema, max_files_per_trigger=1), "job", "ts", "state",
                                     F.col("mark"), "seq", delay="1 minute").collect()
    assert sorted((r.job, r.outcome, r.outcome_ts and str(r.outcome_ts)) for r in got) == [("a", "open", None), ("b", "ready", at(1701)), ("c", "open", None)]

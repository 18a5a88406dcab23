"""D7 over time: starts whose phase never came, in batch and over two streams."""

import os
import random
import time

from pyspark.sql import functions as F

from runlens import operators as op
from runlens.streaming import event_stream, stream_missing_phase, stream_missing_table

SCHEMA = "run string, t long, kind string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))


def brute(rows, limit):
    return sorted(((r, t) for r, t, k in rows if k == "download" and t is not None
                   and not any(k2 == "startup" and r2 == r and t2 is not None and t <= t2 <= t + limit for r2, t2, k2 in rows)), key=repr)


def test_batch_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *"abcdefgh"]), rng.choice([None, *range(2000)]), rng.choice(["download", "startup", "other"])) for _ in range(500)]
    rows += [("z", 5, "download"), ("z", 15, "startup"), ("y", 5, "download"), ("y", 16, "startup"), ("y", 16, "startup"), ("x", 9, "startup"), ("x", 10, "download")]
    df = frame(spark, rows)
    got = op.missing_phase(df.where("kind = 'download'"), df.where("kind = 'startup'"), ["run"], "ts", 10).collect()
    assert sorted(((r.run, r.t) for r in got), key=repr) == sorted(brute(rows, 10), key=repr)
    empty = df.where("1 = 0")
    assert op.missing_phase(empty, df, ["run"], "ts", 10).collect() == []


def test_stream_equals_batch_with_late_events_and_releases_state(spark, tmp_dir):
    rng = random.Random(6)
    rows = [(rng.choice([None, *(f"r{i}" for i in range(30))]), rng.randint(0, 6000), rng.choice(["download", "startup"])) for _ in range(400)]
    rows += [("end", 9000, "download"), ("end", 9001, "startup"), ("last", 9000, "download")]
    df = frame(spark, rows)
    path = os.path.join(tmp_dir, "runs")
    slice_of = F.floor((F.col("t") + F.pmod(F.hash("run", "t"), F.lit(100))) / 2000)       # up to 100 s late, across files
    for k in range(5):
        df.where(slice_of == k).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)

    def sides():
        return [event_stream(spark, path, df.schema, max_files_per_trigger=1).where(f"kind = '{k}'") for k in ("download", "startup")]
    got = stream_missing_table(spark, *sides(), ["run"], "ts", 60, delay="5 minutes").collect()
    want = [x for x in brute(rows, 60) if x[1] + 60 < 9000 - 300]
    assert sorted(((r.run, r.t) for r in got), key=repr) == sorted(want, key=repr) and len(want) > 50
    base = os.path.join(tmp_dir, "q")
    stream_missing_phase(*sides(), ["run"], "ts", 60, delay="5 minutes").writeStream.format("parquet").option(
        "checkpointLocation", f"{base}/ck").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    held = spark.read.format("statestore").option("joinSide", "left").load(f"{base}/ck").count()
    assert held <= 2          # only the starts after the last watermark


def test_a_busy_keys_starts_meet_two_windows_each(spark, tmp_dir):
    """One key (NULL) with many phases in reach of every start: the join keeps windows, not phases, and stays right."""
    rng = random.Random(7)
    rows = [(None, rng.randint(0, 3000), rng.choice(["download", "startup"])) for _ in range(600)]
    rows += [(None, 3000 + 7 * k, "download") for k in range(200)] + [("end", 6000, "download"), ("end", 6000, "startup")]
    df = frame(spark, rows)
    path = os.path.join(tmp_dir, "busy")
    df.coalesce(1).write.parquet(path)

    def sides():
        return [event_stream(spark, path, df.schema).where(f"kind = '{k}'") for k in ("download", "startup")]
    got = stream_missing_table(spark, *sides(), ["run"], "ts", 600, delay="1 minute").collect()
    want = [x for x in brute(rows, 600) if x[1] + 600 < 6000 - 60]
    assert sorted(((r.run, r.t) for r in got), key=repr) == sorted(want, key=repr) and len(want) > 50
    base = os.path.join(tmp_dir, "q")
    stream_missing_phase(*sides(), ["run"], "ts", 10, delay="1 day").writeStream.format("parquet").option(
        "checkpointLocation", f"{base}/ck").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    assert spark.read.format("statestore").option("joinSide", "right").load(f"{base}/ck").count() == 0      # no phase waits one by one

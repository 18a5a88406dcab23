"""Readiness over a stream of state events.

E1 keeps, per job, only the first time of each condition (a few minima);
E2 keeps, per ``(job, member)``, the first registration. Both are native
stateful aggregates in update mode with the RocksDB state store. Each
micro-batch's updated rows are written by ``foreachBatch`` to
``<out>/batch_id=<n>`` with overwrite, so a re-run batch after a failure
replaces its own output (idempotent); the checkpoint lives below the
shared ``spark.checkpoint.dir``. ``latest_versions`` then keeps the last
version per key, which equals the batch result.

State note: a plain streaming ``groupBy`` never evicts keys. For job ids that
grow without end use ``runlens.streaming.deadline`` (E1-E3 in one stateful
processor whose per-job state is released by an event-time timer).
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runlens.operators.readiness import (
    _as_list, barrier_from_first_seen, outcome_aggs, outcome_columns,
)
from runlens.session import scratch_path


def event_stream(spark: SparkSession, path: str, schema: StructType, glob: str | None = None,
                 max_files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A file stream of events (Kafka would be a drop-in source on a cluster)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def stream_first_outcome(stream: DataFrame, job: str, ts: str, ready: Column | Sequence[Column],
                         failed: Column | None = None) -> DataFrame:
    """Streaming E1: same aggregates and projection as the batch form."""
    n = len(_as_list(ready))
    return stream.groupBy(job).agg(*outcome_aggs(ts, ready, failed)) \
        .select(*outcome_columns(job, n))


def stream_first_seen(stream: DataFrame, job: str, ts: str, member: str,
                      expected: str | int) -> DataFrame:
    """Streaming half of E2: first registration per (job, member)."""
    exp = F.lit(expected) if isinstance(expected, int) else F.col(expected)
    return stream.groupBy(job, member).agg(F.min(ts).alias("first_ts"),
                                           F.max(exp).cast("int").alias("expected"))


def run_update_stream(agg_stream: DataFrame, out_path: str, checkpoint: str,
                      trigger: dict | None = None, name: str | None = None):
    """Run an update-mode aggregate, committing each micro-batch under ``out_path``."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = (agg_stream.writeStream.outputMode("update").foreachBatch(commit)
              .option("checkpointLocation", checkpoint)
              .trigger(**(trigger or {"availableNow": True})))
    if name:
        writer = writer.queryName(name)
    return writer.start()


def latest_versions(spark: SparkSession, out_path: str, keys: Sequence[str]) -> DataFrame:
    """Last committed version of every key (partial ``WindowGroupLimit``)."""
    df = spark.read.parquet(out_path)
    w = Window.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    return df.withColumn("_rl_rn", F.row_number().over(w)).where("_rl_rn = 1") \
        .drop("_rl_rn", "batch_id")


def as_key(job: str) -> Column:
    """The job as text, for a stateful pandas operator: one NULL in an Arrow batch turns a column of whole-number keys into
    floats, and other jobs of the batch would share the NULL job's state. Cast back with the job's own type."""
    return F.col(job).cast("string").alias(job)


@contextmanager
def state_partitions(spark: SparkSession, n: int | None):
    """Number of state-store partitions for streams started inside the block.

    A stateful stream fixes its partition count (``spark.sql.shuffle.partitions``)
    when it first starts and keeps it in its checkpoint. The session conf is
    changed only while the query starts (the stream clones the session then).
    """
    if not n:
        yield
        return
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _run(spark: SparkSession, agg: DataFrame, kind: str, timeout_s: float | None,
         partitions: int | None = None) -> str:
    base = scratch_path(spark, kind)
    with state_partitions(spark, partitions):
        q = run_update_stream(agg, f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError(f"stream {kind} did not finish in {timeout_s}s")
    if q.exception():
        raise q.exception()
    return f"{base}/out"


def _append_to(spark: SparkSession, stream: DataFrame, base: str, kind: str, timeout_s: float | None, partitions: int | None = None):
    """Run an append-mode stream into a Parquet file sink (exactly once) below ``base`` to the end of input; the ended query."""
    with state_partitions(spark, partitions):
        q = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start(f"{base}/out"))
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError(f"stream {kind} did not finish in {timeout_s}s")
    if q.exception():
        raise q.exception()
    return q


def last_watermark(query) -> str | None:
    """The watermark an ended query stopped at."""
    return max((p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in p.get("eventTime", {})), default=None)


def _run_append(spark: SparkSession, stream: DataFrame, kind: str, timeout_s: float | None,
                partitions: int | None = None) -> str:
    """``_append_to`` a new folder that holds ``out`` and ``checkpoint``."""
    base = scratch_path(spark, kind)
    _append_to(spark, stream, base, kind, timeout_s, partitions)
    return base


def stream_outcome_table(spark: SparkSession, stream: DataFrame, job: str, ts: str,
                         ready: Column | Sequence[Column], failed: Column | None = None,
                         timeout_s: float | None = None, partitions: int | None = None) -> DataFrame:
    """Run streaming E1 to the end of the available input; return its result table."""
    out = _run(spark, stream_first_outcome(stream, job, ts, ready, failed), "outcome", timeout_s,
               partitions)
    return latest_versions(spark, out, [job])


def stream_barrier_table(spark: SparkSession, stream: DataFrame, job: str, ts: str, member: str,
                         expected: str | int, timeout_s: float | None = None,
                         partitions: int | None = None) -> DataFrame:
    """Run streaming first-seen to the end of the input, then the barrier."""
    out = _run(spark, stream_first_seen(stream, job, ts, member, expected), "barrier", timeout_s,
               partitions)
    return barrier_from_first_seen(latest_versions(spark, out, [job, member]), job, member)

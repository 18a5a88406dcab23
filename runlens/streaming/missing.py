"""D7 on live traces: runs that began and whose expected phase never came.

A run whose workers never all register leaves no ``startup`` line, so nothing in the stream tells of it. The finished phases
of a key are reduced to the first and last time of each window as long as the limit (a native windowed aggregate): a start in
window ``b`` has its phase if the last one of ``b`` is not before it, or the first one of ``b + 1`` not past its limit. So the
starts meet at most two rows each in a native stream-stream left outer join, however many phases a key has, and a busy key is
dealt over its windows. All state is released by the watermark: a start that found its phase leaves when both windows have
passed, one that found none is then reported once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import scratch_path
from runlens.streaming.deadline import _use_rocksdb
from runlens.streaming.readiness import _append_to, last_watermark


def _micros(limit_s: float) -> int:
    return int(round(limit_s * 1_000_000))


def _width(limit_s: float) -> int:
    return max(_micros(limit_s), 1)


def _bucket(us: Column, limit_s: float) -> Column:
    width = F.lit(_width(limit_s))
    return ((us - F.pmod(us, width)) / width).cast("long")


def _by_start(windows: DataFrame, keys: Sequence[str], limit_s: float) -> DataFrame:
    """Each window (``_rl_min``, ``_rl_max``, ``_rl_end``) under the bucket of the starts it can end: its own and the one before."""
    at = _bucket(F.unix_micros("_rl_min"), limit_s)
    side = F.explode(F.array(F.struct(at.alias("b"), F.lit(True).alias("own")), F.struct((at - 1).alias("b"), F.lit(False).alias("own"))))
    return windows.withColumn("_rl_s", side).select(*[F.col(k).alias(f"_rl_p_{k}") for k in keys], F.col("_rl_s.b").alias("_rl_pb"),
                                                    F.col("_rl_s.own").alias("_rl_own"), "_rl_min", "_rl_max", "_rl_end")


def _finds(keys: Sequence[str], limit_s: float) -> list[Column]:
    """Join condition of a start (``_rl_at``, ``_rl_b``) and a window of ``_by_start`` that holds its phase."""
    limit = F.expr(f"INTERVAL {_micros(limit_s)} MICROSECOND")
    return [F.col(k).eqNullSafe(F.col(f"_rl_p_{k}")) for k in keys] + [
        F.col("_rl_b") == F.col("_rl_pb"),
        F.when(F.col("_rl_own"), F.col("_rl_max") >= F.col("_rl_at")).otherwise(F.col("_rl_min") <= F.col("_rl_at") + limit)]


def stream_missing_phase(starts: DataFrame, done: DataFrame, keys: Sequence[str], ts: str, limit_s: float, delay: str = "1 hour") -> DataFrame:
    """Rows of ``starts`` without a row of ``done`` of the same keys from their time up to ``limit_s`` later, once that is certain.

    Streaming form of ``runlens.operators.missing_phase`` (append mode). ``delay`` is how late an event of either stream may
    arrive. NULL keys match each other. Rows without a time are never reported. A start is reported when the watermark has
    passed it by twice the limit.
    """
    keys, width = list(keys), _width(limit_s)

    def timed(df, name):
        return df.withColumn(name, F.col(ts).cast("timestamp")).withWatermark(name, delay)
    left = timed(starts.where(F.col(ts).isNotNull()), "_rl_at").withColumn("_rl_b", _bucket(F.unix_micros("_rl_at"), limit_s))
    windows = timed(done.select(*keys, ts).where(F.col(ts).isNotNull()), "_rl_done") \
        .groupBy(*keys, F.window("_rl_done", f"{width} microseconds").alias("_rl_w")) \
        .agg(F.min("_rl_done").alias("_rl_min"), F.max("_rl_done").alias("_rl_max")) \
        .select(*keys, "_rl_min", "_rl_max", F.window_time("_rl_w").alias("_rl_end"))
    # The bounds on _rl_end only tell when state may go. A window outlasts the starts it may end by one width: what the
    # state holds at any watermark then decides every start in it.
    span = F.expr(f"INTERVAL {2 * width} MICROSECOND")
    held = F.expr(f"INTERVAL {3 * width} MICROSECOND")
    return left.join(_by_start(windows, keys, limit_s), how="left_outer", on=[
        *_finds(keys, limit_s), F.col("_rl_end") <= F.col("_rl_at") + span, F.col("_rl_at") <= F.col("_rl_end") + held]) \
        .where(F.col("_rl_min").isNull()).select(*starts.columns)


def stream_missing_table(spark: SparkSession, starts: DataFrame, done: DataFrame, keys: Sequence[str], ts: str, limit_s: float,
                         delay: str = "1 hour", timeout_s: float | None = None, partitions: int | None = None) -> DataFrame:
    """Run it to the end of the available input; starts whose limit the last watermark has not passed are not decided.

    Starts whose limit has passed while their windows have not are decided by the batch form of the same join over the state.
    """
    _use_rocksdb(spark)
    out = stream_missing_phase(starts, done, keys, ts, limit_s, delay)
    base = scratch_path(spark, "missing")
    mark = last_watermark(_append_to(spark, out, base, "missing", timeout_s, partitions))
    table = spark.read.schema(out.schema).parquet(f"{base}/out")
    if mark is None:
        return table
    return table.unionByName(waiting_starts(spark, f"{base}/checkpoint", table, list(keys), limit_s, mark))


def waiting_starts(spark: SparkSession, checkpoint: str, table: DataFrame, keys: list[str], limit_s: float, mark: str) -> DataFrame:
    """Rows, in the columns of ``table``, of the starts in the stream's state that the watermark ``mark`` decides."""
    def state(**options) -> DataFrame:
        return spark.read.format("statestore").options(**options).load(checkpoint)

    join, windows = 0, 1       # operators are numbered from the sink
    limit = F.expr(f"INTERVAL {_micros(limit_s)} MICROSECOND")
    starts = state(operatorId=join, joinSide="left").select("value.*").where(F.col("_rl_at") + limit < F.lit(mark).cast("timestamp"))
    passed = state(operatorId=join, joinSide="right").select("value.*")
    still = state(operatorId=windows)
    names = still.schema["value"].dataType.names
    still = still.select(*[F.col("key").getField(k).alias(k) for k in keys], F.col("value").getField(names[0]).alias("_rl_min"),
                         F.col("value").getField(names[1]).alias("_rl_max"), F.lit(None).cast("timestamp").alias("_rl_end"))
    seen = passed.unionByName(_by_start(still, keys, limit_s))
    return starts.join(seen, on=_finds(keys, limit_s), how="left_anti").select(*table.columns)

"""Performance traces.

A trace is an append-only CSV without header in one of two layouts:

* four fields ``phase,framework, nodes, seconds``
* three fields ``phase, nodes, seconds`` (framework only in the file name)

The run time and the framework live in the file name
``<framework>_performance_<yyyyMMdd-HHmmss>.csv``. Lines of any other shape
give no row. Everything is native expressions over ``read.text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from runlens.functions.columns import decimal_or_null, int_or_null, nonblank
from runlens.schemas import TRACE

# Trace file-name convention and its time format.
TRACE_NAME_RE = r"([A-Za-z0-9]+)_performance_(\d{8}-\d{6})\.csv"
TRACE_TIME_FORMAT = "yyyyMMdd-HHmmss"


def trace_file_name(framework: Column, run_ts: Column) -> Column:
    """``<framework>_performance_<yyyyMMdd-HHmmss>.csv`` for a run.

    The stamp is built from the timestamp's fields, so a zone-free run time
    is written as it is, whatever the session time zone.
    """
    stamp = F.format_string("%04d%02d%02d-%02d%02d%02d", F.year(run_ts), F.month(run_ts),
                            F.dayofmonth(run_ts), F.hour(run_ts), F.minute(run_ts),
                            F.second(run_ts))
    return F.concat(framework, F.lit("_performance_"), stamp, F.lit(".csv"))


def _stamp_ntz(stamp: Column) -> Column:
    """``yyyyMMdd-HHmmss`` as a zone-free timestamp; NULL when malformed.

    Built from its digits with ``try_make_timestamp_ntz``, so the result does
    not depend on the session time zone (no DST gap shifts).
    """
    ok = stamp.rlike(r"^\d{8}-\d{6}$")

    def part(pos: int, n: int) -> Column:
        return F.substring(stamp, pos, n).cast("int")
    return F.when(ok, F.try_make_timestamp_ntz(part(1, 4), part(5, 2), part(7, 2),
                                               part(10, 2), part(12, 2), part(14, 2)))


def parse_trace_lines(df: DataFrame, line: str = "line", file: str = "file", dropped: Observation | str | None = None) -> DataFrame:
    """Parse trace text lines into the ``TRACE`` schema.

    ``dropped`` counts, in the same pass, the lines read (``lines``) and those that give no row, by the first thing wrong
    with them: ``bad_shape`` (neither three nor four fields), ``no_phase``, ``bad_nodes``, ``bad_seconds``. A batch caller
    passes an ``Observation`` and reads it after its action; a stream takes a name and reports the counts of every
    micro-batch under it in ``observedMetrics``.

    ``file`` may be a bare name or a full path; the trace name is found
    anywhere in it, so partition folders named after the file work too.
    The line is split once in its own projection; the fields are then cheap
    array reads (no re-split per field, no re-evaluation in the filter).
    """
    split = df.select(F.split(F.col(line), ",").alias("_rl_p"),
                      F.regexp_extract(F.col(file), TRACE_NAME_RE, 0).alias("_rl_name"))
    p = F.col("_rl_p")
    four = F.size(p) == 4
    fields = split.select(
        F.size(p).isin(3, 4).alias("_rl_shape"),
        F.get(p, 0).alias("_rl_phase"),
        F.when(four, F.get(p, 1)).alias("_rl_fw"),
        F.when(four, F.get(p, 2)).otherwise(F.get(p, 1)).alias("_rl_nodes"),
        F.when(four, F.get(p, 3)).otherwise(F.get(p, 2)).alias("_rl_secs"),
        F.nullif(F.col("_rl_name"), F.lit("")).alias("_rl_file"),
    )
    name = F.col("_rl_file")
    fw_from_name = F.substring_index(name, "_performance_", 1)
    stamp = F.substring_index(F.substring_index(name, "_performance_", -1), ".csv", 1)
    typed = fields.select(F.col("_rl_shape"), F.struct(
        F.coalesce(nonblank(F.col("_rl_fw")), fw_from_name).alias("framework"),
        _stamp_ntz(stamp).alias("run_ts"),
        nonblank(F.col("_rl_phase")).alias("phase"),
        int_or_null(F.col("_rl_nodes")).alias("nodes"),
        decimal_or_null(F.col("_rl_secs"), 18, 5).alias("seconds"),
        name.alias("file"),
    ).alias("_rl_t"))
    # Invalid lines are dropped by exploding an empty array rather than by a
    # filter: a filter on parsed fields would be pushed below the projections
    # and re-evaluate every parsing expression inside the predicate.
    t = F.col("_rl_t")
    if dropped is not None:
        wrong = F.when(~F.coalesce("_rl_shape", F.lit(False)), "bad_shape").when(t["phase"].isNull(), "no_phase") \
            .when(t["nodes"].isNull(), "bad_nodes").when(t["seconds"].isNull(), "bad_seconds")
        typed = typed.observe(dropped, F.count(F.lit(1)).alias("lines"),
                              *[F.count_if(wrong == r).alias(r) for r in ("bad_shape", "no_phase", "bad_nodes", "bad_seconds")])
    ok = F.col("_rl_shape") & t["phase"].isNotNull() & t["nodes"].isNotNull() \
        & t["seconds"].isNotNull()
    out = typed.select(F.inline(F.when(ok, F.array(t)).otherwise(F.array().cast(
        "array<struct<framework:string,run_ts:timestamp_ntz,phase:string,nodes:int,"
        "seconds:decimal(18,5),file:string>>"))))
    return out.select([F.col(f.name).cast(f.dataType) for f in TRACE.fields])


def _lines(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def read_traces(spark: SparkSession, path: str, dropped: Observation | None = None) -> DataFrame:
    """Read every trace file below ``path`` (A1)."""
    return parse_trace_lines(_lines(spark.read.option("recursiveFileLookup", "true").text(path)), dropped=dropped)


def stream_traces(spark: SparkSession, path: str, max_files_per_trigger: int | None = None, dropped: str | None = None) -> DataFrame:
    """Follow the trace files that arrive below ``path`` (A1 as a stream).

    A file is read once, when it first appears. A trace that is flushed phase by phase is delivered as one closed segment per flush
    in a folder named after the trace (``<trace name>/<segment>``), because lines added to a file already read are not seen.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_trace_lines(_lines(reader.text(path)), dropped=dropped)


def append_traces(df: DataFrame, path: str) -> None:
    """Append parsed trace rows as Parquet partitioned by framework.

    Each call is one atomic job commit, so a lost executor re-runs tasks
    without duplicating rows; readers filtering on ``framework`` prune. The
    ``rebalance`` hint lets AQE size the files per framework (a hot framework
    is split across tasks, small ones are merged).
    """
    df.hint("rebalance", "framework").write.mode("append").partitionBy("framework").parquet(path)


def append_traces_stream(stream_df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Streaming form of A6: exactly-once file sink with a checkpoint.

    Started again with the same ``path`` and ``checkpoint`` it goes on after the last finished micro-batch. A micro-batch whose
    files were written but whose end was not recorded is run again; the sink's log knows it, so its rows are not added twice.
    """
    writer = (stream_df.writeStream.format("parquet").outputMode("append")
              .partitionBy("framework").option("checkpointLocation", checkpoint))
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start(path)

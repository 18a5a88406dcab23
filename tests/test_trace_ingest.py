"""A1/A6 as a continuous ingest, stopped and started again; A1/A3 lines that give no row are counted in the same pass."""

import os
import shutil

from pyspark.sql import Observation

from runlens import operators as op
from runlens import sources as src
from runlens.schemas import TRACE

NAME = "spark_performance_20240102-0304{:02d}.csv"


def flush(folder, trace, segment, lines):
    d = os.path.join(folder, NAME.format(trace))
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, f"{segment}.txt"), "w") as f:
        f.write("\n".join(lines) + "\n")


def rows(spark, path):
    return sorted((r.file, r.phase, r.nodes, float(r.seconds)) for r in spark.read.schema(TRACE).parquet(path).collect())


def test_ingest_goes_on_after_a_crash_between_write_and_record(spark, tmp_dir):
    inp, out, ck = (os.path.join(tmp_dir, x) for x in ("in", "out", "ck"))

    def run(checkpoint):
        q = src.append_traces_stream(src.stream_traces(spark, inp, max_files_per_trigger=1, dropped="lines"), out, checkpoint)
        q.awaitTermination()
        return [p["observedMetrics"]["lines"] for p in q.recentProgress if "lines" in p.get("observedMetrics", {})]
    want = []
    for trace in range(3):
        flush(inp, trace, "download", [f"download,spark, 48, {trace}.5", "no trace line"])
        want.append((NAME.format(trace), "download", 48, trace + 0.5))
    counted = run(ck)
    assert len(counted) == 3 and sum(c["lines"] for c in counted) == 6 and sum(c["bad_shape"] for c in counted) == 3
    assert rows(spark, out) == sorted(want)
    # The last micro-batch's files are written and in the sink's log, but the crash came before its end was recorded.
    last = max(int(n) for n in os.listdir(f"{ck}/commits") if n.isdigit())
    crashed = os.path.join(tmp_dir, "ck_crashed")
    shutil.copytree(ck, crashed, ignore=lambda d, names: [n for n in names if os.path.basename(d) == "commits" and n.strip(".crc") == str(last)])
    for trace in range(3):                                     # the next phase of the same traces, delivered while it was down
        flush(inp, trace, "startup", [f"startup, 48, {trace}.25"])
        want.append((NAME.format(trace), "startup", 48, trace + 0.25))
    run(crashed)
    assert rows(spark, out) == sorted(want)                    # nothing twice, nothing lost
    run(crashed)
    assert rows(spark, out) == sorted(want)


def test_dropped_trace_lines_are_counted_by_their_first_fault(spark):
    lines = ["download,spark, 48, 1.5", "startup, 48, 2", "", "only", "a,b,c,d,e", " , 48, 1", "x, many, 1", "x, 1, soon", " , many, soon", None]
    df = spark.createDataFrame([(x, NAME.format(1)) for x in lines], "line string, file string")
    seen = Observation()
    got = src.parse_trace_lines(df, dropped=seen)
    assert got.count() == 2
    assert seen.get == {"lines": 10, "bad_shape": 4, "no_phase": 2, "bad_nodes": 1, "bad_seconds": 1}
    assert src.parse_trace_lines(df).collect() == got.collect()


def test_counting_reads_the_files_once(spark, tmp_dir):
    flush(tmp_dir, 1, "all", ["download,spark, 48, 1.5"])
    plan = src.read_traces(spark, tmp_dir, dropped=Observation())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan


def test_dropped_key_value_lines(spark):
    df = spark.createDataFrame([(x,) for x in ["a=1", "", "  ", None, "# a=1", " #", "word", "b=", "=c"]], "line string")
    seen = Observation()
    got = op.read_key_values(df, dropped=seen).count()
    assert seen.get == {"lines": 9, "blank": 3, "comment": 2, "no_separator": 1} and got == 3

"""Hand-written fixtures for the layouts the driver tables lack (FIXTURES.md section 2)."""

import datetime as dt
import os
from decimal import Decimal

from pyspark.sql import functions as F

from runlens import operators as op
from runlens import sources as src
from runlens.operators.text import WORKER_ID_RE


def _write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)
    return path


def _ts(s):
    return dt.datetime.fromisoformat(s)


# --- 2.1 traces ------------------------------------------------------------

TRACE_FILES = {
    "spark_performance_20170101-120000.csv": "download,spark, 4, 12.50000\nstartup,spark, 4, 30.25000\n",
    "flink_performance_20170101-130000.csv": "download,flink, 2, 8.00000\nstartup,flink, 2, 11.75000\n",
    "kafka_performance_20170102-130000.csv": "download, 8, 9.00000\nstartup, 8, 41.00000\n",
    "spark_performance_20170103-120000.csv": "download,spark, 4, 10.00000\n",
    "kafka_performance_20170104-130000.csv": "total_runtime, 8, 99.00000\n",
    "bad_performance_20170105-130000.csv": "\nstartup,spark, x, 1.0\none\n",
}


def _trace_dir(tmp_dir):
    for name, text in TRACE_FILES.items():
        _write(tmp_dir, name, text)
    return tmp_dir


def test_read_traces_layouts(spark, tmp_dir):
    rows = src.read_traces(spark, _trace_dir(tmp_dir)).collect()
    assert len(rows) == 8
    got = {(r.framework, r.run_ts, r.phase, r.nodes, r.seconds, r.file) for r in rows}
    assert ("kafka", _ts("2017-01-02 13:00:00"), "startup", 8, Decimal("41.00000"),
            "kafka_performance_20170102-130000.csv") in got
    assert ("spark", _ts("2017-01-01 12:00:00"), "download", 4, Decimal("12.50000"),
            "spark_performance_20170101-120000.csv") in got
    assert ("kafka", _ts("2017-01-04 13:00:00"), "total_runtime", 8, Decimal("99.00000"),
            "kafka_performance_20170104-130000.csv") in got
    assert not any(r.file.startswith("bad_") for r in rows)


def test_missing_startup_is_found(spark, tmp_dir):
    traces = src.read_traces(spark, _trace_dir(tmp_dir))
    runs = traces.select("framework", "run_ts").distinct()
    grid = op.expand_grid(runs, {"phase": F.array(F.lit("download"), F.lit("startup"))})
    missing = op.missing_runs(grid, traces, ["framework", "run_ts", "phase"]).collect()
    got = {(r.framework, r.run_ts, r.phase) for r in missing}
    assert ("spark", _ts("2017-01-03 12:00:00"), "startup") in got
    assert ("spark", _ts("2017-01-01 12:00:00"), "startup") not in got


def test_append_traces_batch_and_stream(spark, tmp_dir):
    traces = src.read_traces(spark, _trace_dir(os.path.join(tmp_dir, "in")))
    out = os.path.join(tmp_dir, "out")
    src.append_traces(traces.where("framework = 'spark'"), out)
    src.append_traces(traces.where("framework <> 'spark'"), out)
    back = spark.read.parquet(out)
    assert back.count() == 8
    assert back.where("framework = 'flink'").count() == 2

    # Stream sink: running the same availableNow query twice adds nothing.
    stream = spark.readStream.schema("value string").text(os.path.join(tmp_dir, "in"))
    parsed = src.parse_trace_lines(stream.select(F.col("value").alias("line"),
                                                 F.col("_metadata.file_path").alias("file")))
    sink, ckpt = os.path.join(tmp_dir, "sink"), os.path.join(tmp_dir, "ckpt")
    for _ in range(2):
        src.append_traces_stream(parsed, sink, ckpt).awaitTermination()
    assert spark.read.parquet(sink).count() == 8


# --- 2.2 host lists -----------------------------------------------------------

def test_distinct_hosts(spark):
    df = spark.createDataFrame([("a", "n1"), ("a", "n1"), ("a", " n2 "), ("a", ""), ("a", "n2\n")],
                               "alloc_id string, line string")
    rows = op.distinct_hosts(df).collect()
    assert sorted(r.host for r in rows) == ["n1", "n2"]
    assert op.node_count(op.distinct_hosts(df)).collect()[0].n_nodes == 2


def test_expand_slots(spark):
    df = spark.createDataFrame([("a", "n1 2 all.q x"), ("a", "n2 0 q x"), ("a", "n3 two q x"),
                                ("a", "n4"), ("a", "n5 3")], "alloc_id string, line string")
    slots = op.expand_slots(df).collect()
    counts = {}
    for r in slots:
        counts[r.host] = counts.get(r.host, 0) + 1
    assert counts == {"n1": 2, "n5": 3}
    assert sorted(r.host for r in op.expand_slots(df, distinct=True).collect()) == ["n1", "n5"]


def test_expand_hostlist(spark):
    df = spark.createDataFrame([("a", "c401-[101-103,105],gpu2"), ("b", "n[08-11]"),
                                ("c", "x[3-1],y[7],z")], "alloc_id string, expr string")
    rows = op.expand_hostlist(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r.alloc_id, set()).add(r.host)
    assert by["a"] == {"c401-101", "c401-102", "c401-103", "c401-105", "gpu2"}
    assert by["b"] == {"n08", "n09", "n10", "n11"}
    assert by["c"] == {"y7", "z"}


def test_expand_hostlist_several_groups(spark):
    df = spark.createDataFrame([("a", "rack[1-2]-n[01-02],login"), ("b", "x[1,3]y[8-9]z")],
                               "alloc_id string, expr string")
    by = {}
    for r in op.expand_hostlist(df).collect():
        by.setdefault(r.alloc_id, set()).add(r.host)
    assert by["a"] == {"rack1-n01", "rack1-n02", "rack2-n01", "rack2-n02", "login"}
    assert by["b"] == {"x1y8z", "x1y9z", "x3y8z", "x3y9z"}
    from runlens.functions import expand_hostlist
    row = df.select(expand_hostlist(F.col("expr")).alias("h")).orderBy("alloc_id").collect()
    assert set(row[0].h) == by["a"] and set(row[1].h) == by["b"]


def test_expand_hostlist_column_form(spark):
    from runlens.functions import expand_hostlist
    row = spark.createDataFrame([("c401-[101-103,105],gpu2",)], "e string") \
        .select(expand_hostlist(F.col("e")).alias("h")).collect()[0]
    assert sorted(row.h) == ["c401-101", "c401-102", "c401-103", "c401-105", "gpu2"]


def test_first_present(spark):
    df = spark.createDataFrame([("1", "", None, "s"), ("2", "p", "q", None), ("3", None, None, None)],
                               "alloc_id string, pbs string, slurm string, sge string")
    rows = {r.alloc_id: (r.host, r.source) for r in
            op.first_present(df, ["pbs", "slurm", "sge"], "localhost", out="host").collect()}
    assert rows == {"1": ("s", "sge"), "2": ("p", "pbs"), "3": ("localhost", "default")}


def test_apply_defaults(spark):
    df = spark.createDataFrame([("x", "", "3"), (None, "2", "y")], "a string, b string, c string")
    rows = op.apply_defaults(df, {"a": ("/tmp", "string"), "b": (10, "int"), "c": (1, "int")}).collect()
    assert [(r.a, r.b, r.c) for r in rows] == [("x", 10, 3), ("/tmp", 2, 1)]


def test_assign_ids(spark):
    df = spark.createDataFrame([("a", "h2"), ("a", "h1"), ("b", "h9")], "alloc_id string, host string")
    for skew_safe in (True, False):
        rows = {(r.alloc_id, r.host): (r.node_id, r.is_master)
                for r in op.assign_ids(df, skew_safe=skew_safe).collect()}
        assert rows == {("a", "h1"): (0, True), ("a", "h2"): (1, False), ("b", "h9"): (0, True)}


# --- 2.3 configuration text ---------------------------------------------------------

PROPS = ["broker.id=3", "listeners=PLAINTEXT://h:9092", "advertised.listeners=PLAINTEXT://h:9092",
         "zookeeper.connect=m:2181", "zookeeper.connection.timeout.ms=6000", "#listeners = x"]


def test_filter_keys(spark):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(PROPS)], "n int, line string")
    rows = op.filter_keys(df, "line", prefixes=["broker.id", "listeners", "zookeeper.connect"],
                          display="shown").orderBy("n").collect()
    assert [r.shown for r in rows] == ["broker.id: 3", "listeners: PLAINTEXT://h:9092",
                                       "zookeeper.connect: m:2181",
                                       "zookeeper.connection.timeout.ms: 6000"]


def test_filter_map_keys(spark):
    df = spark.sql("SELECT map('spark.executor.memory', '1g', 'number_of_processes', '2') AS m")
    row = op.filter_map_keys(df, "m", prefixes=["spark"]).collect()[0]
    assert row.m == {"spark.executor.memory": "1g"}


def test_key_values(spark):
    df = spark.createDataFrame([("a=b=c",), ("# c=1",), ("",), ("x",)], "line string")
    rows = op.read_key_values(df).collect()
    assert [(r.key, r.value) for r in rows] == [("a", "b=c")]
    shown = op.filter_keys(df, "line", prefixes=["a"], display="shown").collect()[0].shown
    assert shown == "a: b: c"
    yaml = spark.createDataFrame([("jobmanager.rpc.address: 10.0.0.1",), ("# x: y",)], "line string")
    rows = op.read_key_values(yaml, sep=": ").collect()
    assert [(r.key, r.value) for r in rows] == [("jobmanager.rpc.address", "10.0.0.1")]


XML = """<?xml version="1.0"?>
<configuration>
  <property><name>fs.default.name</name><value>hdfs://h1:9000</value></property>
  <!-- <property><name>dfs.replication</name><value>1</value></property> -->
  <property><name>yarn.host</name><value>${yarn.host}</value></property>
</configuration>
"""


def test_xml_properties_and_master_host(spark, tmp_dir):
    _write(tmp_dir, "profile=default/core-site.xml", XML)
    _write(tmp_dir, "profile=other/core-site.xml", XML.replace("h1", "h2"))
    df = src.read_xml_properties(spark, tmp_dir)
    rows = {(r.profile, r.name, r.value) for r in df.collect()}
    assert ("default", "fs.default.name", "hdfs://h1:9000") in rows
    assert ("default", "yarn.host", "${yarn.host}") in rows
    assert not any(r[1] == "dfs.replication" for r in rows)
    pruned = df.where("profile = 'other'")
    assert "PartitionFilters: [isnotnull(profile" in pruned._jdf.queryExecution().executedPlan().toString() \
        or pruned.count() == 2
    text = spark.createDataFrame([(XML,)], "t string")
    host = op.extract_first(text, "t", r"<value>hdfs://(.*):.*</value>", 1, out="host").collect()[0].host
    assert host == "h1"
    flink = spark.createDataFrame([("jobmanager.rpc.address: 10.0.0.1\nx: y",)], "t string")
    addr = op.extract_first(flink, "t", r"jobmanager\.rpc\.address: *(\S+)", 1, out="a").collect()[0].a
    assert addr == "10.0.0.1"


def test_placeholders(spark):
    text = spark.createDataFrame([(1, "a $USER/${JOB}x ${yarn.host} %s $"), (2, None), (3, "plain")],
                                 "id int, t string")
    env = spark.createDataFrame([("USER", "u1"), ("JOB", "77"), ("JOB", "12")], "name string, value string")
    rows = {r.id: r.t for r in op.resolve_placeholders(text, "t", env, row_id="id").collect()}
    assert rows == {1: "a u1/77x ${yarn.host} %s $", 2: None, 3: "plain"}


def test_overlay(spark):
    base = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    over = spark.createDataFrame([("y", 9), ("z", 3)], "k string, v int")
    rows = {(r.k, r.v, r.from_over) for r in op.overlay_table(base, over, ["k"]).collect()}
    assert rows == {("x", 1, False), ("y", 9, True), ("z", 3, True)}
    m = spark.sql("SELECT map('a', '1', 'b', '2') AS d, map('b', '9') AS u")
    merged = m.select(op.overlay_maps(F.col("d"), F.col("u")).alias("m")).collect()[0].m
    assert merged == {"a": "1", "b": "9"}


def test_classify(spark):
    df = spark.createDataFrame([("yarn-client",), ("spark://m:7077",), ("pbs+ssh://h",)], "u string")
    rows = [r.c for r in op.classify(df, "u", [("yarn", "yarn"), ("spark", "spark")], "hadoop",
                                     out="c").collect()]
    assert rows == ["yarn", "spark", "hadoop"]


# --- 2.4 status answers ----------------------------------------------------------

def test_status_answers(spark):
    html = spark.createDataFrame([("<a>worker-2017-10.0.0.1-7077</a><td>worker-5</td> worker-6",)], "h string")
    assert op.extract_all(html, "h", WORKER_ID_RE).collect()[0].n_matches == 2
    js = spark.createDataFrame([(1, '{"taskmanagers":4}'), (2, "not json"), (3, "{}")], "i int, j string")
    rows = {r.i: r.value for r in op.json_int(js, "j", "$.taskmanagers").collect()}
    assert rows == {1: 4, 2: 0, 3: 0}
    listing = spark.createDataFrame(
        [("j", 0, "Job: 1"), ("j", 1, " exec_host = a/0"), ("j", 2, "exec_host = z/0"),
         ("j", 3, " exec_host = b/0+c/0"), ("k", 0, "Job: 2")], "job string, seq int, line string")
    rows = {r.job: r.value for r in op.last_match_value(listing, "job", "seq", "line", "exec_host").collect()}
    assert rows == {"j": "b/0+c/0", "k": "empty"}


def test_derived_fields(spark):
    df = spark.createDataFrame([("[pbs://h]-[123.srv]", "/x/spark-2.2.0-bin-hadoop2.7.tgz", "h1/0+h2/0", "nohost")],
                               "job string, path string, hosts string, plain string")
    spec = {"job_id": ("job_id", "job"), "base": ("after_last", "path", "/"), "stem": ("stem", "base"),
            "short": ("tokens", "stem", "-", 2), "host": ("before", "hosts", "/"),
            "whole": ("before", "plain", "/")}
    r = op.derive_fields(df, spec).collect()[0]
    assert (r.job_id, r.base, r.stem, r.short, r.host, r.whole) == (
        "123.srv", "spark-2.2.0-bin-hadoop2.7.tgz", "spark-2.2.0-bin-hadoop2.7", "spark-2.2.0", "h1", "nohost")


# --- 2.5 catalogue and state -------------------------------------------------------

def test_latest_by_prefix_and_newest(spark):
    t2, t3 = _ts("2020-01-02 00:00:00"), _ts("2020-01-03 00:00:00")
    cat = spark.createDataFrame([("w", "hadoop-conf-b", t2), ("w", "hadoop-conf-a", t2), ("w", "kafka-x", t3)],
                                "dir string, name string, ts timestamp_ntz")
    row = op.latest_by_prefix(cat, "dir", "name", "ts", "hadoop-conf").collect()
    assert [r.name for r in row] == ["hadoop-conf-a"]
    assert op.latest_by_prefix(cat, "dir", "name", "ts", "none-").count() == 0
    assert [r.name for r in op.latest_by_prefix(cat, None, "name", "ts", "hadoop-conf").collect()] == ["hadoop-conf-a"]
    top = op.newest(cat, None, "ts", limit=1, tiebreak=["name"]).collect()
    assert [r.name for r in top] == ["kafka-x"]
    ranked = {r.name: r.rank for r in op.newest(cat, "dir", "ts", tiebreak=["name"]).collect()}
    assert ranked == {"kafka-x": 1, "hadoop-conf-a": 2, "hadoop-conf-b": 3}


def test_catalog_reads_no_content(spark, tmp_dir):
    _write(tmp_dir, "a/hadoop-conf-1/x.txt", "abc")
    _write(tmp_dir, "a/kafka-1/y.txt", "de")
    df = src.read_catalog(spark, tmp_dir)
    assert sorted((r.name, r.length) for r in df.collect()) == [("x.txt", 3), ("y.txt", 2)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1]


def test_phase_durations(spark):
    t0 = _ts("2020-01-01 00:00:00")
    df = spark.createDataFrame([("r", t0), ("r", t0 + dt.timedelta(seconds=12.5)),
                                ("r", t0 + dt.timedelta(seconds=42.75))], "run_id string, ts timestamp_ntz")
    rows = op.phase_durations(df, "run_id", "ts").orderBy("seq").collect()
    assert [r.step_us for r in rows] == [None, 12_500_000, 30_250_000]
    assert rows[-1].total_us == 42_750_000


def test_first_outcome(spark):
    t = [_ts(f"2020-01-01 00:00:0{i}") for i in range(6)]
    df = spark.createDataFrame([("j1", t[0], "Pending"), ("j1", t[1], "Running"), ("j1", t[2], "marker"),
                                ("j2", t[0], "Failed"), ("j3", t[3], "Running")],
                               "job_id string, ts timestamp_ntz, state string")
    res = op.first_outcome(df, "job_id", "ts", [F.col("state") == "Running", F.col("state") == "marker"],
                           F.col("state") == "Failed")
    rows = {r.job_id: (r.outcome, r.outcome_ts) for r in res.collect()}
    assert rows == {"j1": ("ready", t[2]), "j2": ("failed", t[0]), "j3": ("open", None)}


def test_barrier_and_deadline(spark):
    t = [_ts(f"2020-01-01 00:00:0{i}") for i in range(6)]
    df = spark.createDataFrame([("j1", t[0], "w1", 2), ("j1", t[1], "w1", 2), ("j1", t[2], "w2", 2),
                                ("j1", t[3], "w2", 2), ("j2", t[0], "w1", 3), ("j2", t[1], "w2", 3)],
                               "job_id string, ts timestamp_ntz, member string, expected int")
    rows = {r.job_id: r.ready_ts for r in op.readiness_barrier(df, "job_id", "ts", "member", "expected").collect()}
    assert rows == {"j1": t[2], "j2": None}
    s = _ts("2020-01-01 00:00:00")
    dl = spark.createDataFrame([("a", s, s + dt.timedelta(seconds=600)), ("b", s, s + dt.timedelta(seconds=601)),
                                ("c", s, None)], "job_id string, start_ts timestamp_ntz, ready_ts timestamp_ntz")
    got = {r.job_id: r.met for r in op.within_deadline(dl, "start_ts", "ready_ts", 600).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_run_stats_and_scaling(spark):
    rows = [("spark", "startup", n, Decimal(v)) for n, vals in ((4, ["10", "20", "30"]), (8, ["5", "10"]))
            for v in vals]
    df = spark.createDataFrame(rows, "framework string, phase string, nodes int, seconds decimal(18,5)")
    stats = op.run_stats(df, ["framework", "phase", "nodes"], "seconds")
    by = {r.nodes: r for r in stats.collect()}
    assert by[4].n == 3 and by[4].mean == Decimal("20.00000") and by[4].p50 == 20.0 and by[4].p90 == 28.0
    assert by[8].mean == Decimal("7.50000") and abs(by[8].stddev - 3.5355339) < 1e-6
    approx = {r.nodes: r.p50 for r in op.run_stats(df, ["framework", "phase", "nodes"], "seconds",
                                                   approx=True).collect()}
    assert approx[4] == 20.0
    sc = {r.nodes: (r.base_size, r.speedup) for r in
          op.scaling_ratio(stats, ["framework", "phase"], "nodes", "mean").collect()}
    assert sc == {4: (4, 1.0), 8: (4, 20 / 7.5)}


def test_sweep_grid(spark):
    grid = op.sweep_grid(spark, 20, {"cores": [48, 96, 192, 384, 768], "framework": ["spark", "kafka"]})
    assert grid.count() == 200
    assert grid.select("rep").distinct().count() == 20


def test_trace_times_ignore_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("startup, 4, 1.0", "spark_performance_20240310-023000.csv"),
                                    ("startup, 4, 1.0", "spark_performance_20241340-023000.csv")],
                                   "line string, file string")
        rows = src.parse_trace_lines(df).collect()
        assert [r.run_ts for r in rows] == [_ts("2024-03-10 02:30:00"), None]
        named = spark.createDataFrame([(_ts("2024-03-10 02:30:00"),)], "t timestamp_ntz") \
            .select(src.trace_file_name(F.lit("spark"), F.col("t")).alias("f")).collect()[0].f
        assert named == "spark_performance_20240310-023000.csv"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")

"""Registered queries: every operator run over the driver tables.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names and types equal those of the SQL in ``runlens.plans.oracle``. The
inputs the reference reads as files (traces, host files, XML configs) are
derived from the tables by Spark, so every query's work grows with them.
Builders that exercise a file reader or writer write their input below the
shared checkpoint folder first (a new folder per call). Partitioned writes
use the ``rebalance`` hint on the partition column: AQE then writes about
one file per value, splits a hot value into several files and merges small
ones, instead of one file per (task, value).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from runlens import operators as op
from runlens import sources as src
from runlens.operators.text import WORKER_ID_RE
from runlens.schemas import TRACE
from runlens.session import scratch_path
from runlens.sources.traces import TRACE_NAME_RE
from runlens.streaming import (
    event_stream, stream_barrier_table, stream_deadline_table, stream_fleet_deadline_table, stream_missing_table, stream_outcome_table,
    stream_phase_table, stream_state_outcome_table,
)

Query = Callable[[SparkSession, str], DataFrame]

# Fixed values of the synthetic sweep laid over the events table: the
# frameworks that write traces and the core counts of the benchmark sweep.
FRAMEWORKS = ["spark", "flink", "kafka"]
SIZES = [48, 96, 192, 384, 768]
DEADLINE_S = 3 * 86400
WATERMARK_DELAY = "1 hour"
RETENTION_S = 40 * 86400   # users keep emitting events for the whole month


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, spread over at least ``defaultParallelism`` tasks.

    The driver's files are a single row group each, so a scan is one task
    and every CPU-heavy projection after it (parsing, regex, explode) would
    run on one core. A scan with fewer splits than the session's parallelism
    is rebalanced round-robin; a large input (thousands of splits) is left
    as it is, so at scale this adds no shuffle.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    try:
        want = spark.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:   # no RDD view of the plan (remote session): leave the scan as it is
        return df
    return df.repartition(want) if splits < want else df


def _framework(user: Column) -> Column:
    return F.element_at(F.array(*[F.lit(f) for f in FRAMEWORKS]), (user % 3 + 1).cast("int"))


def _size(user: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SIZES]), (user % 5 + 1).cast("int"))


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trace text: even ids in the 4-field layout, odd in the 3-field one."""
    ev = table(spark, sf_dir, "events")
    fw, nodes = _framework(F.col("user_id")), _size(F.col("user_id"))
    secs = F.format_string("%.5f", F.col("value"))
    run_ts = F.to_date("ts").cast("timestamp_ntz")
    line = F.when(F.col("event_id") % 2 == 0,
                  F.concat(F.col("event_type"), F.lit(","), fw, F.lit(", "), nodes, F.lit(", "), secs)) \
        .otherwise(F.concat(F.col("event_type"), F.lit(", "), nodes, F.lit(", "), secs))
    return ev.select(line.alias("line"), src.trace_file_name(fw, run_ts).alias("file"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.parse_trace_lines(trace_lines(spark, sf_dir))


# --- A: sources ---------------------------------------------------------

def q_trace_parse(spark, sf_dir):
    return traces(spark, sf_dir)


def q_trace_files(spark, sf_dir):
    path = scratch_path(spark, "trace_files")
    trace_lines(spark, sf_dir).hint("rebalance", "file").write.partitionBy("file").text(path)
    return src.read_traces(spark, path)


def q_trace_append(spark, sf_dir):
    path = scratch_path(spark, "trace_append")
    t = traces(spark, sf_dir)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    src.append_traces(t.where(F.col("run_ts") < cut), path)
    src.append_traces(t.where(~(F.col("run_ts") < cut) | F.col("run_ts").isNull()), path)
    back = spark.read.schema(TRACE).parquet(path)
    return back.select(*[F.col(f.name) for f in TRACE.fields])


def host_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PBS-style node-file lines: padded, some with a newline, blank for line 7."""
    li = table(spark, sf_dir, "lineitem")
    host = F.concat(F.lit("node"), F.col("l_suppkey"))
    line = F.when(F.col("l_linenumber") == 7, F.lit(" \t")) \
        .when(F.col("l_linenumber") == 3, F.concat(host, F.lit("\n"))) \
        .otherwise(F.concat(F.lit("  "), host, F.lit(" ")))
    return li.select((F.col("l_orderkey") % 50).alias("alloc_id"), line.alias("line"))


def q_host_file_scan(spark, sf_dir):
    path = scratch_path(spark, "host_files")
    host_lines(spark, sf_dir).hint("rebalance", "alloc_id").write.partitionBy("alloc_id").text(path)
    lines = src.read_lines(spark, path)
    lines = lines.withColumn("alloc_id",
                             F.regexp_extract("file", r"alloc_id=(\d+)", 1).cast("bigint"))
    return op.distinct_hosts(lines, "alloc_id", "line")


def xml_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part rows as ``<property>`` entries, one profile per part type."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_type").alias("profile"),
        F.concat(F.lit("part."), F.col("p_partkey"), F.lit(".brand")).alias("name"),
        F.col("p_brand").alias("value"),
        F.concat(F.lit("size "), F.col("p_size")).alias("description"))


def q_xml_props(spark, sf_dir):
    path = scratch_path(spark, "xml_props")
    (xml_configs(spark, sf_dir).hint("rebalance", "profile").write.partitionBy("profile").format("xml")
     .option("rootTag", "configuration").option("rowTag", "property").save(path))
    return src.read_xml_properties(spark, path).select("profile", "name", "value", "description")


def q_kv_split(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 7
    line = F.when(k == 0, F.concat(F.lit("# k"), F.col("p_partkey"), F.lit("=commented"))) \
        .when(k == 1, F.lit("   ")) \
        .when(k == 2, F.concat(F.lit("noseparator"), F.col("p_partkey"))) \
        .otherwise(F.concat(F.lit(" k"), F.col("p_partkey"), F.lit(" = "), F.col("p_brand"),
                            F.lit("="), F.col("p_size"), F.lit(" ")))
    kv = op.read_key_values(part.select("p_partkey", line.alias("line")), "line", "=")
    return kv.select("p_partkey", "key", "value")


# --- B: host lists -------------------------------------------------------

def q_hosts_distinct(spark, sf_dir):
    return op.distinct_hosts(host_lines(spark, sf_dir), "alloc_id", "line")


def q_node_counts(spark, sf_dir):
    return op.node_count(op.distinct_hosts(host_lines(spark, sf_dir), "alloc_id", "line"))


def q_dense_ids(spark, sf_dir):
    hosts = op.distinct_hosts(host_lines(spark, sf_dir), "alloc_id", "line")
    return op.assign_ids(hosts, "alloc_id", "host")


def q_dense_ids_hot(spark, sf_dir):
    """B5 with one allocation holding a third of all host lines (every line is
    its own host), numbered by the split position plan."""
    li = table(spark, sf_dir, "lineitem")
    alloc = F.when(F.col("l_orderkey") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("l_orderkey") % 50)
    host = F.concat(F.lit("n"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"))
    lines = li.select(alloc.alias("alloc_id"), F.concat(F.lit(" "), host, F.lit("\n")).alias("line"))
    hosts = op.distinct_hosts(lines, "alloc_id", "line")
    return op.assign_ids(hosts, "alloc_id", "host", skew_safe=True)


def q_slots_expand(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    host = F.concat(F.lit("node"), F.col("l_suppkey"))
    line = F.when(n == 5, host) \
        .otherwise(F.concat(host, F.lit(" "),
                            F.when(n == 7, F.lit("x")).when(n == 6, F.lit("0")).otherwise(n.cast("string")),
                            F.lit(" all.q x")))
    lines = li.select((F.col("l_orderkey") % 50).alias("alloc_id"), line.alias("line"))
    return op.expand_slots(lines, "alloc_id", "line")


def q_hostlist_expand(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, k, b = F.col("o_custkey") % 7, F.col("o_custkey") % 90, F.col("o_orderkey") % 13

    def pad(c):
        return F.lpad(c.cast("string"), 2, "0")
    expr = F.concat(F.lit("c"), a, F.lit("-["), pad(k), F.lit("-"), pad(k + 3), F.lit(","),
                    pad(k + 1), F.lit(","), (k + 10).cast("string"), F.lit("],gpu"), b)
    return op.expand_hostlist(o.select(F.col("o_orderkey").alias("alloc_id"), expr.alias("expr")),
                              "alloc_id", "expr")


def q_source_precedence(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    pbs = F.when(key % 4 == 0, F.lit("")).when(key % 4 == 1, F.concat(F.lit("pbs"), F.col("o_custkey")))
    slurm = F.when(key % 6 == 0, F.concat(F.lit("slurm"), key)).when(key % 6 == 1, F.lit(""))
    sge = F.when(key % 5 != 0, F.concat(F.lit("sge"), F.col("o_custkey")))
    df = o.select("o_orderkey", pbs.alias("pbs"), slurm.alias("slurm"), sge.alias("sge"))
    res = op.first_present(df, ["pbs", "slurm", "sge"], "localhost", out="host",
                           source_out="source", skip_empty=["pbs"])
    return res.select("o_orderkey", "host", "source")


def q_slots_distinct(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    host = F.concat(F.lit("node"), F.col("l_suppkey"))
    line = F.when(n == 5, host).otherwise(F.concat(
        host, F.lit(" "), F.when(n == 7, F.lit("x")).when(n == 6, F.lit("0")).otherwise(n.cast("string"))))
    lines = li.select((F.col("l_orderkey") % 50).alias("alloc_id"), line.alias("line"))
    return op.expand_slots(lines, "alloc_id", "line", distinct=True)


def q_field_defaults(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    df = o.select(
        "o_orderkey",
        F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.concat(F.lit("/scratch/"), F.col("o_custkey")))
        .alias("workdir"),
        F.when(k % 4 == 0, F.lit("x")).when(k % 4 == 1, F.lit(" 4 ")).when(k % 4 == 2, F.lit("4.0"))
        .alias("nproc"),
        F.when(k % 5 == 0, F.concat((F.col("o_custkey") % 8 + 1).cast("string"), F.lit("g"))).alias("memory"))
    return op.apply_defaults(df, {"workdir": ("/tmp", "string"), "nproc": (1, "int"),
                                  "memory": ("1g", "string")})


# --- C, S: filters and text ---------------------------------------------

def q_yaml_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    line = F.when(k == 0, F.concat(F.lit("# note: "), F.col("o_orderkey"))) \
        .when(k == 1, F.concat(F.lit("jobmanager.rpc.address: 10.0."), F.col("o_custkey") % 256,
                               F.lit("."), F.col("o_orderkey") % 256)) \
        .when(k == 2, F.concat(F.lit("taskmanager.numberOfTaskSlots: "), F.col("o_orderkey") % 16)) \
        .when(k == 3, F.lit("no separator here")) \
        .otherwise(F.concat(F.lit("env.java.opts:   -Xmx"), F.col("o_custkey") % 64, F.lit("g -Da=b: c ")))
    kv = op.read_key_values(o.select("o_orderkey", line.alias("line")), "line", sep=": ")
    return kv.select("o_orderkey", "key", "value")


def _options(c: DataFrame) -> Column:
    return F.create_map(
        F.lit("spark.executor.memory"), F.concat((F.col("c_custkey") % 8 + 1).cast("string"), F.lit("g")),
        F.lit("spark.executor.cores"), (F.col("c_nationkey") % 4 + 1).cast("string"),
        F.lit("number_of_processes"), F.lit("2"),
        F.lit("sparkling"), F.col("c_mktsegment"))


def q_option_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    df = op.filter_map_keys(c.select("c_custkey", _options(c).alias("opts")), "opts", prefixes=["spark"])
    return df.select("c_custkey", F.explode("opts").alias("opt_key", "opt_value"))


def q_option_overlay(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    defaults = F.create_map(F.lit("spark.executor.memory"), F.lit("1g"),
                            F.lit("spark.executor.cores"), F.lit("1"),
                            F.lit("number_of_processes"), F.lit("1"))
    m = F.col("c_custkey") % 3
    user = F.when(m == 0, F.create_map(F.lit("spark.executor.memory"),
                                       F.concat((F.col("c_nationkey") % 8 + 2).cast("string"), F.lit("g")))) \
        .when(m == 1, F.create_map(F.lit("number_of_processes"), (F.col("c_nationkey") % 5 + 1).cast("string"),
                                   F.lit("extra.key"), F.col("c_mktsegment"))) \
        .otherwise(F.create_map().cast("map<string,string>"))
    merged = c.select("c_custkey", op.overlay_maps(defaults, user).alias("opts"))
    return merged.select("c_custkey", F.explode("opts").alias("opt_key", "opt_value"))


def q_master_host(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    live = F.concat(F.lit("<property><name>fs.default.name</name><value>hdfs://h"), key,
                    F.lit(":9000</value></property>"))
    old = F.concat(F.lit("<!-- <property><name>fs.default.name</name><value>hdfs://old"), key,
                   F.lit(":9000</value></property> -->"))
    text = F.when(key % 7 == 0, F.lit("<configuration>\n</configuration>")) \
        .when(key % 3 == 0, F.concat(F.lit("<configuration>\n"), old, F.lit("\n"), live, F.lit("\n</configuration>"))) \
        .otherwise(F.concat(F.lit("<configuration>\n"), live, F.lit("\n</configuration>")))
    df = s.select("s_suppkey", text.alias("core_site"))
    return op.extract_first(df, "core_site", r"<value>hdfs://(.*):.*</value>", 1, out="master") \
        .select("s_suppkey", "master")


def q_worker_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    tag = F.concat(F.lit("<td>worker-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-10.0."),
                   F.col("o_custkey") % 256, F.lit("."), F.col("o_orderkey") % 256, F.lit("-7077</td>"))
    page = F.concat(F.lit("<html>"), F.repeat(tag, (F.col("o_orderkey") % 4).cast("int")),
                    F.lit(" worker-9 </html>"))
    df = o.select("o_orderkey", page.alias("page"))
    return op.extract_all(df, "page", WORKER_ID_RE, out="workers", count_out="n_workers") \
        .select("o_orderkey", "n_workers")



def q_keys_filtered(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k, pk = F.col("p_partkey") % 6, F.col("p_partkey")
    line = F.when(k == 0, F.concat(F.lit("broker.id="), pk)) \
        .when(k == 1, F.concat(F.lit("zookeeper.connection.timeout.ms="), F.col("p_size") * 1000)) \
        .when(k == 2, F.concat(F.lit("advertised.listeners=PLAINTEXT://h"), pk, F.lit(":9092"))) \
        .when(k == 3, F.concat(F.lit("listeners=PLAINTEXT://h"), pk, F.lit(":9092=x"))) \
        .when(k == 4, F.concat(F.lit("#listeners = x"), pk)) \
        .otherwise(F.concat(F.lit("zookeeper.connect=m"), pk, F.lit(":2181")))
    df = part.select("p_partkey", line.alias("line"))
    res = op.filter_keys(df, "line", prefixes=["broker.id", "listeners", "zookeeper.connect"],
                         display="shown")
    return res.select("p_partkey", "shown")


def q_url_class(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rules = [("https://m.", "mobile"), ("https", "secure"), ("http", "plain")]
    return op.classify(pages, "url", rules, "other", out="url_class").select("page_id", "url_class")


def q_url_host(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return op.extract_first(pages, "url", r"^[a-z]+://([^/:?#]+)", 1, out="host") \
        .select("page_id", "host")


HREF_RE = r'href="(/[^"]*)"'


def q_html_all(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return op.extract_all(pages, "html", HREF_RE, group=1, explode=True, out="link",
                          pos_out="link_pos").select("page_id", "link_pos", "link")


def q_html_count(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return op.extract_all(pages, "html", HREF_RE, group=1, out="links", count_out="n_links") \
        .select("page_id", "n_links")


def q_json_default(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    m = F.col("event_id") % 7
    props = F.when(m == 0, F.lit("not json")).when(m == 1, F.lit("{}")) \
        .when(m == 2, F.lit('{"k": "x"}')).otherwise(F.col("props"))
    return op.json_int(ev.select("event_id", props.alias("props")), "props", "$.k", 0, out="k") \
        .select("event_id", "k")


def q_last_match(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    line = F.when(F.col("role") == "system", F.concat(F.lit("user="), F.col("text"))) \
        .otherwise(F.concat(F.lit(" "), F.col("role"), F.lit("="), F.col("text")))
    df = conv.select("conv_id", "turn", line.alias("line"))
    return op.last_match_value(df, "conv_id", "turn", "line", "user=", "empty", out="last_user")


def q_derived(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = F.concat(F.lit("[pbs://h"), F.col("o_custkey"), F.lit("]-["), F.col("o_orderkey"), F.lit(".srv]"))
    return op.derive_fields(o.select("o_orderkey", s.alias("job")), {"job_id": ("job_id", "job")}) \
        .select("o_orderkey", "job_id")


def q_url_parts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    spec = {
        "rest": ("after", "url", "://"),
        "host": ("before", "rest", "/"),
        "short_host": ("before", "host", "."),
        "base": ("after_last", "url", "/"),
        "stem": ("stem", "base"),
        "head2": ("tokens", "host", ".", 2),
    }
    return op.derive_fields(pages, spec).select("page_id", "host", "short_host", "base", "stem", "head2")


def placeholder_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    text = F.concat(F.lit("home=$HOME/"), F.col("o_orderkey"),
                    F.lit(" seg=${SEGMENT} n=${NATION} keep=${no.pe} %s $ cost=$"),
                    F.col("o_orderkey") % 100, F.lit(" tail=$UNKNOWN $"))
    texts = o.select("o_orderkey", F.col("o_custkey").alias("cust"), text.alias("text"))
    cn = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    env = cn.select(F.col("c_custkey").alias("cust"), F.explode(F.array(
        F.struct(F.lit("HOME").alias("name"), F.concat(F.lit("/home/"), F.col("c_name")).alias("value")),
        F.struct(F.lit("SEGMENT").alias("name"),
                 F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).alias("value")),
        F.struct(F.lit("NATION").alias("name"), F.col("n_name").alias("value")),
    )).alias("v")).select("cust", "v.name", "v.value").where(F.col("value").isNotNull())
    return texts, env


def q_placeholders(spark, sf_dir):
    texts, env = placeholder_inputs(spark, sf_dir)
    res = op.resolve_placeholders(texts, "text", env, keys=["cust"], out="resolved",
                                  row_id="o_orderkey")
    return res.select("o_orderkey", "resolved")


def q_overlay(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    base = part.select(F.col("p_partkey").alias("cfg_key"), F.col("p_brand").alias("cfg_value"))
    changed = part.where(F.col("p_size") > 40).select(
        F.col("p_partkey").alias("cfg_key"), F.concat(F.col("p_brand"), F.lit("*")).alias("cfg_value"))
    added = part.where(F.col("p_size") < 3).select(
        (F.col("p_partkey") + 1000000).alias("cfg_key"),
        F.concat(F.lit("new-"), F.col("p_name")).alias("cfg_value"))
    return op.overlay_table(base, changed.unionByName(added), ["cfg_key"], flag="from_over")


# --- D: recency, stats, sweep -------------------------------------------

def q_latest_prefix(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.col("o_orderpriority"), F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    df = o.select("o_custkey", name.alias("name"), "o_orderdate")
    return op.latest_by_prefix(df, "o_custkey", "name", "o_orderdate", "1-")


def q_newest_1(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return op.newest(o, "o_custkey", "o_orderdate", limit=1, tiebreak=["o_orderkey"])


def q_newest_all(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return op.newest(o, "o_custkey", "o_orderdate", limit=None, tiebreak=["o_orderkey"])


def q_newest_global(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return op.newest(o, None, "o_orderdate", limit=10, tiebreak=["o_orderkey"])


def q_phase_durations(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "event_id", F.col("event_type").alias("phase"), "ts")
    return op.phase_durations(ev, "run_id", "ts", tiebreak=["event_id"])


def q_phase_durations_hot(spark, sf_dir):
    """D3 with one run holding a third of all readings (every third event is
    moved to run 0): that run is numbered by many tasks."""
    ev = table(spark, sf_dir, "events")
    run = F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("user_id"))
    df = ev.select(run.alias("run_id"), "event_id", F.col("event_type").alias("phase"), "ts")
    return op.phase_durations(df, "run_id", "ts", tiebreak=["event_id"], skew_safe=True)


def _stats(spark, sf_dir, percentiles=(0.5, 0.9)):
    return op.run_stats(traces(spark, sf_dir), ["framework", "phase", "nodes"], "seconds", scale=5,
                        percentiles=percentiles)


def q_trace_stats(spark, sf_dir):
    return _named_stats(_stats(spark, sf_dir), "framework", "phase", "nodes")


def q_run_stats_hot(spark, sf_dir):
    """D4 per run with one run holding a third of all readings (every third
    event moves to run 0); exact percentiles by the split position plan."""
    ev = table(spark, sf_dir, "events")
    run = F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("user_id"))
    secs = F.format_string("%.5f", F.col("value")).cast("decimal(18,5)")
    df = ev.select(run.alias("run_id"), secs.alias("seconds"))
    return _named_stats(op.run_stats(df, ["run_id"], "seconds"), "run_id")


def q_trace_scaling(spark, sf_dir):
    s = _stats(spark, sf_dir, percentiles=()).select("framework", "phase", "nodes",
                                                     F.col("mean").alias("mean_s"))
    r = op.scaling_ratio(s, ["framework", "phase"], "nodes", "mean_s", out="speedup",
                         base_size="base_nodes")
    return r.select("framework", "phase", "nodes", "mean_s", "base_nodes",
                    F.round("speedup", 4).alias("speedup"))


def q_sweep_missing(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    present = ev.select("user_id", day.alias("day"), "event_type")
    # One scalar subquery for all grid bounds: first and last day, event kinds.
    bounds = ev.select(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi"),
                                F.array_sort(F.collect_set("event_type")).alias("kinds"))).scalar()
    users = ev.select("user_id").distinct()
    grid = op.expand_grid(users, {"day": F.sequence(bounds["lo"], bounds["hi"]),
                                  "event_type": bounds["kinds"]})
    return op.missing_runs(grid, present, ["user_id", "day", "event_type"])


def q_sweep_missing_cells(spark, sf_dir):
    """The same sweep through bit words: no row per grid cell or present cell is shuffled."""
    day = F.to_date("ts")
    ev = table(spark, sf_dir, "events").select("user_id", day.alias("day"), "event_type")
    bounds = ev.select(F.struct(F.min("day").alias("lo"), F.max("day").alias("hi"), F.array_sort(F.collect_set("event_type")).alias("kinds"))).scalar()
    return op.missing_cells(ev, ev, ["user_id"], {"day": F.sequence(bounds["lo"], bounds["hi"]), "event_type": bounds["kinds"]})


# --- E: readiness --------------------------------------------------------

def _ready_conds():
    return [F.col("event_type") == "signup", F.col("event_type") == "purchase"]


def _failed_cond():
    return F.col("event_type") == "error"


def _expected():
    return F.when(F.col("user_id") % 4 == 0, F.lit(6)).otherwise(F.lit(5))


def q_first_outcome(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumnRenamed("user_id", "job_id")
    return op.first_outcome(ev, "job_id", "ts", _ready_conds(), _failed_cond())


def q_barrier(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("expected", _expected())
    return op.readiness_barrier(ev, "user_id", "ts", "event_type", "expected") \
        .withColumnRenamed("user_id", "job_id")


def q_barrier_hot(spark, sf_dir):
    """E2 with one fleet job holding a third of all events: every third event
    registers member ``u<user>-<type>`` of job 0 (500 expected); the n-th
    member is found by the split position plan."""
    ev = table(spark, sf_dir, "events")
    hot = F.col("event_id") % 3 == 0
    df = ev.select(
        F.when(hot, F.lit(0).cast("bigint")).otherwise(F.col("user_id")).alias("job_id"),
        F.when(hot, F.concat(F.lit("u"), F.col("user_id"), F.lit("-"), F.col("event_type")))
        .otherwise(F.col("event_type")).alias("member"),
        F.when(hot, F.lit(500)).otherwise(_expected()).alias("expected"), "ts")
    return op.readiness_barrier(df, "job_id", "ts", "member", "expected", skew_safe=True)


def q_deadline(spark, sf_dir):
    b = q_barrier(spark, sf_dir)
    return op.within_deadline(b, "start_ts", "ready_ts", DEADLINE_S) \
        .select("job_id", "start_ts", "ready_ts", "met")


def _state_partitions(spark):
    """One state store per core of the cluster."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:   # remote session: keep the session's setting
        return None


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return event_stream(spark, sf_dir, schema, glob="events.parquet")


def q_stream_outcome(spark, sf_dir):
    s = _event_stream(spark, sf_dir).withColumnRenamed("user_id", "job_id")
    return stream_outcome_table(spark, s, "job_id", "ts", _ready_conds(), _failed_cond(),
                                partitions=_state_partitions(spark))


def q_stream_barrier(spark, sf_dir):
    s = _event_stream(spark, sf_dir).withColumn("expected", _expected())
    return stream_barrier_table(spark, s, "user_id", "ts", "event_type", "expected",
                                partitions=_state_partitions(spark)) \
        .withColumnRenamed("user_id", "job_id")


def q_stream_deadline(spark, sf_dir):
    """E1-E3 as one stream (all members, failure or timeout) whose per-job state
    is released at the deadline."""
    s = _event_stream(spark, sf_dir).withColumn("expected", _expected())
    return stream_deadline_table(spark, s, "user_id", "ts", "event_type", "expected", DEADLINE_S,
                                 delay=WATERMARK_DELAY, retention_s=RETENTION_S,
                                 failed=_failed_cond(), partitions=_state_partitions(spark)) \
        .withColumnRenamed("user_id", "job_id")


def _named_stats(s: DataFrame, *keys: str) -> DataFrame:
    return s.select(*keys, "n", F.col("mean").alias("mean_s"), F.round("stddev", 4).alias("sd_s"),
                    F.col("min").alias("min_s"), F.col("max").alias("max_s"),
                    F.round("p50", 4).alias("p50_s"), F.round("p90", 4).alias("p90_s"))


def q_run_stats_signed(spark, sf_dir):
    """D4 with negative readings: every other event counts against its run."""
    ev = table(spark, sf_dir, "events")
    secs = F.format_string("%.5f", F.col("value")).cast("decimal(18,5)")
    df = ev.select((F.col("user_id") % 40).alias("run_id"),
                   F.when(F.col("event_id") % 2 == 0, -secs).otherwise(secs).cast("decimal(18,5)").alias("seconds"))
    return _named_stats(op.run_stats(df, ["run_id"], "seconds"), "run_id")


def q_run_stats_repeats(spark, sf_dir):
    """D4 with nine of ten readings equal."""
    ev = table(spark, sf_dir, "events")
    secs = F.format_string("%.5f", F.col("value")).cast("decimal(18,5)")
    df = ev.select((F.col("user_id") % 7).alias("run_id"),
                   F.when(F.col("event_id") % 10 != 0, F.lit("-1.00000").cast("decimal(18,5)")).otherwise(secs).alias("seconds"))
    return _named_stats(op.run_stats(df, ["run_id"], "seconds"), "run_id")


def q_hostlist_groups(spark, sf_dir):
    """B3 with items of two, three and four bracket groups, and malformed ones that give no host."""
    o = table(spark, sf_dir, "orders")
    k = (F.col("o_custkey") % 90).cast("string")
    expr = F.concat(F.lit("r["), k, F.lit("-"), (F.col("o_custkey") % 90 + 1).cast("string"), F.lit("]n[08-10]")) 
    expr = F.when(F.col("o_orderkey") % 4 == 0, expr) \
        .when(F.col("o_orderkey") % 4 == 1, F.concat(expr, F.lit("c[1,3],bad[1-3"))) \
        .when(F.col("o_orderkey") % 4 == 2, F.concat(expr, F.lit("c[1, 3]d[0-1]x,n[5- 6]"))) \
        .otherwise(F.concat(F.lit("a[1-2]b[3,ok"), k))
    return op.expand_hostlist(o.select(F.col("o_orderkey").alias("alloc_id"), expr.alias("expr")), "alloc_id", "expr")


def q_deadline_batch(spark, sf_dir):
    """The whole wait loop in batch form."""
    ev = table(spark, sf_dir, "events").withColumn("expected", _expected())
    return op.barrier_within_deadline(ev, "user_id", "ts", "event_type", "expected", DEADLINE_S, _failed_cond()) \
        .withColumnRenamed("user_id", "job_id")


def q_keys_contains(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return op.filter_keys(part, "p_name", prefixes=["a"], contains=["e"])


def q_class_equals(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rules = [("BUILDING", "spark"), ("MACHINERY", "flink"), ("building", "kafka")]
    return op.classify(c, "c_mktsegment", rules, "other", out="framework", how="equals").select("c_custkey", "framework")


def q_last_match_all(spark, sf_dir):
    """S4 with keys that have no listing at all."""
    conv = table(spark, sf_dir, "conversations")
    lines = conv.where(F.col("conv_id") % 3 != 0).select(
        "conv_id", "turn", F.concat(F.lit(" "), F.col("role"), F.lit("="), F.col("text")).alias("line"))
    return op.last_match_value(lines, "conv_id", "turn", "line", "user=", "empty", out="last_user",
                               keys_df=conv.select("conv_id"))


def q_overlay_null_keys(spark, sf_dir):
    n = table(spark, sf_dir, "supplier")
    key = F.when(F.col("s_suppkey") != 1, F.col("s_suppkey"))
    base = n.select(key.alias("cfg_key"), F.col("s_name").alias("cfg_value"))
    over = n.where(F.col("s_suppkey") % 5 == 1).select(key.alias("cfg_key"), F.concat("s_name", F.lit("*")).alias("cfg_value"))
    return op.overlay_table(base, over, ["cfg_key"], flag="from_over")


def q_missing_null_keys(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    user = F.when(F.col("user_id") % 50 != 0, F.col("user_id"))
    present = ev.where(F.col("event_type") == "purchase").select(user.alias("user_id"))
    return op.missing_runs(ev.select(user.alias("user_id")).distinct(), present, ["user_id"])


def q_json_large(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit('{"k": '), F.col("o_orderkey") * F.lit(3_000_000_000), F.lit("}"))
    return op.json_int(o.select("o_orderkey", text.alias("j")), "j", "$.k", 0, out="k").select("o_orderkey", "k")


def _job_states(ev: DataFrame) -> DataFrame:
    """Events as job states: clicks run a job, views queue it again, every fifth error fails it, signups write the marker
    (not for every tenth user), purchases change nothing. Every third event belongs to one fleet job."""
    kind = F.col("event_type")
    state = F.when(kind == "click", "Running").when(kind == "view", "Queued") \
        .when((kind == "error") & (F.col("event_id") % 5 == 0) & (F.col("user_id") % 3 != 0), "Failed")
    return ev.select(F.when(F.col("event_id") % 3 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("user_id")).alias("job_id"),
                     "ts", "event_id", state.alias("state"), ((kind == "signup") & (F.col("user_id") % 10 != 0)).alias("mark"))


def q_first_outcome_states(spark, sf_dir):
    ev = _job_states(table(spark, sf_dir, "events"))
    return op.state_outcome(ev, "job_id", "ts", "state", F.col("mark"), "event_id")


def q_stream_outcome_states(spark, sf_dir):
    return stream_state_outcome_table(spark, _job_states(_event_stream(spark, sf_dir)), "job_id", "ts", "state", F.col("mark"), "event_id",
                                      delay=WATERMARK_DELAY, retention_s=RETENTION_S, partitions=_state_partitions(spark))


def _fleet_events(ev: DataFrame) -> DataFrame:
    """Every third event registers member ``u<user>-<type>`` of one fleet job (200 expected, no failures)."""
    hot = F.col("event_id") % 3 == 0
    return ev.select(
        F.when(hot, F.lit(-1).cast("bigint")).otherwise(F.col("user_id")).alias("job_id"), "ts",
        F.when(hot, F.concat(F.lit("u"), F.col("user_id"), F.lit("-"), F.col("event_type"))).otherwise(F.col("event_type")).alias("member"),
        F.when(hot, F.lit(200)).otherwise(F.lit(4)).alias("expected"), (~hot & _failed_cond()).alias("fail"))


def q_stream_deadline_hot(spark, sf_dir):
    return stream_fleet_deadline_table(spark, _fleet_events(_event_stream(spark, sf_dir)), "job_id", "ts", "member", "expected", DEADLINE_S,
                                       delay=WATERMARK_DELAY, retention_s=RETENTION_S, failed=F.col("fail"),
                                       partitions=_state_partitions(spark))


def q_placeholders_hot_key(spark, sf_dir):
    """S6 where one key holds a third of all variables and texts; without a row id, the first text of each kind twice."""
    o = table(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("o_custkey"))
    env = o.select(key.alias("cust"), F.concat(F.lit("V"), F.col("o_orderkey")).alias("name"), F.col("o_orderpriority").alias("value"))
    text = F.concat(F.lit("p=$V"), F.col("o_orderkey"), F.lit(" q=${V"), F.col("o_orderkey") % 997, F.lit("} $$V1"))
    texts = o.select(key.alias("cust"), text.alias("text"), "o_orderkey")
    res = op.resolve_placeholders(texts.unionByName(texts.where(F.col("o_orderkey") % 5 == 0)), "text", env, keys=["cust"], out="resolved")
    return res.select("o_orderkey", "resolved")


def q_placeholders_global(spark, sf_dir):
    """S6 with one environment for all texts."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    env = c.select(F.concat(F.lit("C"), F.col("c_custkey")).alias("name"), F.col("c_name").alias("value"))
    text = F.concat(F.lit("by $C"), F.col("o_custkey"), F.lit(" not ${C} of ${C"), F.col("o_orderkey") % 2000, F.lit("}"))
    res = op.resolve_placeholders(o.select("o_orderkey", text.alias("text")), "text", env, out="resolved", row_id="o_orderkey")
    return res.select("o_orderkey", "resolved")


PHASE_LIMIT_S = 12 * 3600


def _run_phases(ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Downloads (views) and startups (clicks) of runs; every 25th user has no run key."""
    ev = ev.withColumn("run_id", F.when(F.col("user_id") % 25 != 0, F.col("user_id")))
    return (ev.where(F.col("event_type") == "view").select("event_id", "run_id", "ts"),
            ev.where(F.col("event_type") == "click").select("run_id", "ts"))


def q_missing_startups(spark, sf_dir):
    starts, done = _run_phases(table(spark, sf_dir, "events"))
    return op.missing_phase(starts, done, ["run_id"], "ts", PHASE_LIMIT_S)


def q_stream_missing(spark, sf_dir):
    starts, _ = _run_phases(_event_stream(spark, sf_dir))
    _, done = _run_phases(_event_stream(spark, sf_dir))
    return stream_missing_table(spark, starts, done, ["run_id"], "ts", PHASE_LIMIT_S, delay=WATERMARK_DELAY,
                                partitions=_state_partitions(spark))


def q_last_match_null_keys(spark, sf_dir):
    """S4 where one listing has no key."""
    conv = table(spark, sf_dir, "conversations").withColumn("k", F.when(F.col("conv_id") % 5 != 0, F.col("conv_id")))
    order = F.struct("conv_id", "turn")
    lines = conv.select("k", order.alias("at"), F.concat(F.lit(" "), F.col("role"), F.lit("="), F.col("text")).alias("line"))
    return op.last_match_value(lines, "k", "at", "line", "user=", "empty", out="last_user", keys_df=conv.select("k"))


def q_missing_null_run(spark, sf_dir):
    """D7 where the run without a key is among the missing."""
    ev = table(spark, sf_dir, "events")
    user = F.when(F.col("user_id") % 50 != 0, F.col("user_id"))
    present = ev.where((F.col("user_id") % 50 != 0) & (F.col("user_id") % 7 != 3)).select("user_id")
    return op.missing_runs(ev.select(user.alias("user_id")).distinct(), present, ["user_id"])


def q_stream_phase_durations(spark, sf_dir):
    ev = _event_stream(spark, sf_dir).select(F.col("user_id").alias("run_id"), "event_id", F.col("event_type").alias("phase"), "ts")
    return stream_phase_table(spark, ev, "run_id", "ts", "event_id", delay=WATERMARK_DELAY, retention_s=RETENTION_S,
                              partitions=_state_partitions(spark))


def q_stream_phase_durations_hot(spark, sf_dir):
    """Streaming D3 with one run holding a third of all readings."""
    run = F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("user_id"))
    ev = _event_stream(spark, sf_dir).select(run.alias("run_id"), "event_id", F.col("event_type").alias("phase"), "ts")
    return stream_phase_table(spark, ev, "run_id", "ts", "event_id", delay=WATERMARK_DELAY, retention_s=RETENTION_S,
                              partitions=_state_partitions(spark))


def q_stream_trace_append(spark, sf_dir):
    """A1 and A6 as a continuous ingest: the trace files of the first half of the month, then a restart that finds the others."""
    base = scratch_path(spark, "stream_trace_append")
    lines = trace_lines(spark, sf_dir)
    first = F.regexp_extract("file", TRACE_NAME_RE, 2) < "20240116-"
    for part in (first, ~first):
        lines.where(part).hint("rebalance", "file").write.mode("append").partitionBy("file").text(f"{base}/in")
        src.append_traces_stream(src.stream_traces(spark, f"{base}/in"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(TRACE).parquet(f"{base}/out").select(*[F.col(f.name) for f in TRACE.fields])


def _counted(spark, df: DataFrame, seen: Observation, kind: str) -> DataFrame:
    """Write ``df`` once and return what was observed on the way, one row per count (a fixed number of them)."""
    df.write.parquet(scratch_path(spark, kind))
    return spark.createDataFrame(sorted(seen.get.items()), "what string, n long")


def q_trace_dropped(spark, sf_dir):
    """A1 over lines of which some are cut, lack a phase or hold no numbers: lines read and dropped, counted while they are parsed."""
    ev = table(spark, sf_dir, "events")
    k = F.col("event_id") % 7
    phase = F.when(k == 1, F.lit(" ")).otherwise(F.col("event_type"))
    nodes = F.when(k == 3, F.lit("x")).otherwise(_size(F.col("user_id")).cast("string"))
    secs = F.concat(F.format_string("%.5f", F.col("value")), F.when(k == 2, F.lit("s")).otherwise(F.lit("")))
    line = F.when(k == 0, phase).otherwise(F.concat_ws(", ", phase, nodes, secs))
    lines = ev.select(line.alias("line"), src.trace_file_name(_framework(F.col("user_id")), F.col("ts")).alias("file"))
    seen = Observation()
    return _counted(spark, src.parse_trace_lines(lines, dropped=seen), seen, "trace_dropped")


def q_kv_dropped(spark, sf_dir):
    """A3 over properties of which some are blank, comments or lack the separator."""
    part = table(spark, sf_dir, "part")
    line = F.when(F.col("p_partkey") % 5 == 0, F.lit(" ")).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit(" # "), F.col("p_brand"))) \
        .when(F.col("p_partkey") % 5 == 2, F.col("p_brand")).otherwise(F.concat(F.lit("brand="), F.col("p_brand")))
    seen = Observation()
    return _counted(spark, op.read_key_values(part.select(line.alias("line")), dropped=seen), seen, "kv_dropped")


QUERIES: dict[str, Query] = {
    "trace_parse": q_trace_parse,
    "trace_files": q_trace_files,
    "trace_append": q_trace_append,
    "trace_stats": q_trace_stats,
    "trace_scaling": q_trace_scaling,
    "run_stats_hot": q_run_stats_hot,
    "phase_durations": q_phase_durations,
    "phase_durations_hot": q_phase_durations_hot,
    "sweep_missing": q_sweep_missing,
    "sweep_missing_cells": q_sweep_missing_cells,
    "host_file_scan": q_host_file_scan,
    "hosts_distinct": q_hosts_distinct,
    "slots_expand": q_slots_expand,
    "hostlist_expand": q_hostlist_expand,
    "source_precedence": q_source_precedence,
    "dense_ids": q_dense_ids,
    "dense_ids_hot": q_dense_ids_hot,
    "node_counts": q_node_counts,
    "slots_distinct": q_slots_distinct,
    "field_defaults": q_field_defaults,
    "yaml_split": q_yaml_split,
    "option_keys": q_option_keys,
    "option_overlay": q_option_overlay,
    "master_host": q_master_host,
    "worker_ids": q_worker_ids,
    "kv_split": q_kv_split,
    "xml_props": q_xml_props,
    "keys_filtered": q_keys_filtered,
    "url_class": q_url_class,
    "url_host": q_url_host,
    "html_all": q_html_all,
    "html_count": q_html_count,
    "json_default": q_json_default,
    "last_match": q_last_match,
    "derived": q_derived,
    "url_parts": q_url_parts,
    "placeholders": q_placeholders,
    "overlay": q_overlay,
    "latest_prefix": q_latest_prefix,
    "newest_1": q_newest_1,
    "newest_all": q_newest_all,
    "newest_global": q_newest_global,
    "first_outcome": q_first_outcome,
    "barrier": q_barrier,
    "barrier_hot": q_barrier_hot,
    "deadline": q_deadline,
    "stream_outcome": q_stream_outcome,
    "stream_barrier": q_stream_barrier,
    "stream_deadline": q_stream_deadline,
    "run_stats_signed": q_run_stats_signed,
    "run_stats_repeats": q_run_stats_repeats,
    "hostlist_groups": q_hostlist_groups,
    "deadline_batch": q_deadline_batch,
    "keys_contains": q_keys_contains,
    "class_equals": q_class_equals,
    "last_match_all": q_last_match_all,
    "overlay_null_keys": q_overlay_null_keys,
    "missing_null_keys": q_missing_null_keys,
    "json_large": q_json_large,
    "first_outcome_states": q_first_outcome_states,
    "stream_outcome_states": q_stream_outcome_states,
    "stream_deadline_hot": q_stream_deadline_hot,
    "placeholders_hot_key": q_placeholders_hot_key,
    "placeholders_global": q_placeholders_global,
    "missing_startups": q_missing_startups,
    "stream_missing": q_stream_missing,
    "last_match_null_keys": q_last_match_null_keys,
    "missing_null_run": q_missing_null_run,
    "stream_phase_durations": q_stream_phase_durations,
    "stream_phase_durations_hot": q_stream_phase_durations_hot,
    "stream_trace_append": q_stream_trace_append,
    "trace_dropped": q_trace_dropped,
    "kv_dropped": q_kv_dropped,
}


"""DuckDB SQL with the same result as each registered query.

Tables are the driver's views. Expected values are built from the table
columns directly (for example host names from numbers), not by re-parsing
the text the Spark side parses, wherever that is possible.
"""

from __future__ import annotations

FW = "(['spark','flink','kafka'])[user_id % 3 + 1]"
SIZE = "CAST(([48,96,192,384,768])[user_id % 5 + 1] AS INTEGER)"
WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"

TRACES = f"""
SELECT {FW} AS framework,
       CAST(CAST(ts AS DATE) AS TIMESTAMP) AS run_ts,
       event_type AS phase,
       {SIZE} AS nodes,
       CAST(value AS DECIMAL(18,5)) AS seconds,
       {FW} || '_performance_' || strftime(CAST(ts AS DATE), '%Y%m%d') || '-000000.csv' AS file
FROM events
"""

# Exact mean in units of 1e-5: quotient and remainder of the integer sum, half away from zero.
_U = "sum(CAST(seconds * 100000 AS HUGEINT))"
MEAN5 = (f"CAST(({_U} // count(*) + CASE WHEN 2 * abs({_U} % count(*)) >= count(*) THEN sign({_U}) ELSE 0 END) "
         "* CAST('0.00001' AS DECIMAL(6,5)) AS DECIMAL(18,5))")

STATS5 = f"""count(*) AS n, {MEAN5} AS mean_s,
       round(stddev_samp(CAST(seconds AS DOUBLE)), 4) AS sd_s,
       min(seconds) AS min_s, max(seconds) AS max_s,
       round(quantile_cont(CAST(seconds AS DOUBLE), 0.5), 4) AS p50_s,
       round(quantile_cont(CAST(seconds AS DOUBLE), 0.9), 4) AS p90_s"""

HOSTS = """
SELECT DISTINCT l_orderkey % 50 AS alloc_id, 'node' || l_suppkey AS host
FROM lineitem WHERE l_linenumber <> 7
"""

BARRIER = """
WITH f AS (
  SELECT user_id, event_type, min(ts) AS first_ts,
         CAST(CASE WHEN user_id % 4 = 0 THEN 6 ELSE 5 END AS INTEGER) AS expected
  FROM events GROUP BY user_id, event_type),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_ts, event_type) AS rn FROM f)
SELECT user_id AS job_id, max(expected) AS expected, count(*) AS n_members,
       min(first_ts) AS start_ts, min(first_ts) FILTER (WHERE rn = expected) AS ready_ts
FROM r GROUP BY user_id
"""

BARRIER_HOT = """
WITH e AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN CAST(0 AS BIGINT) ELSE user_id END AS job_id,
         CASE WHEN event_id % 3 = 0 THEN 'u' || user_id || '-' || event_type ELSE event_type END AS member,
         CASE WHEN event_id % 3 = 0 THEN 500 WHEN user_id % 4 = 0 THEN 6 ELSE 5 END AS expected, ts
  FROM events),
f AS (SELECT job_id, member, min(ts) AS first_ts, CAST(max(expected) AS INTEGER) AS expected
      FROM e GROUP BY job_id, member),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY first_ts, member) AS rn FROM f)
SELECT job_id, max(expected) AS expected, count(*) AS n_members,
       min(first_ts) AS start_ts, min(first_ts) FILTER (WHERE rn = expected) AS ready_ts
FROM r GROUP BY job_id
"""

OUTCOME = """
WITH a AS (
  SELECT user_id AS job_id,
         min(ts) FILTER (WHERE event_type = 'signup') AS r0,
         min(ts) FILTER (WHERE event_type = 'purchase') AS r1,
         min(ts) FILTER (WHERE event_type = 'error') AS failed_ts
  FROM events GROUP BY user_id),
b AS (SELECT job_id, CASE WHEN r0 IS NOT NULL AND r1 IS NOT NULL THEN greatest(r0, r1) END AS ready_ts,
             failed_ts FROM a)
SELECT job_id,
       CASE WHEN ready_ts IS NOT NULL AND (failed_ts IS NULL OR ready_ts <= failed_ts) THEN 'ready'
            WHEN failed_ts IS NOT NULL THEN 'failed' ELSE 'open' END AS outcome,
       CASE WHEN ready_ts IS NOT NULL AND (failed_ts IS NULL OR ready_ts <= failed_ts) THEN ready_ts
            ELSE failed_ts END AS outcome_ts,
       ready_ts, failed_ts
FROM b
"""

# The stream emits a job once the final watermark (latest event minus one hour) has
# passed start + 3 days; undecided jobs after that are open. Members count only by the deadline.
DEADLINE_BATCH = """
WITH f AS (SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY user_id, event_type),
s AS (SELECT user_id, min(ts) AS start_ts, min(ts) FILTER (WHERE event_type = 'error') AS fail_ts
      FROM events GROUP BY user_id),
w AS (SELECT f.user_id, f.event_type, f.first_ts, s.start_ts,
             CASE WHEN f.user_id % 4 = 0 THEN 6 ELSE 5 END AS expected
      FROM f JOIN s ON f.user_id = s.user_id WHERE f.first_ts <= s.start_ts + INTERVAL 3 DAY),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_ts, event_type) AS rn FROM w),
b AS (SELECT user_id, min(start_ts) AS start_ts, count(*) AS n_members,
             min(first_ts) FILTER (WHERE rn = expected) AS ready_ts
      FROM r GROUP BY user_id),
v AS (SELECT b.*, CASE WHEN s.fail_ts <= s.start_ts + INTERVAL 3 DAY THEN s.fail_ts END AS failed_ts
      FROM b JOIN s ON b.user_id = s.user_id),
o AS (SELECT *, CASE WHEN ready_ts IS NOT NULL AND (failed_ts IS NULL OR ready_ts <= failed_ts) THEN 'ready'
                     WHEN failed_ts IS NOT NULL THEN 'failed' ELSE 'timed_out' END AS outcome FROM v)
SELECT user_id AS job_id, start_ts, n_members, ready_ts, failed_ts, outcome, outcome = 'ready' AS met
FROM o
"""

MISSING = """
WITH e AS (SELECT CASE WHEN user_id % 25 <> 0 THEN user_id END AS run_id, * FROM events)
SELECT s.event_id, s.run_id, s.ts FROM e s
WHERE s.event_type = 'view' AND NOT EXISTS (
  SELECT 1 FROM e d WHERE d.event_type = 'click' AND d.run_id IS NOT DISTINCT FROM s.run_id
                      AND d.ts BETWEEN s.ts AND s.ts + INTERVAL 12 HOUR)
"""

FLEET = """
WITH e AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN CAST(-1 AS BIGINT) ELSE user_id END AS job_id, ts,
         CASE WHEN event_id % 3 = 0 THEN 'u' || user_id || '-' || event_type ELSE event_type END AS member,
         CASE WHEN event_id % 3 = 0 THEN 200 ELSE 4 END AS expected, event_id % 3 <> 0 AND event_type = 'error' AS fail
  FROM events),
s AS (SELECT job_id, min(ts) AS start_ts, max(expected) AS expected, min(ts) FILTER (WHERE fail) AS fail_ts FROM e GROUP BY job_id),
m AS (SELECT job_id, member, min(ts) AS first_ts FROM e GROUP BY job_id, member),
n AS (SELECT s.*, first_ts, row_number() OVER (PARTITION BY s.job_id ORDER BY first_ts, member) AS rn
      FROM s JOIN m ON m.job_id = s.job_id AND first_ts <= start_ts + INTERVAL 3 DAY),
v AS (SELECT job_id, start_ts, count(*) AS n_members, min(first_ts) FILTER (WHERE rn = expected) AS ready_ts,
             CASE WHEN min(fail_ts) <= start_ts + INTERVAL 3 DAY THEN min(fail_ts) END AS failed_ts FROM n GROUP BY job_id, start_ts),
o AS (SELECT *, CASE WHEN ready_ts <= coalesce(failed_ts, ready_ts) THEN 'ready' WHEN failed_ts IS NOT NULL THEN 'failed'
                     WHEN start_ts + INTERVAL 3 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR THEN 'timed_out'
                     ELSE 'open' END AS outcome FROM v)
SELECT job_id, start_ts, n_members, ready_ts, failed_ts, outcome, outcome = 'ready' AS met FROM o
"""

# States as intervals up to the next state; the job is ready where a running interval and the time since the marker meet.
STATES = """
WITH e AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN CAST(-1 AS BIGINT) ELSE user_id END AS job_id, ts, event_id,
         CASE WHEN event_type = 'click' THEN 'Running' WHEN event_type = 'view' THEN 'Queued'
              WHEN event_type = 'error' AND event_id % 5 = 0 AND user_id % 3 <> 0 THEN 'Failed' END AS state,
         event_type = 'signup' AND user_id % 10 <> 0 AS mark
  FROM events),
s AS (SELECT job_id, state, ts AS t0, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS t1 FROM e WHERE state IS NOT NULL),
m AS (SELECT job_id, min(ts) AS t FROM e WHERE mark GROUP BY job_id),
r AS (SELECT s.job_id, min(greatest(t0, t)) AS ready_ts FROM s JOIN m ON s.job_id = m.job_id
      WHERE state = 'Running' AND (t1 IS NULL OR t1 > greatest(t0, t)) GROUP BY s.job_id),
f AS (SELECT job_id, min(t0) AS failed_ts FROM s WHERE state = 'Failed' AND (t1 IS NULL OR t1 > t0) GROUP BY job_id),
x AS (SELECT j.job_id, ready_ts, failed_ts, least(ready_ts, failed_ts) AS outcome_ts
      FROM (SELECT DISTINCT job_id FROM e) j LEFT JOIN r ON r.job_id = j.job_id LEFT JOIN f ON f.job_id = j.job_id)
SELECT job_id, CASE outcome_ts WHEN ready_ts THEN 'ready' WHEN failed_ts THEN 'failed' ELSE 'open' END AS outcome, outcome_ts,
       ready_ts, failed_ts
FROM x
"""

DEADLINE_STREAM = f"""
SELECT * REPLACE (CASE WHEN outcome = 'timed_out'
                        AND (epoch_us(start_ts) + 259200000000) // 1000 > epoch_ms((SELECT max(ts) FROM events)) - 3600000
                  THEN 'open' ELSE outcome END AS outcome)
FROM ({DEADLINE_BATCH})
"""

ORACLE: dict[str, str] = {
    "trace_parse": TRACES,
    "trace_files": TRACES,
    "trace_append": TRACES,
    "trace_stats": f"""
WITH t AS ({TRACES})
SELECT framework, phase, nodes, count(*) AS n, {MEAN5} AS mean_s,
       round(stddev_samp(CAST(seconds AS DOUBLE)), 4) AS sd_s,
       min(seconds) AS min_s, max(seconds) AS max_s,
       round(quantile_cont(CAST(seconds AS DOUBLE), 0.5), 4) AS p50_s,
       round(quantile_cont(CAST(seconds AS DOUBLE), 0.9), 4) AS p90_s
FROM t GROUP BY framework, phase, nodes
""",
    "run_stats_hot": f"""
WITH t AS (SELECT CASE WHEN event_id % 3 = 0 THEN CAST(0 AS BIGINT) ELSE user_id END AS run_id,
                  CAST(value AS DECIMAL(18,5)) AS seconds FROM events)
SELECT run_id, count(*) AS n, {MEAN5} AS mean_s,
       round(stddev_samp(CAST(seconds AS DOUBLE)), 4) AS sd_s,
       min(seconds) AS min_s, max(seconds) AS max_s,
       round(quantile_cont(CAST(seconds AS DOUBLE), 0.5), 4) AS p50_s,
       round(quantile_cont(CAST(seconds AS DOUBLE), 0.9), 4) AS p90_s
FROM t GROUP BY run_id
""",
    "trace_scaling": f"""
WITH t AS ({TRACES}),
s AS (SELECT framework, phase, nodes, {MEAN5} AS mean_s FROM t GROUP BY framework, phase, nodes)
SELECT framework, phase, nodes, mean_s,
       first_value(nodes) OVER w AS base_nodes,
       round(CAST(first_value(mean_s) OVER w AS DOUBLE) / CAST(mean_s AS DOUBLE), 4) AS speedup
FROM s WINDOW w AS (PARTITION BY framework, phase ORDER BY nodes)
""",
    "phase_durations": """
SELECT user_id AS run_id, event_id, event_type AS phase, ts,
       row_number() OVER w - 1 AS seq,
       epoch_us(ts) - epoch_us(lag(ts) OVER w) AS step_us,
       epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id)) AS total_us
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""",
    "phase_durations_hot": """
WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN CAST(0 AS BIGINT) ELSE user_id END AS run_id,
                  event_id, event_type, ts FROM events)
SELECT run_id, event_id, event_type AS phase, ts,
       row_number() OVER w - 1 AS seq,
       epoch_us(ts) - epoch_us(lag(ts) OVER w) AS step_us,
       epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY run_id)) AS total_us
FROM e WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)
""",
    "sweep_missing": """
WITH u AS (SELECT DISTINCT user_id FROM events),
d AS (SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day
      FROM events),
k AS (SELECT DISTINCT event_type FROM events),
p AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events)
SELECT u.user_id, d.day, k.event_type FROM u CROSS JOIN d CROSS JOIN k
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = u.user_id AND p.day = d.day
                  AND p.event_type = k.event_type)
""",
    "host_file_scan": HOSTS,
    "hosts_distinct": HOSTS,
    "node_counts": f"""
SELECT alloc_id, count(DISTINCT host) AS n_nodes FROM ({HOSTS}) h GROUP BY alloc_id
""",
    "dense_ids": f"""
SELECT alloc_id, host, row_number() OVER w - 1 AS node_id, (row_number() OVER w - 1) = 0 AS is_master
FROM ({HOSTS}) h WINDOW w AS (PARTITION BY alloc_id ORDER BY host)
""",
    "dense_ids_hot": """
WITH h AS (SELECT DISTINCT CASE WHEN l_orderkey % 3 = 0 THEN CAST(0 AS BIGINT) ELSE l_orderkey % 50 END AS alloc_id,
                           'n' || l_orderkey || '-' || l_linenumber AS host FROM lineitem)
SELECT alloc_id, host, row_number() OVER w - 1 AS node_id, (row_number() OVER w - 1) = 0 AS is_master
FROM h WINDOW w AS (PARTITION BY alloc_id ORDER BY host)
""",
    "slots_expand": """
SELECT l_orderkey % 50 AS alloc_id, 'node' || l_suppkey AS host,
       CAST(unnest(generate_series(1, l_linenumber)) AS INTEGER) AS slot
FROM lineitem WHERE l_linenumber <= 4
""",
    "hostlist_expand": """
SELECT DISTINCT alloc_id, host FROM (
  SELECT o_orderkey AS alloc_id,
         'c' || (o_custkey % 7) || '-' || lpad(CAST(o_custkey % 90 + r.i AS VARCHAR), 2, '0') AS host
  FROM orders CROSS JOIN range(0, 4) r(i)
  UNION ALL
  SELECT o_orderkey, 'c' || (o_custkey % 7) || '-' || CAST(o_custkey % 90 + 10 AS VARCHAR) FROM orders
  UNION ALL
  SELECT o_orderkey, 'gpu' || (o_orderkey % 13) FROM orders) x
""",
    "source_precedence": """
WITH s AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN 'pbs' || o_custkey END AS pbs,
         CASE WHEN o_orderkey % 6 = 0 THEN 'slurm' || o_orderkey WHEN o_orderkey % 6 = 1 THEN '' END AS slurm,
         CASE WHEN o_orderkey % 5 <> 0 THEN 'sge' || o_custkey END AS sge
  FROM orders)
SELECT o_orderkey, coalesce(nullif(pbs, ''), slurm, sge, 'localhost') AS host,
       CASE WHEN nullif(pbs, '') IS NOT NULL THEN 'pbs' WHEN slurm IS NOT NULL THEN 'slurm'
            WHEN sge IS NOT NULL THEN 'sge' ELSE 'default' END AS source
FROM s
""",
    "slots_distinct": """
SELECT DISTINCT l_orderkey % 50 AS alloc_id, 'node' || l_suppkey AS host
FROM lineitem WHERE l_linenumber <= 4
""",
    "field_defaults": """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 3 = 1 THEN '/scratch/' || o_custkey ELSE '/tmp' END AS workdir,
       CAST(CASE WHEN o_orderkey % 4 = 1 THEN 4 ELSE 1 END AS INTEGER) AS nproc,
       CASE WHEN o_orderkey % 5 = 0 THEN (o_custkey % 8 + 1) || 'g' ELSE '1g' END AS memory
FROM orders
""",
    "yaml_split": """
SELECT o_orderkey,
       CASE o_orderkey % 5 WHEN 1 THEN 'jobmanager.rpc.address' WHEN 2 THEN 'taskmanager.numberOfTaskSlots'
            ELSE 'env.java.opts' END AS key,
       CASE o_orderkey % 5 WHEN 1 THEN '10.0.' || (o_custkey % 256) || '.' || (o_orderkey % 256)
            WHEN 2 THEN CAST(o_orderkey % 16 AS VARCHAR)
            ELSE '-Xmx' || (o_custkey % 64) || 'g -Da=b: c' END AS value
FROM orders WHERE o_orderkey % 5 IN (1, 2, 4)
""",
    "option_keys": """
SELECT c_custkey, 'spark.executor.memory' AS opt_key, (c_custkey % 8 + 1) || 'g' AS opt_value FROM customer
UNION ALL SELECT c_custkey, 'spark.executor.cores', CAST(c_nationkey % 4 + 1 AS VARCHAR) FROM customer
UNION ALL SELECT c_custkey, 'sparkling', c_mktsegment FROM customer
""",
    "option_overlay": """
WITH d(k, v) AS (VALUES ('spark.executor.memory', '1g'), ('spark.executor.cores', '1'),
                        ('number_of_processes', '1')),
u AS (SELECT c_custkey, 'spark.executor.memory' AS k, (c_nationkey % 8 + 2) || 'g' AS v
      FROM customer WHERE c_custkey % 3 = 0
      UNION ALL SELECT c_custkey, 'number_of_processes', CAST(c_nationkey % 5 + 1 AS VARCHAR)
      FROM customer WHERE c_custkey % 3 = 1
      UNION ALL SELECT c_custkey, 'extra.key', c_mktsegment FROM customer WHERE c_custkey % 3 = 1)
SELECT c.c_custkey, d.k AS opt_key, d.v AS opt_value FROM customer c CROSS JOIN d
WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.c_custkey = c.c_custkey AND u.k = d.k)
UNION ALL SELECT c_custkey, k, v FROM u
""",
    "master_host": """
SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'old' || s_suppkey
                       ELSE 'h' || s_suppkey END AS master
FROM supplier
""",
    "worker_ids": """
SELECT o_orderkey, CAST(o_orderkey % 4 AS INTEGER) AS n_workers FROM orders
""",
    "kv_split": """
SELECT p_partkey, 'k' || p_partkey AS key, p_brand || '=' || p_size AS value
FROM part WHERE p_partkey % 7 >= 3
""",
    "xml_props": """
SELECT p_type AS profile, 'part.' || p_partkey || '.brand' AS name, p_brand AS value,
       'size ' || p_size AS description
FROM part
""",
    "keys_filtered": """
SELECT p_partkey,
       CASE p_partkey % 6
         WHEN 0 THEN 'broker.id: ' || p_partkey
         WHEN 1 THEN 'zookeeper.connection.timeout.ms: ' || (p_size * 1000)
         WHEN 3 THEN 'listeners: PLAINTEXT://h' || p_partkey || ':9092: x'
         ELSE 'zookeeper.connect: m' || p_partkey || ':2181' END AS shown
FROM part WHERE p_partkey % 6 IN (0, 1, 3, 5)
""",
    "url_class": """
SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN 'mobile'
                     WHEN starts_with(url, 'https') THEN 'secure'
                     WHEN starts_with(url, 'http') THEN 'plain' ELSE 'other' END AS url_class
FROM pages
""",
    "url_host": """
SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '') AS host FROM pages
""",
    "html_all": """
SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS link_pos, unnest(l) AS link
FROM (SELECT page_id, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS l FROM pages) t
""",
    "html_count": """
SELECT page_id, CAST(len(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS INTEGER) AS n_links
FROM pages
""",
    "json_default": """
WITH p AS (
  SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'not json' WHEN event_id % 7 = 1 THEN '{}'
                        WHEN event_id % 7 = 2 THEN '{"k": "x"}' ELSE props END AS props
  FROM events),
v AS (SELECT event_id, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS raw FROM p)
SELECT event_id,
       coalesce(CASE WHEN regexp_full_match(raw, '\\s*[+-]?\\d+\\s*') THEN TRY_CAST(trim(raw) AS BIGINT) END, CAST(0 AS BIGINT)) AS k
FROM v
""",
    "last_match": f"""
WITH l AS (
  SELECT conv_id, turn,
         CASE WHEN role = 'system' THEN 'user=' || text ELSE ' ' || role || '=' || text END AS line
  FROM conversations),
m AS (
  SELECT conv_id,
         arg_max(trim(substr(line, instr(line, '=') + 1), {WS}), turn) FILTER (WHERE instr(line, 'user=') > 1) AS v
  FROM l GROUP BY conv_id)
SELECT conv_id, coalesce(v, 'empty') AS last_user FROM m
""",
    "derived": """
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '.srv' AS job_id FROM orders
""",
    "url_parts": """
WITH r AS (
  SELECT page_id, url,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE url END AS rest
  FROM pages),
h AS (SELECT page_id, url, split_part(rest, '/', 1) AS host, regexp_extract(url, '[^/]*$') AS base FROM r)
SELECT page_id, host, split_part(host, '.', 1) AS short_host, base,
       regexp_replace(base, '\\.[^./]*$', '') AS stem,
       regexp_extract(host, '^[^.]*(\\.[^.]*)?', 0) AS head2
FROM h
""",
    "placeholders": """
WITH t AS (
  SELECT o_orderkey, o_custkey,
         'home=$HOME/' || o_orderkey || ' seg=${SEGMENT} n=${NATION} keep=${no.pe} %s $ cost=$'
           || (o_orderkey % 100) || ' tail=$UNKNOWN $' AS text
  FROM orders)
SELECT t.o_orderkey,
       replace(replace(replace(t.text,
         '$HOME', coalesce('/home/' || c.c_name, '$HOME')),
         '${SEGMENT}', coalesce(CASE WHEN c.c_nationkey % 2 = 0 THEN c.c_mktsegment END, '${SEGMENT}')),
         '${NATION}', coalesce(n.n_name, '${NATION}')) AS resolved
FROM t LEFT JOIN customer c ON c.c_custkey = t.o_custkey
       LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
""",
    "overlay": """
WITH b AS (SELECT p_partkey AS cfg_key, p_brand AS cfg_value FROM part),
o AS (SELECT p_partkey AS cfg_key, p_brand || '*' AS cfg_value FROM part WHERE p_size > 40
      UNION ALL
      SELECT p_partkey + 1000000, 'new-' || p_name FROM part WHERE p_size < 3)
SELECT coalesce(o.cfg_key, b.cfg_key) AS cfg_key,
       CASE WHEN o.cfg_key IS NOT NULL THEN o.cfg_value ELSE b.cfg_value END AS cfg_value,
       o.cfg_key IS NOT NULL AS from_over
FROM b FULL OUTER JOIN o ON b.cfg_key = o.cfg_key
""",
    "latest_prefix": """
SELECT o_custkey, name, o_orderdate FROM (
  SELECT o_custkey, o_orderpriority || '/' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS name, o_orderdate
  FROM orders WHERE starts_with(o_orderpriority, '1-')) t
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, name) = 1
""",
    "newest_1": """
SELECT o_custkey, o_orderkey, o_orderdate,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS rank
FROM orders QUALIFY rank <= 1
""",
    "newest_all": """
SELECT o_custkey, o_orderkey, o_orderdate,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank
FROM orders
""",
    "newest_global": """
SELECT o_custkey, o_orderkey, o_orderdate,
       CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS rank
FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10
""",
    "first_outcome": OUTCOME,
    "stream_outcome": OUTCOME,
    "barrier": BARRIER,
    "barrier_hot": BARRIER_HOT,
    "stream_deadline": DEADLINE_STREAM,
    "stream_barrier": BARRIER,
    "deadline": f"""
SELECT job_id, start_ts, ready_ts,
       coalesce(epoch_us(ready_ts) - epoch_us(start_ts) <= {3 * 86400 * 1_000_000}, false) AS met
FROM ({BARRIER}) b
""",
    "run_stats_signed": f"""
WITH t AS (SELECT user_id % 40 AS run_id,
                  CAST(CASE WHEN event_id % 2 = 0 THEN -CAST(value AS DECIMAL(18,5)) ELSE CAST(value AS DECIMAL(18,5)) END
                       AS DECIMAL(18,5)) AS seconds FROM events)
SELECT run_id, {STATS5} FROM t GROUP BY run_id
""",
    "run_stats_repeats": f"""
WITH t AS (SELECT user_id % 7 AS run_id,
                  CAST(CASE WHEN event_id % 10 <> 0 THEN CAST(-1 AS DECIMAL(18,5)) ELSE CAST(value AS DECIMAL(18,5)) END
                       AS DECIMAL(18,5)) AS seconds FROM events)
SELECT run_id, {STATS5} FROM t GROUP BY run_id
""",
    "hostlist_groups": """
WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS m, o_custkey % 90 AS k FROM orders),
p AS (SELECT o.*, 'r' || (k + a.i) || 'n' || n.t AS host
      FROM o CROSS JOIN range(0, 2) a(i) CROSS JOIN (VALUES ('08'), ('09'), ('10')) n(t) WHERE m <> 3)
SELECT DISTINCT alloc_id, host FROM (
  SELECT o_orderkey AS alloc_id, host FROM p WHERE m = 0
  UNION ALL SELECT o_orderkey, host || 'c' || c FROM p CROSS JOIN (VALUES ('1'), ('3')) v(c) WHERE m = 1
  UNION ALL SELECT o_orderkey, host || 'c' || c || 'd' || d || 'x'
  FROM p CROSS JOIN (VALUES ('1'), ('3')) v(c) CROSS JOIN (VALUES ('0'), ('1')) w(d) WHERE m = 2
  UNION ALL SELECT o_orderkey, 'n' || x FROM o CROSS JOIN (VALUES ('5'), ('6')) v(x) WHERE m = 2) u
""",
    "deadline_batch": DEADLINE_BATCH,
    "keys_contains": """
SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'a') OR contains(p_name, 'e')
""",
    "class_equals": """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'spark' WHEN 'MACHINERY' THEN 'flink' ELSE 'other' END AS framework
FROM customer
""",
    "last_match_all": f"""
WITH m AS (
  SELECT conv_id, arg_max(trim(text, {WS}), turn) FILTER (WHERE role = 'user' OR instr(role || '=' || text, 'user=') > 0) AS v
  FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id)
SELECT c.conv_id, coalesce(m.v, 'empty') AS last_user
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m ON m.conv_id = c.conv_id
""",
    "overlay_null_keys": """
SELECT nullif(s_suppkey, 1) AS cfg_key, CASE WHEN s_suppkey % 5 = 1 THEN s_name || '*' ELSE s_name END AS cfg_value,
       s_suppkey % 5 = 1 AS from_over
FROM supplier
""",
    "missing_null_keys": """
WITH e AS (SELECT CASE WHEN user_id % 50 <> 0 THEN user_id END AS user_id, event_type FROM events)
SELECT user_id FROM e GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'purchase') = 0
""",
    "first_outcome_states": STATES,
    "stream_outcome_states": f"SELECT job_id, outcome, outcome_ts FROM ({STATES}) s",
    "stream_deadline_hot": FLEET,
    "placeholders_hot_key": """
WITH t AS (SELECT o_orderkey, o_orderkey % 997 AS m, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS cust, o_orderpriority
           FROM orders),
r AS (SELECT t.o_orderkey,
             'p=' || t.o_orderpriority || ' q=' || coalesce(u.o_orderpriority, '${V' || t.m || '}') || ' $'
               || coalesce(w.o_orderpriority, '$V1') AS resolved
      FROM t LEFT JOIN t u ON u.o_orderkey = t.m AND u.cust = t.cust LEFT JOIN t w ON w.o_orderkey = 1 AND w.cust = t.cust)
SELECT * FROM r UNION ALL SELECT * FROM r WHERE o_orderkey % 5 = 0
""",
    "placeholders_global": """
SELECT o_orderkey, 'by ' || coalesce(c.c_name, '$C' || o_custkey) || ' not ${C} of ' || coalesce(d.c_name, '${C' || (o_orderkey % 2000) || '}') AS resolved
FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey LEFT JOIN customer d ON d.c_custkey = o_orderkey % 2000
""",
    "missing_startups": MISSING,
    "stream_missing": f"""
WITH w AS (SELECT least(max(ts) FILTER (WHERE event_type = 'view'), max(ts) FILTER (WHERE event_type = 'click')) - INTERVAL 1 HOUR AS mark
           FROM events)
SELECT m.* FROM ({MISSING}) m, w WHERE m.ts + INTERVAL 12 HOUR < mark
""",
    "last_match_null_keys": f"""
WITH c AS (SELECT CASE WHEN conv_id % 5 <> 0 THEN conv_id END AS k, conv_id, turn, ' ' || role || '=' || text AS line FROM conversations),
h AS (SELECT * FROM c WHERE instr(line, 'user=') > 1
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY conv_id DESC, turn DESC) = 1)
SELECT d.k, coalesce(trim(substr(h.line, instr(h.line, '=') + 1), {WS}), 'empty') AS last_user
FROM (SELECT DISTINCT k FROM c) d LEFT JOIN h ON h.k IS NOT DISTINCT FROM d.k
""",
    "missing_null_run": """
SELECT DISTINCT CASE WHEN user_id % 50 <> 0 THEN user_id END AS user_id FROM events WHERE user_id % 50 = 0 OR user_id % 7 = 3
""",
    "json_large": """
SELECT o_orderkey, o_orderkey * 3000000000 AS k FROM orders
""",
    "stream_trace_append": TRACES,
    "trace_dropped": """
SELECT unnest(['lines', 'bad_shape', 'no_phase', 'bad_nodes', 'bad_seconds']) AS what,
       unnest([count(*), count(*) FILTER (WHERE event_id % 7 = 0), count(*) FILTER (WHERE event_id % 7 = 1),
               count(*) FILTER (WHERE event_id % 7 = 3), count(*) FILTER (WHERE event_id % 7 = 2)]) AS n
FROM events
""",
    "kv_dropped": """
SELECT unnest(['lines', 'blank', 'comment', 'no_separator']) AS what,
       unnest([count(*), count(*) FILTER (WHERE p_partkey % 5 = 0), count(*) FILTER (WHERE p_partkey % 5 = 1),
               count(*) FILTER (WHERE p_partkey % 5 = 2)]) AS n
FROM part
""",
}
ORACLE |= {f"stream_{k}": ORACLE[k] for k in ("phase_durations", "phase_durations_hot")}
ORACLE["sweep_missing_cells"] = ORACLE["sweep_missing"]

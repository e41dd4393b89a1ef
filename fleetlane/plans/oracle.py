"""DuckDB SQL twins of the registered queries (same column names/types).

The stand-in views of :mod:`fleetlane.plans.standins` are spelled here as
CTEs so that each string runs on the bare driver tables.
"""

from __future__ import annotations

from fleetlane.functions.ids import UUID_RE
from fleetlane.functions.stats import CONTAINER_RE, FLEET_NAME_RE, MEM_UNITS
from fleetlane.operators.tasks import JOB_CMD, SERVICE_JOB_CMD, TIMEOUT_MESSAGE
from fleetlane.plans import standins as si
from fleetlane.sources.requests import INVALID_ERROR, PIPELINE_ERROR

# Whitespace class of the word-count tokenizer (space, tab, LF, CR, FF).
_TOK = r"'[ \t\n\r\f]+'"

_WORDS = f"""
  SELECT w AS word FROM (
    SELECT unnest(regexp_split_to_array(text, {_TOK})) AS w FROM documents)
  WHERE w <> ''"""

ORACLE: dict[str, str] = {}

# Whitespace set of a whole-text strip, and the token separator of a
# command line, spelled for DuckDB.
_WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"
_WSRUN = r"'[ \t\n\r\f\x0b]+'"
_UUID_RE = "'" + UUID_RE + "'"


def _q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"

ORACLE["wordcount"] = f"""
SELECT word, count(*)::BIGINT AS cnt FROM ({_WORDS}) GROUP BY word
"""

ORACLE["wordcount_by_set"] = f"""
SELECT input_set, word, count(*)::BIGINT AS cnt FROM (
  SELECT input_set, w AS word FROM (
    SELECT source AS input_set,
           unnest(regexp_split_to_array(text, {_TOK})) AS w FROM documents)
  WHERE w <> '')
GROUP BY input_set, word
"""

ORACLE["wordcount_sorted"] = ORACLE["wordcount"] + " ORDER BY word"

ORACLE["text_scan"] = """
SELECT source AS input_set, count(*)::BIGINT AS n_files,
       sum(len(string_split(text, chr(10))))::BIGINT AS n_lines,
       sum(length(text))::BIGINT AS n_chars
FROM documents GROUP BY source
"""

ORACLE["union_inputs"] = """
SELECT source AS input_set, doc_id AS item_id, text FROM documents
UNION ALL
SELECT 'benchmark' AS input_set, item_id, text FROM benchmark
"""

ORACLE["task_report"] = f"""
WITH hdr(sec, k, line) AS (VALUES (0, 0, 'input :'), (2, 1, ''), (2, 2, 'wordcount output:'),
                                 (4, 3, ''), (5, 4, 'mkdir output.txt:'), (6, 5, ''),
                                 (7, 6, 'save hdfs to disk')),
tasks AS (SELECT DISTINCT source AS task FROM documents),
lines AS (
  SELECT source AS task, doc_id AS k_doc,
         unnest(range(len(string_split(text, chr(10))))) AS k_line,
         unnest(string_split(text, chr(10))) AS line
  FROM documents),
words AS (
  SELECT task, w AS word FROM (
    SELECT source AS task, unnest(regexp_split_to_array(text, {_TOK})) AS w FROM documents)
  WHERE w <> '')
SELECT t.task, h.sec::INT AS sec, 0::BIGINT AS k_doc, h.k::BIGINT AS k_line, '' AS k_word, h.line
FROM tasks t, hdr h
UNION ALL
SELECT task, 1, k_doc, k_line::BIGINT, '', line FROM lines
UNION ALL
SELECT task, 3, 0, 0, word, word || chr(9) || count(*)::VARCHAR FROM words GROUP BY task, word
"""


# ---------------------------------------------------------------- task family
_TASKS = f"""
  SELECT pos, cmd, t[3] AS input, t[4] AS output, t[-1] AS uuid
  FROM (SELECT pos, cmd, regexp_split_to_array(cmd, {_WSRUN}) AS t
        FROM (SELECT pos, trim(value, {_WS}) AS cmd FROM ({si.QUEUE_LINES_SQL}))
        WHERE cmd <> '')"""

_PARSED = f"""
  SELECT pos, uuid, path, coalesce(regexp_matches(uuid, {_UUID_RE}), false) AS valid
  FROM (SELECT pos,
               CASE WHEN nid <> '' THEN nid ELSE regexp_split_to_array(v, {_WSRUN})[-1] END AS uuid,
               CASE WHEN nid <> '' THEN trim(npath, {_WS}) END AS path
        FROM (SELECT pos, v, regexp_extract(v, '^(\\S+):::(.*)$', 1) AS nid,
                     regexp_extract(v, '^(\\S+):::(.*)$', 2) AS npath
              FROM (SELECT pos, trim(value, {_WS}) AS v FROM ({si.COMPLETION_LINES_SQL}))
              WHERE v <> ''))"""

_FIRSTS = f"""
  SELECT uuid, f.pos AS first_pos, nullif(f.p, '') AS path, dup_count
  FROM (SELECT uuid, min({{'pos': pos, 'p': coalesce(path, '')}}) AS f, count(*)::BIGINT AS dup_count
        FROM ({_PARSED}) WHERE valid GROUP BY uuid)"""

ORACLE["queue_scan"] = _TASKS

ORACLE["completion_scan"] = _FIRSTS

ORACLE["report_scan"] = f"""
SELECT doc_id AS report_id, trim(text, {_WS}) AS report FROM documents
WHERE length(text) > 0
"""

ORACLE["completion_match"] = f"""
SELECT t.uuid, t.pos, t.input, f.path, f.first_pos AS done_pos
FROM ({_TASKS}) t JOIN ({_FIRSTS}) f ON t.uuid = f.uuid
"""

ORACLE["pending_tasks"] = f"""
SELECT pos, uuid, input FROM ({_TASKS}) t
WHERE NOT EXISTS (SELECT 1 FROM ({_PARSED}) c WHERE c.valid AND c.uuid = t.uuid)
"""

ORACLE["busy_groups"] = f"""
SELECT container_id, name FROM ({si.CONTAINERS_SQL}) c
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_linestatus = 'O' AND l_suppkey = c.container_id)
"""

ORACLE["result_lookup"] = f"""
SELECT c.uuid, c.path AS log_path, r.report IS NOT NULL AS found, r.report
FROM (SELECT uuid, path,
             CASE WHEN p LIKE '/%' THEN p ELSE '{si.LOG_ROOT}/' || p END AS np
      FROM (SELECT uuid, path, regexp_replace(trim(path, {_WS}), '^logs/', '') AS p
            FROM ({si.LABEL_COMPLETIONS_SQL}))) c
LEFT JOIN (SELECT path, trim(text, {_WS}) AS report FROM ({si.REPORT_FILES_SQL})
           WHERE length(text) > 0) r ON r.path = c.np
"""

_TSF = "'%Y-%m-%d %H:%M:%S.%f'"
ORACLE["timeout_status"] = f"""
SELECT r.event_id, r.user_id, strftime(r.ts, {_TSF}) AS submit_ts,
       strftime(min(c.ts), {_TSF}) AS done_ts,
       CASE WHEN min(c.ts) IS NULL THEN 'timeout' ELSE 'success' END AS status
FROM events r
LEFT JOIN events c ON c.user_id = r.user_id AND c.event_type = 'purchase'
     AND c.ts BETWEEN r.ts AND r.ts + INTERVAL 3600 SECOND
WHERE r.event_type = 'signup'
GROUP BY r.event_id, r.user_id, r.ts
"""

ORACLE["queue_head"] = f"""
SELECT pos, cmd, t[3] AS input, t[4] AS output, t[-1] AS uuid
FROM (SELECT pos, cmd, regexp_split_to_array(cmd, {_WSRUN}) AS t
      FROM (SELECT pos, trim(value, {_WS}) AS cmd
            FROM (SELECT * FROM ({si.QUEUE_LINES_SQL}) ORDER BY pos LIMIT 7))
      WHERE cmd <> '')
"""

ORACLE["queue_pop"] = f"""
WITH q AS ({si.QUEUE_LINES_SQL})
SELECT pos, value FROM q
WHERE pos > (SELECT max(pos) FROM (SELECT pos FROM q ORDER BY pos LIMIT 1))
"""

ORACLE["completion_tail"] = f"""
SELECT pos, value FROM ({si.COMPLETION_LINES_SQL}) ORDER BY pos DESC, value DESC LIMIT 10
"""

ORACLE["queue_status"] = """
SELECT o_orderpriority AS run, count(*)::BIGINT AS n_tasks,
       count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS n_running,
       bool_or(o_orderstatus = 'O') AS any_running
FROM orders GROUP BY o_orderpriority
"""

ORACLE["exec_time_mining"] = f"""
SELECT doc_id, rc, matched, CASE WHEN matched THEN trim(m, {_WS}) ELSE text END AS result
FROM (SELECT doc_id, text, rc, m, (rc = 0 AND m <> '') AS matched
      FROM (SELECT doc_id, text, (CASE WHEN n_chars < 100 THEN 1 ELSE 0 END)::BIGINT AS rc,
                   regexp_extract(text, '(?is)(the .*? of )', 1) AS m
            FROM documents))
"""

ORACLE["access_log"] = """
SELECT event_id,
       printf('%s - INFO - [access] %s - "%s %s %s" %d %s - %.2fms',
              strftime(end_ts, '%H:%M:%S'), client, method, path, 'HTTP/1.1', status,
              coalesce(bytes, '-'),
              (epoch_us(end_ts) - epoch_us(ts))::DOUBLE / 1000.0::DOUBLE) AS log_line
FROM (SELECT event_id, ts,
             ts + to_microseconds(round(value * 1000)::BIGINT) AS end_ts,
             printf('10.0.%d.%d', user_id // 256, user_id % 256) AS client,
             CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method,
             CASE WHEN event_type = 'view' THEN '/favicon.ico' ELSE '/' || event_type END AS path,
             CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
             CASE WHEN event_type <> 'click' THEN json_extract_string(props, '$.k') END AS bytes
      FROM events)
WHERE path <> '/favicon.ico'
"""

ORACLE["callback_outbox"] = f"""
SELECT u AS uuid,
       CASE WHEN o_orderpriority = '1-URGENT'
            THEN to_json({{'uuid': u, 'task_status': st,
                           'result': {{'status': st, 'cmd': '{JOB_CMD} ' || ip || ' ' || op,
                                      'output': msg, 'input_path': ip, 'output_path': op,
                                      'execution_time': hms}}}})
            ELSE to_json({{'uuid': u, 'success': ok, 'message': msg, 'timestamp': hms}}) END::VARCHAR
         AS payload
FROM (SELECT *, CASE WHEN ok THEN 'success' ELSE 'failed' END AS st,
             CASE WHEN ok THEN 'wordcount finished: ' || op ELSE {_q(TIMEOUT_MESSAGE)} END AS msg
      FROM (SELECT o_orderpriority, {si._uuid_sql('o_orderkey')} AS u, o_orderstatus = 'F' AS ok,
                   'output/o' || o_orderkey::VARCHAR AS op, 'input/c' || o_custkey::VARCHAR AS ip,
                   strftime(o_orderdate, '%H:%M:%S') AS hms
            FROM orders WHERE o_orderstatus IN ('F', 'O')))
"""

_PIPE_BLANK = ("(coalesce(json_extract_string(body, '$.ipy_path'), '') = '' "
               "OR coalesce(json_extract_string(body, '$.pipeline'), '') = '')")
ORACLE["request_scan"] = f"""
SELECT event_id, ts, variant, error IS NULL AS accepted,
       (CASE WHEN error IS NULL THEN 200 ELSE 400 END)::BIGINT AS code, error,
       CASE WHEN error IS NULL AND variant <> 'pipeline' THEN json_extract_string(body, '$.input') END AS input,
       CASE WHEN error IS NULL AND variant = 'micro' THEN coalesce(json_extract_string(body, '$.output'), '')
            WHEN error IS NULL AND variant = 'hadoop' THEN json_extract_string(body, '$.output') END AS output,
       CASE WHEN error IS NULL AND variant <> 'pipeline' THEN json_extract_string(body, '$.callback_url') END
         AS callback_url
FROM (SELECT event_id, ts, variant, body,
             CASE WHEN keys IS NULL THEN {_q(INVALID_ERROR)}
                  WHEN variant = 'pipeline' AND {_PIPE_BLANK} THEN {_q(PIPELINE_ERROR)}
                  WHEN variant = 'hadoop' AND NOT list_contains(keys, 'input') THEN 'required key absent: input'
                  WHEN variant = 'hadoop' AND NOT list_contains(keys, 'output') THEN 'required key absent: output'
                  WHEN variant = 'hadoop' AND NOT list_contains(keys, 'callback_url')
                       THEN 'required key absent: callback_url'
                  WHEN variant = 'micro' AND NOT list_contains(keys, 'input') THEN 'required key absent: input'
                  WHEN variant = 'micro' AND NOT list_contains(keys, 'callback_url')
                       THEN 'required key absent: callback_url'
             END AS error
      FROM (SELECT *, CASE WHEN json_valid(body) THEN json_keys(body) END AS keys
            FROM ({si.REQUEST_BODIES_SQL})))
"""


# --------------------------------------------------------------- usage family
_SNAPS = si.SNAPSHOT_ROWS_SQL
_NUMRE = r"'^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]+)\s*$'"
_CRE = _q(CONTAINER_RE)
_FACTOR = "CASE u " + " ".join(f"WHEN '{u}' THEN {f}" for u, f in MEM_UNITS.items()) + " END"


def _pct(c: str) -> str:
    return f"(TRY_CAST(trim({c}, '%') AS DECIMAL(18,4)) * 0.01::DECIMAL(2,2))"


def _bytes(c: str) -> str:
    num = f"TRY_CAST(regexp_extract({c}, {_NUMRE}, 1) AS DECIMAL(18,4))"
    unit = f"regexp_extract({c}, {_NUMRE}, 2)"
    return f"round({num} * ({_FACTOR.replace('CASE u', 'CASE ' + unit)})::DECIMAL(18,0), 0)::BIGINT"


_TYPED = f"""
  SELECT run_id, phase, sample_no, name,
         nullif(regexp_extract(name, {_CRE}, 1), '') AS role,
         TRY_CAST(nullif(regexp_extract(name, {_CRE}, 2), '') AS BIGINT) AS group_no,
         coalesce(TRY_CAST(nullif(regexp_extract(name, {_CRE}, 3), '') AS BIGINT),
                  CASE WHEN regexp_extract(name, {_CRE}, 1) = 'master' THEN 0::BIGINT END) AS slot,
         {_pct('cpu_pct')} AS cpu,
         {_bytes("split_part(mem_usage, '/', 1)")} AS mem_used,
         {_bytes("split_part(mem_usage, '/', 2)")} AS mem_limit,
         {_pct('mem_pct')} AS mem
  FROM ({_SNAPS})"""

_PHASE_RANK = "CASE WHEN phase = 'end' THEN 1 ELSE 0 END"


def _by_snapshot(metric: str) -> str:
    return f"""
  SELECT run_id, phase, sample_no, round(sum({metric}), 3)::DOUBLE AS {metric}
  FROM ({_TYPED}) GROUP BY run_id, phase, sample_no"""


_CPU = _by_snapshot("cpu")


def _axis(src: str, step: str = "6.5") -> str:
    return f"""
  SELECT run_id, phase, sample_no, idx, 0.0::DOUBLE + idx::DOUBLE * {step}::DOUBLE AS t_sec
  FROM (SELECT run_id, phase, sample_no,
               (row_number() OVER (PARTITION BY run_id ORDER BY {_PHASE_RANK}, sample_no) - 1)::BIGINT AS idx
        FROM (SELECT DISTINCT run_id, phase, sample_no FROM ({src})))"""


ORACLE["stat_scan"] = _SNAPS

ORACLE["stat_typed"] = f"""
SELECT run_id, phase, sample_no, name, role, group_no, slot, cpu::DOUBLE AS cpu, mem_used, mem_limit,
       mem::DOUBLE AS mem
FROM ({_TYPED})
"""

ORACLE["fleet_filter"] = f"""
SELECT container_id, name FROM ({si.CONTAINERS_SQL}) WHERE regexp_matches(name, {_q(FLEET_NAME_RE)})
"""

ORACLE["name_count"] = f"""
SELECT nation, count(*) FILTER (WHERE contains(name, 'hadoop-master'))::BIGINT AS n_groups
FROM ({si.CONTAINERS_SQL}) GROUP BY nation
"""

ORACLE["cpu_by_snapshot"] = _CPU
ORACLE["mem_by_snapshot"] = _by_snapshot("mem")

ORACLE["run_makespan"] = """
SELECT user_id, day, start_ms, end_ms, (end_ms - start_ms)::DOUBLE / 1000.0::DOUBLE AS elapsed_s
FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day,
             ((epoch_us(min(ts)) + 500) // 1000)::BIGINT AS start_ms,
             ((epoch_us(max(ts)) + 500) // 1000)::BIGINT AS end_ms
      FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d'))
"""

ORACLE["time_axis"] = _axis(_SNAPS)

ORACLE["series_align"] = f"""
WITH cpu AS ({_CPU}),
ax AS ({_axis('SELECT * FROM cpu', '1.0')}),
m AS (SELECT run_id, idx - 3 AS idx, cpu AS value
      FROM cpu JOIN ax USING (run_id, phase, sample_no) WHERE idx >= 3),
len AS (SELECT run_id, count(*) AS l FROM m GROUP BY run_id),
grid AS (SELECT run_id, unnest(range(0, (SELECT max(l) FROM len)))::BIGINT AS idx FROM len)
SELECT g.run_id, g.idx, 0.0::DOUBLE + g.idx::DOUBLE * 6.5::DOUBLE AS t_sec,
       last_value(m.value IGNORE NULLS) OVER (PARTITION BY g.run_id ORDER BY g.idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value,
       m.value IS NULL AS padded
FROM grid g LEFT JOIN m ON m.run_id = g.run_id AND m.idx = g.idx
"""

ORACLE["series_head"] = f"""
SELECT run_id, phase, sample_no, cpu FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {_PHASE_RANK}, sample_no) AS rn FROM ({_CPU}))
WHERE rn <= 34
"""

ORACLE["group_timeline"] = f"""
SELECT run_id, phase, sample_no, n_groups,
       coalesce(n_groups <> lag(n_groups) OVER (PARTITION BY run_id ORDER BY {_PHASE_RANK}, sample_no),
                false) AS changed
FROM (SELECT run_id, phase, sample_no,
             count(DISTINCT CASE WHEN contains(name, 'hadoop-master') THEN name END)::BIGINT AS n_groups
      FROM ({_SNAPS}) GROUP BY run_id, phase, sample_no)
"""

ORACLE["end_phase"] = f"""
WITH m AS (SELECT user_id, min(ts) AS mts FROM events WHERE event_type = 'error' GROUP BY user_id),
j AS (SELECT e.user_id, e.event_id, e.ts, m.mts FROM events e LEFT JOIN m ON m.user_id = e.user_id)
SELECT user_id, event_id, strftime(ts, {_TSF}) AS ts, '' AS phase FROM j WHERE mts IS NULL OR ts <= mts
UNION ALL
SELECT user_id, event_id, strftime(ts, {_TSF}) AS ts, 'end' AS phase
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
      FROM j WHERE ts > mts)
WHERE rn <= 4
"""

ORACLE["log_tail"] = f"SELECT value FROM ({si.COMPLETION_LINES_SQL}) ORDER BY pos DESC, value DESC LIMIT 10"
ORACLE["log_head"] = f"SELECT * EXCLUDE (pos) FROM ({ORACLE['queue_head']})"

# ------------------------------------------------------------ contrast family
_MS_LI = """
  SELECT l_returnflag AS strategy, month(l_shipdate)::BIGINT AS n_tasks,
         round(sum(l_extendedprice::DECIMAL(18,2)) * 0.00001::DECIMAL(6,5), 3)::DOUBLE AS seconds
  FROM lineitem GROUP BY l_returnflag, month(l_shipdate)"""

ORACLE["strategy_join"] = f"""
WITH ms AS ({_MS_LI})
SELECT 1::BIGINT AS nodes, n_tasks, a.seconds AS sec_a, n.seconds AS sec_n, r.seconds AS sec_r
FROM (SELECT * FROM ms WHERE strategy = 'A') a
FULL OUTER JOIN (SELECT * FROM ms WHERE strategy = 'N') n USING (n_tasks)
FULL OUTER JOIN (SELECT * FROM ms WHERE strategy = 'R') r USING (n_tasks)
"""

ORACLE["phase_share"] = f"""
WITH ms AS ({_MS_LI})
SELECT 1::BIGINT AS nodes, n_tasks, warm_s, cold_s, work::DOUBLE / 10.0::DOUBLE AS work_pct,
       (1000 - work)::DOUBLE / 10.0::DOUBLE AS scaling_pct
FROM (SELECT n_tasks, warm_s, cold_s,
             ((2000 * round(warm_s * 1000)::BIGINT + round(cold_s * 1000)::BIGINT)
               // (2 * round(cold_s * 1000)::BIGINT))::BIGINT AS work
      FROM (SELECT a.n_tasks, a.seconds AS warm_s, r.seconds AS cold_s
            FROM (SELECT * FROM ms WHERE strategy = 'A') a
            JOIN (SELECT * FROM ms WHERE strategy = 'R') r USING (n_tasks)))
"""

ORACLE["series_contrast"] = f"""
WITH cpu AS ({_CPU}), ax AS ({_axis('SELECT * FROM cpu')})
SELECT idx, max(CASE WHEN run_id = 1 THEN cpu END) AS run_1, max(CASE WHEN run_id = 2 THEN cpu END) AS run_2,
       max(CASE WHEN run_id = 3 THEN cpu END) AS run_3
FROM cpu JOIN ax USING (run_id, phase, sample_no) GROUP BY idx
"""

ORACLE["node_normalise"] = """
SELECT strategy, (n_tasks // nodes)::BIGINT AS tasks_per_node,
       max(CASE WHEN nodes = 1 THEN seconds END) AS sec_1, max(CASE WHEN nodes = 2 THEN seconds END) AS sec_2,
       max(CASE WHEN nodes = 4 THEN seconds END) AS sec_4
FROM (SELECT o_orderpriority AS strategy,
             (CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END)::BIGINT AS nodes,
             month(o_orderdate)::BIGINT AS n_tasks,
             round(sum(o_totalprice::DECIMAL(18,2)) * 0.000001::DECIMAL(7,6), 3)::DOUBLE AS seconds
      FROM orders GROUP BY ALL)
WHERE n_tasks % nodes = 0 GROUP BY 1, 2
"""

# ----------------------------------------------------------- placement family
_WORKERS = f"""
  SELECT name, (row_number() OVER (ORDER BY name) - 1)::BIGINT AS widx
  FROM (SELECT DISTINCT name FROM ({si.CONTAINERS_SQL})
        WHERE regexp_matches(name, {_q(FLEET_NAME_RE)}) AND starts_with(name, 'hadoop-master-'))"""


def _assign_new(ranked: str) -> str:
    return f"""
  SELECT r.*, CASE WHEN o.name IS NOT NULL THEN o.name
                   WHEN (SELECT count(*) FROM w) > 0 THEN (SELECT min(name) FROM w)
                   ELSE 'hadoop-master-0' END AS container
  FROM ({ranked}) r
  LEFT JOIN o ON o.oidx = CASE WHEN (SELECT count(*) FROM o) > 0 THEN r.rank0 % (SELECT count(*) FROM o) END"""


_W_O = f"""w AS ({_WORKERS}),
o AS (SELECT name, (row_number() OVER (ORDER BY name) - 1)::BIGINT AS oidx FROM w
      WHERE name <> 'hadoop-master-0')"""

_RANKED_TASKS = f"SELECT *, (row_number() OVER (ORDER BY pos) - 1)::BIGINT AS rank0 FROM ({_TASKS})"

ORACLE["worker_assign"] = f"""
WITH w AS ({_WORKERS}), t AS ({_RANKED_TASKS}),
s AS (SELECT pos, uuid, rank0,
             CASE WHEN (SELECT count(*) FROM w) > 0 THEN rank0 % (SELECT count(*) FROM w) END AS slot FROM t)
SELECT pos, uuid, rank0, slot, w.name AS container FROM s LEFT JOIN w ON w.widx = s.slot
"""

_ARRIVALS = """
  SELECT pos, queue_len, queue_len AS rank0
  FROM (SELECT pos, k, (cum - least(0, min(cum) OVER (ORDER BY d, k, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
                        - 1)::BIGINT AS queue_len
        FROM (SELECT *, sum(delta) OVER (ORDER BY d, k, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
              FROM (SELECT o_orderdate::DATE AS d, 0 AS k, o_orderkey AS pos, 1 AS delta FROM orders
                    UNION ALL
                    SELECT d, 1, NULL, -count(*)
                    FROM (SELECT max(l_shipdate)::DATE AS d FROM lineitem GROUP BY l_orderkey) GROUP BY d)))
  WHERE k = 0"""

ORACLE["worker_assign_new"] = f"""
WITH {_W_O}
SELECT pos, {si._uuid_sql('pos')} AS uuid, queue_len, container FROM ({_assign_new(_ARRIVALS)})
"""

ORACLE["worker_reassign"] = f"""
WITH {_W_O},
t AS (SELECT o_orderkey AS pos, {si._uuid_sql('o_orderkey')} AS uuid, o_orderstatus,
             (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS rank0 FROM orders),
b AS (SELECT pos, uuid, rank0,
             CASE WHEN o_orderstatus = 'O' THEN container ELSE 'hadoop-master-0' END AS container
      FROM ({_assign_new('SELECT * FROM t')}))
SELECT b.pos, b.uuid, b.container, coalesce(w.name, b.container) AS new_container
FROM b LEFT JOIN w ON w.widx = CASE WHEN b.container = 'hadoop-master-0' AND (SELECT count(*) FROM w) > 1
                                    THEN b.rank0 % (SELECT count(*) FROM w) END
"""

_REQ = ORACLE["request_scan"]
ORACLE["request_scan"] = f"SELECT * EXCLUDE (ts) FROM ({_REQ})"
ORACLE["task_intake"] = f"""
WITH {_W_O},
acc AS (SELECT q.event_id AS pos, q.input, q.output, q.callback_url, q.ts,
               (row_number() OVER (ORDER BY q.event_id) - 1)::BIGINT AS rank0
        FROM ({_REQ}) q
        WHERE q.accepted AND q.variant = 'hadoop')
SELECT u AS uuid, printf('{SERVICE_JOB_CMD} %s %s %s', input, output, u) AS command,
       container, callback_url, strftime(ts, {_TSF}) AS submit_ts, 'pending' AS status
FROM (SELECT *, {si._uuid_sql('pos')} AS u FROM ({_assign_new('SELECT * FROM acc')}))
"""

# ------------------------------------------------------------- scaling family
_DEPTH = """
  SELECT tick, delta,
         (cum - least(0, min(cum) OVER (ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))::BIGINT
           AS depth
  FROM (SELECT *, sum(delta) OVER (ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS tick,
               sum(CASE WHEN event_type = 'signup' THEN 1 ELSE -1 END)::BIGINT AS delta
        FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1))"""

_DECISION = f"""
  SELECT tick, depth, groups, action,
         (CASE action WHEN 'extend' THEN least(depth, 6) WHEN 'shrink' THEN 1 ELSE groups END)::BIGINT AS target
  FROM (SELECT *, CASE WHEN depth > groups AND least(depth, 6) > groups THEN 'extend'
                       WHEN depth = 0 AND groups > 1 THEN 'shrink' ELSE 'hold' END AS action
        FROM (SELECT tick, depth, greatest(1, coalesce(n_up, 1))::BIGINT AS groups
              FROM ({_DEPTH}) LEFT JOIN (
                SELECT tick, count(DISTINCT name) FILTER (WHERE contains(name, 'hadoop-master')) AS n_up
                FROM ({si.LISTINGS_SQL}) GROUP BY tick) USING (tick)))"""

ORACLE["queue_depth"] = _DEPTH
ORACLE["scale_decision"] = _DECISION
ORACLE["scale_actions"] = f"""
SELECT tick, action, step, group_no,
       'hadoop-master-' || group_no::VARCHAR || ',hadoop-slave-' || group_no::VARCHAR || '-1,hadoop-slave-'
         || group_no::VARCHAR || '-2' AS members
FROM (SELECT tick, action, unnest(range(1, abs(target - groups) + 1))::BIGINT AS step,
             unnest(CASE WHEN action = 'extend' THEN range(groups, target)
                         ELSE range(groups - 1, target - 1, -1) END)::BIGINT AS group_no
      FROM ({_DECISION}) WHERE action IN ('extend', 'shrink'))
"""

# ------------------------------------------------------------------ streaming
# Stream twins equal their batch twins once the end marker closed the stream.
ORACLE["stream_queue"] = ORACLE["queue_scan"]
ORACLE["stream_tail"] = f"SELECT * EXCLUDE (pos) FROM ({ORACLE['queue_scan']})"
ORACLE["stream_match"] = ORACLE["timeout_status"]
ORACLE["stream_end_phase"] = ORACLE["end_phase"]
ORACLE["stream_scale"] = ORACLE["scale_decision"]
ORACLE["stream_dedup"] = f"SELECT uuid, first_pos, path FROM ({ORACLE['completion_scan']})"

ORACLE["stream_usage"] = f"""
SELECT strftime(make_timestamp(w * 6500000), {_TSF}) AS window_start,
       round(sum(value::DECIMAL(18,4)), 3)::DOUBLE AS value, count(*)::BIGINT AS n_samples
FROM (SELECT value, epoch_us(ts) // 6500000 AS w FROM events) GROUP BY w
"""

# Per-user lifecycle fold: one recursion step consumes every user's next event.
ORACLE["stream_lifecycle"] = f"""
WITH RECURSIVE ev AS (
  SELECT user_id, ts, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
st(user_id, n, open, status, submit_ts, out_status, out_submit, out_end) AS (
  SELECT DISTINCT user_id, 0::BIGINT, false, NULL::VARCHAR, NULL::TIMESTAMP, NULL::VARCHAR,
         NULL::TIMESTAMP, NULL::TIMESTAMP FROM ev
  UNION ALL
  SELECT user_id, n,
         (open0 AND NOT closes) OR opens,
         CASE WHEN opens THEN 'pending'
              WHEN open0 AND NOT closes THEN
                   CASE WHEN event_type IN ('click', 'view') AND status = 'pending' THEN 'running'
                        ELSE status END END,
         CASE WHEN opens THEN ts WHEN open0 AND NOT closes THEN submit_ts END,
         CASE WHEN expired THEN 'timeout'
              WHEN closes THEN CASE WHEN event_type = 'purchase' THEN 'success' ELSE 'failed' END END,
         CASE WHEN expired OR closes THEN submit_ts END,
         CASE WHEN expired THEN submit_ts + INTERVAL 3600 SECOND WHEN closes THEN ts END
  FROM (SELECT *, open0 AND event_type IN ('purchase', 'error') AS closes,
               NOT open0 AND event_type = 'signup' AS opens
        FROM (SELECT e.user_id, e.n, e.ts, e.event_type, s.status, s.submit_ts,
                     coalesce(s.open AND e.ts > s.submit_ts + INTERVAL 3600 SECOND, false) AS expired,
                     coalesce(s.open AND NOT (e.ts > s.submit_ts + INTERVAL 3600 SECOND), false) AS open0
              FROM st s JOIN ev e ON e.user_id = s.user_id AND e.n = s.n + 1)))
SELECT user_id, strftime(out_submit, {_TSF}) AS submit_ts, strftime(out_end, {_TSF}) AS end_ts,
       out_status AS status
FROM st WHERE out_status IS NOT NULL
UNION ALL
SELECT user_id, strftime(submit_ts, {_TSF}), strftime(submit_ts + INTERVAL 3600 SECOND, {_TSF}), 'timeout'
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS rk FROM st)
WHERE rk = 1 AND open
"""

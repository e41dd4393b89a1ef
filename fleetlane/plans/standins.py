"""How the driver's tables stand in for the fleet's data.

Each stand-in is a Spark builder plus its DuckDB twin (a CTE body), kept
side by side so the two cannot drift.  Every builder reads a whole table
and only projects it: no row is sampled, capped or filtered away here.

* orders    -> task queue lines   (pos = o_orderkey, one line per order)
* lineitem  -> completion log     (one line per item, both formats)
* lineitem  -> container snapshots (run = return flag, sample = ship month,
                                     container = supplier + line number)
* supplier  -> containers          (fleet masters, or other containers)
* documents -> job outputs / reports / input sets
* events    -> requests, access records, queue ticks
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlane.functions.ids import STANDIN_UUID_FMT, standin_uuid
from fleetlane.functions.timefmt import as_ts
from fleetlane.operators.tasks import JOB_CMD
from fleetlane.sources.tables import spread, table

SQL_UUID = "printf('" + STANDIN_UUID_FMT + "', {k} & 4294967295, ({k} >> 32) & 4294967295)"

# Root folder the task logs are written under.
LOG_ROOT = "/srv/fleet/logs"


def _uuid_sql(k: str) -> str:
    return SQL_UUID.format(k=k)


# ------------------------------------------------------------- queue lines
def queue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, value): one command line per order; pending low-priority orders
    were cleared to blank lines; open orders use tabs/double blanks."""
    return queue_lines_of(table(spark, sf_dir, "orders"))


def queue_lines_of(o: DataFrame) -> DataFrame:
    """:func:`queue_lines` over any orders frame (batch or stream)."""
    uuid = standin_uuid(F.col("o_orderkey"))
    inp = F.concat(F.lit("input/c"), F.col("o_custkey").cast("string"))
    out = F.concat(F.lit("output/o"), F.col("o_orderkey").cast("string"))
    sep = F.when(F.col("o_orderstatus") == "O", F.lit("\t ")).otherwise(F.lit(" "))
    line = F.concat_ws("", F.lit(JOB_CMD), sep, inp, sep, out, sep, uuid)
    blank = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    return o.select(F.col("o_orderkey").alias("pos"),
                    F.when(blank, F.lit("   ")).otherwise(line).alias("value"))


QUEUE_LINES_SQL = f"""
SELECT o_orderkey AS pos,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN '   '
            ELSE '{JOB_CMD}' || sep || 'input/c' || o_custkey::VARCHAR || sep
                 || 'output/o' || o_orderkey::VARCHAR || sep || {_uuid_sql('o_orderkey')} END AS value
FROM (SELECT *, CASE WHEN o_orderstatus = 'O' THEN chr(9) || ' ' ELSE ' ' END AS sep FROM orders)
"""


# --------------------------------------------------------- completion log
def completion_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, value): one completion per line item for task l_orderkey.

    Odd line numbers use the new ``id:::path`` format (path relative with
    ``logs/``, bare, or absolute by return flag), even ones the old command
    format; quantity 50 items carry a corrupted id (trailing ``i``)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_partkey", "l_shipdate")
    return completion_lines_of(spread(li))


def completion_lines_of(li: DataFrame, keep=()) -> DataFrame:
    """:func:`completion_lines` over any lineitem frame (batch or stream)."""
    uuid = standin_uuid(F.col("l_orderkey"))
    uuid = F.when(F.col("l_quantity") == 50, F.concat(uuid, F.lit("i"))).otherwise(uuid)
    fname = F.concat(standin_uuid(F.col("l_orderkey")), F.lit(".txt"))
    path = (F.when(F.col("l_returnflag") == "R", F.concat(F.lit(LOG_ROOT + "/"), fname))
             .when(F.col("l_returnflag") == "A", fname)
             .otherwise(F.concat(F.lit("logs/"), fname)))
    new = F.concat(uuid, F.lit(":::"), path)
    old = F.concat(F.lit(JOB_CMD + " input/p"), F.col("l_partkey").cast("string"),
                   F.lit(" output/o"), F.col("l_orderkey").cast("string"), F.lit(" "), uuid)
    pos = F.unix_date(F.to_date(F.col("l_shipdate"))).cast("bigint") * 16 + F.col("l_linenumber")
    return li.select(*keep, pos.alias("pos"),
                     F.when(F.col("l_linenumber") % 2 == 1, new).otherwise(old).alias("value"))


COMPLETION_LINES_SQL = f"""
SELECT ((l_shipdate::DATE - DATE '1970-01-01')::BIGINT * 16 + l_linenumber)::BIGINT AS pos,
       CASE WHEN l_linenumber % 2 = 1 THEN u || ':::' ||
                 CASE WHEN l_returnflag = 'R' THEN '{LOG_ROOT}/' || f
                      WHEN l_returnflag = 'A' THEN f ELSE 'logs/' || f END
            ELSE '{JOB_CMD} input/p' || l_partkey::VARCHAR || ' output/o'
                 || l_orderkey::VARCHAR || ' ' || u END AS value
FROM (SELECT *,
             CASE WHEN l_quantity = 50 THEN {_uuid_sql('l_orderkey')} || 'i'
                  ELSE {_uuid_sql('l_orderkey')} END AS u,
             {_uuid_sql('l_orderkey')} || '.txt' AS f
      FROM lineitem)
"""


# ---------------------------------------------------------------- reports
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): the report file of task ``doc_id`` is a document."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit(LOG_ROOT + "/"), standin_uuid(F.col("doc_id")),
                             F.lit(".txt")).alias("path"), "text")


REPORT_FILES_SQL = f"""
SELECT '{LOG_ROOT}/' || {_uuid_sql('doc_id')} || '.txt' AS path, text FROM documents
"""


def label_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uuid, path): a completion line per labelled document; toxic ones
    point at an archive folder where no report exists."""
    lb = table(spark, sf_dir, "labels")
    u = standin_uuid(F.col("doc_id"))
    f = F.concat(u, F.lit(".txt"))
    path = (F.when(F.col("toxic") == 1, F.concat(F.lit("/mnt/archive/"), f))
             .when(F.col("quality") == 1, F.concat(F.lit("logs/"), f))
             .otherwise(f))
    return lb.select(u.alias("uuid"), path.alias("path"))


LABEL_COMPLETIONS_SQL = f"""
SELECT u AS uuid,
       CASE WHEN toxic = 1 THEN '/mnt/archive/' || u || '.txt'
            WHEN quality = 1 THEN 'logs/' || u || '.txt' ELSE u || '.txt' END AS path
FROM (SELECT *, {_uuid_sql('doc_id')} AS u FROM labels)
"""


# ------------------------------------------------------------- containers
def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container_id, nation, name): every supplier is a container; those
    with a non-negative balance are fleet masters, the rest other services."""
    s = table(spark, sf_dir, "supplier")
    name = (F.when(F.col("s_acctbal") >= 0,
                   F.concat(F.lit("hadoop-master-"), F.col("s_suppkey").cast("string")))
             .otherwise(F.concat(F.lit("registry-"), F.col("s_suppkey").cast("string"))))
    return s.select(F.col("s_suppkey").alias("container_id"),
                    F.col("s_nationkey").cast("bigint").alias("nation"), name.alias("name"))


CONTAINERS_SQL = """
SELECT s_suppkey AS container_id, s_nationkey::BIGINT AS nation,
       CASE WHEN s_acctbal >= 0 THEN 'hadoop-master-' || s_suppkey::VARCHAR
            ELSE 'registry-' || s_suppkey::VARCHAR END AS name
FROM supplier
"""


# -------------------------------------------------------------- snapshots
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw container snapshot rows, as the sampler writes them (all text).

    run = return flag (A=1, N=2, R=3), sample = months since 1970 of the
    ship date, container = supplier (line 1 = master, others = slaves),
    CPU % = tax, MEM % = discount of a 62.36 GiB limit."""
    li = spread(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_suppkey", "l_linenumber", "l_tax",
                                                        "l_discount"))
    run = (F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2)
            .otherwise(3)).cast("bigint")
    sample = ((F.year("l_shipdate") - 1970) * 12 + F.month("l_shipdate") - 1).cast("bigint")
    sk = F.col("l_suppkey").cast("string")
    name = (F.when(F.col("l_linenumber") == 1, F.concat(F.lit("hadoop-master-"), sk))
             .otherwise(F.concat(F.lit("hadoop-slave-"), sk, F.lit("-"),
                                 (F.col("l_linenumber") - 1).cast("string"))))
    cpu = F.concat((F.col("l_tax") * 100).cast("decimal(10,2)").cast("string"), F.lit("%"))
    mem_pct = F.concat((F.col("l_discount") * 100).cast("decimal(10,2)").cast("string"), F.lit("%"))
    used = (F.when(F.col("l_discount") >= 0.05,
                   F.concat((F.col("l_discount") * 62.36).cast("decimal(12,3)").cast("string"),
                            F.lit("GiB")))
             .otherwise(F.concat((F.col("l_discount") * 62.36 * 1024).cast("decimal(12,1)")
                                 .cast("string"), F.lit("MiB"))))
    return li.select(run.alias("run_id"), F.lit("").alias("phase"), sample.alias("sample_no"),
                     name.alias("name"), cpu.alias("cpu_pct"),
                     F.concat(used, F.lit(" / 62.36GiB")).alias("mem_usage"),
                     mem_pct.alias("mem_pct"))


SNAPSHOT_ROWS_SQL = """
SELECT (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END)::BIGINT AS run_id,
       '' AS phase,
       ((year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1)::BIGINT AS sample_no,
       CASE WHEN l_linenumber = 1 THEN 'hadoop-master-' || l_suppkey::VARCHAR
            ELSE 'hadoop-slave-' || l_suppkey::VARCHAR || '-' || (l_linenumber - 1)::VARCHAR END AS name,
       (l_tax * 100)::DECIMAL(10,2)::VARCHAR || '%' AS cpu_pct,
       CASE WHEN l_discount >= 0.05 THEN (l_discount * 62.36)::DECIMAL(12,3)::VARCHAR || 'GiB'
            ELSE (l_discount * 62.36 * 1024)::DECIMAL(12,1)::VARCHAR || 'MiB' END
         || ' / 62.36GiB' AS mem_usage,
       (l_discount * 100)::DECIMAL(10,2)::VARCHAR || '%' AS mem_pct
FROM lineitem
"""


# ------------------------------------------------------------ ticks (events)
def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``ts`` as a UTC TIMESTAMP (the parquet reads as NTZ)."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("ts", as_ts(F.col("ts")))


def listed_name():
    """The container an event of the stream shows to be up: six workers by
    user, of which views come from another service."""
    n = F.pmod(F.col("user_id"), F.lit(6)).cast("string")
    return F.when(F.col("event_type") == "view", F.concat(F.lit("registry-"), n)).otherwise(
        F.concat(F.lit("hadoop-master-"), n))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tick, name): the containers seen in each hour."""
    e = event_times(spark, sf_dir)
    return e.select(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("tick"),
                    listed_name().alias("name"))


LISTINGS_SQL = """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS tick,
       CASE WHEN event_type = 'view' THEN 'registry-' ELSE 'hadoop-master-' END || (user_id % 6)::VARCHAR AS name
FROM events
"""


# --------------------------------------------------------- requests (events)
def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, variant, body): a request per event; which keys the body
    carries follows the event's own fields (props.k, value, user)."""
    e = spread(table(spark, sf_dir, "events"))
    k = F.from_json("props", "k bigint").getField("k")
    variant = (F.when(F.col("event_type").isin("signup", "purchase"), "hadoop")
                .when(F.col("event_type").isin("click", "view"), "micro")
                .otherwise("pipeline"))
    uid = F.col("user_id").cast("string")
    job = F.concat_ws(", ",
                      F.when(k >= 10, F.concat(F.lit('"input": "input/u'), uid, F.lit('"'))),
                      F.when(F.col("value") >= 5.0,
                             F.concat(F.lit('"output": "output/e'), F.col("event_id").cast("string"),
                                      F.lit('"'))),
                      F.when(k < 90, F.concat(F.lit('"callback_url": "http://client-'), uid,
                                              F.lit('/done"'))))
    pipe = F.concat(F.lit('"ipy_path": "'),
                    F.when(k < 30, F.lit("")).otherwise(F.concat(F.lit("nb/u"), uid, F.lit(".ipynb"))),
                    F.lit('", "pipeline": "p'), k.cast("string"), F.lit('"'))
    body = (F.when(k >= 98, F.lit('{"input": '))
             .otherwise(F.concat(F.lit("{"), F.when(variant == "pipeline", pipe).otherwise(job),
                                 F.lit("}"))))
    return e.select("event_id", as_ts(F.col("ts")).alias("ts"), variant.alias("variant"),
                    body.alias("body"))


REQUEST_BODIES_SQL = """
SELECT event_id, ts, variant,
       CASE WHEN k >= 98 THEN '{"input": '
            ELSE '{' || CASE WHEN variant = 'pipeline'
                   THEN '"ipy_path": "' || CASE WHEN k < 30 THEN '' ELSE 'nb/u' || user_id::VARCHAR || '.ipynb' END
                        || '", "pipeline": "p' || k::VARCHAR || '"'
                   ELSE concat_ws(', ',
                          CASE WHEN k >= 10 THEN '"input": "input/u' || user_id::VARCHAR || '"' END,
                          CASE WHEN value >= 5.0 THEN '"output": "output/e' || event_id::VARCHAR || '"' END,
                          CASE WHEN k < 90 THEN '"callback_url": "http://client-' || user_id::VARCHAR || '/done"' END)
                   END || '}' END AS body
FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k,
             CASE WHEN event_type IN ('signup', 'purchase') THEN 'hadoop'
                  WHEN event_type IN ('click', 'view') THEN 'micro' ELSE 'pipeline' END AS variant
      FROM events)
"""


def access_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One served request per event: path from the event type (views are
    the browser's icon fetch), errors answer 500, clicks send no length,
    the request took ``value`` milliseconds."""
    e = event_times(spark, sf_dir)
    path = F.when(F.col("event_type") == "view", "/favicon.ico").otherwise(
        F.concat(F.lit("/"), F.col("event_type")))
    method = F.when(F.col("event_type").isin("signup", "purchase"), "POST").otherwise("GET")
    end_ts = F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1000).cast("bigint"))
    uid = F.col("user_id")
    return e.select(
        "event_id",
        F.format_string("10.0.%d.%d", (uid / 256).cast("bigint"), F.pmod(uid, F.lit(256))).alias("client"),
        method.alias("method"), path.alias("path"), F.lit("HTTP/1.1").alias("protocol"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.when(F.col("event_type") != "click", F.get_json_object("props", "$.k")).alias("bytes"),
        F.col("ts").alias("start_ts"), end_ts.alias("end_ts"))

"""Log-shaped views over the given tables.

The tables hold no log lines, so each view derives them with SQL text that reads the
same in Spark and in DuckDB.  ``{minute_format}``-like differences are the only
placeholders.  Views always cover the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberwatch.session import configure

SPARK_CLOCK = "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"
DUCKDB_CLOCK = "strftime(ts, '%Y-%m-%d %H:%M:%S')"

LOG_EVENTS = """
SELECT concat('app_', user_id) AS block_id, event_id AS line_id, ts, event_type,
       concat('svc', user_id % 10) AS source, concat('host', user_id % 7) AS source_machine,
       concat({clock}, ' host', user_id % 7, ' app[', user_id, ']: ', CASE event_type
         WHEN 'error'    THEN concat('ERROR authentication failure: login failed for user u', user_id,
                                     ' from 10.0.', event_id % 4, '.', event_id % 256,
                                     ' port ', 1024 + event_id % 5000)
         WHEN 'signup'   THEN concat('WARN user account created, privilege change for admin group id 0x00',
                                     event_id % 100)
         WHEN 'purchase' THEN concat('INFO scheduled task created at /srv/jobs/', event_id,
                                     ' by svc', user_id % 10, '@example.com')
         WHEN 'view'     THEN concat('INFO remote connection attempt to https://example.com/p/', event_id)
         ELSE concat('INFO too many requests: timeout after ', event_id % 30, ' s') END) AS raw
FROM {events}
"""

# Windows event records: a channel, an event id and a rendered line per event
WINDOWS_EVENTS = """
SELECT event_id AS record_id, ts, user_id, event_type, channel, win_id,
       concat('host', user_id % 7) AS source_machine,
       CASE WHEN event_type = 'click' THEN 'linux' ELSE 'windows' END AS os,
       CASE WHEN event_type = 'view' THEN 'winlog' ELSE 'syslog' END AS format,
       concat({clock}, ' [', channel, '] EventID=', win_id, ' ', CASE event_type
         WHEN 'error'  THEN concat('An account failed to log on. user u', user_id)
         WHEN 'signup' THEN concat('A member was added, elevated group. user u', user_id)
         ELSE concat('Event recorded. RecordNumber=', event_id) END) AS raw
FROM (SELECT *,
             CASE user_id % 4 WHEN 0 THEN 'Security' WHEN 1 THEN 'System'
                              WHEN 2 THEN 'Application' ELSE 'Setup' END AS channel,
             CASE event_id % 12 WHEN 0 THEN 4625 WHEN 1 THEN 4648 WHEN 2 THEN 4720 WHEN 3 THEN 4728
                  WHEN 4 THEN 4698 WHEN 5 THEN 7045 WHEN 6 THEN 1102 WHEN 7 THEN 4719
                  WHEN 8 THEN 4624 WHEN 9 THEN 4688 WHEN 10 THEN 4732 ELSE 9999 END AS win_id
      FROM {events}) e
"""

# Scored blocks: one row per event with hit counts and a score on either scale.  The prime
# divisor keeps scores off rounding ties, which DuckDB rounds after scaling by ten;
# scores on band limits are tested on literal frames.
SCORED_BLOCKS = """
SELECT event_id AS alert_id, ts AS alert_at, concat('app_', user_id) AS block_id,
       concat('Host', user_id % 7) AS source_machine,
       CAST((event_id * 37) % 401 - 200 AS DOUBLE) / CAST(997 AS DOUBLE) AS anomaly_score,
       1 + event_id % 50 AS num_events, event_id % 7 AS error_count,
       CASE WHEN event_id % 11 < 8 THEN 0 ELSE event_id % 11 - 7 END AS priority_hits,
       CASE event_type WHEN 'error' THEN 3 ELSE 0 END AS brute_force_hits,
       CASE event_type WHEN 'signup' THEN 1 + event_id % 2 ELSE event_id % 2 END AS privilege_esc_hits,
       CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS dos_hits,
       CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS log_tamper_hits,
       CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END AS startup_hits,
       CASE event_type WHEN 'view' THEN event_id % 4 ELSE 0 END AS network_hits,
       CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'brute_force' WHEN 2 THEN 'unheard+dos'
            WHEN 3 THEN 'log_tamper+startup' WHEN 4 THEN 'unheard'
            ELSE 'network+privilege_esc' END AS cats,
       CASE event_id % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM'
            ELSE 'LOW' END AS priority,
       CAST(event_id % 101 AS DOUBLE) / CAST(10 AS DOUBLE) AS cvss_score
FROM {events}
"""

# Analyst label log: several entries per block over time, one label name not allowed; block
# app_3 never gets an allowed label
LABEL_LOG = """
SELECT concat('app_', o_custkey % 200) AS block_id, o_orderkey AS seq,
       o_orderdate AS labelled_at, o_orderpriority AS note,
       CASE WHEN o_custkey % 200 = 3 THEN 'confirmed' WHEN o_orderpriority = '1-URGENT' THEN 'true_positive'
            WHEN o_orderpriority = '2-HIGH' THEN 'false_positive' WHEN o_orderpriority = '3-MEDIUM' THEN 'true_negative'
            WHEN o_orderpriority = '5-LOW' THEN 'false_negative' ELSE 'confirmed' END AS label
FROM {orders}
"""

# Retrain audit log: feedback and retrain records in arrival order
RETRAIN_LOG = """
SELECT o_orderkey AS seq, o_orderdate AS ts,
       CASE o_orderstatus WHEN 'P' THEN 'model_retrained' ELSE 'feedback_submitted' END AS event,
       CAST(o_custkey % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS contamination
FROM {orders}
"""

HEALTH_LOG = """
SELECT event_id AS seq,
       CASE WHEN event_id % 2 = 0 THEN concat('HOST', user_id) ELSE concat('host', user_id) END AS machine,
       value AS cpu, event_type AS os, ts AS updated_at
FROM {events}
"""

# User directory: machine pairing with mixed case, some users without an address (all on HOST2)
USERS = """
SELECT c_name AS username, concat(' HOST', c_custkey % 9) AS source_machine,
       CASE WHEN c_acctbal < 0 OR c_custkey % 9 = 2 THEN '' ELSE concat('u', c_custkey, '@', lower(n_name), '.example.com') END AS email,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'user' END AS role
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

VIEWS = {
    "log_events": (LOG_EVENTS, ["events"]),
    "windows_events": (WINDOWS_EVENTS, ["events"]),
    "scored_blocks": (SCORED_BLOCKS, ["events"]),
    "label_log": (LABEL_LOG, ["orders"]),
    "retrain_log": (RETRAIN_LOG, ["orders"]),
    "health_log": (HEALTH_LOG, ["events"]),
    "users": (USERS, ["customer", "nation"]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, df[field.name].cast("timestamp"))
    return df


#: Rows that one task derives lines from.
TASK_ROWS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out over every core, and over so many tasks that none grows with the input.

    Splits do not tell: Spark cuts a file by bytes, and all rows of a row group, which may be millions,
    come with one of the cuts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // TASK_ROWS)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, inputs = VIEWS[name]
    frames = {t: spread(table(spark, sf_dir, t)) for t in inputs}
    return spark.sql(sql.replace("{clock}", SPARK_CLOCK), **frames)


def over(events: DataFrame, name: str = "log_events") -> DataFrame:
    """A view over an events-shaped frame, batch or streaming."""
    sql, _ = VIEWS[name]
    return events.sparkSession.sql(sql.replace("{clock}", SPARK_CLOCK), events=events)


def cte(*names: str) -> str:
    """``WITH`` clause defining the named views for DuckDB."""
    parts = []
    for name in names:
        sql, inputs = VIEWS[name]
        body = sql.replace("{clock}", DUCKDB_CLOCK)
        for t in inputs:
            body = body.replace("{" + t + "}", t)
        parts.append(f"{name} AS ({body})")
    return "WITH " + ",\n".join(parts)

"""Queries on scans, parsers and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.functions import text
from emberwatch.operators import features, parsing
from emberwatch.plans import features_queries as FQ
from emberwatch.plans import sqltext as S
from emberwatch.plans.registry import query, rounded
from emberwatch.plans.views import cte, table, view
from emberwatch.schemas import TEMPLATE_CATALOG, struct
from emberwatch.session import fresh_dir
from emberwatch.sources import records, text_files

DOC_LINES = (
    "WITH lines AS (SELECT doc_id, source, unnest(l) AS raw, unnest(range(1, len(l) + 1)) AS line_id"
    " FROM (SELECT doc_id, source, string_split_regex(text, '\\r\\n|\\r|\\n') AS l FROM documents))"
)


@query(
    "scan_text_lines",
    oracle=DOC_LINES + " SELECT doc_id, line_id, raw FROM lines WHERE regexp_matches(raw, '\\S')",
)
def scan_text_lines(spark, sf_dir):
    return text_files.text_lines(table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query(
    "csv_to_logline",
    oracle="SELECT doc_id, concat(source, ' [', lang, '] EventID=', n_chars, ' ',"
    " replace(replace(text, chr(10), ' '), chr(13), ' ')) AS raw FROM documents",
)
def csv_to_logline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("Date and Time"),
        F.col("lang").alias("Level"),
        F.col("n_chars").alias("Event ID"),
        F.col("text").alias("Description"),
    )
    return docs.select("doc_id", text_files.winlog_line(docs).alias("raw"))


@query(
    "csv_export_lines",
    oracle="SELECT concat(source, ' [', lang, '] EventID=', n_chars, ' ',"
    " replace(replace(text, chr(10), ' '), chr(13), ' ')) AS raw FROM documents",
)
def csv_export_lines(spark, sf_dir):
    """The same lines from CSV exports on disk, in two header layouts side by side."""
    folder = fresh_dir(spark, "exports")
    docs = table(spark, sf_dir, "documents")
    layouts = [
        {"source": "Date and Time", "lang": "Level", "n_chars": "Event ID", "text": "Description"},
        {"text": "Message", "n_chars": "Id", "lang": "LevelDisplayName", "source": "TimeCreated"},
    ]
    for i, names in enumerate(layouts):
        part = docs.filter(F.col("doc_id") % 2 == i).select(*[F.col(c).alias(n) for c, n in names.items()])
        writer = part.write.option("header", "true").option("quote", '"').option("escape", '"')
        writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(f"{folder}/layout {i}")
    return text_files.read_winlog_csv(spark, folder, recursive=True).select("raw")


@query(
    "scan_directory",
    oracle=cte("log_events")
    + ", files AS (SELECT source, count(*) AS n FROM log_events GROUP BY source)"
    " SELECT 'unknown' AS os, 'generic' AS format, sum(n)::BIGINT AS events,"
    " sum(n * (n + 1) // 2)::BIGINT AS line_sum, max(n) AS line_max FROM files",
)
def scan_directory(spark, sf_dir):
    """Log lines written as one text file per source, scanned back."""
    folder = fresh_dir(spark, "logdir")
    lines = view(spark, sf_dir, "log_events").select("raw", "source")
    lines.repartition("source").write.partitionBy("source").text(folder)
    events = text_files.read_directory(spark, folder, recursive=True)
    return events.groupBy("os", "format").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("line_id").alias("line_sum"),
        F.max("line_id").alias("line_max"),
    )


FORMAT_NAME = (
    "CASE doc_id % 7 WHEN 0 THEN 'hadoop.log' WHEN 1 THEN 'Auth.log' WHEN 2 THEN 'winevt.csv'"
    " ELSE concat(source, '.txt') END"
)


@query(
    "detect_format",
    oracle=DOC_LINES
    + f", heads AS (SELECT doc_id, lower({FORMAT_NAME}) AS name,"
    " bool_or(line_id <= 5 AND regexp_matches(lower(raw), 'blk_|namenode|datanode')) AS h,"
    " bool_or(line_id <= 5 AND regexp_matches(lower(raw), '\\b(sshd|sudo|su|pam|kernel)\\b')) AS s,"
    " bool_or(line_id <= 5 AND regexp_matches(lower(raw), 'eventid|logname')) AS w"
    " FROM lines WHERE regexp_matches(raw, '\\S') GROUP BY doc_id, name)"
    " SELECT doc_id, CASE "
    + " ".join(
        f"WHEN contains(name, '{w}') THEN '{f}'" for f, words in D.FORMAT_NAME_HINTS for w in words
    )
    + " WHEN h THEN 'hdfs' WHEN s THEN 'syslog' WHEN w THEN 'winlog' ELSE 'generic' END AS format FROM heads",
)
def detect_format(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("name", F.expr(FORMAT_NAME))
    lines = text_files.text_lines(docs, ["doc_id", "name"], "text")
    return text_files.detect_format(lines, ["doc_id"])


# every seventh line is cut short, every fifth lacks a required key
JSON_LINE = (
    "CASE WHEN event_id % 7 = 0 THEN '{{\"raw\": \"cut' "
    "WHEN event_id % 5 = 0 THEN concat('{{\"raw\": \"', event_type, '\", \"template_id\": 1}}') "
    "ELSE concat('{{\"block_id\": \"b', user_id, '\", \"raw\": \"', event_type, "
    "'\", \"template_id\": ', event_id, ', \"extra\": ', props, '}}') END"
).replace("{{", "{").replace("}}", "}")


@query(
    "jsonl_scan_lenient",
    oracle=f"WITH j AS (SELECT event_id, {JSON_LINE} AS line FROM events),"
    " ok AS MATERIALIZED (SELECT event_id, TRY_CAST(line AS JSON) AS o FROM j)"
    " SELECT event_id, json_extract_string(o, '$.block_id') AS block_id,"
    " json_extract_string(o, '$.raw') AS raw,"
    " CAST(json_extract_string(o, '$.template_id') AS BIGINT) AS template_id FROM ok"
    " WHERE o IS NOT NULL AND json_extract_string(o, '$.block_id') IS NOT NULL",
)
def jsonl_scan_lenient(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", F.expr(JSON_LINE).alias("line"))
    schema = struct("block_id string, raw string, template_id bigint")
    return records.parse_json_lines(lines, "line", schema, ["block_id", "raw", "template_id"])


HDFS_LINE = (
    "concat('081109 203518 143 INFO dfs.DataNode: ', CASE WHEN event_id % 3 = 0 THEN 'no block'"
    " ELSE concat('Receiving block blk_', CASE WHEN event_id % 2 = 0 THEN '-' ELSE '' END, user_id,"
    " ' src /10.0.0.', event_id % 255, ' then blk_', event_id) END)"
)


@query(
    "hdfs_block_id",
    oracle=f"WITH h AS (SELECT event_id AS line_id, {HDFS_LINE} AS raw FROM events)"
    " SELECT line_id, raw, coalesce(nullif(regexp_extract(raw, '(blk_[-\\d]+)', 1), ''),"
    " concat('hdfs_line_', line_id)) AS block_id, 'hdfs' AS source, 'linux' AS os FROM h",
)
def hdfs_block_id(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_id"), F.expr(HDFS_LINE).alias("raw")
    )
    return parsing.hdfs_events(lines)


XML_EVENT = (
    "concat('<Event xmlns=\"http://schemas.microsoft.com/win/2004/08/events/event\"><System>',"
    " '<EventID>', win_id, '</EventID><Level>', record_id % 6, '</Level>',"
    " '<TimeCreated SystemTime=\"2024-01-01T00:00:', record_id % 60, 'Z\"/>',"
    " '<EventRecordID>', record_id, '</EventRecordID><Channel>', channel, '</Channel>',"
    " '<Computer>', source_machine, '</Computer></System><EventData>',"
    " '<Data Name=\"TargetUserName\">u', user_id, '</Data><Data Name=\"Empty\"></Data>',"
    " '<Data>', event_type, ' &amp; more</Data></EventData></Event>')"
)


@query(
    "flatten_newlines",
    oracle="SELECT doc_id, regexp_replace(text, '\\r\\n|\\n', ' ', 'g') AS flat FROM documents",
)
def flatten_newlines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.flatten_newlines("text").alias("flat"))


@query(
    "xml_events_in_order",
    oracle=cte("windows_events")
    + " SELECT record_id, row_number() OVER (PARTITION BY user_id ORDER BY record_id) AS place FROM windows_events",
)
def xml_events_in_order(spark, sf_dir):
    """Event files of one user each, every file read in the order of its record ids."""
    folder = fresh_dir(spark, "event-xml")
    docs = view(spark, sf_dir, "windows_events").select("user_id", F.expr(XML_EVENT).alias("value"))
    docs.repartition("user_id").write.partitionBy("user_id").text(folder)
    return records.read_event_xml(spark, folder, recursive=True).select("record_id", "place")


@query(
    "xml_event_to_line",
    oracle=cte("windows_events")
    + " SELECT record_id, concat('Channel=', channel, ' EventID=', win_id, ' Level=',"
    + f" {S.case_of('(record_id % 6)::VARCHAR', D.EVENT_LEVELS, '(record_id % 6)::VARCHAR')},"
    + " ' Time=2024-01-01T00:00:', record_id % 60, 'Z Computer=', source_machine,"
    + " ' | TargetUserName=u', user_id, ' | ', event_type, ' & more',"
    + f" coalesce(concat(' | keywords=', nullif({S.case_of('win_id', D.EVENT_KEYWORDS)}, '')), '')) AS raw"
    + " FROM windows_events WHERE win_id <> 9999"
    + " UNION ALL SELECT record_id, concat('Channel=', channel, ' EventID=', win_id, ' Level=',"
    + f" {S.case_of('(record_id % 6)::VARCHAR', D.EVENT_LEVELS, '(record_id % 6)::VARCHAR')},"
    + " ' Time=2024-01-01T00:00:', record_id % 60, 'Z Computer=', source_machine,"
    + " ' | TargetUserName=u', user_id, ' | ', event_type, ' & more') AS raw"
    + " FROM windows_events WHERE win_id = 9999",
)
def xml_event_to_line(spark, sf_dir):
    docs = view(spark, sf_dir, "windows_events").select(F.expr(XML_EVENT).alias("xml"))
    return records.xml_event_lines(docs)


@query(
    "incremental_since_cursor",
    oracle=cte("windows_events")
    + ", c AS (SELECT channel, max(record_id) AS last_record FROM windows_events"
    " WHERE ts < TIMESTAMP '2024-01-16 00:00:00' AND channel <> 'Setup' GROUP BY channel)"
    " SELECT w.channel, w.record_id, w.win_id FROM windows_events w LEFT JOIN c USING (channel)"
    " WHERE w.record_id > coalesce(c.last_record, 0)",
)
def incremental_since_cursor(spark, sf_dir):
    events = view(spark, sf_dir, "windows_events")
    old = events.filter((F.col("ts") < F.lit("2024-01-16").cast("timestamp")) & (F.col("channel") != "Setup"))
    cursor = records.cursor_high_water(old, "channel", "record_id")
    return records.since_cursor(events, cursor, "channel", "record_id").select(
        "channel", "record_id", "win_id"
    )


@query(
    "cursor_high_water",
    oracle=cte("windows_events")
    + " SELECT channel, max(record_id) AS last_record FROM windows_events GROUP BY channel",
)
def cursor_high_water(spark, sf_dir):
    return records.cursor_high_water(view(spark, sf_dir, "windows_events"), "channel", "record_id")


@query(
    "agent_batch_normalise",
    oracle=cte("windows_events")
    + ", items AS (SELECT record_id, ts, trim(raw) AS raw, channel AS source, win_id FROM windows_events"
    " UNION ALL SELECT record_id, ts, 'plain line', 'agent', NULL FROM windows_events)"
    f" SELECT raw, concat('agent_', source, '_', {S.MINUTE}) AS block_id, source,"
    " source AS source_machine, 'unknown' AS os, strftime(ts, '%Y-%m-%d %H:%M:%S') AS collected_at,"
    f" 'agent_generic' AS template_id, {S.event_threat('win_id')} AS priority_threat FROM items",
)
def agent_batch_normalise(spark, sf_dir):
    item = F.struct(F.concat(F.lit("  "), "raw", F.lit(" ")).alias("log"), F.col("channel").alias("source"))
    plain = F.struct(F.lit("plain line").alias("log"), F.lit(None).cast("string").alias("source"))
    blank = F.struct(F.lit("   ").alias("log"), F.col("channel").alias("source"))
    batches = view(spark, sf_dir, "windows_events").select(
        F.col("ts").alias("received_at"), F.to_json(F.array(item, blank, plain)).alias("payload")
    )
    return records.agent_events(batches).withColumn(
        "collected_at", F.date_format("collected_at", "yyyy-MM-dd HH:mm:ss")
    )


@query("parquet_roundtrip", oracle=FQ.FLAGGED + FQ.grouped(f"{FQ.COUNTS}, {FQ.LENGTHS}, {FQ.LEVELS}"))
def parquet_roundtrip(spark, sf_dir):
    path = fresh_dir(spark, "features")
    out = features.block_features(FQ.parsed(spark, sf_dir), groups=("counts", "lengths", "levels"))
    out.write.parquet(path)
    return rounded(spark.read.parquet(path))


@query(
    "jsonl_sink_roundtrip",
    oracle=cte("log_events") + " SELECT block_id, line_id, source, raw FROM log_events",
)
def jsonl_sink_roundtrip(spark, sf_dir):
    path = fresh_dir(spark, "events-jsonl")
    events = view(spark, sf_dir, "log_events").select("block_id", "line_id", "source", "raw")
    records.write_json_lines(events, path)
    return records.read_json_lines(spark, path, events.schema, ["raw", "block_id"])


@query(
    "template_catalog",
    oracle=FQ.PARSED
    + "SELECT template_id, arg_max(template, line_id) AS template FROM parsed GROUP BY template_id",
)
def template_catalog(spark, sf_dir):
    return parsing.template_catalog(FQ.parsed(spark, sf_dir))


@query(
    "catalog_sorted",
    oracle=FQ.PARSED
    + ", catalog AS (SELECT template_id, arg_max(template, line_id) AS template FROM parsed GROUP BY template_id)"
    " SELECT row_number() OVER (ORDER BY template_id) AS place, template_id, template FROM catalog",
)
def catalog_sorted(spark, sf_dir):
    """The catalog as written: a line's place counts lines from the first file on, in the order of file names."""
    path = fresh_dir(spark, "catalog")
    records.write_catalog(parsing.template_catalog(FQ.parsed(spark, sf_dir)), path)
    lines = text_files.read_log_lines(spark, path, glob="*.json")
    files = lines.groupBy("file").agg(F.max("line_id").alias("n"))
    # one row per file of the catalog
    earlier = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    row = F.from_json("raw", TEMPLATE_CATALOG)
    placed = lines.join(starts, "file").select((F.col("start") + F.col("line_id")).alias("place"), row.alias("row"))
    return placed.select("place", "row.*")


@query(
    "filter_windows_events",
    oracle=cte("windows_events")
    + " SELECT record_id, raw, os, format FROM windows_events WHERE os = 'windows' OR format = 'winlog'",
)
def filter_windows_events(spark, sf_dir):
    return features.windows_events(view(spark, sf_dir, "windows_events")).select(
        "record_id", "raw", "os", "format"
    )

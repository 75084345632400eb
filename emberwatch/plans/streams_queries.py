"""Streaming queries: each drains the given tables once and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.functions import blocks, text
from emberwatch.operators import alerts, forest
from emberwatch.operators import preparation as prep
from emberwatch.plans import alerts_queries as AQ
from emberwatch.plans import features_queries as FQ
from emberwatch.plans import sqltext as S
from emberwatch.plans.registry import query
from emberwatch.plans.views import cte, over, table, view
from emberwatch.schemas import struct
from emberwatch.session import configure, fresh_dir
from emberwatch.sources import records
from emberwatch.streaming import jobs
from emberwatch.streaming.windows import minute_blocks


def events_stream(spark, sf_dir):
    """The events table read as a stream."""
    configure(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(spark, df, purpose):
    """Run an append stream to its end into files and read them back."""
    base = fresh_dir(spark, purpose)
    jobs.to_files(df, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def grow(lines, folder, name):
    """Append ``lines`` (file, order, raw) to the files of a folder, each by one task and in order."""

    def append(rows):
        import os
        from itertools import groupby

        os.makedirs(folder, exist_ok=True)
        for file, own in groupby(rows, key=lambda r: r["file"]):
            with open(f"{folder}/{file}.{name}", "a", encoding="utf-8") as out:
                out.writelines(r["raw"] + "\n" for r in own)

    lines.select("file", "order", "raw").repartition("file").sortWithinPartitions("file", "order").foreachPartition(append)


def tail_growing(spark, lines, folder, name, run):
    """Run a tailing job while its files grow: started, appended to, appended to and rotated, begun anew."""
    import os

    folder = folder.removeprefix("file://")
    part = F.pmod("order", F.lit(4))
    grow(lines.filter(part == 0), folder, name)
    run()
    grow(lines.filter(part == 1), folder, name)
    run()
    grow(lines.filter(part == 2), folder, name)
    for file in sorted(os.listdir(folder)):
        os.rename(f"{folder}/{file}", f"{folder}/{file}.1")
    grow(lines.filter(part == 3), folder, name)
    run()


@query(
    "stream_file_tail",
    oracle=cte("log_events") + " SELECT raw, source FROM log_events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'",
)
def stream_file_tail(spark, sf_dir):
    """One log file per service, tailed from a start time on while all grow and rotate."""
    base = fresh_dir(spark, "tail")
    lines = view(spark, sf_dir, "log_events").select(F.col("source").alias("file"), F.col("line_id").alias("order"), "raw")

    def run():
        tailed = jobs.tail_text(spark, f"{base}/in", F.lit("2024-01-10").cast("timestamp"), pattern="*.log")
        jobs.to_files(tailed.select("raw", "source"), f"{base}/out", f"{base}/checkpoint").awaitTermination()

    tail_growing(spark, lines, f"{base}/in", "log", run)
    return spark.read.schema("raw string, source string").parquet(f"{base}/out")


@query(
    "stream_linux_events",
    oracle=cte("log_events")
    + ", c AS (SELECT *, CASE "
    + " ".join(f"WHEN {S.any_of(w)} THEN '{c.upper()}'" for c, w in D.REALTIME_KEYWORDS.items())
    + " ELSE 'INFO' END AS template_id FROM log_events) SELECT raw, concat('app_', regexp_extract(raw, 'app\\[(\\d+)\\]', 1)) AS block_id,"
    " source, 'host-1' AS source_machine, 'linux' AS os, template_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS collected_at FROM c",
)
def stream_linux_events(spark, sf_dir):
    """Tailed lines in the shape of staged events."""
    base = fresh_dir(spark, "linux")
    lines = view(spark, sf_dir, "log_events").select(F.col("source").alias("file"), F.col("line_id").alias("order"), "raw")

    def run():
        events = jobs.linux_events(jobs.tail_text(spark, f"{base}/in", pattern="*.log"), F.lit("host-1"))
        jobs.to_files(events, f"{base}/out", f"{base}/checkpoint").awaitTermination()

    tail_growing(spark, lines, f"{base}/in", "log", run)
    collected = F.date_format("collected_at", "yyyy-MM-dd HH:mm:ss").alias("collected_at")
    return spark.read.parquet(f"{base}/out").select("raw", "block_id", "source", "source_machine", "os", "template_id", collected)


@query(
    "stream_alert_feed",
    oracle=cte("scored_blocks")
    + " SELECT block_id, priority, num_events FROM scored_blocks WHERE alert_id % 10 <> 0",
)
def stream_alert_feed(spark, sf_dir):
    """Alert lines of a feed that grows between reads; every tenth line is damaged."""
    base = fresh_dir(spark, "feed")
    rows = AQ.scored(spark, sf_dir).select(
        "alert_id", F.to_json(F.struct("block_id", "priority", "num_events")).alias("line")
    )
    damaged = F.when(F.col("alert_id") % 10 == 0, F.expr("left(line, length(line) - 2)")).otherwise(F.col("line"))
    lines = rows.select(F.concat(F.lit("alerts-"), F.col("alert_id") % 8).alias("file"), F.col("alert_id").alias("order"), damaged.alias("raw"))
    schema = struct("block_id string, priority string, num_events bigint")

    def run():
        feed = jobs.tail_json(spark, f"{base}/in", schema, ["block_id"], pattern="*.jsonl")
        jobs.to_files(feed, f"{base}/out", f"{base}/checkpoint").awaitTermination()

    tail_growing(spark, lines, f"{base}/in", "jsonl", run)
    return spark.read.schema(schema).parquet(f"{base}/out")


@query(
    "stream_minute_blocks",
    oracle=cte("log_events")
    + " SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, source, event_type,"
    " count(*) AS num_events, sum(length(raw))::BIGINT AS chars FROM log_events"
    " WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM log_events)"
    " GROUP BY ALL",
)
def stream_minute_blocks(spark, sf_dir):
    """Minute blocks the watermark has closed; the last ten minutes are still open."""
    log = over(events_stream(spark, sf_dir))
    return drain(spark, minute_blocks(log, ["source", "event_type"], watermark="10 minutes"), "minutes")


@query(
    "stream_cooldown",
    oracle=AQ.EVENTS_ALERTS
    + AQ.kept_rows("a", "event_type", 1800 * 1_000_000, "event_id")
    + " SELECT k AS event_type, tie AS event_id FROM chosen",
)
def stream_cooldown(spark, sf_dir):
    base = fresh_dir(spark, "cooldown")
    stream = events_stream(spark, sf_dir).select("event_type", "event_id", "ts")
    jobs.cooldown_job(stream, "event_type", "ts", 1800, "event_id", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_type", "event_id")


@query(
    "stream_dedup",
    oracle=cte("log_events")
    + f", c AS (SELECT block_id, CASE "
    + " ".join(f"WHEN {S.any_of(w)} THEN '{c.upper()}'" for c, w in D.REALTIME_KEYWORDS.items())
    + " ELSE 'INFO' END AS category FROM log_events) SELECT DISTINCT block_id, category FROM c",
)
def stream_dedup(spark, sf_dir):
    from emberwatch.functions.threats import first_category

    log = over(events_stream(spark, sf_dir))
    pairs = log.select("block_id", first_category(F.lower("raw")).alias("category"), "ts")
    return drain(spark, jobs.dedup_alerts(pairs, ["block_id", "category"], "ts"), "dedup").drop("ts")


@query(
    "stream_latest_health",
    oracle=cte("health_log")
    + " SELECT lower(machine) AS machine, arg_max(cpu, (updated_at, seq)) AS cpu,"
    " arg_max(seq, (updated_at, seq)) AS seq FROM health_log GROUP BY lower(machine)",
)
def stream_latest_health(spark, sf_dir):
    base = fresh_dir(spark, "health")
    stream = over(events_stream(spark, sf_dir), "health_log")
    job, table = jobs.latest_health_job(stream, f"{base}/out", f"{base}/checkpoint")
    job.awaitTermination()
    return table.latest().select("machine", "cpu", "seq")


def in_order(events, path, parts):
    """Write events as so many files, one after the other by time, and read them as micro-batches."""
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if low is not None:
        slot = F.floor((F.unix_micros("ts") - low) * parts / (high - low + 1))
        for part in range(parts):
            events.filter(slot == part).coalesce(1).write.mode("append").parquet(path)
    else:
        events.write.parquet(path)
    return events.sparkSession.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def score_cycle(spark, sf_dir, source, base, want):
    """Windows events streamed through features, forest, rules and cooldown."""
    past = FQ.parsed_windows(spark, sf_dir).withColumn("ts", F.lit(None).cast("timestamp"))
    from emberwatch.operators.features import realtime_block_features

    history = prep.zero_fill(realtime_block_features(past.drop("ts")), D.MODEL_FEATURES)
    model = forest.fit(history, D.MODEL_FEATURES, trees=50, contamination=0.05)
    events = over(source, "windows_events")
    threat = blocks.priority_threat(F.col("win_id"))
    stream = events.select(
        "raw",
        "source_machine",
        "ts",
        F.col("record_id").alias("line_id"),
        F.concat(F.lit("EVT_"), F.col("win_id").cast("string")).alias("template_id"),
        threat.alias("priority_threat"),
        F.concat(F.lit("win_"), F.col("user_id").cast("string")).alias("block_id"),
    )
    cycle = jobs.score_cycle_job(stream, model, base, f"{base}/checkpoint", threshold=0.1, span="7 days", want=want)
    cycle.awaitTermination()
    return cycle


@query(
    "stream_rule_alerts",
    oracle=cte("windows_events")
    + f", flagged AS (SELECT concat('win_', user_id) AS block_id, {S.flags(D.REALTIME_KEYWORDS)} FROM windows_events)"
    + f", hit AS (SELECT block_id, {S.hits(D.REALTIME_KEYWORDS)} FROM flagged GROUP BY block_id) "
    + " UNION ALL ".join(
        f"SELECT block_id, '{c}' AS category, '{p}' AS priority FROM hit WHERE {c}_hits >= {n}" for c, p, n in D.RULES
    ),
)
def stream_rule_alerts(spark, sf_dir):
    """Rule alerts of the score cycle, with every block spread over several micro-batches."""
    base = fresh_dir(spark, "cycle-parts")
    events = table(spark, sf_dir, "events")
    events.repartition(3, F.xxhash64("event_id")).write.parquet(f"{base}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = score_cycle(spark, sf_dir, source, base, ("rules",)).alerts()
    return out.select("block_id", F.element_at("threat_categories", 1).alias("category"), "priority")


@query(
    "stream_score_cycle",
    oracle=cte("windows_events")
    + f", flagged AS (SELECT *, concat('win_', user_id) AS block_id, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS opened,"
    f" {S.event_threat('win_id')} AS threat, {S.level()} AS level, {S.flags(D.REALTIME_KEYWORDS)} FROM windows_events)"
    " SELECT block_id, strftime(opened, '%Y-%m-%d') AS opened, arg_min(source_machine, record_id) AS source_machine, count(*) AS num_events,"
    " count(DISTINCT win_id) AS unique_templates, max(length(raw))::INTEGER AS max_msg_len, count(*) FILTER (level = 'ERROR') AS error_count,"
    f" count(*) FILTER (threat IS NOT NULL) AS priority_hits, {S.hits(D.REALTIME_KEYWORDS)}, true AS scored FROM flagged"
    " WHERE opened + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM windows_events)"
    " GROUP BY block_id, opened HAVING count(*) >= 3",
)
def stream_score_cycle(spark, sf_dir):
    """The weeks of blocks that the score cycle has closed and scored, over seven micro-batches."""
    base = fresh_dir(spark, "cycle")
    source = in_order(table(spark, sf_dir, "events"), f"{base}/in", 7)
    parts = score_cycle(spark, sf_dir, source, base, ("blocks",)).blocks()
    counts = ["num_events", "unique_templates", "error_count", "priority_hits", *[f"{c}_hits" for c in D.REALTIME_KEYWORDS]]
    return parts.select(
        "block_id", F.date_format("opened_at", "yyyy-MM-dd").alias("opened"), "source_machine",
        *[F.col(c).cast("bigint") for c in counts], F.col("max_msg_len").cast("int"),
        F.col("anomaly_score").between(-1.0, 1.0).alias("scored"),
    )


AGENT_ITEMS = (
    cte("windows_events")
    + f", items AS (SELECT ts, trim(raw) AS raw, concat('agent_', channel, '_', {S.MINUTE}) AS block_id,"
    f" channel AS source, {S.event_threat('win_id')} AS threat, record_id FROM windows_events)"
    f", flagged AS (SELECT *, {S.level()} AS level, {S.flags(D.REALTIME_KEYWORDS)} FROM items)"
    f", block AS (SELECT block_id, source AS source_machine, count(*) AS num_events, max(date_trunc('minute', ts)) AS opened,"
    " count(*) FILTER (level = 'ERROR') AS error_count, count(*) FILTER (threat IS NOT NULL) AS priority_hits,"
    f" {S.hits(D.REALTIME_KEYWORDS)} FROM flagged GROUP BY block_id, source)"
)
AGENT_RULES = " || ".join(
    f"CASE WHEN {c}_hits >= {n} THEN ['{p} — ' || {S.quote(D.CVE_BY_CATEGORY.get(c, D.CVE_GENERIC)['name'])}] ELSE [] END"
    for c, p, n in D.RULES
)


@query(
    "agent_ingest_alerts",
    oracle=AGENT_ITEMS
    + ", judged AS (SELECT *, opened + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM items) AS closed FROM block)"
    " SELECT block_id, source_machine, num_events AS staged,"
    " CASE WHEN closed THEN num_events ELSE 0 END AS scored_events, CASE WHEN closed THEN error_count ELSE 0 END AS error_count,"
    " CASE WHEN closed THEN priority_hits ELSE 0 END AS priority_hits,"
    f" array_to_string(list_sort({AGENT_RULES}), '; ') AS rules, true AS model_agrees FROM judged",
)
def agent_ingest_alerts(spark, sf_dir):
    """Batches of agents, a batch per channel and minute, through staging, rules, score and cooldown.

    ``model_agrees``: model alerts of a block, if any, carry its own score below the threshold.
    """
    base = fresh_dir(spark, "agents")
    past = FQ.parsed_windows(spark, sf_dir)
    from emberwatch.operators.features import realtime_block_features

    history = prep.zero_fill(realtime_block_features(past), D.MODEL_FEATURES)
    model = forest.fit(history, D.MODEL_FEATURES, trees=50, contamination=0.05)
    sent = view(spark, sf_dir, "windows_events").select(
        "ts", F.to_json(F.array(F.struct(F.col("raw").alias("log"), F.col("channel").alias("source")))).alias("payload")
    )
    stream = in_order(sent, f"{base}/in", 3)
    ingest = jobs.agent_ingest_job(stream, model, base, f"{base}/checkpoint", received_at="ts", threshold=0.1)
    ingest.awaitTermination()
    staged = ingest.events().groupBy("block_id", "source_machine").agg(F.count(F.lit(1)).alias("staged"))
    scored = ingest.blocks().select("block_id", F.col("num_events").alias("scored_events"), "error_count", "priority_hits", "anomaly_score")
    raised = ingest.alerts().groupBy("block_id").agg(
        F.array_join(
            F.sort_array(F.collect_list(F.when(F.col("rule_based"), F.regexp_replace("description", r" \(\d+ indicator\(s\)\)$", "")))), "; "
        ).alias("rules"),
        F.collect_list(F.when(~F.col("rule_based"), F.struct("anomaly_score", "description"))).alias("model"),
    )
    own = F.round("anomaly_score", 6)
    agrees = F.forall(
        F.coalesce("model", F.array().cast("array<struct<anomaly_score:double,description:string>>")),
        lambda m: (m["anomaly_score"] == own) & (own < 0.1) & m["description"].contains(F.format_string("score %.4f", own)),
    )
    none = F.lit(0).cast("bigint")
    return staged.join(scored, "block_id", "left").join(raised, "block_id", "left").select(
        "block_id", "source_machine", "staged",
        *[F.coalesce(F.col(c).cast("bigint"), none).alias(c) for c in ("scored_events", "error_count", "priority_hits")],
        F.coalesce("rules", F.lit("")).alias("rules"), agrees.alias("model_agrees"),
    )

"""Queries on block and event features."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.operators import features, parsing
from emberwatch.plans import sqltext as S
from emberwatch.plans.registry import query, rounded
from emberwatch.plans.views import cte, view


def parsed(spark, sf_dir):
    """Log view with template ids."""
    return parsing.with_template(view(spark, sf_dir, "log_events"))


def parsed_windows(spark, sf_dir):
    """Windows view as parsed events with priority threats."""
    from emberwatch.functions import blocks, text

    events = view(spark, sf_dir, "windows_events")
    threat = blocks.priority_threat(F.col("win_id"))
    return events.select(
        "raw",
        "os",
        "format",
        "source_machine",
        F.col("record_id").alias("line_id"),
        F.concat(F.lit("EVT_"), F.col("win_id").cast("string")).alias("template_id"),
        threat.alias("priority_threat"),
        F.concat(F.lit("win_"), F.col("user_id").cast("string")).alias("block_id"),
    )


# --- oracle pieces --------------------------------------------------------------------

PARSED = (
    cte("log_events")
    + f", templated AS (SELECT *, {S.template()} AS template FROM log_events)"
    + f", parsed AS (SELECT *, {S.template_id()} AS template_id FROM templated)"
)
FLAGGED = (
    PARSED
    + f", flagged AS (SELECT *, {S.level()} AS level, {S.flags(D.BATCH_KEYWORDS)},"
    + f" {S.parse_timestamp()} AS seen FROM parsed)"
)
WINDOWS = (
    cte("windows_events")
    + ", parsed AS (SELECT raw, os, format, source_machine, record_id AS line_id,"
    + " concat('EVT_', win_id) AS template_id, concat('win_', user_id) AS block_id,"
    + f" {S.event_threat('win_id')} AS priority_threat FROM windows_events)"
    + f", flagged AS (SELECT *, {S.level()} AS level, {S.flags(D.REALTIME_KEYWORDS)} FROM parsed)"
)
COUNTS = "count(*) AS num_events, count(DISTINCT template_id) AS unique_templates"
LENGTHS = (
    "round(avg(length(raw)), 6) AS avg_msg_len, round(stddev_pop(length(raw)), 6) AS std_msg_len,"
    " max(length(raw))::INTEGER AS max_msg_len, min(length(raw))::INTEGER AS min_msg_len"
)
LEVELS = (
    "count(*) FILTER (level = 'ERROR') AS error_count, count(*) FILTER (level = 'WARN') AS warn_count,"
    " count(*) FILTER (level = 'INFO') AS info_count,"
    " round(count(*) FILTER (level = 'ERROR') / count(*)::DOUBLE, 6) AS error_ratio,"
    " round(count(*) FILTER (level = 'WARN') / count(*)::DOUBLE, 6) AS warn_ratio"
)
DURATION = "CASE WHEN count(seen) >= 2 THEN epoch(max(seen)) - epoch(min(seen)) END"
TIME = (
    f"coalesce({DURATION}, 0.0)::DOUBLE AS block_duration_sec,"
    f" round(CASE WHEN ({DURATION}) IS NULL THEN 0.0 WHEN ({DURATION}) = 0 THEN -1.0"
    f" ELSE count(*) / ({DURATION}) END, 6)::DOUBLE AS events_per_sec"
)
GAPS = "(max(line_id) - min(line_id) + 1 - count(DISTINCT line_id))::BIGINT AS gap_count"
SHAPE = (
    "SELECT block_id, round(-sum(c / t * log2(c / t)), 6) + 0.0 AS template_entropy,"
    " round(max(c) / max(t), 6) AS top_template_ratio"
    " FROM (SELECT block_id, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY block_id)::DOUBLE AS t"
    " FROM flagged GROUP BY block_id, template_id) GROUP BY block_id"
)


def grouped(columns: str, source: str = "flagged") -> str:
    return f"SELECT block_id, {columns} FROM {source} GROUP BY block_id"


# --- queries --------------------------------------------------------------------------


def feature_query(name, groups, columns, oracle):
    @query(name, oracle=oracle)
    def run(spark, sf_dir):
        out = features.block_features(parsed(spark, sf_dir), groups=groups)
        return rounded(out.select(*columns) if columns else out)

    return run


feature_query("block_counts", ("counts",), None, PARSED + grouped(COUNTS, "parsed"))
feature_query("block_msg_len_stats", ("lengths",), None, FLAGGED + grouped(LENGTHS))
feature_query("block_level_counts", ("levels",), None, FLAGGED + grouped(LEVELS))
feature_query(
    "template_entropy",
    ("shape",),
    ["block_id", "template_entropy"],
    FLAGGED + f"SELECT block_id, template_entropy FROM ({SHAPE})",
)
feature_query(
    "top_template_ratio",
    ("shape",),
    ["block_id", "top_template_ratio"],
    FLAGGED + f"SELECT block_id, top_template_ratio FROM ({SHAPE})",
)
feature_query("threat_hits", ("hits",), None, FLAGGED + grouped(S.hits(D.BATCH_KEYWORDS)))
feature_query("block_duration_rate", ("time",), None, FLAGGED + grouped(TIME))
feature_query(
    "block_features",
    features.GROUPS,
    None,
    FLAGGED
    + f", base AS ({grouped(', '.join([COUNTS, LENGTHS, LEVELS, TIME, GAPS, S.hits(D.BATCH_KEYWORDS)]))})"
    + f", shape AS ({SHAPE}) SELECT * FROM base JOIN shape USING (block_id)",
)


@query("sequence_gaps", oracle=cte("log_events") + grouped(GAPS, "log_events"))
def sequence_gaps(spark, sf_dir):
    return features.sequence_gaps(view(spark, sf_dir, "log_events"))


@query(
    "missing_line_ids",
    oracle=cte("log_events")
    + ", steps AS (SELECT block_id, line_id, lead(line_id) OVER"
    " (PARTITION BY block_id ORDER BY line_id) AS nxt"
    " FROM (SELECT DISTINCT block_id, line_id FROM log_events))"
    " SELECT block_id, line_id + 1 AS first_missing, nxt - 1 AS last_missing"
    " FROM steps WHERE nxt > line_id + 1",
)
def missing_line_ids(spark, sf_dir):
    return features.missing_line_ids(view(spark, sf_dir, "log_events"))


@query(
    "event_index",
    oracle=cte("log_events")
    + " SELECT block_id, line_id, row_number() OVER"
    " (PARTITION BY block_id ORDER BY line_id) - 1 AS event_index FROM log_events",
)
def event_index(spark, sf_dir):
    events = view(spark, sf_dir, "log_events").select("block_id", "line_id")
    return features.event_index(events, ties=()).select("block_id", "line_id", "event_index")


@query(
    "event_features",
    oracle=FLAGGED
    + "SELECT block_id, row_number() OVER (PARTITION BY block_id ORDER BY line_id) - 1 AS event_index,"
    " template_id, length(raw)::INTEGER AS msg_len,"
    " len(regexp_extract_all(raw, '\\S+'))::INTEGER AS word_count,"
    " (level = 'ERROR')::INTEGER AS is_error, (level = 'WARN')::INTEGER AS is_warn,"
    " (level = 'INFO')::INTEGER AS is_info, (seen IS NOT NULL)::INTEGER AS has_timestamp, "
    + ", ".join(f"{c}_flag" for c in D.BATCH_KEYWORDS)
    + " FROM flagged",
)
def event_features(spark, sf_dir):
    return features.event_features(parsed(spark, sf_dir))


REALTIME = (
    ", base AS (SELECT block_id, coalesce(nullif(arg_min(source_machine, line_id), ''), 'unknown') AS source_machine,"
    f" {COUNTS}, {LENGTHS}, {LEVELS}, 0.0::DOUBLE AS block_duration_sec, 0.0::DOUBLE AS events_per_sec,"
    " 0::BIGINT AS gap_count, count(*) FILTER (coalesce(priority_threat, '') <> '') AS priority_hits,"
    f" {S.hits(D.REALTIME_KEYWORDS)} FROM flagged GROUP BY block_id HAVING count(*) >= 3)"
    f", shape AS ({SHAPE}) "
)


@query(
    "realtime_block_features",
    oracle=WINDOWS + REALTIME + "SELECT * FROM base JOIN shape USING (block_id)",
)
def realtime_block_features(spark, sf_dir):
    return rounded(features.realtime_block_features(parsed_windows(spark, sf_dir)))


@query(
    "windows_block_features",
    oracle=WINDOWS.replace("FROM parsed)", "FROM parsed WHERE os = 'windows' OR format = 'winlog')")
    + REALTIME
    + "SELECT * EXCLUDE (priority_hits) FROM base JOIN shape USING (block_id)",
)
def windows_block_features(spark, sf_dir):
    return rounded(features.windows_block_features(parsed_windows(spark, sf_dir)))


@query(
    "tumbling_minute_blocks",
    oracle=cte("log_events")
    + " SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, source,"
    " event_type, count(*) AS num_events, sum(length(raw))::BIGINT AS chars"
    " FROM log_events GROUP BY ALL",
)
def tumbling_minute_blocks(spark, sf_dir):
    from emberwatch.streaming.windows import minute_blocks

    return minute_blocks(view(spark, sf_dir, "log_events"), ["source", "event_type"])

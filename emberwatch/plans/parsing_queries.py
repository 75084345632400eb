"""Queries on text functions, templates, threat flags and block ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.functions import blocks, text, threats
from emberwatch.operators import parsing
from emberwatch.plans import features_queries as FQ
from emberwatch.plans import sqltext as S
from emberwatch.plans.registry import query
from emberwatch.plans.views import cte, spread, table, view

LOG = cte("log_events")
WIN = cte("windows_events")


@query("normalize_template", oracle=FQ.PARSED + "SELECT line_id, raw, template FROM parsed")
def normalize_template(spark, sf_dir):
    return FQ.parsed(spark, sf_dir).select("line_id", "raw", "template")


@query("template_id", oracle=FQ.PARSED + "SELECT line_id, template_id FROM parsed")
def template_id(spark, sf_dir):
    return FQ.parsed(spark, sf_dir).select("line_id", "template_id")


@query("template_count", oracle=FQ.PARSED + "SELECT count(DISTINCT template_id) AS templates FROM parsed")
def template_count(spark, sf_dir):
    return parsing.template_count(FQ.parsed(spark, sf_dir))


@query(
    "windows_event_template",
    oracle=WIN + f" SELECT record_id, {S.event_template()} AS template FROM windows_events",
)
def windows_event_template(spark, sf_dir):
    return view(spark, sf_dir, "windows_events").select(
        "record_id", text.event_template("raw").alias("template")
    )


@query("level_classify", oracle=LOG + f" SELECT line_id, {S.level()} AS level FROM log_events")
def level_classify(spark, sf_dir):
    return view(spark, sf_dir, "log_events").select(
        "line_id", threats.level(F.lower("raw")).alias("level")
    )


@query(
    "threat_flags_batch",
    oracle=LOG + f" SELECT line_id, {S.flags(D.BATCH_KEYWORDS)} FROM log_events",
)
def threat_flags_batch(spark, sf_dir):
    lowered = threats.with_lowered(view(spark, sf_dir, "log_events"))
    return lowered.select("line_id", *threats.threat_flags(F.col("_lower"), D.BATCH_KEYWORDS))


@query(
    "threat_flags_realtime",
    oracle=WIN
    + f" SELECT record_id, {S.flags(D.REALTIME_KEYWORDS)} FROM windows_events",
)
def threat_flags_realtime(spark, sf_dir):
    lowered = threats.with_lowered(view(spark, sf_dir, "windows_events"))
    return lowered.select("record_id", *threats.threat_flags(F.col("_lower"), D.REALTIME_KEYWORDS))


@query(
    "first_match_category",
    oracle=LOG
    + " SELECT line_id, CASE "
    + " ".join(f"WHEN {S.any_of(w)} THEN '{c.upper()}'" for c, w in D.REALTIME_KEYWORDS.items())
    + " ELSE 'INFO' END AS category FROM log_events",
)
def first_match_category(spark, sf_dir):
    return view(spark, sf_dir, "log_events").select(
        "line_id", threats.first_category(F.lower("raw")).alias("category")
    )


TEMPLATES = ["from 10.0.", "Elevated Group"]


def _weighted(raw: str = "raw") -> str:
    import re

    terms = []
    for word, weight in D.ATTACK_WEIGHTS.items():
        hit = (
            f"contains(lower({raw}), {S.quote(word)})"
            if " " in word
            else f"regexp_matches(lower({raw}), {S.quote(chr(92) + 'b' + re.escape(word) + chr(92) + 'b')})"
        )
        terms.append(f"CASE WHEN {hit} THEN {weight}::DOUBLE ELSE 0 END")
    for phrase in TEMPLATES:
        terms.append(f"CASE WHEN contains(lower({raw}), {S.quote(phrase.lower())}) THEN 3.0::DOUBLE ELSE 0 END")
    return f"round(least({' + '.join(terms)}, 10.0::DOUBLE), 1)"


ALL_TEXT = (
    "WITH texts AS (SELECT concat('d', doc_id) AS id, text AS raw FROM documents"
    " UNION ALL SELECT concat('c', conv_id, '_', turn), text FROM conversations"
    " UNION ALL SELECT concat('p', page_id), html FROM pages)"
)


def all_text(spark, sf_dir):
    """Whole texts of documents, conversations and pages with one id column."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.col("text").alias("raw")
    )
    talk = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), F.col("turn")).alias("id"),
        F.col("text").alias("raw"),
    )
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id")).alias("id"), F.col("html").alias("raw")
    )
    return spread(docs.unionByName(talk).unionByName(pages))


WEIGHTED = (
    LOG
    + f", scored AS (SELECT line_id, {_weighted()} AS score FROM log_events)"
)


@query("weighted_keyword_score", oracle=WEIGHTED + " SELECT line_id, score FROM scored")
def weighted_keyword_score(spark, sf_dir):
    score = threats.keyword_score(F.col("raw"), templates=TEMPLATES)
    return view(spark, sf_dir, "log_events").select("line_id", score.alias("score"))


@query(
    "score_band",
    oracle=WEIGHTED
    + " SELECT line_id, CASE WHEN score >= 9 THEN 'CRITICAL' WHEN score >= 7 THEN 'HIGH'"
    " WHEN score >= 4 THEN 'MEDIUM' WHEN score > 0 THEN 'LOW' ELSE 'NONE' END AS band FROM scored",
)
def score_band(spark, sf_dir):
    return weighted_keyword_score(spark, sf_dir).select(
        "line_id", threats.score_band(F.col("score")).alias("band")
    )


@query(
    "eventid_priority_threat",
    oracle=WIN
    + f" SELECT record_id, {S.event_threat(S.event_id())} AS priority_threat FROM windows_events",
)
def eventid_priority_threat(spark, sf_dir):
    return view(spark, sf_dir, "windows_events").select(
        "record_id", blocks.priority_threat(text.event_id("raw")).alias("priority_threat")
    )


FORMAT_OF = "CASE line_id % 4 WHEN 0 THEN 'hdfs' WHEN 1 THEN 'syslog' WHEN 2 THEN 'winlog' ELSE 'generic' END"
MIXED_RAW = (
    "CASE WHEN line_id % 3 = 0 THEN concat('RecordNumber: ', line_id, ' of blk_-', line_id)"
    " WHEN line_id % 3 = 1 THEN raw ELSE 'no id at all' END"
)
MIXED = LOG + f", mixed AS (SELECT line_id, ts, source, {FORMAT_OF} AS fmt, {MIXED_RAW} AS raw FROM log_events)"
PROCESS = r"(\w+)\[(\d+)\]"
PROCESS_BLOCK = (
    f"CASE WHEN regexp_matches(raw, '{PROCESS}') THEN concat(regexp_extract(raw, '{PROCESS}', 1), '_',"
    f" regexp_extract(raw, '{PROCESS}', 2)) END"
)


def mixed(spark, sf_dir):
    return view(spark, sf_dir, "log_events").select(
        "line_id", "ts", "source", F.expr(FORMAT_OF).alias("fmt"), F.expr(MIXED_RAW).alias("raw")
    )


@query(
    "block_id_by_format",
    oracle=MIXED
    + " SELECT line_id, CASE fmt WHEN 'hdfs' THEN coalesce(nullif(regexp_extract(raw, 'blk_-?\\d+'), ''),"
    " concat('hdfs_line_', line_id))"
    f" WHEN 'syslog' THEN coalesce({PROCESS_BLOCK}, concat('syslog_', {S.MINUTE}))"
    " WHEN 'winlog' THEN CASE WHEN regexp_matches(raw, '(?i)RecordNumber[=:\\s]+(\\d+)')"
    f" THEN concat('win_', regexp_extract(raw, '(?i)RecordNumber[=:\\s]+(\\d+)', 1), '_', {S.MINUTE})"
    f" ELSE concat('win_line_', line_id) END ELSE concat('generic_', {S.MINUTE}) END AS block_id FROM mixed",
)
def block_id_by_format(spark, sf_dir):
    block = blocks.block_by_format(F.col("fmt"), F.col("raw"), F.col("line_id"), F.col("ts"))
    return mixed(spark, sf_dir).select("line_id", block.alias("block_id"))


@query(
    "block_id_syslog",
    oracle=MIXED
    + f" SELECT line_id, coalesce({PROCESS_BLOCK}, concat(source, '_', {S.MINUTE})) AS block_id FROM mixed",
)
def block_id_syslog(spark, sf_dir):
    block = blocks.block_by_process(F.col("raw"), F.col("source"), F.col("ts"))
    return mixed(spark, sf_dir).select("line_id", block.alias("block_id"))


@query(
    "block_id_windows",
    oracle=WIN
    + f" SELECT record_id, concat('win_', channel, '_', {S.MINUTE}, '_',"
    f" coalesce({S.event_threat('win_id')}, 'general')) AS block_id FROM windows_events",
)
def block_id_windows(spark, sf_dir):
    threat = blocks.priority_threat(F.col("win_id"))
    return view(spark, sf_dir, "windows_events").select(
        "record_id", blocks.block_by_channel(F.col("channel"), F.col("ts"), threat).alias("block_id")
    )


@query(
    "infer_os",
    oracle=MIXED
    + " SELECT line_id, CASE WHEN fmt = 'winlog' THEN 'windows' WHEN fmt IN ('syslog', 'hdfs')"
    " THEN 'linux' ELSE 'unknown' END AS os FROM mixed",
)
def infer_os(spark, sf_dir):
    return mixed(spark, sf_dir).select("line_id", blocks.os_of_format(F.col("fmt")).alias("os"))


@query(
    "word_count",
    oracle=ALL_TEXT + " SELECT id, len(regexp_extract_all(raw, '\\S+'))::INTEGER AS words FROM texts",
)
def word_count(spark, sf_dir):
    return all_text(spark, sf_dir).select("id", text.word_count("raw").alias("words"))


STAMPED = (
    "CASE event_id % 6 WHEN 0 THEN concat('  ', {iso}, ' spaced')"
    " WHEN 1 THEN concat({tee}, '.123 iso') WHEN 2 THEN concat({short}, ' INFO short year')"
    " WHEN 3 THEN concat({day}, ' date only') WHEN 4 THEN concat('2024-02-30 10:00:0', event_id % 10)"
    " ELSE 'no time here' END"
)
SPARK_STAMPED = STAMPED.format(
    iso="date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
    tee="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")",
    short="date_format(ts, 'yy/MM/dd HH:mm:ss')",
    day="date_format(ts, 'yyyy-MM-dd')",
)
DUCK_STAMPED = STAMPED.format(
    iso="strftime(ts, '%Y-%m-%d %H:%M:%S')",
    tee="strftime(ts, '%Y-%m-%dT%H:%M:%S')",
    short="strftime(ts, '%y/%m/%d %H:%M:%S')",
    day="strftime(ts, '%Y-%m-%d')",
)


@query(
    "parse_timestamp_multi",
    oracle=f"WITH s AS (SELECT event_id, {DUCK_STAMPED} AS raw FROM events)"
    f" SELECT event_id, strftime({S.parse_timestamp()}, '%Y-%m-%d %H:%M:%S') AS parsed FROM s",
)
def parse_timestamp_multi(spark, sf_dir):
    stamped = spread(table(spark, sf_dir, "events")).select("event_id", F.expr(SPARK_STAMPED).alias("raw"))
    return stamped.select(
        "event_id",
        F.date_format(text.parse_timestamp("raw"), "yyyy-MM-dd HH:mm:ss").alias("parsed"),
    )


@query("minute_bucket", oracle=f"SELECT event_id, {S.MINUTE} AS minute FROM events")
def minute_bucket(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.minute_bucket("ts").alias("minute"))


@query(
    "threat_label",
    oracle="SELECT event_id, CASE event_type WHEN 'error' THEN 'Brute Force' WHEN 'view' THEN 'Network'"
    " WHEN 'signup' THEN 'Privilege Esc' WHEN 'purchase' THEN 'Log Tamper'"
    " ELSE 'Suspicious Process' END AS label FROM events",
)
def threat_label(spark, sf_dir):
    category = (
        "CASE event_type WHEN 'error' THEN 'brute_force' WHEN 'view' THEN 'network'"
        " WHEN 'signup' THEN 'privilege_esc' WHEN 'purchase' THEN 'log_tamper'"
        " ELSE 'suspicious_process' END"
    )
    return table(spark, sf_dir, "events").select(
        "event_id", text.title_label(F.expr(category)).alias("label")
    )


@query("mask_tokens", oracle=ALL_TEXT + f" SELECT id, {S.mask_tokens('raw')} AS masked FROM texts")
def mask_tokens(spark, sf_dir):
    return all_text(spark, sf_dir).select("id", text.mask_tokens("raw").alias("masked"))


@query(
    "mask_email",
    oracle=cte("users")
    + " SELECT username, CASE WHEN contains(email, '@') THEN concat("
    "CASE WHEN length(split_part(email, '@', 1)) > 1 THEN substr(email, 1, 1) ELSE '' END,"
    " '***@', substr(email, strpos(email, '@') + 1)) ELSE 'your registered email' END AS masked FROM users",
)
def mask_email(spark, sf_dir):
    return view(spark, sf_dir, "users").select("username", text.mask_email("email").alias("masked"))


TIPS = {k: v["tip"] for k, v in D.CVE_BY_CATEGORY.items()}


def _tip_oracle(part: str) -> str:
    steps = (
        "list_filter(list_transform(string_split_regex(trim(tip), '\\s*\\d+\\.\\s+'),"
        " lambda s: trim(s)), lambda s: s <> '')"
    )
    return f"array_to_string({steps}[{part}], ' / ')"


@query(
    "split_tip_steps",
    oracle=cte("scored_blocks")
    + ", t AS (SELECT alert_id, concat(' ', priority, ' 1. ', "
    + S.case_of("split_part(cats, '+', 1)", TIPS, "''")
    + ") AS tip FROM scored_blocks)"
    + f" SELECT alert_id, {_tip_oracle('1:2')} AS immediate, {_tip_oracle('3:')} AS later FROM t",
)
def split_tip_steps(spark, sf_dir):
    from emberwatch.functions.lookup import lookup

    first = F.substring_index("cats", "+", 1)
    tip = F.concat(
        F.lit(" "), F.col("priority"), F.lit(" 1. "), F.coalesce(lookup(TIPS, first), F.lit(""))
    )
    tips = view(spark, sf_dir, "scored_blocks").select("alert_id", tip.alias("tip"))
    return tips.select(
        "alert_id",
        F.array_join(text.immediate_steps("tip"), " / ").alias("immediate"),
        F.array_join(text.later_steps("tip"), " / ").alias("later"),
    )

"""Queries on alerts: scoring bands, rules, cooldowns, enrichment, listing, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.functions import alerting
from emberwatch.operators import alerts, features, feedback
from emberwatch.operators.cooldown import cooldown
from emberwatch.plans import features_queries as FQ
from emberwatch.plans import sqltext as S
from emberwatch.plans.registry import query, rounded
from emberwatch.plans.views import cte, view
from emberwatch.session import session_with

SCORED = cte("scored_blocks")
HITS = ["brute_force", "privilege_esc", "dos", "log_tamper", "startup", "network"]


def scored(spark, sf_dir):
    return view(spark, sf_dir, "scored_blocks")


def alert_log(spark, sf_dir):
    """Alert table with a categories array."""
    return scored(spark, sf_dir).withColumn(
        "threat_categories", F.filter(F.split("cats", r"\+"), lambda c: c != "")
    )


# --- oracle pieces --------------------------------------------------------------------

PRIORITY = (
    "CASE WHEN anomaly_score < 0 THEN"
    " CASE WHEN priority_hits >= 3 OR anomaly_score <= -0.15 THEN 'CRITICAL'"
    " WHEN priority_hits > 0 OR anomaly_score <= -0.12 THEN 'HIGH'"
    " WHEN anomaly_score <= -0.10 THEN 'MEDIUM' ELSE 'LOW' END"
    " ELSE CASE WHEN priority_hits >= 3 OR anomaly_score <= 0.02::DOUBLE THEN 'CRITICAL'"
    " WHEN priority_hits > 0 OR anomaly_score <= 0.05::DOUBLE THEN 'HIGH'"
    " WHEN anomaly_score <= 0.08::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END END"
).replace("-0.15 ", "-0.15::DOUBLE ").replace("-0.12 ", "-0.12::DOUBLE ").replace("-0.10 ", "-0.10::DOUBLE ")
CVSS = (
    "round(greatest(0.0::DOUBLE, least(10.0::DOUBLE, round(CASE WHEN anomaly_score < 0 THEN CASE level"
    " WHEN 'CRITICAL' THEN least(10.0::DOUBLE, 9.0::DOUBLE + (abs(anomaly_score) - 0.15::DOUBLE) / 0.05::DOUBLE)"
    " WHEN 'HIGH' THEN 7.0::DOUBLE + (abs(anomaly_score) - 0.12::DOUBLE) / 0.03::DOUBLE * 2.0::DOUBLE"
    " WHEN 'MEDIUM' THEN 4.0::DOUBLE + (abs(anomaly_score) - 0.10::DOUBLE) / 0.02::DOUBLE * 3.0::DOUBLE"
    " ELSE greatest(0.1::DOUBLE, abs(anomaly_score) * 10) END ELSE CASE level"
    " WHEN 'CRITICAL' THEN least(10.0::DOUBLE, 9.0::DOUBLE + (0.02::DOUBLE - anomaly_score) / 0.02::DOUBLE)"
    " WHEN 'HIGH' THEN 7.0::DOUBLE + (0.05::DOUBLE - anomaly_score) / 0.03::DOUBLE * 2.0::DOUBLE"
    " WHEN 'MEDIUM' THEN 4.0::DOUBLE + (0.08::DOUBLE - anomaly_score) / 0.03::DOUBLE * 3.0::DOUBLE"
    " ELSE greatest(0.1::DOUBLE, (0.10::DOUBLE - anomaly_score) / 0.02::DOUBLE * 3.9::DOUBLE) END END, 1))), 1)"
)
CATEGORIES = (
    "list_filter(["
    + ", ".join(f"CASE WHEN {c}_hits > 0 THEN '{c}' END" for c in ["priority", *HITS])
    + "], lambda c: c IS NOT NULL)"
)
SIGNATURE = (
    f"concat(coalesce(nullif(array_to_string(list_sort({CATEGORIES}), '+'), ''), 'unknown'), '@',"
    " (round(anomaly_score * 100) / 100 + 0.0)::VARCHAR)"
)
RATED = SCORED + (
    f", leveled AS (SELECT * EXCLUDE (priority, cvss_score), {PRIORITY} AS level FROM scored_blocks)"
    f", rated AS (SELECT *, {CVSS} AS cvss FROM leveled)"
)


def kept_rows(source: str, key: str, micros: int, tie: str) -> str:
    """Recursive CTEs: one row per kept time and key, starting from the earliest."""
    return (
        f", slots AS (SELECT {key} AS k, epoch_us(alert_at) AS t, min({tie}) AS tie FROM {source} GROUP BY ALL)"
        ", kept AS (SELECT k, min(t) AS t FROM slots GROUP BY k"
        f" UNION ALL SELECT k, (SELECT min(s.t) FROM slots s WHERE s.k = kept.k AND s.t >= kept.t + {micros}) AS t"
        " FROM kept WHERE t IS NOT NULL)"
        ", chosen AS (SELECT s.k, s.t, s.tie FROM kept JOIN slots s USING (k, t))"
    )


# --- queries --------------------------------------------------------------------------


@query("alert_priority", oracle=RATED + " SELECT alert_id, level AS priority FROM rated")
def alert_priority(spark, sf_dir):
    level = alerting.priority(F.col("anomaly_score"), F.col("priority_hits"))
    return scored(spark, sf_dir).select("alert_id", level.alias("priority"))


@query("alert_cvss", oracle=RATED + " SELECT alert_id, cvss AS cvss_score FROM rated")
def alert_cvss(spark, sf_dir):
    return alerts.with_priority(scored(spark, sf_dir)).select("alert_id", "cvss_score")


@query("alert_signature", oracle=SCORED + f" SELECT alert_id, {SIGNATURE} AS signature FROM scored_blocks")
def alert_signature(spark, sf_dir):
    rows = scored(spark, sf_dir)
    hits = ["priority_hits", *[f"{c}_hits" for c in HITS]]
    return rows.select(
        "alert_id",
        alerting.signature(alerting.categories(hits), F.col("anomaly_score")).alias("signature"),
    )


@query(
    "threat_categories_array",
    oracle=SCORED
    + f" SELECT alert_id, array_to_string({CATEGORIES}, ',') AS categories, len({CATEGORIES})::INTEGER AS n"
    " FROM scored_blocks",
)
def threat_categories_array(spark, sf_dir):
    found = alerting.categories(["priority_hits", *[f"{c}_hits" for c in HITS]])
    return scored(spark, sf_dir).select(
        "alert_id", F.array_join(found, ",").alias("categories"), F.size(found).alias("n")
    )


LATEST_LABELS = (
    ", latest AS (SELECT block_id, arg_max(label, (labelled_at, seq)) AS label,"
    " arg_max(note, (labelled_at, seq)) AS note FROM label_log"
    f" WHERE label IN ({', '.join(S.quote(n) for n in D.ANALYST_LABELS)})"
    " GROUP BY block_id)"
)
LABELLED = cte("scored_blocks", "label_log") + LATEST_LABELS


def latest_labels(spark, sf_dir):
    return feedback.latest_label(feedback.valid_labels(view(spark, sf_dir, "label_log")))


@query(
    "alert_filter",
    oracle=LABELLED
    + " SELECT a.alert_id, l.label FROM scored_blocks a LEFT JOIN latest l USING (block_id)"
    " WHERE a.priority = 'HIGH' AND contains(concat('+', a.cats, '+'), '+brute_force+')"
    " AND l.label IS NOT NULL AND a.source_machine = 'Host3'",
)
def alert_filter(spark, sf_dir):
    joined = alerts.with_labels(alert_log(spark, sf_dir), latest_labels(spark, sf_dir))
    out = alerts.alert_filter(joined, "HIGH", "brute_force", "labelled", "Host3")
    return out.select("alert_id", "label")


@query(
    "event_filter",
    oracle=cte("log_events")
    + " SELECT line_id, source, source_machine FROM log_events WHERE source = 'svc3' AND source_machine = 'host2'",
)
def event_filter(spark, sf_dir):
    return alerts.event_filter(view(spark, sf_dir, "log_events"), "svc3", "host2").select(
        "line_id", "source", "source_machine"
    )


@query(
    "scope_by_machine",
    oracle=cte("log_events", "users")
    + " SELECT u.username, count(*) AS visible, max(e.line_id) AS last_line FROM log_events e"
    " JOIN users u ON lower(trim(e.source_machine)) = lower(trim(u.source_machine))"
    " WHERE u.role <> 'admin' GROUP BY u.username"
    " UNION ALL SELECT u.username, t.visible, t.last_line FROM users u,"
    " (SELECT count(*) AS visible, max(line_id) AS last_line FROM log_events) t WHERE u.role = 'admin'",
)
def scope_by_machine(spark, sf_dir):
    users = view(spark, sf_dir, "users")
    admin = F.col("role") == "admin"
    events = view(spark, sf_dir, "log_events").select("source_machine", "line_id")
    # combine per machine first: the pairing then multiplies summaries, not events
    per_machine = events.groupBy("source_machine").agg(
        F.count(F.lit(1)).alias("n"), F.max("line_id").alias("last")
    )
    paired = (
        alerts.scope_by_user(per_machine, users.filter(~admin))
        .groupBy("username")
        .agg(F.sum("n").alias("visible"), F.max("last").alias("last_line"))
    )
    # an admin sees every row: one row of totals stands for them all
    everything = alerts.scope_by_machine(per_machine, "admin", None)
    totals = everything.agg(F.struct(F.sum("n").alias("n"), F.max("last").alias("last")).alias("t")).scalar()
    full = users.filter(admin).select("username", totals.alias("_t"))
    return paired.unionByName(full.select("username", F.col("_t.n").alias("visible"), F.col("_t.last").alias("last_line")))


@query(
    "min_priority_gate",
    oracle=SCORED
    + " SELECT alert_id, priority, (priority IN ('CRITICAL'))::INTEGER AS email FROM scored_blocks"
    " WHERE priority IN ('CRITICAL', 'HIGH', 'MEDIUM')",
)
def min_priority_gate(spark, sf_dir):
    level = F.col("priority")
    return (
        scored(spark, sf_dir)
        .filter(alerting.at_least(level, "MEDIUM"))
        .select("alert_id", "priority", alerting.at_least(level, "CRITICAL", 3).cast("int").alias("email"))
    )


REPAIR = (
    "CASE WHEN cvss_score >= CASE priority WHEN 'CRITICAL' THEN 9.0 WHEN 'HIGH' THEN 7.0"
    " WHEN 'MEDIUM' THEN 4.0 ELSE 0.0 END THEN cvss_score ELSE CASE priority WHEN 'CRITICAL' THEN 9.5"
    " WHEN 'HIGH' THEN 7.5 WHEN 'MEDIUM' THEN 5.0 ELSE 2.0 END END::DOUBLE"
)


@query("cvss_repair", oracle=SCORED + f" SELECT alert_id, {REPAIR} AS cvss FROM scored_blocks")
def cvss_repair(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "alert_id", alerting.repaired_cvss(F.col("priority"), F.col("cvss_score")).alias("cvss")
    )


@query(
    "alerts_left_join_labels",
    oracle=LABELLED
    + " SELECT a.alert_id, a.block_id, l.label, coalesce(l.note, '') AS note"
    " FROM scored_blocks a LEFT JOIN latest l USING (block_id)",
)
def alerts_left_join_labels(spark, sf_dir):
    joined = alerts.with_labels(scored(spark, sf_dir), latest_labels(spark, sf_dir))
    return joined.select("alert_id", "block_id", "label", "note")


FIRST_KNOWN = (
    "(list_filter(string_split(cats, '+'), lambda c: c IN ("
    + ", ".join(S.quote(c) for c in D.CVE_BY_CATEGORY)
    + ")))[1]"
)
CVE_FIELDS = {"name": "vulnerability_name", "cwe": "cwe", "cve_ids": "cve_ids", "tip": "remediation_tip"}


def cve_columns(event: str | None = None) -> str:
    out = []
    for field, alias in CVE_FIELDS.items():
        generic = S.quote("" if field == "cve_ids" else D.CVE_GENERIC[field])
        parts = [S.cve_case(FIRST_KNOWN, D.CVE_BY_CATEGORY, field), generic]
        if event:
            parts.insert(0, S.cve_case(event, D.CVE_BY_EVENT, field))
        out.append(f"coalesce({', '.join(parts)}) AS {alias}")
    return ", ".join(out)


def enriched(df):
    return df.select(
        "alert_id",
        "vulnerability_name",
        "cwe",
        F.array_join("cve_ids", ",").alias("cve_ids"),
        "remediation_tip",
    )


@query("cve_enrich_category", oracle=SCORED + f" SELECT alert_id, {cve_columns()} FROM scored_blocks")
def cve_enrich_category(spark, sf_dir):
    return enriched(alerts.enrich(alert_log(spark, sf_dir)))


EVENT_OF = "CASE WHEN alert_id % 3 = 0 THEN 4625 WHEN alert_id % 3 = 1 THEN 1102 ELSE 4624 END"


@query("cve_enrich_eventid", oracle=SCORED + f" SELECT alert_id, {cve_columns(EVENT_OF)} FROM scored_blocks")
def cve_enrich_eventid(spark, sf_dir):
    return enriched(alerts.enrich(alert_log(spark, sf_dir), F.expr(EVENT_OF).cast("bigint")))


@query(
    "route_recipients",
    oracle=cte("scored_blocks", "users")
    + " SELECT coalesce(u.email, 'soc@example.com') AS recipient, count(*) AS alerts,"
    " max(a.alert_id) AS last_alert FROM scored_blocks a LEFT JOIN"
    " (SELECT * FROM users WHERE email <> '') u"
    " ON lower(trim(a.source_machine)) = lower(trim(u.source_machine)) GROUP BY ALL",
)
def route_recipients(spark, sf_dir):
    users = view(spark, sf_dir, "users")
    slim = scored(spark, sf_dir).groupBy("source_machine").agg(
        F.count(F.lit(1)).alias("n"), F.max("alert_id").alias("last")
    )
    routed = alerts.route_recipients(slim, users, "soc@example.com")
    return routed.groupBy("recipient").agg(
        F.sum("n").alias("alerts"), F.max("last").alias("last_alert")
    )


# A written file names each list of addresses once, and by number in its rows, as long as all its lists fit in
# this many bytes; beyond Parquet's usual 1 MB every row takes its machine's whole list to disk.  The least and
# greatest list are not kept for values over 4 kB, yet are looked for in every row.  Alerts are small before the
# join and long after it, so their partitions are not put together up to the usual 1 MB.
LISTS = {
    "parquet.dictionary.page.size": 128 << 20,
    "parquet.column.statistics.enabled#recipients": "false",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1",
}


@query(
    "alert_recipients",
    oracle=cte("scored_blocks", "users")
    + ", paired AS (SELECT lower(trim(source_machine)) AS machine, array_to_string(list_sort(list(DISTINCT email)), ',') AS emails"
    " FROM users WHERE email <> '' GROUP BY 1)"
    " SELECT a.alert_id, coalesce(p.emails, 'soc@example.com') AS recipients FROM scored_blocks a"
    " LEFT JOIN paired p ON lower(trim(a.source_machine)) = p.machine",
)
def alert_recipients(spark, sf_dir):
    """Every alert with the addresses it goes to."""
    session = session_with(spark, LISTS)
    users = view(session, sf_dir, "users")
    return alerts.with_recipients(scored(session, sf_dir), users, "soc@example.com", ",").select("alert_id", "recipients")


@query(
    "scope_paired_machine",
    oracle=cte("log_events", "users")
    + " SELECT line_id, source, source_machine, raw FROM log_events WHERE source_machine ="
    " (SELECT lower(trim(source_machine)) FROM users WHERE role <> 'admin' AND email <> '' ORDER BY username LIMIT 1)",
)
def scope_paired_machine(spark, sf_dir):
    """The events that the first paired user of the directory may see."""
    users = view(spark, sf_dir, "users").filter((F.col("role") != "admin") & (F.col("email") != ""))
    caller = users.orderBy("username").select(F.trim("source_machine").alias("machine")).first()
    events = view(spark, sf_dir, "log_events").select("line_id", "source", "source_machine", "raw")
    return alerts.scope_by_machine(events, "user", caller and caller["machine"])


@query(
    "recent_alerts",
    oracle=SCORED
    + " SELECT alert_id, priority FROM (SELECT * FROM scored_blocks ORDER BY alert_id DESC LIMIT 500)"
    " WHERE priority = 'HIGH'",
)
def recent_alerts(spark, sf_dir):
    newest = alerts.newest(scored(spark, sf_dir), "alert_id", 500)
    return newest.filter(F.col("priority") == "HIGH").select("alert_id", "priority")


@query(
    "recent_events",
    oracle=cte("log_events")
    + " SELECT line_id, source FROM (SELECT * FROM log_events ORDER BY line_id DESC LIMIT 2000)"
    " WHERE source = 'svc3' AND source_machine = 'host2'",
)
def recent_events(spark, sf_dir):
    events = view(spark, sf_dir, "log_events")
    return alerts.event_view(events, "line_id", 2000, "svc3", "host2").select("line_id", "source")


@query(
    "slice_first_n",
    oracle=SCORED
    + ", c AS (SELECT alert_id, string_split(coalesce("
    + S.cve_case(FIRST_KNOWN, D.CVE_BY_CATEGORY, "cve_ids")
    + ", ''), ',') AS ids FROM scored_blocks)"
    " SELECT alert_id, array_to_string(ids[1:2], ',') AS first_ids FROM c",
)
def slice_first_n(spark, sf_dir):
    full = alerts.enrich(alert_log(spark, sf_dir))
    return full.select("alert_id", F.array_join(F.slice("cve_ids", 1, 2), ",").alias("first_ids"))


@query(
    "union_sources",
    oracle=cte("log_events", "windows_events")
    + " SELECT raw, source, NULL AS os, source_machine, line_id FROM log_events"
    " UNION ALL SELECT raw, NULL, os, source_machine, record_id FROM windows_events",
)
def union_sources(spark, sf_dir):
    linux = view(spark, sf_dir, "log_events").select("raw", "source", "source_machine", "line_id")
    win = view(spark, sf_dir, "windows_events").select(
        "raw", "os", "source_machine", F.col("record_id").alias("line_id")
    )
    return alerts.union_sources(linux, win)


@query("alert_count", oracle=SCORED + " SELECT count(*) AS alerts FROM scored_blocks")
def alert_count(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.count(F.lit(1)).alias("alerts"))


@query(
    "distinct_machines",
    oracle=SCORED
    + " SELECT DISTINCT source_machine FROM (SELECT * FROM scored_blocks ORDER BY alert_id DESC LIMIT 2000)"
    " WHERE source_machine <> ''",
)
def distinct_machines(spark, sf_dir):
    return alerts.distinct_machines(scored(spark, sf_dir), "alert_id")


# --- rules ----------------------------------------------------------------------------

RULE_ALERTS = (
    cte("log_events")
    + f", flagged AS (SELECT *, {S.flags(D.REALTIME_KEYWORDS)} FROM log_events)"
    + ", blocks AS (SELECT block_id, arg_min(source_machine, line_id) AS source_machine, max(ts) AS alert_at,"
    + f" count(*) AS num_events, {S.hits(D.REALTIME_KEYWORDS)} FROM flagged GROUP BY block_id)"
    + ", fired AS ("
    + " UNION ALL ".join(
        f"SELECT block_id, source_machine, alert_at, num_events, '{c}' AS category, '{p}' AS priority,"
        f" {c}_hits AS hits FROM blocks WHERE {c}_hits >= {n}"
        for c, p, n in D.RULES
    )
    + ")"
)
RULE_COLUMNS = (
    "strftime(alert_at, '%Y-%m-%d %H:%M:%S') AS alert_at, block_id, source_machine, num_events, priority, category,"
    " CASE priority WHEN 'CRITICAL' THEN 9.5 WHEN 'HIGH' THEN 7.5 WHEN 'MEDIUM' THEN 5.0 ELSE 2.0 END::DOUBLE AS cvss_score,"
    f" {S.cve_case('category', D.CVE_BY_CATEGORY, 'cwe')} AS cwe,"
    f" concat(priority, ' — ', {S.cve_case('category', D.CVE_BY_CATEGORY, 'name')}, ' (', hits, ' indicator(s))') AS description"
)


def flat_rules(df):
    return df.select(
        F.date_format("alert_at", "yyyy-MM-dd HH:mm:ss").alias("alert_at"),
        "block_id",
        "source_machine",
        "num_events",
        "priority",
        F.element_at("threat_categories", 1).alias("category"),
        "cvss_score",
        "cwe",
        "description",
    )


@query("rule_alerts", oracle=RULE_ALERTS + f" SELECT {RULE_COLUMNS} FROM fired")
def rule_alerts(spark, sf_dir):
    return flat_rules(alerts.rule_alerts(view(spark, sf_dir, "log_events")))


@query(
    "rule_dedup",
    oracle=RULE_ALERTS.replace("max(ts) AS alert_at", "max(ts) AS alert_at, date_trunc('day', ts) AS d").replace(
        "GROUP BY block_id)", "GROUP BY block_id, d)"
    )
    + ", first AS (SELECT block_id, category, min(alert_at) AS alert_at FROM fired GROUP BY ALL)"
    f" SELECT {RULE_COLUMNS} FROM fired JOIN first USING (block_id, category, alert_at)",
)
def rule_dedup(spark, sf_dir):
    """Alerts of daily blocks, where the same block and category would fire every day."""
    events = view(spark, sf_dir, "log_events")
    name = F.col("block_id")
    daily = events.withColumn("block_id", F.concat_ws("|", name, F.date_format("ts", "yyyyMMdd")))
    fired = alerts.rule_alerts(daily).withColumn("block_id", F.substring_index("block_id", "|", 1))
    return flat_rules(alerts.dedup_rules(fired))


# --- cooldowns ------------------------------------------------------------------------

MODEL_ALERTS = (
    RATED
    + f", anomalies AS (SELECT *, {SIGNATURE} AS signature FROM rated WHERE anomaly_score < 0.1::DOUBLE)"
)
MODEL_ALERTS = MODEL_ALERTS.replace("WITH ", "WITH RECURSIVE ", 1)
FIRST_KNOWN_NAME = S.cve_case(
    "list_filter([" + ", ".join(f"CASE WHEN {c}_hits > 0 THEN '{c}' END" for c in HITS if c in D.CVE_BY_CATEGORY)
    + "], lambda c: c IS NOT NULL)[1]",
    D.CVE_BY_CATEGORY,
    "name",
)
MODEL_KEPT = kept_rows("anomalies", "signature", 3600 * 1_000_000, "alert_id")


@query(
    "model_alerts",
    oracle=MODEL_ALERTS
    + MODEL_KEPT
    + " SELECT epoch_us(a.alert_at) AS alert_us, a.block_id, a.source_machine,"
    " round(a.anomaly_score, 6) AS anomaly_score, a.cvss AS cvss_score, a.num_events, a.error_count,"
    f" array_to_string({CATEGORIES}, ',') AS categories, a.level AS priority,"
    f" concat(a.level, ' — ', coalesce({FIRST_KNOWN_NAME}, {S.quote(D.CVE_GENERIC['name'])}), ' | score ',"
    " printf('%.4f', round(a.anomaly_score, 6))) AS description"
    " FROM anomalies a JOIN chosen c ON a.signature = c.k AND a.alert_id = c.tie",
)
def model_alerts(spark, sf_dir):
    rows = scored(spark, sf_dir).drop("priority", "cvss_score", "cats")
    out = alerts.model_alerts(rows, seconds=3600, tie="alert_id")
    return out.select(
        F.unix_micros("alert_at").alias("alert_us"),
        "block_id",
        "source_machine",
        "anomaly_score",
        "cvss_score",
        "num_events",
        "error_count",
        F.array_join("threat_categories", ",").alias("categories"),
        "priority",
        "description",
    )


EVENTS_ALERTS = "WITH RECURSIVE a AS (SELECT event_type, event_id, user_id, ts AS alert_at FROM events)"


@query(
    "alert_cooldown",
    oracle=EVENTS_ALERTS
    + kept_rows("a", "event_type", 1800 * 1_000_000, "event_id")
    + " SELECT k AS event_type, tie AS event_id, t AS alert_us FROM chosen",
)
def alert_cooldown(spark, sf_dir):
    from emberwatch.plans.views import table

    events = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    out = cooldown(events, "event_type", "ts", 1800, "event_id")
    return out.select("event_type", "event_id", F.unix_micros("ts").alias("alert_us"))


@query(
    "notify_cooldown",
    oracle=SCORED.replace("WITH ", "WITH RECURSIVE ", 1)
    + kept_rows("scored_blocks", "block_id", 21600 * 1_000_000, "alert_id")
    + " SELECT k AS block_id, tie AS alert_id FROM chosen",
)
def notify_cooldown(spark, sf_dir):
    out = cooldown(scored(spark, sf_dir), "block_id", "alert_at", 21600, "alert_id")
    return out.select("block_id", "alert_id")


@query(
    "dispatch_plan",
    oracle=SCORED.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", gated AS (SELECT * FROM scored_blocks WHERE priority IN ('CRITICAL', 'HIGH', 'MEDIUM'))"
    + kept_rows("gated", "block_id", 21600 * 1_000_000, "alert_id")
    + " SELECT g.block_id, g.source_machine AS machine, g.priority, epoch_us(g.alert_at) AS sent_us,"
    + f" {REPAIR.replace('cvss_score', 'g.cvss_score')} AS cvss_score,"
    + " CASE WHEN g.priority = 'MEDIUM' THEN 'desktop,sound' ELSE 'desktop,sound,email' END AS channels"
    + " FROM gated g JOIN chosen c ON g.block_id = c.k AND g.alert_id = c.tie",
)
def dispatch_plan(spark, sf_dir):
    plan = alerts.dispatch_plan(alert_log(spark, sf_dir), "alert_id", min_priority="MEDIUM", seconds=21600)
    return plan.select(
        "block_id",
        "machine",
        "priority",
        F.unix_micros("sent_at").alias("sent_us"),
        "cvss_score",
        F.array_join("channels_used", ",").alias("channels"),
    )


@query(
    "union_alerts",
    oracle=RULE_ALERTS
    + SCORED.replace("WITH ", ", ", 1)
    + " SELECT block_id, category AS cats, priority, 1 AS rule_based, "
    + S.cve_case("category", D.CVE_BY_CATEGORY, "cwe")
    + " AS cwe FROM fired UNION ALL SELECT block_id, cats, priority, 0, NULL FROM scored_blocks",
)
def union_alerts(spark, sf_dir):
    rule = alerts.rule_alerts(view(spark, sf_dir, "log_events"))
    model = alert_log(spark, sf_dir).select("alert_at", "block_id", "priority", "threat_categories")
    return alerts.union_alerts(rule, model).select(
        "block_id",
        F.array_join("threat_categories", "+").alias("cats"),
        "priority",
        F.col("rule_based").cast("int").alias("rule_based"),
        "cwe",
    )


@query(
    "alert_view",
    oracle=LABELLED
    + f", v AS (SELECT a.alert_id, a.cats, a.priority, l.label, coalesce(l.note, '') AS note"
    " FROM (SELECT * FROM scored_blocks ORDER BY alert_id DESC LIMIT 1000) a LEFT JOIN latest l USING (block_id))"
    f" SELECT alert_id, priority, label, note, {cve_columns()} FROM v"
    " WHERE contains(concat('+', cats, '+'), '+log_tamper+') AND label IS NOT NULL",
)
def alert_view(spark, sf_dir):
    out = alerts.alert_view(
        alert_log(spark, sf_dir),
        latest_labels(spark, sf_dir),
        "alert_id",
        limit=1000,
        threat="log_tamper",
        labelled="labelled",
    )
    return out.select(
        "alert_id", "priority", "label", "note", "vulnerability_name", "cwe",
        F.array_join("cve_ids", ",").alias("cve_ids"), "remediation_tip",
    )

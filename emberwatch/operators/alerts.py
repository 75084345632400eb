"""Rule alerts, model alerts, enrichment, listing, routing and dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.functions import alerting, threats
from emberwatch.functions.lookup import literal_map
from emberwatch.operators.cooldown import cooldown

RULE_COOLDOWN_SEC = 60
NOTIFY_COOLDOWN_SEC = 60
ANOMALY_THRESHOLD = 0.10


def rule_alerts(
    df: DataFrame, keywords: dict = D.REALTIME_KEYWORDS, rules=D.RULES, at: Column | None = None
) -> DataFrame:
    """One alert per block and category whose hits reach the rule's minimum.

    ``at`` is the alert time; the default is the block's last event time.
    """
    flagged = threats.with_lowered(df).select(
        "block_id",
        "source_machine",
        "line_id",
        "ts",
        *threats.threat_flags(F.col("_lower"), keywords, "_hits"),
    )
    names = [r[0] for r in rules]
    # per machine first, with numeric buffers only, so that events are hashed and not sorted; the
    # first machine is that of the lowest line id, or of the earliest event without line ids
    machines = flagged.groupBy("block_id", "source_machine").agg(
        F.min("line_id").alias("line_id"),
        F.min("ts").alias("first_at"),
        F.max("ts").alias("last_at"),
        F.count(F.lit(1)).alias("num_events"),
        *[F.sum(f"{c}_hits").alias(c) for c in names],
    )
    blocks = machines.groupBy("block_id").agg(
        F.min(F.struct(F.col("line_id").isNull(), "line_id", "first_at", "source_machine")).alias("origin"),
        F.max("last_at").alias("last_at"),
        F.sum("num_events").alias("num_events"),
        *[F.sum(c).alias(c) for c in names],
    )
    needed = literal_map({c: n for c, _, n in rules}, value_type="int")
    hits = blocks.unpivot(
        ["block_id", "origin", "last_at", "num_events"], names, "category", "hits"
    )
    fired = hits.filter(F.col("hits") >= F.element_at(needed, F.col("category")))
    return alerts_of_rules(fired.withColumn("source_machine", F.col("origin.source_machine")), rules, at)


def alerts_of_rules(fired: DataFrame, rules=D.RULES, at: Column | None = None) -> DataFrame:
    """Alerts of blocks and categories whose hits reached the rule's minimum.

    ``fired``: block_id, source_machine, last_at, num_events, category, hits.
    """
    level = literal_map({c: p for c, p, _ in rules})
    fired = fired.withColumn("priority", F.element_at(level, F.col("category")))
    cve = alerting.cve_for_category(F.array("category"))
    info = fired.withColumn("_cve", F.coalesce(cve, alerting.cve_struct(D.CVE_GENERIC)))
    return info.select(
        (F.col("last_at") if at is None else at).alias("alert_at"),
        "block_id",
        F.coalesce(F.col("source_machine"), F.lit("unknown")).alias("source_machine"),
        F.lit(0.0).alias("anomaly_score"),
        alerting.default_cvss(F.col("priority")).alias("cvss_score"),
        "num_events",
        F.lit(0).cast("bigint").alias("error_count"),
        F.array("category").alias("threat_categories"),
        "priority",
        F.lit(True).alias("rule_based"),
        *cve_columns("_cve"),
        F.format_string(
            "%s — %s (%d indicator(s))", F.col("priority"), F.col("_cve.name"), F.col("hits")
        ).alias("description"),
    )


def cve_columns(struct: str) -> list[Column]:
    return [
        F.col(f"{struct}.cve_ids").alias("cve_ids"),
        F.col(f"{struct}.cwe").alias("cwe"),
        F.col(f"{struct}.name").alias("vulnerability_name"),
        F.col(f"{struct}.description").alias("vulnerability_desc"),
        F.col(f"{struct}.tip").alias("remediation_tip"),
    ]


def dedup_rules(alerts: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """A (block, category) pair fires once, ever; the earliest alert is kept.

    ``seen`` (block_id, category) lists the pairs that fired before.
    """
    keyed = alerts.withColumn("category", F.element_at("threat_categories", 1))
    row = F.struct(*alerts.columns)
    first = keyed.groupBy("block_id", "category").agg(
        F.min_by(row, F.struct("alert_at", "num_events", "source_machine")).alias("_row")
    )
    if seen is not None:
        first = first.join(seen, ["block_id", "category"], "left_anti")
    return first.select("_row.*")


def with_priority(scored: DataFrame, scale: str = "auto") -> DataFrame:
    score = F.col("anomaly_score")
    out = scored.withColumn("priority", alerting.priority(score, F.col("priority_hits"), scale))
    return out.withColumn("cvss_score", alerting.cvss(score, F.col("priority"), scale))


def model_alerts(
    scored: DataFrame,
    threshold: float = ANOMALY_THRESHOLD,
    seconds: float = RULE_COOLDOWN_SEC,
    scale: str = "auto",
    at: str = "alert_at",
    tie: str = "block_id",
    seed: DataFrame | None = None,
) -> DataFrame:
    """Scored blocks → prioritised, de-duplicated alerts."""
    return alerts_of_model(cooldown(signed(scored, threshold, scale), "signature", at, seconds, tie, seed), at)


def signed(scored: DataFrame, threshold: float = ANOMALY_THRESHOLD, scale: str = "auto") -> DataFrame:
    """Anomalous blocks with priority and signature, before any cooldown."""
    hits = [c for c in scored.columns if c.endswith("_hits")]
    named = with_priority(scored.filter(F.col("anomaly_score") < threshold), scale)
    return named.withColumn("_signature_cats", alerting.categories(hits)).withColumn(
        "signature", alerting.signature(F.col("_signature_cats"), F.col("anomaly_score"))
    )


def alerts_of_model(kept: DataFrame, at: str = "alert_at") -> DataFrame:
    """Alert columns of signed blocks; the description names the first known category's vulnerability."""
    named = alerting.cve_info(F.col("_signature_cats"))["name"]
    return kept.select(
        F.col(at).alias("alert_at"),
        "block_id",
        "source_machine",
        F.round("anomaly_score", 6).alias("anomaly_score"),
        "cvss_score",
        F.col("num_events").cast("bigint").alias("num_events"),
        F.col("error_count").cast("bigint").alias("error_count"),
        F.col("_signature_cats").alias("threat_categories"),
        "priority",
        "signature",
        F.format_string(
            "%s — %s | score %.4f", F.col("priority"), named, F.round("anomaly_score", 6)
        ).alias("description"),
    )


def union_alerts(rule: DataFrame, model: DataFrame) -> DataFrame:
    return rule.unionByName(model, allowMissingColumns=True).withColumn(
        "rule_based", F.coalesce("rule_based", F.lit(False))
    )


def enrich(alerts: DataFrame, event: Column | None = None) -> DataFrame:
    """Add vulnerability columns where the alert does not carry them yet."""
    work = alerts.withColumn("_cve", alerting.cve_info(F.col("threat_categories"), event))
    stored = "vulnerability_name" in alerts.columns
    missing = F.coalesce(F.col("vulnerability_name"), F.lit("")) == "" if stored else F.lit(True)
    names = ["cve_ids", "cwe", "vulnerability_name", "vulnerability_desc", "remediation_tip"]
    for name, fresh in zip(names, cve_columns("_cve")):
        old = F.col(name) if name in alerts.columns else F.lit(None)
        work = work.withColumn(f"_{name}", F.when(missing, fresh).otherwise(old))
    return work.drop("_cve", *names).withColumnsRenamed({f"_{n}": n for n in names})


def with_labels(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join of the latest analyst label; absent note becomes empty."""
    return alerts.join(
        labels.select("block_id", "label", F.col("note").alias("_note")), "block_id", "left"
    ).withColumn("note", F.coalesce("_note", F.lit(""))).drop("_note")


def alert_filter(
    alerts: DataFrame,
    priority: str = "all",
    threat: str = "",
    labelled: str = "all",
    machine: str = "",
) -> DataFrame:
    if priority != "all":
        alerts = alerts.filter(F.col("priority") == priority)
    if threat:
        alerts = alerts.filter(F.array_contains("threat_categories", threat))
    if labelled == "labelled":
        alerts = alerts.filter(F.col("label").isNotNull())
    elif labelled == "unlabelled":
        alerts = alerts.filter(F.col("label").isNull())
    if machine:
        alerts = alerts.filter(F.col("source_machine") == machine)
    return alerts


def event_filter(events: DataFrame, source: str = "", machine: str = "") -> DataFrame:
    if source:
        events = events.filter(F.col("source") == source)
    if machine:
        events = events.filter(F.col("source_machine") == machine)
    return events


def newest(log: DataFrame, order: str, n: int) -> DataFrame:
    """Last ``n`` rows of an append log, newest first (a top-k, not a full sort)."""
    return log.orderBy(F.col(order).desc()).limit(n)


def alert_view(
    alerts: DataFrame, labels: DataFrame, order: str, limit: int = 100, filter_first: bool = False, **filters
) -> DataFrame:
    """Alert listing: newest ``limit`` alerts, labelled, enriched, then filtered."""
    if filter_first:
        # label filters need the join before the limit
        joined = alert_filter(with_labels(alerts, labels), **filters)
        return enrich(newest(joined, order, limit))
    recent = newest(alerts, order, limit)
    return alert_filter(enrich(with_labels(recent, labels)), **filters).orderBy(F.col(order).desc())


def event_view(
    events: DataFrame, order: str, limit: int = 200, source: str = "", machine: str = ""
) -> DataFrame:
    """Event listing: newest ``limit`` events, then filtered."""
    return event_filter(newest(events, order, limit), source, machine).orderBy(F.col(order).desc())


def scope_by_machine(rows: DataFrame, role: str, machine: str | None) -> DataFrame:
    """Rows a caller may see: all for an admin, else those of the paired machine."""
    if role == "admin":
        return rows
    if not machine:
        return rows.filter(F.lit(False))
    return rows.filter(F.col("source_machine") == machine.lower())


def scope_by_user(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Every user's visible rows: (username, row) pairs by paired machine.

    Both sides are shuffled on the machine unless the directory is small enough for
    Spark to broadcast it on its own; skewed machines are split at run time.
    """
    paired = users.select(
        "username", F.lower(F.trim("source_machine")).alias("_machine")
    ).filter(F.col("_machine") != "")
    return rows.withColumn("_machine", F.lower(F.trim("source_machine"))).join(paired, "_machine").drop("_machine")


def route_recipients(alerts: DataFrame, users: DataFrame, fallback: str) -> DataFrame:
    """One row per alert and recipient; the fallback address when nobody is paired."""
    paired = users.filter(F.coalesce(F.col("email"), F.lit("")) != "").select(
        F.lower(F.trim("source_machine")).alias("_machine"), F.col("email").alias("_email")
    )
    return (
        alerts.withColumn("_machine", F.lower(F.trim("source_machine")))
        .join(paired, "_machine", "left")
        .withColumn("recipient", F.coalesce("_email", F.lit(fallback)))
        .drop("_machine", "_email")
    )


def with_recipients(alerts: DataFrame, users: DataFrame, fallback: str, separator: str | None = None) -> DataFrame:
    """One row per alert with its ``recipients`` in order; the fallback address when nobody is paired.

    The directory is folded to a row per machine first, so alerts are neither multiplied nor grouped; an
    address that is entered twice for a machine gets one copy.  With ``separator`` recipients are one text,
    joined once per machine.
    """
    emails, nobody = F.sort_array(F.collect_set("email")), F.array(F.lit(fallback))
    if separator is not None:
        emails, nobody = F.array_join(emails, separator), F.lit(fallback)
    paired = (
        users.filter(F.coalesce(F.col("email"), F.lit("")) != "")
        .groupBy(F.lower(F.trim("source_machine")).alias("_machine"))
        .agg(emails.alias("_emails"))
    )
    return (
        alerts.withColumn("_machine", F.lower(F.trim("source_machine")))
        .join(paired, "_machine", "left")
        .withColumn("recipients", F.coalesce("_emails", nobody))
        .drop("_machine", "_emails")
    )


def dispatch_plan(
    alerts: DataFrame,
    order: str,
    min_priority: str = "HIGH",
    email_min_priority: str = "HIGH",
    sound: bool = True,
    email: bool = True,
    seconds: float = NOTIFY_COOLDOWN_SEC,
    seed: DataFrame | None = None,
) -> DataFrame:
    """Notifications to send: gate, cooldown per block, channels, audit columns."""
    level = F.col("priority")
    gated = alerts.filter(alerting.at_least(level, min_priority))
    kept = cooldown(gated, F.coalesce("block_id", F.lit("unknown")), "alert_at", seconds, order, seed)
    channels = F.array_except(
        F.array(
            F.lit("desktop"),
            F.lit("sound") if sound else F.lit(None).cast("string"),
            F.when(F.lit(email) & alerting.at_least(level, email_min_priority, 3), F.lit("email")),
        ),
        F.array(F.lit(None).cast("string")),
    )
    return kept.select(
        F.col("alert_at").alias("notified_at"),
        F.col("alert_at").alias("sent_at"),
        "block_id",
        F.coalesce("source_machine", F.lit("")).alias("machine"),
        "priority",
        "threat_categories",
        "anomaly_score",
        alerting.repaired_cvss(level, F.col("cvss_score")).alias("cvss_score"),
        channels.alias("channels_used"),
    )


def cooldown_seed(log: DataFrame, key: str = "block_id", at: str = "sent_at") -> DataFrame:
    """Cooldown state from a notification log: last time per key."""
    sent = log.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    return sent.groupBy(F.col(key).alias("key")).agg(F.max(at).alias("last_at"))


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def distinct_machines(alerts: DataFrame, order: str, last: int = 2000) -> DataFrame:
    return (
        newest(alerts, order, last)
        .filter(F.coalesce("source_machine", F.lit("")) != "")
        .select("source_machine")
        .distinct()
        .orderBy("source_machine")
    )

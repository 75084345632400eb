"""Declared schemas of the tables that enter and leave the library."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def struct(columns: str) -> T.StructType:
    """'name type, …' → schema; needs no running session."""
    pairs = (part.split() for part in columns.split(","))
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


STAGED_EVENT = struct(
    "raw string, block_id string, source string, os string, format string, "
    "line_id bigint, collected_at timestamp"
)
COLLECTED_EVENT = struct(
    "raw string, block_id string, source string, source_machine string, os string, "
    "collected_at timestamp, template_id string, line_id bigint, event_id bigint, "
    "priority_threat string"
)
AGENT_PAYLOAD = T.ArrayType(struct("log string, source string"))
PARSED_EVENT = struct(
    "template_id bigint, template string, raw string, block_id string, source string, "
    "os string, line_id bigint, collected_at timestamp"
)
TEMPLATE_CATALOG = struct("template_id bigint, template string")
ALERT = struct(
    "alert_at timestamp, block_id string, source_machine string, anomaly_score double, "
    "cvss_score double, num_events bigint, error_count bigint, "
    "threat_categories array<string>, priority string, rule_based boolean, "
    "cve_ids array<string>, cwe string, vulnerability_name string, "
    "vulnerability_desc string, remediation_tip string"
)
ANALYST_LABEL = struct("block_id string, label string, note string, labelled_at timestamp")
GROUND_TRUTH = struct("BlockId string, Label string")
NOTIFICATION = struct(
    "notified_at timestamp, sent_at timestamp, block_id string, machine string, "
    "priority string, threat_categories array<string>, anomaly_score double, "
    "channels_used array<string>"
)
AUDIT = struct(
    "event string, timestamp timestamp, contamination double, n_labels_used bigint, "
    "block_id string, label string, note string"
)
MACHINE_HEALTH = struct(
    "machine string, ip string, os string, cpu double, ram double, ram_used double, "
    "ram_total double, disk double, disk_used double, disk_total double, "
    "updated_at timestamp"
)
USER = struct("username string, email string, role string, source_machine string")
RUN_RESULT = struct(
    "module string, id string, test string, status string, severity string, "
    "detail string, timestamp timestamp"
)

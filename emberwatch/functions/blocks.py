"""Block ids and operating system by log format.

The minute part of a block id comes from the event time column, so the same input
always gives the same blocks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.functions.lookup import lookup
from emberwatch.functions.text import minute_bucket

# --- fixed values: block id patterns --------------------------------------------------
HDFS_BLOCK = r"blk_-?\d+"
PROCESS_ID = r"(?U)(\w+)\[(\d+)\]"
RECORD_NUMBER = r"(?Ui)RecordNumber[=:\s]+(\d+)"


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def process_block(raw: Column) -> Column:
    """``name[pid]`` → ``name_pid``, null when absent."""
    return F.concat(_found(raw, PROCESS_ID, 1), F.lit("_"), _found(raw, PROCESS_ID, 2))


def block_by_format(fmt: Column, raw: Column, line_id: Column, ts: Column) -> Column:
    minute = minute_bucket(ts)
    line = line_id.cast("string")
    record = _found(raw, RECORD_NUMBER, 1)
    hdfs = F.coalesce(_found(raw, HDFS_BLOCK, 0), F.concat(F.lit("hdfs_line_"), line))
    syslog = F.coalesce(process_block(raw), F.concat(F.lit("syslog_"), minute))
    winlog = F.coalesce(
        F.concat(F.lit("win_"), record, F.lit("_"), minute), F.concat(F.lit("win_line_"), line)
    )
    return (
        F.when(fmt == "hdfs", hdfs)
        .when(fmt == "syslog", syslog)
        .when(fmt == "winlog", winlog)
        .otherwise(F.concat(F.lit("generic_"), minute))
    )


def block_by_process(raw: Column, source: Column, ts: Column) -> Column:
    """Process block, else the source's minute."""
    return F.coalesce(process_block(raw), F.concat(source, F.lit("_"), minute_bucket(ts)))


def block_by_channel(channel: Column, ts: Column, threat: Column) -> Column:
    group = F.when(F.coalesce(threat, F.lit("")) == "", "general").otherwise(threat)
    return F.concat_ws("_", F.lit("win"), channel, minute_bucket(ts), group)


def agent_block(source: Column, ts: Column) -> Column:
    return F.concat_ws("_", F.lit("agent"), source, minute_bucket(ts))


def os_of_format(fmt: Column) -> Column:
    return F.coalesce(lookup(D.FORMAT_OS, fmt), F.lit("unknown"))


def priority_threat(event: Column) -> Column:
    """Threat category of a high-priority Windows event id, else null."""
    return lookup(D.EVENT_THREATS, event, key_type="bigint")

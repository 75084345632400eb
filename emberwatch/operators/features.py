"""Block and event features.

Block features take two grouped steps.  The first groups by (block, template), so a
block holding most rows is still spread by its templates and combined map-side; the
second folds the template rows of a block.  No row list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.functions import text, threats
from emberwatch.operators.ordering import SLICE_BITS, distinct_bits, sliced_gaps, sliced_position

GROUPS = ("counts", "lengths", "levels", "shape", "time", "gaps", "hits")


def measured(df: DataFrame, keywords: dict, groups=GROUPS) -> DataFrame:
    """Per-event measures, computed once and only those the wanted groups need."""
    cols = ["block_id", "template_id"]
    out = threats.with_lowered(df)
    extra = []
    if "lengths" in groups:
        extra.append(F.length("raw").alias("_len"))
    if "levels" in groups:
        extra.append(threats.level(F.col("_lower")).alias("_level"))
    if "time" in groups:
        extra.append(F.unix_seconds(text.parse_timestamp("raw")).alias("_at"))
    if "gaps" in groups:
        cols.append("line_id")
    if "origin" in groups:
        threat = F.col("priority_threat") if "priority_threat" in df.columns else F.lit("")
        cols += ["source_machine"] + ([] if "gaps" in groups else ["line_id"])
        cols += ["ts"] if "ts" in df.columns else []
        extra.append((F.coalesce(threat, F.lit("")) != "").alias("_priority"))
    if "hits" in groups:
        extra += threats.threat_flags(F.col("_lower"), keywords)
    return out.select(*cols, *extra)


def block_features(
    df: DataFrame, keywords: dict = D.BATCH_KEYWORDS, groups=GROUPS, span: str | None = None
) -> DataFrame:
    """One feature row per block; ``groups`` picks which features are computed.

    With ``span`` (such as '1 hour') a block is taken in parts of that length of event time, with
    ``opened_at`` and ``closed_at``.  On a stream with a watermark every part leaves once, when the
    watermark has passed its end; both steps then keep sums per template and block, never events.
    """
    events = measured(df, keywords, groups)
    first = [F.count(F.lit(1)).alias("n")]
    second = [F.sum("n").alias("num_events")]
    tail = ["block_id"]
    n = F.col("num_events")

    if "counts" in groups:
        second.append(F.count("template_id").alias("unique_templates"))
        tail += ["num_events", "unique_templates"]
    if "lengths" in groups:
        length = F.col("_len").cast("bigint")
        first += [
            F.sum(length).alias("len1"),
            F.sum((length * length).cast("double")).alias("len2"),
            F.max("_len").alias("len_max"),
            F.min("_len").alias("len_min"),
        ]
        second += [
            F.sum("len1").cast("double").alias("len1"),
            F.sum("len2").alias("len2"),
            F.max("len_max").alias("max_msg_len"),
            F.min("len_min").alias("min_msg_len"),
        ]
        # population deviation from whole-number sums, exact up to 2**53
        spread = n * F.col("len2") - F.col("len1") * F.col("len1")
        tail += [
            (F.col("len1") / n).alias("avg_msg_len"),
            (F.sqrt(F.greatest(spread, F.lit(0.0))) / n).alias("std_msg_len"),
            "max_msg_len",
            "min_msg_len",
        ]
    if "levels" in groups:
        for name in ("ERROR", "WARN", "INFO"):
            column = f"{name.lower()}_count"
            first.append(F.count_if(F.col("_level") == name).alias(column))
            second.append(F.sum(column).alias(column))
            tail.append(column)
        tail += [
            (F.col("error_count") / n).alias("error_ratio"),
            (F.col("warn_count") / n).alias("warn_ratio"),
        ]
    if "shape" in groups:
        share = F.col("n").cast("double")
        second += [F.sum(share * F.log2(share)).alias("nlogn"), F.max("n").alias("n_top")]
        # -sum(p*log2(p)) with p = n/N
        tail += [
            F.greatest(F.log2(n.cast("double")) - F.col("nlogn") / n, F.lit(0.0)).alias("template_entropy"),
            (F.col("n_top") / n).alias("top_template_ratio"),
        ]
    if "time" in groups:
        first += [
            F.min("_at").alias("at_min"),
            F.max("_at").alias("at_max"),
            F.count("_at").alias("at_n"),
        ]
        second += [
            F.min("at_min").alias("at_min"),
            F.max("at_max").alias("at_max"),
            F.sum("at_n").alias("at_n"),
        ]
        lasted = F.when(F.col("at_n") >= 2, F.col("at_max") - F.col("at_min"))
        tail += [
            F.coalesce(lasted.cast("double"), F.lit(0.0)).alias("block_duration_sec"),
            F.when(lasted.isNull(), 0.0)
            .when(lasted == 0, -1.0)
            .otherwise(F.try_divide(n, lasted))
            .alias("events_per_sec"),
        ]
    if "gaps" in groups:
        first += [F.min("line_id").alias("line_min"), F.max("line_id").alias("line_max")]
        second += [F.min("line_min").alias("line_min"), F.max("line_max").alias("line_max")]
        gap = F.col("line_max") - F.col("line_min") + 1 - F.col("_lines")
        tail.append(F.coalesce(gap, F.lit(0)).alias("gap_count"))
    if "origin" in groups:
        # without line ids the earliest event names the machine
        order = [F.col("line_id").isNull().alias("unordered"), "line_id", *(["ts"] if "ts" in events.columns else [])]
        first += [
            F.min(F.struct(*order, "source_machine")).alias("origin"),
            F.count_if("_priority").alias("priority_hits"),
        ]
        second += [F.min("origin").alias("origin"), F.sum("priority_hits").alias("priority_hits")]
        tail += [F.col("origin.source_machine").alias("source_machine"), "priority_hits"]
    if "hits" in groups:
        for category in keywords:
            first.append(F.sum(f"{category}_flag").alias(f"{category}_hits"))
            second.append(F.sum(f"{category}_hits").alias(f"{category}_hits"))
            tail.append(f"{category}_hits")

    part = [] if span is None else [F.window("ts", span).alias("part")]
    again = [] if span is None else [F.window(F.col("part"), span).alias("part")]
    if span is not None:
        second.append(F.max("last_at").alias("last_at"))
        first.append(F.max("ts").alias("last_at"))
        tail += [F.col("part.start").alias("opened_at"), F.col("part.end").alias("closed_at"), "last_at"]
    out = events.groupBy(*part, "block_id", "template_id").agg(*first).groupBy(*again, "block_id").agg(*second)
    if "gaps" in groups:
        out = out.join(distinct_bits(df, "block_id", "line_id", "_lines"), "block_id", "left")
    return out.select(*tail)


def sequence_gaps(df: DataFrame) -> DataFrame:
    """gap_count alone, without the template step."""
    ends = df.groupBy("block_id").agg(
        F.min("line_id").alias("low"), F.max("line_id").alias("high")
    )
    lines = distinct_bits(df, "block_id", "line_id", "lines")
    return ends.join(lines, "block_id", "left").select(
        "block_id",
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("lines"), F.lit(0)).alias("gap_count"),
    )


def missing_line_ids(df: DataFrame) -> DataFrame:
    return sliced_gaps(df, "block_id", "line_id")


def _placed(df: DataFrame, at: Column, ties: list[str], digest: Column) -> DataFrame:
    """Add event_index: by line id, and by time where there is none; events with neither come first.

    ``digest`` is a hexadecimal hash that the ties begin with.  Files that number their lines from one
    again fill a block's slices with equal ids; those are cut by id and then by hash.  Slices of events
    without line id hold 67 seconds and are cut to milliseconds, then to microseconds.
    """
    rows = df.withColumn("_at", F.unix_micros(at))
    start = F.conv(F.substring(digest, 1, 3), 16, 10).cast("bigint")
    time = F.col("_at")
    spread = F.when(time.isNull(), start).otherwise(F.shiftright(time, 26) + (1 << 40))
    line = F.col("line_id").cast("bigint")
    near = F.coalesce(line.bitwiseAND((1 << SLICE_BITS) - 1), F.shiftright(time, 10).bitwiseAND(0xFFFF), F.lit(0))
    nearer = F.when(line.isNotNull(), F.shiftright(start, 2)).otherwise(F.coalesce(time.bitwiseAND(0x3FF), F.lit(0)))
    # ids that repeat are taken by their ties, whatever the time
    when = F.when(line.isNull(), time)
    out = sliced_position(
        rows.withColumn("_at", when), "block_id", "line_id", ["_at", *ties], "event_index", null_slice=spread, finer=(near, nearer)
    )
    return out.drop("_at")


def _arrival(df: DataFrame) -> Column:
    """Time at which an event came, as far as its columns tell."""
    known = [F.col(c).cast("timestamp") for c in ("ts", "collected_at") if c in df.columns]
    return F.coalesce(*known) if known else F.lit(None).cast("timestamp")


def event_index(df: DataFrame, ties=("raw",)) -> DataFrame:
    """Add the 0-based arrival position of each event within its block: by line id, else by time.

    Events that agree in these stand in the order of a hash of ``ties``, whichever file they are from.
    """
    digest = F.md5(F.concat_ws("\n", *[F.col(t).cast("string") for t in ties]))
    return _placed(df.withColumn("_digest", digest), _arrival(df), ["_digest"], F.col("_digest")).drop("_digest")


def event_features(df: DataFrame, keywords: dict = D.BATCH_KEYWORDS) -> DataFrame:
    """One row per event: text measures, level flags, threat flags, position."""
    lowered = F.col("_lower")
    level = F.col("_level")
    rows = threats.with_lowered(df).withColumn("_level", threats.level(lowered))
    flat = rows.select(
        "block_id",
        "template_id",
        "line_id",
        F.md5("raw").alias("_tie"),
        _arrival(df).alias("_came"),
        F.length("raw").alias("msg_len"),
        text.word_count("raw").alias("word_count"),
        (level == "ERROR").cast("int").alias("is_error"),
        (level == "WARN").cast("int").alias("is_warn"),
        (level == "INFO").cast("int").alias("is_info"),
        text.parse_timestamp("raw").isNotNull().cast("int").alias("has_timestamp"),
        *threats.threat_flags(lowered, keywords),
    )
    # only narrow numeric columns travel through the ordering shuffle
    placed = _placed(flat, F.col("_came"), ["_tie"], F.coalesce("_tie", F.lit("")))
    return placed.select(
        "block_id",
        "event_index",
        *[c for c in flat.columns if c not in ("block_id", "line_id", "_tie", "_came")],
    )


def realtime_block_features(
    df: DataFrame,
    keywords: dict = D.REALTIME_KEYWORDS,
    min_events: int = 3,
    fallback_machine: str = "unknown",
    span: str | None = None,
) -> DataFrame:
    """Features of freshly collected blocks: small blocks dropped, time fields zero.

    ``span`` takes blocks in parts of event time, as in ``block_features``.

    ``source_machine`` is that of the block's first event; ``priority_hits`` counts
    events with a priority threat.
    """
    groups = ("counts", "lengths", "levels", "shape", "origin", "hits")
    base = block_features(df, keywords, groups, span).filter(F.col("num_events") >= min_events)
    machine = F.coalesce(F.nullif(F.col("source_machine"), F.lit("")), F.lit(fallback_machine))
    hits = [f"{c}_hits" for c in keywords]
    outer = ["block_id", "source_machine", "priority_hits", *hits]
    return base.select(
        "block_id",
        machine.alias("source_machine"),
        *[c for c in base.columns if c not in outer],
        F.lit(0.0).alias("block_duration_sec"),
        F.lit(0.0).alias("events_per_sec"),
        F.lit(0).cast("bigint").alias("gap_count"),
        "priority_hits",
        *hits,
    )


def windows_events(df: DataFrame) -> DataFrame:
    """Events of Windows origin; the predicate reaches the scan."""
    return df.filter((F.col("os") == "windows") | (F.col("format") == "winlog"))


def windows_block_features(
    df: DataFrame, keywords: dict = D.REALTIME_KEYWORDS, min_events: int = 3
) -> DataFrame:
    return realtime_block_features(windows_events(df), keywords, min_events).drop("priority_hits")

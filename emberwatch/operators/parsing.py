"""Event parsing: templates, template ids, catalog, staged-event columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions import blocks, text


def with_template(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``template`` and ``template_id`` to every event."""
    named = df.withColumn("template", text.normalize(raw))
    return named.withColumn("template_id", text.template_id("template"))


def parsed_events(df: DataFrame) -> DataFrame:
    """Staged events → parsed events; absent attributes get their defaults."""
    def attribute(name, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)

    line = F.col("line_id")
    return with_template(df).select(
        "template_id",
        "template",
        "raw",
        F.coalesce(
            F.col("block_id") if "block_id" in df.columns else F.lit(None),
            F.concat(F.lit("unknown_"), line.cast("string")),
        ).alias("block_id"),
        attribute("source", "unknown").alias("source"),
        attribute("os", "unknown").alias("os"),
        line.alias("line_id"),
        (F.col("collected_at") if "collected_at" in df.columns else F.lit(None).cast("timestamp")).alias(
            "collected_at"
        ),
    )


def hdfs_events(df: DataFrame, raw: str = "raw", line: str = "line_id") -> DataFrame:
    """Lines of an HDFS log → events keyed by their first block token."""
    return df.select(
        text.strip(raw).alias("raw"),
        F.coalesce(
            text.hdfs_block(raw), F.concat(F.lit("hdfs_line_"), F.col(line).cast("string"))
        ).alias("block_id"),
        F.lit("hdfs").alias("source"),
        F.lit("linux").alias("os"),
        F.col(line).alias("line_id"),
    ).filter(~text.is_blank("raw"))


def staged_events(df: DataFrame, fmt, source="source", ts: str = "ts") -> DataFrame:
    """Lines (raw, line_id, time) → staged events with block id and system."""
    form = F.lit(fmt) if isinstance(fmt, str) else fmt
    return df.select(
        text.strip("raw").alias("raw"),
        blocks.block_by_format(form, F.col("raw"), F.col("line_id"), F.col(ts)).alias("block_id"),
        F.col(source).alias("source"),
        blocks.os_of_format(form).alias("os"),
        form.alias("format"),
        F.col("line_id"),
        F.col(ts).alias("collected_at"),
    )


def template_catalog(df: DataFrame, order: str = "line_id") -> DataFrame:
    """One row per template id; on an id collision the last template wins.

    Events combine by id and text with a numeric maximum, which hashes; the maximum by a text
    would sort them all and sees only the distinct pairs.
    """
    seen = df.groupBy("template_id", "template").agg(F.max(order).alias(order))
    return seen.groupBy("template_id").agg(
        F.max_by("template", F.struct(order, "template")).alias("template")
    )


def template_count(df: DataFrame) -> DataFrame:
    """Distinct template ids, counted in two steps so no task sees them all twice."""
    return df.groupBy("template_id").agg(F.lit(1).alias("one")).agg(
        F.count("one").alias("templates")
    )

"""Structured inputs: JSON lines, event XML, agent batches, cursors, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch import dictionaries as D
from emberwatch.functions import blocks, text
from emberwatch.functions.lookup import lookup
from emberwatch.schemas import AGENT_PAYLOAD

CORRUPT = "_corrupt_record"

# --- fixed values: limits and names of the event XML line -----------------------------
XML_DATA_FIELDS = 8
EVENT_XML = (
    "System struct<EventRecordID: string, EventID: struct<_VALUE: string>, "
    "TimeCreated: struct<_SystemTime: string>, Channel: string, Level: string, Computer: string>, "
    "EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>"
)

#: Events whose data may hold elements beside plain Data ones; declarations may hide some.
MORE_THAN_DATA = r"(?s)<!|<EventData.*?<(?!/?Data[\s/>]|/EventData\s*>|/Event\s*>)"


def parse_json_lines(df: DataFrame, column: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """JSON text → columns; malformed lines and lines lacking a required key are dropped."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(
        F.col(column), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    lines = df.filter(~text.is_blank(column)).withColumn("_json", parsed)
    keep = lines.filter(F.col("_json").isNotNull() & F.col(f"_json.{CORRUPT}").isNull())
    for name in required:
        keep = keep.filter(F.col(f"_json.{name}").isNotNull())
    others = [c for c in df.columns if c != column]
    return keep.select(*others, *[F.col(f"_json.{f.name}").alias(f.name) for f in schema.fields])


def read_json_lines(
    spark: SparkSession, paths, schema: T.StructType, required: list[str] = ()
) -> DataFrame:
    """JSON-lines files with a fixed schema, read leniently."""
    return parse_json_lines(spark.read.text(paths), "value", schema, list(required))


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Template catalog ordered by id (range-partitioned sort, ordered file names)."""
    catalog.orderBy("template_id").write.mode("overwrite").json(path)


# --- event XML ------------------------------------------------------------------------


def split_events(df: DataFrame, column: str) -> DataFrame:
    """Text holding several <Event> documents → one per row."""
    parts = F.split(F.col(column), r"(?<=</Event>)")
    return df.select(
        *[c for c in df.columns if c != column], F.explode(parts).alias(column)
    ).filter(~text.is_blank(column))


def read_event_xml(spark: SparkSession, paths, recursive: bool = False) -> DataFrame:
    """Files of event XML → file, record_id, place (from 1, by record id within the file), raw."""
    from pyspark.sql import Window

    files = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "</Event>").text(paths)
    parts = files.select(F.col("_metadata.file_path").alias("file"), text.strip("value").alias("xml"))
    parts = parts.filter(F.col("xml") != "").withColumn("xml", F.concat("xml", F.lit("</Event>")))
    lines = xml_event_lines(parts)
    order = Window.partitionBy("file").orderBy("record_id", "raw")
    return lines.withColumn("place", F.row_number().over(order).cast("bigint"))


def xml_event_lines(df: DataFrame, column: str = "xml") -> DataFrame:
    """Event XML → record_id and one summary line; malformed events are dropped.

    The first data fields follow the header; words describing a known event id are
    appended so that the keyword rules can match.
    """
    others = [c for c in df.columns if c != column]
    # exploded, not filtered: a filter would be moved into the scan and parse every event twice
    whole = F.filter(F.array(F.from_xml(F.col(column), EVENT_XML)), lambda e: e["System"].isNotNull())
    work = df.withColumn("_e", F.explode(whole))
    system = "_e.System"

    def value(path, default):
        found = text.strip(F.col(f"{system}.{path}"))
        return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))

    number = value("EventID._VALUE", "?")
    raw_level = value("Level", "")
    level = F.coalesce(lookup(D.EVENT_LEVELS, raw_level), raw_level)
    computer = value("Computer", "")
    named = F.transform(
        F.col("_e.EventData.Data"),
        lambda d: F.when(
            F.coalesce(text.strip(d["_VALUE"]), F.lit("")) != "",
            F.concat(
                F.when(F.coalesce(d["_Name"], F.lit("")) != "", F.concat(d["_Name"], F.lit("="))).otherwise(""),
                text.strip(d["_VALUE"]),
            ),
        ),
    )
    # free-form user data has no fixed schema; its texts are read in document order
    loose = F.transform(F.xpath(F.col(column), F.lit("Event/UserData//text()")), lambda v: text.strip(v))
    # other elements of the event data carry text too; a path builds the whole document, so only
    # events that may hold such an element are searched
    others_text = F.transform(
        F.xpath(F.col(column), F.lit("Event/EventData//*[name() != 'Data']/text()")), lambda v: text.strip(v)
    )
    named = F.coalesce(named, F.array().cast("array<string>"))
    event_data = F.when(F.col(column).rlike(MORE_THAN_DATA), F.concat(named, others_text)).otherwise(named)
    fields = (
        F.when(F.col("_e.EventData").isNotNull(), event_data)
        .when(F.contains(F.col(column), F.lit("UserData")) | F.contains(F.col(column), F.lit("<!")), loose)
        .otherwise(F.array().cast("array<string>"))
    )
    present = F.slice(F.filter(fields, lambda v: v.isNotNull() & (v != "")), 1, XML_DATA_FIELDS)
    words = lookup(D.EVENT_KEYWORDS, number.try_cast("bigint"), key_type="bigint")
    line = F.concat(
        F.lit("Channel="), value("Channel", "?"),
        F.lit(" EventID="), number,
        F.lit(" Level="), level,
        F.lit(" Time="), F.coalesce(F.col(f"{system}.TimeCreated._SystemTime"), F.lit("")),
        F.when(computer != "", F.concat(F.lit(" Computer="), computer)).otherwise(""),
        F.when(F.size(present) > 0, F.concat(F.lit(" | "), F.array_join(present, " | "))).otherwise(""),
        F.when(words.isNotNull(), F.concat(F.lit(" | keywords="), words)).otherwise(""),
    )
    record = F.coalesce(F.col(f"{system}.EventRecordID").try_cast("bigint"), F.lit(0))
    return work.select(*others, record.cast("bigint").alias("record_id"), line.alias("raw"))


# --- agent batches --------------------------------------------------------------------


def agent_events(df: DataFrame, payload: str = "payload", received_at: str = "received_at") -> DataFrame:
    """JSON batches of {log, source} → staged events; blank lines are dropped."""
    items = df.select(
        F.col(received_at).alias("collected_at"),
        F.explode(F.from_json(F.col(payload), AGENT_PAYLOAD)).alias("item"),
    ).select(
        text.strip("item.log").alias("raw"),
        F.coalesce("item.source", F.lit("agent")).alias("source"),
        "collected_at",
    )
    return items.filter(F.coalesce(F.col("raw"), F.lit("")) != "").select(
        "raw",
        blocks.agent_block(F.col("source"), F.col("collected_at")).alias("block_id"),
        "source",
        F.col("source").alias("source_machine"),
        F.lit("unknown").alias("os"),
        "collected_at",
        F.lit("agent_generic").alias("template_id"),
        blocks.priority_threat(text.event_id("raw")).alias("priority_threat"),
    )


# --- cursors --------------------------------------------------------------------------


def since_cursor(events: DataFrame, cursor: DataFrame, source: str, record: str) -> DataFrame:
    """Records newer than their source's cursor (``last_record``); no cursor means 0."""
    return (
        events.join(cursor.select(source, "last_record"), source, "left")
        .filter(F.col(record) > F.coalesce("last_record", F.lit(0)))
        .drop("last_record")
    )


def cursor_high_water(events: DataFrame, source: str, record: str, cursor: DataFrame | None = None) -> DataFrame:
    """Largest record per source, never behind an earlier cursor."""
    seen = events.select(source, F.col(record).alias("last_record"))
    if cursor is not None:
        seen = seen.unionByName(cursor.select(source, "last_record"))
    return seen.groupBy(source).agg(F.max("last_record").alias("last_record"))

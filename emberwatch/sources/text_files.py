"""Log files: numbered lines, format detection, CSV exports, directory scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.functions import blocks, text
from emberwatch.session import written

#: Columns of a CSV export that are read unless a header is wider, and the most; exports have about twenty.
CSV_COLUMNS, MOST_CSV_COLUMNS = 64, 20_480
LOG_GLOB = "*{" + ",".join(D.SUPPORTED_SUFFIXES) + "}"


def text_lines(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Split a text column into numbered lines; blank lines count but are dropped."""
    lines = F.split(F.col(column), r"\r\n|\r|\n")
    return (
        df.select(*keys, F.posexplode(lines).alias("_pos", "raw"))
        .filter(~text.is_blank("raw"))
        .select(*keys, (F.col("_pos") + 1).alias("line_id"), "raw")
    )


def read_log_lines(
    spark: SparkSession, paths, recursive: bool = False, glob: str = LOG_GLOB, skip_damaged: bool = False
) -> DataFrame:
    """Numbered lines of plain or gzip files: file, file_time, line_id, raw.

    A damaged file ends the read; ``skip_damaged`` reads on with the lines before the damage.

    Large files are read in splits.  A first pass counts the lines of every split into a
    small written table; its running sum gives each split its first line number, so line
    text is never shuffled or held per file.
    """
    scan = (
        spark.read.option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", glob)
        .option("ignoreCorruptFiles", str(skip_damaged).lower())
        .text(paths)
    )
    numbered = scan.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("raw"),
    )
    from pyspark.sql import Window

    splits = numbered.groupBy("file", "_start").agg(
        F.min("_id").alias("_base"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(
        splits.select(
            "file",
            "_start",
            (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_base")).alias("_shift"),
        ),
        "splits",
    )
    # both scans must cut the files alike; a split without an offset is an error, never a loss
    shift = F.coalesce("_shift", F.raise_error(F.lit("file splits changed between two scans")).cast("bigint"))
    return (
        numbered.join(offsets, ["file", "_start"], "left")
        .filter(~text.is_blank("raw"))
        .select("file", "file_time", (F.col("_id") + shift + 1).alias("line_id"), "raw")
    )


def file_name(path: Column) -> Column:
    # a plus sign in a path stands for itself
    return F.url_decode(F.replace(F.substring_index(path, "/", -1), F.lit("+"), F.lit("%2B")))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def detect_format(lines: DataFrame, keys: list[str], name: Column | None = None) -> DataFrame:
    """Format per file from its name, then from its first five lines.

    ``lines`` has ``keys`` identifying the file, line_id and raw.
    """
    name = F.lower(F.col("name") if name is None else name)
    lowered = F.lower("raw")
    head = F.col("line_id") <= 5
    hints = [
        F.coalesce(F.bool_or(F.when(head, lowered.rlike("(?U)" + pattern))), F.lit(False)).alias(f"_{i}")
        for i, (_, pattern) in enumerate(D.FORMAT_TEXT_HINTS)
    ]
    per_file = lines.groupBy(*keys).agg(F.min(name).alias("_name"), *hints)
    chain = F.when(F.lit(False), F.lit(""))
    for fmt, words in D.FORMAT_NAME_HINTS:
        for word in words:
            chain = chain.when(F.col("_name").contains(word), fmt)
    for i, (fmt, _) in enumerate(D.FORMAT_TEXT_HINTS):
        chain = chain.when(F.col(f"_{i}"), fmt)
    return per_file.select(*keys, chain.otherwise("generic").alias("format"))


def winlog_line(df: DataFrame, headers: dict = D.WINLOG_CSV_HEADERS) -> Column:
    """Rebuild one line from an event-log export; each header is chosen by presence."""
    def pick(role):
        for name in headers[role]:
            if name in df.columns:
                return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        return F.lit("")

    return _winlog_line(pick)


def winlog_line_of_cells(cells: Column, header: Column, headers: dict = D.WINLOG_CSV_HEADERS) -> Column:
    """The same from a row's cells and its own file's header row."""
    def pick(role):
        chosen = F.lit("")
        for name in reversed(headers[role]):
            at = F.array_position(header, F.lit(name)).cast("int")
            chosen = F.when(at > 0, F.coalesce(F.try_element_at(cells, at), F.lit(""))).otherwise(chosen)
        return chosen

    return _winlog_line(pick)


def _winlog_line(pick) -> Column:
    message = F.translate(pick("message"), "\n\r", "  ")
    return F.concat(
        pick("time"), F.lit(" ["), pick("level"), F.lit("] EventID="), pick("event"), F.lit(" "), message
    )


def _csv_rows(spark: SparkSession, paths, recursive: bool, names: list[str], *more: Column) -> DataFrame:
    df = (
        spark.read.schema(", ".join(f"{n} string" for n in [*names, *(["_record"] if more else [])]))
        .option("columnNameOfCorruptRecord", "_record")
        .option("maxColumns", MOST_CSV_COLUMNS + 1)
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", "*.csv")
        .option("multiLine", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(paths)
    )
    return df.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.monotonically_increasing_id().alias("_id"),
        F.array(*names).alias("_cells"),
        *more,
    )


def read_winlog_csv(spark: SparkSession, paths, recursive: bool = False) -> DataFrame:
    """Event-log CSV exports, each with its own header → file, file_time, line_id, raw."""
    # a row that is not as wide as the schema keeps its record, whose commas bound the width from above
    names = [f"c{i}" for i in range(CSV_COLUMNS)]
    probe = _csv_rows(spark, paths, recursive, names, F.struct(F.size(F.split("_record", ",")), "c0").alias("_width"))
    widest = probe.groupBy("file").agg(F.min_by("_width", "_id").alias("_width")).agg(F.max("_width")).first()[0]
    if widest and widest[0] > CSV_COLUMNS:  # with a cell, as Spark reads no record by itself
        if widest[0] > MOST_CSV_COLUMNS:
            raise ValueError(f"a CSV header may have {widest[0]} columns, more than {MOST_CSV_COLUMNS}: an open quote?")
        names = [f"c{i}" for i in range(widest[0])]
    rows = _csv_rows(spark, paths, recursive, names)
    # a multi-line CSV file is one split, so its rows are consecutive and the header comes first
    first = rows.groupBy("file").agg(F.min("_id").alias("_base"), F.min_by("_cells", "_id").alias("_header"))
    trimmed = F.transform("_header", lambda c: F.trim(F.ltrim(F.coalesce(c, F.lit("")), F.lit("﻿"))))
    first = written(first.withColumn("_header", trimmed), "csv-headers")
    return (
        rows.join(first, "file")
        .filter(F.col("_id") > F.col("_base"))
        .select(
            "file",
            "file_time",
            (F.col("_id") - F.col("_base")).alias("line_id"),
            winlog_line_of_cells(F.col("_cells"), F.col("_header")).alias("raw"),
        )
    )


def read_directory(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """All supported files of a directory as staged events, format found per file."""
    lines = read_log_lines(spark, path, recursive)
    formats = written(
        detect_format(lines, ["file"], file_name(F.col("file"))), "formats"
    )
    is_export = F.col("file").endswith(".csv") & (F.col("format") == "winlog")
    plain = lines.join(formats.filter(~is_export), "file")
    exports = formats.filter(is_export)
    if not exports.isEmpty():
        rebuilt = read_winlog_csv(spark, path, recursive).join(exports, "file")
        plain = plain.unionByName(rebuilt)
    when = F.coalesce(text.parse_timestamp("raw"), F.col("file_time"))
    fmt = F.col("format")
    return plain.select(
        text.strip("raw").alias("raw"),
        blocks.block_by_format(fmt, F.col("raw"), F.col("line_id"), when).alias("block_id"),
        file_stem(F.col("file")).alias("source"),
        blocks.os_of_format(fmt).alias("os"),
        fmt.alias("format"),
        "line_id",
        when.alias("collected_at"),
    )

"""Structured Streaming jobs over growing log folders.

Every job is a source, a transform shared with the batch operators, and a file sink with
a checkpoint, so a restart resumes where the last committed micro-batch ended.
``processing`` sets the trigger: an interval such as '30 seconds', or None to take what
is there and stop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from emberwatch.functions import blocks, text, threats
from emberwatch.operators import alerts, features, feedback, forest
from emberwatch.session import exists, listed, removed
from emberwatch.sources import growing_files
from emberwatch.sources.records import agent_events, parse_json_lines
from emberwatch.streaming import state

COLLECT_INTERVAL = "30 seconds"


# --- sources --------------------------------------------------------------------------


def tail_text(
    spark: SparkSession,
    path: str,
    start_at: Column | None = None,
    start: str = "beginning",
    pattern: str = "*",
    recursive: bool = True,
) -> DataFrame:
    """New log lines of a folder whose files grow and rotate: raw, source (file stem), event time.

    The checkpoint is the cursor, by byte for every file.  ``start="end"`` skips what the files hold
    at the first run; ``start_at`` skips events from before a time.
    """
    lines = growing_files.read_stream(spark, path, pattern, start, recursive)
    lines = lines.select("raw", "source", F.coalesce(text.parse_timestamp("raw"), "modified").alias("ts"))
    return lines if start_at is None else lines.filter(F.col("ts") >= start_at)


def tail_json(
    spark: SparkSession, path: str, schema: T.StructType, required: list[str], start: str = "beginning", pattern: str = "*"
) -> DataFrame:
    """New JSON lines of a folder whose files grow; malformed lines are skipped."""
    lines = growing_files.read_stream(spark, path, pattern, start)
    return parse_json_lines(lines.select(F.col("raw").alias("value")), "value", schema, required)


def linux_events(lines: DataFrame, machine: Column) -> DataFrame:
    """Tailed lines as staged events: the category stands for the template, the line id is unknown.

    ``lines`` carries raw, source and ts; ``machine`` names the host that the files belong to.
    """
    return lines.select(
        "raw",
        blocks.block_by_process(F.col("raw"), F.col("source"), F.col("ts")).alias("block_id"),
        "source",
        machine.alias("source_machine"),
        F.lit("linux").alias("os"),
        threats.first_category(F.lower("raw")).alias("template_id"),
        F.lit(None).cast("bigint").alias("line_id"),
        F.col("ts").alias("collected_at"),
    )


# --- sinks ----------------------------------------------------------------------------


def _trigger(writer, processing: str | None):
    if processing is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=processing)


def to_files(
    df: DataFrame, path: str, checkpoint: str, processing: str | None = None, fmt: str = "parquet"
) -> StreamingQuery:
    writer = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
    return _trigger(writer.outputMode("append"), processing).start()


# --- jobs -----------------------------------------------------------------------------


def dedup_alerts(alerts_stream: DataFrame, keys: list[str], ts: str, bound: str | None = None) -> DataFrame:
    """First row per key.  Without ``bound`` a key fires once ever (state grows with the
    number of keys); with it, once per watermark interval."""
    if bound is None:
        return alerts_stream.dropDuplicates(keys)
    return alerts_stream.withWatermark(ts, bound).dropDuplicatesWithinWatermark(keys)


def cooldown_job(
    stream: DataFrame,
    key: str,
    ts: str,
    seconds: float,
    tie: str,
    out: str,
    checkpoint: str,
    processing: str | None = None,
    retain_seconds: float | None = None,
) -> StreamingQuery:
    """Cooldown across micro-batches into files; the last kept time of every key is Spark's state.

    ``retain_seconds`` (at least the cooldown plus the lateness to expect) bounds the state.
    """
    return to_files(state.cooled(stream, key, ts, seconds, tie, retain_seconds), out, checkpoint, processing)


class Upserts:
    """The latest row per key of a stream as change files: a batch writes the keys it changed only.

    Every ``every`` batches the files so far become one base and are removed, so their number stays
    bounded; a batch that is repeated after a failure writes its own folder again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, every: int = 32):
        self.spark, self.path, self.key, self.every = spark, path, key, every
        self.names, self.schema = schema.names, T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])

    def folders(self) -> list[str]:
        """The newest finished base and the changes after it, older ones left out."""
        found = sorted(f for f in listed(self.spark, self.path) if f.startswith(("base=", "change=")))
        bases = [f for f in found if f.startswith("base=") and exists(self.spark, f"{self.path}/{f}/_SUCCESS")]
        return [f for f in found if f in bases[-1:] or f.startswith("change=") and (not bases or f[7:] > bases[-1][5:])]

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])
        newest = rows.groupBy(self.key).agg(F.max("_batch").alias("_batch"))
        return rows.join(newest, [self.key, "_batch"], "left_semi").select(*self.schema.names)

    def write(self, batch: DataFrame, number: int) -> None:
        if number and number % self.every == 0:
            base = f"base={number - 1:012d}"
            before = [f for f in self.folders() if f != base and f.split("=")[1] < f"{number:012d}"]
            if before and base not in self.folders():
                self._rows(before).write.mode("overwrite").parquet(f"{self.path}/{base}")
            for folder in listed(self.spark, self.path):
                if folder != base and folder.startswith(("base=", "change=")) and folder.split("=")[1] < f"{number:012d}":
                    removed(self.spark, f"{self.path}/{folder}")
        change = batch.select(*self.names).withColumn("_batch", F.lit(number).cast("bigint"))
        change.write.mode("overwrite").parquet(f"{self.path}/change={number:012d}")

    def latest(self) -> DataFrame:
        return self._rows(self.folders()).select(*self.names)


def latest_health_job(stream: DataFrame, out: str, checkpoint: str, processing: str | None = None) -> tuple[StreamingQuery, Upserts]:
    """Keep the newest snapshot per machine: Spark's state holds it, changed machines are written."""
    latest = feedback.latest_health(stream)
    table = Upserts(stream.sparkSession, out, latest.schema, "machine")
    writer = latest.writeStream.outputMode("update").foreachBatch(table.write).option("checkpointLocation", checkpoint)
    return _trigger(writer, processing).start(), table


CYCLE = ("blocks", "rules", "model")


class ScoreCycle:
    """The queries of a score cycle and where their results are."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out, self.queries, self.schemas = spark, out, {}, {}

    def awaitTermination(self) -> None:
        for job in self.queries.values():
            job.awaitTermination()

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.out}/{name}")

    def blocks(self) -> DataFrame:
        """Every closed part of a block once, with features and score."""
        return self._read("blocks")

    def alerts(self) -> DataFrame:
        """Rule alerts and model alerts, as far as the cycle makes them, enriched."""
        kinds = [self._read(k) for k in ("rules", "model") if k in self.queries]
        return alerts.enrich(kinds[0] if len(kinds) == 1 else alerts.union_alerts(*kinds))


def score_cycle_job(
    stream: DataFrame,
    model: forest.IsolationForest,
    out: str,
    checkpoint: str,
    threshold: float = alerts.ANOMALY_THRESHOLD,
    min_events: int = 3,
    seconds: float = alerts.RULE_COOLDOWN_SEC,
    span: str = "1 hour",
    lateness: str = "10 minutes",
    processing: str | None = None,
    retain_seconds: float | None = None,
    want: tuple[str, ...] = CYCLE,
) -> ScoreCycle:
    """Collect → featurise → score → alert.

    ``stream`` carries collected events with block id, template id, machine and time.  Three queries
    work on it, and none depends on where micro-batches begin:

    * blocks are taken in parts of ``span`` of event time; each part is scored once, when the watermark
      (``lateness`` behind the newest event) passes its end.  State holds sums per template and block of
      open parts.  Events later than that are left out; events without a time belong to no part.
    * keyword hits of a block add up over its whole life, and each category is raised as soon as its
      rule is met, once.  ``retain_seconds`` forgets blocks without new events.
    * scored parts below ``threshold`` pass the cooldown by signature and become model alerts, at the
      time of the part's last event.

    Without an interval the queries run one after the other to the end of what is there.  ``want`` picks
    queries; ``model`` reads what ``blocks`` wrote.
    """
    spark, cycle = stream.sparkSession, ScoreCycle(stream.sparkSession, out)

    def start(name: str, rows: DataFrame) -> None:
        cycle.schemas[name] = rows.schema
        if name in want:
            cycle.queries[name] = to_files(rows, f"{out}/{name}", f"{checkpoint}/{name}", processing)
            if processing is None:
                cycle.queries[name].awaitTermination()

    start("rules", alerts.alerts_of_rules(state.fired_rules(stream, retain_seconds=retain_seconds)))
    parts = features.realtime_block_features(stream.withWatermark("ts", lateness), min_events=min_events, span=span)
    start("blocks", forest.score(parts, model).drop("is_anomaly", "prediction").withColumnRenamed("last_at", "alert_at"))
    if "model" in want:
        closed = spark.readStream.schema(cycle.schemas["blocks"]).parquet(f"{out}/blocks")
        kept = state.cooled(alerts.signed(closed, threshold), "signature", "alert_at", seconds, "block_id", retain_seconds)
        start("model", alerts.alerts_of_model(kept))
    return cycle


class AgentIngest(ScoreCycle):
    """A score cycle over what agents sent, and the staged events themselves."""

    def events(self) -> DataFrame:
        return self._read("events")


def agent_ingest_job(
    batches: DataFrame,
    model: forest.IsolationForest,
    out: str,
    checkpoint: str,
    payload: str = "payload",
    received_at: str = "received_at",
    processing: str | None = None,
    **settings,
) -> AgentIngest:
    """Agent batches → staged events, rule alerts and model alerts.

    ``batches`` carries JSON lists of {log, source} and their time of receipt.  The payload is parsed
    once; staged events go to files, and the score cycle reads those files as its stream.  An agent's
    block is one source and minute, so blocks are taken in parts of a minute, and one event is enough
    for a score.  Rules do not wait for the model or the watermark.  Every sink commits whole
    micro-batches, so a restart repeats none.  A null or malformed payload holds no events; a batch
    without time of receipt has events and no block.  ``settings`` are those of ``score_cycle_job``.
    """
    spark = batches.sparkSession
    staged = agent_events(batches, payload, received_at)
    job = to_files(staged, f"{out}/events", f"{checkpoint}/events", processing)
    if processing is None:
        job.awaitTermination()
    arrived = spark.readStream.schema(staged.schema).parquet(f"{out}/events")
    arrived = arrived.withColumns({"ts": F.col("collected_at"), "line_id": F.lit(None).cast("bigint")})
    settings = {"min_events": 1, "span": "1 minute", "processing": processing} | settings
    cycle = score_cycle_job(arrived, model, out, checkpoint, **settings)
    ingest = AgentIngest(spark, out)
    ingest.queries = {"events": job, **cycle.queries}
    ingest.schemas = {"events": staged.schema, **cycle.schemas}
    return ingest

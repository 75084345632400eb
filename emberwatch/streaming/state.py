"""Keyed state of streams, kept by Spark's state store.

Rows meet their key's state in one task; the cooldown sorts a key's rows of a micro-batch on that task's
disk, so its memory does not grow with them.  Nothing here is rewritten as a whole: the store keeps changes,
and a key whose time is over is removed by its timer.
"""

from __future__ import annotations

import heapq
import itertools
import pickle
import sys
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from emberwatch import dictionaries as D
from emberwatch.functions import threats
from emberwatch.operators.cooldown import key_name

# workers need not have this package: processors travel with the query
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a sorted run, rows of it that are read at once, and runs that are merged at once.
RUN_ROWS, BLOCK_ROWS, MOST_RUNS = 20_000, 100, 200


class Runs:
    """Tuples to be read in order once: sorted runs on the task's disk, of which few rows are in memory."""

    def __init__(self, rows: int = RUN_ROWS, block: int = BLOCK_ROWS):
        self.rows, self.block, self.held, self.files = rows, block, [], []

    def add(self, item: tuple) -> None:
        self.held.append(item)
        if len(self.held) >= self.rows:
            self._spill(sorted(self.held))
            self.held = []
            if len(self.files) >= MOST_RUNS:
                files, self.files = self.files, []
                self._spill(heapq.merge(*map(self._read, files)))
                for file in files:
                    file.close()

    def _spill(self, items) -> None:
        file, items = tempfile.TemporaryFile(), iter(items)
        self.files.append(file)
        while block := list(itertools.islice(items, self.block)):
            pickle.dump(block, file, pickle.HIGHEST_PROTOCOL)
        file.flush()

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        file.seek(0)
        while True:
            try:
                block = pickle.load(file)
            except EOFError:
                return
            yield from block

    def merged(self) -> Iterator[tuple]:
        self.held.sort()
        return heapq.merge(*map(self._read, self.files), self.held)

    def close(self) -> None:
        for file in self.files:
            file.close()


class CooldownProcessor(StatefulProcessor):
    """Keeps a row when ``wait`` microseconds have passed since the last kept row of its key."""

    def __init__(self, wait: int, retain: int | None):
        self.wait, self.retain = wait, retain

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = known = self.last.get()[0] if self.last.exists() else None
        runs = Runs()
        try:
            for place, r in enumerate(rows):
                if r["t_"] is None:
                    yield Row(row_=r["row_"])
                elif known is None or r["t_"] > known:
                    # nulls of the tie come last; ``place`` keeps rows themselves from being compared
                    runs.add((r["t_"], r["tie_"] is None, r["tie_"] or 0, place, r["row_"]))
            kept = False
            for t, *_, row in runs.merged():
                if last is None or t >= last + self.wait:
                    last, kept = t, True
                    yield Row(row_=row)
        finally:
            runs.close()
        if not kept:
            return
        self.last.update((last,))
        if self.retain is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last // 1000 + self.retain)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        """Nothing is held outside the store."""


class RuleProcessor(StatefulProcessor):
    """Adds up a block's keyword hits and raises each category once, when its rule's minimum is reached."""

    def __init__(self, needed: dict[str, int], retain: int | None):
        self.needed, self.retain = needed, retain

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getValueState("events", "n long, last long, unordered boolean, line long, first long, machine string")
        self.hits = handle.getMapState("hits", "category string", "hits long, fired boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, last, origin = 0, None, None
        if self.events.exists():
            n, last, *known = self.events.get()
            origin = tuple(known)
        new: dict[str, int] = {}
        for r in rows:
            block, n = r["block_id"], n + r["n"]
            last = r["last"] if last is None else last if r["last"] is None else max(last, r["last"])
            for category in self.needed:
                if r[category]:
                    new[category] = new.get(category, 0) + r[category]
            own = (r["line"] is None, r["line"], r["first"], r["machine"])
            origin = own if origin is None else min(origin, own, key=_arrival)
        self.events.update((n, last, *origin))
        for category, more in new.items():
            old = self.hits.getValue((category,)) if self.hits.containsKey((category,)) else None
            total, fired = more + (old[0] if old else 0), bool(old and old[1])
            if total >= self.needed[category] and not fired:
                fired = True
                yield Row(block_id=block, source_machine=origin[3], last=last, num_events=n, category=category, hits=total)
            self.hits.updateValue((category,), (total, fired))
        if self.retain is not None and last is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last // 1000 + self.retain)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.events.clear()
        self.hits.clear()
        return iter([])

    def close(self) -> None:
        """Nothing is held outside the store."""


def _arrival(origin: tuple) -> tuple:
    """Lowest line id first; without line ids the earliest time; nulls before values, as in SQL."""
    return tuple((x is not None, x if x is not None else 0) if not isinstance(x, str) else (True, x) for x in origin[:3]) + ((origin[3] is not None, origin[3] or ""),)


def _combined(categories: list[str]):
    """Sums per block and machine within an Arrow batch, so a hot block shrinks before the shuffle."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [("n", "sum"), ("last", "max"), ("first", "min"), ("line", "min"), *[(c, "sum") for c in categories]]
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by(["block_id", "machine"], use_threads=False).aggregate(sums)
            table = table.rename_columns([c.rsplit("_", 1)[0] if c not in ("block_id", "machine") else c for c in table.column_names])
            yield from table.select(["block_id", "machine", *[c for c, _ in sums]]).to_batches()

    return combine


def fired_rules(stream: DataFrame, keywords: dict = D.REALTIME_KEYWORDS, rules=D.RULES, retain_seconds: float | None = None, event: str = "ts") -> DataFrame:
    """Blocks and categories of a stream whose hits, added up over all micro-batches, reach their rule.

    Every pair leaves once.  ``num_events``, ``hits`` and the machine are those known when it does.  With
    ``retain_seconds`` a block is forgotten when the watermark of that length passes its last event.
    """
    names = [c for c, _, _ in rules]
    flagged = threats.with_lowered(stream).select(
        "block_id",
        F.col("source_machine").alias("machine"),
        F.lit(1).cast("bigint").alias("n"),
        F.unix_micros(event).alias("last"),
        F.unix_micros(event).alias("first"),
        F.col("line_id").cast("bigint").alias("line"),
        *[f.cast("bigint").alias(c) for c, f in zip(names, threats.threat_flags(F.col("_lower"), {c: keywords[c] for c in names}), strict=True)],
    )
    numbers = ", ".join(f"{c} long" for c in ["n", "last", "first", "line", *names])
    parts = flagged.mapInArrow(_combined(names), f"block_id string, machine string, {numbers}")
    parts = parts.withColumn("key_", key_name(F.col("block_id")))
    if retain_seconds is None:
        mode, retain = "None", None
    else:
        mode, retain = "EventTime", int(retain_seconds * 1000)
        parts = parts.withColumn("event_", F.timestamp_micros("last")).withWatermark("event_", f"{retain} milliseconds")
    needed = {c: n for c, _, n in rules}
    out = "block_id string, source_machine string, last long, num_events long, category string, hits long"
    fired = parts.groupBy("key_").transformWithState(RuleProcessor(needed, retain), out, "Append", mode)
    return fired.withColumn("last_at", F.timestamp_micros("last")).drop("last")


def cooled(stream: DataFrame, key: str, ts: str, seconds: float, tie: str, retain_seconds: float | None = None) -> DataFrame:
    """The rows of a stream that pass the cooldown of their key, across micro-batches.

    Rows of one micro-batch are taken in the order of time and ``tie``; rows at or before a
    key's last kept time are suppressed.  A null key is a key of its own.  Rows without a time cannot be
    compared and all pass.  With ``retain_seconds`` a key is forgotten once the watermark of
    the same length passes its last kept time, which bounds the state; rows later than that are dropped.
    """
    timed = stream.withColumns(
        {
            "key_": key_name(F.col(key)),
            "t_": F.unix_micros(F.col(ts).cast("timestamp")),
            "tie_": F.col(tie),
            "row_": F.struct(*[F.col(c) for c in stream.columns]),
        }
    )
    wait = int(round(seconds * 1_000_000))
    if retain_seconds is None:
        mode, retain = "None", None
    else:
        mode, retain = "EventTime", int(max(retain_seconds, seconds) * 1000)
        timed = timed.withColumn("event_", F.col(ts).cast("timestamp")).withWatermark("event_", f"{retain} milliseconds")
    fields = T.StructType([T.StructField("row_", stream.schema)])
    kept = timed.groupBy("key_").transformWithState(CooldownProcessor(wait, retain), fields, "Append", mode)
    return kept.select("row_.*")

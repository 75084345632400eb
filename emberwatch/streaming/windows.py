"""One-minute blocks, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minute_blocks(
    events: DataFrame, keys: list[str], ts: str = "ts", watermark: str | None = None
) -> DataFrame:
    """Tumbling one-minute groups per key.

    With a watermark (streams) each minute is closed once, after late events had their
    time; without it (batch) the same grouping is computed directly.
    """
    source = events.withWatermark(ts, watermark) if watermark else events
    return (
        source.groupBy(F.window(ts, "1 minute").alias("w"), *keys)
        .agg(
            F.count(F.lit(1)).alias("num_events"),
            F.sum(F.length("raw").cast("bigint")).alias("chars"),
        )
        .select(
            F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("minute"),
            *keys,
            "num_events",
            "chars",
        )
    )

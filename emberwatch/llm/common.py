"""What the training-data operators share: table access, hashing, and batch helpers."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

#: Bytes that end a word in the "letters, digits and non-ASCII" word definition; upper case
#: letters map to lower case, so one ``translate`` lower-cases and blanks separators.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


#: Bytes of rows that a Python worker gets at once, where the session leaves Spark's default of 64 MB.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package wherever the driver was started, and feed them small batches.

    Tasks import it by name.  Where it is not installed on the machines, its folder is added to the
    workers' search path; a path that a machine lacks is ignored there.  A worker holds several
    copies of a batch of whole texts, so the batch size sets its memory; a session's own setting stays.
    """
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, key: str, text: str, as_bytes: bool = False) -> DataFrame:
    """Key and text only, so that no other column can clash; a null text becomes empty."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(F.col(f"`{key}`").alias("_key"), (value.cast("binary") if as_bytes else value).alias("_text"))


#: Bytes of text that are split into words at once; as words a text takes about ten times its size.
PIECE_BYTES = 1 << 20


def pieces(frames: Iterator[pd.DataFrame], text: str = "_text", limit: int | None = None) -> Iterator[pd.DataFrame]:
    """The rows of ``frames`` in order, in frames of about ``limit`` bytes of text; a longer text stands alone."""
    for frame in frames:
        for a, b in chunks([len(t) for t in frame[text]], limit or PIECE_BYTES):
            yield frame.iloc[a:b]


def give_back() -> None:
    """Return memory that this process has freed to the system; Arrow and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def released(run):
    """``run`` over a task's batches; when they end, the worker gives back what it no longer uses.

    Workers go on to other tasks and stages, and what each of them left would add up.
    """

    def task(batches):
        yield from run(batches)
        give_back()

    return task


def map_keyed(rows: DataFrame, run, columns: str, key: str = "_key") -> DataFrame:
    """``rows.mapInPandas(run)`` with the key first, then ``columns``; the key comes back as it was.

    pandas makes floats of whole numbers beside a null, which lose digits above 2^53, so such keys
    travel as text.
    """
    kind = rows.schema[key].dataType
    sent = rows.withColumn(key, F.col(key).cast("string")) if isinstance(kind, T.IntegralType) else rows
    made = sent.mapInPandas(released(run), f"{key} {sent.schema[key].dataType.simpleString()}, {columns}")
    return made.withColumn(key, F.col(key).cast(kind))


def alnum_words(raw: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters."""
    return raw.translate(WORD_BYTES).split()


def chunks(lengths, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose lengths sum to about ``limit``; a longer single item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (wraps around on purpose)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))

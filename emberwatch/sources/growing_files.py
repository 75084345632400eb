"""Lines of files that grow and rotate, as a streaming data source (``growing_files``).

Spark's own file source takes a file once and never looks at it again.  Log files and alert feeds are
appended to in place, so here the offset of a stream names for every file how far it has been read:

* a file is known by device and inode, so renaming it (rotation) does not read it twice, and lines that
  were added just before the renaming are still read under its new name;
* a file that became shorter than its position, or whose first bytes changed, was cut off and written
  anew: it is read from its start, and of a copy made before that only what had not been read;
* only whole lines are passed on; an unfinished last line waits for its line break;
* the first run begins at the files' ends (``start=end``) or at their starts.  Files that appear later
  are read from their start.

The offset is the cursor and lives in the stream's checkpoint.  Byte ranges of at most ``SPLIT_BYTES``
are read in parallel; a line belongs to the range it starts in.  The folder must be a file system that
driver and executors mount, since only such files can grow.
"""

from __future__ import annotations

import fnmatch
import os
import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SPLIT_BYTES = 64 << 20
#: So many of a file's first bytes tell whether it is still the same text.
HEAD_BYTES = 256
BATCH_LINES = 20_000
SCHEMA = "raw string, source string, path string, position long, modified timestamp"
_ROTATED = re.compile(r"(.+?)(?:[.-]\d+)+")

# workers need not have this package: the source travels with the query
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class FileRange(InputPartition):
    identity: str
    path: str
    base: str
    start: int
    stop: int
    head_bytes: int
    head: int


def identity_of(path: str) -> str:
    found = os.stat(path)
    return f"{found.st_dev}:{found.st_ino}"


def head_of(path: str, size: int) -> int:
    with open(path, "rb") as file:
        return zlib.crc32(file.read(size))


def end_of_lines(path: str, size: int) -> int:
    """The position after the last line break before ``size``."""
    with open(path, "rb") as file:
        end = size
        while end > 0:
            start = max(0, end - 65536)
            file.seek(start)
            at = file.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


def base_name(name: str, pattern: str, names: set[str]) -> str | None:
    """The name a file is tailed under: its own, or the one it had before rotation; None if neither.

    A file that matches the pattern counts as rotated only beside the file it would have been.
    """
    old = _ROTATED.fullmatch(name)
    before = old[1] if old and fnmatch.fnmatch(old[1], pattern) else None
    if fnmatch.fnmatch(name, pattern):
        return before if before in names else name
    return before


class GrowingFilesReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder = options["path"].removeprefix("file://")
        self.pattern = options.get("pattern", "*")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.at_end = options.get("start", "beginning").lower() == "end"
        self.strict = options.get("failOnDataLoss", "true").lower() == "true"
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def _files(self) -> Iterator[tuple[str, str]]:
        for folder, below, names in os.walk(self.folder):
            if not self.recursive:
                below.clear()
            present = set(names)
            for name in sorted(names):
                base = None if name.startswith((".", "_")) else base_name(name, self.pattern, present)
                if base is not None:
                    yield os.path.join(folder, name), base

    def _now(self) -> dict:
        found = {}
        for path, base in self._files():
            try:
                end = end_of_lines(path, os.stat(path).st_size)
                known = min(end, HEAD_BYTES)
                found[identity_of(path)] = {"path": path, "base": base, "end": end, "known": known, "head": head_of(path, known)}
            except FileNotFoundError:  # rotated away just now; the next look finds its new name
                continue
        return found

    def initialOffset(self) -> dict:
        return {"files": self._now() if self.at_end else {}}

    def latestOffset(self) -> dict:
        return {"files": self._now()}

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        found = []
        by_path = {old["path"]: old for old in start["files"].values()}
        for identity, now in end["files"].items():
            old, at = start["files"].get(identity), 0
            if old is None:
                twin = by_path.get(os.path.join(os.path.dirname(now["path"]), now["base"]))
                if twin and os.path.basename(now["path"]) != now["base"] and self._continues(identity, now, twin):
                    at = twin["end"]  # a copy of a followed file that is emptied in its place
            elif self._continues(identity, now, old):
                at = old["end"]
            while at < now["end"]:
                stop = min(now["end"], at + self.split)
                found.append(FileRange(identity, now["path"], (old or now)["base"], at, stop, now["known"], now["head"]))
                at = stop
        return found

    @staticmethod
    def _continues(identity: str, now: dict, old: dict) -> bool:
        """Whether the file still begins with what was read of it under ``old``."""
        if now["end"] < old["end"]:
            return False
        if old["known"] == now["known"]:
            return old["head"] == now["head"]
        path = _located(now["path"], identity)
        return path is None or head_of(path, old["known"]) == old["head"]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        path = _located(partition.path, partition.identity)
        if path is None or head_of(path, partition.head_bytes) != partition.head:
            if self.strict:
                raise FileNotFoundError(f"lines of {partition.path} are gone; set failOnDataLoss to false to go on without them")
            return
        source = os.path.splitext(partition.base)[0]
        with open(path, "rb") as file:
            modified = datetime.fromtimestamp(os.fstat(file.fileno()).st_mtime, UTC)
            at = partition.start
            file.seek(max(at - 1, 0))
            if at and file.read(1) != b"\n":
                at += len(file.readline())  # began in the range before
            raws, places = [], []
            while at < partition.stop:
                line = file.readline()
                if not line:
                    break
                text = line.decode("utf-8", "replace").strip()
                if text:
                    raws.append(text)
                    places.append(at)
                at += len(line)
                if len(raws) >= BATCH_LINES:
                    yield _batch(raws, source, partition.path, places, modified)
                    raws, places = [], []
            if raws:
                yield _batch(raws, source, partition.path, places, modified)

    def commit(self, end: dict) -> None:
        """Nothing to release: files belong to whoever writes them."""


def _located(path: str, identity: str) -> str | None:
    """Where the file is now: at ``path``, or beside it under another name."""
    try:
        if identity_of(path) == identity:
            return path
    except FileNotFoundError:
        pass
    folder = os.path.dirname(path)
    for entry in os.scandir(folder) if os.path.isdir(folder) else ():
        try:
            if entry.is_file() and identity_of(entry.path) == identity:
                return entry.path
        except FileNotFoundError:
            continue
    return None


def _batch(raws, source, path, places, modified) -> pa.RecordBatch:
    n = len(raws)
    return pa.RecordBatch.from_arrays(
        [pa.array(raws), pa.array([source] * n), pa.array([path] * n), pa.array(places, pa.int64()), pa.array([modified] * n, pa.timestamp("us", "UTC"))],
        names=["raw", "source", "path", "position", "modified"],
    )


class GrowingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingFilesReader:
        return GrowingFilesReader(dict(self.options))


def read_stream(
    spark: SparkSession,
    path: str,
    pattern: str = "*",
    start: str = "beginning",
    recursive: bool = True,
    fail_on_data_loss: bool = True,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Non-blank lines of a folder's files as they grow: raw, source, path, position, modified.

    ``source`` is the name without its extension, that of a rotated file's former name; ``position`` is
    the line's first byte.  ``start`` says where files that exist at the first run begin.
    """
    spark.dataSource.register(GrowingFiles)
    reader = spark.readStream.format("growing_files").option("pattern", pattern).option("start", start)
    reader = reader.option("recursive", str(recursive).lower()).option("failOnDataLoss", str(fail_on_data_loss).lower())
    return reader.option("splitBytes", str(split_bytes)).load(path)

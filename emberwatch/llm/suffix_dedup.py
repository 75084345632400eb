"""Removal of repeated byte strings by blockwise suffix sorting over a cover sample.

Every string of LENGTH bytes counts that also starts elsewhere.  A full suffix array of the corpus
would need a record for every byte.  Two ideas of blockwise construction avoid that:

*Cover sample.*  A few positions are sampled so that any two equal strings hold sampled positions
at the same offset.  The sample is taken by content (the least hash of all short strings inside),
which keeps 2 in 82 positions; a periodic difference cover with this property keeps about 12 in 133.
The position in a string that decides is its suffix bucket.

*Ranks of the sample resolve ties.*  Sample positions are ranked first, by identity classes of
the short string and of the whole stretch of text that shares a bucket.  A stretch that occurs
twice is settled for all its strings at once, one whose sample is unique has no equal, and
only the strings of the stretches in between are sorted themselves, block after block.

Blocks are ranges of the hashed order.  Texts are kept in batches in a table bucketed by batch,
so they are never shuffled again; only fixed-size records travel.  Within a batch equal records
are merged first, so a passage that all documents share adds one record per batch.
"""

from __future__ import annotations

import hashlib
import random
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.llm.common import keyed_text, mix64
from emberwatch.session import fresh_dir, written

LENGTH = 200
#: Bytes of the short strings whose hashes choose the sample.
SEED_BYTES = 120
BATCH_BYTES = 4 << 20
#: Strings handled at once within a batch; a longer text is taken in such parts.
PART = 1 << 17
#: Batches per block of the sorted order.
BATCHES_PER_BLOCK = 4

_DRAW = np.random.default_rng(200)
_BYTE = [mix64(_DRAW.integers(1, 1 << 62, 256, dtype=np.uint64)) | np.uint64(1) for _ in range(2)]
_BASE = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
#: Records: identity of the bucket, of the stretch (two independent hashes), place in the batch, copies (1 or 2).
SAMPLE = np.dtype([("bucket", "<u8"), ("stretch", "<u8"), ("check", "<u4"), ("place", "<u4"), ("copies", "u1")])
STRING = np.dtype([("string", "<u8"), ("check", "<u4"), ("place", "<u4"), ("copies", "u1")])
#: Ranks told to a batch: its strings all repeat; they repeat and are to be shown to others; still open.
SETTLED, SETTLED_SHOWN, OPEN = 1, 2, 3


def _powers(base: int, n: int) -> np.ndarray:
    out, done, step = np.ones(n, np.uint64), 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step % (1 << 64)
    return out


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(which: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _tables:
        n = 2 * PART + LENGTH + 1
        _tables[which] = _powers(_BASE[which], n), _powers(pow(_BASE[which], -1, 1 << 64), n)
    return _tables[which]


class Hashes:
    """Hashes of any substring of a part by differences of prefix sums."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = _power_tables(which)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[which][data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:-size]) * self.down[:n])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, done = keys, 1
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(out) - (width - done)], out[width - done :]) if done < width else out


class Batch:
    """Distinct texts of a batch, their sample and the strings that belong to each sample position."""

    def __init__(self, texts: list[bytes]):
        index: dict[bytes, int] = {}
        self.owner = [index.setdefault(t, len(index)) for t in texts]
        self.texts = list(index)
        copies = np.bincount(self.owner, minlength=len(self.texts)) if texts else np.zeros(0, int)
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.base = np.cumsum(sizes) - sizes
        self.size = int(sizes.sum())
        data = np.frombuffer(b"".join(self.texts), np.uint8)
        made: list[tuple] = []
        self.parts: list[tuple[int, np.ndarray]] = []
        for doc, start, end in self._parts(sizes):
            self._sample(data, doc, start, end, sizes, copies, made)
        columns = [np.concatenate(c) for c in zip(*made, strict=True)] if made else [np.zeros(0, np.uint64)] * 3 + [np.zeros(0, np.int64)] * 4
        #: Per sample record: bucket, stretch, check, first and last string, sampled position, copies of the text.
        self.bucket, self.stretch, self.check, self.first, self.last, self.at, self.copies = columns
        self.data = data

    def _parts(self, sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Ranges of whole short texts, or pieces of a long one: (text, first string, end of the bytes)."""
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if n > PART:
                if total:
                    yield -1, int(self.base[start]), int(self.base[i])
                for s in range(0, int(n) - LENGTH + 1, PART):
                    yield i, int(self.base[i]) + s, int(self.base[i]) + min(int(n), s + PART + LENGTH - 1)
                start, total = i + 1, 0
            elif total + n > PART:
                yield -1, int(self.base[start]), int(self.base[i])
                start, total = i, int(n)
            else:
                total += int(n)
        if total:
            yield -1, int(self.base[start]), self.size

    def _sample(self, data, doc, start, end, sizes, copies, made) -> None:
        own = data[start:end]
        strings = len(own) - LENGTH + 1
        if strings <= 0:
            return
        hashes = Hashes(own, 0)
        seeds = hashes.all(SEED_BYTES)
        keys = (seeds & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(seeds), dtype=np.uint64)
        at = (_least(keys, LENGTH - SEED_BYTES + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if doc >= 0:
            of = np.full(strings, doc)
            inside = np.arange(strings)
        else:
            a, b = np.searchsorted(self.base, [start, end])
            of = np.repeat(np.arange(a, b), sizes[a:b])[:strings]
            inside = np.flatnonzero(np.arange(start, start + strings) + LENGTH <= (self.base + sizes)[of])
        if not len(inside):
            return
        at, of = at[inside], of[inside]
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (of[1:] != of[:-1])])
        first, last = inside[new], inside[np.r_[new[1:], len(inside)] - 1]
        where, text = at[new], of[new]
        offsets = mix64(((where - first).astype(np.uint64) << np.uint64(32)) | (last - where + LENGTH).astype(np.uint64))
        second = Hashes(own, 1)
        made.append(
            (
                seeds[where],
                hashes.of(first, last + LENGTH) ^ offsets,
                second.of(first, last + LENGTH) >> np.uint64(32),
                first + start,
                last + start,
                where + start,
                copies[text],
            )
        )

    def records(self) -> np.ndarray:
        """Sample records with equal ones merged; ``place`` is the first of them."""
        out = np.zeros(len(self.bucket), SAMPLE)
        out["bucket"], out["stretch"], out["check"] = self.bucket, self.stretch, self.check
        out["place"], out["copies"] = np.arange(len(out)), np.minimum(self.copies, 2)
        return _merged(out, ["bucket", "stretch", "check"])

    def ranked(self, place: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Rank of every sample record, merged ones included (0: its bucket is unique)."""
        by_place = np.zeros(len(self.bucket), np.uint8)
        by_place[place] = rank
        names = np.zeros(len(self.bucket), [("a", "<u8"), ("b", "<u8"), ("c", "<u8")])
        names["a"], names["b"], names["c"] = self.bucket, self.stretch, self.check
        _, back = np.unique(names, return_inverse=True)
        best = np.zeros(back.max() + 1 if len(back) else 0, np.uint8)
        np.maximum.at(best, back, by_place)
        return best[back]

    def open_strings(self, ranks: np.ndarray, place: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strings to be compared one by one, and how often each counts."""
        shown = place[rank >= SETTLED_SHOWN]
        low = self.first[shown]
        n = self.last[shown] - low + 1
        starts = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        weight = np.repeat(np.where(ranks[shown] == OPEN, 1, 2), n)
        return starts, weight

    def string_records(self, starts: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Identity of each string, ``place`` being its start."""
        order = np.argsort(starts, kind="stable")
        out = np.zeros(len(starts), STRING)
        out["place"], out["copies"] = starts[order], weight[order]
        i = 0
        while i < len(out):  # hashes part by part over the bytes that are needed
            low = int(out["place"][i])
            j = int(np.searchsorted(out["place"], low + PART))
            own = self.data[low : min(self.size, low + PART + LENGTH)]
            s = out["place"][i:j].astype(np.int64) - low
            out["string"][i:j] = Hashes(own, 0).of(s, s + LENGTH)
            out["check"][i:j] = Hashes(own, 1).of(s, s + LENGTH) >> np.uint64(32)
            i = j
        return out

    def repeated(self, open_records: np.ndarray, told: np.ndarray) -> np.ndarray:
        """Starts of all open strings equal to one that was told to repeat."""
        names = open_records[["string", "check"]].copy()
        _, back = np.unique(names, return_inverse=True)
        hit = np.zeros(back.max() + 1 if len(back) else 0, bool)
        hit[back[np.isin(open_records["place"], told)]] = True
        return open_records["place"][hit[back]].astype(np.int64)

    def results(self, ranks: np.ndarray, repeated: np.ndarray) -> list[tuple[int, int, int, str, bytes]]:
        """Per text of the batch: bytes, removed bytes, removed runs, digest of the rest, the rest."""
        edge = np.zeros(self.size + 1, np.int64)
        settled = (ranks == SETTLED) | (ranks == SETTLED_SHOWN)
        np.add.at(edge, self.first[settled], 1)
        np.add.at(edge, self.last[settled] + LENGTH, -1)
        np.add.at(edge, repeated, 1)
        np.add.at(edge, repeated + LENGTH, -1)
        gone = np.cumsum(edge)[:-1] > 0
        found = []
        for base, text in zip(self.base, self.texts, strict=True):
            own = gone[base : base + len(text)]
            removed = int(own.sum())
            runs = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
            rest = text if not removed else self.data[base : base + len(text)][~own].tobytes()
            found.append((len(text), removed, runs, hashlib.sha256(rest).hexdigest(), rest))
        return [found[i] for i in self.owner]


def _merged(records: np.ndarray, names: list[str]) -> np.ndarray:
    """Equal records as one, with the first place and up to two copies."""
    if not len(records):
        return records
    order = np.lexsort([records["place"]] + [records[n] for n in reversed(names)])
    own = records[order]
    new = np.r_[True, np.any([own[n][1:] != own[n][:-1] for n in names], axis=0)]
    starts = np.flatnonzero(new)
    out = own[starts]
    out["copies"] = np.minimum(np.add.reduceat(own["copies"].astype(np.int64), starts), 2)
    return out


def _by_block(records: np.ndarray, name: str, blocks: int) -> Iterator[tuple[int, bytes]]:
    # Buckets are named by least hashes, which crowd near zero, so names are hashed again.
    block = ((mix64(records[name]) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    edges = np.searchsorted(block[order], np.arange(blocks + 1))
    for b in range(blocks):
        if edges[b + 1] > edges[b]:
            yield b, records[order[edges[b] : edges[b + 1]]].tobytes()


def _block_records(frame: pd.DataFrame, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(r, kind) for r in frame["records"]]
    return np.concatenate(parts), np.repeat(frame["batch"].to_numpy(np.int64), [len(p) for p in parts])


def _to_batches(batch: np.ndarray, place: np.ndarray, rank: np.ndarray) -> pd.DataFrame:
    order = np.argsort(batch, kind="stable")
    names, starts = np.unique(batch[order], return_index=True)
    edges = np.r_[starts, len(order)]
    rows = [(int(n), place[order[a:b]].astype("<u4").tobytes(), rank[order[a:b]].astype("u1").tobytes()) for n, a, b in zip(names, edges, edges[1:], strict=False)]
    return pd.DataFrame(rows, columns=["batch", "places", "ranks"])


def rank_samples(frame: pd.DataFrame) -> pd.DataFrame:
    """Sort one block of sample records and tell each batch the ranks of its repeated ones."""
    own, batch = _block_records(frame, SAMPLE)
    order = np.lexsort((own["check"], own["stretch"], own["bucket"]))
    own, batch = own[order], batch[order]
    new_bucket = np.r_[True, own["bucket"][1:] != own["bucket"][:-1]]
    new = new_bucket | np.r_[True, (own["stretch"][1:] != own["stretch"][:-1]) | (own["check"][1:] != own["check"][:-1])]
    bucket, stretch = np.cumsum(new_bucket) - 1, np.cumsum(new) - 1
    repeated = np.bincount(bucket, own["copies"])[bucket] > 1
    settled = np.bincount(stretch, own["copies"])[stretch] > 1
    has_open = np.bincount(bucket, ~settled)[bucket] > 0
    rank = np.where(settled, np.where(has_open & new, SETTLED_SHOWN, SETTLED), OPEN)
    return _to_batches(batch[repeated], own["place"][repeated], rank[repeated])


def repeated_strings(frame: pd.DataFrame) -> pd.DataFrame:
    """Sort one block of strings and tell each batch which of its own occur elsewhere."""
    own, batch = _block_records(frame, STRING)
    order = np.lexsort((own["check"], own["string"]))
    own, batch = own[order], batch[order]
    new = np.r_[True, (own["string"][1:] != own["string"][:-1]) | (own["check"][1:] != own["check"][:-1])]
    same = np.cumsum(new) - 1
    repeated = np.bincount(same, own["copies"])[same] > 1
    return _to_batches(batch[repeated], own["place"][repeated], np.zeros(repeated.sum(), np.uint8))


def _joined(replies: pd.DataFrame, step: int) -> tuple[np.ndarray, np.ndarray]:
    own = replies[replies["step"] == step]
    places = [np.frombuffer(p, "<u4") for p in own["places"]]
    ranks = [np.frombuffer(r, "u1") for r in own["ranks"]]
    none = np.zeros(0, np.int64)
    return (np.concatenate(places).astype(np.int64), np.concatenate(ranks)) if places else (none, none.astype(np.uint8))


def batched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Texts in batches of about BATCH_BYTES, written as a table bucketed by batch; whole-number keys as text."""
    spark = docs.sparkSession
    rows = keyed_text(docs, key, text, as_bytes=True)
    if isinstance(rows.schema["_key"].dataType, T.IntegralType):
        # pandas would make floats of whole numbers beside a null
        rows = rows.withColumn("_key", F.col("_key").cast("string"))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, filled, place = random.SystemRandom().getrandbits(62), 0, 0
        for frame in frames:
            batch, row = [], []
            for raw in frame["_text"]:
                if filled and filled + len(raw) > BATCH_BYTES:
                    number, filled, place = random.SystemRandom().getrandbits(62), 0, 0
                batch.append(number)
                row.append(place)
                filled, place = filled + len(raw) + 1, place + 1
            yield frame.assign(batch=batch, row=row)

    made = rows.mapInPandas(run, f"_key {kind}, _text binary, batch long, row int")
    name = f"suffix_batches_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.bucketBy(parts, "batch").option("path", fresh_dir(spark, "suffix-batches")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """Per row: key, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked for, ``kept`` (the bytes left).

    A byte goes if any LENGTH-byte string over it also starts elsewhere, in the same text or another;
    strings are judged on the input.  Null and empty texts have no bytes; repeated rows are repeats
    like any other; null keys pass through.  Strings count as equal by 96 bits of hash.
    """
    rows = batched(docs, key, text)
    kind = rows.schema["_key"].dataType.simpleString()
    batches = rows.select("batch").distinct().count()
    blocks = max(1, -(-batches // BATCHES_PER_BLOCK))

    def load(frame: pd.DataFrame) -> Batch:
        return Batch(list(frame.sort_values("row")["_text"]))

    def samples(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["batch"].iloc[0])
        out = [(b, number, r) for b, r in _by_block(load(frame).records(), "bucket", blocks)]
        return pd.DataFrame(out, columns=["block", "batch", "records"])

    def strings(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(frame) and len(replies):
            place, rank = _joined(replies, 1)
            if (rank >= SETTLED_SHOWN).any():
                batch = load(frame)
                starts, weight = batch.open_strings(batch.ranked(place, rank), place, rank)
                number = int(frame["batch"].iloc[0])
                out = [(b, number, r) for b, r in _by_block(_merged(batch.string_records(starts, weight), ["string", "check"]), "string", blocks)]
        return pd.DataFrame(out, columns=["block", "batch", "records"])

    def results(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        names = ["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        if not len(frame):
            return pd.DataFrame(columns=names)
        frame = frame.sort_values("row")
        batch = load(frame)
        place, rank = _joined(replies, 1)
        ranks = batch.ranked(place, rank)
        strings_open = batch.string_records(*batch.open_strings(ranks, place, rank))
        made = batch.results(ranks, batch.repeated(strings_open, _joined(replies, 2)[0]))
        out = pd.DataFrame(made, columns=names[1:])
        if not keep_text:
            out["kept"] = None
        out.insert(0, "_key", frame["_key"].to_numpy())
        return out

    record_rows = "block int, batch long, records binary"
    reply_rows = "batch long, places binary, ranks binary"
    texts = rows.select("batch", "row", "_text")
    one = texts.groupBy("batch").applyInPandas(samples, record_rows).groupBy("block").applyInPandas(rank_samples, reply_rows)
    one = written(one.withColumn("step", F.lit(1)), "sample-ranks")
    two = texts.groupBy("batch").cogroup(one.groupBy("batch")).applyInPandas(strings, record_rows)
    two = two.groupBy("block").applyInPandas(repeated_strings, reply_rows)
    replies = one.union(written(two.withColumn("step", F.lit(2)), "repeats"))
    schema = f"_key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    found = rows.groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(results, schema)
    found = found.withColumn("_key", F.col("_key").cast(docs.schema[key].dataType)).withColumnRenamed("_key", key)
    return found if keep_text else found.drop("kept")

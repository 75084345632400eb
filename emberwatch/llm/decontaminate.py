"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a run of documents.  Its suffix array orders the word positions whose next words all
occur in the benchmark (no other position can start a match) by the words that follow.  Every
suffix of every test item is looked up by binary search; a hit gives the places of its window, and
the neighbours in the array the longest verbatim match.  Shards are independent: documents are
read once and never shuffled.  Benchmark items reach the shards in blocks of bounded size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.llm.common import alnum_words, chunks, keyed_text, released

WINDOW = 10
#: Text bytes of a shard whose array is built at once, and of a benchmark block sent to the tasks.
SHARD_BYTES, BLOCK_BYTES = 1 << 21, 1 << 23


class Block:
    """Test suffixes of some benchmark items, as word ranks in one vocabulary."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        words = [alnum_words(text) for _, text in items]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for x in words for w in x}))}
        self.window = window
        #: Suffixes by the number of words that make a window: ``window``, or all words of a shorter item.
        self.depths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        rows: dict[int, list[tuple[list[int], int]]] = {}
        self.items = [key for key, _ in items]
        for i, x in enumerate(words):
            ranks = [self.vocabulary[w] for w in x]
            depth = min(window, len(ranks))
            for s in range(len(ranks) - depth + 1 if depth else 0):
                rows.setdefault(depth, []).append((ranks[s : s + depth], i))
        for depth, found in rows.items():
            windows = np.array([r for r, _ in found], np.int64)
            distinct, back = np.unique(windows, axis=0, return_inverse=True)
            order = np.argsort(back, kind="stable")
            owners = np.array([i for _, i in found])[order]
            starts = np.searchsorted(back[order], np.arange(len(distinct) + 1))
            self.depths[depth] = (distinct, owners, starts)
        self.texts = [np.array([self.vocabulary[w] for w in x], np.int64) for x in words]


def packed(columns: np.ndarray, size: int) -> np.ndarray:
    """Rows of word ranks as byte strings that sort like the rows."""
    kind = ">u2" if size < 1 << 16 else ">u4"
    rows = np.ascontiguousarray(columns.astype(kind))
    return rows.view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel()


class Shard:
    """Concatenated words of some documents, as ranks (0: not in the benchmark)."""

    def __init__(self, texts: list[bytes], block: Block):
        words = [alnum_words(t) for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        rank = block.vocabulary.get
        self.ranks = np.fromiter((rank(w, 0) for x in words for w in x), np.int64, int(self.sizes.sum()))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.block = block

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, depth and window number (within its depth) of every window that occurs."""
        n = len(self.ranks)
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        ends = (self.first + self.sizes)[doc] if n else np.zeros(0, np.int64)
        # Words from here on that all are in the benchmark: no longer match can start here.
        gaps = np.append(np.flatnonzero(self.ranks == 0), n)
        reach = np.minimum(ends, gaps[np.searchsorted(gaps, np.arange(n))]) - np.arange(n)
        out = []
        for depth, (windows, _, _) in self.block.depths.items():
            starts = np.flatnonzero(reach >= depth)
            first_words = np.zeros(len(self.block.vocabulary) + 1, bool)
            first_words[windows[:, 0]] = True
            starts = starts[first_words[self.ranks[starts]]]
            if not len(starts):
                continue
            suffixes = packed(self.ranks[starts[:, None] + np.arange(depth)], len(self.block.vocabulary))
            tests = packed(windows, len(self.block.vocabulary))
            names = bytes_of(suffixes), bytes_of(tests)
            order = np.argsort(names[0], kind="stable")
            array = names[0][order]
            low = np.searchsorted(array, names[1], side="left")
            high = np.searchsorted(array, names[1], side="right")
            for w in np.flatnonzero(high > low):
                at = starts[order[low[w] : high[w]]]
                out.append((at, np.full(len(at), depth), np.full(len(at), w)))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def longest(self, start: int, item: int, depth: int) -> int:
        """Words of the verbatim match of this place with the item, at the item's best position."""
        d = int(np.searchsorted(self.first + self.sizes, start, side="right"))
        mine, its = self.ranks[start : self.first[d] + self.sizes[d]], self.block.texts[item]
        best = depth
        for s in np.flatnonzero(its[: len(its) - depth + 1] == mine[0]):
            m = min(len(mine), len(its) - s)
            differ = np.flatnonzero(mine[:m] != its[s : s + m])
            best = max(best, int(differ[0]) if len(differ) else m)
        return best

    def results(self) -> list[tuple[int, list[list[int]], list[str], list[dict]]]:
        """Per document: words, runs of words inside windows, items, and matched runs by item."""
        start, depth, window = self.hits()
        out = [(int(n), [], [], []) for n in self.sizes]
        if not len(start):
            return out
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)[start]
        order = np.lexsort((start, owner))
        for d in np.unique(owner):
            mine = order[np.searchsorted(owner[order], d, "left") : np.searchsorted(owner[order], d, "right")]
            a = self.first[d]
            items, runs = set(), {}
            for k in mine:
                _, owners, starts = self.block.depths[int(depth[k])]
                for i in owners[starts[window[k]] : starts[window[k] + 1]]:
                    i = int(i)
                    items.add(i)
                    run = runs.get(i)
                    if run and start[k] <= run[-1][1]:
                        run[-1][1] = max(run[-1][1], int(start[k] + depth[k]))
                    else:
                        runs.setdefault(i, []).append([int(start[k]), int(start[k] + depth[k]), int(depth[k])])
            names = [self.block.items[i] for i in items]
            hit = [[r[0] - int(a), r[1] - int(a)] for found in runs.values() for r in found]
            matches = [
                {"item": self.block.items[i], "first_word": r[0] - int(a), "last_word": r[1] - 1 - int(a), "longest": self.longest(r[0], i, r[2])}
                for i in sorted(runs)
                for r in runs[i]
            ]
            out[d] = (int(self.sizes[d]), hit, names, matches)
        return out


def bytes_of(rows: np.ndarray) -> np.ndarray:
    """Void rows as fixed byte strings: they compare like the rows, since no rank is zero."""
    return rows.view(f"S{rows.dtype.itemsize}")


def benchmark_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of about BLOCK_BYTES, fetched partition by partition."""
    rows = keyed_text(items, key, text, as_bytes=True)
    rows = rows.select(F.coalesce(F.col("_key").cast("string"), F.lit("")).alias("_key"), "_text")
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r["_key"], bytes(r["_text"])))
        size += len(r["_text"])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def merged(runs: list[list[int]]) -> list[dict]:
    """Union of runs of words, ends exclusive."""
    out: list[dict] = []
    for start, end in sorted(runs):
        if out and start <= out[-1]["start"] + out[-1]["words"]:
            out[-1]["words"] = max(out[-1]["words"], end - out[-1]["start"])
        else:
            out.append({"start": start, "words": end - start})
    return out


def searched(rows: DataFrame, block: list[tuple[str, bytes]], window: int) -> DataFrame:
    """``rows`` with the hits of one block of items added."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(Block(block, window)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tests = pickle.loads(shared.value)
        for frame in frames:
            texts = list(frame["_text"])
            found = [r for a, b in chunks([len(t) for t in texts], SHARD_BYTES) for r in Shard(texts[a:b], tests).results()]
            old = zip(frame["_runs"], frame["items"], frame["matches"], strict=True)
            runs, items, matches = [], [], []
            for (_, new_runs, new_items, new_matches), (o_runs, o_items, o_matches) in zip(found, old, strict=True):
                runs.append(merged(new_runs + [[r["start"], r["start"] + r["words"]] for r in o_runs]))
                items.append(sorted({*new_items, *o_items}))
                matches.append(new_matches + list(o_matches))
            yield frame.assign(n_words=[f[0] for f in found], _runs=runs, items=items, matches=matches)

    return rows.mapInPandas(run, rows.schema)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Per document row: key, ``n_words``, ``n_hit``, ``items`` and ``matches``.

    ``n_hit`` counts the words inside occurrences of a window of ``window`` consecutive item words
    (all words of a shorter item), ``items`` holds the ids of the items with occurring windows,
    sorted as strings, and ``matches`` the places with the length of the longest verbatim match.
    Null and empty texts have no words; an item without words has no window; an item without id
    goes by the empty id.  Document rows are independent, repeated ones and null keys included.
    """
    rows = keyed_text(docs, key, text, as_bytes=True)
    kind = rows.schema["_key"].dataType
    state = rows.select(
        # pandas would make floats of whole numbers beside a null
        (F.col("_key").cast("string") if isinstance(kind, T.IntegralType) else F.col("_key")).alias("_key"),
        "_text",
        F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("array<struct<start: long, words: long>>").alias("_runs"),
        F.lit(None).cast("array<string>").alias("items"),
        F.lit(None).cast("array<struct<item: string, first_word: long, last_word: long, longest: long>>").alias("matches"),
    )
    state = state.withColumns({c: F.coalesce(c, F.array().cast(state.schema[c].dataType)) for c in ("_runs", "items", "matches")})
    for block in list(benchmark_blocks(benchmark, item_key, item_text)) or [[]]:
        state = searched(state, block, window)
    n_hit = F.aggregate("_runs", F.lit(0).cast("long"), lambda n, r: n + r["words"])
    return state.select(F.col("_key").cast(kind).alias(key), "n_words", n_hit.alias("n_hit"), "items", "matches")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """The document rows, all columns, in which no benchmark window occurs."""
    at = docs.columns.index(text)
    out = docs
    for block in list(benchmark_blocks(benchmark, item_key, item_text)) or [[]]:
        out = without_hits(out, block, at, window)
    return out


def without_hits(docs: DataFrame, block: list[tuple[str, bytes]], at: int, window: int) -> DataFrame:
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(Block(block, window)))

    def run(batches):
        tests = pickle.loads(shared.value)
        for batch in batches:
            texts = [t.encode() if t else b"" for t in batch.column(at).to_pylist()]
            clean = [not r[1] for a, b in chunks([len(t) for t in texts], SHARD_BYTES) for r in Shard(texts[a:b], tests).results()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)

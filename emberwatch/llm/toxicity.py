"""Toxicity by a convolutional text classifier trained in numpy tasks over all labelled rows.

A word enters as the sum of two hashed embeddings, one of the whole word and one of its first
letters, so unseen endings of a known stem still count.  Filters of several widths slide over
the words, each keeps its maximum over the whole text, and a logistic unit joins them.  A
threshold for each language is fitted on rows kept out of the training; the language is read
off the text by its common words, never from a column.  A score of 0.5 is that threshold.

Training goes in rounds.  The labelled rows lie in shards of fixed content; in a round every shard
takes its own gradient steps from the common model, and Spark averages what they changed.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import WORD_BYTES, chunks, keyed_text, map_keyed, released

#: Labelled rows to a shard, until so many shards exist; beyond, shards grow.
SHARD_ROWS, MOST_SHARDS = 6_000, 64
#: Rows and words that a shard holds at once; batches are made among them.
WINDOW_ROWS, WINDOW_WORDS = 6_000, 4_000_000
#: Embedding rows that are averaged in one group.
BLOCK = 2_048
#: Bits of the filter of labelled keys, and of one of its rows (fixed by Spark's bitmap functions).
FILTER_BITS, BITMAP_BITS = 1 << 26, 1 << 15
BUCKETS = 1 << 18
STEM_BYTES = 4
DIM, FILTERS, WIDTHS = 12, 6, (1, 2, 3)
EPOCHS, BATCH, RATE, DECAY = 5, 48, 0.08, 1e-6
#: Few rows are gone through more often, for at least so many steps in all.
LEAST_STEPS = 400
#: A bucket gets an embedding if so many training texts have it; all others share a zero vector.
LEAST_TEXTS = 3
#: Languages with fewer calibration texts of either class take the threshold of all languages.
LEAST_CALIBRATION = 15
CALIBRATION_SHARE = 4  # one in so many labelled rows
#: With more calibration rows than this their logits are counted in steps of 1 / LOGIT_STEPS.
EXACT_LOGITS, LOGIT_STEPS = 100_000, 4_096
#: Text bytes that are split into words and scored at once, and words whose table rows are held at once.
BYTES_AT_ONCE, WORDS_AT_ONCE = 400_000, 4_096
#: Words of more bytes are hashed one by one.
LONG_WORD = 64

#: Common words by which a text's language is told (fixed values, of at most five bytes each).
COMMON = {
    "en": "the of and to in is that it for as with on be by this are from at which was".split(),
    "fr": "le les des du et en une est que qui dans pour par sur au aux avec elle ce pas".split(),
    "de": "der die das und ist nicht von zu mit den dem ein eine auf für im sich auch des".split(),
    "es": "el los las y en del se por con no una su para es al lo como más pero".split(),
}
LANGUAGES = ["", *COMMON]


#: zlib's crc32 as a table of single bytes, and what another start (77) changes in the crc32 of so many bytes.
CRC = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
STEM_START = np.array([zlib.crc32(bytes(n), 77) ^ zlib.crc32(bytes(n)) for n in range(STEM_BYTES + 1)], np.uint32)


class Words:
    """The words of some texts, all hashed together: ``whole`` is the crc32 of each, ``stem`` that of its first bytes."""

    def __init__(self, texts: list[bytes]):
        raw = b" ".join(texts).translate(WORD_BYTES)
        data = np.frombuffer(raw, np.uint8)
        letter = np.zeros(len(data) + 2, bool)
        np.not_equal(data, 32, out=letter[1:-1])
        edges = np.flatnonzero(letter[1:] != letter[:-1])
        start, end = edges[::2], edges[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        #: Number of words of each text.
        self.sizes = np.diff(np.searchsorted(start, ends), prepend=0)
        self.bytes = np.minimum(end - start, LONG_WORD + 1).astype(np.uint8)
        self.first = data[start]
        # Longer words first: those with another byte to take in are the first so many.
        order = np.argsort(LONG_WORD + 1 - self.bytes, kind="stable")
        longer = len(order) - np.cumsum(np.bincount(self.bytes, minlength=LONG_WORD + 2))
        at, state, stem = start[order], np.full(len(order), 0xFFFFFFFF, np.uint32), None
        for k, n in enumerate(longer[:LONG_WORD]):
            if k == STEM_BYTES:
                stem = state.copy()
            if not n:
                break
            own = state[:n]
            step = CRC[(own ^ data[at[:n]]).astype(np.uint8)]
            own >>= np.uint32(8)
            own ^= step
            at[:n] += 1
        state ^= np.uint32(0xFFFFFFFF)
        for i in range(longer[LONG_WORD]):
            state[i] = zlib.crc32(raw[start[order[i]] : end[order[i]]])
        self.whole, self.stem = np.empty_like(state), np.empty_like(state)
        self.whole[order] = state
        self.stem[order] = state if stem is None else stem ^ np.uint32(0xFFFFFFFF)
        self.stem ^= STEM_START[np.minimum(self.bytes, STEM_BYTES)]

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash buckets of whole words and of their stems."""
        return self.whole % np.uint32(BUCKETS), self.stem % np.uint32(BUCKETS)

    def languages(self) -> np.ndarray:
        """Number of the language that has the word among its common ones, or 0.

        Words of at most five bytes with equal crc32, length and first byte are equal.
        """
        near = COMMON_AT[self.whole % np.uint32(COMMON_SLOTS)]
        same = (COMMON_CRC[near] == self.whole) & (COMMON_BYTES[near] == self.bytes) & (COMMON_FIRST[near] == self.first)
        return np.where(same, COMMON_LANGUAGE[near], 0)


COMMON_SLOTS = 1 << 18
_common = {w.encode(): i for i, name in enumerate(LANGUAGES) for w in COMMON.get(name, ())}
COMMON_CRC = np.array([0, *map(zlib.crc32, _common)], np.uint32)
COMMON_BYTES = np.array([0, *map(len, _common)], np.uint8)
COMMON_FIRST = np.array([0, *(w[0] for w in _common)], np.uint8)
COMMON_LANGUAGE = np.array([0, *_common.values()], np.uint8)
COMMON_AT = np.zeros(COMMON_SLOTS, np.uint8)
COMMON_AT[COMMON_CRC[1:] % np.uint32(COMMON_SLOTS)] = np.arange(1, len(COMMON_CRC))


class Model:
    """Embedding rows, filters and thresholds; small and of a size set by the parameters above."""

    def __init__(self, whole: list[np.ndarray], stems: list[np.ndarray], seed: int = 7):
        self._begin(rows_of(whole), rows_of(stems), seed)

    @classmethod
    def of_rows(cls, whole: tuple[np.ndarray, int], stems: tuple[np.ndarray, int], seed: int = 7) -> Model:
        """A model whose embedding rows are given as by ``rows_of``."""
        model = cls.__new__(cls)
        model._begin(whole, stems, seed)
        return model

    def _begin(self, whole: tuple[np.ndarray, int], stems: tuple[np.ndarray, int], seed: int) -> None:
        draw = np.random.default_rng(seed)
        (self.rows_whole, n_whole), (self.rows_stem, n_stem) = whole, stems
        self.e_whole = draw.normal(0, 0.1, (n_whole, DIM)).astype(np.float32)
        self.e_stem = draw.normal(0, 0.1, (n_stem, DIM)).astype(np.float32)
        self.e_whole[0] = self.e_stem[0] = 0
        self.filters = [draw.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = draw.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(0)
        self.thresholds = np.zeros(len(LANGUAGES))

    def epoch(self, seen: Seen, whole, stems, labels: np.ndarray, weights: np.ndarray, rate: float, draw) -> None:
        """Adaptive gradient steps on small batches, once over the rows; gradients pass through the maxima only."""
        # Texts of like length share a batch, so one long text does not set the size of many.
        order = np.argsort([len(x) for x in whole], kind="stable")
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for b in draw.permutation(len(batches)):
            batch = batches[b]
            sizes = np.array([len(whole[i]) for i in batch])
            ids_w, ids_s = np.concatenate([whole[i] for i in batch]), np.concatenate([stems[i] for i in batch])
            x = self.e_whole.take(ids_w, axis=0)
            x += self.e_stem.take(ids_s, axis=0)
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            pooled = np.zeros((len(batch), len(self.out)), np.float32)
            where = np.full((len(batch), len(self.out)), -1)
            for k, w in enumerate(WIDTHS):
                if len(x) < w:
                    continue
                c = x[: len(x) - w + 1] @ self.filters[k][0]
                for j in range(1, w):
                    c += x[j : len(x) - w + 1 + j] @ self.filters[k][j]
                c += self.shift[k]
                for r, (s, n) in enumerate(zip(starts, sizes, strict=True)):
                    if n >= w:
                        own = c[s : s + n - w + 1]
                        at = own.argmax(0)
                        top = own[at, np.arange(FILTERS)]
                        cols = slice(k * FILTERS, (k + 1) * FILTERS)
                        pooled[r, cols] = np.maximum(top, 0)
                        where[r, cols] = np.where(top > 0, s + at, -1)
            p = 1 / (1 + np.exp(-(pooled @ self.out + self.bias)))
            g = ((p - labels[batch]) * weights[batch] / len(batch)).astype(np.float32)
            g_pool = g[:, None] * self.out[None, :]
            g_out = g @ pooled + DECAY * self.out
            ids, grads = [], []
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                r, f = np.nonzero(where[:, cols] >= 0)
                at, gg = where[:, cols][r, f], g_pool[:, cols][r, f]
                g_f = np.zeros_like(self.filters[k])
                for j in range(w):
                    np.add.at(g_f[j].T, f, gg[:, None] * x[at + j])
                    ids.append(at + j)
                    grads.append(gg[:, None] * self.filters[k][j].T[f])
                g_b = np.bincount(f, gg, FILTERS).astype(np.float32)
                seen.filters[k] += g_f**2
                self.filters[k] -= rate * g_f / np.sqrt(seen.filters[k])
                seen.shift[k] += g_b**2
                self.shift[k] -= rate * g_b / np.sqrt(seen.shift[k])
            at, grad = np.concatenate(ids), np.concatenate(grads)
            for known, table, own in ((seen.e_whole, self.e_whole, ids_w[at]), (seen.e_stem, self.e_stem, ids_s[at])):
                rows, back = np.unique(own, return_inverse=True)
                total = np.zeros((len(rows), DIM), np.float32)
                np.add.at(total, back, grad)
                total[rows == 0] = 0
                known[rows] += total**2
                table[rows] -= rate * total / np.sqrt(known[rows])
            seen.out += g_out**2
            self.out -= rate * g_out / np.sqrt(seen.out)
            seen.bias += g.sum() ** 2
            self.bias -= np.float32(rate * g.sum() / np.sqrt(seen.bias))

    def parts(self, seen: Seen) -> dict[str, np.ndarray]:
        """All that training changes, with the squares seen, as rows that can be averaged one by one."""
        one = [*self.filters, *self.shift, self.out, self.bias, *seen.filters, *seen.shift, seen.out, seen.bias]
        return {
            "whole": np.hstack([self.e_whole, seen.e_whole]),
            "stem": np.hstack([self.e_stem, seen.e_stem]),
            "one": np.concatenate([np.ravel(x) for x in one]).astype(np.float32)[None, :],
        }

    def take(self, seen: Seen, part: str, rows: np.ndarray, values: np.ndarray) -> None:
        """Put rows of ``parts`` in their places."""
        if part != "one":
            table, known = (self.e_whole, seen.e_whole) if part == "whole" else (self.e_stem, seen.e_stem)
            table[rows], known[rows] = values[:, :DIM], values[:, DIM:]
            return
        flat, at = values[0], 0
        for own in (self, seen):
            for x in [*own.filters, *own.shift, own.out]:
                x[...] = flat[at : at + x.size].reshape(x.shape)
                at += x.size
            own.bias = type(own.bias)(flat[at])
            at += 1

    def tables(self) -> Tables:
        return Tables(self)


class Seen:
    """Sums of squared gradients, shaped like the model."""

    def __init__(self, model: Model):
        self.e_whole, self.e_stem, self.out = (np.full_like(x, 1e-6) for x in (model.e_whole, model.e_stem, model.out))
        self.filters = [np.full_like(f, 1e-6) for f in model.filters]
        self.shift = [np.full_like(b, 1e-6) for b in model.shift]
        self.bias = 1e-6


class Tables:
    """What every word adds to every filter at every place in its window, worked out once."""

    def __init__(self, model: Model):
        flat = np.concatenate([f.transpose(1, 0, 2).reshape(DIM, -1) for f in model.filters], axis=1)
        # Columns by place in the window, and for each place the filters that reach it, the widest last.
        begin = np.cumsum([0, *WIDTHS])
        places = [begin[k] + j for j in range(WIDTHS[-1]) for k, w in enumerate(WIDTHS) if w > j]
        columns = np.concatenate([np.arange(p * FILTERS, (p + 1) * FILTERS) for p in places])
        self.whole, self.stem = (model.e_whole @ flat)[:, columns], (model.e_stem @ flat)[:, columns]
        self.whole, self.stem = np.ascontiguousarray(self.whole), np.ascontiguousarray(self.stem)
        self.shift = np.concatenate(model.shift)
        self.rows_whole, self.rows_stem = model.rows_whole.astype(np.int32), model.rows_stem.astype(np.int32)
        self.model = model

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language of each text."""
        logits, languages = [], []
        for a, b in chunks([len(t) for t in texts], BYTES_AT_ONCE):
            one, two = self._some(Words(texts[a:b]))
            logits.append(one)
            languages.append(two)
        return (np.concatenate(logits), np.concatenate(languages)) if logits else (np.zeros(0), np.zeros(0, int))

    def _some(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        model, sizes = self.model, words.sizes
        doc = np.repeat(np.arange(len(sizes)), sizes)
        counts = np.bincount(doc * len(LANGUAGES) + words.languages(), minlength=len(sizes) * len(LANGUAGES))
        counts = counts.reshape(len(sizes), len(LANGUAGES))
        counts[:, 0] = 0
        pooled = np.zeros((len(sizes), len(model.out)), np.float32)
        whole, stem = words.buckets()
        whole, stem = self.rows_whole[whole], self.rows_stem[stem]
        for a in range(0, len(doc), WORDS_AT_ONCE):
            own = doc[a : a + WORDS_AT_ONCE]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            found = np.maximum.reduceat(self._windows(whole, stem, doc, a, len(own)), first, axis=0)
            pooled[own[first]] = np.maximum(pooled[own[first]], found)
        return (pooled @ model.out + model.bias).astype(np.float64), counts.argmax(1)

    def _windows(self, whole: np.ndarray, stem: np.ndarray, doc: np.ndarray, a: int, n: int) -> np.ndarray:
        """All filters at ``n`` words from the ``a``-th; windows over the end of a text count for none."""
        reach = slice(a, a + n + WIDTHS[-1] - 1)
        by_whole, by_stem, own = self.whole.take(whole[reach], axis=0), self.stem.take(stem[reach], axis=0), doc[reach]
        columns = len(self.shift)
        total = by_whole[:n, :columns] + by_stem[:n, :columns]
        at = columns
        for j in range(1, WIDTHS[-1]):
            more = columns - FILTERS * sum(w <= j for w in WIDTHS)
            m = min(n, len(own) - j)
            total[:m, -more:] += by_whole[j : j + m, at : at + more]
            total[:m, -more:] += by_stem[j : j + m, at : at + more]
            at += more
        total += self.shift
        for j in range(1, WIDTHS[-1]):
            m = min(n, len(own) - j)
            over = np.r_[np.flatnonzero(own[:m] != own[j : j + m]), np.arange(m, n)]
            total[over, FILTERS * sum(w <= j for w in WIDTHS) :] = 0
        return total

    def scores(self, texts: list[bytes]) -> np.ndarray:
        logits, languages = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip(logits - self.model.thresholds[languages], -30, 30)))


def rows_of(ids: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Embedding row of each bucket (0: none) and the number of rows."""
    texts = np.zeros(BUCKETS, np.int64)
    for x in ids:
        texts[np.unique(x)] += 1
    return rows_for(texts)


def rows_for(texts: np.ndarray) -> tuple[np.ndarray, int]:
    """The same from the number of texts that have each bucket."""
    rows = np.zeros(BUCKETS, np.int64)
    kept = np.flatnonzero(texts >= LEAST_TEXTS)
    rows[kept] = np.arange(1, len(kept) + 1)
    return rows, len(kept) + 1


def best_threshold(logits: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> float:
    """Middle of the widest gap among thresholds of least weighted error; the weights of each logit are given."""
    x, back = np.unique(logits, return_inverse=True)
    y, n = np.bincount(back, positive), np.bincount(back, negative)
    wrong = np.r_[0, np.cumsum(y - n)] + n.sum()
    edges = np.r_[x[0] - 2, x, x[-1] + 2]
    gaps = np.where(wrong <= wrong.min() + 1e-9, np.diff(edges), -1)
    i = gaps.argmax()
    return float((edges[i] + edges[i + 1]) / 2)


def is_held_out(key: str, folds: int, fold: int) -> F.Column:
    """Whether crc32 of the key as text leaves this remainder; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[DataFrame, dict, int]:
    """Every labelled text, packed, in its shard, in an order of its own; weights of the classes; number of shards.

    Labels of one key are merged by their maximum.  A filter of fixed size, one bit to a hash of a key,
    keeps out most texts without a label.  The rest are dealt into the shards by their key as text, together
    with the labels, and meet their label there: a text moves once, and it travels and rests packed.
    """
    one = labels.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max(f"`{label}`").cast("int").alias("_label"))
    one = one.where("_key is not null and _label in (0, 1)")
    kind = docs.schema[key].dataType
    name = F.col("_key").cast(kind).cast("string").alias("_name")
    keys = keyed_text(docs, key, key).select("_key").join(one, "_key").groupBy("_label").agg(F.count("*").alias("n"))
    totals = {r["_label"]: r["n"] for r in one.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    got = {r["_label"]: r["n"] for r in keys.collect()}
    shards = int(min(MOST_SHARDS, max(1, -(-sum(got.values()) // SHARD_ROWS))))

    def slot(rows):
        return rows.withColumn("_slot", F.pmod(F.xxhash64(F.col("_key").cast(kind)), F.lit(FILTER_BITS)))

    bits = slot(one).groupBy(F.expr(f"_slot div {BITMAP_BITS}").alias("_map")).agg(
        F.bitmap_construct_agg(F.col("_slot") % BITMAP_BITS).alias("_bits")
    )
    byte = F.conv(F.hex(F.expr(f"substring(_bits, int(_slot % {BITMAP_BITS} div 8) + 1, 1)")), 16, 10).cast("int")
    rows = slot(keyed_text(docs, key, text, as_bytes=True)).withColumn("_map", F.expr(f"_slot div {BITMAP_BITS}"))
    rows = rows.join(F.broadcast(bits), "_map").where(F.getbit(byte, (F.col("_slot") % 8).cast("int")) == 1)
    rows = rows.select(name, "_text", F.xxhash64("_key", "_text").alias("_order"))
    rows = rows.mapInPandas(released(packed), "_name string, _text binary, _order long")
    rows = rows.unionByName(one.select(name, "_label"), allowMissingColumns=True).repartition(shards, "_name")
    rows = rows.withColumn("_label", F.max("_label").over(Window.partitionBy("_name"))).where("_text is not null and _label is not null")
    rows = rows.select("_label", "_text", "_order", (F.col("_order") % CALIBRATION_SHARE == 0).alias("_calibrate"))
    return rows.sortWithinPartitions("_order"), {c: totals.get(c, 0) / n for c, n in got.items()}, shards


def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows with their texts compressed one by one."""
    for frame in frames:
        yield frame.assign(_text=[zlib.compress(t, 1) for t in frame["_text"]])


def bucket_texts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts each bucket occurs, as whole word and as stem; at most two counts to a bucket."""

    def run(frames):
        texts = np.zeros((2, BUCKETS), np.int64)
        for frame in frames:
            for t in frame["_text"]:
                for kind, ids in enumerate(Words([zlib.decompress(t)]).buckets()):
                    texts[kind][np.unique(ids)] += 1
        at = np.flatnonzero(texts)
        yield pd.DataFrame({"at": at, "n": texts.ravel()[at]})

    counts = rows.mapInPandas(released(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    texts = np.zeros(2 * BUCKETS, np.int64)
    texts[counts["at"].to_numpy(np.int64)] = counts["n"]
    return texts[:BUCKETS], texts[BUCKETS:]


def windows(frames: Iterator[pd.DataFrame], model: Model) -> Iterator[tuple[list, list, np.ndarray]]:
    """Embedding rows of the words of consecutive texts, and their labels, a bounded number at a time."""
    whole, stems, labels, held = [], [], [], 0
    rows_whole, rows_stem = model.rows_whole.astype(np.int32), model.rows_stem.astype(np.int32)
    for frame in frames:
        texts = [zlib.decompress(raw) for raw in frame["_text"]]
        for a, b in chunks([len(t) for t in texts], BYTES_AT_ONCE):
            words = Words(texts[a:b])
            of_whole, of_stem = words.buckets()
            ends = np.cumsum(words.sizes)[:-1]
            own = zip(np.split(rows_whole[of_whole], ends), np.split(rows_stem[of_stem], ends), frame["_label"].iloc[a:b], strict=True)
            for one, two, y in own:
                if labels and (len(labels) >= WINDOW_ROWS or held + len(one) > WINDOW_WORDS):
                    yield whole, stems, np.array(labels, np.float64)
                    whole, stems, labels, held = [], [], [], 0
                whole.append(one)
                stems.append(two)
                labels.append(y)
                held += len(one)
    if labels:
        yield whole, stems, np.array(labels, np.float64)


def trained_round(rows: DataFrame, model: Model, seen: Seen, balance: float, rates: list[float], number: int) -> None:
    """One step of every shard over its rows, ``rates`` times, and the average of what they changed.

    An embedding row is averaged over the shards that changed it.  Shards that are gone through more
    than once are the only one and hold it; else rows pass by in windows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps((model, seen)))

    def run(frames):
        shard = TaskContext.get().partitionId()
        model, seen = pickle.loads(shared.value)
        before = model.parts(seen)
        draw = np.random.default_rng(11 if len(rates) > 1 or number == 0 == shard else [11, shard, number])
        own = windows(frames, model)
        held = list(own) if len(rates) > 1 else None
        for rate in rates:
            for whole, stems, y in held or own:
                model.epoch(seen, whole, stems, y, np.where(y == 1, balance, 1.0), rate, draw)
        for part, values in model.parts(seen).items():
            changed = np.flatnonzero((values != before[part]).any(1))
            for block in np.unique(changed // BLOCK):
                at = changed[changed // BLOCK == block]
                yield pd.DataFrame(
                    {"part": [part], "block": [block], "shard": [shard], "rows": [at.astype("<i8").tobytes()], "values": [values[at].tobytes()]}
                )

    def average(frame):
        at = [np.frombuffer(r, "<i8") for r in frame.sort_values("shard")["rows"]]
        rows, back = np.unique(np.concatenate(at), return_inverse=True)
        values = np.concatenate([np.frombuffer(v, np.float32) for v in frame.sort_values("shard")["values"]]).reshape(len(back), -1)
        total = np.zeros((len(rows), values.shape[1]), np.float32)
        np.add.at(total, back, values)
        total /= np.bincount(back)[:, None].astype(np.float32)
        return pd.DataFrame({"part": frame["part"].iloc[:1], "rows": [rows.tobytes()], "values": [total.tobytes()]})

    made = rows.mapInPandas(released(run), "part string, block long, shard int, rows binary, values binary")
    made = made.groupBy("part", "block").applyInPandas(average, "part string, rows binary, values binary")
    for r in made.collect():
        at = np.frombuffer(r["rows"], "<i8")
        model.take(seen, r["part"], at, np.frombuffer(r["values"], np.float32).reshape(len(at), -1))
    shared.destroy()


def calibrated(rows: DataFrame, model: Model, weights: dict[int, float], n: int) -> None:
    """Fit the thresholds on all calibration rows, whose logits are counted by language and class."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(frames):
        tables = pickle.loads(shared.value).tables()
        for frame in frames:
            logits, languages = tables.logits([zlib.decompress(t) for t in frame["_text"]])
            if n > EXACT_LOGITS:
                logits = np.round(logits * LOGIT_STEPS) / LOGIT_STEPS
            yield pd.DataFrame({"logit": logits, "language": languages, "label": frame["_label"].to_numpy()})

    counts = rows.mapInPandas(released(run), "logit double, language int, label int").groupBy("logit", "language").agg(
        F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative")
    )
    counts = counts.toPandas()
    for i in range(len(LANGUAGES)):
        own = counts[counts["language"] == i] if i else counts
        if i == 0 or min(own["positive"].sum(), own["negative"].sum()) >= LEAST_CALIBRATION:
            found = best_threshold(own["logit"].to_numpy(), own["positive"] * weights[1], own["negative"] * weights[0])
            model.thresholds[i if i else slice(None)] = found
    shared.destroy()


def trained(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | float:
    """Model fitted on every labelled row; without both classes, the share of label 1 (0 without labels)."""
    rows, weights, shards = labelled(docs, labels, key, text, label)
    rows = rows.persist(StorageLevel.DISK_ONLY)
    try:
        n = {(r["_label"], r["_calibrate"]): r["count"] for r in rows.groupBy("_label", "_calibrate").count().collect()}
        positive, negative = n.get((1, False), 0), n.get((0, False), 0)
        if not positive or not negative:
            return (positive + n.get((1, True), 0)) / max(1, sum(n.values()))
        fit, held = rows.where("not _calibrate"), rows.where("_calibrate")
        whole, stems = bucket_texts(fit)
        model = Model.of_rows(rows_for(whole), rows_for(stems))
        seen, balance = Seen(model), min(negative / positive, 10.0)
        batches = -(-(positive + negative) // BATCH)
        epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
        rates = [RATE / (1 + EPOCHS * epoch / epochs) for epoch in range(epochs)]
        for number, own in enumerate([rates] if shards == 1 else [[r] for r in rates]):
            trained_round(fit, model, seen, balance, own, number)
        if n.get((1, True), 0) and n.get((0, True), 0):
            calibrated(held, model, weights, n[1, True] + n[0, True])
    finally:
        rows.unpersist()
    return model


def scored(docs: DataFrame, model: Model | float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and ``score``, 0.5 being the threshold of the text's language.

    Empty and null texts score by the bias alone.  Rows are independent; null keys pass through.
    """
    rows = keyed_text(docs, key, text, as_bytes=True)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pickle.loads(shared.value)
        tables = own if isinstance(own, float) else Tables(own)
        for frame in frames:
            score = np.full(len(frame), tables) if isinstance(tables, float) else tables.scores(list(frame["_text"]))
            yield pd.DataFrame({"_key": frame["_key"], "score": score})

    return map_keyed(rows, run, "score double").withColumnRenamed("_key", key)


def clean(docs: DataFrame, model: Model | float, text: str = "text") -> DataFrame:
    """The rows, all columns, whose texts score below 0.5.

    Null texts and texts without words stay.  Where the labels lacked a class nothing was learnt, and
    every row stays.
    """
    import pyarrow as pa

    if isinstance(model, float):
        return docs
    columns, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(frames):
        tables = Tables(pickle.loads(shared.value))
        for batch in frames:
            texts = [t.encode() if t else b"" for t in batch.column(columns.index(text)).to_pylist()]
            wordless = np.array([not t.translate(WORD_BYTES).strip() for t in texts], bool)
            yield batch.filter(pa.array((tables.scores(texts) < 0.5) | wordless))

    return docs.mapInArrow(released(run), docs.schema)

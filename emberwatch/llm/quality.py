"""Text quality by regularised quadratic discriminants over document statistics.

Every text becomes a short vector of statistics, transformed towards symmetric shape.  Spark sums
the two classes' moments over all labelled rows; each class covariance is shrunk towards the pooled
one and towards a multiple of the unit matrix.  The score is the logistic of the difference of
the classes' log densities, from Mahalanobis distances by Cholesky factors made once.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import chunks, keyed_text, map_keyed
from emberwatch.llm.toxicity import COMMON

STATISTICS = [
    "words", "word_length", "word_spread", "upper", "digit", "symbol", "point", "shout", "space", "accent",
    "common", "variety", "top_word", "line_length", "repeated_lines", "repeated_triples", "compressed", "odd_ends",
]
#: Shares of the pooled covariance and of the scaled unit matrix in each class covariance.
TOWARDS_POOLED, TOWARDS_UNIT = 0.1, 0.05
#: Statistics are held within so many standard deviations; logits are tempered by this factor.
WITHIN, TEMPER = 6.0, 0.5
BYTES_AT_ONCE = 1 << 21

_COMMON = frozenset(w.encode() for words in COMMON.values() for w in words)
#: Class of each byte: 0 lower-case letter or other, 1 upper, 2 digit, 3 symbol, 4 point or comma, 5 ! or ?, 6 white space, 7 non-ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
_KIND[[ord(c) for c in ".,;:'\"()-"]] = 4
_KIND[[ord(c) for c in "!?"]] = 5
_KIND[[9, 10, 11, 12, 13, 32]] = 6
_KIND[128:] = 7
_TRIM = b".,;:!?\"'()[]"


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATISTICS per text; an empty text gives the values of no words."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for a, b in chunks([len(t) for t in texts], BYTES_AT_ONCE):
        own = texts[a:b]
        sizes = np.array([len(t) for t in own])
        joined = np.frombuffer(b"".join(own), np.uint8)
        doc = np.repeat(np.arange(len(own), dtype=np.int64), sizes)
        kinds = np.bincount(doc * 8 + _KIND[joined], minlength=8 * len(own)).reshape(-1, 8)
        shares = np.sqrt(kinds / np.maximum(sizes, 1)[:, None])
        for i, text in enumerate(own):
            out[a + i] = one(text, shares[i])
    return out


def one(text: bytes, shares: np.ndarray) -> list[float]:
    words = text.lower().split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    mean = lengths.mean() if words else 0.0
    trimmed = [w.strip(_TRIM) for w in words]
    seen: dict[bytes, int] = {}
    for w in trimmed:
        seen[w] = seen.get(w, 0) + 1
    common = sum([seen[w] for w in seen.keys() & _COMMON])
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    odd = sum([1 for w in words if w[-1] < 128 and _KIND[w[-1]] in (3, 5)])
    return [
        np.log1p(len(words)),
        np.log1p(mean),
        np.log1p(lengths.std()) if words else 0.0,
        shares[1], shares[2], shares[3], shares[4], shares[5], shares[6], shares[7],
        common / n,
        np.log1p(len(seen)) / np.log1p(n),
        np.sqrt(max(seen.values(), default=0) / n),
        np.log1p(len(text) / max(len(lines), 1)),
        np.sqrt(1 - len(set(lines)) / max(len(lines), 1)) if lines else 0.0,
        np.sqrt(1 - len(set(triples)) / max(len(triples), 1)) if triples else 0.0,
        len(zlib.compress(text, 1)) / (len(text) + 16),
        np.sqrt(odd / n),
    ]


class Discriminant:
    """Class means, Cholesky factors and log determinants over standardised statistics."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        n = {c: m[0] for c, m in moments.items()}
        total = sum(n.values())
        self.centre = sum(m[1] for m in moments.values()) / total
        second = sum(m[2] for m in moments.values()) / total
        self.scale = np.sqrt(np.maximum(np.diag(second) - self.centre**2, 1e-6))
        means = {c: (m[1] / m[0] - self.centre) / self.scale for c, m in moments.items()}
        covariance = {
            c: (m[2] / m[0] - np.outer(m[1], m[1]) / m[0] ** 2) / np.outer(self.scale, self.scale) for c, m in moments.items()
        }
        pooled = sum(n[c] * covariance[c] for c in n) / total
        self.classes = {}
        for c in n:
            shrunk = (1 - TOWARDS_POOLED) * covariance[c] + TOWARDS_POOLED * pooled
            unit = np.eye(len(pooled)) * np.trace(shrunk) / len(pooled)
            shrunk = (1 - TOWARDS_UNIT) * shrunk + TOWARDS_UNIT * unit + 1e-9 * np.eye(len(pooled))
            factor = np.linalg.cholesky(shrunk)
            self.classes[c] = (means[c], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(n[c] / total))

    def scores(self, values: np.ndarray) -> np.ndarray:
        z = np.clip((values - self.centre) / self.scale, -WITHIN, WITHIN)
        density = {}
        for c, (mean, inverse, log_det, prior) in self.classes.items():
            density[c] = prior - 0.5 * (log_det + (((z - mean) @ inverse.T) ** 2).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(TEMPER * (density[1] - density[0]), -30, 30)))


def described(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and one double column per statistic."""
    rows = keyed_text(docs, key, text, as_bytes=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = pd.DataFrame(statistics(list(frame["_text"])), columns=STATISTICS)
            made.insert(0, "_key", frame["_key"].to_numpy())
            yield made

    return map_keyed(rows, run, ", ".join(f"{s} double" for s in STATISTICS)).withColumnRenamed("_key", key)


def fitted(values: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Discriminant | float:
    """Discriminant from the moments of all labelled rows; without both classes, the share of label 1.

    Labels of one key are merged by their maximum; a null key has no label.
    """
    one_label = labels.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max(f"`{label}`").cast("int").alias("_label"))
    known = values.withColumnRenamed(key, "_key").join(one_label.where("_label in (0, 1)"), "_key")
    sums = [F.sum(s).alias(f"s_{s}") for s in STATISTICS]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(STATISTICS) for j, b in enumerate(STATISTICS) if i <= j]
    rows = known.groupBy("_label").agg(F.count("*").alias("n"), *sums, *products).collect()
    moments, d = {}, len(STATISTICS)
    for r in rows:
        square = np.array([[r[f"p_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        moments[r["_label"]] = (float(r["n"]), np.array([r[f"s_{s}"] for s in STATISTICS]), square)
    if len(moments) < 2:
        return float(next(iter(moments), 0))
    return Discriminant(moments)


def scored(values: DataFrame, model: Discriminant | float, key: str = "doc_id") -> DataFrame:
    """Per row of ``described``: key and ``score``."""
    shared = values.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pickle.loads(shared.value)
        for frame in frames:
            score = np.full(len(frame), own) if isinstance(own, float) else own.scores(frame[STATISTICS].to_numpy())
            yield pd.DataFrame({"_key": frame["_key"], "score": score})

    return map_keyed(values.withColumnRenamed(key, "_key"), run, "score double").withColumnRenamed("_key", key)

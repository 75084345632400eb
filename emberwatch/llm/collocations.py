"""Phrase collocations per language, counted by weighted acyclic automata.

1. A worker turns about ``SHARD_BYTES`` of text into one automaton of all its phrases of 1 to 4 words,
   with the language as first label, and writes it as sorted blocks.
2. Cut points over the blocks' first sequences divide all phrases into ranges of about ``RANGE_ARCS``
   arcs.  Blocks are cut there, and each range's pieces are united, weights summed.  A range is any
   stretch of the sorted order, so a very common first word or pair spreads over as many ranges as its
   continuations need, and a very common phrase arrives once per shard.
3. Phrases seen ``LEAST`` times or more leave; parts of such phrases are at least as frequent, so the
   surviving phrases hold every count that scores need.  Each range asks for the parts of its phrases
   once, and composes the automaton of parts with the automaton of counts that comes back.
4. Phrases inside a longer one that is nearly as frequent go, and the best of each language stay.

Only cut points reach the driver, some fifty bytes for each ``RANGE_ARCS`` arcs.

Defined cases: a null text is empty, a null language is ``und``, repeated rows count each time, a piece
without a separator is counted whole however long, an empty table gives no rows, and other columns are
never read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import with_package
from emberwatch.llm.transducer import SPLIT, Transducer, compose, from_levels, from_sequences, union
from emberwatch.session import written

#: Words of the longest phrase, and occurrences that a candidate needs.
LONGEST, LEAST = 4, 30
#: A candidate inside a longer one goes if the longer has this many hundredths of its occurrences.
INSIDE_PERCENT = 80
#: Phrases returned for each language.
BEST = 2000
UNKNOWN = "und"
#: Layout only: text in one automaton, arcs in a written block, arcs in a range before it is united.
SHARD_BYTES, BLOCK_ARCS, RANGE_ARCS = 8 << 20, 1 << 14, 1 << 20

#: Lower-cases A-Z, ends pieces with a byte that no text holds, and makes tabs blanks.
_BYTES = bytes(
    255 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)

BLOCK = "first array<string>, arcs long, blob binary"


def phrase_counts(texts: dict[bytes, list[bytes]], longest: int = LONGEST) -> Transducer:
    """The automaton of all phrases of texts (by language) whose pieces are parted by ``SPLIT``.

    A sequence is the language and 1 to ``longest`` words; the language alone weighs its words in all.
    """
    tokens, sizes, langs = [], [], sorted(texts)
    for lang in langs:
        own = (b" " + SPLIT + b" ").join(t.replace(SPLIT, b" " + SPLIT + b" ") for t in texts[lang]).split()
        tokens += own
        tokens.append(SPLIT)
        sizes.append(len(own) + 1)
    words = sorted({*tokens, *langs} - {SPLIT})
    number = {w: i for i, w in enumerate(words)} | {SPLIT: -1}
    ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
    del tokens
    state = np.where(ids >= 0, np.repeat(np.arange(len(langs)), sizes), -1)
    labels, above = [np.array([number[x] for x in langs], np.int64)], [np.zeros(len(langs), np.int64)]
    weights = [np.bincount(state[state >= 0], minlength=len(langs))]
    for d in range(longest):
        # at[i]: the phrase of d words (the language, at first) that the word at i + d may continue
        at = np.flatnonzero(state[: len(ids) - d] >= 0)
        at = at[ids[at + d] >= 0]
        keys, place, counts = np.unique(state[at] * len(words) + ids[at + d], return_inverse=True, return_counts=True)
        labels.append(keys % max(len(words), 1))
        above.append(keys // max(len(words), 1))
        weights.append(counts)
        state = np.full(len(ids), -1, np.int64)
        state[at] = place
    return from_levels(words, labels, above, weights)


def _strings(sequence: list[bytes]) -> list[str]:
    return [w.decode() for w in sequence]


def blocks_of(counted: Transducer, size: int) -> Iterator[tuple[list[str], int, bytes]]:
    parents = counted.parents()
    for start in range(0, len(counted), size):
        stop = min(start + size, len(counted))
        yield _strings(counted.sequence(start, parents)), stop - start, counted.cut(start, stop, parents).packed()


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``SHARD_BYTES`` that end where a piece ends."""
    start = 0
    while len(text) - start > SHARD_BYTES:
        end = text.find(SPLIT, start + SHARD_BYTES)
        if end < 0:
            break
        yield text[start:end]
        start = end + 1
    yield text[start:]


def _count_batches(size: int):
    def out(texts) -> Iterator[pa.RecordBatch]:
        for first, arcs, blob in blocks_of(phrase_counts(texts), size):
            yield pa.RecordBatch.from_arrays(
                [pa.array([first], pa.list_(pa.string())), pa.array([arcs], pa.int64()), pa.array([blob], pa.binary())], names=["first", "arcs", "blob"]
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer()
                for part in _pieces(bytes(raw).translate(_BYTES)) if raw else ():
                    texts.setdefault(lang.encode(), []).append(part)
                    held += len(part)
                    if held >= SHARD_BYTES:
                        yield from out(texts)
                        texts, held = {}, 0
        if held:
            yield from out(texts)

    return count


def shards(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Sorted blocks of the automata of all texts: first sequence, arcs, the packed block."""
    with_package(docs.sparkSession)
    read = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return read.mapInArrow(_count_batches(BLOCK_ARCS), BLOCK)


def cut_points(blocks: DataFrame) -> list[list[bytes]]:
    """First sequences of all ranges but the lowest."""
    total = blocks.agg(F.sum("arcs")).first()[0] or 0
    ranges = -(-total // RANGE_ARCS)
    if ranges < 2:
        return []
    firsts = blocks.select("first").repartitionByRange(ranges, "first").groupBy(F.spark_partition_id().alias("part")).agg(F.min("first").alias("first"))
    points = sorted([w.encode() for w in r["first"]] for r in firsts.select("first").collect())
    return points[1:]


def _cut_batches(points: list[list[bytes]]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                block = Transducer.unpacked(raw)
                parents = block.parents()
                # arcs of weight 0 only lead to the first real one, which may lie in a later range
                start = int(np.flatnonzero(block.weight)[0])
                number = bisect.bisect_right(points, block.sequence(start, parents))
                numbers, blobs = [], []
                while start < len(block):
                    stop = block.place(points[number], parents) if number < len(points) else len(block)
                    if stop > start:
                        numbers.append(number)
                        blobs.append(block.cut(start, stop, parents).packed())
                        start = stop
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], names=["range", "blob"])

    return cut


COUNTED = "range long, lang string, words int, phrase string, f long"


def _unite(frame: pd.DataFrame) -> pd.DataFrame:
    counted = union([Transducer.unpacked(raw) for raw in frame["blob"]])
    kept = np.flatnonzero((counted.weight >= LEAST) | ((counted.depth == 0) & (counted.weight > 0)))
    sequences = counted.sequences(kept)
    return pd.DataFrame(
        {
            "range": frame["range"].iloc[0],
            "lang": pd.Series([s[0].decode() for s in sequences], dtype=object),
            "words": counted.depth[kept].astype(np.int32),
            "phrase": pd.Series([b" ".join(s[1:]).decode() for s in sequences], dtype=object),
            "f": counted.weight[kept],
        }
    )


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Phrases of up to ``LONGEST`` words with ``f`` of ``LEAST`` or more, and of each language the
    phrase of no words, whose ``f`` is all its words: range, lang, words, phrase, f."""
    blocks = written(shards(docs, text, lang), "collocation-blocks")
    pieces = blocks.select("blob").mapInArrow(_cut_batches(cut_points(blocks)), "range long, blob binary")
    return pieces.groupBy("range").applyInPandas(_unite, COUNTED)


def _parts() -> Column:
    """All first and last parts of a phrase."""
    words = F.split("phrase", " ")
    cuts = F.sequence(F.lit(1), F.col("words") - 1)
    firsts = F.transform(cuts, lambda k: F.array_join(F.slice(words, 1, k), " "))
    rests = F.transform(cuts, lambda k: F.array_join(F.slice(words, k + 1, F.col("words") - k), " "))
    return F.array_union(firsts, rests)


def _sequence(lang: str, words: list[str]) -> tuple[bytes, ...]:
    return (lang.encode(), *[w.encode() for w in words])


def _score(candidates: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
    """l, r and score of the lowest-scoring cut of every candidate of a range."""
    counted = sorted(zip([_sequence(x, p.split(" ")) for x, p in zip(parts["lang_of"], parts["part"], strict=True)], parts["of"].tolist(), strict=True))
    counts = from_sequences([s for s, _ in counted], [f for _, f in counted])
    split = [(lang, phrase.split(" ")) for lang, phrase in zip(candidates["lang"], candidates["phrase"], strict=True)]
    ask = sorted({_sequence(lang, p) for lang, words in split for k in range(1, len(words)) for p in (words[:k], words[k:])})
    wanted = from_sequences(ask, [1] * len(ask))
    ends = np.flatnonzero(wanted.weight)
    f_of = dict(zip(ask, compose(counts, wanted)[ends].tolist(), strict=True))
    found = []
    for (lang, words), a in zip(split, candidates["f"].tolist(), strict=True):
        cuts = []
        for k in range(1, len(words)):
            left, right = f_of[_sequence(lang, words[:k])], f_of[_sequence(lang, words[k:])]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        found.append(min(cuts))
    return pd.DataFrame(
        {
            "lang": candidates["lang"],
            "phrase": candidates["phrase"],
            "words": candidates["words"],
            "a": candidates["f"],
            "l": [c[2] for c in found],
            "r": [c[3] for c in found],
            "score": [c[0] for c in found],
        }
    )


def scored(counted: DataFrame) -> DataFrame:
    """Candidates of 2 or more words with a, l, r and score: from ``frequent``'s rows."""
    candidates = counted.where("words >= 2")
    asked = candidates.select(F.col("range").alias("for"), F.col("lang").alias("in"), F.explode(_parts()).alias("part")).distinct()
    same = (asked["in"] == counted["lang"]) & (asked["part"] == counted["phrase"])
    parts = asked.join(counted, same).select("for", F.col("in").alias("lang_of"), "part", F.col("f").alias("of"))
    grouped = candidates.groupBy("range").cogroup(parts.groupBy("for"))
    return grouped.applyInPandas(_score, "lang string, phrase string, words int, a long, l long, r long, score long")


def outermost(candidates: DataFrame) -> DataFrame:
    """Without candidates that stand inside a longer one of ``INSIDE_PERCENT`` of their occurrences.

    Of all longer candidates around one, the most frequent has one word more.
    """
    words = F.split("phrase", " ")
    shorter = F.array(F.array_join(F.slice(words, 1, F.col("words") - 1), " "), F.array_join(F.slice(words, 2, F.col("words") - 1), " "))
    around = candidates.where("words > 2").select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    exact = "decimal(38,0)"
    inside = F.col("around").cast(exact) * 100 >= F.col("a").cast(exact) * INSIDE_PERCENT
    return candidates.join(around, ["lang", "phrase"], "left").where(~F.coalesce(inside, F.lit(False))).drop("around")


def best(candidates: DataFrame, most: int = BEST) -> DataFrame:
    """The first ``most`` of each language, ranked; a language is first ranked in parts."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = candidates.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return rows.drop("part")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = BEST) -> DataFrame:
    """The ``most`` best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counted = written(frequent(docs, text, lang), "collocation-counts")
    sizes = counted.where("words = 0").select("lang", F.col("f").alias("n"))
    # a range border may part a language's own arc from its phrases, but never doubles it
    rows = best(outermost(written(scored(counted), "collocation-scores")), most).join(sizes, "lang")
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""Spelling variants: words one edit apart, by asymmetric q-chunks.

Of two words one edit apart, the shorter (or either, of equal length) is cut into two disjoint chunks,
its first and its last half.  One edit spoils at most one of them, so the other stands whole in the
longer word, moved by no more than the difference of the lengths, that is within a shift of one.  The
same holds for what is left beside the whole chunk: it is one edit apart too, and one of its two
chunks stands whole.  A word therefore gives four signatures of two chunks each in its role of the
shorter word, and as many grams for every length that a shorter partner can have; equal signatures
are joined and the pairs verified.  Two levels leave about a quarter of the word open, which keeps the
joined groups small also where very many words begin or end alike.

Texts are counted in Arrow batches: a worker adds up words until its table holds ``MOST_WORDS`` of
them, so a very common word leaves a task a few times only.  Everything after the counts is joins and
aggregates over distinct words, which no single word can make uneven by itself; a signature that many
words share is a join key that Spark splits when skewed.

Defined cases: a null text has no words, a null key counts as an empty one where keys matter, repeated
rows count each time, an empty table gives no rows, and other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import with_package
from emberwatch.session import written

#: Runs of letters that count as words, before they are lower-cased (A-Z only).
RUN = "[A-Za-zÀ-ÿ]+"
#: Words of fewer code points, or seen less often, take no part.
SHORTEST, LEAST = 7, 2
#: A near word is a word's form when it is this many times as frequent.
RATIO = 10
#: Distinct words that a worker adds up before it hands their counts on.
MOST_WORDS = 200_000
#: One run in so many of a document, by checksum, loses a letter in ``misspelt``.
ONE_IN = 31

COUNTS = "word string, n long"


def misspelt(key: str, run: str) -> str:
    """The run, or for one (key, run) in ``ONE_IN`` the run without one of its letters."""
    h = crc32(f"{key}:{run}".encode())
    if h % ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count_batches(change) -> callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total = re.compile(RUN).findall, Counter()

        def out():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # bytes.lower() touches A-Z only
                raw = text.as_buffer()
                own = Counter(w for w in runs(bytes(raw).lower().decode()) if len(w) >= SHORTEST) if raw else {}
                for run, n in own.items():
                    word = change(key, run) if change else run
                    if len(word) >= SHORTEST:
                        total[word] += n
                if len(total) >= MOST_WORDS:
                    yield out()
                    total.clear()
        if total:
            yield out()

    return count


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", change=misspelt) -> DataFrame:
    """Words of at least ``SHORTEST`` code points with their occurrences ``n``, at least ``LEAST``.

    ``change(key as text, run)`` maps the runs of a document to words; None takes runs as they are.
    """
    with_package(docs.sparkSession)
    read = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    parts = read.mapInArrow(_count_batches(change), COUNTS)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _signatures(length: Column, shorter: Column) -> Column:
    """The four signatures of a word as the partner of words with ``shorter`` code points.

    ``length`` is the word's own length, the same or one more.  A signature holds the shorter length,
    which chunk is whole on either level, and a hash of both chunks; equal hashes are verified later.
    """
    word, found = F.col("word"), []
    for first in (True, False):
        size = F.floor(shorter / 2).cast("int")
        chunk = F.substr(word, F.lit(1) if first else length - size + 1, size)
        # what is left beside the chunk: ``rest`` code points in the shorter word, one more in a longer one
        rest, begin = shorter - size, (size if first else F.lit(0))
        own = length - size
        half = F.floor(rest / 2).cast("int")
        for second in (True, False):
            inner = F.substr(word, begin + (F.lit(1) if second else own - half + 1), half)
            found.append(F.xxhash64(shorter, F.lit(first), F.lit(second), chunk, inner))
    return F.array(*found)


def near_pairs(words: DataFrame) -> DataFrame:
    """Each unordered pair of words one edit apart once: a, n_a, b, n_b, where a is not longer than b."""
    sized = words.select("word", "n", F.char_length("word").cast("int").alias("size"))

    def keyed(shorter: Column) -> DataFrame:
        return sized.select("word", "n", "size", F.explode(_signatures(F.col("size"), shorter)).alias("key"))

    chunks = keyed(F.col("size")).select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("size").alias("size_a"))
    grams = (
        sized.select("word", "n", "size", F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("shorter"))
        .where(F.col("shorter") >= SHORTEST)
        .select("word", "n", "size", F.explode(_signatures(F.col("size"), F.col("shorter"))).alias("key"))
        .select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("size").alias("size_b"))
    )
    apart = (F.col("size_b") > F.col("size_a")) | (F.col("a") < F.col("b"))
    pairs = chunks.join(grams, (chunks["key"] == grams["key"]) & apart & (F.levenshtein("a", "b", 1) == 1))
    # a pair meets in every signature that its edit leaves whole
    return pairs.select("a", "n_a", "b", "n_b").dropDuplicates(["a", "b"])


def _roots(forms: DataFrame) -> DataFrame:
    """From (word, form) the last word that following forms leads to.

    Every form is ``RATIO`` times as frequent as its word, so a chain has at most as many links as the
    largest count has digits; following doubles its stride each round.
    """
    top = forms.agg(F.max("form_n")).first()[0]
    up = forms.select("word", F.col("form").alias("root"))
    stride, longest = 1, len(str(top or 0))
    while stride < longest:
        onward = up.select(F.col("word").alias("root"), F.col("root").alias("_root"))
        up = written(up.join(onward, "root", "left").select("word", F.coalesce("_root", "root").alias("root")), "spelling-roots")
        stride *= 2
    return up


def variants(words: DataFrame) -> DataFrame:
    """Per word: form, root, n, n_near, form_n.

    The form is the near word of largest ``n``, ties to the smallest in code-point order, if it is at
    least ``RATIO`` times as frequent; the root is where following forms ends, the word itself without one.
    """
    pairs = near_pairs(words)
    ends = F.inline(
        F.array(
            F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
            F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
        )
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = pairs.select(ends).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= RATIO * F.col("n")
    found = written(
        words.join(near, "word", "left").select(
            "word",
            F.when(is_form, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(found.where("form is not null").select("word", "form", "form_n"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", change=misspelt) -> DataFrame:
    """Spelling variants of all words of ``docs``; see ``word_counts`` and ``variants``."""
    return variants(written(word_counts(docs, key, text, change), "spelling-words"))

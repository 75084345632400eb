"""Near-duplicates by b-bit MinHash with exact confirmation.

Documents with the same words form a class, so copies are never compared.  Minima of hash
functions over a class's word shingles make band keys for candidate search; the low bits of the
minima, packed as bit planes, estimate similarity by bit counts, corrected for chance collisions.

Links are needed for components only.  Each bucket first compares its members with one pivot and
confirms these pairs on the full sets.  Only where a bucket still holds several components are
members compared with each other, inside the task, and only pairs across components that may
reach the threshold leave it.  A pair is left out there when its estimate is far too low, or when
the shingles that both could share are provably too few.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import chunks, map_keyed, mix64, pieces, released
from emberwatch.llm.components import components
from emberwatch.session import written

SHINGLE_WORDS = 5
#: Links need at least so many hundredths of common shingles.
PERCENT = 85
BANDS, ROWS = 24, 6
MINIMA = BANDS * ROWS
LOW_BITS = 4
PLANE_LONGS = -(-MINIMA // 64)
#: Candidates stay down to so many standard deviations of the estimate below the threshold.
DEVIATIONS = 4.5
#: Members of a bucket that one task compares at once; larger buckets are cut into such blocks.
BLOCK_ROWS = 512

_DRAW = np.random.default_rng(85)
_FACTORS = _DRAW.integers(1, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _DRAW.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_PLACES = mix64(_DRAW.integers(1, 1 << 62, SHINGLE_WORDS, dtype=np.uint64)) | np.uint64(1)
_CHUNK = 4096
#: Words that are hashed and mixed at once.
MIX_WORDS = 1 << 15


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; all words together if they are fewer."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < SHINGLE_WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    last = n - SHINGLE_WORDS + 1
    total = h[:last] * _PLACES[0]
    for i in range(1, SHINGLE_WORDS):
        total += mix64(h[i : i + last] + _PLACES[i])
    return np.unique(mix64(total))


def all_shingles(texts: list[list[bytes]]) -> Iterator[np.ndarray]:
    """``shingles`` of each word list; the words of many texts are hashed and mixed in one array."""
    for a, b in chunks([len(t) for t in texts], MIX_WORDS):
        part = texts[a:b]
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(part)), np.uint64, sum(map(len, part)))
        last = max(len(h) - SHINGLE_WORDS + 1, 0)
        total = h[:last] * _PLACES[0]
        for i in range(1, SHINGLE_WORDS):
            total += mix64(h[i : i + last] + _PLACES[i])
        total, start = mix64(total), 0
        for words in part:
            n = len(words)
            # shingles that run over a text's end belong to none
            yield shingles(words) if n < SHINGLE_WORDS else np.unique(total[start : start + n - SHINGLE_WORDS + 1])
            start += n


def minima(shingle: np.ndarray) -> np.ndarray:
    """Minimum of every hash function over a set of shingles."""
    x = (shingle >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), _CHUNK):
        part = x[i : i + _CHUNK]
        for j in range(0, MINIMA, 48):
            own = slice(j, j + 48)
            np.minimum(out[own], (part[None, :] * _FACTORS[own, None] + _SHIFTS[own, None]).min(axis=1), out=out[own])
    return out


def bit_planes(low: np.ndarray) -> list[int]:
    """The low bits of mixed minima: LOW_BITS planes of one bit per minimum, packed in longs."""
    mixed = (low * np.uint32(0x9E3779B1)) >> np.uint32(32 - LOW_BITS)
    planes = []
    for bit in range(LOW_BITS):
        bits = np.zeros(PLANE_LONGS * 64, np.uint8)
        bits[:MINIMA] = (mixed >> np.uint32(bit)) & 1
        planes += np.packbits(bits, bitorder="little").view("<i8").tolist()
    return planes


def band_keys(low: np.ndarray) -> list[int]:
    return [xxhash.xxh3_64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), seed=b) - (1 << 63) for b in range(BANDS)]


def least_equal(deviations: float = DEVIATIONS) -> int:
    """Fewest equal minima (by their low bits) of a pair that stays a candidate."""
    chance = 2.0**-LOW_BITS
    expected = chance + (1 - chance) * PERCENT / 100
    return int(MINIMA * expected - deviations * np.sqrt(MINIMA * expected * (1 - expected)))


def _text(docs: DataFrame, key: str, text: str) -> DataFrame:
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(value).alias("text_key"), value.cast("binary").alias("_text"))


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: id, text_key, class (digest of the words; null without words), n (shingles), bands and planes.

    Within a task only the first document of a class carries bands and planes.
    """
    rows = _text(docs, key, text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        for frame in pieces(frames):
            texts = [raw.lower().split() for raw in frame["_text"]]
            names = [xxhash.xxh3_128_digest(b" ".join(words)) if words else None for words in texts]
            new = {own: i for i, own in reversed(list(enumerate(names))) if own and own not in seen}
            firsts = sorted(new.values())
            made_here = {}
            for i, found in zip(firsts, all_shingles([texts[i] for i in firsts]), strict=True):
                low = minima(found)
                seen[names[i]] = len(found)
                made_here[i] = (band_keys(low), bit_planes(low))
            out = [(own, seen.get(own, 0), *made_here.get(i, (None, None))) for i, own in enumerate(names)]
            made = pd.DataFrame(out, columns=["class", "n", "bands", "planes"])
            yield pd.concat([frame[["id", "text_key"]].reset_index(drop=True), made], axis=1)

    return map_keyed(rows, run, "text_key long, class binary, n long, bands array<long>, planes array<long>", "id")


def full_sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """Class and packed shingle hashes of the texts whose text_key is in ``wanted``; equal texts once."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.xxhash64(value).alias("text_key"), value.cast("binary").alias("_text"))
    rows = rows.groupBy("text_key").agg(F.first("_text").alias("_text")).join(wanted, "text_key", "left_semi").select("_text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames):
            words = [t.lower().split() for t in frame["_text"]]
            yield pd.DataFrame(
                {"class": [xxhash.xxh3_128_digest(b" ".join(w)) for w in words], "shingles": [s.tobytes() for s in all_shingles(words)]}
            )

    return rows.mapInPandas(released(run), "class binary, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    joined = pairs.join(sets.withColumnsRenamed({"class": "a", "shingles": "set_a"}), "a")
    joined = joined.join(sets.withColumnsRenamed({"class": "b", "shingles": "set_b"}), "b").select("a", "b", "set_a", "set_b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            linked = []
            for x, y in zip(frame["set_a"], frame["set_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield frame.loc[linked, ["a", "b"]]

    return joined.mapInPandas(released(run), "a binary, b binary")


def equal_minima(left: str, right: str) -> F.Column:
    """Minima that agree in their low bits: no plane differs."""
    differ = None
    for plane in range(LOW_BITS):
        longs = [F.col(left)[plane * PLANE_LONGS + i].bitwiseXOR(F.col(right)[plane * PLANE_LONGS + i]) for i in range(PLANE_LONGS)]
        differ = longs if differ is None else [d.bitwiseOR(x) for d, x in zip(differ, longs, strict=True)]
    return F.lit(MINIMA) - sum([F.bit_count(d) for d in differ], F.lit(0))


def across(members: DataFrame, emit: str) -> DataFrame:
    """Candidates across components within buckets: ``pairs`` (a, b), the ``classes`` in any pair,
    or a ``tree``: of the pairs that most likely link, as many as join the components they can join.

    ``members``: band, class, component, n, shared, bands, planes, size (of the bucket).  Two blocks
    of a large bucket meet in one group, so no task holds more than two blocks.  A pair that shares
    several buckets is looked at in the first of them.
    """
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    rows = members.withColumns({"blocks": blocks, "own": own})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"first": F.least("own", "other"), "second": F.greatest("own", "other")})
    keep = ["band", "first", "second", "own", "class", "component", "n", "shared", "bands", "planes"]
    least = least_equal(0 if emit == "tree" else DEVIATIONS)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        planes = np.array(frame["planes"].tolist(), np.int64).reshape(len(frame), LOW_BITS, PLANE_LONGS)
        bands, here = np.array(frame["bands"].tolist(), np.int64), int(frame["band"].iloc[0])
        n, shared = frame["n"].to_numpy(), frame["shared"].to_numpy()
        names = frame["class"].to_numpy()
        component = pd.factorize(frame["component"])[0]
        block = frame["own"].to_numpy()
        two_blocks = frame["first"].iloc[0] != frame["second"].iloc[0]
        out_a, out_b = [], []
        joined = np.arange(component.max() + 1)  # components as joined so far
        for i in range(len(frame)):
            j = np.arange(i + 1, len(frame))
            j = j[component[j] != component[i]]
            if two_blocks:
                j = j[block[j] != block[i]]
            j = j[100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])]
            common = np.minimum(shared[i], shared[j])
            j = j[100 * common >= PERCENT * (n[i] + n[j] - common)]
            if not len(j):
                continue
            j = j[bands[i][(bands[j] == bands[i]).argmax(axis=1)] == here]
            differ = np.bitwise_or.reduce(planes[j] ^ planes[i], axis=1)
            j = j[MINIMA - np.bitwise_count(differ.view(np.uint64)).sum(axis=1, dtype=np.int64) >= least]
            if emit == "tree":
                _, first = np.unique(joined[component[j]], return_index=True)
                j = j[first]
                j = j[joined[component[j]] != joined[component[i]]]
                for other in np.unique(joined[component[j]]):
                    joined[joined == other] = joined[component[i]]
            out_a += [names[i]] * len(j)
            out_b += names[j].tolist()
        if emit == "classes":
            return pd.DataFrame({"class": list({*out_a, *out_b})}, dtype=object)
        low = [min(x, y) for x, y in zip(out_a, out_b, strict=True)]
        high = [max(x, y) for x, y in zip(out_a, out_b, strict=True)]
        return pd.DataFrame({"a": low, "b": high}, dtype=object)

    schema = "class binary" if emit == "classes" else "a binary, b binary"
    return rows.select(keep).groupBy("band", "first", "second").applyInPandas(run, schema).distinct()


def shared_counts(sets: DataFrame) -> DataFrame:
    """Per class: ``shared``, its shingles that at least one other class of ``sets`` has too."""

    def owner(name: bytes) -> int:
        return struct.unpack("<q", name[:8])[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, own in zip(frame["class"], frame["shingles"], strict=True):
                values = np.frombuffer(own, np.int64)
                yield pd.DataFrame({"shingle": values, "owner": np.full(len(values), owner(name))})

    single = sets.mapInPandas(released(run), "shingle long, owner long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("owner").alias("owner"))
    single = single.where("n = 1").groupBy("owner").agg(F.count("*").alias("single"))

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"class": frame["class"], "owner": [owner(c) for c in frame["class"]], "all": [len(s) // 8 for s in frame["shingles"]]})

    rows = sets.mapInPandas(released(named), "class binary, owner long, all long").join(single, "owner", "left")
    return rows.select("class", (F.col("all") - F.coalesce("single", F.lit(0))).alias("shared"))


def links(classes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Links between classes whose components are those of all links: columns a and b."""
    keys = classes.select("class", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count("*").alias("size"), F.min("class").alias("pivot")).where("size > 1")
    buckets = written(keys.join(shared, "band"), "buckets")
    near = buckets.select("class").distinct()
    sets = written(full_sets(docs, text, classes.join(near, "class", "left_semi").select("text_key")), "sets")
    planes = written(classes.select("class", "n", "bands", "planes").join(near, "class", "left_semi"), "planes")

    stars = buckets.where("class != pivot").select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct()
    stars = stars.join(planes.select(F.col("class").alias("b"), F.col("planes").alias("planes_b"), F.col("n").alias("n_b")), "b")
    stars = stars.join(planes.select(F.col("class").alias("a"), F.col("planes").alias("planes_a"), F.col("n").alias("n_a")), "a")
    stars = stars.where(equal_minima("planes_a", "planes_b") >= least_equal())
    stars = stars.where(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")).select("a", "b")
    first = written(confirmed(stars, sets), "links")

    shared_buckets = buckets.select("band", "class", "size")
    rows = mixed(shared_buckets, components(first)).join(planes, "class")
    live = written(across(rows.withColumn("shared", F.col("n")), "classes"), "live")
    counts = written(shared_counts(sets.join(live, "class", "left_semi")), "shared")
    # a class that shares too few of its shingles has no link; without it others share fewer
    able = counts.join(planes.select("class", "n"), "class").where(100 * F.col("shared") >= PERCENT * F.col("n"))
    counts = written(shared_counts(sets.join(able, "class", "left_semi")).join(planes, "class"), "shared")
    tree = written(across(rows.select("band", "class", "size", "component").join(counts, "class"), "tree"), "tree")
    second = written(first.union(confirmed(tree, sets)), "links")
    rows = mixed(shared_buckets, components(second)).join(counts, "class")
    return second.union(written(confirmed(written(across(rows, "pairs"), "pairs"), sets), "links"))


def mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their components, of the buckets that hold more than one component."""
    rows = buckets.join(labels.withColumnRenamed("node", "class"), "class", "left")
    rows = rows.withColumn("component", F.coalesce("component", "class"))
    many = rows.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    return written(rows.join(many.select("band"), "band"), "members")


def members(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: ``id``, ``text_key``, ``n`` and ``component``, the name of its group; null without words."""
    rows = written(signatures(docs, key, text), "signatures")
    with_bands = rows.where("bands is not null")
    classes = with_bands.groupBy("class").agg(F.max("n").alias("n"), F.max("bands").alias("bands"), F.max("planes").alias("planes"), F.min("text_key").alias("text_key"))
    classes = written(classes, "classes")
    labels = written(components(links(classes, docs, text)), "components").withColumnRenamed("node", "class")
    found = rows.select("id", "text_key", "n", "class").join(labels, "class", "left")
    return found.withColumn("component", F.coalesce("component", "class"))


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``n_shingles``, ``component_id`` (smallest key reachable), ``kept``, and ``text_key``.

    Words are split at ASCII white space with A-Z lower-cased.  Null, empty and blank texts have no
    shingles and stand alone.  A null key counts as larger than any; a group of null keys has a null
    component and is kept.  Rows that repeat a key keep one result each.
    """
    found = members(docs, key, text)
    smallest = found.where("component is not null").groupBy("component").agg(F.min("id").alias("smallest"))
    found = found.join(smallest, "component", "left")
    component = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("smallest"))
    return found.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
        "text_key",
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document row, all columns, of every group; documents without words all stay.

    The row with the smallest key stays, a null key counting as larger than any; of rows that repeat
    it within a group, the one with the smallest text hash.  Groups are told apart by their own name,
    so neither null keys nor a key shared by different texts joins them.
    """
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("_key"), F.col("text_key").alias("_text_key"))
    kept = members(docs, key, text).where("component is not null").groupBy("component").agg(F.min(order).alias("best"))
    kept = written(kept.select("best._key", "best._text_key"), "kept")
    text_key = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    blank = ~F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike("[^ \\t-\\r]")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col(f"`{key}`").alias("_key"), text_key.alias("_text_key"), blank.alias("_blank"))
    once = rows.where("not _blank").dropDuplicates(["_key", "_text_key"])
    same = once["_key"].eqNullSafe(kept["_key"]) & (once["_text_key"] == kept["_text_key"])
    return once.join(kept, same, "left_semi").select("_row.*").union(rows.where("_blank").select("_row.*"))

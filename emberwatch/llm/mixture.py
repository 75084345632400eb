"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1, a broken line through knots.  The
integral of a schedule is the source's weight; weights share out the words of all documents, and a
source's target stops at ``MOST_PASSES`` times its size, the excess going to the others by weight.

A source's documents stand in a fixed random order (by a hash of their key), pass after pass, until
its target is used up.  The word at which a document begins in that stream, set against the source's
cumulative demand (target times the integral of its schedule up to a time), gives the time at which
training reaches it: its position.  Sorting by position by ranges gives the training order.

Running sums over a source never pass through one task: the hash order is cut into about as many
slices as a slice has rows, slices are summed on their own, and slice totals give the offsets.  Ranks
of sources come from ranges of names in the same way.  Only totals of the whole table reach the driver.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; a null key
orders like an empty one; rows that agree in key, source and size are interchangeable and counted
together until their places are known; documents without words are never taken; an empty table gives
no rows; other columns are never read.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.session import written

#: Knots (time, weight) of the schedules that sources take in turn, by order of their names.  They
#: integrate to 5, 2 and 1: a source that fades, one that stays level, one that grows.
SCHEDULES = [[(0.0, 7.5), (1.0, 2.5)], [(0.0, 2.0), (1.0, 2.0)], [(0.0, 0.5), (1.0, 1.5)]]
#: A document is read at most so many times.
MOST_PASSES = 3

_GAP, _WORD = "[ \\t-\\r]", "[^ \\t-\\r]"


def word_count(text: Column) -> Column:
    """Words of a text: runs without ASCII white space.  No list of words is built."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"{_GAP}*+{_WORD}++{_GAP}*+", "x")
    return F.char_length(F.regexp_replace(marks, "[^x]++", "")).cast("long")


def areas(knots: list[tuple[float, float]]) -> list[float]:
    """The integral of a schedule up to each of its knots."""
    found = [0.0]
    for (t0, w0), (t1, w1) in pairwise(knots):
        found.append(found[-1] + (w0 + w1) / 2 * (t1 - t0))
    return found


def time_at(area: Column, knots: list[tuple[float, float]]) -> Column:
    """The time at which the integral of a schedule reaches ``area``: its inverse, piece by piece."""
    found, upto = None, areas(knots)
    for i, ((t0, w0), (t1, w1)) in enumerate(pairwise(knots)):
        if upto[i + 1] == upto[i]:
            continue
        more, slope = area - F.lit(upto[i]), (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * more, F.lit(0.0)))
        here = F.when(more > 0, F.lit(t0) + F.lit(2.0) * more / (F.lit(w0) + root)).otherwise(F.lit(t0))
        found = F.when(area < F.lit(upto[i + 1]), here) if found is None else found.when(area < F.lit(upto[i + 1]), here)
    return F.lit(knots[-1][0]) if found is None else found.otherwise(F.lit(knots[-1][0]))


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, the 0-based place by name in code-point order, null last."""
    order = F.col("source").asc_nulls_last()
    ranges = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = written(sources.repartitionByRange(ranges, order).withColumn("part", F.spark_partition_id()), "mixture-sources")
    # at most ``ranges`` rows reach the window without a key
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return parts.withColumn("inside", inside).join(sizes, "part").withColumn("rank", F.col("before") + F.col("inside") - 1).drop("part", "inside", "before")


def targets(sources: DataFrame, schedules=SCHEDULES, most: int = MOST_PASSES) -> DataFrame:
    """From (source, source_size): ``schedule``, its number in ``schedules``, and ``target`` in words.

    ``level`` is the target of weight 1 among sources that are not stopped.  It only rises while
    sources that would pass their bound are taken out, until none does.
    """
    weights = [areas(knots)[-1] for knots in schedules]
    ranked = _ranked(sources).withColumn("schedule", F.pmod("rank", F.lit(len(schedules))).cast("int"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("schedule") + 1)
    ranked = written(ranked.withColumn("weight", weight), "mixture-ranks")
    bound = most * F.col("source_size")
    total, level = ranked.agg(F.sum("source_size")).first()[0] or 0, -1.0
    while True:
        stopped = F.col("weight") * F.lit(level) > bound
        fixed, rest = ranked.agg(
            F.coalesce(F.sum(F.when(stopped, bound)), F.lit(0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0))
        ).first()
        raised = (total - fixed) / rest if rest else level
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("weight") * F.lit(level), bound.cast("double"))
    return ranked.withColumn("target", F.greatest(target, F.lit(0.0)))


def scheduled(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", schedules=SCHEDULES, most: int = MOST_PASSES) -> DataFrame:
    """Per row: key, ``source``, ``size``, ``source_size``, ``target`` and ``places``.

    ``places`` holds the passes that the mix takes, at most ``most``: pass (from 0), position in
    training (0 to 1) and words.  The document at which a target ends gives only the words still wanted,
    so the words taken of a source add up to its target, rounded.
    """
    sized = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    order = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("key").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    rows = sized.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    rows = written(rows.select("*", order.alias("order")), "mixture-rows")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sizes = written(sizes, "mixture-sizes")
    found = written(targets(sizes.select("source", "source_size"), schedules, most), "mixture-targets")

    largest = sizes.agg(F.max("rows")).first()[0] or 0
    slice_of = F.shiftright("order", 60 - largest.bit_length() // 2)
    same = rows["source"].eqNullSafe(found["source"])
    rows = rows.join(found, same).select("key", found["source"], "size", "copies", "order", "rank", "schedule", "source_size", "target", slice_of.alias("slice"))
    own = F.col("size") * F.col("copies")
    totals = rows.groupBy("rank", "slice").agg(F.sum(own).alias("words"))
    earlier = Window.partitionBy("rank").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("rank", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("rank", "slice").orderBy("order", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(own).over(inside), F.lit(0))).join(totals, ["rank", "slice"])
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))

    first = F.col("offset") + F.col("inside") + F.col("copy") * F.col("size")
    wanted = F.floor(F.col("target") + 0.5)

    def place(number: Column) -> Column:
        start = number * F.col("source_size") + first
        time = None
        for i, knots in enumerate(schedules):
            area = start.cast("double") / F.col("target") * F.lit(areas(knots)[-1])
            one = F.col("schedule") == i
            time = F.when(one, time_at(area, knots)) if time is None else time.when(one, time_at(area, knots))
        words = F.greatest(F.least(F.col("size"), wanted - start), F.lit(0))
        return F.struct(number.alias("pass"), F.when(words > 0, time).alias("position"), words.alias("words"))

    places = F.filter(F.array(*[place(F.lit(i)) for i in range(most)]), lambda p: p["words"] > 0)
    return rows.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", places.alias("places"))


def taken(places: str | Column = "places") -> Column:
    """Words that the mix takes of a row, repeats counted."""
    return F.aggregate(places, F.lit(0).cast("long"), lambda total, p: total + p["words"])


def training_order(planned: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per pass of a document, range-sorted by position: key, pass, position, words."""
    rows = planned.select(F.col(f"`{key}`"), F.inline("places"))
    return rows.orderBy("position", key, "pass")

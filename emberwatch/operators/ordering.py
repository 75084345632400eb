"""Order-dependent work on keys of any size.

A window over one key runs in one task.  Here the key's order is first cut into slices
by a rule on the ordering value, each slice is handled on its own, and the few slice
summaries carry the state from one slice to the next.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_BITS = 16
LOWEST_SLICE = -(1 << 60)
#: Rows that one slice may hold before it is cut further.
CROWD = 4 << SLICE_BITS
#: Groups of tasks whose quantile sketches are merged apart.
SKETCHES = 64


def sliced_position(
    df: DataFrame,
    key: str,
    order: str,
    ties: list[str],
    out: str,
    bits: int = SLICE_BITS,
    null_slice: Column | None = None,
    finer: tuple[Column, ...] = (),
    crowd: int = CROWD,
) -> DataFrame:
    """0-based position of each row within its key, ordered by ``order`` then ``ties``.

    Slices hold ``2**bits`` consecutive order values; slice counts are summed to offsets.  Rows without
    an order value come first, by ``ties``; ``null_slice`` (a whole number from 0 that grows with the
    ties) spreads them over slices too.  Order values may repeat, so a slice may hold any number of
    rows: one with more than ``crowd`` is cut by ``finer``, whole numbers of which each grows with the
    order among rows that agree in those before it.  Positions do not depend on the cuts.  A null key is
    a key of its own.
    """
    unordered = F.lit(LOWEST_SLICE) if null_slice is None else LOWEST_SLICE + null_slice
    part = F.coalesce(F.shiftright(F.col(order).cast("bigint"), bits), unordered.cast("bigint"))
    rows = df.withColumn("_slice", part)
    cuts = [f"_cut{i}" for i in range(len(finer))]

    def joined(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
        """Join on names that may be null on both sides; the right side's copies go."""
        other = right.withColumnsRenamed({n: f"_of_{n}" for n in names})
        same = F.lit(True)
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"_of_{n}"))
        return left.join(other, same, how).drop(*[f"_of_{n}" for n in names])

    def before(*order: str) -> Column:
        earlier = Window.partitionBy(key, *(() if order == ("_slice",) else ("_slice",))).orderBy(*order)
        return F.coalesce(F.sum("_rows").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    size = F.count(F.lit(1)).alias("_rows")
    slices = rows.groupBy(key, "_slice").agg(size).select(
        key, "_slice", before("_slice").alias("_before"), (F.col("_rows") > crowd).alias("_crowded")
    )
    rows = joined(rows, slices, [key, "_slice"], "inner")
    rows = rows.withColumns({n: F.when(F.col("_crowded"), c.cast("bigint")).otherwise(F.lit(0)) for n, c in zip(cuts, finer)})
    within = Window.partitionBy(key, "_slice", *cuts).orderBy(order, *ties)
    placed = rows.withColumn("_rank", F.row_number().over(within))
    ahead = F.lit(0)
    if finer:
        cells = rows.filter("_crowded").groupBy(key, "_slice", *cuts).agg(size)
        cells = cells.select(key, "_slice", *cuts, before(*cuts).alias("_ahead"))
        placed = joined(placed, cells, [key, "_slice", *cuts], "left")
        ahead = F.coalesce("_ahead", F.lit(0))
    at = F.col("_rank") - 1 + F.col("_before") + ahead
    return placed.withColumn(out, at.cast("bigint")).drop("_slice", *cuts, "_rank", "_before", "_crowded", "_ahead")


def sliced_gaps(df: DataFrame, key: str, order: str, bits: int = SLICE_BITS) -> DataFrame:
    """Missing integers between each key's smallest and largest value, as intervals.

    Returns key, first_missing, last_missing; the range itself is never expanded.
    """
    ids = (
        df.filter(F.col(order).isNotNull())
        .withColumn("_slice", F.shiftright(F.col(order).cast("bigint"), bits))
        .groupBy(key, "_slice", order)
        .agg(F.lit(1).alias("_one"))
    )
    inner = ids.withColumn(
        "_next", F.lead(order).over(Window.partitionBy(key, "_slice").orderBy(order))
    ).select(key, F.col(order).alias("_from"), "_next")
    edges = (
        ids.groupBy(key, "_slice")
        .agg(F.min(order).alias("_low"), F.max(order).alias("_from"))
        .withColumn("_next", F.lead("_low").over(Window.partitionBy(key).orderBy("_slice")))
        .select(key, "_from", "_next")
    )
    return (
        inner.unionByName(edges)
        .filter(F.col("_next") > F.col("_from") + 1)
        .select(
            key,
            (F.col("_from") + 1).alias("first_missing"),
            (F.col("_next") - 1).alias("last_missing"),
        )
    )


def distinct_bits(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Exact count of distinct integers per key.

    64 neighbouring values share one row as a bit set, so the shuffle carries at most
    one row per key and value, usually far fewer.
    """
    words = (
        df.filter(F.col(value).isNotNull())
        .groupBy(key, F.shiftright(F.col(value).cast("bigint"), 6).alias("_word"))
        .agg(
            F.bit_or(
                F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(value).bitwiseAND(63).cast("int"))
            ).alias("_bits")
        )
    )
    return words.groupBy(key).agg(F.sum(F.bit_count("_bits")).cast("bigint").alias(out))


def cumulative_by_value(
    df: DataFrame, value: str, weights: dict[str, Column], buckets: int = 1024
) -> DataFrame:
    """Sum weights per distinct value and add running sums in ascending value order.

    Columns: value, each weight, and ``<weight>_before`` (sum over smaller values).
    Ranges of values are bounded by approximate quantiles of the distinct values, so no
    task orders more than about 1/buckets of them; repeated values collapse first.
    """
    per_value = df.groupBy(value).agg(*[c.alias(n) for n, c in weights.items()])
    probabilities = [i / buckets for i in range(1, buckets)]
    cuts = per_value.approxQuantile(value, probabilities, 0.25 / buckets)
    finite = sorted({c for c in cuts if abs(c) < float("inf")}) or [0.0]
    splits = [float("-inf"), *finite, float("inf")]
    bucketed = Bucketizer(
        splits=splits, inputCol=value, outputCol="_bucket", handleInvalid="keep"
    ).transform(per_value)
    names = list(weights)
    # at most `buckets` + 1 rows reach the one-partition window below
    totals = bucketed.groupBy("_bucket").agg(*[F.sum(n).alias(n) for n in names])
    earlier = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bucket", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in names]
    )
    inside = Window.partitionBy("_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return bucketed.join(F.broadcast(offsets), "_bucket").select(
        value,
        *names,
        *[
            (F.col(f"_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_before")
            for n in names
        ],
    )


def quantile_brackets(
    df: DataFrame, columns: list[str], probabilities: list[float], accuracy: int, sketches: int = SKETCHES
) -> DataFrame:
    """One row: struct ``edges`` with values <column>_lo<i> and <column>_hi<i> around each wanted quantile.

    Tasks are dealt into ``sketches`` groups, each with a sketch per column, since merging the sketches of
    all tasks takes one task longer than everything else.  A group gives evenly spaced quantiles that count
    for its rows; the brackets are read off their union and leave room for the error of both steps, so they
    hold for any way the rows are dealt out.  A side that no value is sure to bound is infinite.
    """
    steps = max(accuracy // 4, 1)
    marks = F.expr(f"array({', '.join(f'{i / steps!r}D' for i in range(1, steps + 1))})")
    grouped = df.groupBy((F.spark_partition_id() % sketches).alias("_group")).agg(
        *[
            F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.percentile_approx(c, marks, accuracy).alias("marks")).alias(c)
            for c in columns
        ]
    )
    # the ranks between two neighbouring marks of a group are its n rows over `steps`
    points = (
        grouped.select(F.inline(F.array(*columns)))
        .select("feature", "n", F.explode("marks").alias("value"))
        .groupBy("feature", "value")
        .agg(F.sum("n").alias("n"))
    )
    key = Window.partitionBy("feature")
    run = key.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto, rows = F.sum("n").over(run) / steps, F.sum("n").over(key) / steps
    placed = points.select("feature", "value", upto.alias("upto"), (F.col("n") / steps).alias("own"), rows.alias("rows"))
    # each sketch errs by 1 / accuracy of its rows and by less than two ranks
    error = 2.0 / accuracy * F.col("rows") + 2 * sketches

    def edges(c):
        here = F.col("feature") == c
        for i, p in enumerate(probabilities):
            rank = p * F.col("rows")
            lo = here & (F.col("upto") - F.col("own") <= rank - error - F.col("rows") / steps)
            hi = here & (F.col("upto") >= rank + error)
            yield F.coalesce(F.max(F.when(lo, F.col("value"))), F.lit(float("-inf"))).alias(f"{c}_lo{i}")
            yield F.coalesce(F.min(F.when(hi, F.col("value"))), F.lit(float("inf"))).alias(f"{c}_hi{i}")

    return placed.agg(F.struct(*[e for c in columns for e in edges(c)]).alias("edges"))


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], accuracy: int = 10000
) -> DataFrame:
    """Exact linearly interpolated quantiles: columns feature, probability, quantile.

    Sketches bracket each wanted rank from both sides, then only values inside the
    brackets (about 18/accuracy of the rows) are counted exactly.  Nulls and
    NaNs are ignored.  The same steps run for every number of rows.
    """
    clean = df.select(
        *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]
    )
    bounds = quantile_brackets(clean, columns, probabilities, accuracy)
    # a scalar subquery: one row of 2 * |columns| * |probabilities| numbers
    located = clean.select("*", bounds.scalar().alias("_edges"))
    wanted = [
        (c, p, F.col(f"_edges.`{c}_lo{i}`"), F.col(f"_edges.`{c}_hi{i}`"))
        for c in columns
        for i, p in enumerate(probabilities)
    ]

    def named(c, p, *rest):
        return F.struct(F.lit(c).alias("feature"), F.lit(float(p)).alias("probability"), *rest)

    # one row of counts, turned into |columns| * |probabilities| rows
    sizes = located.agg(
        F.array(
            *[
                named(
                    c,
                    p,
                    F.count(c).alias("total"),
                    F.count_if(F.col(c) < lo).alias("below"),
                    F.count_if(F.col(c).between(lo, hi)).alias("within"),
                    # on few rows the wanted ranks may lie next to the bracket
                    F.max(F.when(F.col(c) < lo, F.col(c))).alias("lower"),
                    F.min(F.when(F.col(c) > hi, F.col(c))).alias("upper"),
                )
                for c, p, lo, hi in wanted
            ]
        ).alias("sizes")
    ).select(F.inline("sizes"))
    inside = [F.coalesce(F.col(c).between(lo, hi), F.lit(False)) for c, _, lo, hi in wanted]
    near = inside[0]
    for test in inside[1:]:
        near = near | test
    per = ["feature", "probability"]
    counted = (
        located.filter(near)
        .select(
            F.inline(
                F.array(
                    *[
                        named(c, p, F.when(test, F.col(c)).alias("value"))
                        for (c, p, _, _), test in zip(wanted, inside)
                    ]
                )
            )
        )
        .filter(F.col("value").isNotNull())
        .groupBy(*per, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    run = Window.partitionBy(*per).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        counted.withColumn("upto", F.sum("n").over(run))
        .join(F.broadcast(sizes), per)
        .withColumn("rank", F.col("probability") * (F.col("total") - 1))
        .withColumn("last", F.col("below") + F.col("upto") - 1)
        .withColumn("first", F.col("last") - F.col("n") + 1)
    )

    def at(rank):
        covers = (F.col("first") <= rank) & (F.col("last") >= rank)
        return F.max(
            F.when(covers, F.col("value"))
            .when(rank == F.col("below") - 1, F.col("lower"))
            .when(rank == F.col("below") + F.col("within"), F.col("upper"))
        )

    picked = placed.groupBy(*per).agg(
        at(F.floor("rank")).alias("v0"), at(F.ceil("rank")).alias("v1"), F.max("rank").alias("rank")
    )
    return picked.select(
        *per,
        F.when(
            F.col("v0").isNull() | F.col("v1").isNull(),
            F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"),
        )
        .otherwise(
            F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("rank") - F.floor("rank"))
        )
        .alias("quantile"),
    )

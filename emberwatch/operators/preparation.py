"""Model input: column choice, cleaning, scaling, splitting, thresholds and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.operators.ordering import exact_quantiles

NUMERIC = {"byte", "short", "integer", "long", "float", "double", "decimal"}


def is_numeric(field) -> bool:
    return field.dataType.typeName() in NUMERIC


def feature_columns(df: DataFrame, excluded=D.NON_FEATURES) -> list[str]:
    """Numeric columns outside the exclusion list, in schema order."""
    return [f.name for f in df.schema.fields if f.name not in excluded and is_numeric(f)]


def select_features(df: DataFrame, excluded=D.NON_FEATURES) -> DataFrame:
    """block_id plus every usable feature column, checked by schema only."""
    if "block_id" not in df.columns:
        raise ValueError("the feature table needs a 'block_id' column")
    columns = feature_columns(df, excluded)
    if not columns:
        raise ValueError("no usable numeric feature columns")
    return df.select("block_id", *columns)


def reconcile_columns(
    df: DataFrame,
    wanted: list[str] | None,
    expected: int | None = None,
    aliases: dict = D.COLUMN_ALIASES,
    excluded=D.NON_FEATURES_EVALUATION,
) -> DataFrame:
    """Keep the non-feature columns and bring the features to the model's column list.

    A missing column is taken from its known alias and renamed; if the count still
    differs from ``expected``, the first numeric columns in schema order are used.
    """
    available = feature_columns(df, excluded)
    expected = expected or (len(wanted) if wanted else len(available))
    others = [c for c in df.columns if c not in available]
    if wanted is not None:
        chosen = []
        for name in wanted:
            if name in available:
                chosen.append(F.col(name))
            elif aliases.get(name) in available:
                chosen.append(F.col(aliases[name]).alias(name))
        if len(chosen) == expected:
            return df.select(*others, *chosen)
    if len(available) < expected:
        raise ValueError(f"{len(available)} usable numeric columns, the model expects {expected}")
    return df.select(*others, *available[:expected])


def finite_or_null(df: DataFrame, columns: list[str]) -> DataFrame:
    def clean(c):
        value = F.col(c).cast("double")
        # Spark orders NaN above infinity, so one comparison excludes both
        return F.when(F.abs(value) < float("inf"), value)

    return df.withColumns({c: clean(c) for c in columns})


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """±inf and NaN become null, nulls become the exact column median.

    One pass finds the columns that have gaps; medians are computed for those alone.
    """
    work = finite_or_null(df, columns)
    gaps = work.agg(*[F.bool_or(F.col(c).isNull()).alias(c) for c in columns]).first()
    gappy = [c for c in columns if gaps[c]]
    if not gappy:
        return work
    medians = exact_quantiles(work, gappy, [0.5])
    # one row per gappy column, turned into one struct by conditional aggregates
    row = medians.agg(
        F.struct(
            *[F.max(F.when(F.col("feature") == c, F.col("quantile"))).alias(c) for c in gappy]
        ).alias("m")
    ).scalar()
    filled = work.select("*", row.alias("_m"))
    return filled.withColumns({c: F.coalesce(F.col(c), F.col(f"_m.`{c}`")) for c in gappy}).drop("_m")


def zero_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scoring input: absent columns and non-finite values become 0."""
    absent = {c: F.lit(0.0) for c in columns if c not in df.columns}
    return finite_or_null(df.withColumns(absent) if absent else df, columns).fillna(0.0, columns)


def split_fraction(key: str, seed: int = 42):
    """Number in [0, 10000) that depends on the key and the seed only."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10000


def train_test_split(df: DataFrame, key: str = "block_id", test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` ('train' or 'test'); independent of partitioning, no shuffle."""
    limit = round((1 - test_size) * 10000)
    return df.withColumn(
        "split", F.when(split_fraction(key, seed) < limit, "train").otherwise("test")
    )


def scale_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: struct ``s`` with <column>_mean and <column>_std (population, 0 → 1)."""
    cells = []
    for c in columns:
        deviation = F.stddev_pop(c)
        cells += [
            F.avg(c).alias(f"{c}_mean"),
            F.when(deviation == 0, 1.0).otherwise(deviation).alias(f"{c}_std"),
        ]
    return df.agg(F.struct(*cells).alias("s"))


def standard_scale(df: DataFrame, columns: list[str], fitted_on: DataFrame | None = None) -> DataFrame:
    stats = scale_stats(df if fitted_on is None else fitted_on, columns).scalar()
    work = df.select("*", stats.alias("_s"))
    return work.withColumns(
        {c: (F.col(c) - F.col(f"_s.`{c}_mean`")) / F.col(f"_s.`{c}_std`") for c in columns}
    ).drop("_s")


def threshold_anomaly(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.withColumn("is_anomaly", F.col(score) < threshold)


def score_distribution(df: DataFrame, score: str, flagged) -> DataFrame:
    """One-row report on scores; percentiles interpolate linearly."""
    base = df.agg(
        F.count(F.lit(1)).alias("test_blocks"),
        F.count_if(flagged).alias("flagged_anomalies"),
        F.round(F.try_divide(100 * F.count_if(flagged), F.count(F.lit(1))), 2).alias("anomaly_rate_pct"),
        F.round(F.avg(score), 6).alias("score_mean"),
        F.round(F.stddev_pop(score), 6).alias("score_std"),
        F.round(F.min(score), 6).alias("score_min"),
        F.round(F.max(score), 6).alias("score_max"),
    )
    marks = exact_quantiles(df, [score], [0.05, 0.95])

    def mark(p):
        return marks.filter(F.col("probability") == p).select(F.round("quantile", 6)).scalar()

    return base.select("*", mark(0.05).alias("score_p5"), mark(0.95).alias("score_p95"))

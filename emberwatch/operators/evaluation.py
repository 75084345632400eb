"""Evaluation of predictions against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.functions.lookup import lookup
from emberwatch.operators.ordering import cumulative_by_value


def clean_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def join_truth(features: DataFrame, truth: DataFrame, check: bool = True) -> DataFrame:
    """Inner join on block_id = BlockId; an empty result is an error when checked."""
    truth = clean_header(truth)
    if not {"BlockId", "Label"} <= set(truth.columns):
        raise ValueError(f"ground truth needs BlockId and Label, found {truth.columns}")
    joined = features.join(truth, F.col("block_id") == F.col("BlockId"))
    if check and joined.isEmpty():
        raise ValueError("no block_id matches a BlockId; were both made from the same log?")
    return joined


def map_labels(df: DataFrame, label: str = "Label", out: str = "y_true") -> DataFrame:
    """Normal → +1, Anomaly → -1; rows with any other label are dropped."""
    sign = lookup(D.TRUTH_SIGN, F.col(label), value_type="int")
    return df.withColumn(out, sign).filter(F.col(out).isNotNull())


def _side(positive: str) -> int:
    return D.TRUTH_SIGN[positive]


def confusion_matrix(df: DataFrame, truth="y_true", pred="y_pred", positive: str = "Anomaly") -> DataFrame:
    p = _side(positive)
    is_true, is_pred = F.col(truth) == p, F.col(pred) == p
    n = F.count(F.lit(1))
    return df.agg(
        F.count_if(is_true & is_pred).alias("true_positives"),
        F.count_if(~is_true & ~is_pred).alias("true_negatives"),
        F.count_if(~is_true & is_pred).alias("false_positives"),
        F.count_if(is_true & ~is_pred).alias("false_negatives"),
        F.round(F.try_divide(F.count_if(F.col(truth) == F.col(pred)), n), 4).alias("accuracy"),
    )


def classification_report(df: DataFrame, truth="y_true", pred="y_pred") -> DataFrame:
    """Per class, macro and weighted precision, recall, F1 and support (0 when undefined)."""
    counts = df.agg(
        *[
            F.count_if(F.col(column) == sign).alias(f"{name}_{kind}")
            for name, sign in D.TRUTH_SIGN.items()
            for kind, column in (("true", truth), ("pred", pred))
        ],
        *[
            F.count_if((F.col(truth) == sign) & (F.col(pred) == sign)).alias(f"{name}_hit")
            for name, sign in D.TRUTH_SIGN.items()
        ],
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    rows = []
    for name in D.TRUTH_SIGN:
        hit, actual, given = (F.col(f"{name}_{k}") for k in ("hit", "true", "pred"))
        # F1 = 2TP / (actual + predicted)
        rows.append(
            F.struct(
                F.lit(name).alias("class"),
                ratio(hit, given).alias("precision"),
                ratio(hit, actual).alias("recall"),
                ratio(2 * hit, actual + given).alias("f1_score"),
                actual.alias("support"),
            )
        )
    per_class = counts.select(F.inline(F.array(*rows)))
    measures = ["precision", "recall", "f1_score"]
    weight = F.col("support")
    means = per_class.agg(
        F.struct(
            F.lit("macro avg").alias("class"),
            *[F.avg(m).alias(m) for m in measures],
            F.sum(weight).alias("support"),
        ).alias("macro"),
        F.struct(
            F.lit("weighted avg").alias("class"),
            *[ratio(F.sum(F.col(m) * weight), F.sum(weight)).alias(m) for m in measures],
            F.sum(weight).alias("support"),
        ).alias("weighted"),
    ).select(F.inline(F.array("macro", "weighted")))
    return per_class.unionByName(means)


def _ordered_counts(df: DataFrame, score: str, truth: str, buckets: int) -> DataFrame:
    anomaly = F.col(truth) == D.TRUTH_SIGN["Anomaly"]
    return cumulative_by_value(
        df.withColumn("_s", F.col(score).cast("double")),
        "_s",
        {"pos": F.count_if(anomaly), "neg": F.count_if(~anomaly)},
        buckets,
    )


def roc_auc(df: DataFrame, score: str, truth: str = "y_true", buckets: int = 1024) -> DataFrame:
    """Exact area under the ROC curve; low scores mean anomaly; null with one class.

    Mann-Whitney form: for each distinct score, normal rows above it count in full and
    ties count half.
    """
    ordered = _ordered_counts(df, score, truth, buckets)
    pos, neg = F.sum("pos"), F.sum("neg")
    pairs = F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2))
    return ordered.agg(F.try_divide(pairs, (pos.cast("double") * neg)).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, truth: str = "y_true", buckets: int = 1024) -> DataFrame:
    """Step-wise average precision over distinct scores, most anomalous first."""
    ordered = _ordered_counts(df, score, truth, buckets)
    found = F.col("pos_before") + F.col("pos")
    seen = found + F.col("neg_before") + F.col("neg")
    return ordered.agg(
        F.try_divide(F.sum(F.col("pos") * (found / seen)), F.sum("pos")).alias("avg_precision")
    )


def threat_category_analysis(
    df: DataFrame, truth="y_true", pred="y_pred", categories=tuple(D.BATCH_KEYWORDS)
) -> DataFrame:
    """Blocks with hits, true anomalies among them, detected ones and rate per category."""
    present = [c for c in categories if f"{c}_hits" in df.columns]
    totals = []
    for c in present:
        hit = F.col(f"{c}_hits") > 0
        anomaly = hit & (F.col(truth) == -1)
        totals += [
            F.count_if(hit).alias(f"{c}_a"),
            F.count_if(anomaly).alias(f"{c}_b"),
            F.count_if(anomaly & (F.col(pred) == -1)).alias(f"{c}_c"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("category"),
            F.col(f"{c}_a").alias("blocks_with_hits"),
            F.col(f"{c}_b").alias("true_anomaly_hits"),
            F.col(f"{c}_c").alias("correctly_detected"),
            F.round(F.try_divide(100 * F.col(f"{c}_c"), F.col(f"{c}_b")), 1).alias("detection_rate_pct"),
        )
        for c in present
    ]
    return df.agg(*totals).select(F.inline(F.array(*rows)))


def report(df: DataFrame, score: str, truth="y_true", pred="y_pred") -> DataFrame:
    """All measures of judged rows in long form: (section, metric, value).

    Sections are ``overall``, the classes with their averages, and the threat categories that ``df`` has
    hit columns for.  ``df`` is read once per measure, so pass a written table.
    """

    def long(part: DataFrame, name: str | None = None) -> DataFrame:
        section = F.lit("overall") if name is None else F.col(name)
        cells = [
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
            for c in part.columns
            if c != name
        ]
        return part.select(section.alias("section"), F.inline(F.array(*cells)))

    out = long(confusion_matrix(df, truth, pred))
    for part in (
        long(roc_auc(df, score, truth)),
        long(average_precision(df, score, truth)),
        long(classification_report(df, truth, pred), "class"),
    ):
        out = out.unionByName(part)
    if any(f"{c}_hits" in df.columns for c in D.BATCH_KEYWORDS):
        out = out.unionByName(long(threat_category_analysis(df, truth, pred), "category"))
    return out


REPORT_SCHEMA = (
    "evaluated_at timestamp, n_features bigint, feature_columns array<string>, n_blocks bigint,"
    " metrics map<string, map<string, double>>, threat_analysis map<string, map<string, double>>"
)


def write_report(report: DataFrame, blocks: int, columns: list[str], path: str) -> None:
    """One JSON object: when, features, number of blocks, and the measures by section.

    The report has some dozens of rows whatever the input, so they gather in one map.
    """
    section = F.map_from_entries(F.collect_list(F.struct("metric", "value")))
    sections = report.groupBy("section").agg(section.alias("values"))
    threats = F.col("section").isin(*D.BATCH_KEYWORDS)

    def gathered(which: Column, name: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(which, F.struct("section", "values")))).alias(name)

    sections.agg(gathered(~threats, "metrics"), gathered(threats, "threat_analysis")).select(
        F.current_timestamp().alias("evaluated_at"),
        F.lit(len(columns)).cast("bigint").alias("n_features"),
        F.array(*[F.lit(c) for c in columns]).cast("array<string>").alias("feature_columns"),
        F.lit(blocks).cast("bigint").alias("n_blocks"),
        "metrics",
        "threat_analysis",
    ).coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).json(path)

"""Analyst feedback, retraining triggers, machine health and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.functions.lookup import lookup

AUTO_RETRAIN_LABELS = 10
ONLINE_SECONDS = 15 * 60


def valid_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("label").isin(D.ANALYST_LABELS))


def rejected_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(~F.coalesce(F.col("label").isin(D.ANALYST_LABELS), F.lit(False)))


def latest_by(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """Last row per key.  An aggregate, so rows of a hot key combine before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(
        *key, "_row.*"
    )


def latest_label(labels: DataFrame) -> DataFrame:
    return latest_by(labels, ["block_id"], "labelled_at", "seq")


def latest_health(health: DataFrame) -> DataFrame:
    """Newest snapshot per machine; machine names are compared lower-cased."""
    named = health.withColumn("machine", F.lower(F.trim("machine"))).filter(F.col("machine") != "")
    return latest_by(named, ["machine"], "updated_at", "seq")


def machine_online(health: DataFrame, as_of: Column, seconds: int = ONLINE_SECONDS) -> DataFrame:
    """Online when last seen less than ``seconds`` before ``as_of``; unknown → offline."""
    age = F.unix_micros(as_of) - F.unix_micros(F.col("updated_at"))
    return latest_health(health).withColumn(
        "online", F.coalesce(age < seconds * 1_000_000, F.lit(False))
    )


def last_retrain(log: DataFrame) -> DataFrame:
    """Time and contamination of the last retrain record; nulls when there is none."""
    last = F.max_by(
        F.struct("ts", "contamination"), F.when(F.col("event") == "model_retrained", F.col("seq"))
    )
    return log.agg(last.alias("r")).select(
        F.col("r.ts").alias("last_retrain_at"), F.col("r.contamination").alias("last_contamination")
    )


def labels_since_retrain(labels: DataFrame, log: DataFrame) -> DataFrame:
    """Labels newer than the last retrain; all of them when there was none."""
    since = last_retrain(log).select("last_retrain_at").scalar()
    return labels.filter(since.isNull() | (F.col("labelled_at") > since))


def retrain_due(labels: DataFrame, log: DataFrame, needed: int = AUTO_RETRAIN_LABELS) -> DataFrame:
    return labels_since_retrain(labels, log).agg(
        F.count(F.lit(1)).alias("new_labels"), (F.count(F.lit(1)) >= needed).alias("due")
    )


def feedback_metrics(labels: DataFrame) -> DataFrame:
    """Label counts with precision, recall and F1, null where undefined."""
    counts = labels.agg(*[F.count_if(F.col("label") == n).alias(n) for n in D.ANALYST_LABELS])
    tp, fp = F.col("true_positive"), F.col("false_positive")
    tn, fn = F.col("true_negative"), F.col("false_negative")
    precision = F.round(F.try_divide(tp, tp + fp), 4)
    recall = F.round(F.try_divide(tp, tp + fn), 4)
    rated = counts.select(
        (tp + fp + tn + fn).alias("total_labelled"),
        *D.ANALYST_LABELS,
        precision.alias("precision"),
        recall.alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn(
        "f1_score", F.when((p > 0) & (r > 0), F.round(2 * p * r / (p + r), 4))
    )


def feedback_report(latest: DataFrame, log: DataFrame, needed: int = AUTO_RETRAIN_LABELS) -> DataFrame:
    """Live metrics with the last retrain and the labels that arrived since, one row."""
    last = last_retrain(log)
    fresh = labels_since_retrain(latest, log).agg(F.count(F.lit(1)))
    return feedback_metrics(latest).select(
        "*",
        last.select("last_retrain_at").scalar().alias("last_retrain_at"),
        last.select("last_contamination").scalar().alias("last_contamination"),
        fresh.scalar().alias("labels_since_retrain"),
        F.lit(needed).alias("auto_retrain_threshold"),
    )


def feedback_audit(labels: DataFrame) -> DataFrame:
    """Audit rows of submitted labels, in the shape of the retrain log."""
    return labels.select(
        F.lit("feedback_submitted").alias("event"),
        F.col("labelled_at").alias("timestamp"),
        "block_id",
        "label",
        "note",
    )


def join_feedback(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Add feedback_label: -1 confirmed or missed anomaly, +1 normal, null unlabelled."""
    sign = lookup(D.FEEDBACK_SIGN, F.col("label"), value_type="int")
    signed = labels.select("block_id", sign.alias("feedback_label"))
    return features.join(signed, "block_id", "left")


def contamination_estimate(joined: DataFrame) -> DataFrame:
    """Share of anomalies among labelled rows in [0.01, 0.5]; 0.01 below five labels."""
    n = F.count("feedback_label")
    anomalies = F.count_if(F.col("feedback_label") == -1)
    share = F.least(F.lit(0.5), F.greatest(F.lit(0.01), F.try_divide(anomalies, n)))
    return joined.agg(
        n.alias("n_labelled"),
        anomalies.alias("n_anomalies"),
        F.when(n >= 5, share).otherwise(0.01).alias("contamination"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Totals, pass rate and severity counts of a detection run."""
    total = F.count(F.lit(1))
    passed = F.count_if(F.col("status") != "FAILED")
    severity = F.coalesce("severity", F.lit("MEDIUM"))
    return results.agg(
        total.alias("total_tests"),
        passed.alias("passed"),
        (total - passed).alias("failed"),
        F.coalesce(
            F.when(total > 0, F.format_string("%.1f%%", F.try_divide(100 * passed, total))),
            F.lit("N/A"),
        ).alias("pass_rate"),
        *[F.count_if(severity == s).alias(s.lower()) for s in D.PRIORITY_RANK],
    )

"""Whole jobs: ingest to features, training, evaluation and retraining."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.operators import evaluation, feedback, features, forest, parsing
from emberwatch.operators import preparation as prep
from emberwatch.session import written
from emberwatch.sources import text_files


@dataclass
class Training:
    model: forest.IsolationForest
    report: DataFrame
    scored_test: DataFrame


def features_from_logs(spark: SparkSession, path: str, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Directory of log files → (block features, event features), both lazy."""
    staged = text_files.read_directory(spark, path, recursive)
    parsed = parsing.parsed_events(staged)
    return features.block_features(parsed), features.event_features(parsed)


def train(
    table: DataFrame,
    contamination: float = 0.01,
    trees: int = 100,
    max_samples: str | int | float = "auto",
    test_size: float = 0.2,
    seed: int = 42,
    path: str | None = None,
) -> Training:
    """Clean, split, fit, and report on the held-out part; optionally save the model."""
    spark = table.sparkSession
    chosen = prep.select_features(table)
    columns = [c for c in chosen.columns if c != "block_id"]
    # written once: fitting reads it for statistics, the sample and the offset
    clean = written(
        prep.train_test_split(prep.impute_median(chosen, columns), "block_id", test_size, seed),
        "training",
    )
    model = forest.fit(
        clean.filter(F.col("split") == "train"),
        columns,
        trees=trees,
        max_samples=max_samples,
        contamination=contamination,
        seed=seed,
    )
    scored = written(
        forest.score(clean.filter(F.col("split") == "test"), model).select(
            "block_id", "anomaly_score", "prediction"
        ),
        "scored-test",
    )
    report = prep.score_distribution(scored, "anomaly_score", F.col("prediction") == -1)
    sizes = clean.agg(F.count_if(F.col("split") == "train").alias("n"))
    settings = {
        "contamination": contamination,
        "n_estimators": trees,
        "max_samples": str(max_samples),
        "test_size": test_size,
        "random_state": seed,
        "n_features": len(columns),
    }
    report = report.select(
        *[F.lit(v).alias(k) for k, v in settings.items()], sizes.scalar().alias("train_blocks"), "*"
    )
    if path:
        model.save(spark, f"{path}/model")
        stamped = report.withColumn("trained_at", F.current_timestamp())
        stamped.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    return Training(model, report, scored)


def evaluate(
    table: DataFrame,
    truth: DataFrame,
    model: forest.IsolationForest,
    threshold: float | None = None,
    path: str | None = None,
) -> DataFrame:
    """Evaluation report in long form: (section, metric, value); ``path`` also takes it as JSON."""
    joined = evaluation.map_labels(evaluation.join_truth(table, truth))
    ready = prep.reconcile_columns(joined.drop("BlockId"), model.columns, excluded=[*D.NON_FEATURES_EVALUATION, "y_true"])
    filled = prep.impute_median(ready, model.columns)
    scored = forest.score(filled, model)
    limit = 0.0 if threshold is None else threshold
    rows = written(
        scored.select(
            "block_id",
            "y_true",
            "anomaly_score",
            F.when(F.col("anomaly_score") < limit, -1).otherwise(1).alias("y_pred"),
            *[c for c in scored.columns if c.endswith("_hits")],
        ),
        "evaluated",
    )
    report = evaluation.report(rows, "anomaly_score")
    if path:
        evaluation.write_report(report, rows.count(), model.columns, path)
    return report


def retrain(
    windows_events: DataFrame,
    fallback: DataFrame,
    labels: DataFrame,
    as_of,
    min_events: int = 3,
    path: str | None = None,
    **settings,
) -> tuple[Training, DataFrame]:
    """Refit from the latest Windows events, with contamination set by feedback.

    Returns the training and its audit row.  ``fallback`` is used when no Windows block
    is large enough.  Labels steer the contamination only; the forest is unsupervised.
    """
    spark = fallback.sparkSession
    table = written(features.windows_block_features(windows_events, min_events=min_events), "windows-features")
    if table.isEmpty():
        table = fallback
    latest = feedback.latest_label(feedback.valid_labels(labels))
    facts = feedback.contamination_estimate(feedback.join_feedback(table, latest)).first()
    training = train(table, contamination=facts["contamination"], path=path, **settings)
    audit = latest.agg(F.count(F.lit(1)).alias("n_labels_used")).select(
        F.lit("model_retrained").alias("event"),
        F.lit(as_of).cast("timestamp").alias("timestamp"),
        F.lit(facts["contamination"]).alias("contamination"),
        "n_labels_used",
    )
    if path:
        audit.write.mode("append").json(f"{path}/audit")
    return training, audit


def end_to_end(
    spark: SparkSession, path: str, recursive: bool = False, model_path: str | None = None, **settings
) -> Training:
    """Log directory → trained model, without intermediate hand-over files."""
    blocks, _ = features_from_logs(spark, path, recursive)
    return train(written(blocks, "block-features"), path=model_path, **settings)

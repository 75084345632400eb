"""Queries on analyst feedback, retraining state, machine health and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.operators import evaluation, feedback
from emberwatch.plans import sqltext as S
from emberwatch.plans.registry import query, registered, rounded
from emberwatch.plans.views import cte, table, view
from emberwatch.session import fresh_dir, written

ALLOWED = ", ".join(S.quote(n) for n in D.ANALYST_LABELS)
LABELS = cte("label_log")
FEEDBACK = cte("label_log", "retrain_log")
CLEAN = f", labels2 AS (SELECT * FROM label_log WHERE label IN ({ALLOWED}))"
LATEST = (
    CLEAN
    + ", latest AS (SELECT block_id, max((labelled_at, seq)) AS o, arg_max(label, (labelled_at, seq)) AS label,"
    " arg_max(note, (labelled_at, seq)) AS note, arg_max(labelled_at, (labelled_at, seq)) AS labelled_at"
    " FROM labels2 GROUP BY block_id)"
)
RETRAIN = (
    ", r AS (SELECT arg_max(ts, seq) AS at_time, arg_max(contamination, seq) AS contamination"
    " FROM retrain_log WHERE event = 'model_retrained')"
)


def labels(spark, sf_dir):
    return feedback.valid_labels(view(spark, sf_dir, "label_log"))


@query("label_validate", oracle=LABELS + f" SELECT seq, label FROM label_log WHERE label IN ({ALLOWED})")
def label_validate(spark, sf_dir):
    return labels(spark, sf_dir).select("seq", "label")


@query("label_rejects", oracle=LABELS + f" SELECT seq, label FROM label_log WHERE label NOT IN ({ALLOWED})")
def label_rejects(spark, sf_dir):
    return feedback.rejected_labels(view(spark, sf_dir, "label_log")).select("seq", "label")


@query(
    "latest_label",
    oracle=LABELS + LATEST
    + " SELECT block_id, label, note, strftime(labelled_at, '%Y-%m-%d') AS labelled_on FROM latest",
)
def latest_label(spark, sf_dir):
    return feedback.latest_label(labels(spark, sf_dir)).select(
        "block_id", "label", "note", F.date_format("labelled_at", "yyyy-MM-dd").alias("labelled_on")
    )


@query(
    "latest_health",
    oracle=cte("health_log")
    + " SELECT lower(machine) AS machine, arg_max(cpu, (updated_at, seq)) AS cpu,"
    " arg_max(os, (updated_at, seq)) AS os, max(seq) FILTER (TRUE) * 0 + arg_max(seq, (updated_at, seq)) AS seq"
    " FROM health_log GROUP BY lower(machine)",
)
def latest_health(spark, sf_dir):
    return feedback.latest_health(view(spark, sf_dir, "health_log")).select("machine", "cpu", "os", "seq")


AS_OF = "2024-01-30 12:00:00"


@query(
    "machine_online",
    oracle=cte("health_log")
    + f" SELECT lower(machine) AS machine, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(updated_at))"
    " < 900 * 1000000)::INTEGER AS online FROM health_log GROUP BY lower(machine)",
)
def machine_online(spark, sf_dir):
    health = view(spark, sf_dir, "health_log")
    out = feedback.machine_online(health, F.lit(AS_OF).cast("timestamp"))
    return out.select("machine", F.col("online").cast("int").alias("online"))


@query(
    "last_retrain",
    oracle=FEEDBACK + RETRAIN
    + " SELECT strftime(at_time, '%Y-%m-%d') AS retrained_on, contamination FROM r",
)
def last_retrain(spark, sf_dir):
    return feedback.last_retrain(view(spark, sf_dir, "retrain_log")).select(
        F.date_format("last_retrain_at", "yyyy-MM-dd").alias("retrained_on"),
        F.col("last_contamination").alias("contamination"),
    )


@query(
    "labels_since_retrain",
    oracle=FEEDBACK + LATEST + RETRAIN
    + " SELECT o[2] AS seq, block_id FROM latest WHERE labelled_at > (SELECT at_time FROM r)",
)
def labels_since_retrain(spark, sf_dir):
    latest = feedback.latest_label(labels(spark, sf_dir))
    return feedback.labels_since_retrain(latest, view(spark, sf_dir, "retrain_log")).select("seq", "block_id")


@query(
    "retrain_due",
    oracle=FEEDBACK + LATEST + RETRAIN
    + " SELECT count(*) AS new_labels, (count(*) >= 10)::INTEGER AS due FROM latest"
    " WHERE labelled_at > (SELECT at_time FROM r)",
)
def retrain_due(spark, sf_dir):
    latest = feedback.latest_label(labels(spark, sf_dir))
    out = feedback.retrain_due(latest, view(spark, sf_dir, "retrain_log"))
    return out.withColumn("due", F.col("due").cast("int"))


@query(
    "feedback_metrics",
    oracle=LABELS + LATEST
    + ", c AS (SELECT "
    + ", ".join(f"count(*) FILTER (label = '{n}') AS {n}" for n in D.ANALYST_LABELS)
    + " FROM latest), p AS (SELECT *, round(true_positive / (true_positive + false_positive)::DOUBLE, 4) AS precision,"
    " round(true_positive / (true_positive + false_negative)::DOUBLE, 4) AS recall FROM c)"
    " SELECT *, true_positive + false_positive + true_negative + false_negative AS total_labelled,"
    " round(2 * precision * recall / (precision + recall), 4) AS f1_score FROM p",
)
def feedback_metrics(spark, sf_dir):
    return feedback.feedback_metrics(feedback.latest_label(labels(spark, sf_dir)))


@query(
    "feedback_report",
    oracle=FEEDBACK + LATEST + RETRAIN
    + " SELECT count(*) AS total_labelled,"
    " (SELECT strftime(at_time, '%Y-%m-%d') FROM r) AS retrained_on,"
    " (SELECT contamination FROM r) AS last_contamination,"
    " count(*) FILTER (labelled_at > (SELECT at_time FROM r)) AS labels_since_retrain,"
    " 10 AS auto_retrain_threshold FROM latest",
)
def feedback_report(spark, sf_dir):
    latest = feedback.latest_label(labels(spark, sf_dir))
    report = feedback.feedback_report(latest, view(spark, sf_dir, "retrain_log"))
    return report.select(
        "total_labelled",
        F.date_format("last_retrain_at", "yyyy-MM-dd").alias("retrained_on"),
        "last_contamination",
        "labels_since_retrain",
        "auto_retrain_threshold",
    )


BLOCKS = ", blocks AS (SELECT concat('app_', user_id) AS block_id, count(*) AS num_events FROM events GROUP BY ALL)"
SIGNED = (
    BLOCKS
    + ", signed AS (SELECT b.block_id, b.num_events, "
    + S.case_of("l.label", D.FEEDBACK_SIGN)
    + " AS feedback_label FROM blocks b LEFT JOIN latest l USING (block_id))"
)


def joined_feedback(spark, sf_dir):
    events = view(spark, sf_dir, "log_events")
    features = events.groupBy("block_id").agg(F.count(F.lit(1)).alias("num_events"))
    return feedback.join_feedback(features, feedback.latest_label(labels(spark, sf_dir)))


@query(
    "join_feedback",
    oracle=LABELS + LATEST + SIGNED + " SELECT block_id, num_events, feedback_label::DOUBLE AS feedback_label FROM signed",
)
def join_feedback(spark, sf_dir):
    # unlabelled blocks have a null, which the comparison carries as a floating-point column
    joined = joined_feedback(spark, sf_dir)
    return joined.withColumn("feedback_label", F.col("feedback_label").cast("double"))


@query(
    "contamination_estimate",
    oracle=LABELS + LATEST + SIGNED
    + " SELECT count(feedback_label) AS n_labelled, count(*) FILTER (feedback_label = -1) AS n_anomalies,"
    " round(CASE WHEN count(feedback_label) >= 5 THEN least(0.5::DOUBLE, greatest(0.01::DOUBLE,"
    " count(*) FILTER (feedback_label = -1) / count(feedback_label)::DOUBLE)) ELSE 0.01 END, 6) AS contamination"
    " FROM signed",
)
def contamination_estimate(spark, sf_dir):
    return rounded(feedback.contamination_estimate(joined_feedback(spark, sf_dir)))


RUN = (
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'FAILED' ELSE 'PASSED' END AS status,"
    " CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH'"
    " WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' END AS severity FROM "
)


@query(
    "run_summary",
    oracle=f"WITH run AS ({RUN} orders) SELECT count(*) AS total_tests,"
    " count(*) FILTER (status <> 'FAILED') AS passed, count(*) FILTER (status = 'FAILED') AS failed,"
    " concat(printf('%.1f', 100.0 * count(*) FILTER (status <> 'FAILED') / count(*)), '%') AS pass_rate,"
    " count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,"
    " count(*) FILTER (coalesce(severity, 'MEDIUM') = 'MEDIUM') AS medium,"
    " count(*) FILTER (severity = 'LOW') AS low FROM run",
)
def run_summary(spark, sf_dir):
    run = spark.sql(RUN + "{orders}", orders=table(spark, sf_dir, "orders"))
    return feedback.run_summary(run)


# --- evaluation: documents with toxicity labels, scored by length ----------------------

TRUTH = (
    "WITH joined AS (SELECT d.doc_id::VARCHAR AS block_id, l.toxic, d.n_chars,"
    " CASE l.toxic WHEN 1 THEN 'Anomaly' WHEN 0 THEN 'Normal' ELSE 'Unknown' END AS label,"
    " -(d.n_chars // 50)::DOUBLE AS score FROM documents d JOIN labels l USING (doc_id))"
    ", t AS (SELECT *, CASE label WHEN 'Normal' THEN 1 WHEN 'Anomaly' THEN -1 END AS y_true,"
    " CASE WHEN score < -40 THEN -1 ELSE 1 END AS y_pred FROM joined WHERE label IN ('Normal', 'Anomaly'))"
)


def joined_truth(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("block_id"),
        "n_chars",
        (-F.floor(F.col("n_chars") / 50).cast("double")).alias("score"),
        # threat columns of a block feature table
        (F.col("n_chars") % 3).alias("brute_force_hits"),
        F.when(F.col("lang") == "en", 1).otherwise(0).alias("privilege_esc_hits"),
        F.lit(0).alias("dos_hits"),
        (F.col("doc_id") % 2).alias("network_hits"),
    )
    truth = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias(" BlockId"),
        F.when(F.col("toxic") == 1, "Anomaly").when(F.col("toxic") == 0, "Normal").otherwise("Unknown").alias("Label "),
    )
    return evaluation.join_truth(docs, truth, check=False)


def evaluated(spark, sf_dir):
    mapped = evaluation.map_labels(joined_truth(spark, sf_dir))
    return mapped.withColumn("y_pred", F.when(F.col("score") < -40, -1).otherwise(1))


@query("join_features_labels", oracle=TRUTH + " SELECT block_id, n_chars, label AS \"Label\" FROM joined")
def join_features_labels(spark, sf_dir):
    return joined_truth(spark, sf_dir).select("block_id", "n_chars", "Label")


@query("label_map", oracle=TRUTH + " SELECT block_id, y_true FROM t")
def label_map(spark, sf_dir):
    return evaluated(spark, sf_dir).select("block_id", "y_true")


@query(
    "confusion_matrix",
    oracle=TRUTH
    + " SELECT count(*) FILTER (y_true = -1 AND y_pred = -1) AS true_positives,"
    " count(*) FILTER (y_true = 1 AND y_pred = 1) AS true_negatives,"
    " count(*) FILTER (y_true = 1 AND y_pred = -1) AS false_positives,"
    " count(*) FILTER (y_true = -1 AND y_pred = 1) AS false_negatives,"
    " round(count(*) FILTER (y_true = y_pred) / count(*)::DOUBLE, 4) AS accuracy FROM t",
)
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(evaluated(spark, sf_dir))


@query(
    "roc_auc",
    oracle=TRUTH
    + ", ranked AS (SELECT y_true, rank() OVER (ORDER BY -score) AS r,"
    " count(*) OVER (PARTITION BY score) AS ties FROM t)"
    ", s AS (SELECT sum(r + (ties - 1) / 2.0::DOUBLE) FILTER (y_true = -1) AS rank_sum,"
    " count(*) FILTER (y_true = -1)::DOUBLE AS p, count(*) FILTER (y_true = 1)::DOUBLE AS n FROM ranked)"
    " SELECT round((rank_sum - p * (p + 1) / 2) / (p * n), 6) AS roc_auc FROM s",
)
def roc_auc(spark, sf_dir):
    return rounded(evaluation.roc_auc(evaluated(spark, sf_dir), "score"))


@query(
    "average_precision",
    oracle=TRUTH
    + ", s AS (SELECT score, count(*) FILTER (y_true = -1)::DOUBLE AS p, count(*)::DOUBLE AS n FROM t GROUP BY score)"
    ", c AS (SELECT p, sum(p) OVER (ORDER BY score) AS cp, sum(n) OVER (ORDER BY score) AS cn FROM s)"
    " SELECT round(sum(p * cp / cn) / sum(p), 6) AS avg_precision FROM c",
)
def average_precision(spark, sf_dir):
    return rounded(evaluation.average_precision(evaluated(spark, sf_dir), "score"))


CLASS_ROW = (
    "SELECT '{name}' AS class, coalesce(hit / nullif(pred, 0), 0.0) AS precision,"
    " coalesce(hit / nullif(act, 0), 0.0) AS recall, coalesce(2 * hit / nullif(act + pred, 0), 0.0) AS f1_score,"
    " act::BIGINT AS support FROM (SELECT count(*) FILTER (y_true = {v} AND y_pred = {v})::DOUBLE AS hit,"
    " count(*) FILTER (y_pred = {v})::DOUBLE AS pred, count(*) FILTER (y_true = {v})::DOUBLE AS act FROM t)"
)


@query(
    "classification_report",
    oracle=TRUTH
    + ", per AS ("
    + " UNION ALL ".join(CLASS_ROW.format(name=n, v=v) for n, v in D.TRUTH_SIGN.items())
    + "), whole AS (SELECT * FROM per UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score),"
    " sum(support)::BIGINT FROM per UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),"
    " sum(recall * support) / sum(support), sum(f1_score * support) / sum(support), sum(support)::BIGINT FROM per)"
    " SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall,"
    " round(f1_score, 6) AS f1_score, support FROM whole",
)
def classification_report(spark, sf_dir):
    return rounded(evaluation.classification_report(evaluated(spark, sf_dir)))


THREATS = {
    "brute_force": "n_chars % 3 > 0",
    "privilege_esc": "lang = 'en'",
    "dos": "FALSE",
    "network": "doc_id % 2 > 0",
}


@query(
    "threat_category_analysis",
    oracle=TRUTH
    + ", w AS (SELECT t.y_true, t.y_pred, d.n_chars, d.lang, d.doc_id FROM t JOIN documents d ON t.block_id = d.doc_id::VARCHAR) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS category, count(*) FILTER ({cond}) AS blocks_with_hits,"
        f" count(*) FILTER ({cond} AND y_true = -1) AS true_anomaly_hits,"
        f" count(*) FILTER ({cond} AND y_true = -1 AND y_pred = -1) AS correctly_detected,"
        f" round(100.0::DOUBLE * count(*) FILTER ({cond} AND y_true = -1 AND y_pred = -1)"
        f" / nullif(count(*) FILTER ({cond} AND y_true = -1), 0), 1) AS detection_rate_pct FROM w"
        for c, cond in THREATS.items()
    ),
)
def threat_category_analysis(spark, sf_dir):
    return evaluation.threat_category_analysis(evaluated(spark, sf_dir))


OVERALL = {
    "confusion_matrix": ["true_positives", "true_negatives", "false_positives", "false_negatives", "accuracy"],
    "roc_auc": ["roc_auc"],
    "average_precision": ["avg_precision"],
}
CLASS_MEASURES = ["precision", "recall", "f1_score", "support"]
THREAT_MEASURES = ["blocks_with_hits", "true_anomaly_hits", "correctly_detected", "detection_rate_pct"]


def long_sql(name: str, section: str, measures: list[str]) -> str:
    """The rows of an earlier query's SQL in long form."""
    return " UNION ALL ".join(
        f"SELECT {section} AS section, '{m}' AS metric, round({m}::DOUBLE, 6) AS value FROM ({registered(name)})"
        for m in measures
    )


@query(
    "evaluation_report",
    oracle=" UNION ALL ".join(
        [
            *[long_sql(name, "'overall'", measures) for name, measures in OVERALL.items()],
            long_sql("classification_report", "class", CLASS_MEASURES),
            long_sql("threat_category_analysis", "category", THREAT_MEASURES),
            f"SELECT 'report' AS section, 'n_blocks' AS metric, count(*)::DOUBLE AS value FROM ({registered('label_map')})",
            "SELECT 'report', 'n_features', 2::DOUBLE",
        ]
    ),
)
def evaluation_report(spark, sf_dir):
    """The whole report of judged rows, written as JSON and read back."""
    path = fresh_dir(spark, "evaluation")
    rows = written(evaluated(spark, sf_dir), "judged")
    evaluation.write_report(evaluation.report(rows, "score"), rows.count(), ["n_chars", "network_hits"], path)
    back = evaluation.read_report(spark, path)
    measures = back.select(F.explode(F.map_concat("metrics", "threat_analysis")).alias("section", "values")).select(
        "section", F.explode("values").alias("metric", "value")
    )
    sizes = back.select(
        F.lit("report").alias("section"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                    for c in ("n_blocks", "n_features")
                ]
            )
        ),
    )
    return rounded(measures.unionByName(sizes))

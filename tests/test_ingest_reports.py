"""Agent ingest as one job, and the reports that jobs leave behind."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.operators import alerts, evaluation, forest, preparation
from emberwatch.operators.features import realtime_block_features
from emberwatch.plans import features_queries as FQ
from emberwatch.streaming import jobs

T0 = datetime(2024, 1, 1)
SCHEMA = "payload string, received_at timestamp"


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    history = prepared(realtime_block_features(FQ.parsed_windows(spark, sf_dir)))
    return forest.fit(history, D.MODEL_FEATURES, trees=20, contamination=0.05)


def prepared(blocks):
    return preparation.zero_fill(blocks, D.MODEL_FEATURES)


def send(spark, folder, *batches):
    rows = [(p if p is None or isinstance(p, str) else json.dumps(p), at) for p, at in batches]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder + "/in")


def ingest(spark, folder, model, **settings):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    job = jobs.agent_ingest_job(stream, model, folder + "/out", folder + "/mark", **settings)
    job.awaitTermination()
    return job


def lines(text, n=1, source="web1"):
    return [{"log": text, "source": source}] * n


def test_rules_add_up_over_batches_and_restarts(spark, folder, model):
    """Three failed logons raise an alert in whatever batches they come, and never a second one."""
    send(spark, folder, (lines("failed password for alice"), T0), (lines("failed password for alice"), T0 + timedelta(seconds=5)))
    first = ingest(spark, folder, model)
    assert first.alerts().count() == 0 and first.events().count() == 2
    send(spark, folder, (lines("failed password for alice", 2), T0 + timedelta(seconds=9)))
    fired = ingest(spark, folder, model).alerts().filter("rule_based").collect()
    assert [(r["block_id"], r["threat_categories"], r["num_events"]) for r in fired] == [("agent_web1_20240101_0000", ["brute_force"], 4)]
    assert fired[0]["source_machine"] == "web1" and fired[0]["description"].endswith("(4 indicator(s))")
    send(spark, folder, (lines("failed password for alice", 5), T0 + timedelta(seconds=20)))
    again = ingest(spark, folder, model)
    assert again.alerts().filter("rule_based").count() == 1 and again.events().count() == 9


def test_single_events_are_scored_once_their_minute_has_passed(spark, folder, model):
    send(spark, folder, (lines("quiet line"), T0), (lines("late enough"), T0 + timedelta(hours=1)))
    blocks = ingest(spark, folder, model, threshold=2.0).blocks().collect()
    assert [(r["block_id"], r["num_events"]) for r in blocks] == [("agent_web1_20240101_0000", 1)]


def test_model_alerts_say_what_they_are(spark, folder, model):
    """Every score lies below a threshold of two, so every closed block is raised."""
    send(spark, folder, (lines("failed password for alice", 3), T0), (lines("later"), T0 + timedelta(hours=1)))
    raised = ingest(spark, folder, model, threshold=2.0).alerts().filter(~F.col("rule_based")).collect()
    assert len(raised) == 1
    name = D.CVE_BY_CATEGORY["brute_force"]["name"]
    assert raised[0]["description"] == f"{raised[0]['priority']} — {name} | score {raised[0]['anomaly_score']:.4f}"
    assert raised[0]["vulnerability_name"] == name


def test_damaged_batches(spark, folder, model):
    """Null, malformed and empty payloads and blank lines hold no events; a null source is the agent."""
    payloads = [None, "{", "[]", "not json", [{"log": "  "}, {"log": None}, {"log": " kept ", "source": None}]]
    send(spark, folder, *[(p, T0) for p in payloads], (lines("timeless"), None))
    rows = ingest(spark, folder, model).events().orderBy("raw").collect()
    assert [(r["raw"], r["source"]) for r in rows] == [("kept", "agent"), ("timeless", "web1")]


def test_no_batches(spark, folder, model):
    spark.createDataFrame([], SCHEMA).write.parquet(folder + "/in")
    job = ingest(spark, folder, model)
    assert (job.events().count(), job.blocks().count(), job.alerts().count()) == (0, 0, 0)


def test_description_of_an_unknown_category(spark):
    rows = spark.createDataFrame(
        [("b", "m", -0.2, 3, 0, 0, 0, T0)],
        "block_id string, source_machine string, anomaly_score double, num_events int, error_count int,"
        " priority_hits int, dos_hits int, alert_at timestamp",
    )
    out = alerts.model_alerts(rows).first()
    assert out["description"] == f"CRITICAL — {D.CVE_GENERIC['name']} | score -0.2000"


JUDGED = "block_id string, y_true int, y_pred int, score double, dos_hits int"


def report_of(spark, folder, rows):
    judged = spark.createDataFrame(rows, JUDGED)
    evaluation.write_report(evaluation.report(judged, "score"), judged.count(), ["num_events"], folder + "/report")
    return evaluation.read_report(spark, folder + "/report").collect()


def test_evaluation_report_file(spark, folder):
    found = report_of(spark, folder, [("a", -1, -1, -0.2, 1), ("b", 1, 1, 0.3, 0), ("c", 1, -1, -0.1, 2), ("d", -1, 1, 0.1, 0)])
    assert len(found) == 1
    row = found[0]
    assert (row["n_blocks"], row["n_features"], row["feature_columns"]) == (4, 1, ["num_events"])
    overall = row["metrics"]["overall"]
    assert (overall["true_positives"], overall["false_positives"], overall["accuracy"]) == (1, 1, 0.5)
    assert overall["roc_auc"] == 0.75 and set(row["metrics"]) == {"overall", "Normal", "Anomaly", "macro avg", "weighted avg"}
    assert row["threat_analysis"] == {
        "dos": {"blocks_with_hits": 2.0, "true_anomaly_hits": 1.0, "correctly_detected": 1.0, "detection_rate_pct": 100.0}
    }


@pytest.mark.parametrize("rows", [[], [("a", 1, 1, 0.5, 0)]], ids=["empty", "one class"])
def test_evaluation_report_without_both_classes(spark, folder, rows):
    """Undefined measures are null; the report is still whole."""
    row = report_of(spark, folder, rows)[0]
    assert row["n_blocks"] == len(rows) and row["metrics"]["overall"]["roc_auc"] is None
    assert row["metrics"]["Anomaly"]["support"] == 0 and row["threat_analysis"]["dos"]["detection_rate_pct"] is None

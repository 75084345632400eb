import glob
import hashlib
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.functions import alerting
from emberwatch.operators import alerts, feedback
from emberwatch.operators.cooldown import cooldown

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "score, hits, priority, cvss",
    [
        (0.02, 0, "CRITICAL", 9.0), (0.0, 0, "CRITICAL", 10.0), (0.05, 0, "HIGH", 7.0), (0.08, 0, "MEDIUM", 4.0),
        (0.09, 0, "LOW", 2.0), (0.2, 0, "LOW", 0.1), (0.09, 1, "HIGH", 4.3), (0.2, 3, "CRITICAL", 0.0),
        (-0.15, 0, "CRITICAL", 9.0), (-0.25, 0, "CRITICAL", 10.0), (-0.12, 0, "HIGH", 7.0),
        (-0.10, 0, "MEDIUM", 4.0), (-0.05, 0, "LOW", 0.5), (-0.001, 0, "LOW", 0.1),
    ],
)
def test_priority_and_cvss_on_band_limits(spark, score, hits, priority, cvss):
    df = spark.createDataFrame([(score, hits)], "anomaly_score double, priority_hits int")
    row = alerts.with_priority(df).first()
    assert (row["priority"], row["cvss_score"]) == (priority, cvss)


def test_signature_and_categories(spark):
    df = spark.createDataFrame([(2, 0, 1, 0.1049), (0, 0, 0, -0.2)], "dos_hits int, network_hits int, brute_force_hits int, s double")
    found = alerting.categories(["dos_hits", "network_hits", "brute_force_hits"])
    rows = df.select(found, alerting.signature(found, F.col("s"))).collect()
    assert rows[0][0] == ["dos", "brute_force"] and rows[0][1] == "brute_force+dos@0.1"
    assert rows[1][0] == [] and rows[1][1] == "unknown@-0.2"


def test_cve_lookup_order(spark):
    df = spark.createDataFrame(
        [(["odd", "network", "dos"], None), (["dos"], 4625), ([], 4624), (None, None)],
        "threat_categories array<string>, ev bigint",
    )
    names = [r["vulnerability_name"] for r in alerts.enrich(df, F.col("ev")).collect()]
    assert names == [
        D.CVE_BY_CATEGORY["network"]["name"], D.CVE_BY_EVENT[4625]["name"], D.CVE_GENERIC["name"], D.CVE_GENERIC["name"],
    ]


def test_enrich_keeps_stored_values(spark):
    df = spark.createDataFrame([(["dos"], "Own name", "CWE-1")], "threat_categories array<string>, vulnerability_name string, cwe string")
    row = alerts.enrich(df).first()
    assert (row["vulnerability_name"], row["cwe"], row["cve_ids"]) == ("Own name", "CWE-1", None)


def test_rules_fire_and_dedup(spark):
    lines = [("b", "h1", i, T0 + timedelta(seconds=i), "login failed sudo") for i in range(3)]
    lines += [("c", "h2", i, T0, "login failed") for i in range(2)]
    df = spark.createDataFrame(lines, "block_id string, source_machine string, line_id bigint, ts timestamp, raw string")
    fired = alerts.rule_alerts(df)
    got = {(r["block_id"], r["threat_categories"][0]): r for r in fired.collect()}
    assert set(got) == {("b", "brute_force"), ("b", "privilege_esc")}
    row = got["b", "brute_force"]
    assert row["cvss_score"] == 7.5 and row["num_events"] == 3 and row["rule_based"]
    assert row["description"] == f"HIGH — {D.CVE_BY_CATEGORY['brute_force']['name']} (3 indicator(s))"
    seen = spark.createDataFrame([("b", "brute_force")], "block_id string, category string")
    left = alerts.dedup_rules(fired.unionByName(fired), seen).collect()
    assert [r["threat_categories"] for r in left] == [["privilege_esc"]]


def brute_force(rows, wait, seed=None):
    """Sequential definition: keep when ``wait`` seconds passed since the last kept row."""
    last, kept = dict(seed or {}), []
    for key, at, tie in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key not in last or at - last[key] >= timedelta(seconds=wait):
            last[key] = at
            kept.append(tie)
    return sorted(kept)


def test_cooldown_known_case(spark):
    times = [0, 30, 61, 100, 121, 122, 200]
    rows = [("k", T0 + timedelta(seconds=t), t) for t in times]
    df = spark.createDataFrame(rows, "key string, ts timestamp, tie int")
    assert sorted(r["tie"] for r in cooldown(df, "key", "ts", 60, "tie").collect()) == [0, 61, 121, 200]


@pytest.mark.parametrize("chunk", [1, 2, 7, 64])
def test_cooldown_equals_sequential_fold(spark, chunk):
    """Hot key with long unbroken runs, ties, bursts and quiet spells."""
    rng = random.Random(chunk)
    rows, tie = [], 0
    for key, n, gap in [("hot", 1500, 4.0), ("steady", 300, 45.0), ("rare", 40, 900.0), ("burst", 200, 0.01)]:
        at = T0
        for _ in range(n):
            at += timedelta(microseconds=rng.choice([0, int(rng.expovariate(1 / gap) * 1e6), 60_000_000 if key == "steady" else 1]))
            rows.append((key, at, tie))
            tie += 1
    df = spark.createDataFrame(rows, "key string, ts timestamp, tie int").repartition(7)
    got = sorted(r["tie"] for r in cooldown(df, "key", "ts", 60, "tie", chunk_cooldowns=chunk).collect())
    assert got == brute_force(rows, 60)


def test_cooldown_seed(spark):
    rows = [("a", T0 + timedelta(seconds=s), s) for s in (-5, 10, 59, 60, 70)] + [("b", T0, 100)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, tie int")
    seed = spark.createDataFrame([("a", T0)], "key string, last_at timestamp")
    assert sorted(r["tie"] for r in cooldown(df, "key", "ts", 60, "tie", seed).collect()) == [60, 100]


def test_notifications_resume_from_the_log(spark):
    log = spark.createDataFrame([("a", T0), ("a", T0 + timedelta(seconds=30)), (None, T0)], "block_id string, sent_at timestamp")
    rows = [(i, T0 + timedelta(seconds=s), k, "m", "HIGH", ["dos"], 0.1, 8.0) for i, (s, k) in enumerate([(80, "a"), (90, "a"), (80, "b")])]
    df = spark.createDataFrame(rows, "seq int, alert_at timestamp, block_id string, source_machine string, priority string,"
                               " threat_categories array<string>, anomaly_score double, cvss_score double")
    out = alerts.dispatch_plan(df, "seq", seconds=60, seed=alerts.cooldown_seed(log)).collect()
    assert sorted((r["block_id"], r["sent_at"]) for r in out) == [("a", T0 + timedelta(seconds=90)), ("b", T0 + timedelta(seconds=80))]


def test_listing_limits_before_filtering(spark):
    rows = [(i, f"b{i}", "m", "HIGH" if i % 2 else "LOW", ["dos"]) for i in range(10)]
    df = spark.createDataFrame(rows, "seq int, block_id string, source_machine string, priority string, threat_categories array<string>")
    labels = spark.createDataFrame([("b9", "true_positive", "n")], "block_id string, label string, note string")
    out = alerts.alert_view(df, labels, "seq", limit=4, priority="HIGH").collect()
    assert [r["seq"] for r in out] == [9, 7] and out[0]["label"] == "true_positive" and out[1]["note"] == ""
    first = alerts.alert_view(df, labels, "seq", limit=4, filter_first=True, priority="HIGH").collect()
    assert [r["seq"] for r in first] == [9, 7, 5, 3]
    assert alerts.scope_by_machine(df, "user", None).count() == 0
    assert alerts.scope_by_machine(df, "user", "M").count() == 10


def test_feedback(spark):
    labels = spark.createDataFrame(
        [("a", "true_positive", "", T0, 1), ("a", "false_positive", "", T0 + timedelta(1), 2),
         ("b", "true_positive", "", T0, 3), ("c", "nonsense", "", T0, 4)],
        "block_id string, label string, note string, labelled_at timestamp, seq int",
    )
    assert feedback.rejected_labels(labels).count() == 1
    latest = feedback.latest_label(feedback.valid_labels(labels))
    m = feedback.feedback_metrics(latest).first()
    assert (m["total_labelled"], m["precision"], m["recall"], m["f1_score"]) == (2, 0.5, 1.0, 0.6667)
    empty = feedback.feedback_metrics(latest.limit(0)).first()
    assert empty["precision"] is None and empty["total_labelled"] == 0
    log = spark.createDataFrame([("model_retrained", T0, 0.2, 1), ("feedback_submitted", T0 + timedelta(9), None, 2)],
                                "event string, ts timestamp, contamination double, seq int")
    assert feedback.labels_since_retrain(latest, log).count() == 1
    assert feedback.labels_since_retrain(latest, log.limit(0)).count() == 2
    assert feedback.retrain_due(latest, log.limit(0), needed=2).first()["due"]
    joined = feedback.join_feedback(spark.createDataFrame([(c,) for c in "abxyz"], "block_id string"), latest)
    few = feedback.contamination_estimate(joined).first()
    assert few["n_labelled"] == 2 and few["contamination"] == 0.01


def test_dispatch(spark):
    rows = [(i, T0 + timedelta(seconds=10 * i), "b", "m", p, ["dos"], 0.1, c)
            for i, (p, c) in enumerate([("LOW", 1.0), ("HIGH", 1.0), ("CRITICAL", 9.9), ("MEDIUM", 5.5)])]
    df = spark.createDataFrame(rows, "seq int, alert_at timestamp, block_id string, source_machine string, priority string,"
                               " threat_categories array<string>, anomaly_score double, cvss_score double")
    out = alerts.dispatch_plan(df, "seq", min_priority="MEDIUM", seconds=15).collect()
    got = {r["priority"]: (r["cvss_score"], r["channels_used"]) for r in out}
    assert got == {"HIGH": (7.5, ["desktop", "sound", "email"]), "MEDIUM": (5.5, ["desktop", "sound"])}


def test_cooldown_keeps_null_keys_and_times(spark):
    rows = [(1, None, 0), (2, None, 10), (3, None, 100), (4, "k", None), (5, "k", None), (6, "k", 5), (7, "k", 6)]
    df = spark.createDataFrame(rows, "id int, k string, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    kept = {r["id"] for r in cooldown(df, "k", "ts", 60, "id").collect()}
    assert kept == {1, 3, 4, 5, 6}


def test_cooldown_takes_a_row_without_tie_value(spark):
    df = spark.createDataFrame([(None, "k"), (None, "k")], "id int, k string").withColumn("ts", F.timestamp_seconds(F.lit(5)))
    out = cooldown(df, "k", "ts", 60, "id").collect()
    assert [r["k"] for r in out] == ["k"]


def test_recipients_of_every_alert(spark):
    """Names are compared trimmed and lower-cased; without an address the fallback gets the alert."""
    alerts_ = spark.createDataFrame(
        [(1, " Web1"), (2, "web2"), (3, None), (4, "web1"), (4, "web1")], "alert_id int, source_machine string"
    )
    users = spark.createDataFrame(
        [("b@x", "WEB1 "), ("a@x", "web1"), ("a@x", "web1"), ("", "web2"), (None, "web2"), ("c@x", None)],
        "email string, source_machine string",
    )
    got = [(r["alert_id"], r["recipients"]) for r in alerts.with_recipients(alerts_, users, "f@x").orderBy("alert_id").collect()]
    assert got == [(1, ["a@x", "b@x"]), (2, ["f@x"]), (3, ["f@x"]), (4, ["a@x", "b@x"]), (4, ["a@x", "b@x"])]
    assert alerts.with_recipients(alerts_, users.limit(0), "f@x").count() == 5
    assert alerts.with_recipients(alerts_.limit(0), users, "f@x").count() == 0


def test_scope_of_an_unpaired_caller_is_empty(spark):
    rows = spark.createDataFrame([(1, "web1"), (2, None)], "alert_id int, source_machine string")
    assert alerts.scope_by_machine(rows, "user", None).count() == 0
    assert [r["alert_id"] for r in alerts.scope_by_machine(rows, "user", "WEB1").collect()] == [1]
    assert alerts.scope_by_machine(rows, "admin", None).count() == 2


def test_written_lists_of_recipients(spark, folder):
    """A file names a machine's list once, also one far over 1 MB, and its rows refer to it."""
    from emberwatch.plans.alerts_queries import alert_recipients

    spark.range(60_000).selectExpr(
        "id * 9 + 1 AS c_custkey", "concat('c', id) AS c_name", "1 AS c_nationkey", "1D AS c_acctbal", "'BUILDING' AS c_mktsegment"
    ).write.parquet(f"{folder}/customer.parquet")
    spark.sql("SELECT 1 AS n_nationkey, 'FRANCE' AS n_name, 0 AS n_regionkey").write.parquet(f"{folder}/nation.parquet")
    spark.range(200).selectExpr(
        "id AS event_id", "timestamp_seconds(id) AS ts", "1 + id % 2 AS user_id", "'view' AS event_type", "1D AS value", "'' AS props"
    ).write.parquet(f"{folder}/events.parquet")
    found = alert_recipients(spark, folder)
    assert found.columns == ["alert_id", "recipients"]
    found.write.parquet(f"{folder}/out")
    rows = spark.read.parquet(f"{folder}/out").groupBy(F.col("alert_id") % 2, F.md5("recipients")).count().collect()
    every = ",".join(sorted(f"u{i * 9 + 1}@france.example.com" for i in range(60_000)))
    digest = {hashlib.md5(t.encode()).hexdigest() for t in (every, "soc@example.com")}
    assert len(rows) == 2 and {r[1] for r in rows} == digest and {r[2] for r in rows} == {100}
    # 8 tasks may each write the list of 1.7 million letters once; in every row it would be 170 million
    assert sum(map(os.path.getsize, glob.glob(f"{folder}/out/*.parquet"))) < 9 * len(every)
    assert spark.conf.get("parquet.dictionary.page.size", None) is None

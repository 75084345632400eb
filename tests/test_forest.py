import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.dictionaries import MODEL_FEATURES
from emberwatch.operators import forest
from emberwatch.plans import jobs

NORMAL = {
    "num_events": 12.0, "unique_templates": 4.0, "avg_msg_len": 120.0, "std_msg_len": 15.0, "max_msg_len": 180.0,
    "min_msg_len": 80.0, "warn_count": 1.0, "info_count": 11.0, "warn_ratio": 0.083, "template_entropy": 1.5,
    "top_template_ratio": 0.6, "block_duration_sec": 2.0, "events_per_sec": 6.0,
}
ANOMALOUS = {
    "num_events": 500.0, "unique_templates": 50.0, "avg_msg_len": 50.0, "std_msg_len": 5.0, "max_msg_len": 60.0,
    "min_msg_len": 40.0, "error_count": 480.0, "warn_count": 10.0, "info_count": 10.0, "error_ratio": 0.96,
    "warn_ratio": 0.02, "template_entropy": 5.0, "top_template_ratio": 0.95, "block_duration_sec": 0.5,
    "events_per_sec": 1000.0, "gap_count": 50.0, "brute_force_hits": 200.0,
}


def table(spark, rows):
    return spark.createDataFrame(
        [(name, *[float(r.get(c, 0.0)) for c in MODEL_FEATURES]) for name, r in rows],
        "block_id string, " + ", ".join(f"{c} double" for c in MODEL_FEATURES),
    )


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        rows.append((f"b{i}", {k: v * (1 + 0.1 * rng.normal()) for k, v in NORMAL.items()}))
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def model(training):
    return forest.fit(training, MODEL_FEATURES, trees=40, contamination=0.05)


def test_anomalous_row_scores_lower(spark, model):
    rows = {r["block_id"]: r for r in forest.score(table(spark, [("n", NORMAL), ("a", ANOMALOUS)]), model).collect()}
    assert rows["a"]["anomaly_score"] < rows["n"]["anomaly_score"]
    assert rows["a"]["prediction"] == -1 and rows["n"]["prediction"] == 1


def test_contamination_sets_the_flagged_share(training, model):
    flagged = forest.score(training, model).filter("prediction = -1").count()
    assert abs(flagged - 0.05 * 400) <= 2


def test_edge_rows(spark, model):
    rows = [("five", {c: 5.0 for c in MODEL_FEATURES}), ("zero", {}), ("nan", {c: float("nan") for c in MODEL_FEATURES}),
            ("inf", {c: float("inf") for c in MODEL_FEATURES})]
    rows += [(f"r{i}", {c: float(i % 100) for c in MODEL_FEATURES}) for i in range(1000)]
    got = {r["block_id"]: r["anomaly_score"] for r in forest.score(table(spark, rows), model).collect()}
    assert len(got) == 1004 and all(np.isfinite(v) for v in got.values())
    assert got["zero"] == got["nan"] == got["inf"]


def test_same_model_under_repartitioning(training, model):
    again = forest.fit(training.repartition(5, "num_events"), MODEL_FEATURES, trees=40, contamination=0.05)
    assert [n[:3] for n in again.nodes] == [n[:3] for n in model.nodes]
    assert np.allclose([n[3] for n in again.nodes], [n[3] for n in model.nodes])
    assert np.isclose(again.offset, model.offset)


def test_known_path_lengths(spark):
    """Two points, one feature: each tree splits once, so every path has length one."""
    df = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "block_id string, x double")
    two = forest.fit(df, ["x"], trees=10, contamination=0.5)
    scores = [r["_raw"] for r in forest.score_samples(df, two).collect()]
    assert np.allclose(scores, -0.5)  # 2 ** -(1 / c(2)) with c(2) = 1
    assert forest.expected_path(1) == 0.0 and forest.expected_path(2) == 1.0
    assert np.isclose(forest.expected_path(256), 10.2447, atol=1e-3)


def test_sample_from_large_table(spark):
    """Above the pool size every tree still gets its full sample, all of it distinct."""
    df = spark.range(20_000).select(F.col("id").cast("string").alias("block_id"), F.rand(1).alias("x"))
    got = forest.tree_samples(df, "block_id", ["x"], trees=5, size=64, seed=1, rows=20_000)
    per_tree = got.groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("_id").alias("d")).collect()
    assert [(r["n"], r["d"]) for r in per_tree] == [(64, 64)] * 5


def test_bound_on_model_size(training):
    with pytest.raises(ValueError):
        forest.fit(training, MODEL_FEATURES, trees=1_000_000)


def test_save_and_load(spark, model, training, folder):
    model.save(spark, folder)
    loaded = forest.IsolationForest.load(spark, folder)
    assert loaded.offset == model.offset and loaded.columns == model.columns
    a = forest.score(training, model).agg(F.sum("anomaly_score")).first()[0]
    b = forest.score(training, loaded).agg(F.sum("anomaly_score")).first()[0]
    assert np.isclose(a, b)


def test_train_and_evaluate(spark, training, folder):
    bad = table(spark, [(f"x{i}", {**ANOMALOUS, "num_events": 500.0 + i}) for i in range(20)])
    blocks = training.unionByName(bad)
    result = jobs.train(blocks, contamination=0.05, trees=30, path=folder)
    report = result.report.first()
    assert report["n_features"] == 22 and 0 < report["test_blocks"] < 420
    truth = blocks.select(F.col("block_id").alias(" BlockId "), F.when(F.col("block_id").startswith("x"), "Anomaly").otherwise("Normal").alias("Label"))
    got = {(r["section"], r["metric"]): r["value"] for r in jobs.evaluate(blocks, truth, result.model).collect()}
    assert got["overall", "roc_auc"] > 0.95 and got["overall", "accuracy"] > 0.9
    assert got["Anomaly", "support"] == 20 and got["brute_force", "true_anomaly_hits"] == 20
    with pytest.raises(ValueError):
        jobs.evaluate(blocks, truth.withColumn(" BlockId ", F.lit("none")), result.model)


def test_samples_are_the_smallest_hashes_found_without_a_lambda(spark, capsys):
    """Every tree's rows by their hashes over all rows; the hashes run in compiled code."""
    rows = spark.range(3000).selectExpr("concat('b', id) as block_id", "double(id % 7) as a")
    drawn = forest.tree_samples(rows, "block_id", ["a"], 4, 50, 42, 3000)
    drawn.explain()
    assert "lambdafunction" not in capsys.readouterr().out
    every = rows.crossJoin(spark.range(4).selectExpr("int(id) as tree"))
    every = every.selectExpr("tree", "pmod(xxhash64(block_id, tree, 42), 2147483648) as _order", "block_id as _id").collect()
    want = [r for t in range(4) for r in sorted(tuple(r) for r in every if r["tree"] == t)[:50]]
    assert sorted(tuple(r) for r in drawn.select("tree", "_order", "_id").collect()) == want

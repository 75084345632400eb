import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.operators import evaluation, ordering
from emberwatch.operators import preparation as prep


@pytest.mark.parametrize("n", [1, 2, 3, 30, 5000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 2)
    df = spark.createDataFrame([(float(v), float(-v * 3)) for v in values], "a double, b double")
    probabilities = [0.0, 0.01, 0.05, 0.5, 0.95, 1.0]
    got = {(r["feature"], r["probability"]): r["quantile"] for r in ordering.exact_quantiles(df, ["a", "b"], probabilities).collect()}
    for p in probabilities:
        assert np.isclose(got["a", p], np.percentile(values, 100 * p))
        assert np.isclose(got["b", p], np.percentile(-values * 3, 100 * p))


def test_exact_quantiles_through_sketch(spark):
    """With a coarse sketch the bracket is narrow and the answer still exact."""
    df = spark.range(40_000).select((F.pmod(F.xxhash64("id"), F.lit(10_007)) / 7.0).alias("a"))
    values = np.array([r[0] for r in df.collect()])
    got = ordering.exact_quantiles(df, ["a"], [0.01, 0.5, 0.9], accuracy=400).collect()
    assert len(got) == 3
    for r in got:
        assert np.isclose(r["quantile"], np.percentile(values, 100 * r["probability"]))


def test_exact_quantiles_of_unlike_tasks(spark):
    """Values in order over more tasks than groups of sketches; no task merges the sketches of all tasks."""
    df = spark.range(0, 60_000, 1, 200).select(
        F.when(F.col("id") % 10 > 0, F.pow(F.col("id") - 30_000.0, 3)).alias("a"), F.floor(F.col("id") / 9_000).cast("double").alias("b")
    )
    ids = np.arange(60_000.0)
    values = {"a": (ids[ids % 10 > 0] - 30_000) ** 3, "b": ids // 9_000}
    probabilities = [0.0, 0.003, 0.5, 0.97, 1.0]
    found = ordering.exact_quantiles(df, ["a", "b"], probabilities, accuracy=2000)
    got = {(r["feature"], r["probability"]): r["quantile"] for r in found.collect()}
    for c in "ab":
        for p in probabilities:
            assert np.isclose(got[c, p], np.percentile(values[c], 100 * p))
    edges = ordering.quantile_brackets(df, ["a"], [0.5], 2000).first()["edges"]
    inside = (values["a"] >= edges["a_lo0"]) & (values["a"] <= edges["a_hi0"])
    assert 0 < inside.sum() < 18 / 2000 * inside.size + 6 * ordering.SKETCHES
    assert "_group" in next(x for x in found._jdf.queryExecution().toString().splitlines() if "ObjectHashAggregate" in x and "percentile_approx" in x)


def test_median_query_deals_no_rows_out(spark, sf_dir):
    from emberwatch.plans.models_queries import dirty

    assert "Exchange" not in dirty(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_auc_and_average_precision(spark):
    rng = np.random.default_rng(3)
    n = 900
    y = np.where(rng.random(n) < 0.2, -1, 1)
    score = np.round(rng.normal(size=n) + (y == 1), 1)
    df = spark.createDataFrame([(float(s), int(v)) for s, v in zip(score, y)], "score double, y_true int")
    anomalous = -score
    pos, neg = anomalous[y == -1], anomalous[y == 1]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for cut in sorted(set(anomalous), reverse=True):
        chosen = anomalous >= cut
        recall = (chosen & (y == -1)).sum() / len(pos)
        ap += (recall - last) * (chosen & (y == -1)).sum() / chosen.sum()
        last = recall
    for buckets in (4, 1024):
        assert np.isclose(evaluation.roc_auc(df, "score", buckets=buckets).first()[0], want)
        assert np.isclose(evaluation.average_precision(df, "score", buckets=buckets).first()[0], ap)
    assert evaluation.roc_auc(df.filter("y_true = 1"), "score").first()[0] is None
    assert evaluation.average_precision(df.limit(0), "score").first()[0] is None


def test_median_imputation_and_scaling(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 5.0), ("b", float("nan"), 5.0), ("c", float("inf"), 5.0), ("d", 4.0, 5.0), ("e", None, 5.0)],
        "block_id string, x double, flat double",
    )
    got = {r["block_id"]: r["x"] for r in prep.impute_median(df, ["x", "flat"]).collect()}
    assert got == {"a": 1.0, "b": 2.5, "c": 2.5, "d": 4.0, "e": 2.5}
    scaled = prep.standard_scale(df.filter("block_id in ('a', 'd')"), ["x", "flat"]).orderBy("block_id").collect()
    assert [r["x"] for r in scaled] == [-1.0, 1.0] and [r["flat"] for r in scaled] == [0.0, 0.0]
    zero = prep.zero_fill(df, ["x", "other"]).collect()
    assert [r["x"] for r in zero] == [1.0, 0.0, 0.0, 4.0, 0.0] and zero[0]["other"] == 0.0


def test_columns(spark):
    df = spark.createDataFrame([("a", 1, 2.0, "s")], "block_id string, n int, block_duration double, note string")
    assert prep.feature_columns(df) == ["n", "block_duration"]
    out = prep.reconcile_columns(df, ["block_duration_sec", "n"])
    assert out.columns == ["block_id", "note", "block_duration_sec", "n"]
    fallback = prep.reconcile_columns(df, ["gone", "n"])
    assert fallback.columns == ["block_id", "note", "n", "block_duration"]
    with pytest.raises(ValueError):
        prep.reconcile_columns(df, ["a", "b", "c"])
    with pytest.raises(ValueError):
        prep.select_features(df.drop("block_id"))

"""Queries on model input, the isolation forest and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.operators import evaluation, features, feedback, forest
from emberwatch.operators import preparation as prep
from emberwatch.plans import features_queries as FQ
from emberwatch.plans import jobs
from emberwatch.plans import sqltext as S
from emberwatch.plans.alerts_queries import LATEST_LABELS as LATEST
from emberwatch.plans.registry import query, rounded
from emberwatch.plans.views import cte, spread, table, view
from emberwatch.session import fresh_dir, written

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark, sf_dir, dealt=True):
    rows = table(spark, sf_dir, "lineitem")
    return (spread(rows) if dealt else rows).withColumn(
        "block_id", F.concat_ws("_", "l_orderkey", "l_linenumber")
    )


ROW_ID = "concat(l_orderkey, '_', l_linenumber) AS block_id"


@query(
    "select_features",
    oracle=f"SELECT {ROW_ID}, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,"
    " l_extendedprice, l_discount, l_tax FROM lineitem",
)
def select_features(spark, sf_dir):
    return prep.select_features(lines(spark, sf_dir))


@query(
    "reconcile_columns",
    oracle=cte("scored_blocks")
    + " SELECT block_id, num_events, anomaly_score AS block_duration_sec, dos_hits FROM scored_blocks",
)
def reconcile_columns(spark, sf_dir):
    blocks = view(spark, sf_dir, "scored_blocks").select(
        "block_id", "num_events", F.col("anomaly_score").alias("block_duration"), "dos_hits", "startup_hits"
    )
    return prep.reconcile_columns(blocks, ["num_events", "block_duration_sec", "dos_hits"])


# gaps: every seventh price infinite, every fifth tax not a number, every third quantity null
DIRTY = {
    "l_extendedprice": ("l_orderkey % 7 = 0", "CAST('Infinity' AS DOUBLE)"),
    "l_tax": ("l_orderkey % 5 = 0", "CAST('NaN' AS DOUBLE)"),
    "l_quantity": ("l_orderkey % 3 = 0", "CAST(NULL AS DOUBLE)"),
}


def dirty(spark, sf_dir):
    cells = [F.expr(f"CASE WHEN {w} THEN {v} ELSE {c} END").alias(c) for c, (w, v) in DIRTY.items()]
    # only numbers are read off these rows, in several passes: dealing them out takes longer than every pass
    return lines(spark, sf_dir, dealt=False).select("block_id", "l_discount", *cells)


DIRTY_SQL = (
    f"WITH dirty AS (SELECT {ROW_ID}, l_discount, "
    + ", ".join(f"CASE WHEN {w} THEN NULL ELSE {c} END AS {c}" for c, (w, _) in DIRTY.items())
    + " FROM lineitem)"
)


@query(
    "impute_median",
    oracle=DIRTY_SQL
    + " SELECT block_id, "
    + ", ".join(
        f"round(coalesce({c}, (SELECT median({c}) FROM dirty)), 6) AS {c}" for c in ["l_discount", *DIRTY]
    )
    + " FROM dirty",
)
def impute_median(spark, sf_dir):
    return rounded(prep.impute_median(dirty(spark, sf_dir), ["l_discount", *DIRTY]))


@query(
    "score_input_clean",
    oracle=DIRTY_SQL
    + " SELECT block_id, l_discount, 0.0::DOUBLE AS absent_column, "
    + ", ".join(f"coalesce({c}, 0.0)::DOUBLE AS {c}" for c in DIRTY)
    + " FROM dirty",
)
def score_input_clean(spark, sf_dir):
    return prep.zero_fill(dirty(spark, sf_dir), ["l_discount", "absent_column", *DIRTY])


@query(
    "train_test_split",
    oracle="SELECT block_id, CASE WHEN ('0x' || substr(md5(concat(block_id, ':42')), 1, 8))::BIGINT % 10000"
    f" < 8000 THEN 'train' ELSE 'test' END AS split FROM (SELECT {ROW_ID} FROM lineitem)",
)
def train_test_split(spark, sf_dir):
    return prep.train_test_split(lines(spark, sf_dir).select("block_id"))


@query(
    "standard_scale",
    oracle=f"WITH z AS (SELECT {ROW_ID}, {', '.join(NUMBERS)}, 1.0::DOUBLE AS flat FROM lineitem),"
    " s AS (SELECT "
    + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in NUMBERS)
    + " FROM z) SELECT block_id, 0.0::DOUBLE AS flat, "
    + ", ".join(f"round(({c} - {c}_m) / {c}_s, 4) + 0.0 AS {c}" for c in NUMBERS)
    + " FROM z, s",
)
def standard_scale(spark, sf_dir):
    rows = lines(spark, sf_dir).select("block_id", *NUMBERS, F.lit(1.0).alias("flat"))
    return rounded(prep.standard_scale(rows, [*NUMBERS, "flat"]), 4)


@query(
    "threshold_anomaly",
    oracle="SELECT event_id, value, (value < 10.0)::INTEGER AS is_anomaly FROM events",
)
def threshold_anomaly(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return prep.threshold_anomaly(events, "value", 10.0).withColumn(
        "is_anomaly", F.col("is_anomaly").cast("int")
    )


@query(
    "score_distribution",
    oracle="SELECT count(*) AS test_blocks, count(*) FILTER (l_extendedprice < 2000) AS flagged_anomalies,"
    " round(100.0::DOUBLE * count(*) FILTER (l_extendedprice < 2000) / count(*), 2) AS anomaly_rate_pct,"
    " round(avg(l_extendedprice), 4) AS score_mean, round(stddev_pop(l_extendedprice), 4) AS score_std,"
    " round(min(l_extendedprice), 4) AS score_min, round(max(l_extendedprice), 4) AS score_max,"
    " round(quantile_cont(l_extendedprice, 0.05), 4) AS score_p5,"
    " round(quantile_cont(l_extendedprice, 0.95), 4) AS score_p95 FROM lineitem",
)
def score_distribution(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return rounded(prep.score_distribution(rows, "l_extendedprice", F.col("l_extendedprice") < 2000), 4)


# --- isolation forest -----------------------------------------------------------------


@query("iforest_fit")
def iforest_fit(spark, sf_dir):
    """Node table of a forest over all line items."""
    rows = lines(spark, sf_dir).select("block_id", *NUMBERS)
    return forest.fit(rows, NUMBERS, trees=100, contamination=0.01).node_table(spark)


@query("iforest_score")
def iforest_score(spark, sf_dir):
    """Scores of every line item with the flag of the contamination quantile."""
    rows = lines(spark, sf_dir).select("block_id", *NUMBERS)
    model = forest.fit(rows, NUMBERS, trees=100, contamination=0.01)
    return forest.score(rows, model).select("block_id", "anomaly_score", "prediction", "is_anomaly")


def block_table(spark, sf_dir):
    """Feature rows per user and day, so that there are enough blocks to learn from."""
    events = FQ.parsed(spark, sf_dir)
    daily = F.concat_ws("|", "block_id", F.date_format("ts", "yyyyMMdd"))
    return features.block_features(events.withColumn("block_id", daily))


@query("retrain_job")
def retrain_job(spark, sf_dir):
    """Retraining from Windows blocks and feedback: the report next to the audit row."""
    windows = FQ.parsed_windows(spark, sf_dir).withColumn(
        "block_id", F.concat_ws("_", F.lit("app"), F.substring_index("block_id", "_", -1))
    )
    labels = view(spark, sf_dir, "label_log")
    training, audit = jobs.retrain(
        windows, block_table(spark, sf_dir), labels, "2024-02-01 00:00:00", trees=50
    )
    return audit.select("event", "n_labels_used").join(
        training.report.withColumn("event", F.lit("model_retrained")), "event"
    )


@query("end_to_end_run")
def end_to_end_run(spark, sf_dir):
    """Log files on disk → parsed events → block features → trained forest → report."""
    folder = fresh_dir(spark, "rawlogs")
    view(spark, sf_dir, "log_events").select("raw", "source").write.partitionBy("source").text(folder)
    return jobs.end_to_end(spark, folder, recursive=True, trees=50).report


@query("evaluate_report")
def evaluate_report(spark, sf_dir):
    """Forest over daily blocks judged against blocks holding an error burst."""
    blocks = written(block_table(spark, sf_dir), "daily-blocks")
    truth = blocks.select(
        F.col("block_id").alias("BlockId"),
        F.when(F.col("error_ratio") >= 0.5, "Anomaly").otherwise("Normal").alias("Label"),
    )
    training = jobs.train(blocks, contamination=0.05, trees=50)
    return jobs.evaluate(blocks, truth, training.model)


# --- what must hold of models and jobs, whatever the random draws ----------------------


@query(
    "iforest_trees",
    oracle="SELECT range::INTEGER AS tree, 1::BIGINT AS leaves_over_splits, 1.0::DOUBLE AS leaf_share, true AS splits_in_range,"
    " true AS depth_bounded, (SELECT least(256, count(*)) FROM lineitem)::BIGINT AS sample_size FROM range(100)",
)
def iforest_trees(spark, sf_dir):
    """The shape of every tree: a full binary tree whose splits lie inside the scaled data.

    ``leaf_share`` adds 2 to the power of minus its level over all leaves, which is 1 for a tree in which
    every split has two children and every child one parent.
    """
    rows = lines(spark, sf_dir).select("block_id", *NUMBERS)
    model = forest.fit(rows, NUMBERS, trees=100, contamination=0.01)
    scaled = prep.standard_scale(rows, NUMBERS)
    ends = scaled.agg(
        F.array(*[F.min(c) for c in NUMBERS]).alias("low"), F.array(*[F.max(c) for c in NUMBERS]).alias("high")
    )
    nodes = model.node_table(spark)
    leaf = F.col("feature") < 0
    # levels from the root down: a tree is no deeper than the logarithm of its sample
    level = nodes.filter(F.col("node") == 0).select("tree", "node", F.lit(0).alias("level"))
    placed, depth = level, max(1, (model.sample_size - 1).bit_length())
    for step in range(depth):
        inner = level.join(nodes.filter(~leaf), ["tree", "node"])
        level = inner.select("tree", F.explode(F.array("left", F.col("left") + 1)).alias("node"), F.lit(step + 1).alias("level"))
        placed = placed.unionByName(level)
    whole = nodes.join(placed, ["tree", "node"], "left").crossJoin(F.broadcast(ends))
    at = F.col("feature") + 1
    inside = F.col("threshold").between(F.element_at("low", F.greatest(at, F.lit(1))), F.element_at("high", F.greatest(at, F.lit(1))))
    return whole.groupBy("tree").agg(
        (F.count_if(leaf) - F.count_if(~leaf)).alias("leaves_over_splits"),
        F.round(F.sum(F.when(leaf, F.pow(F.lit(2.0), -F.col("level")))), 6).alias("leaf_share"),
        F.bool_and(leaf | inside).alias("splits_in_range"),
        F.bool_and(F.coalesce(F.col("level") <= depth, F.lit(False))).alias("depth_bounded"),
        F.lit(model.sample_size).cast("bigint").alias("sample_size"),
    )


@query(
    "iforest_flagged",
    oracle="SELECT count(*) AS rows_scored, count(DISTINCT concat(l_orderkey, '_', l_linenumber)) AS blocks_scored,"
    " floor(0.01::DOUBLE * (count(*) - 1))::BIGINT + 1 AS flagged, 0::BIGINT AS out_of_range, 0::BIGINT AS disagreeing FROM lineitem",
)
def iforest_flagged(spark, sf_dir):
    """Scores against the contamination quantile: every row scored once, the lowest hundredth flagged."""
    rows = lines(spark, sf_dir).select("block_id", *NUMBERS)
    model = forest.fit(rows, NUMBERS, trees=100, contamination=0.01)
    value = F.col("anomaly_score")
    return forest.score(rows, model).agg(
        F.count(value).alias("rows_scored"),
        F.count_distinct("block_id").alias("blocks_scored"),
        F.count_if("is_anomaly").alias("flagged"),
        F.count_if(~value.between(-1.0, 1.0)).alias("out_of_range"),
        F.count_if(F.col("is_anomaly") != (F.col("prediction") == -1)).alias("disagreeing"),
    )


def split_sql(blocks: str) -> str:
    """Sizes of the two parts of a table of block ids."""
    place = "('0x' || substr(md5(concat(block_id, ':42')), 1, 8))::BIGINT % 10000"
    return (
        f"(SELECT count(*) FILTER ({place} < 8000) FROM {blocks}) AS train_blocks,"
        f" (SELECT count(*) FILTER ({place} >= 8000) FROM {blocks}) AS test_blocks"
    )


REPORTED = ["contamination", "n_estimators", "n_features", "train_blocks", "test_blocks"]


def consistent(report):
    """The score statistics of a training report in their only possible order."""
    order = ["score_min", "score_p5", "score_p95", "score_max"]
    rising = F.lit(True)
    for low, high in zip(order, order[1:]):
        rising = rising & (F.col(low) <= F.col(high))
    rate = F.round(100 * F.col("flagged_anomalies") / F.col("test_blocks"), 2)
    mean = F.col("score_mean").between(F.col("score_min"), F.col("score_max"))
    return (rising & mean & (F.col("anomaly_rate_pct") == rate)).alias("consistent")


@query(
    "retrain_audit",
    oracle=cte("windows_events", "label_log")
    + ", blocks AS (SELECT concat('app_', user_id) AS block_id FROM windows_events WHERE os = 'windows' OR format = 'winlog'"
    " GROUP BY user_id HAVING count(*) >= 3)"
    + LATEST
    + f", signed AS (SELECT b.block_id, {S.case_of('l.label', D.FEEDBACK_SIGN)} AS sign FROM blocks b LEFT JOIN latest l USING (block_id))"
    " SELECT 'model_retrained' AS event, '2024-02-01 00:00:00' AS retrained_at, (SELECT count(*) FROM latest) AS n_labels_used,"
    " (SELECT round(CASE WHEN count(sign) >= 5 THEN least(0.5::DOUBLE, greatest(0.01::DOUBLE, count(*) FILTER (sign = -1)"
    " / count(sign)::DOUBLE)) ELSE 0.01 END, 6) FROM signed) AS contamination, 50::INTEGER AS n_estimators,"
    # live blocks count one category more than the batch features do
    f" {len(D.MODEL_FEATURES) + len(set(D.REALTIME_KEYWORDS) - set(D.BATCH_KEYWORDS))}::INTEGER AS n_features, "
    + split_sql("blocks")
    + ", true AS consistent",
)
def retrain_audit(spark, sf_dir):
    """A retraining's audit row, read back from its sink, next to what its report must say."""
    path = fresh_dir(spark, "retrained")
    windows = FQ.parsed_windows(spark, sf_dir).withColumn(
        "block_id", F.concat_ws("_", F.lit("app"), F.substring_index("block_id", "_", -1))
    )
    jobs.retrain(
        windows, block_table(spark, sf_dir), view(spark, sf_dir, "label_log"), "2024-02-01 00:00:00", path=path, trees=50
    )
    audit = spark.read.schema("event string, timestamp timestamp, contamination double, n_labels_used bigint").json(f"{path}/audit")
    report = spark.read.json(f"{path}/report").withColumn("event", F.lit("model_retrained"))
    joined = audit.drop("contamination").join(report, "event")
    return rounded(
        joined.select(
            "event",
            F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("retrained_at"),
            "n_labels_used",
            *[F.col(c).cast("int").alias(c) if c.startswith("n_") else c for c in REPORTED],
            consistent(report),
        )
    )


@query(
    "end_to_end_report",
    oracle=cte("log_events")
    # lines that open with an ISO time are of no known log format, so their minute names the block
    + f", blocks AS (SELECT DISTINCT concat('generic_', {S.MINUTE}) AS block_id FROM log_events) SELECT 0.01::DOUBLE AS contamination, 50::INTEGER AS n_estimators,"
    " 22::INTEGER AS n_features, "
    + split_sql("blocks")
    + ", true AS consistent",
)
def end_to_end_report(spark, sf_dir):
    """Log files to a saved model; the report is read back from its sink."""
    folder, path = fresh_dir(spark, "rawlogs"), fresh_dir(spark, "trained")
    view(spark, sf_dir, "log_events").select("raw", "source").write.partitionBy("source").text(folder)
    jobs.end_to_end(spark, folder, recursive=True, model_path=path, trees=50)
    report = spark.read.json(f"{path}/report")
    return rounded(
        report.select(*[F.col(c).cast("int").alias(c) if c.startswith("n_") else c for c in REPORTED], consistent(report))
    )

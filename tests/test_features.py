import hashlib
import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.operators import features, ordering
from emberwatch.plans import views

EVENTS = [
    ("b1", 1, 1, "2024-01-01 00:00:00 ERROR login failed"),
    ("b1", 2, 4, "2024-01-01 00:00:10 warn disk"),
    ("b1", 1, 4, "2024-01-01 00:00:20 info ok"),
    ("b2", 9, None, "sudo root"),
    ("b3", 5, 10, "2024-01-01 00:00:00 x"),
    ("b3", 5, 12, "2024-01-01 00:00:00 y"),
]


def rows(df, key="block_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_block_features_by_hand(spark):
    df = spark.createDataFrame(EVENTS, "block_id string, template_id bigint, line_id bigint, raw string")
    got = rows(features.block_features(df))
    b1 = got["b1"]
    lengths = [len(e[3]) for e in EVENTS[:3]]
    assert b1["num_events"] == 3 and b1["unique_templates"] == 2
    assert math.isclose(b1["avg_msg_len"], np.mean(lengths)) and math.isclose(b1["std_msg_len"], np.std(lengths))
    assert (b1["error_count"], b1["warn_count"], b1["info_count"]) == (1, 1, 1)
    assert math.isclose(b1["template_entropy"], -(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3)))
    assert math.isclose(b1["top_template_ratio"], 2 / 3)
    assert b1["block_duration_sec"] == 20.0 and math.isclose(b1["events_per_sec"], 3 / 20)
    assert b1["gap_count"] == 2  # 2 and 3 are missing, 4 is there twice
    assert b1["brute_force_hits"] == 1
    b2 = got["b2"]
    assert b2["gap_count"] == 0 and b2["events_per_sec"] == 0.0 and b2["privilege_esc_hits"] == 1
    assert got["b3"]["events_per_sec"] == -1.0 and got["b3"]["gap_count"] == 1


def test_invariants(spark, sf_dir):
    from emberwatch.plans.features_queries import parsed

    out = features.block_features(parsed(spark, sf_dir))
    bad = out.filter(
        "num_events <= 0 OR error_ratio NOT BETWEEN 0 AND 1 OR template_entropy < 0 OR gap_count < 0"
        " OR brute_force_hits > num_events OR top_template_ratio NOT BETWEEN 0 AND 1"
        " OR error_count + warn_count + info_count <> num_events"
    )
    assert bad.count() == 0
    flags = features.event_features(parsed(spark, sf_dir))
    assert flags.filter("is_error + is_warn + is_info <> 1 OR brute_force_flag NOT IN (0, 1)").count() == 0


def skewed(spark, n=6000):
    """One key with a third of all rows, repeated and missing ids."""
    ids = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("block_id"),
        (F.pmod(F.xxhash64("id"), F.lit(500_000)) - 1000).alias("line_id"),
        F.md5(F.col("id").cast("string")).alias("raw"),
    )
    return ids.unionByName(ids.limit(50))


def test_event_index_on_hot_key(spark):
    df = skewed(spark).cache()
    got = ordering.sliced_position(df, "block_id", "line_id", ["raw"], "at", bits=12).collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r["block_id"], []).append((r["at"], r["line_id"], r["raw"]))
    assert sum(map(len, by_key.values())) == df.count()
    for items in by_key.values():
        items.sort()
        assert [i[0] for i in items] == list(range(len(items)))
        assert [i[1:] for i in items] == sorted(i[1:] for i in items)


def test_event_features_without_line_ids(spark):
    """Rows lacking a line id still get dense positions, ahead of the numbered ones."""
    df = spark.range(300).select(
        F.lit("hot").alias("block_id"),
        F.lit(1).alias("template_id"),
        F.when(F.col("id") < 20, F.col("id")).alias("line_id"),
        F.concat(F.lit("line "), F.col("id")).alias("raw"),
    )
    got = features.event_features(df).select("event_index", "msg_len").collect()
    assert sorted(r["event_index"] for r in got) == list(range(300))
    by_index = {r["event_index"]: r["msg_len"] for r in got}
    assert [by_index[280 + i] for i in range(20)] == [len(f"line {i}") for i in range(20)]


def test_gaps_on_hot_key(spark):
    df = skewed(spark).cache()
    ids = {}
    for r in df.collect():
        ids.setdefault(r["block_id"], set()).add(r["line_id"])
    want_count = {k: max(v) - min(v) + 1 - len(v) for k, v in ids.items()}
    counts = {r[0]: r[1] for r in features.sequence_gaps(df).collect()}
    assert counts == want_count
    covered = Counter()
    for r in ordering.sliced_gaps(df, "block_id", "line_id", bits=12).collect():
        assert r["first_missing"] <= r["last_missing"]
        span = range(r["first_missing"], r["last_missing"] + 1)
        assert span[0] - 1 in ids[r["block_id"]] and span[-1] + 1 in ids[r["block_id"]]
        covered[r["block_id"]] += len(span)
    assert dict(covered) == {k: v for k, v in want_count.items() if v}


def test_realtime_blocks(spark):
    data = [
        ("a", "t1", 2, "m2", "remote ssh", "network"),
        ("a", "t1", 1, "", "iex hidden", None),
        ("a", "t2", 3, "m3", "admin only", ""),
        ("b", "t1", 1, "m1", "x", None),
    ]
    df = spark.createDataFrame(
        data, "block_id string, template_id string, line_id bigint, source_machine string, raw string, priority_threat string"
    )
    got = rows(features.realtime_block_features(df, min_events=3, fallback_machine="node"))
    assert list(got) == ["a"]
    a = got["a"]
    assert a["source_machine"] == "node" and a["priority_hits"] == 1
    assert a["suspicious_process_hits"] == 1 and a["privilege_esc_hits"] == 0
    assert a["block_duration_sec"] == 0.0 and a["gap_count"] == 0
    wide = features.realtime_block_features(df, min_events=1)
    assert set(f"{c}_hits" for c in D.REALTIME_KEYWORDS) <= set(wide.columns)


def _plain_positions(rows):
    """Line id, then time, then hash; without a line id first, without both before them."""
    def place(r):
        line, at, raw = r
        digest = hashlib.md5(raw.encode()).hexdigest()
        return (line is not None, line or 0, at is not None and line is None, at if line is None and at else datetime.min, digest)

    return [(r, i) for i, r in enumerate(sorted(rows, key=place))]


@pytest.mark.parametrize("crowd", [8, 1 << 20])
def test_positions_in_crowded_slices(spark, monkeypatch, crowd):
    """Ids restart in every file and many events have none; the cuts change nothing."""
    draw = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=f), f"file {f} line {i}") for f in range(20) for i in range(30)]
    rows += [(None, start + timedelta(microseconds=draw.randrange(10**9)), f"tail {i}") for i in range(400)]
    rows += [(None, start - timedelta(days=40000), "before the epoch"), *[(None, None, f"timeless {i}") for i in range(50)]]
    draw.shuffle(rows)
    df = spark.createDataFrame([("b", *r) for r in rows] + [(None, 1, start, "x"), (None, 0, start, "y")], "block_id string, line_id long, ts timestamp, raw string")
    real = ordering.sliced_position
    monkeypatch.setattr(features, "sliced_position", lambda *a, **k: real(*a, crowd=crowd, **k))
    got = {(r["block_id"], r["line_id"], r["raw"]): r["event_index"] for r in features.event_index(df).collect()}
    assert got == {**{("b", r[0], r[2]): i for r, i in _plain_positions(rows)}, (None, 0, "y"): 0, (None, 1, "x"): 1}


def test_crowded_slices_are_cut(spark):
    """One block over many files whose ids are 0 to 99: no group of rows is larger than an id's share."""
    df = spark.range(200_000).select(
        F.lit("b").alias("block_id"), (F.col("id") % 100).alias("line_id"), F.md5(F.col("id").cast("string")).alias("tie")
    )
    start = F.conv(F.substring("tie", 1, 3), 16, 10).cast("bigint")
    out = ordering.sliced_position(df, "block_id", "line_id", ["tie"], "at", finer=(F.col("line_id"), start), crowd=1000)
    facts = out.agg(F.count("at"), F.count_distinct("at"), F.min("at"), F.max("at")).first()
    assert tuple(facts) == (200_000, 200_000, 0, 199_999)
    assert out.filter(F.floor(F.col("at") / 2000) != F.col("line_id")).isEmpty()
    cells = df.groupBy("line_id", start).count().agg(F.max("count")).first()[0]
    assert cells < 20


def test_tailed_events_stand_in_order_of_time(spark):
    """Tailed events stand in the order of their times."""
    start = datetime(2024, 1, 1)
    rows = [("b", i, None, start + timedelta(seconds=i % 7), f"line {i} {'x' * i}") for i in range(50)]
    df = spark.createDataFrame(rows, "block_id string, template_id long, line_id long, collected_at timestamp, raw string")
    got = [r["template_id"] % 7 for r in features.event_features(df).orderBy("event_index").collect()]
    assert got == sorted(got) and len(got) == 50


def test_rows_are_dealt_out_whatever_the_splits(spark, tmp_path):
    """One row group comes with one of a file's splits, however many these are; no task may get it whole."""
    spark.range(300_000).select((F.col("id") * 7919 % 1_000_003).alias("id")).coalesce(1).write.parquet(str(tmp_path / "t"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        df = spark.read.parquet(str(tmp_path / "t"))
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [r["n"] for r in views.spread(df).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sum(sizes) == 300_000 and max(sizes) <= views.TASK_ROWS

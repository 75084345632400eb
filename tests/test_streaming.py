import json
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.operators import alerts, features, forest, preparation
from emberwatch.operators.cooldown import cooldown
from emberwatch.schemas import struct
from emberwatch.session import written
from emberwatch.sources import growing_files
from emberwatch.streaming import jobs, state
from emberwatch.streaming.windows import minute_blocks

T0 = datetime(2024, 1, 1)


def put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.writelines(line + "\n" for line in lines)


def test_tail_resumes_after_restart(spark, folder):
    """Each run reads only what arrived since; a restart continues from the checkpoint."""
    src, out, mark = folder + "/in", folder + "/out", folder + "/mark"
    put(src, "auth.log", ["2024-01-01 00:00:00 old", "2024-01-03 00:00:00 one", "", "   "])
    start = F.lit("2024-01-02").cast("timestamp")

    def run():
        jobs.to_files(jobs.tail_text(spark, src, start), out, mark).awaitTermination()
        return sorted(r["raw"][-3:] for r in spark.read.parquet(out).collect())

    assert run() == ["one"]
    put(src, "sys.log", ["2024-01-04 00:00:00 two"])
    assert run() == ["one", "two"]
    assert run() == ["one", "two"]
    assert {r["source"] for r in spark.read.parquet(out).collect()} == {"auth", "sys"}


def append(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "a") as f:
        f.write(text)


class Tail:
    """A tailing job that is started anew for every look."""

    def __init__(self, spark, folder, **options):
        self.spark, self.src, self.folder, self.options = spark, folder + "/in", folder, options
        os.makedirs(self.src)

    def look(self):
        lines = growing_files.read_stream(self.spark, self.src, **self.options)
        jobs.to_files(lines, self.folder + "/out", self.folder + "/mark").awaitTermination()
        rows = self.spark.read.schema(growing_files.SCHEMA).parquet(self.folder + "/out").collect()
        return sorted((r["source"], r["raw"]) for r in rows)


def test_tail_follows_growth_and_renaming(spark, folder):
    tail = Tail(spark, folder, pattern="*.log")
    append(tail.src, "auth.log", "one\n\n  \ntwo\nthr")
    append(tail.src, "other.txt", "not followed\n")
    assert tail.look() == [("auth", "one"), ("auth", "two")]  # an unfinished line waits
    append(tail.src, "auth.log", "ee\nfour\n")
    assert [r for _, r in tail.look()] == ["four", "one", "three", "two"]
    # lines added just before the renaming are read under the new name, nothing is read twice
    append(tail.src, "auth.log", "five\n")
    os.rename(tail.src + "/auth.log", tail.src + "/auth.log.1")
    append(tail.src, "auth.log", "six\n")
    append(tail.src, "new.log", "seven\n")
    want = ["five", "four", "one", "six", "three", "two"]
    assert tail.look() == [("auth", r) for r in want] + [("new", "seven")]
    os.rename(tail.src + "/auth.log.1", tail.src + "/auth.log.2")
    os.rename(tail.src + "/auth.log", tail.src + "/auth.log.1")
    assert tail.look() == [("auth", r) for r in want] + [("new", "seven")]


def test_tail_follows_copies_and_rewritten_files(spark, folder):
    tail = Tail(spark, folder, pattern="*.log")
    append(tail.src, "a.log", "a1\na2\n")
    append(tail.src, "b.log", "b1 long enough\n")
    tail.look()
    # a.log is copied with a line not yet read, then emptied and written on; b.log is replaced by longer text
    append(tail.src, "a.log", "a3\n")
    with open(tail.src + "/a.log") as f:
        append(tail.src, "a.log.1", f.read())
    for name, text in (("a.log", "a4\n"), ("b.log", "b2 other text\nb3 more\n")):
        with open(f"{tail.src}/{name}", "w") as f:
            f.write(text)
    assert [r for _, r in tail.look()] == ["a1", "a2", "a3", "a4", "b1 long enough", "b2 other text", "b3 more"]


def test_tail_starts_at_the_end(spark, folder):
    tail = Tail(spark, folder, start="end", pattern="*.log")
    append(tail.src, "auth.log", "history\n")
    assert tail.look() == []
    append(tail.src, "auth.log", "now\n")
    append(tail.src, "late.log", "whole\n")
    assert tail.look() == [("auth", "now"), ("late", "whole")]


def test_tail_splits_files_between_lines(spark, folder):
    tail = Tail(spark, folder, split_bytes=7)
    text = "".join(f"{'é' * (i % 9)}{i}\n" for i in range(60)) + "\xff\n"
    os.makedirs(tail.src + "/sub")
    with open(tail.src + "/sub/wide.log", "wb") as f:
        f.write(text.encode("utf-8") + b"\xfe\xff bad\n")
    got = tail.look()
    assert len(got) == 62 and [s for s, _ in got] == ["wide"] * 62
    assert {r for _, r in got} == {f"{'é' * (i % 9)}{i}" for i in range(60)} | {"\xff", "\ufffd\ufffd bad"}


def test_polling_goes_on_after_a_restart(spark, folder):
    """Interval polling: two runs with a trigger interval, stopped in between while the file grows."""
    src = folder + "/in"
    append(src, "auth.log", "".join(f"line {i}\n" for i in range(10)))

    def poll(until):
        lines = growing_files.read_stream(spark, src, pattern="*.log")
        job = jobs.to_files(lines, folder + "/out", folder + "/mark", processing="1 second")
        try:
            for _ in range(60):
                time.sleep(1)
                done = sorted(int(r["raw"][5:]) for r in spark.read.schema(growing_files.SCHEMA).parquet(folder + "/out").collect())
                if len(done) >= until:
                    return done
                append(src, "auth.log", f"line {poll.next}\n" if poll.next < until else "")
                poll.next += poll.next < until
        finally:
            job.stop()
        raise AssertionError(f"{done} after a minute")

    poll.next = 10
    assert poll(13) == list(range(13))
    append(src, "auth.log", "line 13\n")
    poll.next = 14
    assert poll(16) == list(range(16))


SCHEMA = struct("key string, ts timestamp, tie bigint")


def feed(folder, name, rows):
    put(folder, name, [json.dumps({"key": k, "ts": t.isoformat() + "Z", "tie": i}) for k, t, i in rows])


def file_stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)


def test_cooldown_over_batches_equals_batch(spark, folder):
    """Three restarts; null keys, times and ties, and ties beyond 2^53, come out as in the batch operator."""
    src = folder + "/in"
    rows = [(None if i % 7 == 0 else "k" + str(i % 3), T0 + timedelta(seconds=17 * i), None if i % 5 == 0 else i + 2**53) for i in range(60)]
    untimed = [("k1", None, i) for i in (1, 2)]
    for part in range(3):
        put(src, f"p{part}.json", [json.dumps({"key": k, "ts": t.isoformat() + "Z", "tie": i}) for k, t, i in rows[20 * part : 20 * part + 20]])
        if part == 1:
            put(src, "untimed.json", [json.dumps({"key": k, "tie": i}) for k, _, i in untimed])
        jobs.cooldown_job(file_stream(spark, src, SCHEMA), "key", "ts", 60, "tie", folder + "/out", folder + "/mark").awaitTermination()
    df = spark.createDataFrame(rows + untimed, SCHEMA)
    assert sorted(map(str, spark.read.parquet(folder + "/out").collect())) == sorted(map(str, cooldown(df, "key", "ts", 60, "tie").collect()))


@pytest.fixture
def one_partition(spark):
    """State of a stream keeps the number of partitions it began with; few make small batches quick."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_cooldown_state_stays_flat(spark, folder, one_partition):
    """New keys in every micro-batch, old ones forgotten by their timers."""
    for part in range(10):
        feed(folder + "/in", f"p{part:02d}.json", [(f"k{part}-{i}", T0 + timedelta(minutes=10 * part, seconds=i), i) for i in range(20)])
        os.utime(f"{folder}/in/p{part:02d}.json", (1_700_000_000 + part,) * 2)
    job = jobs.cooldown_job(file_stream(spark, folder + "/in", SCHEMA), "key", "ts", 60, "tie", folder + "/out", folder + "/mark", retain_seconds=1200)
    job.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress if p["stateOperators"]]
    # a key has its last time and a timer; without timers the last batch would hold 10 * 20 keys
    assert len(sizes) >= 10 and max(sizes[6:]) <= max(sizes[:6]) and spark.read.parquet(folder + "/out").count() == 200


def test_dedup_remembers_across_batches(spark, folder):
    for part in range(2):
        feed(folder + "/in", f"p{part}.json", [("a", T0, 1), ("a", T0 + timedelta(part), 2), (f"n{part}", T0, 3)])
        stream = jobs.dedup_alerts(jobs.tail_json(spark, folder + "/in", SCHEMA, []), ["key"], "ts")
        jobs.to_files(stream, folder + "/out", folder + "/mark").awaitTermination()
    assert sorted(r["key"] for r in spark.read.parquet(folder + "/out").collect()) == ["a", "n0", "n1"]


def test_late_events_join_their_minute_once(spark, folder):
    """An event late within the watermark is counted; a closed minute is not reopened."""
    schema = struct("source string, ts timestamp, raw string")

    def add(name, *offsets):
        put(folder + "/in", name, [json.dumps({"source": "s", "ts": (T0 + timedelta(seconds=o)).isoformat() + "Z", "raw": "x"}) for o in offsets])
        stream = minute_blocks(jobs.tail_json(spark, folder + "/in", schema, []), ["source"], watermark="2 minutes")
        jobs.to_files(stream, folder + "/out", folder + "/mark").awaitTermination()

    add("a.json", 5, 70)
    add("b.json", 10, 400)  # 10 s is late but inside the watermark
    add("c.json", 20, 900)  # 20 s is too late, its minute has been closed
    got = {r["minute"][-8:]: r["num_events"] for r in spark.read.schema("minute string, source string, num_events bigint, chars bigint").parquet(folder + "/out").collect()}
    assert got == {"00:00:00": 2, "00:01:00": 1, "00:06:00": 1}


def test_latest_health_writes_changes_and_compacts(spark, folder):
    schema = struct("machine string, cpu double, updated_at timestamp, seq bigint")
    for part in range(7):
        rows = [{"machine": m, "cpu": float(part), "updated_at": (T0 + timedelta(part)).isoformat() + "Z", "seq": part} for m in ("PC1", f"pc{part + 5}")]
        rows.append({"machine": "pc1", "cpu": -1.0, "updated_at": T0.isoformat() + "Z", "seq": -part})
        put(folder + "/in", f"p{part}.json", [json.dumps(r) for r in rows])
        os.utime(f"{folder}/in/p{part}.json", (1_700_000_000 + part,) * 2)
    job, table = jobs.latest_health_job(file_stream(spark, folder + "/in", schema), folder + "/out", folder + "/mark")
    job.awaitTermination()
    want = {"pc1": 6.0} | {f"pc{p + 5}": float(p) for p in range(7)}
    assert {r["machine"]: r["cpu"] for r in table.latest().collect()} == want
    # a batch wrote the two machines it changed; a base takes the place of the changes before it
    assert {r["machine"] for r in spark.read.parquet(f"{folder}/out/change={3:012d}").collect()} == {"pc1", "pc8"}
    table.every = 7
    empty = spark.createDataFrame([], table.latest().schema)
    for again in range(2):  # a batch repeated after a failure
        table.write(empty, 7)
        assert table.folders() == [f"base={6:012d}", f"change={7:012d}"]
        assert {r["machine"]: r["cpu"] for r in table.latest().collect()} == want


EVENT = struct("block_id string, template_id string, source_machine string, line_id bigint, ts timestamp, raw string, priority_threat string")


def test_score_cycle_does_not_depend_on_batches(spark, folder, one_partition):
    """Parts of blocks equal the batch features, rules fire once, model alerts pass the cooldown."""
    words = ["failed password for root", "ERROR connection refused", "privilege change for admin", "all fine", "scheduled task created"]
    rows = []
    for i in range(240):
        at = T0 + timedelta(minutes=2 * i)
        rows.append((None if i % 11 == 0 else f"b{i % 4}", f"t{i % 5}", f"m{i % 3}" if i % 13 else None, None if i % 2 else i, at, f"{words[i % 5]} {i}", "x" if i % 17 == 0 else None))
    names = EVENT.names

    def stream(parts):
        src = f"{folder}/in{parts}"
        for part in range(parts):
            own = rows[part * len(rows) // parts : (part + 1) * len(rows) // parts]
            put(src, f"p{part}.json", [json.dumps(dict(zip(names, r)) | {"ts": r[4].isoformat() + "Z"}) for r in own])
            os.utime(f"{src}/p{part}.json", (1_700_000_000 + part,) * 2)
        return file_stream(spark, src, EVENT)

    events = written(spark.createDataFrame(rows, EVENT), "events")
    whole = written(features.realtime_block_features(events, min_events=3, span="1 hour"), "parts")
    model = forest.fit(preparation.zero_fill(whole, D.MODEL_FEATURES), D.MODEL_FEATURES, trees=10, contamination=0.2)
    newest = max(r[4] for r in rows)
    due = whole.filter(F.col("closed_at") <= F.lit(newest - timedelta(minutes=10)))
    want = written(forest.score(due, model).drop("is_anomaly", "prediction").withColumnRenamed("last_at", "alert_at"), "scored")

    def told(df, *columns):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.select(*columns).collect())

    out = f"{folder}/out"
    cycle = jobs.score_cycle_job(stream(3), model, out, f"{out}/mark", threshold=0.0, seconds=3600)
    cycle.awaitTermination()
    assert told(cycle.blocks(), *want.columns) == told(want, *want.columns) and want.count() > 20
    found = written(cycle.alerts(), "alerts")
    columns = ["block_id", "alert_at", "priority", "anomaly_score", "num_events"]
    kept = told(alerts.model_alerts(want, threshold=0.0, seconds=3600), *columns)
    assert told(found.filter("not rule_based"), *columns) == kept and kept
    pair = ["block_id", F.element_at("threat_categories", 1), "priority"]
    rules = told(alerts.rule_alerts(events), *pair)
    assert told(found.filter("rule_based"), *pair) == rules and len(rules) > 5


def test_cooldown_state_holds_few_rows_of_a_key(monkeypatch):
    """A key's micro-batch of any size passes in order while its rows are on disk."""
    import random
    import tracemalloc

    from pyspark.sql import Row

    class Last:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    def run(n):
        """Peak memory of a batch of n rows in random order, and what it keeps."""
        processor = state.CooldownProcessor(1000, None)
        processor.last = Last()
        draw = random.Random(1)
        ids = list(range(n))
        draw.shuffle(ids)
        rows = (Row(t_=7 * i, tie_=None if i % 2 else i, row_=Row(event=f"event {i}", pad="x" * 200 + str(i))) for i in ids)
        tracemalloc.start()
        kept = [r["row_"]["event"] for r in processor.handleInputRows("k", rows, None)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak, kept, processor.last.value

    small, _, _ = run(50_000)
    large, kept, last = run(200_000)
    assert kept == [f"event {i}" for i in range(0, 200_000, 143)]
    assert last == (7 * (199_999 // 143 * 143),)
    assert large < 1.5 * small


def test_sorted_runs_are_merged_when_many(monkeypatch):
    monkeypatch.setattr(state, "MOST_RUNS", 3)
    runs = state.Runs(rows=4, block=2)
    for i in range(50):
        runs.add((i * 37 % 50, i))
    assert len(runs.files) <= 3 and [x for x, _ in runs.merged()] == list(range(50))
    runs.close()

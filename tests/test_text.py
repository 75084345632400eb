import hashlib
import re

import pytest
from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.functions import blocks, text, threats
from emberwatch.operators import parsing

LINES = [
    "Mar 15 12:34:56 myhost sshd[1234]: Failed password for root from 10.1.2.3:22 port 50022 ssh2",
    "2024-01-05T10:00:00.123Z host kernel: eth0 00:1a:2b:3c:4d:5e up at 0x7fff",
    "081109 203518 143 INFO dfs.DataNode: Receiving block blk_-160899 src: /10.250.19.102:54106",
    r"host agent: opened C:\Windows\System32\cmd.exe by a.b+c@example.co.uk",
    "x id 123e4567-e89b-12d3-a456-426614174000 sid S-1-5-21-11-22-33 deadbeefcafe",
    "a é/x/y é5 ünï 42  spaced   out",
    "https://example.com/a/b?c=1 GET /index.html PORT 8080",
    "single",
    "  padded line 7  ",
    "addr fe80:0000:0000:0000:0202:b3ff:fe1e:8329 ok",
]


def python_template(raw):
    """The rule list applied with Python's own regular expressions."""
    found = re.match(r"^(?:\S+\s+\d+\s+\d+:\d+:\d+\s+)?(?:\S+\s+)?(.+)$", raw.strip())
    out = found.group(1) if found else raw
    for pattern, replacement in text.REWRITES:
        out = re.sub(pattern, replacement, out)
    return out.strip()


def test_normalize_equals_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(LINES)], "i int, raw string")
    staged = parsing.with_template(df).withColumn("direct", text.normalize("raw"))
    for row in staged.collect():
        want = python_template(row["raw"])
        assert row["template"] == want
        assert row["direct"] == want
        assert row["template_id"] == int(hashlib.md5(want.encode()).hexdigest()[:8], 16) % 100000


def test_filter_on_template_stays_small(spark):
    """A filter on the mined columns is pushed down without blowing up the plan."""
    df = spark.createDataFrame([(s,) for s in LINES], "raw string").repartition(2)
    out = parsing.with_template(df).filter("template_id > 5 AND template <> 'x'")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 20 * len(text.REWRITES)
    assert out.count() == len(LINES)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2024 [Security] EventID=4625 An account", "Security failed_logon"),
        ("[Setup] EventID=1102", "Windows audit_log_cleared"),
        ("[System] EventID=31337 x", "System windows_event_31337"),
    ],
)
def test_windows_template(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert parsing.with_template(df).first()["template"] == want
    assert df.select(text.normalize("raw")).first()[0] == want


def test_timestamps(spark):
    cases = {
        "2024-03-01T05:06:07.5Z x": "2024-03-01 05:06:07",
        "  2024-03-01 05:06:07 x": "2024-03-01 05:06:07",
        "08/11/09 20:35:18 INFO": "2008-11-09 20:35:18",
        "70/11/09 20:35:18 INFO": "1970-11-09 20:35:18",
        "2024-03-01": "2024-03-01 00:00:00",
        "2024-03-01 99:00:00": "2024-03-01 00:00:00",
        "2024-02-30 10:00:00": None,
        "Mar 15 12:34:56": None,
        "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    out = df.select("raw", F.date_format(text.parse_timestamp("raw"), "yyyy-MM-dd HH:mm:ss").alias("t"))
    assert {r["raw"]: r["t"] for r in out.collect()} == cases


def test_mask_email_and_tips(spark):
    df = spark.createDataFrame(
        [("maria@x.org",), ("m@x.org",), ("nobody",), (None,), ("a@b@c",)], "e string"
    )
    got = [r[0] for r in df.select(text.mask_email("e")).collect()]
    phrase = "your registered email"
    assert got == ["m***@x.org", "***@x.org", phrase, phrase, "***@b@c"]
    tip = spark.createDataFrame([("1. One. 2. Two now. 3. Three. 4. Four",), ("",), (None,)], "tip string")
    rows = tip.select(text.immediate_steps("tip"), text.later_steps("tip")).collect()
    assert rows[0][0] == ["One.", "Two now."] and rows[0][1] == ["Three.", "Four"]
    assert rows[1][0] == [] and rows[2][1] == []


THREAT_LINES = {
    "brute_force": "Logon failure: bad credentials supplied - login failed for guest account",
    "privilege_esc": "Escalation to root/admin detected: permission denied then overridden",
    "dos": "Service flooding detected: connection refused after flood threshold exceeded",
    "log_tamper": "Log truncated: cleared event history - log rotation forced",
    "startup": "Boot time entry added: autorun modified in startup configuration",
    "network": "Firewall alert: SSH connection attempt blocked from external IP",
}


@pytest.mark.parametrize("keywords", [D.BATCH_KEYWORDS, D.REALTIME_KEYWORDS])
def test_each_category_fires(spark, keywords):
    df = spark.createDataFrame(list(THREAT_LINES.items()), "want string, raw string")
    rows = threats.with_lowered(df).select("*", *threats.threat_flags(F.col("_lower"), keywords)).collect()
    for row in rows:
        lowered = row["raw"].lower()
        for category, words in keywords.items():
            assert row[f"{category}_flag"] == int(any(w in lowered for w in words))
        assert row[f"{row['want']}_flag"] == 1


def test_levels_and_weights(spark):
    df = spark.createDataFrame(
        [("FATAL crash",), ("Warning: low",), ("all good",), ("errors happened",), ("malware attack exploit",), ("  ",)],
        "raw string",
    )
    rows = df.select(
        threats.level(F.lower("raw")), threats.keyword_score(F.col("raw")), threats.score_band(threats.keyword_score(F.col("raw")))
    ).collect()
    assert [r[0] for r in rows] == ["ERROR", "WARN", "INFO", "ERROR", "INFO", "INFO"]
    # whole words only: 'errors' is not 'error'; the sum is capped at ten
    assert [r[1] for r in rows] == [0.0, 1.0, 0.0, 0.0, 10.0, 0.0]
    assert [r[2] for r in rows] == ["NONE", "LOW", "NONE", "NONE", "CRITICAL", "NONE"]


def test_block_ids(spark):
    df = spark.createDataFrame(
        [
            ("hdfs", "block blk_-12 then blk_7", 3),
            ("hdfs", "none", 4),
            ("syslog", "sshd[77]: x", 5),
            ("syslog", "plain", 6),
            ("winlog", "recordnumber = 9", 7),
            ("winlog", "plain", 8),
            ("generic", "sshd[77]: x", 9),
        ],
        "fmt string, raw string, line_id bigint",
    ).withColumn("ts", F.lit("2024-01-02 03:04:59").cast("timestamp"))
    got = [r[0] for r in df.select(blocks.block_by_format(*[F.col(c) for c in ("fmt", "raw", "line_id", "ts")])).collect()]
    assert got == [
        "blk_-12", "hdfs_line_4", "sshd_77", "syslog_20240102_0304",
        "win_9_20240102_0304", "win_line_8", "generic_20240102_0304",
    ]


def test_paths_with_many_segments(spark):
    """A blob with as many slashes as letters is one path and does not use the stack up."""
    rows = [("at " + "/a" * 100_000 + " end",), ("C:\\" + "x\\" * 100_000 + "y end",)]
    out = spark.createDataFrame(rows, "raw string").select(text.rewrite(F.col("raw")).alias("t"))
    assert [r["t"] for r in out.collect()] == ["at <PATH> end", "<PATH> end"]

import gzip
import os

from pyspark.sql import functions as F

from emberwatch.operators import parsing
from emberwatch.schemas import struct
from emberwatch.session import configure
from emberwatch.sources import records, text_files


def put(folder, name, content, mode="w"):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(content)
    return path


def test_line_numbers_across_splits(spark, folder):
    """A file cut into many splits keeps exact line numbers; blank lines count."""
    lines = [f"line number {i}" if i % 10 else "" for i in range(1, 3001)]
    put(folder, "big.log", "\n".join(lines) + "\n")
    with gzip.open(os.path.join(folder, "small.log.gz"), "wt") as f:
        f.write("first\n\n   \nfourth\n")
    put(folder, "skip.bin", "never read")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        out = text_files.read_log_lines(spark, folder)
        assert out.rdd.getNumPartitions() > 4
        rows = out.select(text_files.file_name(F.col("file")).alias("f"), "line_id", "raw").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    big = {r["line_id"]: r["raw"] for r in rows if r["f"] == "big.log"}
    assert big == {i + 1: s for i, s in enumerate(lines) if s}
    assert {(r["line_id"], r["raw"]) for r in rows if r["f"] == "small.log.gz"} == {(1, "first"), (4, "fourth")}


def test_directory_formats_and_csv_exports(spark, folder):
    put(folder, "hdfs_day.log", "2024-01-01 00:00:00 Receiving blk_-1\nno block\n")
    put(folder, "plain.txt", "2024-01-01 10:11:12 hello\n")
    put(folder, "content.log", "a\nb\nc\nd\nsshd[5]: late hint\n")
    put(folder, "toolate.log", "a\nb\nc\nd\ne\nsshd[5]: sixth line\n")
    put(folder, "sub/authlog.txt", "su: nested\n")
    put(folder, "winlog.csv", '﻿TimeCreated,LevelDisplayName,Id,Message\n2024-01-01 01:02:03,Error,4625,"two\nlines ""q"""\n')
    put(folder, "other.csv", "x,y\n1,2\n")
    flat = text_files.read_directory(spark, folder)
    got = {(r["source"], r["line_id"]): r for r in flat.collect()}
    assert got["hdfs_day", 1]["block_id"] == "blk_-1" and got["hdfs_day", 2]["block_id"] == "hdfs_line_2"
    assert got["plain", 1]["block_id"] == "generic_20240101_1011" and got["plain", 1]["os"] == "unknown"
    assert got["content", 5]["format"] == "syslog" and got["content", 5]["block_id"] == "sshd_5"
    assert got["toolate", 6]["format"] == "generic"
    assert got["winlog", 1]["raw"] == '2024-01-01 01:02:03 [Error] EventID=4625 two lines "q"'
    assert got["winlog", 1]["os"] == "windows" and got["winlog", 1]["block_id"] == "win_line_1"
    assert got["other", 1]["raw"] == "x,y" and ("authlog", 1) not in got
    deep = text_files.read_directory(spark, folder, recursive=True).filter("source = 'authlog'").collect()
    assert [(r["format"], r["os"]) for r in deep] == [("syslog", "linux")]


def test_alternate_csv_headers(spark):
    df = spark.createDataFrame([("t", "Warn", 7, "a\r\nb")], "`Date and Time` string, Level string, `Event ID` int, Description string")
    assert df.select(text_files.winlog_line(df)).first()[0] == "t [Warn] EventID=7 a  b"


def test_json_lines(spark, folder):
    put(folder, "e.jsonl", '{"raw": "a", "block_id": "b", "extra": 1}\nnot json\n{"raw": "only"}\n\n{"block_id": "c", "raw": "d"}\n')
    schema = struct("raw string, block_id string")
    rows = records.read_json_lines(spark, folder, schema, ["raw", "block_id"]).collect()
    assert {tuple(r) for r in rows} == {("a", "b"), ("d", "c")}
    out = folder + "/out"
    records.write_json_lines(spark.createDataFrame([tuple(r) for r in rows], schema), out)
    records.write_json_lines(spark.createDataFrame([("x", "y")], schema), out, append=True)
    assert records.read_json_lines(spark, out, schema).count() == 3


XML = """<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="p"/>
<EventID Qualifiers="0">4625</EventID><Level>2</Level><TimeCreated SystemTime="2024-01-01T00:00:00Z"/>
<EventRecordID>{rec}</EventRecordID><Channel>Security</Channel><Computer>pc1</Computer></System>{data}</Event>"""


def test_event_xml(spark):
    many = "<EventData>" + "".join(f'<Data Name="n{i}">v{i}</Data>' for i in range(10)) + "</EventData>"
    user = "<UserData><Op xmlns='x'><Who>bob</Who><What> cleared </What></Op></UserData>"
    text = XML.format(rec=12, data=many) + "\n" + XML.format(rec=11, data=user) + "<Event><broken"
    docs = records.split_events(spark.createDataFrame([(text,)], "xml string"), "xml")
    rows = {r["record_id"]: r["raw"] for r in records.xml_event_lines(docs).collect()}
    head = "Channel=Security EventID=4625 Level=ERROR Time=2024-01-01T00:00:00Z Computer=pc1"
    tail = " | keywords=failed logon authentication failure brute force"
    assert rows[12] == head + " | " + " | ".join(f"n{i}=v{i}" for i in range(8)) + tail
    assert rows[11] == head + " | bob | cleared" + tail
    assert set(rows) == {11, 12}


def test_agent_batches(spark):
    payload = '[{"log": " EventID=4625 x ", "source": "pc"}, {"log": "  "}, {"log": "hi"}]'
    df = spark.createDataFrame([(payload,)], "payload string").withColumn(
        "received_at", F.lit("2024-01-01 10:20:30").cast("timestamp")
    )
    rows = records.agent_events(df).collect()
    assert [(r["raw"], r["block_id"], r["priority_threat"]) for r in rows] == [
        ("EventID=4625 x", "agent_pc_20240101_1020", "brute_force"), ("hi", "agent_agent_20240101_1020", None),
    ]


def test_cursor_never_goes_back(spark):
    events = spark.createDataFrame([("a", 5), ("a", 9), ("b", 2)], "s string, r bigint")
    cursor = spark.createDataFrame([("a", 7), ("c", 4)], "s string, last_record bigint")
    assert {tuple(r) for r in records.since_cursor(events, cursor, "s", "r").collect()} == {("a", 9), ("b", 2)}
    high = records.cursor_high_water(events.filter("r < 9"), "s", "r", cursor)
    assert {tuple(r) for r in high.collect()} == {("a", 7), ("b", 2), ("c", 4)}


def test_catalog_last_template_wins(spark, folder):
    df = spark.createDataFrame([(7, "old", 1), (7, "new", 9), (3, "x", 2)], "template_id bigint, template string, line_id bigint")
    catalog = parsing.template_catalog(df)
    records.write_catalog(catalog, folder + "/c")
    assert [tuple(r) for r in spark.read.json(folder + "/c").select("template_id", "template").orderBy("template_id").collect()] == [(3, "x"), (7, "new")]


def test_parsed_event_defaults(spark):
    row = parsing.parsed_events(spark.createDataFrame([("hello 5", 3)], "raw string, line_id bigint")).first()
    assert (row["block_id"], row["source"], row["os"], row["template"]) == ("unknown_3", "unknown", "unknown", "<NUM>")


def test_csv_exports_with_their_own_headers(spark, folder):
    """Layouts differ by file; blanks and plus signs in names are part of the name."""
    put(folder, "winlog a.csv", "TimeCreated,LevelDisplayName,Id,Message\n2024-01-01 00:00:00,Error,1,first\n")
    put(folder, "winlog+b.csv", "Message,Id,Date and Time,Level,Source\nhello two,4625,2024-01-02 00:00:00,Information,SRC\n")
    rows = {r["source"]: (r["line_id"], r["raw"]) for r in text_files.read_directory(spark, folder).collect()}
    assert rows == {
        "winlog a": (1, "2024-01-01 00:00:00 [Error] EventID=1 first"),
        "winlog+b": (1, "2024-01-02 00:00:00 [Information] EventID=4625 hello two"),
    }


def test_csv_exports_wider_than_the_usual(spark, folder):
    """Columns count however far right they stand, behind empty header cells too."""
    wide = ",".join(["x"] * 70) + "," * 30
    put(folder, "winlog a.csv", f"{wide},TimeCreated,LevelDisplayName,Id,Message\n{wide},2024-01-01 00:00:00,Error,1,first\n")
    put(folder, "winlog b.csv", "TimeCreated,LevelDisplayName,Id,Message\n2024-01-02 00:00:00,Error,2,second\n")
    got = sorted(r["raw"] for r in text_files.read_winlog_csv(spark, folder).collect())
    assert got == ["2024-01-01 00:00:00 [Error] EventID=1 first", "2024-01-02 00:00:00 [Error] EventID=2 second"]


def test_event_xml_keeps_other_data_elements(spark):
    xml = (
        "<Event><System><EventRecordID>7</EventRecordID><EventID>9</EventID><Channel>C</Channel></System>"
        "<EventData><Data Name='a'>1</Data><Binary>FFEE</Binary></EventData></Event>"
    )
    line = records.xml_event_lines(spark.createDataFrame([(xml,)], "xml string")).first()["raw"]
    assert line.endswith(" | a=1 | FFEE")


def test_event_xml_is_parsed_once(spark):
    """Not in a filter that moves below the shuffle, where the input may be a single split."""
    lines = records.xml_event_lines(spark.range(8).repartition(2).selectExpr("concat('<Event><System/></Event>', id) AS xml"))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") == 1


def test_event_xml_searches_wherever_elements_may_hide(spark):
    """Texts of all but plain data elements are found by path, whatever the event looks like."""
    head = "<System><EventRecordID>{}</EventRecordID><EventID>9</EventID><Channel>C</Channel></System>"
    data = [
        "<EventData><Data>1</Data></EventData>",
        "<EventData><Data/><Data Name='a'>1</Data >\n</EventData >",
        "<EventData><Data>1<b>deep</b></Data></EventData>",
        "<EventData><DataX>2</DataX></EventData>",
        "<EventData><EventData>3</EventData></EventData>",
        "<EventData/><UserData><x>4</x></UserData>",
        "<UserData>5</UserData>",
        "",
    ]
    rows = [(f"<Event>{head.format(i)}{d}</Event>",) for i, d in enumerate(data)]
    rows.append((f"<Event><EventData><Binary>6</Binary></EventData>{head.format(len(data))}</Event>",))
    got = {r["record_id"]: r["raw"].split("Time=")[1] for r in records.xml_event_lines(spark.createDataFrame(rows, "xml string")).collect()}
    assert got == {0: " | 1", 1: " | a=1", 2: " | 1 | deep", 3: " | 2", 4: " | 3", 5: "", 6: " | 5", 7: "", 8: " | 6"}


def test_large_trees_are_listed_by_few_tasks(spark, folder):
    """A file per folder: listing takes a bounded number of tasks, not one for each folder."""
    for i in range(300):
        put(folder, f"user={i}/e.xml", f"<Event><System><EventRecordID>{i}</EventRecordID></System></Event>")
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        out = records.read_event_xml(configure(spark), folder, recursive=True)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 256
    assert out.count() == 300

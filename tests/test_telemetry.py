import json
import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from watchfloor.operators import shapes
from watchfloor.operators.matching import technique_hits
from watchfloor.operators.telemetry import merge_json, normalise_shipped, parse_audit_lines
from watchfloor.sources import telemetry
from watchfloor.streaming import jobs

LINES = [
    json.dumps({"timestamp": "2024-01-01T00:10:00Z", "technique": "T1190", "message": "m", "odd": {"a": 1}, "serial": 7}),
    json.dumps({"@timestamp": "2024-01-01T00:20:00+00:00", "technique": "T1190"}),
    json.dumps({"timestamp": "2024-01-02T05:00:00Z", "technique": "T1059.004", "returncode": "x"}),
    json.dumps({"timestamp": "never", "key": "exec"}),
    "", "  ", "{broken", "[1, 2]",
]


@pytest.fixture
def lines(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(LINES[:3]) + "\n")
    (folder / "b.jsonl").write_text("\n".join(LINES[3:]) + "\n")
    return str(folder)


def test_json_lines(spark, lines):
    rows = telemetry.read_events(spark, lines).collect()
    assert len(rows) == 4
    first = next(r for r in rows if r.message == "m")
    assert (first.serial, first.attrs, str(first.timestamp)) == (7, {"odd": '{"a":1}'}, "2024-01-01 00:10:00")
    assert {str(r.timestamp) for r in rows} >= {"2024-01-01 00:20:00", "None"}
    assert telemetry.rejected_lines(spark.read.text(lines)).count() == 2
    assert telemetry.read_events(spark, lines, "2024-01-02 00:00:00").count() == 2  # unreadable time is kept


def test_daily_store_prunes_folders(spark, lines, tmp_path):
    store = str(tmp_path / "store")
    telemetry.write_store(telemetry.read_events(spark, lines), store)
    events = telemetry.read_store(spark, store, first_day="2024-01-02", last_day="2024-01-02")
    assert events.count() == 1
    assert "PartitionFilters: [isnotnull(event_date" in events._jdf.queryExecution().executedPlan().toString()
    days = {str(r.event_date): r.n for r in telemetry.store_counts(telemetry.read_store(spark, store)).collect()}
    assert days == {"2024-01-01": 2, "2024-01-02": 1, "None": 1}


def test_shipper_normalisation(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES ('{\"host\": \"new\", \"n\": 3, \"timestamp\": \"2024-01-01T00:00:00Z\"}', 'old', 'l', NULL), "
        "('plain text', 'kept', 'l', '2024-01-02T00:00:00Z') AS t(message, host, label, timestamp)"
    )
    out = normalise_shipped(rows, {"host": "STRING", "n": "INT", "timestamp": "STRING"}).orderBy("timestamp").collect()
    assert [(r.host, r.n, str(r.timestamp)) for r in out] == [("new", 3, "2024-01-01 00:00:00"),
                                                              ("kept", None, "2024-01-02 00:00:00")]
    assert "label" not in out[0]
    assert merge_json(spark.sql("SELECT '{}' AS j, 0 AS k"), "j", {"k": "INT"}).first().k == 0


AUDIT = [
    'type=SYSCALL msg=audit(1704067200.000:1): syscall=59 exe="/bin/sh" key=shell_exec returncode=0 a9=zz',
    'type=PATH msg=audit(1704070900.500:2): name=2F746D70 key="unknown"',
    "",
]


def test_audit_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "audit"
    folder.mkdir()
    (folder / "1.log").write_text("\n".join(AUDIT))
    batch = parse_audit_lines(spark.read.text(str(folder)), host="h").orderBy("serial").collect()
    assert [(r.technique, r.syscall_name, r.exe, r.name) for r in batch] == [
        ("T1059.004", "execve", "/bin/sh", None), (None, None, None, "/tmp")
    ]
    assert batch[0].attrs == {"a9": "zz", "returncode": "0"} and batch[0].returncode == 0 and batch[0].host == "h"
    out = str(tmp_path / "out")
    query = jobs.append_store(jobs.audit_events(spark, str(folder), host="h"), out, f"audit-{uuid.uuid4()}", available_now=True)
    query.awaitTermination(120)
    streamed = spark.read.parquet(out).orderBy("serial").collect()
    assert [r.asDict() for r in streamed] == [r.asDict() for r in batch]


def test_shipped_stream_reads_each_segment_once(spark, lines, tmp_path):
    out = str(tmp_path / "out")
    name = f"ship-{uuid.uuid4()}"
    for expected in (4, 5):
        query = jobs.append_store(jobs.shipped_events(spark, lines), out, name, available_now=True)
        query.awaitTermination(120)
        assert spark.read.parquet(out).count() == expected
        (tmp_path / "in" / "c.jsonl").write_text(json.dumps({"timestamp": "2024-02-01T00:00:00Z", "message": "late"}) + "\n")


def test_hourly_monitor_matches_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    start = datetime(2024, 1, 1)
    rng = random.Random(3)
    stamps = sorted(start + timedelta(minutes=rng.randint(0, 599)) for _ in range(200))
    rows = [{"timestamp": s.isoformat() + "Z", "technique": rng.choice(["T1190", "T1059", "T1"])} for s in stamps]
    rows.append({"timestamp": "2024-01-03T00:00:00Z", "technique": "T9"})  # moves the watermark past every hour
    (folder / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    bound = spark.sql("SELECT * FROM VALUES ('r1', 'T1190'), ('r2', 'T1059.001') AS t(rule_id, technique_id)")
    batch_hits = technique_hits(telemetry.read_events(spark, str(folder)), bound, keep=("timestamp",))
    batch = {(str(r.hour_start), r.rule_id, r.n) for r in shapes.hourly_alerts(batch_hits, "rule_id", 0).collect()}
    out = str(tmp_path / "out")
    query = jobs.append_alerts(jobs.hourly_alerts(jobs.shipped_events(spark, str(folder)), bound), out, f"alerts-{uuid.uuid4()}", available_now=True)
    query.awaitTermination(180)
    streamed = {(str(r.hour_start), r.rule_id, r.n) for r in spark.read.parquet(out).collect()}
    assert streamed == batch and len(batch) > 10


def test_revalidation_reloads_rules(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out = str(tmp_path / "out")
    current = {"sql": "SELECT 'r1' AS rule_id, array('T1190') AS techniques, CAST(NULL AS ARRAY<STRING>) AS keywords, "
                      "CAST(NULL AS STRING) AS detection"}

    watcher = f"watch-{uuid.uuid4()}"

    def run(name, technique):
        (folder / name).write_text(json.dumps({"timestamp": "2024-01-01T00:00:00Z", "technique": technique}))
        jobs.revalidate(jobs.shipped_events(spark, str(folder)), lambda: spark.sql(current["sql"]), out,
                        watcher, available_now=True).awaitTermination(120)
        return {(r.rule_id, r.broad_hits) for r in
                spark.read.parquet(out).groupBy("rule_id").agg(F.sum("broad_hits").alias("broad_hits")).collect()}

    assert run("a.jsonl", "T1190") == {("r1", 1)}
    current["sql"] = current["sql"].replace("'r1'", "'r2'")
    assert run("b.jsonl", "T1190") == {("r1", 1), ("r2", 1)}


@pytest.mark.parametrize("bucket", [60, 3600, 6 * 3600, 40 * 86400])
def test_adjacent_sequence_against_brute_force(spark, bucket):
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        user = "hot" if rng.random() < 0.4 else f"u{rng.randint(0, 5)}"
        rows.append((i, start + timedelta(seconds=rng.randint(0, 3 * 86400) // 600 * 600), user, rng.choice("abc")))
    table = spark.createDataFrame(rows, "event_id INT, ts TIMESTAMP_NTZ, uid STRING, key STRING")
    got = shapes.adjacent_sequence(table, "uid", "ts", "event_id", F.col("key") == "a", F.col("key") == "b",
                                   6 * 3600, bucket_seconds=bucket)
    expected = set()
    for user in {r[2] for r in rows}:
        own = sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0]))
        for x, y in zip(own, own[1:]):
            if x[3] == "a" and y[3] == "b" and y[1] - x[1] <= timedelta(hours=6):
                expected.add((user, x[0], y[0]))
    assert {tuple(r) for r in got.collect()} == expected and expected


def test_spray_counts_distinct_values(spark):
    rows = spark.sql("SELECT * FROM VALUES ('h', 'u1', 'r1'), ('h', 'u1', 'r2'), ('h', 'u2', 'r2'), ('h', NULL, 'r2'), "
                     "('g', 'u1', NULL) AS t(host, uid, props)")
    out = {r.host: (r.failures, r.accounts, r.n_reasons) for r in shapes.spray(rows, ["host"], "uid", "props").collect()}
    assert out == {"h": (4, 2, 2), "g": (1, 1, 0)}


def test_text_signature(spark):
    docs = spark.sql("SELECT * FROM VALUES (1, 'EVAL( base64_decode('), (2, 'eval( only'), (3, 'jsp exec('), (4, NULL) AS t(id, text)")
    strings = {"$a": "eval(", "$b": "base64_decode(", "$c": "exec("}
    out = shapes.signature_matches(docs, "text", strings, "($a and $b) or ($c and not $a)")
    assert sorted(r.id for r in out.collect()) == [1, 3]
    assert shapes.signature_matches(docs, "text", strings, "$a", nocase=False).count() == 1


def test_a_stream_without_a_checkpoint_folder_is_refused(spark, lines, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "configured_folder", lambda spark: None)
    with pytest.raises(ValueError):
        jobs.append_store(jobs.shipped_events(spark, lines), str(tmp_path / "a"), "none", available_now=True)
    query = jobs.append_store(
        jobs.shipped_events(spark, lines), str(tmp_path / "b"), "own", available_now=True, checkpoint=str(tmp_path / "c")
    )
    query.awaitTermination(120)
    assert (tmp_path / "c" / "offsets").exists()


def test_bytes_that_are_no_text_are_replaced(spark):
    line = "type=PROCTITLE msg=audit(1704067200.000:9): proctitle=C3280A comm=6C73 exe=\"6C73\""
    row = parse_audit_lines(spark.createDataFrame([(line,)], "value STRING")).first()
    assert row.proctitle == "�(\n" and row.comm == "ls" and row.exe == "6C73"


def test_changed_rules_meet_the_telemetry_there_is(spark):
    from watchfloor.plans.match import Backend

    events = spark.sql("SELECT timestamp '2024-01-01' AS timestamp, 'T1190' AS technique, 'x' AS message")

    def rules(*techniques):
        rows = [(f"r{i}", f"r{i}", [t], [], None) for i, t in enumerate(techniques)]
        return spark.createDataFrame(rows, "rule_id STRING, name STRING, techniques ARRAY<STRING>, keywords ARRAY<STRING>, detection STRING")

    first, seen = jobs.revalidate_changed(rules("T1190", "T1"), None, Backend(events))
    assert {(r.rule_id, r.status) for r in first.collect()} == {("r0", "pass"), ("r1", "fail")}
    again, seen = jobs.revalidate_changed(rules("T1190", "T1190", "T2"), seen, Backend(events))
    assert {(r.rule_id, r.status) for r in again.collect()} == {("r1", "pass"), ("r2", "fail")}


def test_sketches_of_days_unite(spark):
    events = spark.range(60_000).selectExpr("date_add(DATE'2024-01-01', CAST(id % 4 AS INT)) AS event_date", "id % 7000 AS user", "IF(id % 2 = 0, NULL, 'x') AS half")
    daily = telemetry.store_sketches(events, "user", "half")
    assert daily.count() == 4
    all_days = telemetry.distinct_values(daily, "user", "half").first()
    assert abs(all_days.user - 7000) < 0.03 * 7000 and all_days.half == 1 and all_days.n == 60_000
    two = telemetry.distinct_values(daily, "user", first_day="2024-01-02", last_day="2024-01-03").first()
    exact = events.filter("event_date BETWEEN DATE'2024-01-02' AND DATE'2024-01-03'").select("user").distinct().count()
    assert abs(two.user - exact) < 0.03 * exact and two.n == 30_000
    assert telemetry.distinct_values(daily, "user", by=["event_date"]).count() == 4


def test_positions_follow_the_files(spark, tmp_path):
    rows = [(f"line {k:05d}",) for k in range(3000)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.text(str(tmp_path / "text"))
    spark.createDataFrame(rows, "value string").coalesce(1).write.parquet(str(tmp_path / "parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        for table in (spark.read.text(str(tmp_path / "text")), spark.read.parquet(str(tmp_path / "parquet"))):
            placed = telemetry.with_position(table)
            got = [r.value for r in placed.repartition(7).orderBy("position").collect()]
            assert got == [r[0] for r in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

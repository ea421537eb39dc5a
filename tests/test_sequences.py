import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from watchfloor.operators.shapes import adjacent_sequence
from watchfloor.streaming.sequences import ROCKS_DB, STATE_STORE, adjacent_sequences, keyed_state

SCHEMA = "host string, at timestamp, event_id bigint, kind string"
FIRST, SECOND = "kind = 'a'", "kind = 'b'"
START = datetime(2024, 1, 1)


def stream_of(spark, folder, out, checkpoint):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    found = adjacent_sequences(events, "host", "at", "event_id", F.expr(FIRST), F.expr(SECOND), 120, delay="30 minutes")
    with keyed_state(spark):
        writer = found.writeStream.format("parquet").outputMode("append").option("path", str(out)).option("checkpointLocation", str(checkpoint))
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return query


def write(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_stream_equals_batch_on_shuffled_segments_and_after_a_restart(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), START + timedelta(seconds=30 * k + rng.randint(0, 40)), k, rng.choice("aabc")) for k in range(300)]
    rows = [("x", START + timedelta(seconds=5), 900, "a"), ("x", START + timedelta(seconds=5), 901, "b"), (None, START, 902, "a"), ("x", None, 903, "b"), ("y", START, 904, None)] + rows
    segments = [rows[i : i + 61] for i in range(0, len(rows), 61)]
    for part in segments:
        rng.shuffle(part)
    src, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    for part in segments[:2]:
        write(spark, src, part, "a")
        stream_of(spark, src, out, checkpoint)
    for part in segments[2:]:  # the stream was stopped, and goes on where it was
        write(spark, src, part, "b")
        stream_of(spark, src, out, checkpoint)
    write(spark, src, [("end", START + timedelta(days=2), 10_000, "c")], "c")
    query = stream_of(spark, src, out, checkpoint)
    got = sorted(tuple(r) for r in spark.read.parquet(str(out)).collect())
    table = spark.createDataFrame([r for r in rows if r[0] and r[1]], SCHEMA)
    want = sorted(tuple(r) for r in adjacent_sequence(table, "host", "at", "event_id", F.expr(FIRST), F.expr(SECOND), 120).collect())
    assert got == want and len(want) > 20
    assert spark.conf.get(STATE_STORE, None) != ROCKS_DB
    # A day after the last of their events, hosts are forgotten.
    left = [s for p in query.recentProgress for s in p["stateOperators"]]
    assert left
    state = spark.read.format("state-metadata").load(str(checkpoint)).collect()
    assert state
    kept = spark.read.format("statestore").option("stateVarName", "last").load(str(checkpoint))
    assert {r[0][0] for r in kept.select("key").collect()} <= {"end"}

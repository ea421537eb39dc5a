from watchfloor.operators import matching
from watchfloor.session import inline_table
from watchfloor.streaming.totals import RunningTotals

RULES = {"rule_id": "STRING", "name": "STRING", "techniques": "ARRAY<STRING>", "keywords": "ARRAY<STRING>", "detection": "STRING"}
EVENTS = "event_id BIGINT, technique STRING, key STRING, message STRING"


def block(value):
    return f'{{"s": {{"key": "{value}"}}, "condition": "s"}}'


def test_totals_equal_one_batch_after_rule_changes_and_a_retry(spark, tmp_path):
    batches = [
        [(i + 10 * b, "T1059" if i % 3 == 0 else None, "ab"[i % 2], ["curl it", "nothing", "wget"][i % 3]) for i in range(10)] for b in range(4)
    ]
    first = [("r1", "one", ["T1059"], [], None), ("r2", "two", [], ["curl"], block("a")), ("r3", "three", [], ["wget"], None)]
    second = [("r1", "renamed", ["T1059"], [], None), ("r2", "two", [], ["curl"], block("b")), ("r4", "four", [], ["nothing"], block("a"))]
    states = [first, first, second, [*first[:2], second[2]]]
    now = {}
    totals = RunningTotals(f"file://{tmp_path}/totals", lambda: inline_table(spark, now["rules"], RULES))
    for number, (rows, rules) in enumerate(zip(batches, states, strict=True)):
        now["rules"] = rules
        for _ in range(2 if number in (0, 2) else 1):  # some batches are retried
            totals(spark.createDataFrame(rows, EVENTS), number)
        seen = spark.createDataFrame([r for b in batches[: number + 1] for r in b], EVENTS)
        compiled = matching.compile_rules(inline_table(spark, rules, RULES))
        want = {r.rule_id: (r.field_hits, r.broad_hits) for r in matching.layer_counts(seen, compiled).collect()}
        got = {r.rule_id: (r.field_hits, r.broad_hits) for r in totals.totals(spark).collect()}
        assert {k: v for k, v in got.items() if k in {x[0] for x in rules}} == want, number
    changes = totals._table(spark, "rules", "rule_id STRING, digest STRING").filter("batch_id = 2")
    assert {r.rule_id for r in changes.collect()} == {"r2", "r4"}  # a new name changes nothing that is matched


def test_stream_keeps_totals(spark, tmp_path):
    source = tmp_path / "in"
    rules = inline_table(spark, [("r1", "one", ["T1059"], ["curl"], None)], RULES)
    totals = RunningTotals(f"file://{tmp_path}/totals", lambda: rules)
    for part in range(3):
        spark.createDataFrame([(part, "T1059", "a", "x"), (part, None, "a", "curl"), (part, None, "a", "x")], EVENTS).write.mode("append").parquet(str(source))
        events = spark.readStream.schema(EVENTS).parquet(str(source))
        query = totals.start(events, f"totals-{part}", available_now=True, checkpoint=str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        assert query.exception() is None
        assert [tuple(r) for r in totals.totals(spark).collect()] == [("r1", 0, 2 * (part + 1))]

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from watchfloor.functions.text import keyword_tokens
from watchfloor.operators import keywords, layers, matching, rule_index, united, word_sets
from watchfloor.operators.predicates import Fields
from watchfloor.plans.match import Backend, match_corpus, updated_records, validate_corpus
from watchfloor.session import inline_table

RULES = {"rule_id": "STRING", "name": "STRING", "techniques": "ARRAY<STRING>", "keywords": "ARRAY<STRING>",
         "detection": "STRING"}
EVENT_COLUMNS = (
    "event_id INT, timestamp TIMESTAMP, technique STRING, key STRING, exe STRING, proctitle STRING, cmd_output STRING, "
    "message STRING, raw STRING, a2 STRING"
)


def rules_of(spark, *rows):
    return inline_table(spark, [(r[0], r[0], *r[1:], *[None] * (4 - len(r))) for r in rows], RULES)


def events_of(spark, *rows):
    names = [c.split()[0] for c in EVENT_COLUMNS.split(", ")]
    filled = []
    for i, row in enumerate(rows):
        base = dict.fromkeys(names)
        base["event_id"] = i
        base.update(row)
        filled.append(tuple(base[n] for n in names))
    return spark.createDataFrame(filled, EVENT_COLUMNS)


def hits(spark, rules, events, **options):
    out = match_corpus(rules, Backend(events, **options))
    return {r.rule_id: (r.hits, r.status) for r in out.collect()}


def test_parent_expansion_is_on_the_rule_side_only(spark):
    events = events_of(spark, {"technique": "T1059"}, {"technique": "T1059.004"}, {"technique": "t1190"})
    rules = rules_of(spark, ("sub", ["T1059.004"]), ("base", ["T1059"]), ("case", ["T1190"]), ("none", []))
    assert hits(spark, rules, events) == {
        "sub": (2, "pass"), "base": (1, "pass"), "case": (1, "pass"), "none": (0, "skip")
    }


def test_keyword_scope(spark):
    events = events_of(spark, {"exe": "/tmp/exploit"}, {"key": "exploit_key"}, {"message": "An EXPLOIT ran"})
    rules = rules_of(spark, ("kw", [], ["*exploit*"]))
    assert hits(spark, rules, events)["kw"] == (2, "pass")  # substring, key included, exe not
    assert hits(spark, rules, events, kind="indexed")["kw"] == (1, "pass")  # whole word, key left out


def test_event_counts_once_per_rule(spark):
    events = events_of(spark, {"technique": "T1190", "message": "jndi lookup exploit"})
    rules = rules_of(spark, ("both", ["T1190"], ["jndi", "exploit"]))
    assert hits(spark, rules, events)["both"] == (1, "pass")


def test_at_most_three_samples(spark):
    rows = [{"technique": "T1190", "message": f"m{i}"} for i in range(10)]
    out = match_corpus(rules_of(spark, ("r", ["T1190"]), ("s", ["T1"])), Backend(events_of(spark, *rows)), samples=True)
    found = {r.rule_id: r for r in out.collect()}
    assert found["r"].hits == 10 and len(found["r"].samples) == 3
    assert found["r"].samples[0]["technique"] == "T1190"
    assert found["s"].hits == 0 and found["s"].samples is None


def test_layered_fallback_and_condition_errors(spark):
    block = json.dumps({"sel": {"exe|endswith": "/sh"}, "condition": "sel"})
    miss = json.dumps({"sel": {"exe": "nope"}, "condition": "sel"})
    broken = json.dumps({"sel": {"exe": "x"}, "condition": "sel | count() > 5"})
    events = events_of(spark, {"exe": "/bin/sh", "technique": "T1"}, {"technique": "T1"}, {"exe": "/usr/sh"})
    rules = rules_of(spark, ("field", ["T1"], [], block), ("fallback", ["T1"], [], miss), ("broken", ["T1"], [], broken),
                     ("only", [], [], block), ("neither", [], [], miss))
    rows = {r.rule_id: r for r in match_corpus(rules, Backend(events, kind="indexed")).collect()}
    assert {k: (r.hits, r.status) for k, r in rows.items()} == {
        "field": (2, "pass"), "fallback": (2, "pass"), "broken": (2, "pass"), "only": (2, "pass"), "neither": (0, "skip")
    }
    assert rows["field"].query.startswith("sigma-fields")
    assert "aggregation" in rows["broken"].error and rows["fallback"].error is None


def test_search_backend_and_union(spark):
    events = events_of(spark, {"raw": "x t1190 y"}, {"raw": "Payload JNDI here"}, {"raw": "t1190 jndi"})
    rules = rules_of(spark, ("r", ["T1190"], ["jndi ldap rmi-x"]), ("e", [], ["a b"]))
    out = validate_corpus(rules, {"search": Backend(events, kind="search"), "local": Backend(events)})
    rows = out.collect()
    assert {r.query for r in rows if r.siem == "search"} == {"search: T1190 OR jndi OR ldap", "(no terms to search)"}
    got = {(r.siem, r.rule_id): (r.hits, r.status) for r in rows}
    assert got == {("search", "r"): (3, "pass"), ("search", "e"): (0, "skip"),
                   ("local", "r"): (2, "pass"), ("local", "e"): (0, "fail")}


def test_time_window_null_policy(spark):
    events = spark.sql(
        "SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00'), (2, timestamp'2024-01-03 00:00:00'), (3, NULL) "
        "AS t(event_id, timestamp)"
    )
    keep = matching.since(events, "2024-01-02 00:00:00")
    drop = matching.since(events, "2024-01-02 00:00:00", null_ts="drop")
    assert sorted(r.event_id for r in keep.collect()) == [2, 3]
    assert sorted(r.event_id for r in drop.collect()) == [2]
    assert matching.since(events, None).count() == 3


def test_batches_of_rules_give_the_same_counts(spark):
    rng = random.Random(5)
    techniques = [f"T{1000 + i}" for i in range(6)] + [f"T{1000 + i}.00{j}" for i in range(6) for j in (1, 2)]
    words = ["alpha", "bravo", "charlie", "delta", "echoes"]
    events_rows = [
        {"technique": rng.choice([None, *techniques]), "message": " ".join(rng.choices(words, k=2)),
         "key": rng.choice(words)} for _ in range(200)
    ]
    rules_rows = [
        (f"r{i}", rng.sample(techniques, rng.randint(0, 3)), rng.sample(words, rng.randint(0, 2))) for i in range(25)
    ]
    events, rules = events_of(spark, *events_rows), rules_of(spark, *rules_rows)
    expected = {}
    for name, ids, keywords in rules_rows:
        wanted = {t for i in ids for t in (i, i.split(".")[0])}
        expected[name] = sum(
            (e["technique"] in wanted) or any(k in f"{e['message']} {e['key']}" for k in keywords) for e in events_rows
        )
    for size in (4, 1000):
        counts = matching.layer_counts(events, matching.compile_rules(rules, per_batch=size))
        got = {r.rule_id: r.broad_hits for r in counts.collect()}
        assert {k: v for k, v in expected.items() if v} == {k: v for k, v in got.items() if v}


def test_hot_technique_joins_beyond_the_broadcast_bound(spark):
    """A third of all events share one technique; the shuffle join must give the broadcast answer."""
    from watchfloor.session import join_dimension

    events = spark.range(3000).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("K"), (F.col("id") % 50).cast("string"))).alias("k"),
    )
    rules = spark.sql("SELECT 'HOT' AS k, 1 AS rule UNION ALL SELECT 'HOT', 2 UNION ALL SELECT 'K7', 3")
    small = join_dimension(events, rules, "k")
    large = join_dimension(events, rules, "k", max_rows=1)
    order = ["event_id", "rule"]
    assert large.orderBy(*order).collect() == small.orderBy(*order).collect()
    assert large.filter("rule = 1").count() == 1000


def test_no_nested_loop_joins(spark):
    events = events_of(spark, {"technique": "T1190", "message": "jndi"})
    bound = spark.sql("SELECT 1 AS rule_id, 'T1190' AS technique_id")
    compiled = list(matching.compile_rules(rules_of(spark, ("r", ["T1190"], ["jndi"]))))
    for df in (
        matching.technique_hits(events, bound),
        matching.technique_hit_counts(events, bound),
        matching.layer_counts(events, iter(compiled)),
        matching.hit_rows(events, iter(compiled), ["event_id"]),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_status_is_written_back(spark):
    records = spark.sql(
        "SELECT * FROM VALUES ('a', 'untested', CAST(NULL AS TIMESTAMP)), ('b', 'untested', NULL), "
        "('c', 'needs_review', NULL) AS t(id, validation_status, last_validated)"
    )
    results = spark.sql("SELECT * FROM VALUES ('a', 'pass'), ('b', 'fail'), ('c', 'skip') AS t(rule_id, status)")
    out = {r.id: r for r in updated_records(records, results, "2024-01-01 00:00:00").collect()}
    assert [out[k].validation_status for k in "abc"] == ["passed", "failed", "needs_review"]
    assert out["c"].last_validated is None and out["a"].last_validated is not None


@pytest.mark.parametrize("token, text, expected", [
    ("curl", "a curl b", True), ("curl", "curlx", False), ("two-part", "part x two", True), ("curl", "écurlé", True), ("curl", "_curl curl_", False), ("two-part", "two", False),
])
def test_whole_words(one, token, text, expected):
    assert one(matching.has_word(F.col("t"), token), t=text) is expected


def test_tokens_match_the_compiler(spark):
    rules = rules_of(spark, ("r", [], ["*Jndi:ldap*", "abc"]))
    compiled = next(matching.compile_rules(rules))
    assert set(compiled.tokens) == {"jndi", "ldap"}
    assert rules.select(keyword_tokens(F.col("keywords"))).first()[0] == ["jndi", "ldap"]


@pytest.mark.parametrize("whole_words", [False, True])
def test_keyword_joins_agree_with_generated_tests(spark, whole_words):
    rng = random.Random(9)
    syllables = ["ab", "cd", "-", "_", "é", " ", "\n", "ef", "01", "/"]
    texts = ["".join(rng.choices(syllables, k=rng.randint(0, 30))) for _ in range(300)] + [None, "", "ab-cd"]
    tokens = {"".join(rng.choices(["ab", "cd", "ef", "01", "-", "_"], k=rng.randint(2, 3))) for _ in range(40)}
    tokens = sorted(t for t in tokens if len(t) >= 4)
    events = spark.createDataFrame([(i, t, rng.choice(["T1", "T2", None])) for i, t in enumerate(texts)], "event_id INT, message STRING, technique STRING")
    rules = rules_of(spark, *[(f"r{i}", ["T1"] if i % 7 == 0 else [], [t, tokens[i // 2]]) for i, t in enumerate(tokens)])

    def found(limit):
        broad = layers.Broad.of(rules, whole_words, generated=limit)
        assert (broad.few is None) == (limit == 0)
        rows = sorted(tuple(r) for r in broad.hits(events, ["event_id"]).collect())
        assert len(rows) == len(set(rows))
        assert sorted(tuple(r) for r in broad.counts(events).collect()) == sorted(Counter(r[0] for r in rows).items())
        return rows

    compiled = matching.compile_rules(rules)
    old = sorted((r.rule_id, r.event_id) for r in matching.hit_rows(events, compiled, ["event_id"], whole_words).filter("layer = 'broad'").collect())
    assert found(0) == found(10_000) == old and old


def test_keywords_of_any_shape(spark):
    texts = ["", None, "a", "ab abc", "new  object", "new object here", "neW object", "(a+b)* [x] $1", "日本語です", "e\u0301a \U0001F600\U0001F601x", "tab\tstop", "x" * 50_000 + "needle"]
    words = ["a", "ab", "abc", "new object", "object h", "w ob", "a+b)*", "$1", "本語", "\U0001F600\U0001F601", "\tst", "needle", "absent", "", None, "needle"]
    events = spark.createDataFrame(list(enumerate(texts)), "event_id INT, message STRING")
    wanted = spark.createDataFrame([(w,) for w in words], "keyword STRING")
    got = sorted(tuple(r) for r in keywords.keyword_hits(events, wanted, ["event_id"], "message").collect())
    assert got == sorted((w, i) for w in {*words} - {"", None} for i, t in enumerate(texts) if t and w in t)
    assert keywords.keyword_hits(events.limit(0), wanted, ["event_id"], "message").count() == 0
    assert keywords.keyword_hits(events, wanted.limit(0), ["event_id"], "message").count() == 0


def test_keyword_joins_run_no_python(spark):
    events = spark.createDataFrame([(1, "some words here")], "event_id INT, message STRING")
    wanted = spark.range(300).select(F.concat(F.lit("word"), "id").alias("keyword"), F.col("id").cast("string").alias("rule_id"))
    for whole_words in (False, True):
        plan = keywords.rule_hits(events, wanted, ["event_id"], "message", whole_words)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_index_agrees_with_generated_predicates(spark):
    rng = random.Random(4)
    keys = ["exec", "open", "it's", "net", "EXEC", ""]
    conditions = ["s", "s and t", "s or t", "1 of them", "all of s*", "s and t or u", "s and not u", "(s or t) and u", "1 of s* and t", "not s", "gone", "s | count() > 1"]

    def group():
        parts = [
            {"key": rng.choice(keys)}, {"key": rng.sample(keys, 2)}, {"exe|endswith": rng.choice(["sh", "x", ["sh", "n/x"]])},
            {"exe|startswith|all": ["/", "/bin"]}, {"a2": rng.choice(["1", 2, None])}, {"key|contains": "e"}, {"other": "v1"}, {"returncode": rng.choice([1, 2])},
            {"key|cased": "exec"}, {"key|re": "e.*"},
        ]
        picked = rng.sample(parts * 3 if rng.random() < 0.3 else parts[:4] + parts[6:8], rng.randint(1, 2))
        one = {k: v for p in picked for k, v in p.items()}
        return rng.choice([*[one] * 12, *[[one, {"a2": "2"}]] * 5, {}])

    blocks = {f"r{i}": json.dumps({"s": group(), "s2": group(), "t": group(), "u": {"a2": rng.choice("12")}, "condition": rng.choice(conditions)}) for i in range(250)}
    blocks |= {"text": '"nothing"', "junk": "{", "bad": '{"s": {"key|re": "a(b"}, "condition": "s"}'}
    events = spark.createDataFrame(
        [(i, rng.choice([*keys, None]), rng.choice(["/bin/sh", "x", None, "sh"]), rng.choice(["1", "2", None]), rng.choice([1, 2, None]), {"other": rng.choice(["v1", "v2"])}) for i in range(200)],
        "event_id INT, key STRING, exe STRING, a2 STRING, returncode INT, attrs MAP<STRING, STRING>",
    )
    rules = rules_of(spark, *[(k, [], [], b) for k, b in blocks.items()])
    fields = Fields.of(events.schema)
    for fold in (False, True):
        compiled = list(matching.compile_rules(rules, fields, fold))
        conditions_ = layers.Conditions(rules, fields, fold, per_batch=50)
        errors = {b.rule_ids[n] for b in compiled for n in b.errors}
        assert errors == {r.rule_id for r in conditions_.errors.collect()} > {"text", "junk", "bad"}
        assert conditions_.index.keys.select("rule_id").distinct().count() > 50
        want = sorted((r.rule_id, r.event_id) for r in matching.hit_rows(events, iter(compiled), ["event_id"]).filter("layer = 'field'").collect())
        assert sorted(tuple(r) for r in conditions_.hits(events, ["event_id"]).collect()) == want
        assert sorted(tuple(r) for r in conditions_.counts(events).collect()) == sorted(Counter(w[0] for w in want).items())


def test_negating_rules_are_counted_by_the_index(spark):
    rng = random.Random(5)
    conditions = ["s and not f", "not f and s", "s and NOT 1 of f*", "s and not all of f*", "t or s and not f and not g", "1 of s* and not all of them", "s and not s"]

    def group():
        one = rng.choice([{"key": rng.choice("abc")}, {"key": ["a", "b"]}, {"a2|endswith": rng.choice(["1", "11"])}, {"a2|startswith": "2", "key": "c"}])
        return [one, {"exe": "x"}] if rng.random() < 0.3 else one

    blocks = [
        json.dumps({**{n: group() for n in ("s", "s2", "t", "f", "f2", "g")}, "condition": conditions[i % len(conditions)]}) for i in range(70)
    ]
    rules = rules_of(spark, *[(f"r{i}", [], [], b) for i, b in enumerate([*blocks, *blocks[:9]])], ("r0", [], [], blocks[0])).coalesce(1)
    events = events_of(spark, *[
        {"key": rng.choice(["a", "b", "c", None]), "exe": rng.choice(["x", None]), "a2": rng.choice(["1", "11", "21", "211", None])} for _ in range(150)
    ])
    conditions_ = layers.Conditions(rules, Fields.of(events.schema))
    assert conditions_.found.filter("predicate IS NOT NULL OR error IS NOT NULL").isEmpty()
    want = sorted((r.rule_id, r.event_id) for r in matching.hit_rows(events, matching.compile_rules(rules), ["event_id"]).collect())
    assert len({w[0] for w in want}) > 40 and len(want) > len(set(want))  # r0 comes twice, and counts twice
    assert sorted(tuple(r) for r in conditions_.hits(events, ["event_id"]).collect()) == want
    assert sorted(tuple(r) for r in conditions_.counts(events).collect()) == sorted(Counter(w[0] for w in want).items())


def test_selections_that_negate_bar_a_clause():
    def slots(**entries):
        return [[{"field": k, "how": "", "value": v}] for k, v in entries.items()]

    block = {"s": {"a": "1"}, "f": [{"b": "2", "c": "3"}, {"d": "4"}], "g": {"e|contains": "5"}}
    barred = [slots(b="2", c="3"), slots(d="4")]
    assert rule_index.rule_clauses(block | {"condition": "s and not f"}) == [{"slots": slots(a="1"), "barred": barred}]
    assert rule_index.rule_clauses(block | {"condition": "s or f"}) == [{"slots": x, "barred": []} for x in (slots(a="1"), *barred)]
    for condition in ("not f", "s or not f", "s and not g", "s and not (f)", "s and not not f"):
        assert rule_index.rule_clauses(block | {"condition": condition}) is None


def test_rules_of_one_file_are_translated_by_all_tasks(spark):
    rules = spark.range(100, numPartitions=1).select(F.col("id").alias("rule_id"), F.lit('{"s": {"key": "a"}, "condition": "s"}').alias("detection"))
    found = rule_index.compiled(rules, Fields.of(rules.withColumn("key", F.lit("")).schema))
    assert found.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism > 1


def test_ten_thousand_rules_take_one_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rules = spark.range(10_000).select(
        F.concat(F.lit("r"), "id").alias("rule_id"),
        F.format_string('{"s": {"event_type": "click", "user_id": "%d"}, "condition": "s"}', "id").alias("detection"),
    )
    index = layers.Conditions(rules, Fields.of(events.schema)).index
    plan = index.signatures(events).groupBy("_keys").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Python" not in plan and "NestedLoop" not in plan
    got = {r.rule_id: r.field_hits for r in index.counts(events).collect()}
    want = {f"r{r.user_id}": r["count"] for r in events.filter("event_type = 'click' AND user_id < 10000").groupBy("user_id").count().collect()}
    assert got == want and want


def test_dispatch_does_not_change_the_answer(spark):
    rng = random.Random(4)
    keys = ["exec", "open", "it's", "net"]
    conditions = ["s", "s and not f", "s and t", "not f and s", "s or t", "1 of s*", "(s and t)", "not f"]
    blocks = []
    for _ in range(60):
        exact = rng.choice([{"key": rng.choice(keys)}, {"key": rng.sample(keys, 2)}, {"key|contains": "e"}, {}])
        s = {**exact, "exe|endswith": rng.choice(["sh", "x"])}
        t = rng.choice([{"key": rng.choice(keys)}, {"a2": "1"}])
        blocks.append(json.dumps({"s": s, "t": t, "f": {"key": rng.choice(keys)}, "condition": rng.choice(conditions)}))
    events = events_of(spark, *[
        {"key": rng.choice([*keys, None]), "exe": rng.choice(["/bin/sh", "x", None]), "a2": rng.choice("12")}
        for _ in range(150)
    ])
    rules = rules_of(spark, *[(f"r{i}", [], [], b) for i, b in enumerate(blocks)])

    def counts(dispatch):
        compiled = list(matching.compile_rules(rules, dispatch=dispatch))
        assert bool(compiled[0].required) == bool(dispatch)
        return sorted(matching.layer_counts(events, iter(compiled)).collect())

    assert counts("key") == counts(None) and len(counts(None)) > 20


def test_bad_rules_keep_their_reason_and_spoil_no_other(spark):
    events = spark.createDataFrame(
        [("2024-01-01 00:00:00", "T1059", "run me", 1, {"Image": "a.exe"}), ("2024-01-01 00:00:01", None, "idle", 2, {})],
        "timestamp STRING, technique STRING, message STRING, returncode INT, attrs MAP<STRING, STRING>",
    ).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    blocks = {
        "good": '{"s": {"Image|endswith": ".exe"}, "condition": "s"}',
        "number": '{"s": {"returncode": 1}, "condition": "s"}',
        "mixed": '{"s": {"returncode": ["2", "none"]}, "condition": "s"}',
        "pattern": '{"s": {"message|re": "a(b"}, "condition": "s"}',
        "text": "not json",
        "list": "[1, 2]",
    }
    rules = spark.createDataFrame(
        [(k, k, ["T1059"], [], v) for k, v in blocks.items()],
        "rule_id STRING, name STRING, techniques ARRAY<STRING>, keywords ARRAY<STRING>, detection STRING",
    )
    got = {r.rule_id: r for r in match_corpus(rules, Backend(events, "indexed"), samples=True).collect()}
    assert {k: r.hits for k, r in got.items()} == dict.fromkeys(blocks, 1)
    assert [k for k, r in got.items() if r.error] == [k for k in got if k in ("pattern", "text", "list")]
    assert got["number"].query.startswith("sigma-fields") and got["mixed"].samples[0]["message"] == "idle"
    assert got["good"].samples[0]["Image"] == "a.exe"


def test_a_failing_backend_answers_with_errors(spark):
    rules = spark.createDataFrame([("r", "r", ["T1059"], [])], "rule_id STRING, name STRING, techniques ARRAY<STRING>, keywords ARRAY<STRING>")
    rules = rules.withColumn("detection", F.lit(None).cast("string"))
    events = spark.createDataFrame([("T1059", "x")], "technique STRING, message STRING").withColumn("timestamp", F.current_timestamp())
    backends = {"gone": lambda: Backend(spark.read.parquet("/nowhere/at/all")), "here": Backend(events)}
    got = {r.siem: (r.status, r.hits, r.error) for r in validate_corpus(rules, backends).collect()}
    assert got["here"][:2] == ("pass", 1) and got["gone"][:2] == ("error", 0) and "PATH_NOT_FOUND" in got["gone"][2]


def test_a_backend_that_fails_while_it_runs_spoils_no_other(spark):
    good = events_of(spark, {"technique": "T1059", "message": "run me"})
    broken = good.withColumn("technique", F.when(F.col("event_id") < 0, "T1").otherwise(F.raise_error(F.lit("unreadable block")).cast("string")))
    rules = rules_of(spark, ("r1", ["T1059"], ["run"]))
    out = {r.siem: r for r in validate_corpus(rules, {"broken": Backend(broken), "good": Backend(good)}).collect()}
    assert out["good"].status == "pass" and out["good"].hits == 1
    assert out["broken"].status == "error" and out["broken"].hits == 0 and out["broken"].error


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize(("pairs", "visits", "dense"), [(10**6, 10**6, 64), (9, 3, 64), (9, 3, 2)])
def test_counts_of_rules_equal_their_hits(spark, monkeypatch, whole, pairs, visits, dense):
    """Rules and the rows that they hit are counted without being listed."""
    for name, value in {"PAIRS": pairs, "VISITS": visits, "DENSE": dense}.items():
        monkeypatch.setattr(united, name, value)
    texts = [(f"alpha{k % 3} beta gam_{k % 5}ma delta-{k % 4} x" if k % 9 else None,) for k in range(40)] + [("beta",), ("beta",), ("",)]
    terms = ["alpha1", "alpha", "beta", "gam_2ma", "delta-3", "delta", "none", "", None, "ta-1"]
    filed = [(f"r{k}" if k else None, terms[(k * j) % len(terms)]) for k in range(12) for j in range(1, 4)]
    texts, filed = spark.createDataFrame(texts, "text string"), spark.createDataFrame(filed, "rule_id string, keyword string")
    want = Counter(r.rule_id for r in keywords.rule_hits(texts, filed, [], whole_words=whole).collect())
    assert want and {r.rule_id: r.hits for r in keywords.rule_counts(texts, filed, whole_words=whole).collect()} == want


@pytest.mark.parametrize(("words_held", "links", "hits", "pairs"), [(4 * 10**6, 5 * 10**5, 2 * 10**6, 4 * 10**6), (7, 2, 3, 5)])
def test_texts_meet_words_where_they_are_read(spark, monkeypatch, words_held, links, hits, pairs):
    """Words of texts and what was found in them are not shuffled to be counted by rule, whatever is held at once."""
    for name, value in {"WORDS": words_held, "LINKS": links, "HITS": hits}.items():
        monkeypatch.setattr(word_sets, name, value)
    monkeypatch.setattr(united, "PAIRS", pairs)
    texts = [(f"w{k % 7} w{k % 5} foo_bar-w{k % 3} long tail",) for k in range(50)] + [(None,), ("",), ("tail",), ("tail",)]
    filed = [(k % 9, w) for k, w in enumerate(["w1-w2", "w3", "w1-w2-tail-w0", "tail", "foo_bar", "foo", "none-w1", "--", "W4"] * 5)] + [(None, "w6"), (1, None), (77, "none")]
    texts, filed = spark.createDataFrame(texts, "text string").repartition(3), spark.createDataFrame(filed, "rule_id int, keyword string")
    want = Counter(r.rule_id for r in keywords.rule_hits(texts, filed, [], whole_words=True).collect())

    def joined(*_):
        raise AssertionError("texts are joined")

    monkeypatch.setattr(keywords, "join_dimension", joined)
    assert {r.rule_id: r.hits for r in keywords.rule_counts(texts, filed, whole_words=True).collect()} == want
    assert len(want) > 5 and 77 not in want


@pytest.mark.parametrize(("words_held", "few"), [(10**6, 10**6), (9, 3)])
def test_words_that_contain_keywords_are_found_where_texts_are_read(spark, monkeypatch, words_held, few):
    """Neither a vocabulary nor its runs are shuffled; keywords of any length, with blanks and of several bytes a character."""
    for name, value in {"WORDS": words_held, "LINKS": few, "HITS": few, "SLICE": few}.items():
        monkeypatch.setattr(word_sets, name, value)
    monkeypatch.setattr(united, "PAIRS", words_held)
    texts = [(f"int\u00e9rnationalisation{k % 3} banana\u20ac{k % 4} run  me\tnow{k % 2}", ) for k in range(30)] + [(None,), ("",), ("  ",), ("anana",), ("anana",)]
    terms = ["a", "an", "ana", "anana\u20ac1", "nationalisation2", "\u00e9rnational", "\u20ac", "run  me", "run me", "me\tnow1", " ", "", None, "anan", "bananas", "t\u00e9", " run", "nationalisations", "9"]
    filed = [(f"r{k % 14}" if k % 14 else None, terms[(k * j) % len(terms)]) for k in range(40) for j in (1, 2)]
    texts, filed = spark.createDataFrame(texts, "text string").repartition(3), spark.createDataFrame(filed, "rule_id string, keyword string")
    want = Counter(r.rule_id for r in keywords.rule_hits(texts, filed, []).collect())

    def joined(*_):
        raise AssertionError("words are joined or kept")

    monkeypatch.setattr(keywords, "join_dimension", joined)
    monkeypatch.setattr(keywords, "cut_lineage", joined)
    assert len(want) > 5 and {r.rule_id: r.hits for r in keywords.rule_counts(texts, filed).collect()} == want

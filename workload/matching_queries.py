"""Rules x telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchfloor.functions.ids import parent_technique
from watchfloor.operators import coverage, matching, quality
from watchfloor.operators.layers import free_text_hits
from watchfloor.operators.predicates import Fields
from watchfloor.plans.match import Backend, match_corpus, validate_corpus
from watchfloor.session import inline_table, tune
from watchfloor.sources.telemetry import with_position
from watchfloor.streaming.jobs import revalidate_changed
from workload.registry import query

FIELDS = Fields(["key", "host_no", "value"], attrs=None)
LAYER_ONE = {
    1: '{"sel": {"key": "error", "value|gt": 300}, "condition": "sel"}',
    2: '{"sel": {"key": "signup", "value|lt": 0}, "condition": "sel"}',
    3: '{"sel": {"key": "purchase", "host_no": 0}, "condition": "sel"}',
}


@query("technique_match", "SELECT DISTINCT rule_id, event_id FROM technique_hit")
def technique_match(v):
    return matching.technique_hits(v.telemetry, v.rule_technique)


def status(v):
    bound = v.rule_technique.select("rule_id").distinct().withColumn("bound", F.lit(True))
    rules = v.rule.join(bound, "rule_id", "left")
    counts = matching.technique_hit_counts(v.telemetry, v.rule_technique)
    return matching.rule_status(rules, counts, F.col("bound").isNotNull())


@query("rule_status", "SELECT rule_id, name, hits, status FROM status")
def rule_status(v):
    return status(v).select("rule_id", "name", "hits", "status")


@query(
    "layered_match",
    """SELECT r.rule_id,
              CASE WHEN coalesce(f.n, 0) > 0 THEN 'field' WHEN b.rule_id IS NULL THEN 'none' ELSE 'broad' END AS layer,
              CASE WHEN coalesce(f.n, 0) > 0 THEN f.n ELSE coalesce(h.n, 0) END AS hits
       FROM rule r
       LEFT JOIN (
         SELECT 1 AS rule_id, count(*) AS n FROM telemetry WHERE "key" = 'error' AND value > 300
         UNION ALL SELECT 2, count(*) FROM telemetry WHERE "key" = 'signup' AND value < 0
         UNION ALL SELECT 3, count(*) FROM telemetry WHERE "key" = 'purchase' AND host_no = 0) f
         ON r.rule_id = f.rule_id
       LEFT JOIN (SELECT rule_id, count(*) AS n FROM technique_hit GROUP BY rule_id) h ON r.rule_id = h.rule_id
       LEFT JOIN (SELECT DISTINCT rule_id FROM rule_technique) b ON r.rule_id = b.rule_id""",
)
def layered_match(v):
    blocks = inline_table(v.spark, list(LAYER_ONE.items()), {"rule_id": "INT", "detection": "STRING"})
    bound = v.rule_technique.groupBy("rule_id").agg(F.array_sort(F.collect_list("technique_id")).alias("techniques"))
    rules = v.rule.join(bound, "rule_id", "left").join(blocks, "rule_id", "left").withColumn(
        "keywords", F.array().cast("array<string>")
    )
    counts = matching.layer_counts(v.telemetry, matching.compile_rules(rules, FIELDS))
    per_rule = rules.join(counts.withColumn("rule_id", F.col("rule_id").cast("int")), "rule_id", "left")
    chosen = matching.layered_hits(per_rule)
    nothing = F.col("techniques").isNull() & F.col("detection").isNull()
    return chosen.select("rule_id", F.when(nothing, "none").otherwise(F.col("layer")).alias("layer"), "hits")


@query(
    "sample_events_topk",
    """SELECT rule_id, rn, event_id FROM (
         SELECT rule_id, event_id, CAST(row_number() OVER (PARTITION BY rule_id ORDER BY ts DESC, event_id DESC)
                AS INTEGER) AS rn
         FROM (SELECT DISTINCT rule_id, event_id, ts FROM technique_hit) h) s WHERE rn <= 3""",
)
def sample_events_topk(v):
    hits = matching.technique_hits(v.telemetry, v.rule_technique, keep=("event_id", "ts"))
    return matching.latest_samples(hits, time="ts").select("rule_id", "rn", "event_id")


@query(
    "sample_events_in_file_order",
    """SELECT rule_id, rn, event_id FROM (
         SELECT rule_id, event_id, CAST(row_number() OVER (PARTITION BY rule_id ORDER BY event_id) AS INTEGER) AS rn
         FROM technique_hit) s WHERE rn <= 3""",
)
def sample_events_in_file_order(v):
    """The table stands in the order of its ids; the samples follow the file, not the ids, and rows are dealt anew first."""
    placed = with_position(v.table("events")).select("event_id", "position")
    events = v.telemetry.join(placed, "event_id").repartition(16, F.xxhash64("event_id"))
    hits = matching.technique_hits(events, v.rule_technique, keep=("event_id", "position"))
    return matching.first_samples(hits).select("rule_id", "rn", "event_id")


@query(
    "multi_backend_union",
    """SELECT 'indexed' AS siem, rule_id, count(*) AS hits FROM technique_hit GROUP BY rule_id
       UNION ALL
       SELECT 'search' AS siem, b.rule_id, count(DISTINCT t.event_id) AS hits
       FROM telemetry t JOIN rule_technique b
       ON contains(lower(coalesce(t.technique || ' ', '') || t.message), lower(b.technique_id)) GROUP BY b.rule_id""",
)
def multi_backend_union(v):
    indexed = matching.technique_hit_counts(v.telemetry, v.rule_technique)
    terms = v.rule_technique.withColumnRenamed("technique_id", "term")
    search = free_text_hits(v.telemetry, terms, F.concat_ws(" ", "technique", "message"))
    return indexed.select(F.lit("indexed").alias("siem"), "rule_id", "hits").unionByName(
        search.select(F.lit("search").alias("siem"), "rule_id", "hits")
    )


@query(
    "result_summary",
    """SELECT s.total, s.passed, s.failed, s.skipped,
              CAST(floor(100.0 * s.passed / s.total) AS INTEGER) AS pass_pct, t.covered, t.techniques
       FROM (SELECT count(*) AS total, count(CASE WHEN status = 'pass' THEN 1 END) AS passed,
                    count(CASE WHEN status = 'fail' THEN 1 END) AS failed,
                    count(CASE WHEN status = 'skip' THEN 1 END) AS skipped FROM status) s,
            (SELECT count(DISTINCT CASE WHEN s.status = 'pass' THEN b.technique_id END) AS covered,
                    count(DISTINCT b.technique_id) AS techniques
             FROM rule_technique b JOIN status s ON b.rule_id = s.rule_id) t""",
)
def result_summary(v):
    results = status(v)
    techniques = coverage.technique_totals(results, v.rule_technique)
    return coverage.result_totals(results).select(
        "total", "passed", "failed", "skipped", "pass_pct",
        techniques.select("covered").scalar().alias("covered"),
        techniques.select("techniques").scalar().alias("techniques"),
    )


@query(
    "findings",
    """SELECT s.rule_id, 'warning' AS level,
              'Detection rule did not fire against live telemetry. Techniques: ' ||
              coalesce(b.techniques, '(none)') || '. Query: ' || s.name || '.' AS message
       FROM status s LEFT JOIN (SELECT rule_id, string_agg(technique_id, ', ' ORDER BY technique_id) AS techniques
                                FROM rule_technique GROUP BY rule_id) b ON s.rule_id = b.rule_id
       WHERE s.status = 'fail'""",
)
def findings(v):
    bound = v.rule_technique.groupBy("rule_id").agg(F.array_sort(F.collect_list("technique_id")).alias("techniques"))
    results = status(v).join(bound, "rule_id", "left").withColumns(
        {"query": F.col("name"), "error": F.lit(None).cast("string")}
    )
    return quality.findings(results)


@query(
    "labelled_rule_score",
    """SELECT r.rule_id, coalesce(h.matched, 0) AS matched, coalesce(h.tp, 0) AS tp, coalesce(h.fp, 0) AS fp,
              p.positives - coalesce(h.tp, 0) AS fn
       FROM rule r
       LEFT JOIN (SELECT rule_id, count(*) AS matched, count(CASE WHEN value > 100 THEN 1 END) AS tp,
                         count(CASE WHEN NOT value > 100 THEN 1 END) AS fp FROM technique_hit GROUP BY rule_id) h
         ON r.rule_id = h.rule_id,
       (SELECT count(CASE WHEN value > 100 THEN 1 END) AS positives FROM telemetry) p""",
)
def labelled_rule_score(v):
    labelled = v.telemetry.withColumn("label", F.col("value") > 100)
    hits = matching.technique_hits(labelled, v.rule_technique, keep=("event_id", "label"))
    positives = labelled.agg(F.count_if("label"))
    return matching.labelled_scores(hits, positives, v.rule)


@query(
    "rule_parents",
    "SELECT DISTINCT split_part(technique, '.', 1) AS parent, count(*) AS n FROM telemetry WHERE technique IS NOT NULL "
    "GROUP BY 1",
)
def rule_parents(v):
    events = v.telemetry.filter(F.col("technique").isNotNull())
    return events.groupBy(parent_technique(F.col("technique")).alias("parent")).agg(F.count(F.lit(1)).alias("n"))


# One rule whose pattern no engine can compile, and one whose detection is no block.
BAD_BLOCKS = {4: '{"sel": {"message|re": "a(b"}, "condition": "sel"}', 5: "not a block"}


def blocks_of(v, blocks):
    """Rules with techniques, no keywords and the given detection blocks."""
    bound = v.rule_technique.groupBy("rule_id").agg(F.array_sort(F.collect_list("technique_id")).alias("techniques"))
    detections = inline_table(v.spark, list(blocks.items()), {"rule_id": "INT", "detection": "STRING"})
    keywords = F.array().cast("array<string>")
    return v.rule.join(bound, "rule_id", "left").join(detections, "rule_id", "left").withColumn("keywords", keywords)


@query(
    "match_with_bad_rules",
    """SELECT r.rule_id,
              CASE WHEN coalesce(f.n, 0) > 0 THEN f.n ELSE coalesce(h.n, 0) END AS hits,
              r.rule_id IN (4, 5) OR (b.rule_id IS NULL AND coalesce(f.n, 0) = 0) AS has_error
       FROM rule r
       LEFT JOIN (
         SELECT 1 AS rule_id, count(*) AS n FROM telemetry WHERE "key" = 'error' AND value > 300
         UNION ALL SELECT 2, count(*) FROM telemetry WHERE "key" = 'signup' AND value < 0
         UNION ALL SELECT 3, count(*) FROM telemetry WHERE "key" = 'purchase' AND host_no = 0) f
         ON r.rule_id = f.rule_id
       LEFT JOIN (SELECT rule_id, count(*) AS n FROM technique_hit GROUP BY rule_id) h ON r.rule_id = h.rule_id
       LEFT JOIN (SELECT DISTINCT rule_id FROM rule_technique) b ON r.rule_id = b.rule_id""",
)
def match_with_bad_rules(v):
    tune(v.spark)
    results = match_corpus(blocks_of(v, LAYER_ONE | BAD_BLOCKS), Backend(v.telemetry, "indexed", time="ts"))
    return results.select("rule_id", "hits", F.col("error").isNotNull().alias("has_error"))


@query(
    "backend_error_rows",
    """SELECT 'lake' AS siem, rule_id, hits, status FROM status
       UNION ALL SELECT 'gone', rule_id, 0, 'error' FROM rule""",
)
def backend_error_rows(v):
    """Two backends, one of which cannot be opened."""
    tune(v.spark)
    backends = {
        "gone": lambda: Backend(v.table("no_such_table"), time="ts"),
        "lake": Backend(v.telemetry, time="ts"),
    }
    rules = blocks_of(v, {0: None}).withColumn("detection", F.lit(None).cast("string"))
    return validate_corpus(rules, backends).select("siem", "rule_id", "hits", "status")


@query(
    "changed_rules_revalidated",
    "SELECT rule_id, hits, status FROM status WHERE rule_id % 2 = 0",
)
def changed_rules_revalidated(v):
    """Every second rule has changed since the last snapshot: only those meet the stored telemetry again."""
    tune(v.spark)
    rules = blocks_of(v, {0: None}).withColumn("detection", F.lit(None).cast("string"))
    before = rules.withColumn("name", F.when(F.col("rule_id") % 2 == 0, "older").otherwise(F.col("name")))
    backend = Backend(v.telemetry, time="ts")
    _, seen = revalidate_changed(before, None, backend)
    results, _ = revalidate_changed(rules, seen, backend)
    return results.select("rule_id", "hits", "status")

import json

import pytest
from pyspark.sql import functions as F

from watchfloor.operators import coverage, enrich, export, mapping, quality
from watchfloor.operators.mapping import KeywordHint, SourceHint
from watchfloor.plans.report import coverage_tables, cve_coverage, enrich_corpus, map_corpus
from watchfloor.schemas import DETECTION

KB = """
    SELECT * FROM VALUES
      ('s1', 'T1059', 'Interpreter', 'execution', NULL, false), ('s2', 'T1059.001', 'PowerShell', 'execution', 'T1059', false),
      ('s3', 'T9999', 'Old', 'impact', NULL, true), ('s4', 'T1105', 'Transfer', 'command-and-control', NULL, false),
      ('s5', 'T1140', 'Decode', 'defense-evasion', NULL, false), ('s6', 'T1218.005', 'Mshta', 'defense-evasion', 'T1218', false)
    AS t(stix_id, technique_id, name, tactic, parent_id, deprecated)
"""


def record(id, techniques=(), raw="", severity="med", tags=(), cves=(), sources=(), status="untested", maturity=0, **more):
    return {
        "id": id, "name": f"rule {id}", "description": "", "author": ["x"], "version": "1", "severity": severity,
        "source_format": "sigma", "platforms": [], "tags": list(tags),
        "detection_logic": {"raw": raw, "language": "sigma", "normalized_conditions": [], "field_references": []},
        "log_sources": [{"category": s} for s in sources],
        "mitre_techniques": [
            {"technique_id": t.split(".")[0], "sub_technique_id": t if "." in t else None, "tactic": tactic,
             "confidence": c} for t, tactic, c in techniques
        ],
        "cve_references": [{"cve_id": c, "confidence": 0.9, "cvss_score": s} for c, s in cves],
        "data_components": [], "false_positive_notes": [], "cim_models": [], "validation_status": status,
        "detection_maturity_score": maturity, "portability_score": 0.0, "siem_native": {}, "deployment_history": [],
        **more,
    }


def corpus(spark, *rows):
    text = spark.createDataFrame([(json.dumps(r),) for r in rows], "j STRING")
    return text.select(F.from_json("j", DETECTION).alias("r")).select("r.*")


@pytest.fixture(scope="module")
def kb(spark):
    return spark.sql(KB)


def bound(records):
    return {r.id: [(t.sub_technique_id or t.technique_id, t.tactic, t.confidence) for t in r.mitre_techniques]
            for r in records.collect()}


def test_explicit_mapping_reports_and_fills(spark, kb):
    records = corpus(
        spark,
        record("a", [("T1059", "unknown", 0.8), ("T9999", "impact", 0.9), ("T4242", "x", 0.9)]),
        record("b", [("T1218.005", "defense-evasion", 0.3)]),
        record("c"),
    )
    edges = spark.sql("SELECT 's3' AS source, 's1' AS target")
    out = map_corpus(records, kb, edges, mode="explicit")
    assert bound(out.records) == {
        "a": [("T1059", "execution", 0.8), ("T9999", "impact", 0.9)],
        "b": [("T1218.005", "defense-evasion", 0.3)],  # nothing reaches the threshold: left as it was
        "c": [],
    }
    said = {(r.detection_id, r.error, *r.warnings) for r in out.messages.collect()}
    assert ("a", "T4242 not found in the knowledge base") in said
    assert ("a", None, "T9999 is deprecated/revoked; suggested replacement: T1059") in said
    assert ("a", None, "Filled missing tactic for T1059: execution") in said
    assert ("b", None, "Parent technique T1218 not found for T1218.005") in said


def test_hybrid_mapping_only_fills_gaps(spark, kb):
    records = corpus(
        spark,
        record("a", [("T1059.001", "execution", 0.6)], raw="powershell -enc AA; certutil -decode x"),
        record("b", raw="mshta http", sources=["process_creation"]),
        record("c", raw="nothing"),
    )
    out = bound(map_corpus(records, kb).records)
    assert out["a"] == [("T1059.001", "execution", 0.6), ("T1140", "defense-evasion", 0.9)]
    assert out["b"] == [("T1218.005", "defense-evasion", 0.85)] and out["c"] == []


def test_inference_ranking(spark):
    docs = spark.sql("SELECT 1 AS id, 'alpha beta gamma1' AS text, array('proc') AS sources")
    words = [KeywordHint("alpha", ("T1",), 0.5), KeywordHint("beta", ("T1",), 0.7), KeywordHint("gamma[0-9]", ("T2",), 0.6, True)]
    hints = [SourceHint(("proc",), ("beta",), ("T1", "T3"), 0.7), SourceHint(("PROC",), ("zzz", "ALPHA"), ("T2",), 0.65),
             SourceHint(("other",), ("beta",), ("T4",), 0.9)]
    out = mapping.infer(docs, ["id"], F.col("text"), words, hints, F.col("sources")).collect()
    assert {(r.technique_id, r.confidence, r.source) for r in out} == {
        ("T1", 0.7, "keyword"),  # a data source replaces only when strictly better
        ("T2", 0.65, "datasource"), ("T3", 0.7, "datasource"),
    }


def test_candidates_are_filtered(spark, kb):
    rows = spark.sql(
        "SELECT * FROM VALUES ('r', 0, 't1059', 0.9D), ('r', 1, 'T9999', 0.9D), ('r', 2, 'T1105', 0.2D), ('r', 3, 'junk', 0.9D), "
        "('r', 4, 'T1140', 0.3D), ('r', 5, 'T1059.001', 0.9D) AS t(detection_id, pos, technique_id, confidence)"
    )
    first = {r.technique_id for r in mapping.usable_candidates(rows, kb, "detection_id", most=5).collect()}
    every = {(r.technique_id, r.source) for r in mapping.usable_candidates(rows, kb, "detection_id").collect()}
    assert first == {"T1059", "T1140"} and every == {(t, "candidate") for t in ("T1059", "T1140", "T1059.001")}


def test_enrichment(spark, kb):
    records = corpus(
        spark,
        record("a", [("T1059.001", "unknown", 0.8), ("T4242", "x", 0.8)], tags=["cve.2021.44228", "other"]),
        record("b", severity="high", cves=[("CVE-2021-44228", 10.0)]),
        record("c", cves=[("CVE-2000-0001", None)]),
    )
    cves = spark.sql(f"SELECT 'CVE-2021-44228' AS cve_id, 9.8D AS cvss_score, '{'d' * 400}' AS description "
                     "UNION ALL SELECT 'CVE-2000-0001', 5.0D, ''")
    out, counts = enrich_corpus(records, kb, cves)
    rows = {r.id: r for r in out.collect()}
    first = rows["a"].mitre_techniques[0]
    assert (first.name, first.tactic, first.url.endswith("/T1059/001/")) == ("PowerShell", "execution", True)
    assert [t.technique_id for t in rows["a"].mitre_techniques] == ["T1059", "T4242"]
    assert [c.cve_id for c in rows["a"].cve_references] == ["CVE-2021-44228"]
    assert len(rows["a"].cve_references[0].description) == 400
    assert [rows[k].severity for k in "abc"] == ["critical", "high", "med"]
    assert rows["b"].cve_references[0].cvss_score == 10.0 and rows["c"].cve_references[0].cvss_score == 5.0
    assert counts.first().asDict() == {"techniques_enriched": 1, "warnings": 1, "references_added": 1,
                                       "references_enriched": 3, "severities_updated": 1}


def test_added_references_are_told_from_own(spark):
    own = spark.sql("SELECT 'a' AS d, 'C1' AS c, 1.0D AS score")
    tags = spark.sql("SELECT 'a' AS d, explode(array('C1', 'C2')) AS c")
    out = {r.c: (r.score, r.added) for r in enrich.add_references(own, tags, ["d", "c"]).collect()}
    assert out == {"C1": (1.0, False), "C2": (None, True)}


def test_coverage_tables(spark, kb):
    records = corpus(
        spark,
        record("a", [("T1059", "execution", 0.9), ("T1105", "command-and-control", 0.5)], status="passed", maturity=4),
        record("b", [("T1059", "execution", 0.7)], status="failed", maturity=2),
    )
    out = {name: df.collect() for name, df in coverage_tables(records, kb).items()}
    assert {(r.tactic, r.technique_id, r.name) for r in out["matrix"]} == {
        ("execution", "T1059", "rule a"), ("execution", "T1059", "rule b"), ("command-and-control", "T1105", "rule a")
    }
    layer = {r.technique_id: r for r in out["layer"]}
    assert (layer["T1059"].score, layer["T1059"].comment) == (90, "2 detections: rule a, rule b")
    assert layer["T1105"].comment == "1 detection: rule a"
    entry = {r.technique_id: r for r in out["entries"]}["T1059"]
    assert (entry.n_rules, entry.validated_count, entry.coverage_score, entry.maturity_avg) == (2, 1, 0.5, 3.0)
    score = out["score"][0]
    assert (score.total, score.covered, score.validated, score.score_pct, score.grade) == (5, 2, 2, 40, "D")
    assert {r.technique_id for r in out["gaps"]} == {"T1059.001", "T1140", "T1218.005"}
    badge = out["badge"][0]
    assert (badge.pct, badge.color, badge.rules_total, badge.rules_passed) == (100, "brightgreen", 2, 1)


def test_layer_comment_counts_the_rest(spark):
    pairs = spark.range(7).select(F.lit("T1").alias("t"), F.concat(F.lit("r"), "id").alias("name"),
                                  F.lit(0.5).alias("confidence"))
    row = coverage.layer_rows(coverage.rules_per_technique(pairs, ["t"], "name", 5).withColumnRenamed("t", "technique_id"))
    assert row.first().comment == "7 detections: r0, r1, r2, r3, r4 (+2 more)"


def test_cve_report(spark):
    records = corpus(spark, record("a", [("T1059.004", "execution", 0.9)]))
    cves = spark.sql(
        "SELECT * FROM VALUES ('CVE-1', array('CWE-78'), array('T1190', 'bad'), 10.0D, 0.5D, true), "
        "('CVE-2', array('CWE-78'), NULL, 8.0D, 0.5D, NULL), ('CVE-3', array(), NULL, NULL, 0.9D, NULL) "
        "AS t(cve_id, cwes, techniques, cvss_score, epss, in_kev)"
    )
    ranked, flagged = cve_coverage(records, cves)
    rows = [(r.cve_id, r.techniques, r.covered, r.residual_risk, r.in_kev) for r in ranked.collect()]
    assert rows == [("CVE-1", 3, 2, 1.6667, True), ("CVE-2", 2, 2, 0.0, False), ("CVE-3", 0, 0, 0.0, False)]
    assert flagged.filter(~F.col("covered")).select("technique_id").collect()[0][0] == "T1190"
    assert cve_coverage(records, cves, min_risk=1.0)[0].count() == 1


def test_record_checks(spark):
    good = record("a", [("T1059", "x", 0.5)])
    bad = [
        record("b", severity="huge"), record("c", [("T1059", "x", 1.5)]), record("d", [("X1059", "x", 0.5)]),
        record("e", cves=[("CVE-1", 1.0)]), record("f", cves=[("CVE-2021-0001", 11.0)]),
        record("g", log_sources=[{}]), record("h", validation_status="odd"), record("i", platforms=["amiga"]),
        record("j", portability_score=101.0), record("k", source_format="odd"),
    ]
    kept, rejected = quality.split_rejects(corpus(spark, good, *bad), quality.detection_checks())
    assert [r.id for r in kept.collect()] == ["a"]
    assert {r.id: r.violations for r in rejected.collect()} == {
        "b": ["severity"], "c": ["technique_confidence"], "d": ["technique_id"], "e": ["cve_id"], "f": ["cvss_score"],
        "g": ["log_sources"], "h": ["validation_status"], "i": ["platforms"], "j": ["portability_score"],
        "k": ["source_format"],
    }
    fixed = quality.clamp(corpus(spark, record("a", maturity=9, tags=["x", "y", "x"]), record("b", maturity=-3))).collect()
    assert [(r.detection_maturity_score, r.tags) for r in fixed] == [(5, ["x", "y"]), (0, [])]


def test_event_and_gap_checks(spark):
    events = spark.sql("SELECT * FROM VALUES ('x', 'linux', 0, 65535), ('x', 'linux', -1, 70000), (NULL, 'zz', 1, 1) "
                       "AS t(event_type, platform, src_port, dst_port)")
    out = events.select(quality.violations(quality.event_checks())).collect()
    assert [r[0] for r in out] == [[], ["src_port", "dst_port"], ["event_type", "platform"]]
    gap = spark.sql("SELECT 'T1' AS technique_id, 11D AS priority_score")
    assert gap.select(quality.violations(quality.gap_checks())).first()[0] == ["technique_id", "priority_score"]


def test_schema_check(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', 'n', 'l', NULL), ('b', NULL, 'l', '1.0'), ('c', 'n', 'l', '9') "
                     "AS t(id, name, detection_logic, schema_version)")
    out = {r.id: r.schema_error for r in quality.check_shape(rows).collect()}
    assert out == {"a": None, "b": "missing fields: name", "c": "unknown schema version 9"}


def test_findings(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES ('a', 'A', array('T1'), 'q', 'pass', NULL, 0), ('b', 'B', array('T1', 'T2'), 'q', 'fail', NULL, 1), "
        "('c', 'C', array(), 'q', 'error', 'boom', 2), ('d', 'D', array(), 'q', 'skip', NULL, 3), "
        "('b', 'B2', array('T1'), 'q2', 'fail', NULL, 4) AS t(rule_id, name, techniques, query, status, error, pos)"
    )
    out = sorted((r.rule_id, r.level, r.message) for r in quality.findings(rows).collect())
    assert [(r[0], r[1]) for r in out] == [("b", "warning"), ("b", "warning"), ("c", "error")]
    assert "Techniques: T1, T2." in out[0][2] and out[2][2] == "Validation error: boom"
    described = {r.rule_id: r.name for r in quality.finding_rules(rows, "pos").collect()}
    assert described == {"a": "A", "b": "B", "c": "C", "d": "D"}


def test_target_queries(spark):
    records = corpus(spark, record("a", [("T1059.001", "execution", 0.9), ("T1105", "unknown", 0.5)], severity="critical",
                                   cves=[("CVE-2021-44228", None)]), record("b"))
    rows = {r.id: r for r in export.target_queries(records, "tele").collect()}
    assert rows["a"].sigma_tags == ["attack.execution", "attack.t1059.001", "attack.t1105", "cve.2021.44228"]
    assert 'technique="T1059.001" OR technique="T1105"' in rows["a"].spl and "alert.severity = 5" in rows["a"].spl
    assert rows["a"].kql == '// rule a\ntechnique: "T1059.001" or technique: "T1105"\n'
    assert "(index=tele)" in rows["b"].spl and "isnotempty(technique)" in rows["b"].kql
    payload = {r.id: json.loads(r.payload) for r in export.monitor_payloads(records, "tele-*").collect()}
    assert payload["a"]["query"]["bool"]["should"][0] == {"term": {"technique.keyword": "T1059.001"}}
    assert payload["b"]["query"] == {"match_all": {}} and payload["a"]["schedule"]["period"]["unit"] == "HOURS"
    saved = {r.id: r for r in export.saved_searches(records, "tele").collect()}
    assert (saved["a"].alert_severity, saved["b"].alert_severity, saved["a"].cron_schedule) == ("5", "3", "0 * * * *")


def test_gap_priority(one):
    column = coverage.gap_priority(F.col("f"), F.col("s"), F.col("e"))
    assert one(column, f=2, s="high", e="low") == 6.0
    assert one(column, f=2, s="low", e="high") == pytest.approx(2 / 3)
    assert one(column, f=50, s="high", e="low") == 10.0


def test_lint_records(spark, kb):
    out = quality.lint_records(
        corpus(spark, record("a", [("T1059", "x", 0.5)], raw="keywords: [x]"), record("b"),
               record("c", [("T9999", "x", 0.5), ("T4242", "x", 0.5)], raw="keywords: [x]")), kb)
    assert sorted((r.id, r.code) for r in out.collect()) == [
        ("b", "missing_technique"), ("b", "over_broad"), ("c", "deprecated_technique"), ("c", "unknown_technique")
    ]


def test_score_rates(spark):
    from watchfloor.operators.matching import with_rates

    rows = spark.sql("SELECT * FROM VALUES ('a', 4L, 3L, 1L, 1L), ('b', 0L, 0L, 0L, 0L) AS t(rule_id, matched, tp, fp, fn)")
    out = {r.rule_id: (r.false_negative_rate, r.false_positive_rate) for r in with_rates(rows).collect()}
    assert out == {"a": (0.25, 0.25), "b": (None, None)}


def test_results_round_trip(spark, tmp_path):
    from watchfloor.sources.records import read_results, write_results

    rows = spark.sql(
        "SELECT 'r' AS rule_id, 'n' AS name, array('T1') AS techniques, 'local' AS siem, 'q' AS query, 2L AS hits, "
        "'pass' AS status, CAST(NULL AS STRING) AS error, array(map('a', '1'), map('a', '2')) AS samples"
    )
    write_results(rows.union(rows).coalesce(1), str(tmp_path / "out"), samples=1)
    assert read_results(spark, str(tmp_path / "out")).count() == 2
    back = read_results(spark, str(tmp_path / "out")).first()
    assert (back.hits, back.techniques, back.samples) == (2, ["T1"], [{"a": "1"}])
    (tmp_path / "array.json").write_text(json.dumps([{"rule_id": "x", "hits": 1}, {"rule_id": "y", "status": "fail"}]))
    assert [r.rule_id for r in read_results(spark, str(tmp_path / "array.json"), array=True).orderBy("rule_id").collect()] == ["x", "y"]

"""The command chain end to end: ingest, match, map, enrich, report."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from watchfloor.__main__ import main

SIGMA = """
title: Web Shell
id: 11111111-2222-3333-4444-555555555555
tags: [attack.execution, attack.t1059.004, cve.2021.44228]
logsource: {product: linux}
detection:
  sel: {exe|endswith: /sh}
  keywords: ['*jndi*']
  condition: sel
"""
EVENTS = [
    {"timestamp": "2024-01-01T00:00:00Z", "exe": "/bin/sh", "technique": "T1059"},
    {"timestamp": "2024-01-02T00:00:00Z", "message": "a JNDI lookup"},
    {"timestamp": "2024-01-03T00:00:00Z", "message": "quiet"},
]


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    (root / "rules").mkdir()
    (root / "rules" / "a.yml").write_text(SIGMA)
    (root / "rules" / "b.spl").write_text("index=main T1105")
    (root / "events").mkdir()
    (root / "events" / "e.jsonl").write_text("\n".join(map(json.dumps, EVENTS)))
    technique = lambda i, t, n: {"type": "attack-pattern", "id": f"attack-pattern--{i}", "name": n,
                                 "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "execution"}],
                                 "external_references": [{"source_name": "mitre-attack", "external_id": t}]}
    objects = [technique(1, "T1059", "Interp"), technique(2, "T1059.004", "Shell"), technique(3, "T1105", "Tool"),
               technique(4, "T1003", "Dump")]
    (root / "kb.json").write_text(json.dumps({"objects": objects}))
    (root / "nvd.json").write_text(json.dumps({"vulnerabilities": [{"cve": {
        "id": "CVE-2021-44228", "descriptions": [{"lang": "en", "value": "text"}],
        "metrics": {"cvssMetricV31": [{"type": "Primary", "cvssData": {"baseScore": 10.0}}]},
        "weaknesses": [{"description": [{"value": "CWE-502"}]}]}}]}))
    (root / "epss.json").write_text(json.dumps({"data": [{"cve": "CVE-2021-44228", "epss": "0.9", "percentile": "1"}]}))
    main(["ingest", str(root / "rules"), "--out", str(root / "in")])
    return root


def rows(spark, path):
    return spark.read.json(str(path)).collect()


def test_match(spark, work):
    out = work / "matched"
    main(["match", f"{work}/in/records", f"{work}/events", "--kind", "indexed", "--samples", "--out", str(out),
          "--tested-at", "2024-02-01 00:00:00"])
    results = {r.name: r for r in rows(spark, out / "results")}
    assert (results["Web Shell"].hits, results["Web Shell"].status, len(results["Web Shell"].samples)) == (1, "pass", 1)
    assert results["b"].status == "fail"
    assert {r.name: r.validation_status for r in rows(spark, out / "records")} == {"Web Shell": "passed", "b": "failed"}
    main(["report", f"{out}/results", "--out", f"{work}/summary"])
    totals = rows(spark, work / "summary" / "totals")[0]
    assert (totals.total, totals.passed, totals.failed, totals.pass_pct) == (2, 1, 1, 50)
    assert {r.tactic: (r.covered, r.total) for r in rows(spark, work / "summary" / "tactics")} == {
        "Execution": (1, 1), "Other": (0, 1)
    }
    assert len(rows(spark, work / "summary" / "findings")) == 1


def test_local_match_counts_substrings_and_techniques(spark, work):
    main(["match", f"{work}/in/records", f"{work}/events", "--out", f"{work}/local"])
    assert {r.name: r.hits for r in rows(spark, work / "local" / "results")} == {"Web Shell": 2, "b": 0}
    main(["match", f"{work}/in/records", f"{work}/events", "--start", "2024-01-02 00:00:00", "--out", f"{work}/late"])
    assert {r.name: r.hits for r in rows(spark, work / "late" / "results")} == {"Web Shell": 1, "b": 0}


def test_map_enrich_and_coverage(spark, work):
    main(["map", f"{work}/in/records", f"{work}/kb.json", "--out", f"{work}/mapped"])
    main(["enrich", f"{work}/mapped/records", "--bundle", f"{work}/kb.json", "--nvd", f"{work}/nvd.json",
          "--out", f"{work}/rich"])
    found = {r.name: r for r in rows(spark, work / "rich" / "records")}
    assert found["Web Shell"].severity == "critical"
    assert found["b"].mitre_techniques[0].name == "Tool"
    main(["coverage", f"{work}/rich/records", f"{work}/kb.json", "--out", f"{work}/cover"])
    assert {r.technique_id for r in rows(spark, work / "cover" / "gaps")} == {"T1059", "T1003"}
    main(["cve-coverage", f"{work}/rich/records", "--nvd", f"{work}/nvd.json", "--epss", f"{work}/epss.json",
          "--out", f"{work}/cve"])
    cve = rows(spark, work / "cve" / "cves")[0]
    assert (cve.techniques, cve.covered, cve.residual_risk) == (2, 1, 4.5)
    main(["export", f"{work}/rich/records", "--index", "tele", "--out", f"{work}/sent"])
    assert len(rows(spark, work / "sent" / "queries")) == 2


def test_changes(spark, work):
    main(["changes", f"{work}/rules", "--out", f"{work}/c1"])
    assert {r.change for r in rows(spark, work / "c1" / "changes")} == {"added"}
    (work / "rules" / "c.spl").write_text("index=x")
    main(["changes", f"{work}/rules", "--previous", f"{work}/c1/snapshot", "--out", f"{work}/c2"])
    assert [(r.path.rsplit("/", 1)[1], r.change) for r in rows(spark, work / "c2" / "changes")] == [("c.spl", "added")]


def test_ship_then_match_the_store(spark, work):
    main(["ship", f"{work}/events", "--name", f"job-{uuid.uuid4()}", "--once", "--out", f"{work}/store"])
    main(["match", f"{work}/in/records", f"{work}/store", "--store", "--start", "2024-01-02 00:00:00",
          "--out", f"{work}/from_store"])
    assert {r.name: r.hits for r in rows(spark, work / "from_store" / "results")} == {"Web Shell": 1, "b": 0}


def test_watch(spark, work):
    main(["watch", f"{work}/events", f"{work}/rules", "--name", f"job-{uuid.uuid4()}", "--once", "--out", f"{work}/seen"])
    total = spark.read.parquet(f"{work}/seen").agg(F.sum("broad_hits"), F.sum("field_hits")).first()
    assert tuple(total) == (2, 1)

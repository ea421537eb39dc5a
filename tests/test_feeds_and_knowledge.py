import json

import pytest
from pyspark.sql import functions as F

from watchfloor.operators import graph, knowledge, united
from watchfloor.operators import vulnerabilities as vuln
from watchfloor.operators.vulnerabilities import CoveringRules
from watchfloor.sources import feeds
from watchfloor.sources.knowledge import load_bundle, procedure_examples
from watchfloor.sources.lookups import KEYWORD_HINTS, SOURCE_HINTS, field_map, keyword_hints, source_hints, weakness_map


def ref(external_id):
    return [{"source_name": "other", "external_id": "X"}, {"source_name": "mitre-attack", "external_id": external_id}]


def phase(name):
    return [{"kill_chain_name": "mitre-attack", "phase_name": name}, {"kill_chain_name": "zz", "phase_name": "no"}]


def edge(kind, source, target, description=None):
    return {"type": "relationship", "id": f"relationship--{kind}{source}{target}", "relationship_type": kind,
            "source_ref": source, "target_ref": target, "description": description}


BUNDLE = {
    "type": "bundle",
    "objects": [
        {"type": "attack-pattern", "id": "attack-pattern--1", "name": "Interpreter", "description": "d" * 900,
         "external_references": ref("T1059"), "kill_chain_phases": phase("Execution")},
        {"type": "attack-pattern", "id": "attack-pattern--2", "name": "Shell", "external_references": ref("T1059.004"),
         "x-mitre-is-subtechnique": True, "kill_chain_phases": phase("execution")},
        {"type": "attack-pattern", "id": "attack-pattern--3", "name": "Old", "external_references": ref("T9999"),
         "revoked": True},
        {"type": "attack-pattern", "id": "attack-pattern--4", "name": "Lost", "external_references": ref("T8888.001"),
         "x_mitre_is_subtechnique": True, "x_mitre_deprecated": True},
        {"type": "attack-pattern", "id": "attack-pattern--5", "name": "No id", "external_references": []},
        {"type": "x-mitre-tactic", "id": "x-mitre-tactic--1", "name": "Execution", "external_references": ref("TA0002")},
        {"type": "course-of-action", "id": "course-of-action--1", "name": "Block", "external_references": ref("M1")},
        {"type": "intrusion-set", "id": "intrusion-set--1", "name": "Group", "external_references": ref("G1")},
        {"type": "malware", "id": "malware--1", "name": "Mal", "external_references": ref("S1")},
        {"type": "tool", "id": "tool--1", "name": "Tool", "external_references": ref("S2")},
        edge("revoked-by", "attack-pattern--3", "attack-pattern--1"),
        edge("mitigates", "course-of-action--1", "attack-pattern--1"),
        edge("uses", "intrusion-set--1", "attack-pattern--2", "group ran it"),
        edge("uses", "malware--1", "attack-pattern--2", "mal ran it"),
        edge("uses", "tool--1", "attack-pattern--1"),
    ],
}


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("kb") / "bundle.json"
    path.write_text(json.dumps(BUNDLE, indent=1))
    return load_bundle(spark, str(path))


def test_techniques(kb):
    rows = {r.technique_id: r for r in kb.techniques.collect()}
    assert set(rows) == {"T1059", "T1059.004", "T9999", "T8888.001"}
    assert rows["T1059"].tactic == "execution" and len(rows["T1059"].description) == 900
    assert rows["T1059.004"].parent_id == "T1059" and rows["T8888.001"].parent_id == "T8888"
    assert rows["T9999"].deprecated and rows["T9999"].tactic == "unknown" and rows["T8888.001"].deprecated


def test_listings(kb):
    active = knowledge.active_techniques(kb.techniques)
    assert {r.technique_id for r in active.collect()} == {"T1059", "T1059.004"}
    base = knowledge.active_techniques(kb.techniques, include_deprecated=True, include_subtechniques=False)
    assert {r.technique_id for r in base.collect()} == {"T1059", "T9999"}
    assert kb.tactics.count() == 1


def test_replacement_and_orphans(kb):
    out = {r.technique_id: r.replacement for r in knowledge.replacements(kb.techniques, kb.revoked_by, "stix_id").collect()}
    assert out == {"T9999": "T1059", "T8888.001": None}
    assert [r.technique_id for r in knowledge.orphans(kb.techniques).collect()] == ["T8888.001"]


def test_relationships(kb):
    def of(kind, sources):
        return {(r.technique_id, r.source_id) for r in knowledge.related(kb.edges, sources, kb.techniques, kind).collect()}

    assert of("mitigates", kb.mitigations) == {("T1059", "M1")}
    assert of("group-uses", kb.groups) == {("T1059.004", "G1")}
    assert of("software-uses", kb.software) == {("T1059.004", "S1"), ("T1059", "S2")}
    assert {(r.technique_id, r.description) for r in procedure_examples(kb).collect()} == {
        ("T1059.004", "group ran it"), ("T1059.004", "mal ran it")
    }


def write(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_nvd(spark, tmp_path):
    metric = lambda score, kind, sev=None: {"type": kind, "baseSeverity": sev, "cvssData": {
        "baseScore": score, "version": "x", "vectorString": "v", **({} if sev else {"baseSeverity": "critical"})}}
    path = write(tmp_path, "nvd.json", {"vulnerabilities": [
        {"cve": {"id": "CVE-1", "descriptions": [{"lang": "es", "value": "hola"}, {"lang": "en", "value": "hello"}],
                 "metrics": {"cvssMetricV2": [metric(1.0, "Primary", "low")],
                             "cvssMetricV31": [metric(5.0, "Secondary"), metric(9.8, "Primary")]},
                 "weaknesses": [{"description": [{"value": "CWE-78"}, {"value": "NVD-CWE-noinfo"}]},
                                {"description": [{"value": "CWE-78"}, {"value": "CWE-20"}]}],
                 "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:a"}, {"criteria": "cpe:a"}]}]}],
                 "published": "p", "lastModified": "m"}},
        {"cve": {"id": "CVE-2", "descriptions": [{"lang": "fr", "value": "salut"}],
                 "metrics": {"cvssMetricV2": [metric(4.3, "Secondary", "medium")]}}},
        {"cve": {"id": "CVE-3"}},
    ]})
    rows = {r.cve_id: r for r in feeds.read_nvd(spark, path).collect()}
    one = rows["CVE-1"]
    assert (one.description, one.cvss_score, one.severity) == ("hello", 9.8, "CRITICAL")
    assert (one.cwes, one.cpes) == (["CWE-78", "CWE-20"], ["cpe:a"])
    assert (rows["CVE-2"].description, rows["CVE-2"].cvss_score, rows["CVE-2"].severity) == ("salut", 4.3, "MEDIUM")
    assert (rows["CVE-3"].description, rows["CVE-3"].cvss_score, rows["CVE-3"].cwes) == ("", None, [])


def test_kev_and_epss(spark, tmp_path):
    kev = write(tmp_path, "kev.json", {"vulnerabilities": [{"cveID": "CVE-1", "vendorProject": "V"}, {"cveID": ""}]})
    rows = feeds.read_kev(spark, kev).collect()
    assert [(r.cve_id, r.vendor, r.notes) for r in rows] == [("CVE-1", "V", "")]
    epss = write(tmp_path, "epss.json", {"data": [{"cve": "cve-1", "epss": "0.5", "percentile": "0.9", "date": "d"}]})
    assert [(r.cve_id, r.epss, r.percentile) for r in feeds.read_epss(spark, epss).collect()] == [("CVE-1", 0.5, 0.9)]


def test_mapping_files(spark, tmp_path):
    csv = write(tmp_path, "m.csv", 'CVE ID,Primary Impact,x,Secondary Impact\n'
                                   'cve-1,"T1190; T1059",n,"T1059,foo"\nbad,T1,n,\nCVE-1,T1003,n,\nCVE-2,,n,t1105\n')
    got = {r.cve_id: r.techniques for r in feeds.read_mapping_csv(spark, csv).collect()}
    assert got == {"CVE-1": ["T1190", "T1059", "T1003"], "CVE-2": ["t1105"]}
    by_cve = write(tmp_path, "a.json", {"cve-1": ["T1", " T2 "], "CVE-2": "T3", "x": ["T4"]})
    assert {r.cve_id: r.techniques for r in feeds.read_mapping_json(spark, by_cve).collect()} == {
        "CVE-1": ["T1", "T2"], "CVE-2": ["T3"]
    }
    listed = write(tmp_path, "b.json", [{"cve": "CVE-1", "technique": "T1"}, {"cve_id": "cve-1", "technique_id": "T2"},
                                        {"cve": "CVE-9"}])
    assert {r.cve_id: r.techniques for r in feeds.read_mapping_json(spark, listed).collect()} == {"CVE-1": ["T1", "T2"]}
    with pytest.raises(ValueError, match="no CVE or technique column"):
        feeds.read_mapping_csv(spark, write(tmp_path, "c.csv", "a,b\n1,2\n"))


def test_feed_merge_keeps_a_cve_any_feed_knows(spark):
    nvd = spark.sql("SELECT 'cve-1' AS cve_id, 9.8D AS cvss_score UNION ALL SELECT 'CVE-2', 5.0D")
    kev = spark.sql("SELECT 'CVE-1' AS cve_id, 'v' AS vendor UNION ALL SELECT 'CVE-3', 'w'")
    own = spark.sql("SELECT 'CVE-4' AS cve_id")
    rows = {r.cve_id: r for r in vuln.merge_feeds({"nvd": nvd, "kev": kev, "own": own}).collect()}
    assert set(rows) == {"CVE-1", "CVE-2", "CVE-3", "CVE-4"}
    assert (rows["CVE-1"].cvss_score, rows["CVE-1"].vendor, rows["CVE-1"].in_kev) == (9.8, "v", True)
    assert (rows["CVE-2"].in_kev, rows["CVE-3"].in_nvd, rows["CVE-4"].in_own) == (False, False, True)


def test_technique_merge_joins_sources_of_equal_confidence(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES ('c', 'T1', 'cwe', 0.9D), ('c', 'T1', 'ctid', 0.9D), ('c', 'T2', 'cwe', 0.8D), "
        "('c', 'T2', 'ctid', 0.9D), ('c', 'T3', 'cwe', 0.7D) AS t(cve_id, technique_id, source, confidence)"
    )
    out = vuln.merge_techniques(rows, ["cve_id", "technique_id"], ["ctid", "cwe"], "confidence").collect()
    assert {(r.technique_id, r.confidence, r.source) for r in out} == {
        ("T1", 0.9, "ctid+cwe"), ("T2", 0.9, "ctid"), ("T3", 0.7, "cwe")
    }


def test_coverage_granularity(spark):
    wanted = spark.sql("SELECT 'c' AS cve_id, explode(array('T1059.001', 'T1190')) AS technique_id")
    bound = spark.sql("SELECT 'T1059.004' AS technique_id")
    parent = {r.technique_id: r.covered for r in vuln.flag_covered(wanted, bound).collect()}
    exact = {r.technique_id: r.covered for r in vuln.flag_covered(wanted, bound, "exact").collect()}
    assert parent == {"T1059.001": True, "T1190": False} and exact == {"T1059.001": False, "T1190": False}


def test_weakness_map(spark):
    rows = weakness_map(spark).filter(F.col("cwe_id") == "CWE-78").collect()
    assert sorted((r.technique_id, r.confidence) for r in rows) == [("T1059", 0.85), ("T1059.003", 0.85)]
    assert (len(KEYWORD_HINTS), len(SOURCE_HINTS), weakness_map(spark).select("cwe_id").distinct().count()) == (64, 27, 34)


def test_lookups_from_files(spark, tmp_path):
    words = write(tmp_path, "k.yaml", "entries: [{keyword: abc, techniques: T1}, {keyword: 'a.c', techniques: [T2, T3], "
                                      "regex: true, confidence: 0.9}]")
    hints = keyword_hints(spark, words)
    assert [(h.keyword, h.techniques, h.confidence, h.is_regex) for h in hints] == [
        ("abc", ("T1",), 0.65, False), ("a.c", ("T2", "T3"), 0.9, True)
    ]
    sources = source_hints(spark, write(tmp_path, "s.yaml", "hints: [{log_sources: [x], keywords: [y], techniques: [T1]}]"))
    assert (sources[0].log_sources, sources[0].confidence) == (("x",), 0.60)
    cwes = weakness_map(spark, write(tmp_path, "w.yaml", "mappings: [{cwe_id: CWE-1, techniques: [T1, T2]}]"))
    assert [(r.technique_id, r.confidence) for r in cwes.collect()] == [("T1", 0.6), ("T2", 0.6)]
    paths, defaults = field_map(spark, write(tmp_path, "f.yaml", "field_map: {name: a.b}\ndefaults: {language: l}"))
    assert (paths["name"], paths["id"], defaults) == ("a.b", "id", {"language": "l"})


def test_a_repeated_id_takes_one_whole_record(spark):
    nvd = spark.createDataFrame(
        [("CVE-1", 9.8, "aaa", "2024-01-02"), ("CVE-1", 7.5, "zzz", "2024-01-01"), ("CVE-2", None, "b", None)],
        "cve_id STRING, cvss_score DOUBLE, vendor STRING, last_modified STRING",
    )
    epss = spark.createDataFrame([("cve-1", 0.5), ("CVE-1", 0.5)], "cve_id STRING, epss DOUBLE")
    rows = {r.cve_id: (r.cvss_score, r.vendor, r.epss) for r in vuln.merge_feeds({"nvd": nvd, "epss": epss}).collect()}
    assert rows == {"CVE-1": (9.8, "aaa", 0.5), "CVE-2": (None, "b", None)}


def test_chains_end_wherever_they_are(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(300)]
    loop = [("a", "b"), ("b", "c"), ("c", "a"), ("into", "a"), ("self", "self")]
    edges = spark.createDataFrame([*chain, *loop, ("two", "x"), ("two", "y"), (None, "z"), ("n", None), ("c5", "c6")], "source string, target string")
    got = {r.source: (r.end, r.steps, r.cyclic) for r in graph.chain_ends(edges).collect()}
    want = {f"c{i}": ("c300", 300 - i, False) for i in range(300)}
    want |= {s: (None, None, True) for s in ("a", "b", "c", "into", "self")} | {"two": ("x", 1, False)}
    assert got == want
    assert graph.chain_ends(edges.limit(0)).count() == 0


def test_paths_meet_no_object_twice(spark):
    edges = spark.createDataFrame(
        [("uses", "g1", "s1"), ("uses", "g1", "s1"), ("uses", "g2", "s2"), ("has", "s1", "t1"), ("has", "s1", "g1"), ("has", "s2", "t2"), ("has", None, "t2")],
        "relationship string, source_ref string, target_ref string",
    )
    got = sorted((r.start, r.end, r.path) for r in graph.paths(edges, ["uses", "has"]).collect())
    assert got == [("g1", "t1", ["g1", "s1", "t1"]), ("g2", "t2", ["g2", "s2", "t2"])]
    only = graph.paths(edges, ["uses", "has"], spark.createDataFrame([("g2",)], "ref string"))
    assert [r.end for r in only.collect()] == ["t2"]


def test_covering_rules_are_never_multiplied(spark):
    cves = spark.createDataFrame([("v1", "T1.001"), ("v1", "T2"), ("v2", "T1"), ("v3", "T9"), ("v3", None)], "cve string, technique_id string")
    bound = spark.createDataFrame([("T1.002", f"r{i}") for i in range(500)] + [("T2", "r1"), ("T2", "x"), (None, "y"), ("T2", None)], "technique_id string, rule string")
    rules = CoveringRules(cves, bound, "cve", "rule")
    assert {r.cve: r.n_rules for r in rules.per_cve().collect()} == {"v1": 501, "v2": 500, "v3": 0}
    assert {(r.cve, r.technique_id): r.n_rules for r in rules.per_technique().collect()} == {("v1", "T1.001"): 500, ("v1", "T2"): 2, ("v2", "T1"): 500, ("v3", "T9"): 0}
    one = rules.of(cves.filter("cve = 'v2'"))
    assert one.count() == 500 and {r.technique_id for r in one.collect()} == {"T1"}
    assert rules.sets().count() == 2


def test_sets_of_rules_are_as_long_as_their_members(spark, monkeypatch):
    """One shuffled row of bits for each CVE and parent takes 4 KB whatever it holds; packed numbers take what they hold."""
    cves = spark.createDataFrame([(f"v{k}", f"T{k % 7 + j}") for k in range(60) for j in range(k % 4 + 1)], "cve string, technique_id string")
    pairs = [(f"T{k % 10}", f"r{k * k % 311}") for k in range(900)]
    bound = spark.createDataFrame(pairs, "technique_id string, rule string")
    want = {f"v{k}": len({r for t, r in pairs if t in {f"T{k % 7 + j}" for j in range(k % 4 + 1)}}) for k in range(60)}
    for pairs_held, visits, dense in ((10**6, 10, 64), (40, 7, 64), (40, 7, 2), (10**6, 1000, 0)):
        for name, value in {"PAIRS": pairs_held, "VISITS": visits, "DENSE": dense}.items():
            monkeypatch.setattr(united, name, value)
        rules = CoveringRules(cves, bound, "cve", "rule")
        assert {r.cve: r.n_rules for r in rules.per_cve().collect()} == want
    monkeypatch.setattr(united, "PAIRS", 10**6)
    assert all(len(r[2]) <= 4 * 311 for r in CoveringRules(cves, bound, "cve", "rule").sets().collect())


def test_rows_of_groups_are_dealt_once(spark, monkeypatch):
    """Neither rows nor sets are shuffled again for each bucket that a group visits, nor for each task that reads the sets."""
    cves = spark.createDataFrame([(f"v{k}", f"T{k % 7 + j}") for k in range(30) for j in range(3)], "cve string, technique_id string")
    bound = spark.createDataFrame([(f"T{k % 10}", k % 97) for k in range(400)], "technique_id string, rule long")
    monkeypatch.setattr(united, "PAIRS", 20)
    plan = CoveringRules(cves, bound, "cve", "rule").per_cve()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize(("pairs", "visits", "dense", "few"), [(10**6, 10**6, 512, 1000), (50, 5, 512, 1000), (50, 40, 1, 0), (300, 1, 10**6, 0), (2, 300, 64, 4)])
def test_united_counts_equal_distinct_members(spark, monkeypatch, pairs, visits, dense, few):
    """Repeated rows count once, one group and one member have more rows than are held, and groups without members are there if asked for."""
    for name, value in {"PAIRS": pairs, "VISITS": visits, "LEAST": 10, "DENSE": dense, "FEW": few, "SORTED": 30}.items():
        monkeypatch.setattr(united, name, value)
    members = [(f"p{k % 12}", k * k % 83 if k % 3 else 7) for k in range(500)] + [("p0", 7)] * 300
    filed = [(k % 20 if k % 20 else None, f"p{k * k % 17}") for k in range(300)] + [(3, "p0")] * 200 + [(99, "none"), (98, None)]
    found = united.sets(spark.createDataFrame(members, "part string, member int"), "part", "member")
    groups = spark.createDataFrame(filed, "name long, part string")
    want = {g: len({m for p, m in members if (g, p) in set(filed)}) for g, _ in filed}
    got = [tuple(r) for r in united.counts(groups, found, "name", "part", empty=True).collect()]
    assert len(got) == len(want) and dict(got) == want and want[99] == want[98] == 0
    got = [tuple(r) for r in united.counts(groups, found, "name", "part").collect()]
    assert dict(got) == {g: n for g, n in want.items() if n} and len(got) == len(dict(got))

import json

import pytest
from pyspark.sql import functions as F

from watchfloor.operators.telemetry import snapshot_diff
from watchfloor.sources import records, rules
from watchfloor.sources.loaders import bare_query

FILES = {
    "sigma/proc.yml": """
title: Shell From Web Server
id: 11111111-2222-3333-4444-555555555555
author: Ann, Bo
description: Web shells, see T1505.003 and CVE-2021-44228
tags: [attack.execution, attack.t1059.004, cve.2021.44228, cim.Endpoint, team.blue]
logsource: {product: linux, category: process_creation}
detection:
  sel:
    ParentImage|endswith: '/nginx'
    Image|endswith: ['/sh', '/bash']
  parts:
    - exe: a
    - deep: {comm: b}
  condition: sel and not parts
falsepositives: [None, Admin work]
level: high
""",
    "sigma/no_id.yml": "title: Words\nlogsource: {service: sshd}\ndetection:\n  keywords: ['*jndi*', ldap]\n",
    "sc/wmi.yml": """
name: Remote WMI
id: aaaa
author: Team
description: lateral
search: '`sysmon` index=win sourcetype=sysmon | stats count by host, user | where count > 3'
known_false_positives: none
tags:
  mitre_attack_id: [T1047]
  cve: [CVE-2020-0601]
  kill_chain_phases: [Lateral Movement]
  required_fields: [EventCode]
  analytic_story: [Story One]
  security_domain: endpoint
  severity: high
""",
    "kql/spray.yml": """
id: bbbb
name: Spray
severity: Informational
tactics: [CredentialAccess]
relevantTechniques: [T1110.003]
requiredDataConnectors: [{connectorId: AAD}]
query: |
  SigninLogs
  | where ResultType != 0
""",
    "kql/bare.kql": "// T1059.001\nDeviceProcessEvents\n| where FileName =~ 'x'\n",
    "spl/beacon.spl": "index=dns | stats count by src_ip",
    "spl/saved.conf": """
[default]
search = ignored
[First One]
# comment
search = index=main T1003 | head 1 \\
    | where x > 1
alert.severity = 5
[Second]
search = index=other
description = moderate
""",
    "elastic/rule.toml": '''
[rule]
author = ["E1", "E2"]
name = "Injection"
rule_id = "cccc"
severity = "critical"
type = "eql"
index = ["a", "b", "c", "d", "e", "f"]
tags = ["T1055", "Windows"]
query = """
process where process.name : "x.exe"
"""
[[rule.threat]]
[rule.threat.tactic]
name = "Defense Evasion"
[[rule.threat.technique]]
id = "T1055"
[[rule.threat.technique.subtechnique]]
id = "T1055.002"
''',
    "elastic/rule.json": json.dumps({"rule": {"rule_id": "dddd", "name": "J", "query": "file where file.path == 1"}}),
    "yara/two.yar": """
// rule header comment
rule First : web shell
{
  meta:
    author = "me"
    severity = "low"
    technique = "T1505.003"
    platform = "linux"
  strings:
    $a = "eval("
  condition:
    $a
}
private rule Other { condition: true }
""",
    "generic/own.yml": """
rule_id: G-1
title: Own Format
risk_level: high
os: [win, k8s, amiga]
detection: {search: "dst_ip = 1"}
tags: {attack: "T1071.001; T1041", source: feed}
false_positives: [cdn]
""",
    "broken/bad.yml": "title: [unclosed\ndetection: {}\nlogsource: {}\n",
    "readme.md": "rule X { condition: true }",
    "latin.kql": "SecurityEvent | where Account == 'caf\xe9'".encode("latin-1"),
    "note.dat": "nothing of interest",
}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("rules")
    for name, content in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(root)


@pytest.fixture(scope="module")
def ingested(spark, corpus):
    found, errors = rules.read_rules(spark, corpus)
    return {r.name: r for r in found.collect()}, errors.collect()


def techniques(record):
    return [t.sub_technique_id or t.technique_id for t in record.mitre_techniques]


def test_every_rule_is_found_and_errors_are_rows(ingested):
    found, errors = ingested
    assert sorted(found) == sorted([
        "Shell From Web Server", "Words", "Remote WMI", "Spray", "bare", "beacon", "First One", "Second", "Injection",
        "J", "First", "Other", "Own Format", "latin",
    ])
    assert len(errors) == 1 and errors[0].path.endswith("bad.yml") and "Error" in errors[0].error


def test_sigma(ingested):
    r = ingested[0]["Shell From Web Server"]
    assert r.id == "11111111-2222-3333-4444-555555555555"
    assert r.author == ["Ann", "Bo"] and r.severity == "high" and r.platforms == ["linux"]
    assert techniques(r) == ["T1059.004", "T1505.003"] and {t.tactic for t in r.mitre_techniques} == {"execution"}
    assert [c.cve_id for c in r.cve_references] == ["CVE-2021-44228"]
    assert r.tags == ["attack.execution", "team.blue"] and r.cim_models == ["Endpoint"]
    assert r.detection_logic.field_references == ["Image|endswith", "ParentImage|endswith", "comm", "exe"]
    assert r.detection_logic.normalized_conditions == ["sel and not parts"]
    assert r.false_positive_notes == ["Admin work"] and r.data_components == ["process_creation"]
    assert json.loads(r.detection_logic.ast)["sel"]["ParentImage|endswith"] == "/nginx"


def test_missing_id_is_stable(spark, corpus, ingested):
    again, _ = rules.read_rules(spark, corpus)
    other = {r.name: r.id for r in again.select("name", "id").collect()}
    assert other["Words"] == ingested[0]["Words"].id and len(other["Words"]) == 64


def test_security_content(ingested):
    r = ingested[0]["Remote WMI"]
    assert (r.source_format, r.severity, r.platforms) == ("splunk-spl", "high", ["windows", "linux", "macos"])
    assert techniques(r) == ["T1047"] and r.mitre_techniques[0].tactic == "lateral-movement"
    assert r.tags == ["Story One"] and r.false_positive_notes == [] and r.data_components == ["EventCode"]
    assert r.detection_logic.field_references == ["EventCode", "host", "user"]
    assert [(s.product, s.service) for s in r.log_sources] == [("index=win", None), (None, "sysmon")]


def test_sentinel_and_bare_kql(ingested):
    r = ingested[0]["Spray"]
    assert (r.severity, r.platforms, r.data_components) == ("info", ["cloud"], ["AAD"])
    assert techniques(r) == ["T1110.003"] and r.mitre_techniques[0].tactic == "credential-access"
    b = ingested[0]["bare"]
    assert techniques(b) == ["T1059.001"] and b.platforms == ["windows"]
    assert [s.category for s in b.log_sources] == ["DeviceProcessEvents"]
    assert "café" in ingested[0]["latin"].detection_logic.raw


def test_saved_searches_give_one_rule_per_stanza(spark, corpus):
    loaded = rules.load(rules.route(rules.scan_files(spark, corpus))).filter(F.col("format") == "splunk")
    found = {r.name: r for r in rules.normalise(loaded).collect()}
    assert set(found) == {"First One", "Second"}
    assert found["First One"].detection_logic.raw == "index=main T1003 | head 1 | where x > 1"
    assert (found["First One"].severity, found["Second"].severity) == ("critical", "med")
    assert techniques(found["First One"]) == ["T1003"]


def test_elastic(ingested):
    r = ingested[0]["Injection"]
    assert techniques(r) == ["T1055", "T1055.002"] and r.mitre_techniques[0].tactic == "defense-evasion"
    assert r.tags == ["Windows"] and len(r.log_sources) == 6 and r.author == ["E1", "E2"]
    assert r.detection_logic.language == "eql" and r.platforms == ["windows"]
    assert ingested[0]["J"].id == "dddd"


def test_yara_gives_one_rule_per_definition(spark, corpus):
    loaded = rules.load(rules.route(rules.scan_files(spark, corpus))).filter(F.col("format") == "yara")
    found = {r.name: r for r in rules.normalise(loaded).collect()}
    assert set(found) == {"First", "Other"}
    first = found["First"]
    assert (first.severity, first.platforms, first.tags) == ("low", ["linux"], ["web", "shell"])
    assert techniques(first) == ["T1505.003"] and first.portability_score == 20.0
    assert first.detection_logic.field_references == ["$a"]


def test_generic_fields(ingested):
    r = ingested[0]["Own Format"]
    assert (r.id, r.severity, r.platforms, r.tags) == ("G-1", "high", ["windows", "containers"], ["feed"])
    assert techniques(r) == ["T1071.001", "T1041"] and r.detection_logic.raw == "dst_ip = 1"


def test_custom_field_map(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("meta: {label: Mine}\nrisk: critical\n")
    found, _ = rules.read_rules(
        spark, str(tmp_path), field_map={"name": "meta.label", "severity": "risk"}, defaults={"language": "mine"}
    )
    row = found.first()
    assert (row.name, row.severity, row.detection_logic.language) == ("Mine", "critical", "mine")


def test_extra_format_runs_before_the_fallback(spark, tmp_path):
    (tmp_path / "a.rul").write_text("hello")
    spec = rules.ExtraFormat(F.col("suffix") == "rul", bare_query)
    found, _ = rules.read_rules(spark, str(tmp_path), extra={"rul": spec})
    assert [r.name for r in found.collect()] == ["a"]


def test_forced_format_and_strict_mode(spark, corpus, tmp_path):
    (tmp_path / "x.txtrule").write_text("index=a | fields b")
    found, _ = rules.read_rules(spark, str(tmp_path), forced="spl")
    assert found.first().source_format == "splunk-spl"
    with pytest.raises(rules.RuleErrors, match="bad.yml"):
        rules.read_rules(spark, corpus, strict=True)


def test_non_recursive_scan(spark, corpus):
    assert {r.path.rsplit("/", 1)[1] for r in rules.scan_files(spark, corpus, recursive=False).collect()} == {
        "latin.kql", "note.dat"
    }


def test_json_lines_round_trip(spark, corpus, tmp_path):
    found, _ = rules.read_rules(spark, corpus)
    records.write_detections(found.drop("path"), str(tmp_path / "out"))
    (tmp_path / "out" / "part-bad.json").write_text("{broken\n\n")
    good, rejected = records.read_detections(spark, str(tmp_path / "out"))
    assert good.count() == found.count()
    assert [r.value for r in rejected.collect()] == ["{broken"]
    before = {r.id: r for r in found.select("id", "mitre_techniques", "author").collect()}
    for row in good.collect():
        assert row.mitre_techniques == before[row.id].mitre_techniques and row.author == before[row.id].author


def test_imported_records_regain_their_detection_block(spark, corpus):
    found, _ = rules.read_rules(spark, corpus)
    sigma = found.filter(F.col("source_format") == "sigma")
    stripped = sigma.withColumn("detection_logic", F.col("detection_logic").withField("ast", F.lit(None).cast("string")))
    out = {r.name: r for r in rules.matchable(rules.with_ast(stripped)).collect()}
    assert out["Words"].keywords == ["*jndi*", "ldap"]
    assert json.loads(out["Shell From Web Server"].detection)["condition"] == "sel and not parts"


def test_corpus_change_set(spark):
    old = spark.sql("SELECT * FROM VALUES ('a', 1), ('b', 1), ('c', 1) AS t(path, modified)")
    new = spark.sql("SELECT * FROM VALUES ('b', 1), ('c', 2), ('d', 1) AS t(path, modified)")
    out = {(r.path, r.change) for r in snapshot_diff(old, new, "path", "modified").collect()}
    assert out == {("a", "removed"), ("c", "modified"), ("d", "added")}

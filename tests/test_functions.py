import colorsys

import pytest
from pyspark.sql import functions as F

from watchfloor.functions import audit, ids, labels, text


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("attack.t1059.001", "T1059.001"), ("T1059", "T1059"), (" attack.T1190 ", "T1190"), ("TA0002", None),
        ("attack.ta0002", None), ("nothing", None), ("T1059.0012", "T1059"), ("T10590", None), (None, None),
    ],
)
def test_canonical_technique(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "r STRING")
    assert df.select(ids.canonical_technique(F.col("r"))).first()[0] == expected


@pytest.mark.parametrize(
    "raw, expected",
    [("cve.2021.44228", "CVE-2021-44228"), ("CVE_2021_44228", "CVE-2021-44228"), ("cve-2021-123", None)],
)
def test_canonical_cve(one, raw, expected):
    assert one(ids.canonical_cve(F.col("r")), r=raw) == expected


def test_ids_in_text_are_distinct_and_ordered(one):
    words = "uses T1105 and attack.t1059.001, again T1105; TA0001; CVE-2021-44228 cve.2021.44228 CVE-2020-0601"
    assert one(ids.techniques_in_text(F.col("t")), t=words) == ["T1105", "T1059.001"]
    assert one(ids.cves_in_text(F.col("t")), t=words) == ["CVE-2021-44228", "CVE-2020-0601"]


def test_technique_structs_drop_invalid_and_keep_repeats(one):
    out = one(ids.technique_structs(F.col("t"), F.lit("execution")), t=["T1059.001", "bad", "T1059", "T1059"])
    assert [(b.technique_id, b.sub_technique_id, b.confidence) for b in out] == [
        ("T1059", "T1059.001", 0.8), ("T1059", None, 0.8), ("T1059", None, 0.8)
    ]


def test_cve_structs_deduplicate_spellings(one):
    out = one(ids.cve_structs(F.col("c")), c=["cve.2021.44228", "CVE-2021-44228", "x"])
    assert [(c.cve_id, c.confidence) for c in out] == [("CVE-2021-44228", 0.9)]


def test_cve_tags_allow_short_numbers(one):
    assert one(ids.cves_from_tags(F.col("t")), t=["cve.2021.44228", "attack.t1190", "CVE.2014.0160"]) == [
        "CVE-2021-44228", "CVE-2014-0160"
    ]


def test_technique_url(one):
    assert one(ids.technique_url(F.col("t")), t="T1059.004").endswith("/T1059/004/")
    assert one(ids.technique_url(F.col("t")), t="T1059").endswith("/T1059/")


@pytest.mark.parametrize(
    "keywords, expected",
    [
        (["*jndi*", "exploit*"], ["jndi", "exploit"]), (["id", "ls", "ok", "curl"], ["curl"]),
        (["jndi", "JNDI"], ["jndi"]), (["curl:jndi"], ["curl", "jndi"]), ([], []),
    ],
)
def test_keyword_tokens(one, keywords, expected):
    assert one(text.keyword_tokens(F.col("k")), k=keywords) == expected


def test_leading_tokens_keep_case_and_cap_per_keyword(one):
    assert one(text.leading_tokens(F.col("k")), k=["Alpha Bravo Charlie", "xx Delta"]) == ["Alpha", "Bravo", "Delta"]


@pytest.mark.parametrize(
    "score, band",
    [(10.0, "critical"), (9.0, "critical"), (8.8, "high"), (7.0, "high"), (6.9, "med"), (4.0, "med"), (3.9, "low"),
     (0.0, "low")],
)
def test_cvss_bands(one, score, band):
    assert one(labels.severity_of_cvss(F.col("s")), s=score) == band


def test_severity_words(one):
    assert one(labels.severity(F.col("s")), s=" Moderate ") == "med"
    assert one(labels.severity(F.col("s")), s="whatever") == "med"
    assert one(labels.severity(F.col("s"), labels.SPLUNK_SEVERITIES), s="5") == "critical"


def test_tactic_from_tags(one):
    tags = ["attack.ta0002", "attack.T1059", "attack.Lateral_Movement", "attack.execution"]
    assert one(labels.tactic_from_tags(F.col("t")), t=tags) == "lateral_movement"
    assert one(labels.tactic_from_tags(F.col("t")), t=["cve.2021.1"]) == "unknown"


@pytest.mark.parametrize("pct", range(0, 101, 5))
def test_confidence_color_is_the_hls_green(one, pct):
    c = pct / 100
    r, g, b = colorsys.hls_to_rgb(120 / 360, 0.75 - c * 0.40, 0.6)
    assert one(labels.confidence_color(F.col("c")), c=c) == f"#{int(r * 255):02x}{int(g * 255):02x}{int(b * 255):02x}"


@pytest.mark.parametrize(
    "cvss, epss, ratio, risk", [(10.0, 0.97542, 0.0, 9.7542), (10.0, 0.9, 1.0, 0.0), (10.0, 0.0, 0.0, 0.0)]
)
def test_residual_risk(one, cvss, epss, ratio, risk):
    assert one(labels.residual_risk(F.col("a"), F.col("b"), F.col("c")), a=cvss, b=epss, c=ratio) == risk


@pytest.mark.parametrize(
    "translatable, confidence, gaps, errors, grade",
    [(True, 0.95, 0, 0, "A"), (True, 0.95, 1, 0, "B"), (True, 0.78, 0, 0, "B"), (True, 0.78, 0, 1, "C"),
     (True, 0.2, 0, 0, "D"), (False, 1.0, 0, 0, "F")],
)
def test_migration_grade(one, translatable, confidence, gaps, errors, grade):
    column = labels.migration_grade(F.col("t"), F.col("c"), F.col("g"), F.col("e"))
    assert one(column, t=translatable, c=confidence, g=gaps, e=errors) == grade


def test_primary_technique_and_latest_deployment_prefer_the_first_of_equals(spark):
    row = spark.sql(
        "SELECT array(named_struct('id', 'a', 'confidence', 0.5D), named_struct('id', 'b', 'confidence', 0.9D), "
        "named_struct('id', 'c', 'confidence', 0.9D)) AS t, "
        "array(named_struct('b', 'x', 'deployed_at', timestamp'2024-01-01'), "
        "named_struct('b', 'y', 'deployed_at', timestamp'2024-02-01')) AS d"
    ).select(labels.primary_technique(F.col("t")).alias("p"), labels.latest_deployment(F.col("d")).alias("l")).first()
    assert (row.p.id, row.l.b) == ("b", "y")


AUDIT = (
    'type=SYSCALL msg=audit(1700000000.123:456): arch=c000003e syscall=59 comm="dd" exe="/bin/dd" '
    "proctitle=6C73002D6C uid=0 uid=33 key=shell_exec cwd=zz name=ABC"
)


def test_audit_record(one):
    fields = one(audit.record_fields(F.col("l")), l=AUDIT)
    assert fields["comm"] == "dd"  # quoted, so not hex although it looks like it
    assert fields["proctitle"] == "ls\x00-l"
    assert fields["uid"] == "33"  # the last of repeated keys
    assert fields["name"] == "ABC"  # odd length is not hex
    assert one(audit.record_type(F.col("l")), l=AUDIT) == "SYSCALL"
    assert one(audit.record_serial(F.col("l")), l=AUDIT) == 456
    assert str(one(audit.record_time(F.col("l")), l=AUDIT)).startswith("2023-11-14 22:13:20.123")
    assert one(audit.record_time(F.col("l")), l="no stamp") is None
    assert one(audit.technique_of_key(F.col("k")), k="shell_exec") == "T1059.004"
    assert one(audit.syscall_name(F.col("n")), n="59") == "execve"
    assert one(audit.syscall_name(F.col("n")), n="9999") == "9999"


def test_event_time(one):
    assert str(one(audit.event_time(F.col("t")), t="2024-01-02T03:04:05Z")).startswith("2024-01-02 03:04:05")
    assert one(audit.event_time(F.col("t")), t="soon") is None


def test_spl_features(one):
    spl = (
        "index=main sourcetype=wineventlog EventCode=1\n| where count > 10\n| eval score = a / b\n"
        "| stats count by host, user\n| fields host, process_name"
    )
    assert one(text.spl_fields(F.col("q")), q=spl) == ["host", "process_name", "score", "user"]
    assert one(text.spl_conditions(F.col("q")), q=spl) == ["index=main sourcetype=wineventlog EventCode=1", "count > 10"]
    assert one(text.spl_cim_models(F.col("q")), q=spl) == ["Authentication", "Endpoint.Processes"]
    sources = one(text.spl_log_sources(F.col("q")), q=spl)
    assert [(s.product, s.service) for s in sources] == [("index=main", None), (None, "wineventlog")]


def test_kql_features(one):
    kql = "// note\nSecurityEvent\n| where EventID == 4688\n  and Account contains 'x'\n| project TimeGenerated,\n Account"
    assert one(text.kql_tables(F.col("q")), q=kql) == ["SecurityEvent"]
    assert one(text.kql_platforms(F.col("t")), t=["SecurityEvent", "SigninLogs", "Other"]) == ["cloud", "windows"]
    assert {"EventID", "Account", "TimeGenerated"} <= set(one(text.kql_fields(F.col("q")), q=kql))


def test_comparisons_end_where_words_do(one):
    kql = "SigninLogs\n| where Ip in~ ('a') and Port >= 5 and User !has 'x' or Inbox has_any (y)\n| where Containsx between (1 .. 2)"
    assert one(text.kql_fields(F.col("q")), q=kql) == ["Containsx", "Inbox", "Ip", "Port", "User"]
    eql = "process where process.pid > 4 and not user.name in (\"a\") and file.path like~ \"b\" and host.inside.x: \"c\" and net.a not in (1)"
    assert one(text.eql_fields(F.col("q")), q=eql) == ["file.path", "host.inside.x", "net.a", "process.pid", "user.name"]


def test_eql_features(one):
    eql = "sequence by host.id\n  process where process.name : \"a\" and user.id != 1"
    assert one(text.eql_fields(F.col("q")), q=eql) == ["process.name", "user.id"]
    assert one(text.eql_is_sequence(F.col("q")), q=eql) is True
    assert one(text.eql_platforms(F.col("q")), q=eql) == ["windows"]


def test_yara_features(one):
    rule = 'rule X : t1 {\n meta:\n  author = "me"\n  score = 70\n strings:\n  $b = "x"\n  $a = { 00 }\n condition:\n  $a or $b\n}\n'
    assert one(text.yara_meta(F.col("r")), r=rule) == {"author": "me", "score": "70"}
    assert one(text.yara_condition(F.col("r")), r=rule) == "$a or $b"
    assert one(text.yara_string_names(F.col("r")), r=rule) == ["$a", "$b"]


def test_kql_reads_every_table(one):
    kql = "SecurityEvent\n| where EventID == 1\nSigninLogs\n| project Time,\n  Account\n; union isfuzzy=true AuditLogs, DnsEvents | take 1"
    assert one(text.kql_tables(F.col("q")), q=kql) == ["SecurityEvent", "SigninLogs", "AuditLogs", "DnsEvents"]
    assert one(text.kql_tables(F.col("q")), q="let a = 1; SecurityEvent | where x") == ["SecurityEvent"]


def test_spl_terms_are_not_cut(one):
    spl = " ".join(f"index=i{n}" for n in range(9)) + " " + "x" * 300
    assert len(one(text.spl_log_sources(F.col("q")), q=spl)) == 9 and len(one(text.spl_log_sources(F.col("q"), 3), q=spl)) == 3
    assert one(text.spl_conditions(F.col("q")), q=spl) == [spl] and len(one(text.spl_conditions(F.col("q"), 200), q=spl)[0]) == 200

"""Configured lookup tables: keyword hints, data-source hints, weakness map, generic field map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from watchfloor.operators.mapping import KeywordHint, SourceHint
from watchfloor.operators.vulnerabilities import WEAKNESS_CONFIDENCE
from watchfloor.session import inline_table

# Keyword (or regular expression), techniques, confidence.
KEYWORD_HINTS = (
    KeywordHint("powershell -enc", ("T1059.001",), 0.85),
    KeywordHint("powershell -encodedcommand", ("T1059.001",), 0.90),
    KeywordHint("IEX(", ("T1059.001",), 0.85),
    KeywordHint("invoke-expression", ("T1059.001",), 0.80),
    KeywordHint("invoke-webrequest", ("T1059.001", "T1105"), 0.75),
    KeywordHint("net.webclient", ("T1059.001", "T1105"), 0.75),
    KeywordHint("downloadstring", ("T1059.001", "T1105"), 0.75),
    KeywordHint("cmd.exe /c", ("T1059.003",), 0.70),
    KeywordHint("wscript", ("T1059.005",), 0.75),
    KeywordHint("cscript", ("T1059.005",), 0.75),
    KeywordHint("bash -i", ("T1059.004",), 0.80),
    KeywordHint("python -c", ("T1059.006",), 0.80),
    KeywordHint("perl -e", ("T1059.006",), 0.75),
    KeywordHint("VirtualAllocEx", ("T1055",), 0.75),
    KeywordHint("WriteProcessMemory", ("T1055",), 0.85),
    KeywordHint("CreateRemoteThread", ("T1055.003",), 0.90),
    KeywordHint("SetWindowsHookEx", ("T1055.011",), 0.80),
    KeywordHint("QueueUserAPC", ("T1055.004",), 0.80),
    KeywordHint("NtUnmapViewOfSection", ("T1055.012",), 0.80),
    KeywordHint("mimikatz", ("T1003.001",), 0.95),
    KeywordHint("sekurlsa", ("T1003.001",), 0.95),
    KeywordHint("lsadump", ("T1003.001", "T1003.003"), 0.90),
    KeywordHint("privilege::debug", ("T1003.001",), 0.90),
    KeywordHint("ntdsutil", ("T1003.003",), 0.90),
    KeywordHint("vssadmin create shadow", ("T1003.003", "T1490"), 0.85),
    KeywordHint("reg save.*sam", ("T1003.002",), 0.85, is_regex=True),
    KeywordHint("mshta", ("T1218.005",), 0.85),
    KeywordHint("regsvr32", ("T1218.010",), 0.80),
    KeywordHint("rundll32", ("T1218.011",), 0.80),
    KeywordHint("certutil", ("T1140", "T1218.013"), 0.75),
    KeywordHint("wmic", ("T1047", "T1218.010"), 0.75),
    KeywordHint("msiexec", ("T1218.007",), 0.75),
    KeywordHint("installutil", ("T1218.004",), 0.80),
    KeywordHint("regasm", ("T1218.009",), 0.80),
    KeywordHint("certutil -decode", ("T1140",), 0.90),
    KeywordHint("certutil -urlcache", ("T1140", "T1105"), 0.90),
    KeywordHint("base64 -d", ("T1140",), 0.75),
    KeywordHint("[convert]::frombase64", ("T1140",), 0.80),
    KeywordHint("bitsadmin /transfer", ("T1197",), 0.85),
    KeywordHint("wget ", ("T1105",), 0.65),
    KeywordHint("curl ", ("T1105",), 0.60),
    KeywordHint("Win32_Process", ("T1047",), 0.80),
    KeywordHint("WmiPrvSE", ("T1047",), 0.75),
    KeywordHint("wmic process call create", ("T1047",), 0.90),
    KeywordHint("PSEXESVC", ("T1021.002",), 0.90),
    KeywordHint("psexec", ("T1021.002",), 0.85),
    KeywordHint("net use \\\\", ("T1021.002",), 0.75),
    KeywordHint("wevtutil cl", ("T1070.001",), 0.90),
    KeywordHint("clear-eventlog", ("T1070.001",), 0.85),
    KeywordHint("del /f /q", ("T1070.004",), 0.60),
    KeywordHint("password spray", ("T1110.003",), 0.90),
    KeywordHint("multiple failed", ("T1110",), 0.60),
    KeywordHint("eval(", ("T1505.003",), 0.65),
    KeywordHint("shell_exec", ("T1505.003",), 0.75),
    KeywordHint("nmap", ("T1046",), 0.85),
    KeywordHint("masscan", ("T1046",), 0.85),
    KeywordHint("portscan", ("T1046",), 0.80),
    KeywordHint("s3:GetObject", ("T1530",), 0.85),
    KeywordHint("GetBucketObject", ("T1530",), 0.80),
    KeywordHint("dns beaconing", ("T1071.004",), 0.85),
    KeywordHint("dga", ("T1568.002",), 0.80),
    KeywordHint("c2", ("T1071",), 0.50),
    KeywordHint("ransomware", ("T1486",), 0.85),
    KeywordHint(".locked", ("T1486",), 0.65),
)

# Log sources, keywords, techniques, confidence.
SOURCE_HINTS = (
    SourceHint(("process_creation",), ("certutil", "certutil.exe"), ("T1140", "T1105"), 0.75),
    SourceHint(("process_creation",), ("mshta", "mshta.exe"), ("T1218.005",), 0.85),
    SourceHint(("process_creation",), ("regsvr32",), ("T1218.010",), 0.80),
    SourceHint(("process_creation",), ("rundll32",), ("T1218.011",), 0.80),
    SourceHint(("process_creation",), ("wmic", "wmic.exe"), ("T1047",), 0.80),
    SourceHint(("process_creation",), ("powershell", "pwsh"), ("T1059.001",), 0.65),
    SourceHint(("process_creation",), ("cmd.exe", "cmd /c"), ("T1059.003",), 0.65),
    SourceHint(("process_creation",), ("wscript", "cscript"), ("T1059.005",), 0.75),
    SourceHint(("process_creation",), ("installutil", "regasm", "regsvcs"), ("T1218.004",), 0.80),
    SourceHint(("process_creation",), ("msiexec",), ("T1218.007",), 0.75),
    SourceHint(("process_creation",), ("ntdsutil",), ("T1003.003",), 0.85),
    SourceHint(("process_creation",), ("vssadmin",), ("T1003.003", "T1490"), 0.80),
    SourceHint(("process_access",), ("lsass.exe",), ("T1003.001",), 0.85),
    SourceHint(("process_access",), ("GrantedAccess", "OpenProcess"), ("T1003.001", "T1055"), 0.70),
    SourceHint(("file_creation", "file_event"), (".yar", ".ps1", ".vbs", ".hta"), ("T1105",), 0.60),
    SourceHint(("file_creation", "file_event"), ("shadow", "vss"), ("T1003.003",), 0.70),
    SourceHint(
        ("network_connection", "dns", "zeek:conn", "zeek:dns"), ("beacon", "beacon_score", "dc(query)"),
        ("T1071.004", "T1568.002"), 0.75,
    ),
    SourceHint(("network_connection",), ("bytes_out", "exfil", "bytes >"), ("T1041",), 0.65),
    SourceHint(("registry_event", "registry_set"), ("Run", "RunOnce", "CurrentVersion\\\\Run"), ("T1547.001",), 0.85),
    SourceHint(("registry_event", "registry_set"), ("HKLM\\\\SAM", "HKLM\\\\Security"), ("T1003.002",), 0.80),
    SourceHint(("security", "windows_event_log"), ("EventCode=4625", "EventID=4625", "4625"), ("T1110",), 0.75),
    SourceHint(("security", "windows_event_log"), ("EventCode=4688", "EventID=4688", "4688"), ("T1059",), 0.50),
    SourceHint(
        ("security", "windows_event_log"), ("EventCode=7045", "EventID=7045", "7045", "PSEXESVC", "ServiceName"),
        ("T1021.002", "T1543.003"), 0.80,
    ),
    SourceHint(("security", "windows_event_log"), ("EventCode=4697", "EventID=4697", "4697"), ("T1543.003",), 0.75),
    SourceHint(("AuditLogs", "azure_audit"), ("AddMember", "RoleAssignment"), ("T1098",), 0.75),
    SourceHint(("SigninLogs", "azure_signin"), ("ResultType", "failed", "4", "spray"), ("T1110.003",), 0.70),
    SourceHint(("AWSCloudTrail", "cloudtrail"), ("GetObject", "ListBuckets", "s3"), ("T1530",), 0.75),
)

# Weakness, techniques, confidence.
WEAKNESS_TECHNIQUES = (
    ("CWE-77", ("T1059",), 0.80),
    ("CWE-78", ("T1059", "T1059.003"), 0.85),
    ("CWE-89", ("T1190",), 0.80),
    ("CWE-94", ("T1059",), 0.75),
    ("CWE-917", ("T1059",), 0.85),
    ("CWE-434", ("T1105", "T1505.003"), 0.80),
    ("CWE-22", ("T1083",), 0.80),
    ("CWE-73", ("T1083",), 0.70),
    ("CWE-79", ("T1189",), 0.75),
    ("CWE-918", ("T1090",), 0.75),
    ("CWE-611", ("T1213",), 0.70),
    ("CWE-352", ("T1185",), 0.65),
    ("CWE-287", ("T1078",), 0.80),
    ("CWE-306", ("T1078.001",), 0.85),
    ("CWE-798", ("T1552.001",), 0.90),
    ("CWE-255", ("T1552",), 0.70),
    ("CWE-284", ("T1078",), 0.65),
    ("CWE-119", ("T1203",), 0.75),
    ("CWE-120", ("T1203",), 0.75),
    ("CWE-121", ("T1203",), 0.75),
    ("CWE-122", ("T1203",), 0.75),
    ("CWE-416", ("T1203", "T1055"), 0.70),
    ("CWE-190", ("T1203",), 0.65),
    ("CWE-502", ("T1059", "T1190"), 0.80),
    ("CWE-269", ("T1068",), 0.80),
    ("CWE-732", ("T1222",), 0.65),
    ("CWE-327", ("T1040",), 0.60),
    ("CWE-200", ("T1213",), 0.65),
    ("CWE-312", ("T1552",), 0.65),
    ("CWE-20", ("T1190",), 0.60),
    ("CWE-276", ("T1222",), 0.65),
    ("CWE-400", ("T1499",), 0.60),
    ("CWE-862", ("T1078",), 0.70),
    ("CWE-863", ("T1078",), 0.70),
)

# Where the generic reader finds each record field, as paths into the document.
GENERIC_FIELDS = {
    "id": "rule_id", "name": "title", "description": "desc", "author": "author", "severity": "risk_level",
    "query": "detection.search", "techniques": "tags.attack", "platforms": "os", "tags": "tags.source",
    "false_positives": "false_positives", "version": "version", "cves": "cves",
}
GENERIC_DEFAULTS = {"source_format": "custom", "severity": "medium", "language": "unknown", "author": "unknown"}


def _as_tuple(value) -> tuple[str, ...]:
    if value is None:
        return ()
    return (value,) if isinstance(value, str) else tuple(str(v) for v in value)


def _document(spark: SparkSession, path: str) -> dict:
    """A small YAML configuration file, read through Spark so that any file system works."""
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first().value) or {}


def keyword_hints(spark: SparkSession, path: str | None = None) -> tuple[KeywordHint, ...]:
    if path is None:
        return KEYWORD_HINTS
    return tuple(
        KeywordHint(
            e.get("keyword", ""), _as_tuple(e.get("techniques")), float(e.get("confidence", 0.65)),
            bool(e.get("regex", False)),
        )
        for e in _document(spark, path).get("entries") or []
    )


def source_hints(spark: SparkSession, path: str | None = None) -> tuple[SourceHint, ...]:
    if path is None:
        return SOURCE_HINTS
    return tuple(
        SourceHint(
            _as_tuple(h.get("log_sources")), _as_tuple(h.get("keywords")), _as_tuple(h.get("techniques")),
            float(h.get("confidence", 0.60)),
        )
        for h in _document(spark, path).get("hints") or []
    )


def weakness_map(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(cwe_id, technique_id, confidence) as a small constant table."""
    entries = WEAKNESS_TECHNIQUES
    if path is not None:
        entries = tuple(
            (m.get("cwe_id", ""), _as_tuple(m.get("techniques")), float(m.get("confidence", WEAKNESS_CONFIDENCE)))
            for m in _document(spark, path).get("mappings") or []
        )
    rows = [(cwe, technique, confidence) for cwe, techniques, confidence in entries for technique in techniques]
    return inline_table(spark, rows, {"cwe_id": "STRING", "technique_id": "STRING", "confidence": "DOUBLE"})


def field_map(spark: SparkSession, path: str | None = None) -> tuple[dict[str, str], dict[str, str]]:
    """(paths, defaults) of the generic reader; a configured file overrides single entries."""
    if path is None:
        return dict(GENERIC_FIELDS), dict(GENERIC_DEFAULTS)
    document = _document(spark, path)
    identity = {name: name for name in GENERIC_FIELDS}
    return {**identity, **(document.get("field_map") or {})}, document.get("defaults") or {}

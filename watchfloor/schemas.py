"""Declared schemas (DDL text) of the tables the operators exchange; nothing is inferred at run time."""

from __future__ import annotations

SCHEMA_VERSION = "1.0"

# Enumerations of the record model.
SEVERITIES = ("info", "low", "med", "high", "critical")
RULE_FORMATS = (
    "sigma", "splunk-spl", "kql", "yara", "elastic-eql", "snort", "suricata", "custom",
    "spl", "es-query", "yara-l", "unknown",
)
PLATFORMS = ("windows", "linux", "macos", "cloud", "network", "containers")
VALIDATION_STATUSES = ("untested", "passed", "failed", "needs_review")
DEPLOYMENT_STATUSES = ("deployed", "disabled", "archived", "failed")
TEST_TYPES = ("atomic_red_team", "synthetic", "linter")
MATURITY_LABELS = {
    "0": "No detection / placeholder — rule exists in name only",
    "1": "Untested — broad query filed, high false-positive risk, no review",
    "2": "Basic — query narrowed, false-positive notes documented, linting passes",
    "3": "Moderate — validated with synthetic events, CI gate in place",
    "4": "Good — validated against live ART telemetry, FP rate measured and tracked",
    "5": "Excellent — continuous validation in prod, threat-intel mapped, peer reviewed",
}

TECHNIQUE = "technique_id STRING, sub_technique_id STRING, tactic STRING, confidence DOUBLE, name STRING, url STRING"
CVE_REFERENCE = "cve_id STRING, confidence DOUBLE, cvss_score DOUBLE, description STRING"
LOG_SOURCE = "product STRING, category STRING, service STRING, definition STRING"
DEPLOYMENT = (
    "backend STRING, deployed_at TIMESTAMP, rule_version STRING, status STRING, deployed_by STRING, "
    "commit_sha STRING, backend_rule_id STRING, notes STRING"
)
LOGIC = (
    "raw STRING, language STRING, ast STRING, normalized_conditions ARRAY<STRING>, field_references ARRAY<STRING>"
)


# ``ast`` is recursive, which Spark types cannot express; it travels as JSON text.
DETECTION = (
    "id STRING, name STRING, description STRING, author ARRAY<STRING>, version STRING, created_at TIMESTAMP, "
    "modified_at TIMESTAMP, severity STRING, source_format STRING, platforms ARRAY<STRING>, tags ARRAY<STRING>, "
    f"detection_logic STRUCT<{LOGIC}>, "
    f"log_sources ARRAY<STRUCT<{LOG_SOURCE}>>, "
    f"mitre_techniques ARRAY<STRUCT<{TECHNIQUE}>>, "
    f"cve_references ARRAY<STRUCT<{CVE_REFERENCE}>>, "
    "data_components ARRAY<STRING>, false_positive_notes ARRAY<STRING>, cim_models ARRAY<STRING>, "
    "validation_status STRING, last_validated TIMESTAMP, detection_maturity_score INT, portability_score DOUBLE, "
    "siem_native MAP<STRING, STRING>, "
    "deployment_history ARRAY<STRUCT<"
    f"{DEPLOYMENT}>>"
)

# Telemetry: the fields rules refer to most are columns, every other key lands in ``attrs``.
EVENT_FIELDS = (
    "technique", "key", "source", "host", "vm", "type", "exe", "comm", "proctitle", "cmd_output", "message", "raw",
    "a0", "a1", "a2", "uid", "pid", "cwd", "name", "syscall", "syscall_name",
)
EVENT = (
    "timestamp TIMESTAMP, " + ", ".join(f"`{f}` STRING" for f in EVENT_FIELDS)
    + ", serial BIGINT, returncode INT, attrs MAP<STRING, STRING>"
)

# Normalised event: the wider record that labelled tests exchange.
CANONICAL_EVENT = (
    "id STRING, timestamp TIMESTAMP, source_host STRING, event_type STRING, platform STRING, process_name STRING, "
    "process_id INT, process_guid STRING, parent_process_name STRING, parent_process_id INT, "
    "parent_process_guid STRING, command_line STRING, user STRING, working_directory STRING, integrity_level STRING, "
    "src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING, dns_query STRING, bytes_sent BIGINT, "
    "bytes_received BIGINT, file_path STRING, file_name STRING, file_hash_md5 STRING, file_hash_sha256 STRING, "
    "file_hash_sha1 STRING, registry_key STRING, registry_value_name STRING, registry_value_data STRING, "
    "sysmon_event_id INT, windows_event_id INT, raw STRING, mitre_techniques ARRAY<STRING>, scenario_id STRING, "
    "is_synthetic BOOLEAN"
)

RULE_RESULT = (
    "rule_id STRING, name STRING, techniques ARRAY<STRING>, siem STRING, query STRING, hits BIGINT, status STRING, "
    "error STRING, samples ARRAY<MAP<STRING, STRING>>"
)

VALIDATION_RESULT = (
    "detection_id STRING, detection_name STRING, backend STRING, test_type STRING, passed BOOLEAN, "
    "timestamp TIMESTAMP, duration_seconds DOUBLE, technique_ids ARRAY<STRING>, alert_found BOOLEAN, "
    "false_negative BOOLEAN, false_positive_rate DOUBLE, error STRING, evidence ARRAY<MAP<STRING, STRING>>, "
    "test_details STRING, backend_query_used STRING"
)

CVE_RECORD = (
    "cve_id STRING, description STRING, cvss_score DOUBLE, cvss_vector STRING, cvss_version STRING, severity STRING, "
    "cwes ARRAY<STRING>, cpes ARRAY<STRING>, published STRING, modified STRING"
)

MIGRATION = (
    "detection_id STRING, detection_name STRING, source_siem STRING, target_siem STRING, analyzed_at TIMESTAMP, "
    "translatable BOOLEAN, confidence DOUBLE, translated_query STRING, coverage_gaps ARRAY<STRING>, "
    "warnings ARRAY<STRING>, errors ARRAY<STRING>, "
    "field_mapping_issues ARRAY<STRUCT<source_field: STRING, target_field: STRING, issue: STRING>>, "
    "manual_review_required BOOLEAN, estimated_effort STRING, notes STRING"
)

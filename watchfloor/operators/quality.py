"""Checks on rule records: validity, lint findings, schema version, findings of a result set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfloor.functions.ids import BASE_TECHNIQUE, FULL_CVE, SUB_TECHNIQUE
from watchfloor.schemas import PLATFORMS, RULE_FORMATS, SCHEMA_VERSION, SEVERITIES, VALIDATION_STATUSES

# Fields a record of schema 1.0 must carry.
REQUIRED_FIELDS = ("id", "name", "detection_logic")


def violations(checks: Mapping[str, Column]) -> Column:
    """Names of the checks a row fails; a check that is null counts as passed."""
    return F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in checks.items()]))


def split_rejects(rows: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with ``violations``)."""
    marked = rows.withColumn("violations", violations(checks))
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def _outside(value: Column, low: float, high: float) -> Column:
    return (value < low) | (value > high)


def detection_checks() -> dict[str, Column]:
    """Range, pattern and enumeration checks of a canonical rule record."""
    return {
        "name": F.coalesce(F.length("name"), F.lit(0)) == 0,
        "severity": ~F.col("severity").isin(*SEVERITIES),
        "source_format": ~F.col("source_format").isin(*RULE_FORMATS),
        "validation_status": ~F.col("validation_status").isin(*VALIDATION_STATUSES),
        "platforms": F.exists("platforms", lambda p: ~p.isin(*PLATFORMS)),
        "portability_score": _outside(F.col("portability_score"), 0, 100),
        "log_sources": F.exists(
            "log_sources", lambda s: F.coalesce(s["product"], s["category"], s["service"], s["definition"]).isNull()
        ),
        "technique_id": F.exists(
            "mitre_techniques",
            lambda t: ~t["technique_id"].rlike(BASE_TECHNIQUE) | ~t["sub_technique_id"].rlike(SUB_TECHNIQUE),
        ),
        "technique_confidence": F.exists("mitre_techniques", lambda t: _outside(t["confidence"], 0, 1)),
        "cve_id": F.exists("cve_references", lambda c: ~c["cve_id"].rlike(FULL_CVE)),
        "cve_confidence": F.exists("cve_references", lambda c: _outside(c["confidence"], 0, 1)),
        "cvss_score": F.exists("cve_references", lambda c: _outside(c["cvss_score"], 0, 10)),
    }


def event_checks() -> dict[str, Column]:
    return {
        "event_type": F.col("event_type").isNull(),
        "platform": ~F.col("platform").isin(*PLATFORMS),
        "src_port": _outside(F.col("src_port"), 0, 65535),
        "dst_port": _outside(F.col("dst_port"), 0, 65535),
    }


def gap_checks() -> dict[str, Column]:
    return {
        "technique_id": ~F.col("technique_id").rlike(BASE_TECHNIQUE),
        "priority_score": _outside(F.col("priority_score"), 0, 10),
    }


def clamp(rows: DataFrame) -> DataFrame:
    """Repairs applied on ingest: maturity into 0..5, tags deduplicated in order."""
    return rows.withColumns(
        {
            "detection_maturity_score": F.greatest(F.lit(0), F.least(F.lit(5), "detection_maturity_score")),
            "tags": F.array_distinct("tags"),
        }
    )


def check_shape(rows: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """Adds ``schema_error``: an unknown version, or the required fields that are missing."""
    version = F.coalesce("schema_version", F.lit(SCHEMA_VERSION)) if "schema_version" in rows.columns else F.lit(
        SCHEMA_VERSION
    )
    missing = violations({name: F.col(name).isNull() for name in required})
    return rows.withColumn(
        "schema_error",
        F.when(version != SCHEMA_VERSION, F.concat(F.lit("unknown schema version "), version)).when(
            F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ", "))
        ),
    )


def lint(per_rule: DataFrame, checks: Mapping[str, Column], key: str) -> DataFrame:
    """(key, code): one row per finding."""
    return per_rule.select(key, F.explode(violations(checks)).alias("code"))


def lint_records(records: DataFrame, techniques: DataFrame, max_techniques: int = 20) -> DataFrame:
    """(id, code) over canonical records: no technique, over-broad, or a technique that is unknown or deprecated.

    A rule is over-broad when it names no field, no condition and no keyword, or binds more techniques than allowed.
    """
    ids = F.transform("mitre_techniques", lambda t: F.coalesce(t["sub_technique_id"], t["technique_id"]))
    unspecific = (
        (F.size("detection_logic.field_references") == 0)
        & (F.size("detection_logic.normalized_conditions") == 0)
        & ~F.contains("detection_logic.raw", F.lit("keywords"))
    )
    own = lint(
        records,
        {"missing_technique": F.size("mitre_techniques") == 0,
         "over_broad": unspecific | (F.size("mitre_techniques") > max_techniques)},
        "id",
    )
    bound = records.select("id", F.explode(F.array_distinct(ids)).alias("technique_id"))
    known = techniques.select("technique_id", "deprecated", F.lit(True).alias("known"))
    checked = bound.join(known, "technique_id", "left").groupBy("id").agg(
        F.max(F.col("known").isNull()).alias("unknown"), F.max(F.coalesce("deprecated", F.lit(False))).alias("deprecated")
    )
    return own.unionByName(
        lint(checked, {"unknown_technique": F.col("unknown"), "deprecated_technique": F.col("deprecated")}, "id")
    )


def findings(results: DataFrame) -> DataFrame:
    """One finding per failed or errored rule, once per rule id: level and message."""
    techniques = F.coalesce(F.nullif(F.array_join("techniques", ", "), F.lit("")), F.lit("(none)"))
    message = F.when(
        F.col("status") == "error",
        F.concat(F.lit("Validation error: "), F.coalesce("error", F.lit("unknown error"))),
    ).otherwise(
        F.concat(
            F.lit("Detection rule did not fire against live telemetry. Techniques: "), techniques,
            F.lit(". Query: "), F.coalesce("query", F.lit("")), F.lit("."),
        )
    )
    return results.filter(F.col("status").isin("fail", "error")).select(
        "rule_id",
        F.when(F.col("status") == "error", "error").otherwise("warning").alias("level"),
        message.alias("message"),
    )


def finding_rules(results: DataFrame, pos: str) -> DataFrame:
    """One descriptor per distinct rule id, the first in ``pos`` order."""
    first = results.groupBy("rule_id").agg(F.min_by(F.struct("name", "techniques", "query"), F.col(pos)).alias("r"))
    described = F.when(
        F.size("r.techniques") > 0,
        F.concat(
            F.lit("ATT&CK: "), F.array_join("r.techniques", ", "), F.lit(". Query: "),
            F.coalesce("r.query", F.lit("")), F.lit("."),
        ),
    ).otherwise(F.coalesce("r.query", F.lit("")))
    return first.select("rule_id", F.col("r.name").alias("name"), described.alias("description"),
                        F.col("r.techniques").alias("tags"))

"""Rules as queries for other systems: a table of texts and payloads, nothing is sent anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfloor.functions.ids import technique_ids
from watchfloor.functions.labels import SEVERITY_TO_SIGMA_LEVEL
from watchfloor.session import lookup

# One severity scale for reading and writing.
SEVERITY_NUMBERS = {"info": "1", "low": "2", "med": "3", "high": "4", "critical": "5"}
HOURLY = "0 * * * *"


def _any_of(ids: Column, template: str, joiner: str) -> Column:
    before, after = template.split("{}")
    return F.array_join(F.transform(ids, lambda t: F.concat(F.lit(before), t, F.lit(after))), joiner)


def _distinct_tactics(bindings: Column) -> Column:
    named = F.filter(bindings, lambda t: t["tactic"].isNotNull() & ~t["tactic"].isin("", "unknown"))
    return F.array_distinct(F.transform(named, lambda t: t["tactic"]))


def sigma_tags(bindings: Column, references: Column) -> Column:
    """Tag list of a rule: tactics, techniques, then CVEs."""
    tactics = F.transform(_distinct_tactics(bindings), lambda t: F.concat(F.lit("attack."), F.lower(t)))
    techniques = F.transform(technique_ids(bindings), lambda t: F.concat(F.lit("attack."), F.lower(t)))
    cves = F.transform(
        references, lambda r: F.replace(F.lower(r["cve_id"]), F.lit("-"), F.lit("."))
    )
    return F.concat(tactics, techniques, cves)


def _number(severity: Column) -> Column:
    return F.coalesce(lookup(SEVERITY_NUMBERS, severity), F.lit("3"))


def target_queries(detections: DataFrame, index: str) -> DataFrame:
    """Each rule as a saved-search stanza, a table-query filter and a Sigma tag list, one row per rule."""
    ids = technique_ids(F.col("mitre_techniques"))
    has_ids = F.size(ids) > 0
    described = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("name"))
    spl_filter = F.when(has_ids, _any_of(ids, 'technique="{}"', " OR ")).otherwise(F.lit(f"index={index}"))
    spl = F.concat(
        F.lit("["), F.col("name"), F.lit(f"]\nsearch = index={index} ("), spl_filter,
        F.lit(') | eval detection="'), F.col("name"),
        F.lit('" | table _time, technique, key, exe, uid, cmd_output\nalert.severity = '), _number(F.col("severity")),
        F.lit("\ndescription = "), described, F.lit("\n"),
    )
    kql = F.concat(
        F.lit("// "), F.col("name"), F.lit("\n"),
        F.when(has_ids, _any_of(ids, 'technique: "{}"', " or ")).otherwise("* | where isnotempty(technique)"),
        F.lit("\n"),
    )
    return detections.select(
        "id", "name", sigma_tags(F.col("mitre_techniques"), F.col("cve_references")).alias("sigma_tags"),
        F.coalesce(lookup(SEVERITY_TO_SIGMA_LEVEL, F.col("severity")), F.lit("medium")).alias("sigma_level"),
        spl.alias("spl"), kql.alias("kql"),
    )


def bounded(text: Column, most: int | None) -> Column:
    """``text`` within ``most`` characters; a longer one ends in a hash of the whole, so that different texts stay different."""
    if most is None:
        return text
    ending = F.concat(F.lit("-"), F.substring(F.sha2(text, 256), 1, 12))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 13)), ending))


def monitor_payloads(
    detections: DataFrame, index: str, name_length: int | None = None, trigger_length: int | None = None
) -> DataFrame:
    """(id, payload): an hourly query-level monitor per rule, as JSON. The lengths are limits of the receiving system."""
    ids = technique_ids(F.col("mitre_techniques"))
    terms = F.transform(ids, lambda t: F.struct(F.struct(t.alias("technique.keyword")).alias("term")))
    any_term = F.struct(
        F.struct(terms.alias("should"), F.lit(1).alias("minimum_should_match")).alias("bool")
    )
    everything = F.struct(F.create_map().cast("map<string,string>").alias("match_all"))
    query = F.when(F.size(ids) > 0, F.to_json(any_term)).otherwise(F.to_json(everything))
    payload = F.struct(
        F.lit("monitor").alias("type"),
        bounded(F.col("name"), name_length).alias("name"),
        F.lit("query_level_monitor").alias("monitor_type"),
        F.lit(True).alias("enabled"),
        F.struct(F.struct(F.lit(1).alias("interval"), F.lit("HOURS").alias("unit")).alias("period")).alias("schedule"),
        F.array(F.lit(index)).alias("indices"),
        F.parse_json(query).alias("query"),
        bounded(F.col("id"), trigger_length).alias("trigger_id"),
        F.lit("ctx.results[0].hits.total.value > 0").alias("trigger_condition"),
    )
    return detections.select("id", F.to_json(payload).alias("payload"))


def saved_searches(detections: DataFrame, index: str, name_length: int | None = None) -> DataFrame:
    """Scheduled saved-search parameters per rule, alerting on any hit."""
    ids = technique_ids(F.col("mitre_techniques"))
    terms = _any_of(ids, 'technique="{}"', " OR ")
    return detections.select(
        "id",
        bounded(F.col("name"), name_length).alias("name"),
        F.concat(F.lit(f"index={index} "), terms, F.lit(" | table _time, technique, key, exe, uid")).alias("search"),
        F.coalesce("description", F.lit("")).alias("description"),
        _number(F.col("severity")).alias("alert_severity"),
        F.lit(HOURLY).alias("cron_schedule"),
        F.lit("number of events").alias("alert_type"),
        F.lit("greater than").alias("alert_comparator"),
        F.lit(0).alias("alert_threshold"),
    )

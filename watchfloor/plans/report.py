"""Map, enrich and report on a corpus of canonical records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfloor.functions.ids import cves_from_tags
from watchfloor.operators import coverage, enrich, knowledge, mapping
from watchfloor.operators import vulnerabilities as vuln
from watchfloor.sources.lookups import KEYWORD_HINTS, SOURCE_HINTS, weakness_map
from watchfloor.sources.records import collapse_bindings, explode_bindings, explode_references

MODES = ("explicit", "inferred", "hybrid")


@dataclass(frozen=True)
class Mapped:
    """Outcome of the mapping step: new records, every proposed binding, and the messages per rule."""

    records: DataFrame
    bindings: DataFrame
    messages: DataFrame


def rule_text() -> Column:
    return F.lower(F.concat_ws(" ", "name", "description", "detection_logic.raw"))


def log_source_names() -> Column:
    parts = F.flatten(F.transform("log_sources", lambda s: F.array(s["product"], s["category"], s["service"])))
    return F.transform(F.filter(parts, lambda p: p.isNotNull()), F.lower)


def map_corpus(
    records: DataFrame,
    techniques: DataFrame,
    revoked_by: DataFrame | None = None,
    mode: str = "hybrid",
    keyword_hints: Sequence[mapping.KeywordHint] = KEYWORD_HINTS,
    source_hints: Sequence[mapping.SourceHint] = SOURCE_HINTS,
    candidates: DataFrame | None = None,
    min_confidence: float = mapping.MIN_APPLY_CONFIDENCE,
) -> Mapped:
    """Validate declared techniques, infer missing ones, and write the accepted set back to the records."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    current = explode_bindings(records)
    columns = ["detection_id", "technique_id", "tactic", "confidence", "source", "pos"]
    checked = None
    parts = []
    if mode in ("explicit", "hybrid"):
        swaps = None if revoked_by is None else knowledge.replacements(techniques, revoked_by, "stix_id").filter(
            F.col("replacement").isNotNull()
        )
        checked = mapping.validate_explicit(current, techniques, swaps)
        parts.append(checked.filter(F.col("error").isNull()).select(*columns))
    if mode in ("inferred", "hybrid"):
        guessed = mapping.infer(
            records.select(F.col("id").alias("detection_id"), rule_text().alias("_text"),
                           log_source_names().alias("_sources")),
            ["detection_id"], F.col("_text"), keyword_hints, source_hints, F.col("_sources"),
        )
        guessed = mapping.known_and_active(guessed, techniques)
        if candidates is not None:
            guessed = guessed.unionByName(
                mapping.usable_candidates(candidates, techniques, "detection_id").select(*guessed.columns)
            )
            best_first = F.when(F.col("source") == "candidate", 1).otherwise(0)
            guessed = mapping.first_wins(guessed, ["detection_id", "technique_id"], [best_first, -F.col("confidence")],
                                         ["tactic", "confidence", "source"])
        if parts:
            guessed = mapping.gap_fill(guessed, parts[0], ["detection_id", "technique_id"])
        # Inferred bindings rank behind declared ones, by confidence.
        parts.append(guessed.withColumn("pos", (F.lit(1_000_000) - F.round(F.col("confidence") * 1000)).cast("int"))
                     .select(*columns))
    proposed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    proposed = mapping.first_wins(
        proposed, ["detection_id", "technique_id"], [F.col("pos")], ["tactic", "confidence", "source", "pos"]
    )
    accepted = mapping.apply_bindings(current, proposed, "detection_id", min_confidence)
    messages = records.select(F.col("id").alias("detection_id"), F.lit(None).cast("string").alias("error"),
                              F.array().cast("array<string>").alias("warnings")).limit(0)
    if checked is not None:
        messages = checked.filter(F.col("error").isNotNull() | (F.size("warnings") > 0)).select(
            "detection_id", "error", "warnings"
        )
    return Mapped(_replace(records, collapse_bindings(accepted)), proposed, messages)


def _replace(records: DataFrame, arrays: DataFrame) -> DataFrame:
    """Records with ``mitre_techniques`` taken from ``arrays``; rules without any get an empty list."""
    kind = records.schema["mitre_techniques"].dataType
    columns = records.columns
    joined = records.drop("mitre_techniques").join(arrays, "id", "left")
    return joined.withColumn("mitre_techniques", F.coalesce("mitre_techniques", F.array().cast(kind))).select(*columns)


def enrich_corpus(records: DataFrame, techniques: DataFrame | None, cves: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(enriched records, one row of counters). Either table may be missing; its pass is then left out."""
    out = records
    tallies = []
    if techniques is not None:
        filled = enrich.fill_techniques(
            explode_bindings(records).drop("name").withColumnRenamed("technique_name", "name"), techniques
        )
        tallies.append(enrich.counters(filled, techniques_enriched=F.col("enriched"),
                                       warnings=F.col("warning").isNotNull()))
        out = _replace(out, collapse_bindings(filled.withColumnRenamed("name", "technique_name")))
    if cves is not None:
        tagged = records.select(F.col("id").alias("detection_id"), F.explode(cves_from_tags(F.col("tags"))).alias("cve_id"))
        merged = enrich.add_references(
            explode_references(records), tagged.withColumn("confidence", F.lit(1.0)).distinct(),
            ["detection_id", "cve_id"],
        )
        filled = enrich.fill_references(merged, cves)
        tallies.append(enrich.counters(filled, references_added=F.col("added"), references_enriched=F.col("enriched")))
        reference = F.struct("cve_id", "confidence", "cvss_score", "description")
        arrays = filled.groupBy(F.col("detection_id").alias("id")).agg(
            F.array_sort(F.collect_list(reference)).alias("cve_references")
        )
        columns = out.columns
        kind = records.schema["cve_references"].dataType
        out = out.drop("cve_references").join(arrays, "id", "left").withColumn(
            "cve_references", F.coalesce("cve_references", F.array().cast(kind))
        ).select(*columns)
        scores = filled.filter(F.col("cvss_score").isNotNull()).select(
            F.col("detection_id").alias("id"), F.col("cvss_score").alias("score")
        )
        derived = enrich.derive_severity(out, scores, "id")
        tallies.append(enrich.counters(derived, severities_updated=F.col("severity_updated")))
        out = derived.select(*columns)
    counts = records.sparkSession.sql("SELECT 1 AS one")
    for tally in tallies:
        counts = counts.select("*", *[tally.select(c).scalar().alias(c) for c in tally.columns])
    return out, counts.drop("one")


def coverage_tables(records: DataFrame, techniques: DataFrame) -> dict[str, DataFrame]:
    """Matrix, layer, per-tactic coverage, score, gaps and badge of a corpus."""
    bindings = explode_bindings(records)
    status = records.select(F.col("id").alias("detection_id"), "validation_status",
                            F.col("detection_maturity_score").alias("maturity"))
    passed = bindings.join(status.filter(F.col("validation_status") == "passed"), "detection_id", "left_semi")
    flags = coverage.technique_flags(bindings, passed, "technique_id")
    pairs = coverage.rule_pairs(bindings, ["technique_id", "name"], "detection_id", "confidence")
    named = pairs.groupBy("technique_id", "name").agg(F.max("confidence").alias("confidence"))
    return {
        "matrix": coverage.coverage_matrix(bindings),
        "layer": coverage.layer_rows(
            coverage.rules_per_technique(named, ["technique_id"], "name", coverage.NAMES_IN_COMMENT)
        ),
        "tactics": coverage.tactic_coverage(
            flags.join(techniques.select("technique_id", "tactic"), "technique_id", "left"),
            F.coalesce("tactic", F.lit("unknown")),
        ),
        "entries": coverage.coverage_entries(pairs, status, "technique_id", "detection_id"),
        "score": coverage.coverage_score(techniques, flags.withColumnRenamed("covered", "validated"), "technique_id"),
        "gaps": coverage.gaps(techniques, bindings, "technique_id"),
        "badge": coverage.badge(flags, status, F.col("validation_status") == "passed"),
    }


def cve_coverage(records: DataFrame, cves: DataFrame, min_risk: float = 0.0,
                 granularity: str = "parent") -> tuple[DataFrame, DataFrame]:
    """(one row per CVE by residual risk, (CVE, technique) rows with their coverage).

    ``cves`` is ``vulnerabilities.merge_feeds`` output with ``cwes``, ``techniques``, ``cvss_score`` and ``epss``.
    """
    direct = vuln.direct_techniques(cves.filter(F.col("techniques").isNotNull()))
    weak = vuln.weakness_techniques(
        cves.select("cve_id", F.explode("cwes").alias("cwe_id")), weakness_map(cves.sparkSession)
    )
    columns = ["cve_id", "technique_id", "confidence", "source"]
    bound = vuln.merge_techniques(
        direct.select(*columns).unionByName(weak.select(*columns)), ["cve_id", "technique_id"], ["ctid", "cwe"],
        "confidence",
    )
    flagged = vuln.flag_covered(bound, explode_bindings(records), granularity)
    counts = vuln.coverage_per_cve(flagged, "cve_id")
    scored = vuln.with_residual_risk(cves.join(counts, "cve_id", "left"))
    ranked = scored.filter(F.col("residual_risk") >= min_risk).select(
        "cve_id", "cvss_score", "epss", F.coalesce("in_kev", F.lit(False)).alias("in_kev"),
        F.coalesce("n", F.lit(0)).alias("techniques"), F.coalesce("covered", F.lit(0)).alias("covered"),
        "coverage_ratio", "residual_risk",
    )
    return ranked.orderBy(F.col("residual_risk").desc(), "cve_id"), flagged

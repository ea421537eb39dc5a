"""Technique and CVE identifiers: canonical forms, extraction from text, typed arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier patterns and link format.
TECHNIQUE_PATTERN = r"(?i)(?:attack\.)?t(\d{4})(?:\.(\d{3}))?(?!\d)"
TACTIC_ID_PATTERN = r"(?i)^(?:attack\.)?ta\d{4}$"
CVE_PATTERN = r"(?i)cve[-._](\d{4})[-._](\d{4,})"
CVE_TAG_PATTERN = r"(?i)cve\.(\d{4})\.(\d+)"
FULL_TECHNIQUE = r"^T\d{4}(\.\d{3})?$"
BASE_TECHNIQUE = r"^T\d{4}$"
SUB_TECHNIQUE = r"^T\d{4}\.\d{3}$"
FULL_CVE = r"^CVE-\d{4}-\d{4,}$"
TECHNIQUE_URL = "https://attack.mitre.org/techniques/"


def canonical_technique(raw: Column) -> Column:
    """``attack.t1059.001`` -> ``T1059.001``; null for tactic ids and anything without a technique."""
    text = F.trim(raw)
    base = F.regexp_extract(text, TECHNIQUE_PATTERN, 1)
    sub = F.regexp_extract(text, TECHNIQUE_PATTERN, 2)
    found = (base != "") & ~text.rlike(TACTIC_ID_PATTERN)
    return F.when(found & (sub != ""), F.concat(F.lit("T"), base, F.lit("."), sub)).when(
        found, F.concat(F.lit("T"), base)
    )


def canonical_cve(raw: Column) -> Column:
    """``cve.2021.44228`` or ``CVE_2021_44228`` -> ``CVE-2021-44228``; null when no id is present."""
    year = F.regexp_extract(raw, CVE_PATTERN, 1)
    return F.when(year != "", F.concat(F.lit("CVE-"), year, F.lit("-"), F.regexp_extract(raw, CVE_PATTERN, 2)))


def _groups(text: Column, pattern: str) -> tuple[Column, Column]:
    return tuple(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) for group in (1, 2))


def techniques_in_text(text: Column) -> Column:
    """Distinct canonical technique ids of a text, in order of first appearance."""

    def join(base: Column, sub: Column) -> Column:
        return F.concat(F.lit("T"), base, F.when(sub == "", "").otherwise(F.concat(F.lit("."), sub)))

    return F.array_distinct(F.zip_with(*_groups(text, TECHNIQUE_PATTERN), join))


def cves_in_text(text: Column) -> Column:
    """Distinct canonical CVE ids of a text, in order of first appearance."""

    def join(year: Column, number: Column) -> Column:
        return F.concat(F.lit("CVE-"), year, F.lit("-"), number)

    return F.array_distinct(F.zip_with(*_groups(text, CVE_PATTERN), join))


def cves_from_tags(tags: Column) -> Column:
    """CVE ids of ``cve.YYYY.N`` tags; the number may be shorter than four digits."""

    def one(tag: Column) -> Column:
        return F.concat(
            F.lit("CVE-"), F.regexp_extract(tag, CVE_TAG_PATTERN, 1), F.lit("-"),
            F.regexp_extract(tag, CVE_TAG_PATTERN, 2),
        )

    return F.transform(F.filter(tags, lambda tag: tag.rlike(CVE_TAG_PATTERN)), one)


def parent_technique(technique: Column) -> Column:
    return F.substring_index(technique, ".", 1)


def full_technique(binding: Column) -> Column:
    """Sub-technique id of a binding struct when present, else its base id."""
    return F.coalesce(binding["sub_technique_id"], binding["technique_id"])


def technique_ids(bindings: Column) -> Column:
    return F.transform(bindings, full_technique)


def technique_url(technique: Column) -> Column:
    return F.concat(F.lit(TECHNIQUE_URL), F.replace(technique, F.lit("."), F.lit("/")), F.lit("/"))


def technique_structs(ids: Column, tactic: Column | None = None, confidence: float = 0.8) -> Column:
    """Binding structs for raw ids; invalid ids are dropped, repeats are kept."""
    tactic = F.lit("unknown") if tactic is None else tactic

    def one(technique: Column) -> Column:
        return F.struct(
            parent_technique(technique).alias("technique_id"),
            F.when(F.contains(technique, F.lit(".")), technique).alias("sub_technique_id"),
            tactic.alias("tactic"),
            F.lit(confidence).alias("confidence"),
            F.lit(None).cast("string").alias("name"),
            F.lit(None).cast("string").alias("url"),
        )

    return F.transform(F.filter(F.transform(ids, canonical_technique), lambda t: t.isNotNull()), one)


def cve_structs(ids: Column, confidence: float = 0.9) -> Column:
    """Reference structs for raw CVE ids, canonical and deduplicated."""
    canonical = F.array_distinct(F.filter(F.transform(ids, canonical_cve), lambda c: c.isNotNull()))
    return F.transform(
        canonical,
        lambda c: F.struct(
            c.alias("cve_id"),
            F.lit(confidence).alias("confidence"),
            F.lit(None).cast("double").alias("cvss_score"),
            F.lit(None).cast("string").alias("description"),
        ),
    )

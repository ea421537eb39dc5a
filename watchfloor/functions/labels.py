"""Severity, tactic and platform names of the supported rule formats, and the labels derived from scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchfloor.schemas import MATURITY_LABELS
from watchfloor.session import lookup

# Spellings each rule format uses, and what they mean in the record.
SEVERITY_WORDS = {
    "critical": "critical", "high": "high", "medium": "med", "med": "med", "moderate": "med", "low": "low",
    "informational": "info", "info": "info", "minimal": "info", "notice": "info", "unknown": "med",
}
SIGMA_LEVELS = {
    "critical": "critical", "high": "high", "medium": "med", "low": "low", "informational": "info", "unknown": "med",
}
SPLUNK_SEVERITIES = {"1": "info", "2": "low", "3": "med", "4": "high", "5": "critical"}
SENTINEL_SEVERITIES = {"high": "high", "medium": "med", "low": "low", "informational": "info"}
ELASTIC_SEVERITIES = {"critical": "critical", "high": "high", "medium": "med", "low": "low", "informational": "info"}
SEVERITY_TO_SIGMA_LEVEL = {
    "info": "informational", "low": "low", "med": "medium", "high": "high", "critical": "critical",
}
SENTINEL_TACTICS = {
    "initialaccess": "initial-access", "execution": "execution", "persistence": "persistence",
    "privilegeescalation": "privilege-escalation", "defenseevasion": "defense-evasion",
    "credentialaccess": "credential-access", "discovery": "discovery", "lateralmovement": "lateral-movement",
    "collection": "collection", "commandandcontrol": "command-and-control", "exfiltration": "exfiltration",
    "impact": "impact", "reconnaissance": "reconnaissance", "resourcedevelopment": "resource-development",
}
PRODUCT_PLATFORMS = {
    "windows": "windows", "linux": "linux", "macos": "macos", "aws": "cloud", "azure": "cloud", "gcp": "cloud",
    "okta": "cloud", "m365": "cloud", "office365": "cloud", "kubernetes": "containers", "docker": "containers",
}
PLATFORM_ALIASES = {
    "windows": "windows", "win": "windows", "linux": "linux", "macos": "macos", "mac": "macos", "osx": "macos",
    "cloud": "cloud", "aws": "cloud", "azure": "cloud", "gcp": "cloud", "network": "network",
    "containers": "containers", "docker": "containers", "k8s": "containers",
}
DOMAIN_PLATFORMS = {
    "endpoint": ["windows", "linux", "macos"], "network": ["network"], "cloud": ["cloud"],
    "containers": ["containers"],
}
TECHNIQUE_TACTIC_NAMES = {
    "T1003": "Credential Access", "T1027": "Defense Evasion", "T1046": "Discovery", "T1059": "Execution",
    "T1068": "Privilege Escalation", "T1071": "Command & Control", "T1078": "Defense Evasion",
    "T1110": "Credential Access", "T1190": "Initial Access", "T1218": "Defense Evasion", "T1499": "Impact",
    "T1505": "Persistence", "T1547": "Persistence", "T1552": "Credential Access", "T1574": "Privilege Escalation",
}
TECHNIQUE_TACTIC_SLUGS = {
    "T1190": "initial-access", "T1059": "execution", "T1055": "privilege-escalation",
    "T1068": "privilege-escalation", "T1078": "defense-evasion", "T1203": "execution",
    "T1105": "command-and-control", "T1505": "persistence", "T1083": "discovery", "T1213": "collection",
    "T1090": "command-and-control", "T1040": "credential-access", "T1185": "collection", "T1189": "initial-access",
    "T1499": "impact", "T1222": "defense-evasion", "T1552": "credential-access",
}


def severity(raw: Column, words: dict[str, str] = SEVERITY_WORDS, default: str = "med") -> Column:
    """Severity of a format-specific spelling, ``default`` when null or unknown."""
    return F.coalesce(lookup(words, F.lower(F.trim(raw))), F.lit(default))


def severity_of_cvss(score: Column, scale: int = 1) -> Column:
    """Severity band of a CVSS score; ``scale`` is 10 when scores are stored in tenths."""
    return (
        F.when(score >= 9 * scale, "critical").when(score >= 7 * scale, "high").when(score >= 4 * scale, "med")
        .otherwise("low")
    )


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("-"))


def sentinel_tactic(name: Column) -> Column:
    letters = F.regexp_replace(F.lower(name), "[^a-z]", "")
    return F.coalesce(lookup(SENTINEL_TACTICS, letters), F.lower(name))


def tactic_from_tags(tags: Column) -> Column:
    """First ``attack.<tactic>`` tag that names neither a technique nor a tactic id."""
    named = F.filter(
        F.transform(tags, F.lower),
        lambda t: F.startswith(t, F.lit("attack.")) & ~t.rlike(r"^attack\.ta?\d{4}"),
    )
    return F.coalesce(F.substring(F.get(named, 0), len("attack.") + 1, 1 << 30), F.lit("unknown"))


def platforms(names: Column, words: dict[str, str] = PLATFORM_ALIASES) -> Column:
    """Known platforms of a list of product or platform names, unknown ones dropped."""
    return F.filter(F.transform(names, lambda n: lookup(words, F.lower(F.trim(n)))), lambda p: p.isNotNull())


def domain_platforms(domain: Column) -> Column:
    """Platforms of a security domain: ``endpoint`` when missing, Windows when unknown."""
    name = F.coalesce(F.lower(domain), F.lit("endpoint"))
    answer = F.array(F.lit("windows"))
    for key, values in DOMAIN_PLATFORMS.items():
        answer = F.when(name == key, F.array(*[F.lit(v) for v in values])).otherwise(answer)
    return answer


def tactic_name(technique: Column) -> Column:
    """Report heading of a technique: a fixed prefix table, ``Other`` for the rest."""
    return F.coalesce(lookup(TECHNIQUE_TACTIC_NAMES, F.substring_index(technique, ".", 1)), F.lit("Other"))


def tactic_slug_hint(technique: Column) -> Column:
    return F.coalesce(lookup(TECHNIQUE_TACTIC_SLUGS, F.substring_index(technique, ".", 1)), F.lit("unknown"))


def maturity_label(score: Column) -> Column:
    return F.coalesce(lookup(MATURITY_LABELS, score.cast("string")), F.lit("Unknown"))


def is_validated(status: Column) -> Column:
    return status.isin("passed", "failed")


def primary_technique(bindings: Column) -> Column:
    """Highest-confidence binding of a rule; the earliest one wins a tie."""
    top = F.array_max(F.transform(bindings, lambda b: b["confidence"]))
    return F.get(F.filter(bindings, lambda b: b["confidence"] == top), 0)


def latest_deployment(history: Column) -> Column:
    """Most recent entry of a deployment history; the earliest listed wins a tie."""
    latest = F.array_max(F.transform(history, lambda d: d["deployed_at"]))
    return F.get(F.filter(history, lambda d: d["deployed_at"] == latest), 0)


def result_label(passed: Column, error: Column) -> Column:
    return F.when(F.coalesce(error, F.lit("")) != "", "error").when(passed, "pass").otherwise("fail")


def is_actionable_failure(passed: Column, false_negative: Column, error: Column) -> Column:
    """A missed attack, as opposed to a test that could not run."""
    return ~passed & false_negative & error.isNull()


def migration_grade(translatable: Column, confidence: Column, n_gaps: Column, n_errors: Column) -> Column:
    """A-F by translation confidence; ``confidence`` is a fraction."""
    clean = n_errors == 0
    return (
        F.when(~translatable, "F")
        .when((confidence >= 0.90) & clean & (n_gaps == 0), "A")
        .when((confidence >= 0.75) & clean, "B")
        .when(confidence >= 0.50, "C")
        .otherwise("D")
    )


def badge_color(pct: Column) -> Column:
    return F.when(pct >= 70, "brightgreen").when(pct >= 40, "yellow").otherwise("red")


def confidence_color(confidence: Column) -> Column:
    """Hex green of a confidence: hue 120, saturation 0.6, lightness falling from 0.75 to 0.35."""
    lightness = F.lit(0.75) - confidence * F.lit(0.40)
    strong = F.when(lightness <= 0.5, lightness * F.lit(1.6)).otherwise(
        lightness + F.lit(0.6) - lightness * F.lit(0.6)
    )
    weak = F.lit(2.0) * lightness - strong

    def channel(value: Column) -> Column:
        return F.lpad(F.lower(F.hex((value * 255).cast("bigint"))), 2, "0")

    return F.concat(F.lit("#"), channel(weak), channel(strong), channel(weak))


def residual_risk(cvss: Column, epss: Column, coverage: Column, digits: int | None = 4) -> Column:
    """CVSS x EPSS x uncovered share, rounded half-even; missing scores count as zero."""
    zero = F.lit(0.0)
    risk = F.coalesce(cvss, zero) * F.coalesce(epss, zero) * F.greatest(zero, F.lit(1.0) - coverage)
    return risk if digits is None else F.bround(risk, digits)

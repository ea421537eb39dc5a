"""Filling rules in from the knowledge base and the CVE table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfloor.functions.ids import technique_url
from watchfloor.functions.labels import severity_of_cvss


def is_unnamed(tactic: Column) -> Column:
    return F.coalesce(tactic, F.lit("")).isin("", "unknown")


def fill_tactic(bindings: DataFrame, techniques: DataFrame, key: str) -> DataFrame:
    """Tactic filled from the knowledge base where the binding names none; ``filled`` marks the rows changed."""
    kb = techniques.select(key, "technique_id", F.col("tactic").alias("kb_tactic"))
    unnamed = is_unnamed(F.col("tactic"))
    return (
        bindings.join(kb, key, "left")
        .withColumn("filled", unnamed & F.col("kb_tactic").isNotNull())
        .withColumn("tactic", F.when(unnamed, F.coalesce("kb_tactic", "tactic")).otherwise(F.col("tactic")))
        .drop("kb_tactic")
    )


def fill_techniques(bindings: DataFrame, techniques: DataFrame) -> DataFrame:
    """Name, link and tactic of each binding; unknown techniques carry a warning and stay as they are."""
    kb = techniques.select(
        "technique_id", F.col("name").alias("kb_name"), F.col("tactic").alias("kb_tactic"), F.lit(True).alias("known")
    )
    known = F.coalesce("known", F.lit(False))
    no_name = F.coalesce("name", F.lit("")) == ""
    no_url = F.coalesce("url", F.lit("")) == ""
    no_tactic = is_unnamed(F.col("tactic"))
    return (
        bindings.join(kb, "technique_id", "left")
        .withColumns(
            {
                "enriched": known & (no_name | no_url | no_tactic),
                "warning": F.when(
                    ~known, F.concat(F.lit("Technique "), F.col("technique_id"), F.lit(" not found in knowledge base"))
                ),
                "name": F.when(known & no_name, F.col("kb_name")).otherwise(F.col("name")),
                "url": F.when(known & no_url, technique_url(F.col("technique_id"))).otherwise(F.col("url")),
                "tactic": F.when(known & no_tactic, F.col("kb_tactic")).otherwise(F.col("tactic")),
            }
        )
        .drop("kb_name", "kb_tactic", "known")
    )


def add_references(references: DataFrame, tagged: DataFrame, by: Sequence[str]) -> DataFrame:
    """Existing references plus those only tags name; ``added`` marks the new ones."""
    stacked = references.withColumn("_own", F.lit(1)).unionByName(
        tagged.withColumn("_own", F.lit(0)), allowMissingColumns=True
    )
    others = [c for c in references.columns if c not in by]
    values = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_own"))).alias(c) for c in others]
    return stacked.groupBy(*by).agg(*values, (F.max("_own") == 0).alias("added"))


def fill_references(references: DataFrame, cves: DataFrame, description_length: int | None = None) -> DataFrame:
    """CVSS score and description of references that lack them; ``description_length`` shortens what is copied."""
    kb = cves.select("cve_id", F.col("cvss_score").alias("kb_score"), F.col("description").alias("kb_text"))
    no_text = F.coalesce("description", F.lit("")) == ""
    has_text = F.coalesce("kb_text", F.lit("")) != ""
    copied = F.col("kb_text") if description_length is None else F.left("kb_text", F.lit(description_length))
    changed = (F.col("cvss_score").isNull() & F.col("kb_score").isNotNull()) | (no_text & has_text)
    return (
        references.join(kb, "cve_id", "left")
        .withColumns(
            {
                "enriched": changed,
                "cvss_score": F.coalesce("cvss_score", "kb_score"),
                "description": F.when(no_text & has_text, copied).otherwise(
                    F.col("description")
                ),
            }
        )
        .drop("kb_score", "kb_text")
    )


def derive_severity(detections: DataFrame, scores: DataFrame, key: str, scale: int = 1) -> DataFrame:
    """Severity from the highest linked CVSS score, only for rules still at the default ``med``.

    ``scores`` holds (key, score) rows; they are reduced to one maximum per rule before the join.
    """
    top = scores.groupBy(key).agg(F.max("score").alias("_top"))
    at_default = (F.col("severity") == "med") & F.col("_top").isNotNull()
    return (
        detections.join(top, key, "left")
        .withColumn("severity_updated", at_default & (severity_of_cvss(F.col("_top"), scale) != "med"))
        .withColumn("severity", F.when(at_default, severity_of_cvss(F.col("_top"), scale)).otherwise(F.col("severity")))
        .drop("_top")
    )


def counters(rows: DataFrame, **flags: Column) -> DataFrame:
    """One row of counts, one per named flag."""
    return rows.agg(*[F.count_if(flag).alias(name) for name, flag in flags.items()])

"""The technique knowledge base: listings, relationships, replacements.

All traversals of the object graph are one hop, so vertices and edges are joined as plain tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_techniques(
    techniques: DataFrame, include_deprecated: bool = False, include_subtechniques: bool = True
) -> DataFrame:
    out = techniques
    if not include_deprecated:
        out = out.filter(~F.col("deprecated"))
    if not include_subtechniques:
        out = out.filter(F.col("parent_id").isNull())
    return out


def techniques_by_tactic(techniques: DataFrame) -> DataFrame:
    """Base and sub-technique counts per tactic, deprecated ones left out."""
    return active_techniques(techniques).groupBy("tactic").agg(
        F.count_if(F.col("parent_id").isNull()).alias("base_n"),
        F.count_if(F.col("parent_id").isNotNull()).alias("sub_n"),
    )


def replacements(techniques: DataFrame, revoked_by: DataFrame, key: str) -> DataFrame:
    """(technique_id, replacement) of deprecated techniques; null where no edge names a successor.

    ``revoked_by`` holds (source, target) keys of the knowledge base.
    """
    targets = techniques.select(F.col(key).alias("target"), F.col("technique_id").alias("replacement"))
    named = revoked_by.join(targets, "target").select(F.col("source").alias(key), "replacement")
    return techniques.filter("deprecated").join(named, key, "left").select("technique_id", "replacement")


def orphans(techniques: DataFrame) -> DataFrame:
    """Sub-techniques whose parent is missing from the knowledge base."""
    known = techniques.select(F.col("technique_id").alias("parent_id"))
    return (
        techniques.filter(F.col("parent_id").isNotNull())
        .join(known, "parent_id", "left_anti")
        .select("technique_id", "parent_id")
    )


def related(edges: DataFrame, sources: DataFrame, techniques: DataFrame, relationship: str) -> DataFrame:
    """Objects related to each technique: one row per edge of ``relationship``.

    ``edges`` is (relationship, source_ref, target_ref, description), ``sources`` (stix_id, ...) and ``techniques``
    (stix_id, technique_id, ...).
    """
    targets = techniques.select(F.col("stix_id").alias("target_ref"), "technique_id")
    renamed = sources.select(
        F.col("stix_id").alias("source_ref"), F.col("external_id").alias("source_id"), F.col("name").alias("source_name")
    )
    return (
        edges.filter(F.col("relationship") == relationship)
        .join(targets, "target_ref")
        .join(renamed, "source_ref")
        .select("technique_id", "source_id", "source_name", "description")
    )


def relationship_counts(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    return edges.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))

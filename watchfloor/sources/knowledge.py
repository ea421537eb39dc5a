"""The technique knowledge base from a STIX bundle: one object table, split by type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfloor.functions.labels import slug
from watchfloor.session import cut_lineage
from watchfloor.sources.json_records import documents

# Names used inside the bundle.
CATALOG = "mitre-attack"
# Published bundles write the flags with underscores, older exports with hyphens; both are read.
BUNDLE = """
        type STRING, id STRING, name STRING, description STRING, revoked BOOLEAN,
        `x-mitre-deprecated` BOOLEAN, x_mitre_deprecated BOOLEAN,
        `x-mitre-is-subtechnique` BOOLEAN, x_mitre_is_subtechnique BOOLEAN, x_mitre_shortname STRING,
        kill_chain_phases ARRAY<STRUCT<kill_chain_name STRING, phase_name STRING>>,
        external_references ARRAY<STRUCT<source_name STRING, external_id STRING>>,
        relationship_type STRING, source_ref STRING, target_ref STRING
"""


@dataclass(frozen=True)
class KnowledgeBase:
    """Tables of a bundle. ``techniques`` feeds the mapping operators, ``edges`` the relationship look-ups."""

    techniques: DataFrame
    tactics: DataFrame
    data_sources: DataFrame
    data_components: DataFrame
    mitigations: DataFrame
    groups: DataFrame
    software: DataFrame
    edges: DataFrame

    @property
    def revoked_by(self) -> DataFrame:
        return self.edges.filter(F.col("relationship") == "revoked-by").select(
            F.col("source_ref").alias("source"), F.col("target_ref").alias("target")
        )


def _flag(hyphen: str, underscore: str) -> Column:
    return F.coalesce(F.col(f"`{hyphen}`"), F.col(underscore), F.lit(False))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Every object of the bundle(s), with the catalogue's own id. A bundle is one JSON document, read by many tasks."""
    objects = documents(spark, path, "objects", BUNDLE).select("e.*")
    own = F.filter("external_references", lambda r: r["source_name"] == CATALOG)
    return objects.withColumn("external_id", F.get(own, 0)["external_id"])


def load_bundle(spark: SparkSession, path: str, checkpoint: bool = True) -> KnowledgeBase:
    """Read a bundle once and split it; the checkpoint keeps every table from parsing the file again."""
    objects = read_objects(spark, path)
    if checkpoint:
        objects = cut_lineage(objects)
    phases = F.transform(
        F.filter("kill_chain_phases", lambda p: p["kill_chain_name"] == CATALOG), lambda p: slug(p["phase_name"])
    )
    is_sub = _flag("x-mitre-is-subtechnique", "x_mitre_is_subtechnique")
    revoked = F.coalesce("revoked", F.lit(False))
    techniques = (
        objects.filter((F.col("type") == "attack-pattern") & F.startswith("external_id", F.lit("T")))
        .withColumn("all_tactics", F.coalesce(phases, F.array().cast("array<string>")))
        .select(
            F.col("id").alias("stix_id"),
            F.col("external_id").alias("technique_id"),
            F.coalesce("name", F.lit("")).alias("name"),
            F.coalesce("description", F.lit("")).alias("description"),
            F.coalesce(F.get("all_tactics", 0), F.lit("unknown")).alias("tactic"),
            "all_tactics",
            is_sub.alias("is_subtechnique"),
            F.when(is_sub & F.contains("external_id", F.lit(".")), F.substring_index("external_id", ".", 1)).alias(
                "parent_id"
            ),
            (_flag("x-mitre-deprecated", "x_mitre_deprecated") | revoked).alias("deprecated"),
            revoked.alias("revoked"),
        )
    )

    def of_type(*types: str) -> DataFrame:
        return objects.filter(F.col("type").isin(*types)).select(
            F.col("id").alias("stix_id"), "external_id", "name", "description"
        )

    source_kind = F.substring_index("source_ref", "--", 1)
    kind = (
        F.when(F.col("relationship_type") == "mitigates", F.when(source_kind == "course-of-action", "mitigates"))
        .when(
            F.col("relationship_type") == "uses",
            F.when(source_kind == "intrusion-set", "group-uses").when(
                source_kind.isin("malware", "tool"), "software-uses"
            ),
        )
        .otherwise(F.col("relationship_type"))
    )
    edges = objects.filter(F.col("type") == "relationship").select(
        kind.alias("relationship"), "source_ref", "target_ref", "description"
    )
    return KnowledgeBase(
        techniques, of_type("x-mitre-tactic"), of_type("x-mitre-data-source"), of_type("x-mitre-data-component"),
        of_type("course-of-action"), of_type("intrusion-set"), of_type("malware", "tool"), edges,
    )


def procedure_examples(kb: KnowledgeBase) -> DataFrame:
    """(technique_id, description): texts of the group and software relationships of each technique."""
    used = kb.edges.filter(F.col("relationship").isin("group-uses", "software-uses") & (F.col("description") != ""))
    targets = kb.techniques.select(F.col("stix_id").alias("target_ref"), "technique_id")
    return used.join(targets, "target_ref").select("technique_id", "description")

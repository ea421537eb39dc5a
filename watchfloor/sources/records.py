"""Canonical rule records and rule results as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfloor.operators.quality import clamp
from watchfloor.schemas import DETECTION, RULE_RESULT

CORRUPT = "_bad"


def read_detections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines) of a JSON-lines file.

    An author given as plain text or as a list is read either way.
    """
    schema = DETECTION.replace("author ARRAY<STRING>", "author STRING") + f", {CORRUPT} STRING"
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", schema, {"columnNameOfCorruptRecord": CORRUPT}))
    broken = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    good = parsed.filter(~broken).select("r.*").drop(CORRUPT).withColumn("author", text_list("author"))
    return clamp(good), parsed.filter(broken).select("value")


def text_list(column: str):
    """``"a"`` or ``["a", "b"]`` (as text) -> array."""
    value = F.col(column)
    return F.when(F.startswith(value, F.lit("[")), F.from_json(value, "ARRAY<STRING>")).when(
        value.isNotNull(), F.array(value)
    )


def write_detections(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    records.write.mode(mode).json(path)


def read_results(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Rule results from JSON lines, as ``write_results`` stores them, or with ``array`` from one JSON array per file."""
    return spark.read.schema(RULE_RESULT).option("multiLine", array).json(path)


def write_results(results: DataFrame, path: str, mode: str = "overwrite", samples: int | None = None) -> None:
    """Rule results as JSON lines; ``samples`` bounds the samples kept of each."""
    names = ("rule_id", "name", "techniques", "siem", "query", "hits", "status", "error", "samples")
    cut = samples is not None and "samples" in results.columns
    trimmed = results.withColumn("samples", F.slice("samples", 1, samples)) if cut else results
    trimmed.select(*[n for n in names if n in trimmed.columns]).write.mode(mode).json(path)


def explode_bindings(records: DataFrame) -> DataFrame:
    """(detection_id, name, technique_id, tactic, confidence, pos): one row per technique of a rule."""
    return records.select(
        F.col("id").alias("detection_id"), "name", F.posexplode("mitre_techniques").alias("pos", "t")
    ).select(
        "detection_id", "name", F.coalesce("t.sub_technique_id", "t.technique_id").alias("technique_id"), "t.tactic",
        "t.confidence", F.lit("explicit").alias("source"), "pos", F.col("t.name").alias("technique_name"), "t.url",
    )


def explode_references(records: DataFrame) -> DataFrame:
    """(detection_id, cve_id, confidence, cvss_score, description): one row per CVE of a rule."""
    return records.select(F.col("id").alias("detection_id"), F.explode("cve_references").alias("r")).select(
        "detection_id", "r.cve_id", "r.confidence", "r.cvss_score", "r.description"
    )


def collapse_bindings(bindings: DataFrame) -> DataFrame:
    """Back to one ``mitre_techniques`` array per rule. A rule's own bindings are few, their order is kept."""
    is_sub = F.contains("technique_id", F.lit("."))
    binding = F.struct(
        "pos",
        F.substring_index("technique_id", ".", 1).alias("technique_id"),
        F.when(is_sub, F.col("technique_id")).alias("sub_technique_id"),
        "tactic", "confidence", F.col("technique_name").alias("name"), "url",
    )
    return bindings.groupBy("detection_id").agg(F.array_sort(F.collect_list(binding)).alias("b")).select(
        F.col("detection_id").alias("id"),
        F.transform(
            "b",
            lambda b: F.struct(
                *[b[n].alias(n) for n in ("technique_id", "sub_technique_id", "tactic", "confidence", "name", "url")]
            ),
        ).alias("mitre_techniques"),
    )

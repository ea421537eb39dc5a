"""Vulnerability feeds flattened to tables: NVD, KEV, direct technique mappings, EPSS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfloor.functions.text import strip
from watchfloor.sources.json_records import documents

# Spellings of the mapping file's columns, and the order CVSS versions are preferred in.
CVE_COLUMNS = ("cve", "cve_id", "cve id")
TECHNIQUE_COLUMNS = (
    "technique", "technique_id", "attack technique", "attack_technique", "techniques", "primary impact",
    "secondary impact", "exploitation technique", "uncategorized",
)
METRICS = ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")

_METRIC = (
    "ARRAY<STRUCT<type STRING, baseSeverity STRING, "
    "cvssData STRUCT<baseScore DOUBLE, vectorString STRING, version STRING, baseSeverity STRING>>>"
)
NVD = f"""
    cve STRUCT<
        id STRING, published STRING, lastModified STRING,
        descriptions ARRAY<STRUCT<lang STRING, value STRING>>,
        metrics STRUCT<{', '.join(f'{m} {_METRIC}' for m in METRICS)}>,
        weaknesses ARRAY<STRUCT<description ARRAY<STRUCT<lang STRING, value STRING>>>>,
        configurations ARRAY<STRUCT<nodes ARRAY<STRUCT<cpeMatch ARRAY<STRUCT<criteria STRING>>>>>>>
"""
KEV = """
    cveID STRING, vendorProject STRING, product STRING, vulnerabilityName STRING,
    dateAdded STRING, dueDate STRING, shortDescription STRING, requiredAction STRING, notes STRING
"""
EPSS = "cve STRING, epss STRING, percentile STRING, date STRING"


def _first_where(items: Column, condition) -> Column:
    """First item that satisfies ``condition``, else the first item, else null."""
    return F.coalesce(F.get(F.filter(items, condition), 0), F.get(items, 0))


def read_nvd(spark: SparkSession, path: str) -> DataFrame:
    return flatten_nvd(documents(spark, path, "vulnerabilities", NVD).select(F.col("e.cve").alias("c")))


def flatten_nvd(records: DataFrame) -> DataFrame:
    """One row per CVE: English text, best CVSS version, distinct weaknesses and platforms. Column ``c`` holds the record."""
    metric = F.coalesce(*[_first_where(F.col(f"c.metrics.{m}"), lambda e: e["type"] == "Primary") for m in METRICS])
    values = F.flatten(F.transform("c.weaknesses", lambda w: F.transform(w["description"], lambda d: d["value"])))
    nodes = F.flatten(F.transform("c.configurations", lambda g: g["nodes"]))
    criteria = F.flatten(F.transform(nodes, lambda n: F.transform(n["cpeMatch"], lambda m: m["criteria"])))
    empty = F.array().cast("array<string>")
    return records.withColumn("m", metric).select(
        F.col("c.id").alias("cve_id"),
        F.coalesce(_first_where(F.col("c.descriptions"), lambda d: d["lang"] == "en")["value"], F.lit("")).alias(
            "description"
        ),
        F.col("m.cvssData.baseScore").alias("cvss_score"),
        F.col("m.cvssData.vectorString").alias("cvss_vector"),
        F.col("m.cvssData.version").alias("cvss_version"),
        F.nullif(
            F.upper(F.coalesce(F.nullif("m.cvssData.baseSeverity", F.lit("")), "m.baseSeverity")), F.lit("")
        ).alias("severity"),
        F.coalesce(F.array_distinct(F.filter(values, lambda v: F.startswith(v, F.lit("CWE-")))), empty).alias("cwes"),
        F.coalesce(F.array_distinct(F.filter(criteria, lambda v: v != "")), empty).alias("cpes"),
        F.col("c.published").alias("published"),
        F.col("c.lastModified").alias("modified"),
    )


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    entry = F.col("v")
    renamed = {
        "cve_id": "cveID", "vendor": "vendorProject", "product": "product", "name": "vulnerabilityName",
        "date_added": "dateAdded", "due_date": "dueDate", "short_description": "shortDescription",
        "required_action": "requiredAction", "notes": "notes",
    }
    return (
        documents(spark, path, "vulnerabilities", KEV)
        .withColumnRenamed("e", "v")
        .filter(F.coalesce("v.cveID", F.lit("")) != "")
        .select(*[F.coalesce(entry[old], F.lit("")).alias(new) for new, old in renamed.items()])
    )


def _technique_lists(rows: DataFrame) -> DataFrame:
    """(cve_id, pos, technique) rows -> one distinct list per CVE in order of appearance; lists are a handful long."""
    first = rows.groupBy("cve_id", "technique").agg(F.min("pos").alias("pos"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "technique")))
    return first.groupBy("cve_id").agg(F.transform(ordered, lambda s: s["technique"]).alias("techniques"))


def read_mapping_csv(spark: SparkSession, path: str) -> DataFrame:
    """Direct mappings from CSV: header spellings vary, several technique columns, cells hold several ids."""
    table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    by_name = {c.strip().lower(): c for c in reversed(table.columns)}
    cve = next((by_name[c] for c in (n.strip().lower() for n in table.columns) if c in CVE_COLUMNS), None)
    cells = [c for c in table.columns if c.strip().lower() in TECHNIQUE_COLUMNS]
    if cve is None or not cells:
        raise ValueError(f"no CVE or technique column among {table.columns}")
    ids = F.flatten(F.array(*[F.split(F.coalesce(F.col(f"`{c}`"), F.lit("")), "[,;]") for c in cells]))
    techniques = F.filter(F.transform(ids, strip), lambda t: F.startswith(F.upper(t), F.lit("T")))
    rows = (
        table.select(F.upper(F.trim(F.col(f"`{cve}`"))).alias("cve_id"), F.posexplode(techniques).alias("i", "technique"),
                     F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("row"))
        .filter(F.startswith("cve_id", F.lit("CVE-")))
        .select("cve_id", F.struct("row", "i").alias("pos"), "technique")
    )
    return _technique_lists(rows)


def read_mapping_json(spark: SparkSession, path: str) -> DataFrame:
    """Direct mappings from JSON: ``{cve: [ids]}`` or ``[{cve, technique}]``."""
    text = spark.read.text(path, wholetext=True)
    shaped = text.select(F.trim("value").alias("value"))
    by_cve = (
        shaped.filter(F.startswith("value", F.lit("{")))
        .select(F.explode(F.from_json("value", "MAP<STRING, STRING>")).alias("cve", "ids"))
        .select(
            F.upper("cve").alias("cve_id"),
            F.posexplode(
                F.when(F.startswith("ids", F.lit("[")), F.from_json("ids", "ARRAY<STRING>")).otherwise(F.array("ids"))
            ).alias("pos", "technique"),
        )
    )
    listed = (
        shaped.filter(F.startswith("value", F.lit("[")))
        .select(
            F.posexplode(
                F.from_json(
                    "value", "ARRAY<STRUCT<cve STRING, cve_id STRING, technique STRING, technique_id STRING>>"
                )
            ).alias("pos", "e")
        )
        .select(
            F.upper(F.coalesce(F.nullif("e.cve", F.lit("")), "e.cve_id")).alias("cve_id"), "pos",
            F.coalesce(F.nullif("e.technique", F.lit("")), "e.technique_id").alias("technique"),
        )
    )
    rows = by_cve.unionByName(listed).withColumn("technique", F.trim("technique"))
    return _technique_lists(rows.filter(F.startswith("cve_id", F.lit("CVE-")) & (F.col("technique") != "")))


def read_epss(spark: SparkSession, path: str) -> DataFrame:
    zero = F.lit(0.0)
    return (
        documents(spark, path, "data", EPSS)
        .select("e.*")
        .filter(F.coalesce("cve", F.lit("")) != "")
        .select(
            F.upper("cve").alias("cve_id"),
            F.coalesce(F.col("epss").try_cast("double"), zero).alias("epss"),
            F.coalesce(F.col("percentile").try_cast("double"), zero).alias("percentile"),
            F.coalesce("date", F.lit("")).alias("date"),
        )
    )

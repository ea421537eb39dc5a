"""Rule files, feeds and bundles made of the given tables, read back by the library; validation and enrichment in full."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from watchfloor.functions import labels
from watchfloor.functions.ids import technique_structs
from watchfloor.operators import enrich, knowledge, mapping, quality
from watchfloor.session import shared_folder
from watchfloor.sources import feeds, rules
from watchfloor.sources.knowledge import load_bundle
from workload.registry import query

RECORDS_PER_DOCUMENT = 2_000


def written(v, documents, name):
    """Folder of files, one for each row (number, value)."""
    folder = f"{shared_folder(v.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    documents.select("number", "value").repartition("number").write.partitionBy("number").text(folder)
    return folder


def json_documents(v, rows, key, array, name):
    """Folder of JSON documents with an array of objects each, neighbouring keys in one document."""
    number = F.floor(F.col(key) / RECORDS_PER_DOCUMENT).alias("number")
    record = F.struct(*[c for c in rows.columns if c != key])
    grouped = rows.groupBy(number).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), record.alias("r")))).alias("all"))
    body = F.struct(F.lit("made of tables").alias("note"), F.array(F.struct(F.lit("no record").alias("cveID"))).alias("spec"), F.transform("all", lambda a: a["r"]).alias(array))
    return written(v, grouped.select("number", F.to_json(body).alias("value")), name)


@query(
    "kev_feed",
    """SELECT cve_id, 'vendor "' || priority || '"' AS vendor, '{' || cwe_id || '}' AS name, '' AS notes FROM cve
       WHERE o_orderkey % 5 <> 0""",
)
def kev_feed(v):
    rows = v.cve.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("cve_id")).alias("cveID"),
        F.concat(F.lit('vendor "'), "priority", F.lit('"')).alias("vendorProject"),
        F.concat(F.lit("{"), "cwe_id", F.lit("}")).alias("vulnerabilityName"),
    )
    found = feeds.read_kev(v.spark, json_documents(v, rows, "o_orderkey", "vulnerabilities", "kev"))
    return found.select("cve_id", "vendor", "name", "notes")


@query(
    "epss_feed",
    """SELECT cve_id, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE CAST('0.' || lpad(CAST(epss_pct AS VARCHAR), 3, '0') AS DOUBLE) END AS epss,
              '2024-01-' || lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0') AS date
       FROM cve""",
)
def epss_feed(v):
    rows = v.cve.select(
        "o_orderkey",
        F.lower("cve_id").alias("cve"),
        F.when(F.col("o_orderkey") % 7 == 0, "none").otherwise(F.concat(F.lit("0."), F.lpad(F.col("epss_pct").cast("string"), 3, "0"))).alias("epss"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("o_orderkey") % 28 + 1).cast("string"), 2, "0")).alias("date"),
    )
    found = feeds.read_epss(v.spark, json_documents(v, rows, "o_orderkey", "data", "epss"))
    return found.select("cve_id", "epss", "date")


@query(
    "nvd_feed",
    """SELECT cve_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Text of "' || cve_id || '" [' || priority || ']' END AS description,
              CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 1.0 ELSE CAST(cvss_tenths AS DOUBLE) / 10 END AS cvss_score,
              CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'LOW' ELSE 'HIGH' END AS severity, cwe_id AS cwes
       FROM cve""",
)
def nvd_feed(v):
    """Records with metrics of two versions, texts in two languages and weaknesses that are none."""
    key = F.col("o_orderkey")

    def metric(kind, score, severity):
        return F.struct(F.lit(kind).alias("type"), F.struct(score.alias("baseScore"), F.lit(severity).alias("baseSeverity")).alias("cvssData"))

    score = F.col("cvss_tenths").cast("double") / 10
    newer = F.when(key % 4 >= 2, F.array(metric("Secondary", F.lit(9.9), "CRITICAL"), metric("Primary", score, "high")))
    older = F.when(key % 4 != 0, F.array(metric("Primary", F.lit(1.0), "low")))
    text = F.concat(F.lit('Text of "'), "cve_id", F.lit('" ['), "priority", F.lit("]"))
    said = F.array(
        F.struct(F.lit("es").alias("lang"), F.lit("otra").alias("value")),
        F.struct(F.lit("en").alias("lang"), F.when(key % 3 == 0, "").otherwise(text).alias("value")),
    )
    weak = F.array(F.struct(F.array(*[F.struct(F.lit("en").alias("lang"), c.alias("value")) for c in (F.lit("NVD-CWE-noinfo"), F.col("cwe_id"), F.col("cwe_id"))]).alias("description")))
    record = F.struct(
        F.col("cve_id").alias("id"), said.alias("descriptions"), F.struct(newer.alias("cvssMetricV31"), older.alias("cvssMetricV2")).alias("metrics"), weak.alias("weaknesses")
    )
    found = feeds.read_nvd(v.spark, json_documents(v, v.cve.select("o_orderkey", record.alias("cve")), "o_orderkey", "vulnerabilities", "nvd"))
    return found.select("cve_id", "description", "cvss_score", "severity", F.array_join("cwes", ",").alias("cwes"))


@query(
    "mapping_feed",
    """SELECT k.cve_id, string_agg(k.technique_id, ',' ORDER BY k.technique_id) AS techniques
       FROM (SELECT DISTINCT c.cve_id, k.technique_id FROM cve_technique t JOIN cve c ON c.o_orderkey = t.o_orderkey
             JOIN kb k ON k.s_suppkey = t.s_suppkey) k GROUP BY k.cve_id""",
)
def mapping_feed(v):
    rows = v.cve_technique.join(v.cve.select("o_orderkey", "cve_id"), "o_orderkey").join(v.kb.select("s_suppkey", "technique_id"), "s_suppkey")
    entry = F.struct(F.lower("cve_id").alias("cve"), F.concat(F.lit(" "), "technique_id").alias("technique"))
    grouped = rows.groupBy(F.floor(F.col("o_orderkey") / RECORDS_PER_DOCUMENT).alias("number")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    found = feeds.read_mapping_json(v.spark, written(v, grouped, "mapping"))
    return found.select("cve_id", F.array_join(F.array_sort("techniques"), ",").alias("techniques"))


@query(
    "bundle_techniques",
    """SELECT technique_id, name, tactic, parent_id, deprecated FROM kb""",
)
def bundle_techniques(v):
    """The knowledge base written as bundles and read back."""
    phase = F.array(F.struct(F.lit("other").alias("kill_chain_name"), F.lit("x").alias("phase_name")), F.struct(F.lit("mitre-attack").alias("kill_chain_name"), F.col("tactic").alias("phase_name")))
    own = F.array(F.struct(F.lit("mitre-attack").alias("source_name"), F.col("technique_id").alias("external_id")))
    objects = v.kb.select(
        "s_suppkey", F.lit("attack-pattern").alias("type"), F.concat(F.lit("attack-pattern--"), "s_suppkey").alias("id"), "name",
        phase.alias("kill_chain_phases"), own.alias("external_references"), F.col("deprecated").alias("x_mitre_deprecated"),
        F.col("parent_id").isNotNull().alias("x_mitre_is_subtechnique"),
    )
    kb = load_bundle(v.spark, json_documents(v, objects, "s_suppkey", "objects", "bundle"))
    return kb.techniques.select("technique_id", "name", "tactic", "parent_id", "deprecated")


SIGMA = """title: %s
id: 11111111-2222-3333-4444-%012d
level: %s
status: test
author: someone
tags:
    - attack.%s
    - attack.execution
    - cve.2024.%05d
logsource:
    product: windows
    category: process_creation
detection:
    sel:
        Image|endswith: '\\\\%s.exe'
    condition: sel
"""


@query(
    "sigma_files",
    """SELECT '11111111-2222-3333-4444-' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS id, s_name AS name,
              CASE s_suppkey % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'med' ELSE 'high' END AS severity,
              technique_id, 'CVE-2024-' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS cve_id, 'process_creation' AS category
       FROM (SELECT s.s_name, s.s_suppkey, k.technique_id FROM supplier s JOIN kb k ON s.s_suppkey = k.s_suppkey) r""",
)
def sigma_files(v):
    """A rule file per technique, as ``scan_files`` gives them; the format is found by the file's own content."""
    level = F.element_at(F.array(*[F.lit(x) for x in ("informational", "low", "medium", "high")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    text = F.format_string(SIGMA, "name", "s_suppkey", level, F.lower("technique_id"), "s_suppkey", F.concat(F.lit("tool"), "s_suppkey"))
    files = v.kb.select(F.concat(F.lit("rules/"), "s_suppkey", F.lit(".yml")).alias("path"), F.lit(None).cast("timestamp").alias("modified"), F.lit("yml").alias("suffix"), text.alias("text"))
    loaded = rules.load(rules.route(files))
    records = rules.normalise(loaded.filter("error IS NULL"))
    binding = F.get("mitre_techniques", 0)
    return records.select(
        "id", "name", "severity", F.coalesce(binding["sub_technique_id"], binding["technique_id"]).alias("technique_id"),
        F.get("cve_references", 0)["cve_id"].alias("cve_id"), F.get("log_sources", 0)["category"].alias("category"),
    )


# What rules declare: a technique, sometimes in small letters, unknown or no id at all, and a tactic or none.
DECLARED = """CASE WHEN pos % 11 = 0 THEN 'no technique' WHEN pos % 13 = 0 THEN 'T0001' WHEN pos % 2 = 0 THEN lower(technique_id)
    ELSE technique_id END"""
DECLARED_TACTIC = "CASE WHEN pos % 3 = 0 THEN 'unknown' WHEN pos % 3 = 1 THEN 'declared' END"


@query(
    "explicit_validate_full",
    f"""SELECT d.pos, d.id AS technique_id,
               CASE WHEN d.tactic IS NULL OR d.tactic = 'unknown' THEN k.tactic ELSE d.tactic END AS tactic,
               CASE WHEN d.id IS NULL THEN 'Invalid technique ID: ' || d.raw
                    WHEN k.technique_id IS NULL THEN d.id || ' not found in the knowledge base' END AS error,
               coalesce(k.deprecated, false) AS deprecated, n.technique_id AS replacement,
               CASE WHEN k.technique_id IS NULL THEN '' ELSE concat_ws('; ',
                 CASE WHEN k.deprecated THEN d.id || ' is deprecated/revoked'
                      || coalesce('; suggested replacement: ' || n.technique_id, '') END,
                 CASE WHEN (d.tactic IS NULL OR d.tactic = 'unknown') AND NOT k.deprecated
                      THEN 'Filled missing tactic for ' || d.id || ': ' || k.tactic END,
                 CASE WHEN contains(d.id, '.') AND p.technique_id IS NULL
                      THEN 'Parent technique ' || split_part(d.id, '.', 1) || ' not found for ' || d.id END) END AS warnings
        FROM (SELECT pos, raw, tactic, CASE WHEN raw <> 'no technique' THEN upper(raw) END AS id
              FROM (SELECT pos, {DECLARED} AS raw, {DECLARED_TACTIC} AS tactic FROM binding b JOIN kb k ON b.s_suppkey = k.s_suppkey) r) d
        LEFT JOIN kb k ON k.technique_id = d.id
        LEFT JOIN kb n ON k.deprecated AND n.s_suppkey = k.s_suppkey + 1
        LEFT JOIN kb p ON p.technique_id = split_part(d.id, '.', 1)""",
)
def explicit_validate_full(v):
    declared = v.binding.join(v.kb.select("s_suppkey", "technique_id"), "s_suppkey")
    declared = declared.selectExpr("pos", "detection_id", f"{DECLARED} AS technique_id", f"{DECLARED_TACTIC} AS tactic", "conf_pct AS confidence")
    edges = v.kb.select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") + 1).alias("target"))
    checked = mapping.validate_explicit(declared, v.kb, knowledge.replacements(v.kb, edges, "s_suppkey"))
    return checked.select("pos", "technique_id", "tactic", "error", "deprecated", "replacement", F.array_join("warnings", "; ").alias("warnings"))


@query(
    "enrich_technique_fields",
    """SELECT b.pos, b.id AS technique_id, coalesce(nullif(b.name, ''), k.name, b.name) AS name,
              coalesce(b.url, 'https://attack.mitre.org/techniques/' || replace(k.technique_id, '.', '/') || '/') AS url,
              k.technique_id IS NOT NULL AND (coalesce(b.name, '') = '' OR b.url IS NULL) AS enriched,
              CASE WHEN k.technique_id IS NULL THEN 'Technique ' || b.id || ' not found in knowledge base' END AS warning
       FROM (SELECT pos, CASE WHEN pos % 9 = 0 THEN 'T0002' ELSE technique_id END AS id,
                    CASE pos % 4 WHEN 0 THEN '' WHEN 1 THEN 'own name' END AS name,
                    CASE WHEN pos % 2 = 1 THEN 'https://own/' END AS url
             FROM binding b JOIN kb k ON b.s_suppkey = k.s_suppkey) b LEFT JOIN kb k ON k.technique_id = b.id""",
)
def enrich_technique_fields(v):
    bound = v.binding.join(v.kb.select("s_suppkey", "technique_id"), "s_suppkey").selectExpr(
        "pos", "CASE WHEN pos % 9 = 0 THEN 'T0002' ELSE technique_id END AS technique_id",
        "CASE pos % 4 WHEN 0 THEN '' WHEN 1 THEN 'own name' END AS name", "CASE WHEN pos % 2 = 1 THEN 'https://own/' END AS url", "'declared' AS tactic",
    )
    return enrich.fill_techniques(bound, v.kb).select("pos", "technique_id", "name", "url", "enriched", "warning")


@query(
    "enrich_cve_fields",
    """SELECT r.detection_id, r.o_orderkey, coalesce(r.score, c.score) AS cvss_score,
              CASE WHEN coalesce(r.text, '') = '' AND c.text <> '' THEN c.text ELSE r.text END AS description,
              (r.score IS NULL AND c.score IS NOT NULL) OR (coalesce(r.text, '') = '' AND coalesce(c.text, '') <> '') AS enriched
       FROM (SELECT DISTINCT detection_id, o_orderkey, CASE WHEN detection_id % 3 = 0 THEN 5.5::DOUBLE END AS score,
                    CASE o_orderkey % 3 WHEN 0 THEN 'own' WHEN 1 THEN '' END AS text FROM detection_cve) r
       LEFT JOIN (SELECT o_orderkey, CASE WHEN cvss_tenths > 9 THEN CAST(cvss_tenths AS DOUBLE) / 10 END AS score,
                         CASE WHEN cvss_tenths % 2 = 0 THEN priority ELSE '' END AS text FROM cve) c ON c.o_orderkey = r.o_orderkey""",
)
def enrich_cve_fields(v):
    refs = v.detection_cve.select("detection_id", "o_orderkey").distinct().selectExpr(
        "detection_id", "o_orderkey AS cve_id", "CASE WHEN detection_id % 3 = 0 THEN 5.5D END AS cvss_score",
        "CASE o_orderkey % 3 WHEN 0 THEN 'own' WHEN 1 THEN '' END AS description",
    )
    cves = v.cve.selectExpr("o_orderkey AS cve_id", "CASE WHEN cvss_tenths > 9 THEN CAST(cvss_tenths AS DOUBLE) / 10 END AS cvss_score", "CASE WHEN cvss_tenths % 2 = 0 THEN priority ELSE '' END AS description")
    return enrich.fill_references(refs, cves).withColumnRenamed("cve_id", "o_orderkey").select("detection_id", "o_orderkey", "cvss_score", "description", "enriched")


@query(
    "primary_binding",
    """SELECT b.detection_id, k.technique_id FROM (
         SELECT detection_id, s_suppkey, row_number() OVER (PARTITION BY detection_id ORDER BY conf_pct DESC, pos) AS rn FROM binding) b
       JOIN kb k ON k.s_suppkey = b.s_suppkey WHERE b.rn = 1""",
)
def primary_binding(v):
    """Of each rule's list of bindings the most confident, the earliest of equals."""
    bound = v.binding.join(v.kb.select("s_suppkey", "technique_id"), "s_suppkey")
    lists = bound.groupBy("detection_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("conf_pct").alias("confidence"), "technique_id"))).alias("bindings"))
    return lists.select("detection_id", labels.primary_technique(F.col("bindings"))["technique_id"].alias("technique_id"))


@query(
    "rejected_records",
    """SELECT detection_id, concat_ws(',', CASE WHEN detection_id % 7 = 0 THEN 'name' END, CASE WHEN severity = 'med' THEN 'severity' END,
              CASE WHEN detection_id % 10 = 3 THEN 'portability_score' END, CASE WHEN detection_id % 4 = 1 THEN 'technique_confidence' END) AS violations
       FROM detection WHERE detection_id % 7 = 0 OR severity = 'med' OR detection_id % 10 = 3 OR detection_id % 4 = 1""",
)
def rejected_records(v):
    """Canonical records with faults of several kinds, split from the good ones by the library's own checks."""
    confidence = F.when(F.col("detection_id") % 4 == 1, 1.5).otherwise(0.5)
    bound = technique_structs(F.array(F.lit("T1059.001")))
    records = v.detection.select(
        "detection_id", F.when(F.col("detection_id") % 7 == 0, "").otherwise(F.col("name")).alias("name"),
        F.when(F.col("severity") == "med", "medium-ish").otherwise(F.col("severity")).alias("severity"), F.lit("sigma").alias("source_format"), "validation_status",
        F.array(F.lit("linux")).alias("platforms"), F.when(F.col("detection_id") % 10 == 3, 100.5).otherwise(99.0).alias("portability_score"),
        F.array(F.struct(F.lit("windows").alias("product"), *[F.lit(None).cast("string").alias(c) for c in ("category", "service", "definition")])).alias("log_sources"),
        F.transform(bound, lambda b: b.withField("confidence", confidence)).alias("mitre_techniques"),
        F.array(F.struct(F.lit("CVE-2024-0001").alias("cve_id"), F.lit(0.9).alias("confidence"), F.lit(7.5).alias("cvss_score"))).alias("cve_references"),
    )
    _, rejects = quality.split_rejects(records, quality.detection_checks())
    return rejects.select("detection_id", F.array_join("violations", ",").alias("violations"))

"""Chains, paths and factored sets over the knowledge base and its bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchfloor.operators import coverage, graph, knowledge
from watchfloor.operators.vulnerabilities import CoveringRules
from watchfloor.session import join_dimension
from workload.registry import query

IDS = 1_000_000  # rows of two short columns that are broadcast rather than shuffling bindings


def covering(v):
    ids = v.kb.select("s_suppkey", "technique_id")
    mapped = join_dimension(v.cve_technique, ids, "s_suppkey", max_rows=IDS).select("o_orderkey", "technique_id")
    bound = join_dimension(v.binding, ids, "s_suppkey", max_rows=IDS).select("technique_id", "detection_id")
    return CoveringRules(mapped, bound, "o_orderkey", "detection_id")


RULE_PARENT = """
    SELECT DISTINCT split_part(k.technique_id, '.', 1) AS parent, b.detection_id
    FROM binding b JOIN kb k ON b.s_suppkey = k.s_suppkey"""


@query(
    "cve_covering_rules",
    f"""SELECT p.o_orderkey, count(DISTINCT r.detection_id) AS n_rules
        FROM (SELECT DISTINCT o_orderkey, parent FROM cve_pair) p LEFT JOIN ({RULE_PARENT}) r ON p.parent = r.parent
        GROUP BY p.o_orderkey""",
)
def cve_covering_rules(v):
    return covering(v).per_cve()


@query(
    "cve_technique_rules",
    f"""SELECT p.o_orderkey, p.technique_id, count(r.detection_id) AS n_rules
        FROM cve_pair p LEFT JOIN ({RULE_PARENT}) r ON p.parent = r.parent GROUP BY p.o_orderkey, p.technique_id""",
)
def cve_technique_rules(v):
    return covering(v).per_technique()


@query(
    "coverage_entry_members",
    """SELECT * FROM (WITH bound_to AS (
         SELECT DISTINCT t.technique_id, b.detection_id
         FROM binding b JOIN (SELECT s_suppkey, technique_id FROM kb
                              UNION SELECT s_suppkey, split_part(technique_id, '.', 1) FROM kb) t
         ON b.s_suppkey = t.s_suppkey)
       SELECT technique_id, 'rule' AS kind, CAST(detection_id AS VARCHAR) AS member FROM bound_to
       UNION ALL
       SELECT DISTINCT b.technique_id, 'data', d.data_component FROM bound_to b JOIN detection d ON b.detection_id = d.detection_id) m""",
)
def coverage_entry_members(v):
    bound = v.binding.join(v.kb.select("s_suppkey", "technique_id"), "s_suppkey").select("technique_id", "detection_id")
    return coverage.entry_members(bound, v.detection, "detection_id", "data_component")


# Every part is revoked by the one before it, up to the next multiple of fifty; a few revoke each other.
REVOKED_BY = "CASE WHEN p_partkey % 97 = 5 THEN p_partkey + 1 ELSE p_partkey - 1 END"


@query(
    "revoked_chains",
    f"""WITH RECURSIVE edge AS (
          SELECT p_partkey AS source, {REVOKED_BY} AS target FROM part WHERE p_partkey % 50 <> 0),
        walk AS (
          SELECT source, target AS spot, 1 AS steps FROM edge
          UNION ALL
          SELECT w.source, e.target, w.steps + 1 FROM walk w JOIN edge e ON w.spot = e.source WHERE w.steps < 60),
        ended AS (SELECT * FROM walk WHERE spot NOT IN (SELECT source FROM edge))
        SELECT e.source, d.spot AS "end", CAST(d.steps AS BIGINT) AS steps, d.source IS NULL AS cyclic
        FROM edge e LEFT JOIN ended d ON e.source = d.source""",
)
def revoked_chains(v):
    edges = v.table("part").filter("p_partkey % 50 <> 0").selectExpr("p_partkey AS source", f"{REVOKED_BY} AS target")
    return graph.chain_ends(edges)


def knowledge_edges(v):
    """Nations use suppliers, suppliers use parts, parts are of use to nations."""
    uses = v.table("supplier").selectExpr("'group' AS relationship", "concat('g', s_nationkey) AS source_ref", "concat('s', s_suppkey) AS target_ref")
    soft = v.table("lineitem").selectExpr("'software'", "concat('s', l_suppkey)", "concat('p', l_partkey)")
    back = v.table("part").selectExpr("'back'", "concat('p', p_partkey)", "concat('g', p_partkey % 25)")
    return uses.union(soft).union(back)


@query(
    "group_software_paths",
    """WITH s AS (SELECT DISTINCT s_nationkey, s_suppkey FROM supplier),
            l AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
       SELECT 'g' || s_nationkey AS start, 'g' || (l_partkey % 25) AS "end", count(*) AS n
       FROM s JOIN l ON l.l_suppkey = s.s_suppkey JOIN part p ON p.p_partkey = l.l_partkey
       WHERE s_nationkey <> l_partkey % 25 GROUP BY 1, 2""",
)
def group_software_paths(v):
    found = graph.paths(knowledge_edges(v), ["group", "software", "back"])
    return found.groupBy("start", "end").agg(F.count(F.lit(1)).alias("n"))


@query(
    "technique_procedures",
    """SELECT k.technique_id, CAST(l.l_partkey AS VARCHAR) AS source_id, p.p_name AS source_name, l.l_returnflag AS description
       FROM lineitem l JOIN kb k ON l.l_suppkey = k.s_suppkey JOIN part p ON p.p_partkey = l.l_partkey
       WHERE l.l_linenumber <> 2""",
)
def technique_procedures(v):
    """Every use of a technique with what its edge says; edges of another kind stay out."""
    edges = v.table("lineitem").select(
        F.when(F.col("l_linenumber") == 2, "mitigates").otherwise("uses").alias("relationship"),
        F.concat(F.lit("part--"), "l_partkey").alias("source_ref"),
        F.concat(F.lit("technique--"), "l_suppkey").alias("target_ref"),
        F.col("l_returnflag").alias("description"),
    )
    sources = v.table("part").select(F.concat(F.lit("part--"), "p_partkey").alias("stix_id"), F.col("p_partkey").cast("string").alias("external_id"), F.col("p_name").alias("name"))
    techniques = v.kb.select(F.concat(F.lit("technique--"), "s_suppkey").alias("stix_id"), "technique_id")
    return knowledge.related(edges, sources, techniques, "uses")

"""CVE intelligence: merging feeds, binding CVEs to techniques, coverage and residual risk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfloor.functions.ids import FULL_TECHNIQUE, parent_technique
from watchfloor.functions.labels import residual_risk
from watchfloor.operators import united

# Confidence of a direct mapping and of a weakness mapping that states none.
DIRECT_CONFIDENCE = 0.90
WEAKNESS_CONFIDENCE = 0.60


def merge_feeds(feeds: Mapping[str, DataFrame], key: str = "cve_id", modified: str = "last_modified") -> DataFrame:
    """One row per CVE that any feed knows, with every feed's columns and an ``in_<feed>`` flag.

    The feeds are stacked and grouped once, which costs one shuffle where chained full outer joins cost one per
    feed. Where a feed repeats an id, one whole record of it counts: the last by ``modified`` if the feed has that column,
    ties (and feeds without it) by the record's text. A column that several feeds have comes from the first that fills it.
    """
    columns = {f.name: f.dataType for feed in feeds.values() for f in feed.schema if f.name != key}
    stacked = None
    for name, feed in feeds.items():
        own = [c for c in columns if c in feed.columns]
        order = F.struct(
            (F.col(modified).cast("string") if modified in own else F.lit(None).cast("string")).alias("at"),
            F.to_json(F.struct(*own) if own else F.struct(key)).alias("text"),
        )
        shaped = feed.select(
            F.upper(key).alias(key), F.lit(name).alias("_feed"), order.alias("_order"),
            *[(F.col(c) if c in own else F.lit(None).cast(kind)).alias(c) for c, kind in columns.items()],
        )
        stacked = shaped if stacked is None else stacked.unionByName(shaped)
    record = F.struct(*columns) if columns else F.struct(key)
    last = [F.max_by(record, F.when(F.col("_feed") == name, F.col("_order"))).alias(f"_{name}") for name in feeds]
    present = [F.max(F.col("_feed") == name).alias(f"in_{name}") for name in feeds]
    grouped = stacked.groupBy(key).agg(*last, *present)
    values = [F.coalesce(*[F.col(f"_{name}")[c] for name in feeds]).alias(c) for c in columns]
    return grouped.select(key, *values, *[f"in_{name}" for name in feeds])


def direct_techniques(records: DataFrame, key: str = "cve_id", techniques: str = "techniques") -> DataFrame:
    """Directly mapped techniques; malformed ids are dropped."""
    return (
        records.select(key, F.explode(techniques).alias("technique_id"))
        .withColumn("technique_id", F.trim("technique_id"))
        .filter(F.col("technique_id").rlike(FULL_TECHNIQUE))
        .withColumns({"source": F.lit("ctid"), "confidence": F.lit(DIRECT_CONFIDENCE)})
    )


def weakness_techniques(weaknesses: DataFrame, cwe_map: DataFrame) -> DataFrame:
    """(CVE, CWE) rows joined with the weakness map, one row per mapped technique."""
    return weaknesses.join(cwe_map, "cwe_id").withColumn("source", F.lit("cwe"))


def merge_techniques(bindings: DataFrame, by: Sequence[str], sources: Sequence[str], confidence: str) -> DataFrame:
    """Per CVE and technique: the highest confidence and the sources that reach it, joined in priority order."""
    grouped = bindings.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("source") == name, F.col(confidence))).alias(f"_{name}") for name in sources
        ],
        F.max(confidence).alias(confidence),
    )
    label = F.concat_ws("+", *[F.when(F.col(f"_{n}") == F.col(confidence), F.lit(n)) for n in sources])
    return grouped.select(*by, confidence, label.alias("source"))


def covered_parents(bound: DataFrame) -> DataFrame:
    """Distinct parent ids of bound techniques: the granularity at which a rule covers a CVE's technique."""
    return bound.select(parent_technique(F.col("technique_id")).alias("parent")).distinct()


def flag_covered(techniques: DataFrame, bound: DataFrame, granularity: str = "parent") -> DataFrame:
    """Techniques with ``covered``: whether a bound technique shares the parent, or with ``exact`` the id."""
    keyed = techniques.withColumn(
        "parent", parent_technique(F.col("technique_id")) if granularity == "parent" else F.col("technique_id")
    )
    known = (
        covered_parents(bound) if granularity == "parent" else bound.select(F.col("technique_id").alias("parent"))
        .distinct()
    )
    return keyed.join(known.withColumn("_hit", F.lit(True)), "parent", "left").select(
        *techniques.columns, F.coalesce("_hit", F.lit(False)).alias("covered")
    )


def coverage_per_cve(flagged: DataFrame, key: str) -> DataFrame:
    """(key, n, covered) over distinct (CVE, technique) rows."""
    return flagged.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if("covered").alias("covered"))


def coverage_ratio(covered: Column, total: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) == 0, 0.0).otherwise(covered / total)


def with_residual_risk(cves: DataFrame, digits: int | None = 4) -> DataFrame:
    """Add ``coverage_ratio`` and ``residual_risk`` to (cvss_score, epss, covered, n) rows."""
    ratio = coverage_ratio(F.col("covered"), F.col("n"))
    return cves.withColumn("coverage_ratio", ratio).withColumn(
        "residual_risk", residual_risk(F.col("cvss_score"), F.col("epss"), F.col("coverage_ratio"), digits)
    )


class CoveringRules:
    """Which rules cover the techniques of which CVEs, factored: CVEs point at parent techniques and parents at rules, and the
    product of the two is never made. Both tables are as long as what they are made of.

    ``cve_techniques`` is (cve, technique_id), ``bindings`` (technique_id, rule); a rule covers a technique if it is bound to
    one with the same parent. Null techniques cover nothing. ``techniques`` lists the parents of a CVE's techniques, ``rules``
    the rules of a parent; joined on ``parent`` for one CVE they are its covering rules.
    """

    def __init__(self, cve_techniques: DataFrame, bindings: DataFrame, cve: str, rule: str):
        self.cve, self.rule = cve, rule
        parent = parent_technique(F.col("technique_id")).alias("parent")
        self.cve_parents = cve_techniques.select(cve, "technique_id", parent).filter("parent IS NOT NULL")  # rows may repeat
        self.parent_rules = bindings.select(parent, rule).filter(f"parent IS NOT NULL AND `{rule}` IS NOT NULL")
        self.techniques, self.rules = self.cve_parents.distinct(), self.parent_rules.distinct()

    def of(self, cves: DataFrame) -> DataFrame:
        """(cve, technique_id, rule) of the given CVEs (a table with their ids), which are few."""
        wanted = self.techniques.join(cves.select(self.cve).distinct(), self.cve, "left_semi")
        return wanted.join(self.rules, "parent").select(self.cve, "technique_id", self.rule)

    def sets(self) -> DataFrame:
        """(parent, bucket, members): each parent's rules as packed numbers (see ``united``)."""
        return united.sets(self.parent_rules, "parent", self.rule)

    def per_technique(self) -> DataFrame:
        """(cve, technique_id, n_rules)"""
        sizes = self.rules.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
        joined = self.techniques.join(sizes, "parent", "left")
        return joined.select(self.cve, "technique_id", F.coalesce("n", F.lit(0)).alias("n_rules"))

    def per_cve(self) -> DataFrame:
        """(cve, n_rules): distinct rules that cover any technique of the CVE, counted by uniting its parents' sets."""
        counts = united.counts(self.cve_parents, self.sets(), self.cve, "parent", empty=True)
        return counts.withColumnRenamed("n", "n_rules")

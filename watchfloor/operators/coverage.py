"""Coverage of the technique knowledge base by a rule corpus: matrix, layer, scores, gaps.

Every report starts from distinct (technique, rule) pairs or from one flag per technique, both of which are combined
map-side. No operator gathers all rules of a technique in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchfloor.functions.ids import parent_technique
from watchfloor.functions.labels import badge_color, confidence_color

# How many rule names a layer comment lists unless told otherwise.
NAMES_IN_COMMENT = 5


def floor_pct(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down; zero when there is nothing to cover."""
    return F.when(whole == 0, 0).otherwise(F.floor(part * 100 / whole)).cast("int")


def rule_pairs(bindings: DataFrame, by: Sequence[str], rule: str, confidence: str) -> DataFrame:
    """One row per (technique, rule) with its highest confidence."""
    return bindings.groupBy(*by, rule).agg(F.max(confidence).alias("confidence"))


def first_names(pairs: DataFrame, by: Sequence[str], name: str, k: int) -> DataFrame:
    """(by, names): the first ``k`` rule names in order. Tasks forward at most ``k`` names per technique."""
    ranked = pairs.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(name))).filter(F.col("_rn") <= k)
    names = F.transform(F.array_sort(F.collect_list(F.struct("_rn", name))), lambda s: s[name])
    return ranked.groupBy(*by).agg(names.alias("names"))


def rules_per_technique(pairs: DataFrame, by: Sequence[str], name: str, k: int) -> DataFrame:
    """(by, n_rules, confidence, names): rule count, highest confidence and first ``k`` names per technique."""
    totals = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rules"), F.max("confidence").alias("confidence"))
    return totals.join(first_names(pairs, by, name, k), list(by))


def coverage_matrix(bindings: DataFrame) -> DataFrame:
    """The matrix in long form: distinct (tactic, technique_id, name) rows."""
    return bindings.select(F.coalesce("tactic", F.lit("unknown")).alias("tactic"), "technique_id", "name").distinct()


def layer_comment(n_rules: Column, names: Column, most: int = NAMES_IN_COMMENT) -> Column:
    """``7 detections: a, b, c, d, e (+2 more)``."""
    return F.concat(
        n_rules.cast("string"), F.when(n_rules == 1, " detection: ").otherwise(" detections: "),
        F.array_join(F.slice(names, 1, most), ", "),
        F.when(
            n_rules > most,
            F.concat(F.lit(" (+"), (n_rules - most).cast("string"), F.lit(" more)")),
        ).otherwise(""),
    )


def layer_rows(summary: DataFrame, most: int = NAMES_IN_COMMENT) -> DataFrame:
    """Layer cells from ``rules_per_technique``; confidence is a fraction, a comment lists ``most`` names."""
    return summary.select(
        "technique_id",
        F.bround(F.col("confidence") * 100).cast("int").alias("score"),
        F.col("n_rules").alias("rule_count"),
        layer_comment(F.col("n_rules"), F.col("names"), most).alias("comment"),
        confidence_color(F.col("confidence")).alias("color"),
    )


def technique_flags(bindings: DataFrame, covering: DataFrame, key: str) -> DataFrame:
    """(key, covered): every bound technique, flagged where it also occurs among the ``covering`` bindings.

    Both sides are reduced to distinct keys first, so the join sees at most one row per technique and side.
    """
    hit = covering.select(key).distinct().withColumn("_hit", F.lit(True))
    return (
        bindings.select(key).distinct().join(hit, key, "left").select(key, F.col("_hit").isNotNull().alias("covered"))
    )


def badge(flags: DataFrame, detections: DataFrame, passed: Column) -> DataFrame:
    """One row: technique totals, coverage percentage and colour, rule totals.

    The two totals are computed apart and added up, which avoids a join without keys.
    """
    zero = F.lit(0).cast("bigint")
    techniques = flags.agg(
        F.count(F.lit(1)).alias("total_techniques"), F.count_if("covered").alias("covered_techniques")
    ).select("total_techniques", "covered_techniques", zero.alias("rules_total"), zero.alias("rules_passed"))
    rules = detections.agg(
        F.count(F.lit(1)).alias("rules_total"), F.count_if(passed).alias("rules_passed")
    ).select(zero.alias("total_techniques"), zero.alias("covered_techniques"), "rules_total", "rules_passed")
    names = techniques.columns
    totals = techniques.unionByName(rules).agg(*[F.sum(n).alias(n) for n in names])
    share = F.col("covered_techniques") * 100 / F.col("total_techniques")
    pct = F.when(F.col("total_techniques") == 0, 0.0).otherwise(F.round(share, 1))
    return totals.withColumn("pct", pct).withColumn("color", badge_color(F.col("pct")))


def tactic_coverage(flags: DataFrame, tactic: Column) -> DataFrame:
    """(tactic, covered, total, pct) from one flag row per technique."""
    out = flags.groupBy(tactic.alias("tactic")).agg(
        F.count_if("covered").alias("covered"), F.count(F.lit(1)).alias("total")
    )
    return out.withColumn("pct", floor_pct(F.col("covered"), F.col("total")))


def coverage_entries(pairs: DataFrame, detections: DataFrame, by: str, rule: str) -> DataFrame:
    """Per technique: rules, passed rules, maturity and the share of rules that passed."""
    out = pairs.join(detections.select(rule, "validation_status", "maturity"), rule).groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rules"),
        F.count_if(F.col("validation_status") == "passed").alias("validated_count"),
        F.sum("maturity").alias("maturity_sum"),
    )
    return out.withColumn("coverage_score", F.col("validated_count") / F.col("n_rules")).withColumn(
        "maturity_avg", F.col("maturity_sum") / F.col("n_rules")
    )


def entry_members(bindings: DataFrame, detections: DataFrame, rule: str, data: str) -> DataFrame:
    """(technique_id, kind, member): the rules that map to each technique (``rule``) and the data that feed them (``data``), each
    once and in rows of their own, as many as there are bindings at most.

    ``bindings`` is (technique_id, rule), ``detections`` (rule, data, ...). Sub-techniques count for their parents too.
    """
    ids = F.array_distinct(F.array("technique_id", parent_technique(F.col("technique_id"))))
    bound = bindings.filter("technique_id IS NOT NULL").select(F.explode(ids).alias("technique_id"), rule).distinct()
    rules = bound.select("technique_id", F.lit("rule").alias("kind"), F.col(rule).cast("string").alias("member"))
    fed = bound.join(detections.select(rule, F.col(data).alias("_data")), rule).filter("_data IS NOT NULL").select("technique_id", "_data").distinct()
    return rules.unionByName(fed.select("technique_id", F.lit("data").alias("kind"), F.col("_data").cast("string").alias("member")))


def is_covered(n_rules: Column) -> Column:
    return F.coalesce(n_rules, F.lit(0)) > 0


def letter_grade(pct: Column) -> Column:
    return F.when(pct >= 90, "A").when(pct >= 75, "B").when(pct >= 50, "C").when(pct >= 25, "D").otherwise("F")


def coverage_score(techniques: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """One row over the active techniques: total, covered, validated, percentage and grade.

    ``flags`` has one row per bound technique with ``validated``.
    """
    joined = techniques.filter(~F.col("deprecated")).select(key).join(
        flags.select(key, "validated", F.lit(True).alias("bound")), key, "left"
    )
    out = joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("bound").isNotNull()).alias("covered"),
        F.count_if(F.coalesce("validated", F.lit(False))).alias("validated"),
    )
    pct = floor_pct(F.col("covered"), F.col("total"))
    return out.withColumn("score_pct", pct).withColumn("grade", letter_grade(pct))


def gaps(techniques: DataFrame, bindings: DataFrame, key: str) -> DataFrame:
    """Active techniques without any binding; the bindings are reduced to distinct keys before the anti join."""
    return techniques.filter(~F.col("deprecated")).join(bindings.select(key).distinct(), key, "left_anti")


def gap_priority(frequency: Column, severity: Column, effort: Column) -> Column:
    """Threat frequency x severity weight / effort weight, clamped to 0..10."""
    severity_weight = F.when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)
    effort_weight = F.when(effort == "low", 1).when(effort == "high", 3).otherwise(2)
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), frequency * severity_weight / effort_weight))


def top_gaps(gap: DataFrame, frequency: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` gaps with the most threat-intel hits."""
    hits = F.coalesce(F.col("freq"), F.lit(0).cast("bigint"))
    return (
        gap.join(frequency, key, "left")
        .select("technique_id", hits.alias("freq"))
        .orderBy(F.col("freq").desc(), "technique_id")
        .limit(n)
    )


def uncovered(techniques: DataFrame, bound: DataFrame) -> DataFrame:
    """Knowledge-base ids minus bound ids."""
    return techniques.select("technique_id").distinct().join(bound.select("technique_id").distinct(), "technique_id",
                                                             "left_anti")


def result_totals(results: DataFrame) -> DataFrame:
    """One row: rules per status and the share that passed."""

    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    out = results.agg(
        F.count(F.lit(1)).alias("total"), n("pass").alias("passed"), n("fail").alias("failed"),
        n("skip").alias("skipped"), n("error").alias("errors"),
    )
    return out.withColumn("pass_pct", floor_pct(F.col("passed"), F.col("total")))


def technique_totals(results: DataFrame, rule_technique: DataFrame) -> DataFrame:
    """One row: distinct techniques of passing rules and of all rules."""
    flags = rule_technique.join(results.select("rule_id", "status"), "rule_id").groupBy("technique_id").agg(
        F.max(F.col("status") == "pass").alias("covered")
    )
    return flags.agg(F.count_if("covered").alias("covered"), F.count(F.lit(1)).alias("techniques"))


def migration_totals(analyses: DataFrame, by: Sequence[str]) -> DataFrame:
    """Translatable, to-review and untranslatable rules per migration path."""
    clean = F.col("grade").isin("A", "B")
    return analyses.groupBy(*by).agg(
        F.count_if(clean).alias("translatable"),
        F.count_if(F.col("grade").isin("C", "D")).alias("review"),
        F.count_if(F.col("grade") == "F").alias("untranslatable"),
    )

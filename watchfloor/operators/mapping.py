"""Binding rules to techniques: validating declared ids, inferring missing ones, choosing between them.

Binding tables are (rule, technique) rows with a confidence, a source and a position ``pos`` that makes every
"first wins" explicit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchfloor.functions.ids import FULL_TECHNIQUE, canonical_technique

# Thresholds of the mapping step.
MIN_APPLY_CONFIDENCE = 0.50
MIN_CANDIDATE_CONFIDENCE = 0.30


@dataclass(frozen=True)
class KeywordHint:
    keyword: str
    techniques: tuple[str, ...]
    confidence: float = 0.65
    is_regex: bool = False

    def matches(self, text: Column) -> Column:
        if self.is_regex:
            return text.rlike("(?i)" + self.keyword)
        return F.contains(text, F.lit(self.keyword.lower()))


@dataclass(frozen=True)
class SourceHint:
    log_sources: tuple[str, ...]
    keywords: tuple[str, ...]
    techniques: tuple[str, ...]
    confidence: float = 0.60

    def matches(self, text: Column, sources: Column) -> Column:
        named = F.arrays_overlap(sources, F.array(*[F.lit(s.lower()) for s in self.log_sources]))
        found = F.lit(False)
        for keyword in self.keywords:
            found = found | F.contains(text, F.lit(keyword.lower()))
        return named & found


def infer(
    docs: DataFrame,
    keep: Sequence[str],
    text: Column,
    keyword_hints: Sequence[KeywordHint] = (),
    source_hints: Sequence[SourceHint] = (),
    log_sources: Column | None = None,
    scale: float = 1.0,
    kind: str = "double",
) -> DataFrame:
    """(kept columns, technique_id, confidence, source): the best hint per document and technique.

    Hints are a small configured list, so each technique becomes one CASE over its hints in order of confidence
    (keyword before data source, then list order). A document's bindings are found inside its own row: no join,
    no shuffle, whatever the number of documents. ``text`` must be lower case.
    """
    ranked: dict[str, list[tuple]] = {}
    for position, hint in enumerate(keyword_hints):
        for technique in hint.techniques:
            ranked.setdefault(technique, []).append((-hint.confidence, 0, position, "keyword", hint.matches(text)))
    for position, hint in enumerate(source_hints):
        for technique in hint.techniques:
            ranked.setdefault(technique, []).append(
                (-hint.confidence, 1, position, "datasource", hint.matches(text, log_sources))
            )
    bindings = []
    for technique, options in sorted(ranked.items()):
        best = None
        for negative, _, _, source, matches in sorted(options, key=lambda o: o[:3]):
            value = F.struct(
                F.lit(technique).alias("technique_id"),
                F.lit(-negative * scale).cast(kind).alias("confidence"),
                F.lit(source).alias("source"),
            )
            best = F.when(matches, value) if best is None else best.when(matches, value)
        bindings.append(best)
    exploded = docs.select(*keep, F.explode(F.array(*bindings)).alias("b"))
    return exploded.filter(F.col("b").isNotNull()).select(*keep, "b.*")


def known_and_active(bindings: DataFrame, techniques: DataFrame) -> DataFrame:
    """Bindings whose technique exists and is not deprecated, with the knowledge base tactic added."""
    active = techniques.filter(~F.col("deprecated")).select("technique_id", "tactic")
    return bindings.join(active, "technique_id")


def validate_explicit(bindings: DataFrame, techniques: DataFrame, replacement: DataFrame | None = None) -> DataFrame:
    """Declared bindings checked against the knowledge base.

    Adds ``error`` (unknown or malformed id), ``deprecated``, ``replacement``, ``warnings`` and a tactic filled from
    the knowledge base where the rule names none. ``bindings``: detection_id, technique_id, tactic, confidence.
    """
    kb = techniques.select(
        "technique_id", F.col("tactic").alias("kb_tactic"), F.col("deprecated").alias("kb_deprecated"),
        F.lit(True).alias("known"),
    )
    if replacement is not None:
        kb = kb.join(replacement, "technique_id", "left")
    else:
        kb = kb.withColumn("replacement", F.lit(None).cast("string"))
    parents = techniques.select(F.col("technique_id").alias("_parent"), F.lit(True).alias("parent_known"))
    canonical = canonical_technique(F.col("raw_id"))
    joined = (
        bindings.withColumnRenamed("technique_id", "raw_id")
        .withColumn("technique_id", canonical)
        .join(kb, "technique_id", "left")
        .withColumn("_parent", F.substring_index("technique_id", ".", 1))
        .join(parents, "_parent", "left")
    )
    unnamed = F.coalesce("tactic", F.lit("")).isin("", "unknown")
    error = F.when(
        F.col("technique_id").isNull(), F.concat(F.lit("Invalid technique ID: "), F.col("raw_id"))
    ).when(F.col("known").isNull(), F.concat(F.col("technique_id"), F.lit(" not found in the knowledge base")))
    warnings = F.array_compact(
        F.array(
            F.when(
                F.col("deprecated"),
                F.concat(
                    F.col("technique_id"), F.lit(" is deprecated/revoked"),
                    F.coalesce(F.concat(F.lit("; suggested replacement: "), F.col("replacement")), F.lit("")),
                ),
            ),
            F.when(
                F.col("unnamed") & ~F.col("deprecated"),
                F.concat(F.lit("Filled missing tactic for "), F.col("technique_id"), F.lit(": "), F.col("tactic")),
            ),
            F.when(
                F.contains("technique_id", F.lit(".")) & F.col("parent_known").isNull(),
                F.concat(
                    F.lit("Parent technique "), F.col("_parent"), F.lit(" not found for "), F.col("technique_id")
                ),
            ),
        )
    )
    return (
        joined.withColumn("unnamed", unnamed)
        .withColumn("error", error)
        .withColumn("tactic", F.when(F.col("unnamed"), F.col("kb_tactic")).otherwise(F.col("tactic")))
        .withColumn("deprecated", F.coalesce("kb_deprecated", F.lit(False)))
        .withColumn("warnings", F.when(F.col("error").isNull(), warnings).otherwise(F.array().cast("array<string>")))
        .drop("unnamed", "kb_tactic", "kb_deprecated", "known", "parent_known", "_parent", "raw_id")
    )


def flag_deprecated(bindings: DataFrame, techniques: DataFrame, key: str) -> DataFrame:
    """Bindings LEFT JOIN knowledge base on its own key: technique id and deprecation flag added."""
    return bindings.join(techniques.select(key, "technique_id", "deprecated"), key, "left")


def best_binding(
    bindings: DataFrame, by: Sequence[str], confidence: str, ties: Sequence[Column], take: Mapping[str, Column | str]
) -> DataFrame:
    """The highest-confidence row per ``by``; ``ties`` are ascending tie-breakers.

    A minimum over one struct, so it is combined map-side and needs no sort or window.
    """
    order = [(-F.col(confidence)).alias("_c"), *[t.alias(f"_t{i}") for i, t in enumerate(ties)]]
    kept = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in take.items()]
    best = bindings.groupBy(*by).agg(F.min(F.struct(*order, *kept)).alias("_b"))
    return best.select(*by, *[F.col(f"_b.{name}").alias(name) for name in take])


def first_wins(bindings: DataFrame, by: Sequence[str], order: Sequence[Column], take: Sequence[str]) -> DataFrame:
    """One row per ``by``: the first in ``order``."""
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    first = bindings.groupBy(*by).agg(F.min(F.struct(*keys, *take)).alias("_f"))
    return first.select(*by, *[F.col(f"_f.{name}").alias(name) for name in take])


def gap_fill(inferred: DataFrame, explicit: DataFrame, by: Sequence[str]) -> DataFrame:
    """Inferred bindings no explicit binding already states."""
    return inferred.join(explicit.select(*by).distinct(), list(by), "left_anti")


def only_inferred(bindings: DataFrame, by: Sequence[str], is_explicit: Column) -> DataFrame:
    """``gap_fill`` for passes stacked in one table: keys no explicit row states, in one scan and one shuffle."""
    return bindings.groupBy(*by).agg(F.max(is_explicit).alias("_e")).filter(~F.col("_e")).drop("_e")


def apply_bindings(
    current: DataFrame, proposed: DataFrame, rule: str, min_confidence: float = MIN_APPLY_CONFIDENCE
) -> DataFrame:
    """Replace a rule's bindings by the accepted proposals; a rule with none accepted keeps what it had."""
    accepted = proposed.filter(F.col("confidence") >= min_confidence)
    untouched = current.join(accepted.select(rule).distinct(), rule, "left_anti")
    return accepted.withColumn("confidence", F.bround("confidence", 3)).unionByName(
        untouched, allowMissingColumns=True
    )


def usable_candidates(
    candidates: DataFrame, techniques: DataFrame, rule: str, pos: str = "pos", most: int | None = None
) -> DataFrame:
    """Externally proposed bindings: confident enough, valid, known and active; with ``most`` only a rule's first ones."""
    if most is not None:
        rank = F.row_number().over(W.partitionBy(rule).orderBy(pos))
        candidates = candidates.withColumn("_rn", rank).filter(F.col("_rn") <= most).drop("_rn")
    checked = (
        candidates.drop(pos)
        .withColumn("technique_id", canonical_technique(F.col("technique_id")))
        .filter((F.col("confidence") >= MIN_CANDIDATE_CONFIDENCE) & F.col("technique_id").rlike(FULL_TECHNIQUE))
    )
    return known_and_active(checked, techniques).withColumn("source", F.lit("candidate"))

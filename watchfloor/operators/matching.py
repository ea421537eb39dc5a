"""Rules x telemetry: which rule fires on which event, and how often.

Rules compiled here are the query text, in bounded batches; corpora of thousands go through ``layers``, where rules stay
a table. Events stay distributed. Every event is reduced, inside generated code, to a *signature*: the list of rule numbers its fields, technique and
words satisfy. Counting groups by signature before any rule is expanded, so the shuffle carries one row per
distinct signature and task, however hot a technique or rule is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchfloor.functions.ids import parent_technique
from watchfloor.functions.text import keyword_tokens
from watchfloor.operators.predicates import (
    Fields, UntranslatableCondition, patterns, required_values, rule_predicate,
)
from watchfloor.session import inline_table, join_dimension, sql_string

# The fields each kind of keyword search reads, and how many samples a result keeps.
FREE_TEXT_FIELDS = ("proctitle", "cmd_output", "message", "raw", "a2", "key")
INDEXED_TEXT_FIELDS = ("proctitle", "cmd_output", "message", "raw", "a2")
SAMPLES_PER_RULE = 3
RULES_PER_BATCH = 5_000
NO_PREDICATES = "Rule has no technique IDs or keywords to match against"


# ---- time window and haystacks --------------------------------------------------------------------------


def since(events: DataFrame, start: str | None, time: str = "timestamp", null_ts: str = "keep") -> DataFrame:
    """Look-back window from a literal start; ``null_ts`` keeps or drops events whose time could not be read."""
    if start is None:
        return events
    bound = F.lit(start).cast(events.schema[time].dataType)
    recent = F.col(time) >= bound
    return events.filter(recent | F.col(time).isNull() if null_ts == "keep" else recent)


def haystack(events: DataFrame, fields: Sequence[str] = FREE_TEXT_FIELDS) -> Column:
    """Lower-case free text of an event, over whichever of ``fields`` the table has."""
    present = [F.col(f) for f in fields if f in events.columns]
    return F.lower(F.concat_ws(" ", *present))


def word_parts(token: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[a-z0-9_]+", token.lower()))


def has_word(text: Column, token: str) -> Column:
    """Every word of ``token`` occurs in the lower-case text; a hyphenated token is analysed into its parts.

    The plain substring search decides most rows; only those that contain the letters are searched for boundaries.
    """
    parts = word_parts(token)
    found = F.lit(bool(parts))
    for part in parts:
        found = found & F.contains(text, F.lit(part)) & text.rlike(f"(?<![a-z0-9_]){part}(?![a-z0-9_])")
    return found


# ---- technique layer as a join --------------------------------------------------------------------------


def rule_match_ids(rule_technique: DataFrame) -> DataFrame:
    """(rule_id, match_id): every bound id plus its parent, on the rule side only."""
    both = F.array(F.upper("technique_id"), parent_technique(F.upper("technique_id")))
    return rule_technique.select("rule_id", F.explode(both).alias("match_id")).distinct()


def technique_hits(events: DataFrame, rule_technique: DataFrame, keep: Sequence[str] = ("event_id",)) -> DataFrame:
    """One row per (rule, event) that shares a technique. Events are not shuffled while the rules fit a broadcast."""
    keyed = events.filter(F.col("technique").isNotNull()).select(F.upper("technique").alias("match_id"), *keep)
    return join_dimension(keyed, rule_match_ids(rule_technique), "match_id").select("rule_id", *keep)


def technique_hit_counts(events: DataFrame, rule_technique: DataFrame) -> DataFrame:
    """(rule_id, hits) by technique: events are counted per technique before the rules are joined."""
    per_technique = (
        events.filter(F.col("technique").isNotNull())
        .groupBy(F.upper("technique").alias("match_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_technique.join(rule_match_ids(rule_technique), "match_id").groupBy("rule_id").agg(F.sum("n").alias("hits"))
    )


# ---- all layers in one scan -----------------------------------------------------------------------------


@dataclass(frozen=True)
class CompiledRules:
    """A batch of rules as driver-side predicates; rules are referred to by their number in the batch."""

    rule_ids: tuple[str, ...]
    techniques: Mapping[str, tuple[int, ...]] = field(default_factory=dict)
    tokens: Mapping[str, tuple[int, ...]] = field(default_factory=dict)
    predicates: Mapping[int, str] = field(default_factory=dict)
    errors: Mapping[int, str] = field(default_factory=dict)
    dispatch: str | None = None
    required: Mapping[int, frozenset[str]] = field(default_factory=dict)


def compile_rules(
    rules: DataFrame,
    fields: Fields | None = None,
    case_insensitive: bool = False,
    per_batch: int = RULES_PER_BATCH,
    dispatch: str | None = None,
) -> Iterator[CompiledRules]:
    """Compile rules batch by batch, never holding more than one batch on the driver.

    ``dispatch`` names an event column most rules pin to constants, such as an event type or id. Rules are then
    filed under those constants and an event is tested only against the rules filed under its own value and those
    that pin none. The answer is the same with and without it.

    ``rules`` has ``rule_id``, ``techniques ARRAY<STRING>``, ``keywords ARRAY<STRING>`` and ``detection``, the
    JSON text of a detection block (null where the rule has none).
    """
    rows = rules.select(
        F.col("rule_id").cast("string").alias("rule_id"),
        F.coalesce("techniques", F.array().cast("array<string>")).alias("techniques"),
        keyword_tokens(F.coalesce("keywords", F.array().cast("array<string>"))).alias("tokens"),
        "detection",
    ).toLocalIterator(prefetchPartitions=False)
    readable = pattern_check(rules.sparkSession)
    while batch := list(islice(rows, per_batch)):
        yield _compile(batch, fields, case_insensitive, dispatch, readable)


def pattern_check(spark: SparkSession) -> Callable[[str], None]:
    """A check that the engine can compile a regular expression; raises ``UntranslatableCondition``. Folding the constant
    expression is enough, no job runs."""

    def check(pattern: str) -> None:
        try:
            spark.sql(f"SELECT '' RLIKE {sql_string(pattern)} AS hit").collect()
        except Exception as problem:  # noqa: BLE001 - whatever the engine says, the rule keeps its other layers
            raise UntranslatableCondition(f"cannot read pattern {pattern!r}: {type(problem).__name__}") from None

    return check


def _compile(
    batch: list, fields: Fields | None, case_insensitive: bool, dispatch: str | None, readable: Callable[[str], None]
) -> CompiledRules:
    techniques: dict[str, list[int]] = {}
    tokens: dict[str, list[int]] = {}
    predicates: dict[int, str] = {}
    errors: dict[int, str] = {}
    required: dict[int, frozenset[str]] = {}
    for number, row in enumerate(batch):
        for technique in row.techniques:
            for match_id in {technique.upper(), technique.upper().partition(".")[0]}:
                techniques.setdefault(match_id, []).append(number)
        for token in row.tokens:
            tokens.setdefault(token, []).append(number)
        try:
            block = json.loads(row.detection) if row.detection else {}
            if not isinstance(block, dict):
                raise UntranslatableCondition("the detection is no block of selections")
            if "condition" not in block or str(block["condition"]).strip() == "keywords":
                continue
            sql = rule_predicate(block, fields, case_insensitive)
            for pattern in patterns(block):
                readable(pattern)
            values = required_values(block, dispatch) if dispatch and not case_insensitive else None
        except (ValueError, TypeError, AttributeError) as problem:  # one bad rule keeps its other layers, and its reason
            errors[number] = str(problem) or type(problem).__name__
            continue
        predicates[number] = sql
        if values is not None:
            required[number] = values
    return CompiledRules(
        tuple(row.rule_id for row in batch),
        {k: tuple(sorted(set(v))) for k, v in techniques.items()},
        {k: tuple(sorted(set(v))) for k, v in tokens.items()},
        predicates,
        errors,
        dispatch,
        required,
    )


def _numbers(numbers: Sequence[int]) -> str:
    return ",".join(map(str, numbers))


def _split_numbers(signature: Column) -> Column:
    return F.array_distinct(F.filter(F.split(signature, ","), lambda n: n != ""))


def _token_columns(tokens: Mapping[str, tuple[int, ...]], whole_words: bool) -> list[Column]:
    """Columns over ``_text`` that name the rules whose tokens it contains."""
    text = F.col("_text")
    return [
        F.when(has_word(text, token) if whole_words else F.contains(text, F.lit(token)), F.lit(_numbers(numbers)))
        for token, numbers in tokens.items()
    ]


def _predicate_columns(rules: CompiledRules) -> list[Column]:
    """Columns that name the rules whose conditions hold, filed under the dispatch value where rules pin one."""

    def named(numbers: Sequence[int]) -> list[str]:
        return [f"CASE WHEN {rules.predicates[n]} THEN '{n}' END" for n in numbers]

    filed: dict[str, list[int]] = {}
    for number, values in rules.required.items():
        for value in values:
            filed.setdefault(value, []).append(number)
    columns = [F.expr(sql) for sql in named([n for n in rules.predicates if n not in rules.required])]
    if filed:
        branches = " ".join(
            f"WHEN {sql_string(value)} THEN concat_ws(',', {', '.join(named(numbers))})" for value, numbers in filed.items()
        )
        # concat_ws skips nulls but not empty text, and an event may match none of the rules under its value.
        columns.append(F.expr(f"nullif(CASE `{rules.dispatch}` {branches} END, '')"))
    return columns


def with_signatures(events: DataFrame, rules: CompiledRules, whole_words: bool = False) -> DataFrame:
    """Add ``_field_rules`` (condition layer) and ``_broad_rules`` (technique or keyword layer) to each event."""
    text = haystack(events, INDEXED_TEXT_FIELDS if whole_words else FREE_TEXT_FIELDS)
    by_field = _predicate_columns(rules)
    by_token = _token_columns(rules.tokens, whole_words)
    out = events
    by_technique = []
    if rules.techniques and "technique" in events.columns:
        # At most one row per technique id of this batch, so the size is bounded by RULES_PER_BATCH.
        dimension = inline_table(
            events.sparkSession,
            [(k, _numbers(v)) for k, v in rules.techniques.items()],
            {"_match_id": "STRING", "_by_technique": "STRING"},
        )
        out = out.join(F.broadcast(dimension), F.upper("technique") == F.col("_match_id"), "left").drop("_match_id")
        by_technique = [F.col("_by_technique")]
    if by_token:
        out = out.withColumn("_text", text)
    return (
        out.withColumn("_field_rules", F.concat_ws(",", *by_field) if by_field else F.lit(""))
        .withColumn("_broad_rules", F.concat_ws(",", *by_technique, *by_token) if by_technique + by_token else F.lit(""))
        .drop("_text", "_by_technique")
    )


def _rule_id(rules: CompiledRules, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in rules.rule_ids]), number.cast("int") + 1)


def layer_counts(events: DataFrame, batches: Iterator[CompiledRules], whole_words: bool = False) -> DataFrame:
    """(rule_id, field_hits, broad_hits) of every compiled rule, one event scan per batch of rules."""
    parts = []
    for rules in batches:
        grouped = (
            with_signatures(events, rules, whole_words)
            .groupBy("_field_rules", "_broad_rules")
            .agg(F.count(F.lit(1)).alias("n"))
        )

        def tagged(column: str, is_field: bool) -> Column:
            return F.transform(
                _split_numbers(F.col(column)), lambda n: F.struct(n.alias("number"), F.lit(is_field).alias("is_field"))
            )

        parts.append(
            grouped.select(
                F.explode(F.concat(tagged("_field_rules", True), tagged("_broad_rules", False))).alias("hit"), "n"
            )
            .groupBy(F.col("hit.number").alias("number"))
            .agg(
                F.sum(F.when(F.col("hit.is_field"), F.col("n")).otherwise(0)).alias("field_hits"),
                F.sum(F.when(~F.col("hit.is_field"), F.col("n")).otherwise(0)).alias("broad_hits"),
            )
            .select(_rule_id(rules, F.col("number")).alias("rule_id"), "field_hits", "broad_hits")
        )
    return _union(parts, events, "rule_id STRING, field_hits BIGINT, broad_hits BIGINT")


def hit_rows(
    events: DataFrame,
    batches: Iterator[CompiledRules],
    keep: Sequence[str],
    whole_words: bool = False,
) -> DataFrame:
    """(rule_id, layer, kept columns): one row per rule, layer and event. A map-only job per batch of rules."""
    parts = []
    for rules in batches:
        signed = with_signatures(events, rules, whole_words)
        for layer, column in (("field", "_field_rules"), ("broad", "_broad_rules")):
            parts.append(
                signed.filter(F.col(column) != "")
                .select(F.explode(_split_numbers(F.col(column))).alias("number"), *keep)
                .select(_rule_id(rules, F.col("number")).alias("rule_id"), F.lit(layer).alias("layer"), *keep)
            )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.select(*keep).schema)
    return _union(parts, events, "rule_id STRING, layer STRING, " + schema)


def _union(parts: list[DataFrame], events: DataFrame, schema: str) -> DataFrame:
    if not parts:
        return events.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---- results --------------------------------------------------------------------------------------------


def rule_status(rules: DataFrame, counts: DataFrame, matchable: Column) -> DataFrame:
    """Rules LEFT JOIN hit counts: ``skip`` when there is nothing to match by, else ``pass`` or ``fail``."""
    hits = F.coalesce(F.col("hits"), F.lit(0).cast("bigint"))
    return rules.join(counts, "rule_id", "left").withColumn("hits", hits).withColumn(
        "status", F.when(~matchable, "skip").when(F.col("hits") > 0, "pass").otherwise("fail")
    )


def layered_hits(counts: DataFrame) -> DataFrame:
    """The condition layer where it fired, else the technique-or-keyword layer."""
    fired = F.coalesce(F.col("field_hits"), F.lit(0)) > 0
    return counts.withColumn("layer", F.when(fired, "field").otherwise("broad")).withColumn(
        "hits", F.when(fired, F.col("field_hits")).otherwise(F.coalesce(F.col("broad_hits"), F.lit(0)))
    )


def latest_samples(
    hits: DataFrame, by: Sequence[str] = ("rule_id",), time: str = "timestamp", tie: str = "event_id",
    k: int = SAMPLES_PER_RULE, first: bool = False,
) -> DataFrame:
    """The ``k`` latest (or first) events per rule. Each task forwards at most ``k`` rows per rule."""
    order = [F.col(time).asc_nulls_last(), F.col(tie).asc()] if first else [F.col(time).desc(), F.col(tie).desc()]
    window = W.partitionBy(*by).orderBy(*order)
    return hits.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= k)


def first_samples(
    hits: DataFrame, by: Sequence[str] = ("rule_id",), position: str = "position", k: int = SAMPLES_PER_RULE
) -> DataFrame:
    """The ``k`` first events per rule in file order (see ``sources.telemetry.with_position``)."""
    window = W.partitionBy(*by).orderBy(position)
    return hits.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= k)


def query_description(
    techniques: Column, n_keywords: Column, start: str | None = None, n_events: Column | None = None,
    prefix: str = "",
) -> Column:
    """Human-readable summary of what a rule was matched by."""
    window = f"  since={start[:16]}" if start else "  (all time)"
    parts = [
        F.lit(prefix), F.lit("techniques=["), F.array_join(techniques, ", "), F.lit("]"),
        F.when(n_keywords > 0, F.concat(F.lit("  keywords="), n_keywords.cast("string"))).otherwise(""),
        F.lit(window),
    ]
    if n_events is not None:
        parts += [F.lit("  events="), n_events.cast("string")]
    return F.concat(*parts)


def search_terms(techniques: Column, leading: Column) -> Column:
    """Free-text search terms: technique ids, then the first tokens of each keyword."""
    return F.array_distinct(F.concat(techniques, leading))


def labelled_scores(hits: DataFrame, positives: DataFrame, rules: DataFrame, label: str = "label") -> DataFrame:
    """Per rule over labelled events: matched, true and false positives, and the positives it missed.

    ``positives`` holds one number, the count of labelled events; it is read as a scalar subquery.
    """
    per_rule = hits.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("matched"), F.count_if(F.col(label)).alias("tp"), F.count_if(~F.col(label)).alias("fp")
    )
    zero = F.lit(0).cast("bigint")
    return (
        rules.join(per_rule, "rule_id", "left").select(
            "rule_id",
            *[F.coalesce(c, zero).alias(c) for c in ("matched", "tp", "fp")],
            (positives.scalar() - F.coalesce("tp", zero)).alias("fn"),
        )
    )


def with_rates(scores: DataFrame) -> DataFrame:
    """False-negative rate over labelled positives, and the share of hits that were wrong."""
    positives = F.col("tp") + F.col("fn")
    return scores.withColumns(
        {
            "false_negative_rate": F.try_divide("fn", positives),
            "false_positive_rate": F.try_divide("fp", "matched"),
        }
    )

"""Evaluate a rule corpus against telemetry tables and report one result per rule and backend."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfloor.functions.text import keyword_tokens, leading_tokens
from watchfloor.operators import matching
from watchfloor.operators.layers import Broad, Conditions, free_text_hits
from watchfloor.operators.predicates import Fields
from watchfloor.session import ready, rewritten

# What a result says when there is nothing to look for, per kind of backend.
NOTHING = {
    "local": ("(no techniques or keywords found)", matching.NO_PREDICATES),
    "indexed": ("(no techniques, keywords, or translatable detection block)", matching.NO_PREDICATES),
    "search": ("(no terms to search)", "No technique IDs or keywords to search"),
}


@dataclass(frozen=True)
class Backend:
    """A telemetry table and how it is searched.

    ``local`` matches techniques and keyword substrings; ``indexed`` tries the rule's own conditions first and then
    techniques and whole words; ``search`` looks for terms in the raw text. ``dispatch`` is explained at
    ``matching.compile_rules``. Without ``fields`` a rule's field names are the table's columns, then keys of its ``attrs``
    map. ``samples`` is the number of events kept per rule; the two last settings shape the text of a search.
    """

    events: DataFrame
    kind: str = "local"
    time: str = "timestamp"
    raw: str = "raw"
    fields: Fields | None = None
    case_insensitive: bool = False
    dispatch: str | None = None
    samples: int = matching.SAMPLES_PER_RULE
    terms_per_keyword: int = 2
    search_text_length: int | None = None


def match_corpus(rules: DataFrame, backend: Backend, name: str = "local", start: str | None = None,
                 samples: bool = False) -> DataFrame:
    """Rule results for one backend: rule_id, name, techniques, siem, query, hits, status, error (, samples).

    ``rules`` is ``sources.rules.matchable`` output. The look-back start is a literal, so a rerun gives the same
    answer. Unreadable event times are kept by ``local`` and dropped by the other two.
    """
    ready(rules.sparkSession)
    empty = F.array().cast("array<string>")
    rules = rules.withColumns({c: F.coalesce(c, empty) for c in ("techniques", "keywords")})
    null_ts = "keep" if backend.kind == "local" else "drop"
    events = matching.since(backend.events, start, backend.time, null_ts)
    if backend.kind == "search":
        return _search(rules, events, backend, name)
    whole_words = backend.kind == "indexed"
    usable = rules if whole_words else rules.withColumn("detection", F.lit(None).cast("string"))
    conditions = Conditions(usable, backend.fields or Fields.of(events.schema), backend.case_insensitive)
    broad = Broad.of(rules, whole_words)
    counts = conditions.counts(events).join(broad.counts(events), "rule_id", "full_outer")
    counts = counts.join(conditions.errors.withColumnRenamed("error", "condition_error"), "rule_id", "full_outer")
    same = F.col("rule_id").cast("string") == F.col("_rule")
    chosen = matching.layered_hits(rules.join(counts.withColumnRenamed("rule_id", "_rule"), same, "left").drop("_rule"))
    n_terms = F.size("techniques") + F.size(keyword_tokens(F.col("keywords")) if whole_words else F.col("keywords"))
    prefix = F.when(F.col("layer") == "field", "sigma-fields  ").otherwise("")
    query = F.concat(prefix, matching.query_description(F.col("techniques"), F.size("keywords"), start))
    results = _results(chosen, n_terms == 0, name, query, F.col("condition_error"), backend.kind)
    return _with_samples(results, events, conditions, broad, chosen, backend) if samples else results


def _results(rules: DataFrame, nothing: Column, siem: str, query: Column, error: Column, kind: str) -> DataFrame:
    is_skip = nothing & (F.col("hits") == 0)
    no_query, no_reason = NOTHING[kind]
    return rules.select(
        "rule_id", "name", "techniques", F.lit(siem).alias("siem"),
        F.when(is_skip, F.lit(no_query)).otherwise(query).alias("query"),
        "hits",
        F.when(is_skip, "skip").when(F.col("hits") > 0, "pass").otherwise("fail").alias("status"),
        F.when(is_skip, F.lit(no_reason)).otherwise(error).alias("error"),
    )


def _with_samples(results: DataFrame, events: DataFrame, conditions: Conditions, broad: Broad, chosen: DataFrame,
                  backend: Backend) -> DataFrame:
    """Add up to three events per rule, from the layer that decided: first ones locally, latest ones otherwise."""
    plain = [c for c in events.columns if c != "attrs"]
    kept = events.columns
    tied = events.withColumn("_tie", F.xxhash64(*plain))
    hits = conditions.hits(tied, [*kept, "_tie"]).withColumn("layer", F.lit("field")).unionByName(
        broad.hits(tied, [*kept, "_tie"]).withColumn("layer", F.lit("broad"))
    )
    top = matching.latest_samples(
        hits, ("rule_id", "layer"), backend.time, "_tie", backend.samples, first=backend.kind == "local"
    )
    pairs = [p for c in plain for p in (F.lit(c), F.col(c).cast("string"))]
    event = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    if "attrs" in kept:  # a promoted column wins over a key of the same name
        more = F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*plain))
        event = F.map_concat(event, more)
    packed = top.groupBy("rule_id", "layer").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", F.map_entries(event).alias("e")))),
                    lambda s: F.map_from_entries(s["e"])).alias("samples")
    )
    decided = chosen.select("rule_id", "layer", F.col("rule_id").cast("string").alias("_rule"))
    decided = decided.join(packed.withColumnRenamed("rule_id", "_rule"), ["_rule", "layer"]).drop("layer", "_rule")
    return results.join(decided, "rule_id", "left")


def _search(rules: DataFrame, events: DataFrame, backend: Backend, name: str) -> DataFrame:
    words = leading_tokens(F.col("keywords"), backend.terms_per_keyword)
    wanted = rules.withColumn("terms", matching.search_terms(F.col("techniques"), words))
    counts = free_text_hits(
        events, wanted.select("rule_id", F.explode("terms").alias("term")), F.col(backend.raw)
    )
    joined = wanted.join(counts, "rule_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("bigint")))
    joined_terms = F.array_join("terms", " OR ")
    if backend.search_text_length is not None:
        joined_terms = F.left(joined_terms, F.lit(backend.search_text_length))
    query = F.concat(F.lit("search: "), joined_terms)
    return _results(joined, F.size("terms") == 0, name, query, F.lit(None).cast("string"), "search")


def failed_backend(rules: DataFrame, name: str, reason: str) -> DataFrame:
    """One ``error`` row per rule for a backend that could not be read."""
    empty = F.array().cast("array<string>")
    return rules.select(
        "rule_id", "name", F.coalesce("techniques", empty).alias("techniques"), F.lit(name).alias("siem"),
        F.lit("").alias("query"), F.lit(0).cast("bigint").alias("hits"), F.lit("error").alias("status"),
        F.lit(reason).alias("error"),
    )


def validate_corpus(
    rules: DataFrame, backends: Mapping[str, Backend | Callable[[], Backend]], start: str | None = None
) -> DataFrame:
    """Results of every backend, stacked: one row per rule and backend.

    A backend may be given as a function that opens it. Each is evaluated and its results written by itself, so where opening,
    compiling or running fails (a missing path or column, a file that cannot be read), its rules get status ``error`` with the
    reason, and the other backends answer as usual.
    """
    out = None
    for name, backend in backends.items():
        try:
            part = rewritten(match_corpus(rules, backend() if callable(backend) else backend, name, start), "backend-results")
        except Exception as problem:  # noqa: BLE001 - any failure of one backend is its own result
            part = failed_backend(rules, name, f"{type(problem).__name__}: {str(problem).splitlines()[0] if str(problem) else ''}")
        out = part if out is None else out.unionByName(part)
    return out


def updated_records(records: DataFrame, results: DataFrame, at: str) -> DataFrame:
    """Records with validation status and time set from the results; skipped rules stay as they were."""
    status = results.filter(F.col("status").isin("pass", "fail")).groupBy(F.col("rule_id").alias("id")).agg(
        F.max(F.col("status") == "pass").alias("_passed")
    )
    tested = F.col("_passed").isNotNull()
    return records.join(status, "id", "left").withColumns(
        {
            "validation_status": F.when(tested, F.when(F.col("_passed"), "passed").otherwise("failed")).otherwise(
                F.col("validation_status")
            ),
            "last_validated": F.when(tested, F.lit(at).cast("timestamp")).otherwise(F.col("last_validated")),
        }
    ).drop("_passed")

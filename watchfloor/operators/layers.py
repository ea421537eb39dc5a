"""What a corpus of rules finds in telemetry, layer by layer, as tables.

The condition layer counts by the index of ``rule_index``, whatever the number of rules, and adds a scan per batch of rules
that stay generated predicates. The broad layer joins techniques and keywords; an event counts once for a rule however many
of its techniques and keywords it has. Rules are never listed on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfloor.functions.text import keyword_tokens
from watchfloor.operators import keywords, rule_index
from watchfloor.operators.matching import (
    FREE_TEXT_FIELDS, INDEXED_TEXT_FIELDS, RULES_PER_BATCH, has_word, haystack, rule_match_ids, technique_hit_counts, technique_hits,
)
from watchfloor.operators.predicates import Fields
from watchfloor.session import cut_lineage, join_dimension

# Up to so many distinct keywords are tested for beside the event; the answer of the joins is the same.
GENERATED_KEYWORDS = 64


# ---- conditions -----------------------------------------------------------------------------------------


class Conditions:
    """The detection blocks of ``rules`` (rule_id, detection), translated once."""

    def __init__(self, rules: DataFrame, fields: Fields, case_insensitive: bool = False, per_batch: int = RULES_PER_BATCH):
        self.fields, self.fold, self.per_batch = fields, case_insensitive, per_batch
        found = rule_index.compiled(rules, fields, case_insensitive)
        bad = rule_index.bad_patterns(rules.sparkSession, found)
        errors = found.filter("error IS NOT NULL").select("rule_id", "error").union(bad)
        self.errors = cut_lineage(errors.groupBy("rule_id").agg(F.min("error").alias("error")))
        self.found = found.join(self.errors.select("rule_id"), "rule_id", "left_anti")
        self.index = rule_index.Index(self.found, fields, case_insensitive)

    def _generated(self, events: DataFrame, keep: Sequence[Column | str], counted: bool):
        for batch in rule_index.generated(self.found, self.per_batch):
            ids = F.array(*[F.lit(row.rule_id) for row in batch])
            signed = events.select(rule_index.named(batch).alias("_rules"), *keep).filter("_rules <> ''")
            if counted:
                signed = signed.groupBy("_rules").agg(F.count(F.lit(1)).alias("n"))
            numbers = signed.withColumn("_number", F.explode(F.split("_rules", ",")))
            yield numbers.select(F.element_at(ids, F.col("_number").cast("int") + 1).alias("rule_id"), *(["n"] if counted else keep))

    def counts(self, events: DataFrame) -> DataFrame:
        """(rule_id, field_hits)"""
        parts = [p.groupBy("rule_id").agg(F.sum("n").alias("field_hits")) for p in self._generated(events, [], True)]
        return reduce(DataFrame.union, parts, self.index.counts(events))

    def hits(self, events: DataFrame, keep: Sequence[str]) -> DataFrame:
        """(rule_id, kept columns)"""
        return reduce(DataFrame.union, self._generated(events, list(keep), False), self.index.hits(events, keep))


# ---- techniques and keywords ----------------------------------------------------------------------------


def rule_keywords(rules: DataFrame) -> DataFrame:
    """(rule_id, keyword) of the tokens of the rules' keywords."""
    return rules.select("rule_id", F.explode(keyword_tokens(F.col("keywords"))).alias("keyword"))


class Broad:
    """Techniques and keywords of rules: ``rule_technique`` (rule_id, technique_id), ``rule_keyword`` (rule_id, keyword)."""

    def __init__(self, rule_technique: DataFrame, rule_keyword: DataFrame, whole_words: bool = False, generated: int = GENERATED_KEYWORDS):
        self.rule_technique = rule_technique.select(F.col("rule_id").cast("string").alias("rule_id"), "technique_id")
        self.rule_keyword = rule_keyword.select(F.col("rule_id").cast("string").alias("rule_id"), "keyword")
        self.whole_words = whole_words
        some = self.rule_keyword.select("keyword").distinct().limit(generated + 1).collect()
        self.few = [r.keyword for r in some] if len(some) <= generated else None

    @classmethod
    def of(cls, rules: DataFrame, whole_words: bool = False, generated: int = GENERATED_KEYWORDS) -> Broad:
        return cls(rules.select("rule_id", F.explode("techniques").alias("technique_id")), rule_keywords(rules), whole_words, generated)

    def _signed(self, events: DataFrame, text: Column) -> DataFrame:
        """Events with ``_keys``: their technique and the few keywords in their text."""
        def has(word: str) -> Column:
            return has_word(F.col("_text"), word) if self.whole_words else F.contains("_text", F.lit(word))

        words = [F.when(has(w), F.lit("w" + w)) for w in self.few]
        technique = F.concat(F.lit("t"), F.upper("technique")) if "technique" in events.columns else F.lit(None).cast("string")
        keys = F.filter(F.array(technique, *words), lambda k: k.isNotNull())
        return events.withColumn("_text", text).withColumn("_keys", keys).drop("_text").filter(F.size("_keys") > 0)

    def _rules_of(self, signatures: DataFrame) -> DataFrame:
        """(_keys, rule_id) for each distinct signature."""
        by_key = rule_match_ids(self.rule_technique).select("rule_id", F.concat(F.lit("t"), "match_id").alias("key"))
        by_key = by_key.union(self.rule_keyword.select("rule_id", F.concat(F.lit("w"), "keyword")))
        each = signatures.select("_keys", F.explode("_keys").alias("key"))
        return join_dimension(each, by_key.distinct(), "key").select("_keys", "rule_id").distinct()

    def _text(self, events: DataFrame) -> Column:
        return haystack(events, INDEXED_TEXT_FIELDS if self.whole_words else FREE_TEXT_FIELDS)

    def _by_words(self, events: DataFrame, text: Column, keep: Sequence[str]) -> DataFrame:
        """(rule_id, kept columns) of hits by keywords whose event has no technique of the rule."""
        technique = F.upper("technique") if "technique" in events.columns else F.lit(None).cast("string")
        rows = events.withColumns({"_searched": text, "_technique": technique})
        found = keywords.rule_hits(rows, self.rule_keyword, ["_technique", *keep], "_searched", self.whole_words)
        ids = rule_match_ids(self.rule_technique).withColumnRenamed("rule_id", "_rule")
        bound = (F.col("rule_id") == F.col("_rule")) & (F.col("_technique") == F.col("match_id"))
        return found.join(ids, bound, "left_anti").select("rule_id", *keep)

    def counts(self, events: DataFrame, text: Column | None = None) -> DataFrame:
        """(rule_id, broad_hits)"""
        text = self._text(events) if text is None else text
        if self.few is not None:
            signatures = cut_lineage(self._signed(events, text).groupBy("_keys").agg(F.count(F.lit(1)).alias("n")))
            return self._rules_of(signatures).join(signatures, "_keys").groupBy("rule_id").agg(F.sum("n").alias("broad_hits"))
        found = self._by_words(events, text, []).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
        if "technique" in events.columns:
            found = found.union(technique_hit_counts(events, self.rule_technique))
        return found.groupBy("rule_id").agg(F.sum("hits").alias("broad_hits"))

    def hits(self, events: DataFrame, keep: Sequence[str]) -> DataFrame:
        """(rule_id, kept columns): one row per rule and event."""
        if self.few is not None:
            signed = self._signed(events, self._text(events)).select("_keys", *keep)
            signatures = cut_lineage(signed.select("_keys").distinct())
            return join_dimension(signed, self._rules_of(signatures), "_keys").select("rule_id", *keep)
        found = self._by_words(events, self._text(events), keep)
        return found.union(technique_hits(events, self.rule_technique, keep)) if "technique" in events.columns else found


def free_text_hits(events: DataFrame, rule_terms: DataFrame, raw: Column) -> DataFrame:
    """(rule_id, hits) of a raw-text search: an event counts once per rule if it contains any of its terms.

    ``rule_terms`` is (rule_id, term).
    """
    kind = rule_terms.schema["rule_id"].dataType
    terms = rule_terms.select("rule_id", F.lower("term").alias("keyword"))
    search = Broad(terms.select("rule_id", F.col("keyword").alias("technique_id")).limit(0), terms)
    counts = search.counts(events.select(raw.alias("raw")), F.lower("raw"))
    return counts.select(F.col("rule_id").cast(kind).alias("rule_id"), F.col("broad_hits").alias("hits"))

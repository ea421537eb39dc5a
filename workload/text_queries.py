"""Keyword operators over whole document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchfloor.functions.text import tokens_of_text
from watchfloor.operators import matching
from watchfloor.operators.mapping import KeywordHint, SourceHint, infer
from watchfloor.operators.shapes import signature_matches
from watchfloor.session import inline_table
from workload.registry import query
from workload.views import KEYWORDS

HINTS = [KeywordHint(keyword, (technique,), pct / 100) for _, keyword, technique, pct in KEYWORDS]
SOURCES = [SourceHint(("en", "de"), ("token", "license"), ("T1552.001",), 0.60)]


@query(
    "keyword_tokens",
    """SELECT token, count(*) AS n_docs FROM (
         SELECT DISTINCT doc_id, unnest(string_split_regex(haystack, '[^a-zA-Z0-9_-]')) AS token FROM doc) t
       WHERE length(token) >= 4 GROUP BY token""",
)
def keyword_tokens(v):
    tokens = v.doc.select(F.explode(tokens_of_text(F.col("haystack"))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"))


def _per_keyword(docs, condition):
    """Documents per keyword: one flag per keyword and document, summed map-side in a single aggregate."""
    counts = docs.agg(*[F.count_if(condition(k)).alias(str(pos)) for pos, k, _, _ in KEYWORDS])
    rows = F.array(*[F.struct(F.lit(pos).alias("pos"), F.col(str(pos)).alias("n_docs")) for pos, _, _, _ in KEYWORDS])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


@query(
    "keyword_match_docs",
    """SELECT k.pos, count(CASE WHEN contains(d.haystack, k.keyword) THEN 1 END) AS n_docs
       FROM keyword k CROSS JOIN doc d GROUP BY k.pos""",
)
def keyword_match_docs(v):
    return _per_keyword(v.doc, lambda k: F.contains("haystack", F.lit(k)))


@query(
    "keyword_word_match",
    """SELECT k.pos, count(CASE WHEN list_contains(d.words, k.keyword) THEN 1 END) AS n_docs
       FROM keyword k CROSS JOIN (SELECT string_split_regex(haystack, '[^a-z0-9_]+') AS words FROM doc) d GROUP BY k.pos""",
)
def keyword_word_match(v):
    return _per_keyword(v.doc, lambda k: matching.has_word(F.col("haystack"), k))


@query(
    "infer_keyword",
    """SELECT d.doc_id, k.technique_id, max(k.conf_pct) AS conf_pct FROM doc d JOIN keyword k
       ON contains(d.haystack, k.keyword) GROUP BY 1, 2""",
)
def infer_keyword(v):
    found = infer(v.doc, ["doc_id"], F.col("haystack"), HINTS, scale=100, kind="int")
    return found.select("doc_id", "technique_id", F.col("confidence").alias("conf_pct"))


@query(
    "infer_datasource",
    """SELECT doc_id, 'T1552.001' AS technique_id FROM doc
       WHERE lang IN ('en', 'de') AND (contains(haystack, 'token') OR contains(haystack, 'license'))""",
)
def infer_datasource(v):
    found = infer(v.doc, ["doc_id"], F.col("haystack"), source_hints=SOURCES, log_sources=F.array("lang"))
    return found.select("doc_id", "technique_id")


@query(
    "signature_match_docs",
    """SELECT doc_id FROM doc WHERE (contains(haystack, 'token') OR contains(haystack, 'license'))
       AND NOT contains(haystack, 'that')""",
)
def signature_match_docs(v):
    strings = {"$tok": "token", "$lic": "license", "$common": "that"}
    return signature_matches(v.doc, "haystack", strings, "($tok or $lic) and not $common").select("doc_id")


@query(
    "rule_keyword_hits",
    """SELECT CAST(pos AS VARCHAR(20)) AS rule_id, count(*) AS hits FROM keyword k JOIN doc d
       ON contains(d.haystack, k.keyword) GROUP BY 1""",
)
def rule_keyword_hits(v):
    """The keyword layer of the matcher: documents as messages, one rule per keyword."""
    rules = inline_table(
        v.spark, [(str(pos), None, [keyword], None) for pos, keyword, _, _ in KEYWORDS],
        {"rule_id": "STRING", "techniques": "ARRAY<STRING>", "keywords": "ARRAY<STRING>", "detection": "STRING"},
    )
    events = v.doc.select(F.col("haystack").alias("message"))
    counts = matching.layer_counts(events, matching.compile_rules(rules))
    return counts.select("rule_id", F.col("broad_hits").alias("hits"))

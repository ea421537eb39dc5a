"""Thousands of rules and keywords at once, made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchfloor.functions.text import tokens_of_text
from watchfloor.operators import keywords, layers
from watchfloor.operators.predicates import Fields
from workload.registry import query

TELEMETRY_FIELDS = Fields(["key", "uid", "props", "value"], attrs=None, other=["value"])
EVENT_KEYS = ("click", "error", "purchase", "signup", "view")


def first_turn_tokens(v):
    """A rule per conversation: the tokens of its first turn."""
    first = v.table("conversations").filter("turn = 0")
    return first.select(F.col("conv_id").cast("string").alias("rule_id"), F.explode(tokens_of_text(F.col("text"))).alias("keyword"))


FIRST_TURN_TOKENS = """
    SELECT DISTINCT CAST(conv_id AS VARCHAR) AS rule_id, lower(token) AS keyword
    FROM (SELECT conv_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9_-]{4,}')) AS token FROM conversations WHERE turn = 0) t"""


@query(
    "many_keyword_hits",
    f"""SELECT rule_id, count(DISTINCT doc_id) AS hits
        FROM ({FIRST_TURN_TOKENS}) r
        JOIN (SELECT keyword AS found, doc_id FROM (SELECT DISTINCT keyword FROM ({FIRST_TURN_TOKENS}) r) k
              JOIN doc ON contains(haystack, keyword)) h ON h.found = r.keyword
        GROUP BY rule_id""",
)
def many_keyword_hits(v):
    return keywords.rule_counts(v.doc, first_turn_tokens(v), "haystack")


@query(
    "many_keyword_words",
    f"""WITH doc_word AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(haystack, '[a-z0-9_]+')) AS word
                          FROM (SELECT doc_id, lower(text) AS haystack FROM documents) d),
         part AS (SELECT DISTINCT keyword, unnest(regexp_extract_all(keyword, '[a-z0-9_]+')) AS word
                  FROM ({FIRST_TURN_TOKENS}) r),
         wanted AS (SELECT keyword, count(*) AS n FROM part GROUP BY keyword),
         found AS (SELECT p.keyword, d.doc_id, count(*) AS n FROM part p JOIN doc_word d ON p.word = d.word GROUP BY ALL)
        SELECT r.rule_id, count(DISTINCT f.doc_id) AS hits FROM found f JOIN wanted w ON f.keyword = w.keyword AND f.n = w.n
        JOIN ({FIRST_TURN_TOKENS}) r ON r.keyword = f.keyword GROUP BY r.rule_id""",
)
def many_keyword_words(v):
    return keywords.rule_counts(v.doc, first_turn_tokens(v), "haystack", whole_words=True)


def customer_rules(v):
    """A rule per customer: a user and a kind of event, with an ending of the properties for some. A few negate."""
    key = F.element_at(F.array(*map(F.lit, EVENT_KEYS)), (F.col("c_custkey") % 5 + 1).cast("int"))
    condition = F.expr(
        "CASE WHEN c_custkey % 300 = 3 THEN 's and not f' WHEN c_custkey % 3 = 0 THEN 's' WHEN c_custkey % 3 = 1 THEN 's and f' ELSE 's or f' END"
    )
    block = F.format_string(
        '{"s": {"uid": "%d", "key": ["%s", "view"]}, "f": {"props|endswith": "%d%d}", "key": "error"}, "condition": "%s"}',
        F.col("c_custkey") % 170, key, F.col("c_custkey") % 9, F.col("c_custkey") % 7, condition,
    )
    return v.table("customer").select(F.col("c_custkey").cast("string").alias("rule_id"), block.alias("detection"))


@query(
    "many_rules_match",
    """WITH r AS (
         SELECT c_custkey AS c, CAST(c_custkey % 170 AS VARCHAR) AS uid,
                ['click', 'error', 'purchase', 'signup', 'view'][c_custkey % 5 + 1] AS k,
                CAST(c_custkey % 9 AS VARCHAR) || CAST(c_custkey % 7 AS VARCHAR) || '}' AS ending FROM customer),
       e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS uid, event_type AS k, props FROM events),
       hit AS (
         SELECT r.c, e.event_id FROM r JOIN e ON e.uid = r.uid AND (e.k = r.k OR e.k = 'view')
         WHERE CASE WHEN r.c % 300 = 3 THEN NOT (ends_with(e.props, r.ending) AND e.k = 'error')
                    WHEN r.c % 3 = 1 THEN ends_with(e.props, r.ending) AND e.k = 'error' ELSE true END
         UNION
         SELECT r.c, e.event_id FROM r JOIN e ON ends_with(e.props, r.ending) AND e.k = 'error'
         WHERE r.c % 300 <> 3 AND r.c % 3 = 2)
       SELECT CAST(c AS VARCHAR) AS rule_id, count(*) AS hits FROM hit GROUP BY c""",
)
def many_rules_match(v):
    conditions = layers.Conditions(customer_rules(v), TELEMETRY_FIELDS)
    return conditions.counts(v.telemetry).withColumnRenamed("field_hits", "hits")

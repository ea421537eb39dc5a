"""Thousands of keywords at once, as joins.

Substrings: a keyword without blanks that occurs in a text occurs in one of its words (what stands between blanks), so
keywords meet the vocabulary, the distinct words of all texts, and not the texts. Every keyword is filed under the rarest of
its runs of ``GRAM`` characters in the vocabulary; words meet it there by equality, and ``contains`` tests what met. A keyword
with a run that no word has goes at once. What is left, words with the keywords in them, meets the words of each text.

Whole words: a keyword is the set of its word parts. Parts meet the distinct words of a text by equality, and a keyword is
found when as many of its parts as it has were met.

No keyword is ever part of the query text or on the driver, and nothing but ``rule_counts`` runs in Python. What is shuffled is each
text's distinct words at most; words with keywords in them are broadcast while they are few (see ``join_dimension``), and then only
hits are shuffled. ``rule_counts`` shuffles neither words of texts nor hits: its tasks read the keywords past chunks of texts. Keywords are compared as they are; lower-case both sides for a search without case. Null texts hit
nothing, null, empty and blank keywords are never found, repeated keywords count once. Rows of ``texts`` that are equal are rows of
their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfloor.operators import united, word_sets
from watchfloor.session import cut_lineage, join_dimension, rewritten

GRAM = 4
BLANKS = r"\s+"
WORD = "[a-z0-9_]+"


def words(text: Column) -> Column:
    """Distinct parts of a text between blanks."""
    return F.array_distinct(F.filter(F.split(text, BLANKS), lambda w: w != ""))


def grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters: a look-ahead finds all that overlap in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def keyword_words(vocabulary: DataFrame, keywords: DataFrame) -> DataFrame:
    """(word, keyword): which of the distinct ``word`` s contain which of the distinct ``keyword`` s."""
    size = F.least(F.char_length("keyword"), F.lit(GRAM))
    found = None
    for (length,) in keywords.select(size.alias("size")).distinct().orderBy("size").collect():  # GRAM rows at most
        filed = keywords.filter(size == length).select("keyword", F.explode(grams(F.col("keyword"), length)).alias("gram"))
        runs = vocabulary.select("word", F.explode(grams(F.col("word"), length)).alias("gram"))
        common = runs.join(filed.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        rated = filed.join(common, "gram", "left").groupBy("keyword").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
        rarest = rated.filter("rarest.n > 0").select("keyword", "rarest.gram")
        part = runs.join(rarest, "gram").filter(F.contains("word", F.col("keyword"))).select("word", "keyword")
        found = part if found is None else found.union(part)
    return found if found is not None else vocabulary.select("word", F.col("word").alias("keyword")).limit(0)


def _sought(keywords: DataFrame) -> DataFrame:
    """(keyword, part, spaced): the longest part between blanks of each keyword."""
    part = F.get(F.array_sort(words(F.col("keyword")), lambda a, b: F.char_length(b) - F.char_length(a)), 0)
    return keywords.select("keyword", part.alias("part"), F.col("keyword").rlike(r"\s").alias("spaced")).filter("part IS NOT NULL")


def _substring_hits(rows: DataFrame, keywords: DataFrame, keep: list[str]) -> DataFrame:
    """Keywords with blanks are looked for by their longest part, and then as a whole in the texts that have it."""
    parts = _sought(keywords)
    each = rows.select(*keep, F.explode(words(F.col("_text"))).alias("word"))
    vocabulary = cut_lineage(each.select("word").distinct())
    found = keyword_words(vocabulary, parts.select(F.col("part").alias("keyword")).distinct()).withColumnRenamed("keyword", "part")
    known = cut_lineage(found.join(parts, "part").select("word", "keyword", "spaced"))
    hits = join_dimension(each, known.filter("NOT spaced").select("word", "keyword"), "word").select("keyword", *keep)
    spaced = known.filter("spaced").select("word", "keyword")
    if not spaced.isEmpty():
        whole = rows.select(*keep, "_text", F.explode(words(F.col("_text"))).alias("word"))
        whole = join_dimension(whole, spaced, "word").filter(F.contains("_text", F.col("keyword")))
        hits = hits.union(whole.select("keyword", *keep))
    return hits.dropDuplicates(["_row", "keyword"])


def _parts(text: Column) -> Column:
    """Distinct word parts."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def _wanted(keywords: DataFrame) -> DataFrame:
    """(keyword, word, wanted): the word parts of a keyword, and how many there are."""
    parts = _parts(F.lower("keyword"))
    return keywords.select("keyword", F.explode(parts).alias("word"), F.size(parts).alias("wanted"))


def _word_hits(rows: DataFrame, keywords: DataFrame, keep: list[str]) -> DataFrame:
    each = rows.select(*keep, F.explode(_parts(F.col("_text"))).alias("word"))
    met = join_dimension(each, _wanted(keywords), "word")
    found = met.groupBy("_row", "keyword").agg(F.count(F.lit(1)).alias("met"), F.first("wanted").alias("wanted"), *[F.first(c).alias(c) for c in keep if c != "_row"])
    return found.filter("met = wanted").select("keyword", *keep)


def keyword_hits(texts: DataFrame, keywords: DataFrame, keep: Sequence[str], text: str = "text", whole_words: bool = False) -> DataFrame:
    """(keyword, kept columns): one row for each row of ``texts`` and ``keyword`` of ``keywords`` found in it."""
    rows = texts.select(F.monotonically_increasing_id().alias("_row"), *keep, F.col(text).alias("_text"))
    distinct = keywords.select("keyword").filter("keyword <> ''").distinct()
    found = (_word_hits if whole_words else _substring_hits)(rows, distinct, ["_row", *keep])
    return found.select("keyword", *keep)


def rule_hits(
    texts: DataFrame, rule_keyword: DataFrame, keep: Sequence[str], text: str = "text", whole_words: bool = False
) -> DataFrame:
    """(rule_id, kept columns): one row for each text and rule of which it has a keyword, however many.

    ``rule_keyword`` is (rule_id, keyword).
    """
    rows = texts.select(F.monotonically_increasing_id().alias("_row"), *keep, F.col(text).alias("_text"))
    filed = rule_keyword.filter("keyword <> ''").distinct()
    found = (_word_hits if whole_words else _substring_hits)(rows, filed.select("keyword").distinct(), ["_row", *keep])
    return join_dimension(found, filed, "keyword").dropDuplicates(["_row", "rule_id"]).select("rule_id", *keep)


def rule_counts(texts: DataFrame, rule_keyword: DataFrame, text: str = "text", whole_words: bool = False) -> DataFrame:
    """(rule_id, hits): how many rows ``rule_hits`` has for each rule. Rules and the rows that they hit are never listed: texts are
    filed under keywords in the tasks that read them (see ``word_sets``), and the sets of a rule's keywords are united (see ``united``)."""
    rows = texts.select(F.col(text).alias("_text"))
    filed = rewritten(rule_keyword.select("rule_id", "keyword").filter("keyword <> ''").distinct(), "filed")
    distinct = filed.select("keyword").distinct()
    if whole_words:
        links = _wanted(distinct).withColumn("spaced", F.lit(False))
        each = rows.select(_parts(F.col("_text")).alias("words"))
    else:
        links = _sought(distinct).select("keyword", F.col("part").alias("word"), F.lit(1).alias("wanted"), "spaced")
        spaced = not links.filter("spaced").isEmpty()
        each = rows.select(words(F.col("_text")).alias("words"), *([F.col("_text").alias("text")] if spaced else []))
    return united.counts(filed, word_sets.hit_sets(each, links, inside=not whole_words), "rule_id", "keyword").withColumnRenamed("n", "hits")

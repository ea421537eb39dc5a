"""The pipeline over rows that are hard on it: nulls, repeats, empty and long texts, clashing columns, an empty table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from watchfloor.llm import mixing, near_copies
from watchfloor.llm.common import rewritten

# Names that operators use inside, besides those of documents.
CLASHES = "taken row size key doc hash id n words nth kept_id kept_hash node group component text_hash part __id __hash __n".split()
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="module")
def rows():
    words = "the cat and the dog were here with all the others in the big old house by the river near our town".split()
    texts = [" ".join(words[(k * 7 + i * (k % 5 + 1)) % len(words)] for i in range(40 + k)) for k in range(24)]
    out = [(k, t, "en", "ab"[k % 2], len(t)) for k, t in enumerate(texts)]
    out += [(30, None, None, None, None), (31, "", "en", "a", 0), (32, "12 34", None, None, 5), (None, "a cat without an id sat here", None, "a", 28), (None, "a cat without an id sat here", None, "a", 28)]
    out += [(33, texts[0], "en", "b", 1), (0, texts[0], "en", "a", len(texts[0])), (34, "word " * 30_000 + "end", "en", None, 150_003)]
    return out


def run(spark, docs, last=True):
    for name, stage in corpus_pipeline.STAGES[: None if last else -1]:
        docs = rewritten(stage(spark, docs, ""), name.replace(" ", "-"))
    return docs


def test_stages_take_odd_rows_and_keep_all_columns(spark, rows):
    docs = frame(spark, rows)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = rewritten(stage(spark, kept, ""), name.replace(" ", "-"))
        assert kept.columns == docs.columns, name
        assert name == "mixing" or kept.count() <= before
    ids = kept.select("doc_id").distinct().collect()
    assert {30, 31, 32, 33}.isdisjoint({r.doc_id for r in ids})
    assert kept.filter(F.col("taken") != CLASHES.index("taken")).isEmpty()
    encoded = run(spark, docs)
    assert encoded.filter("NOT round_trip").isEmpty() and encoded.count() == kept.count()


def test_stages_take_an_empty_table(spark, rows):
    assert run(spark, frame(spark, rows[:0])).count() == 0


def test_one_of_repeated_rows_stays(spark, rows):
    kept = near_copies.without_near_copies(frame(spark, rows))
    texts = [r.text for r in kept.collect()]
    assert texts.count(rows[0][1]) == 1 and texts.count("a cat without an id sat here") == 1


def test_mix_takes_what_was_decided(spark, rows):
    docs = frame(spark, [r for r in rows if r[0] is not None])
    decided = mixing.mix_sources(docs).agg(F.sum("taken")).first()[0]
    got = mixing.mixed_documents(docs).agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0]
    assert got == decided

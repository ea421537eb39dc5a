"""The registered queries and the pipeline on the smallest tables."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import corpus_pipeline  # noqa: E402
from watchfloor.llm import queries  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language": "doc_id held_out lang_pred score",
    "op2_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op4_near_vectors": "vec_id n_links component_id kept",
    "op5_near_copies": "doc_id class_id kept",
    "op6_mixing": "doc_id size source_size target taken",
    "op7_toxicity": "doc_id held_out score predicted",
    "op8_pieces": "doc_id ids n_tokens round_trip",
    "op9_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op10_repeats": "doc_id n_bytes n_removed n_spans kept_sha256 text",
    "op11_collocations": "lang rank phrase a l r n score",
    "op12_token_files": "doc_id start n_tokens ids_crc32",
    "op13_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


def test_every_query_states_its_columns():
    assert COLUMNS.keys() == queries.QUERIES.keys()


def test_phrases_have_their_columns(spark):
    assert COLUMNS["op11_collocations"].split() == queries.QUERIES["op11_collocations"](spark, SF_DIR).columns


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - {"op11_collocations"}))
def test_query_returns_a_row_for_each_of_its_table(spark, name):
    table = {"op4_near_vectors": "embeddings", "op9_warc": "pages"}.get(name, "documents")
    got = queries.QUERIES[name](spark, SF_DIR)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    assert got.count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, name):
    import check_oracle

    assert check_oracle.compare(spark, check_oracle.connect(SF_DIR), name, SF_DIR).startswith("ok")


def test_mix_runs_no_python(spark):
    plan = queries.QUERIES["op6_mixing"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.rewritten(stage(spark, docs, SF_DIR), "test")
        seen[name] = (before, docs)
        assert docs.columns == (columns if name != "SentencePiece" else ["doc_id", "ids", "n_tokens", "round_trip"])

    def ids(df):
        return Counter(r.doc_id for r in df.select("doc_id").collect())

    before, after = seen["language ID"]
    assert ids(after) == ids(before.filter("text RLIKE '[a-zA-Z]'"))

    def shingles(text):
        words = text.lower().split()
        return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))

    before, after = seen["near-dedup"]
    bags = {r.doc_id: shingles(r.text) for r in before.collect()}
    group = {}
    for i in sorted(bags):
        group[i] = i
        for j in [j for j in group if j != i and sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())]:
            old, new = sorted((group[i], group[j]))[::-1]
            group = {k: new if g == old else g for k, g in group.items()}
    assert ids(after) == Counter(set(group.values()))

    before, after = seen["secret scans"]
    assert ids(before) == ids(after) and after.filter("n_chars <> char_length(text)").isEmpty()
    assert queries.secret_scans.scan_secrets(after).filter("spans <> ''").isEmpty()

    before, after = seen["mixing"]
    wanted = queries.mixing.mix_sources(before).agg({"taken": "sum"}).first()[0]
    assert sum(len(r.text.split()) for r in after.collect()) == wanted
    before, after = seen["SentencePiece"]
    assert after.count() == before.count() and after.filter("NOT round_trip").isEmpty()

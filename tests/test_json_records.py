import json
import random

import pytest
from pyspark.sql import functions as F

from watchfloor.sources import json_records
from watchfloor.sources.json_records import documents, read_json_records

AWKWARD = ['a "quoted" {brace}', "back\\slash\\", '\\"', "[not] an {array}", "ünïcödé 日本 😀", "", "\\\\\\", "line\nbreak\t", "}" * 40, '"' * 21]


def records(n, seed=1):
    rng = random.Random(seed)
    return [{"id": i, "text": rng.choice(AWKWARD) * rng.randint(1, 4), "deep": {"list": [{"x": rng.choice(AWKWARD)}, [1, [2]]], "none": None}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_records_equal_those_of_the_whole_document(spark, tmp_path, indent, size):
    wanted = records(40 if size < 64 else 120)
    document = {"note": 'x", "items": [', "spec": [{"id": -1}, {"id": -2}], "items": wanted, "nested": {"items": [{"id": -3}]}, "after": [[{"id": -4}], {"id": -5}]}
    (tmp_path / "one.json").write_text(json.dumps(document, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "two.json").write_text(json.dumps({"items": [], "spec": [{"id": 9}]}))
    (tmp_path / "empty.json").write_text("")
    rows = read_json_records(spark, f"file://{tmp_path}", "items", range_bytes=size).orderBy("start").collect()
    assert [json.loads(r.record) for r in rows] == wanted


def test_top_level_array(spark, tmp_path):
    wanted = records(30, 5)
    (tmp_path / "one.json").write_text(json.dumps([1, "two", *wanted, [3]]))
    rows = read_json_records(spark, f"file://{tmp_path}/one.json", range_bytes=50).orderBy("start").collect()
    assert [json.loads(r.record) for r in rows] == wanted


def test_a_file_gives_several_tasks_and_equals_multiline(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"items": records(500, 9)}))
    schema = "id INT, text STRING, deep STRUCT<none STRING>"
    path = f"file://{tmp_path}/one.json"
    whole = spark.read.schema(f"items ARRAY<STRUCT<{schema}>>").option("multiLine", True).json(path).select(F.explode("items").alias("e"))
    assert sorted(map(str, documents(spark, path, "items", schema).collect())) == sorted(map(str, whole.collect()))
    ranges = read_json_records(spark, path, "items", range_bytes=1000).select(F.spark_partition_id().alias("p"), "start")
    assert ranges.select("p").distinct().count() > 1


def test_backslashes_over_the_edges_of_ranges():
    import numpy as np

    text = b'{"a": "\\\\\\" \\\\", "b": "\\\\"}'
    quotes, _, _ = json_records.marks(np.frombuffer(text, np.uint8), 0)
    for cut in range(len(text) + 1):
        run = len(text[:cut]) - len(text[:cut].rstrip(b"\\"))
        left, _, _ = json_records.marks(np.frombuffer(text[:cut], np.uint8), 0)
        right, _, _ = json_records.marks(np.frombuffer(text[cut:], np.uint8), run)
        assert [*left.tolist(), *(right + cut).tolist()] == quotes.tolist(), cut

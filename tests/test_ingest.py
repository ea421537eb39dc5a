from watchfloor.sources import rules
from watchfloor.sources.ingest import RuleStore

RULE = "title: {title}\nid: 11111111-2222-3333-4444-{number:012d}\nlevel: high\nlogsource:\n    product: windows\ndetection:\n    sel:\n        Image: {title}\n    condition: sel\n"


def test_only_changed_files_are_parsed_and_the_result_is_that_of_a_full_run(spark, tmp_path):
    folder, store = tmp_path / "rules", RuleStore(spark, f"file://{tmp_path}/store")
    (folder / "sub").mkdir(parents=True)

    def put(name, title, number):
        (folder / name).write_text(RULE.format(title=title, number=number))

    def check(change, want):
        assert {r.path.rsplit("/", 1)[1]: r.change for r in change.files.collect()} == want
        full, errors = rules.read_rules(spark, f"file://{folder}")
        columns = ["id", "name", "severity", "path", "detection_logic"]
        assert sorted(map(str, store.records().select(columns).collect())) == sorted(map(str, full.select(columns).collect()))
        assert sorted(r.path for r in store.errors().collect()) == sorted(r.path for r in errors.collect())
        parsed = spark.read.parquet(f"file://{tmp_path}/store/records/{change.run}")
        assert {r.path.rsplit("/", 1)[1] for r in parsed.select("path").collect()} <= {k for k, v in want.items() if v != "removed"}

    put("a.yml", "One", 1)
    put("sub/b.yml", "Two", 2)
    (folder / "bad.yml").write_text("title: [unclosed\ndetection:\n    sel: {}\n")
    check(store.ingest(f"file://{folder}"), {"a.yml": "added", "b.yml": "added", "bad.yml": "added"})
    check(store.ingest(f"file://{folder}"), {})
    put("a.yml", "One again", 1)
    put("c.yml", "Three", 3)
    (folder / "sub/b.yml").unlink()
    check(store.ingest(f"file://{folder}"), {"a.yml": "changed", "c.yml": "added", "b.yml": "removed"})
    put("sub/b.yml", "Two", 2)
    check(store.ingest(f"file://{folder}"), {"b.yml": "added"})
    before = sorted(r.id for r in store.records().collect())
    store.compact()
    assert sorted(r.id for r in store.records().collect()) == before
    check(store.ingest(f"file://{folder}"), {})

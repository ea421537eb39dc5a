"""Every registered query against its SQL twin on the smallest tables."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as contract  # noqa: E402
from watchfloor.functions.text import kql_tables  # noqa: E402
from workload.registry import QUERIES  # noqa: E402

SF_DIR = contract.SMOKE_DIR
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    import check_oracle

    return check_oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, db, name):
    import check_oracle

    assert check_oracle.compare(spark, db, name, SF_DIR).startswith("ok")


def test_entry(spark):
    assert contract.entry(spark).count() == 8


def test_no_query_plans_a_product_join(spark):
    for name, run in QUERIES.items():
        plan = run(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name


def test_kql_tables_are_read_once(spark, tmp_path):
    parts = [(k, f"p {k}" if k else None, k, "TYPE") for k in range(4)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["kql_features"](spark, str(tmp_path))
    alone = spark.range(1).select(kql_tables(F.col("id").cast("string")).alias("found"))
    times = [df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") for df in (found, alone)]
    assert times[0] == times[1] > 0
    want = {1: ("SigninLogs", "cloud"), 2: ("OwnTable", ""), 3: ("SecurityEvent", "windows")}
    assert {r.detection_id: (r.tables, r.platforms) for r in found.filter("detection_id > 0").collect()} == want
    assert {r.fields for r in found.filter("detection_id > 0").collect()} == {"EventID,Host,Score,User"}

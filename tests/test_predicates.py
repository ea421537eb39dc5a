import itertools
import re

import pytest
from pyspark.sql import functions as F

from watchfloor.operators.predicates import Fields, UntranslatableCondition, predicate, rule_predicate

EVENTS = [
    (1, "cmd.exe", "C:\\Windows\\cmd.exe /c whoami", "10.1.2.3", "5", {"extra": "yes"}),
    (2, "Powershell.exe", "powershell -enc AAAA", "192.168.0.9", "50", {}),
    (3, None, "it's 100% plain", "10.255.255.255", "x", {"extra": "no"}),
    (4, "rundll32.exe", "rundll32 \\\\srv\\share\\a.dll\nnext", "not an ip", None, None),
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(
        EVENTS, "id INT, image STRING, cmd STRING, ip STRING, n STRING, attrs MAP<STRING, STRING>"
    ).cache()


def ids(events, fold=False, **detection):
    condition = predicate(detection, Fields(["image", "cmd", "ip", "n"]), fold)
    return sorted(r.id for r in events.filter(condition).collect())


@pytest.mark.parametrize(
    "selection, expected",
    [
        ({"image": "cmd.exe"}, [1]),
        ({"image": "CMD.EXE"}, []),
        ({"image": ["cmd.exe", "rundll32.exe"]}, [1, 4]),
        ({"cmd|contains": "it's"}, [3]),
        ({"cmd|contains": "%"}, [3]),
        ({"cmd|startswith": "C:\\Win"}, [1]),
        ({"cmd|endswith": "AAAA"}, [2]),
        ({"cmd|contains|all": ["powershell", "AAAA"]}, [2]),
        ({"cmd|contains|all": ["powershell", "BBBB"]}, []),
        ({"cmd|re": "powershell -enc [A-Z]+"}, [2]),
        ({"cmd|re": "-enc"}, []),
        ({"n|gt": 5}, [2]),
        ({"n|gte": 5, "n|lt": 50}, [1]),
        ({"n|lte": 50}, [1, 2]),
        ({"ip|cidr": "10.0.0.0/8"}, [1, 3]),
        ({"ip|cidr": ["192.168.0.0/24", "172.16.0.0/12"]}, [2]),
        ({"image|exists": True}, [1, 2, 4]),
        ({"image|exists": False}, [3]),
        ({"image": None}, [3]),
        ({"extra": "yes"}, [1]),
        ({"cmd|base64|contains": "x"}, []),
    ],
)
def test_field_conditions(events, selection, expected):
    assert ids(events, sel=selection, condition="sel") == expected


def test_case_insensitive_option(events):
    assert ids(events, fold=True, sel={"image": "POWERSHELL.EXE"}, condition="sel") == [2]
    assert ids(events, fold=True, sel={"image|cased": "POWERSHELL.EXE"}, condition="sel") == []
    assert ids(events, fold=True, sel={"image": ["CMD.exe", "zz"]}, condition="sel") == [1]


def test_list_of_maps_is_or(events):
    assert ids(events, sel=[{"image": "cmd.exe"}, {"n": "50"}], condition="sel") == [1, 2]


def test_missing_field_does_not_match_either_side_of_not(events):
    # Row 3 has no image: the filter does not hold for it, so "not filter" does.
    assert ids(events, sel={"cmd|contains": "i"}, f={"image": "cmd.exe"}, condition="sel and not f") == [3]
    assert ids(events, f={"image": "cmd.exe"}, condition="not (f)") == [2, 3, 4]


CONDITIONS = [
    "a", "not a", "a and b", "a or b", "a and not b", "not a and not b", "(a or b) and c", "a or b and c",
    "not (a or b)", "not (a and not b) or c", "1 of sel_*", "all of sel_*", "1 of sel_* and not c",
    "not 1 of sel_*", "all of them", "NOT a AND (b OR c)",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_truth_table(spark, condition):
    names = ["a", "b", "c", "sel_x", "sel_y"]
    rows = [tuple("1" if bit else None for bit in bits) for bits in itertools.product([0, 1], repeat=5)]
    table = spark.createDataFrame(rows, ", ".join(f"f_{n} STRING" for n in names))
    detection = {n: {f"f_{n}": "1"} for n in names}
    got = table.select("*", F.coalesce(predicate({**detection, "condition": condition},
                                                 Fields([f"f_{n}" for n in names], None)), F.lit(False)).alias("hit"))
    py = condition.lower()
    py = py.replace("1 of sel_*", "(sel_x or sel_y)").replace("all of sel_*", "(sel_x and sel_y)")
    py = py.replace("all of them", "(a and b and c and sel_x and sel_y)")
    for row in got.collect():
        values = {n: row[f"f_{n}"] is not None for n in names}
        assert row.hit == eval(py, {}, values), (condition, values)  # noqa: S307 - fixed test expressions


@pytest.mark.parametrize(
    "detection",
    [
        {"sel": {"image": "x"}, "condition": "sel and nothere"},
        {"sel": {"image": "x"}, "condition": "1 of other*"},
        {"sel": {"image": "x"}, "condition": "sel | count() by ip > 50"},
        {"sel": {"image|wide": "x"}, "condition": "sel"},
        {"sel": {"image": []}, "condition": "sel"},
        {"sel": {"image": "x"}, "condition": "sel; drop"},
        {"sel": {"image": "x"}},
    ],
)
def test_untranslatable_is_an_error(detection):
    with pytest.raises(UntranslatableCondition):
        rule_predicate(detection)


def test_exact_match_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("cast(id AS STRING) AS image").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    plan = table.filter(predicate({"s": {"image": ["3", "4"]}, "condition": "s"}, Fields(["image"], None)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*In\(image", text)
    assert plan.count() == 2


@pytest.mark.parametrize("network", ["0.0.0.0/0", "8.0.0.0/7", "10.0.0.0/8", "172.16.0.0/12", "10.1.0.0/16", "10.0.8.0/21",
                                     "10.1.2.0/24", "10.1.2.128/25", "10.1.2.3/32", "10.1.2.2/31"])
def test_cidr_against_the_address_library(spark, network):
    import ipaddress
    import random

    rng = random.Random(network)
    texts = [".".join(str(rng.choice([0, 1, 2, 3, 8, 9, 10, 15, 16, 31, 32, 127, 128, 172, 255])) for _ in range(4))
             for _ in range(300)]
    texts += ["10.1.2.3", "10.1.2.2", "10.1.2.200", "10.0.15.1", "10.0.16.1", "172.31.0.1", "9.0.0.1"]
    bad = ["10.1.2", "10.1.2.3.4", "10.1.2.256", "10.01.2.3", "10.1.2.x", "", "10.1.2.3 ", "10.1..3"]
    table = spark.createDataFrame([(t,) for t in texts + bad], "ip STRING")
    got = {r.ip for r in table.filter(predicate({"s": {"ip|cidr": network}, "condition": "s"}, Fields(["ip"], None))).collect()}
    assert got == {t for t in texts if ipaddress.ip_address(t) in ipaddress.ip_network(network)}

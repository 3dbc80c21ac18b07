import datetime as dt
from decimal import Decimal

import pytest

from tidelog.functions import filters as f

ROWS = [
    (1, "alice", 30, "hz", None, Decimal("10.50"), "10.50", True, 1.5, dt.datetime(2024, 3, 15, 1, 2, 3)),
    (2, "bob", None, "sh", "a\nb", Decimal("9.00"), "9", False, None, None),
    (3, "ann", 20, None, "50%_x", None, "abc", None, 0.1, None),
    (4, "Żan", 7, "", "ab\n", Decimal("-3.00"), None, None, -2.0, None),
    (5, "x", 1, "hz", "a.c", Decimal("0.00"), "1.2.3", None, 2.0, None),
]
SCHEMA = "id long, name string, age int, city string, title string, amount decimal(10,2), num string, ok boolean, score double, at timestamp_ntz"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("city = 'hz'", [1, 5]),
        ("NOT city = 'hz'", [2, 3, 4]),
        ("NOT (city = 'hz' OR city IS NULL)", [2, 4]),
        ("CITY = 'hz' and Age >= 30", [1]),
        ("city = NULL", []),
        ("NOT city = NULL", [1, 2, 3, 4, 5]),
        ("age < 21 AND NOT name LIKE 'a%'", [4, 5]),
        ("age <> 20", [1, 4, 5]),
        ("amount >= 10", [1]),
        ("amount = 10.5", [1]),
        ("amount = 'x'", []),
        ("amount != 'x'", [1, 2, 4, 5]),
        ("num >= 10", [1, 3]),
        ("num = 10.5", [1]),
        ("num = 1.2.3", [5]),
        ("num > '9'", [1, 3]),
        ("num IN (9, 'abc', NULL)", [2, 3]),
        ("missing IS NULL", [1, 2, 3, 4, 5]),
        ("missing IS NOT NULL OR missing = 1 OR missing IN (1) OR missing LIKE '%'", []),
        ("title IS NOT NULL", [2, 3, 4, 5]),
        ("title LIKE 'a%'", [5]),
        ("title LIKE 'a_c'", [5]),
        (r"title LIKE '%\%\_x'", [3]),
        ("title LIKE '%.%'", [5]),
        ("title LIKE 'ab'", []),
        ("name LIKE '_an'", [4]),
        ("name > 'b'", [2, 4, 5]),
        ("ok = 1", [1]),
        ("ok = 0", [2]),
        ("score > 1", [1, 5]),
        ("score = 0.1", [3]),
        ("at >= '2024-03-15'", [1]),
        ("at LIKE '%01:02:03.000000'", [1]),
        ("id = 1 OR id = 2 AND age IS NOT NULL", [1]),
        ("(id = 1 OR id = 2) AND age IS NULL", [2]),
        ("NOT NOT id = 1", [1]),
        ("`id` = +1", [1]),
        ("amount < -2.5", [4]),
        ("name = 'o''x'", []),
    ],
)
def test_filters(people, text, ids):
    condition = f.compile_filter(f.parse_filter(text), f.struct_lookup(people.schema))
    assert sorted(r["id"] for r in people.where(condition).collect()) == ids
    assert people.where(condition.isNull()).count() == 0  # two-valued


@pytest.mark.parametrize("text", ["", "a", "a =", "= 1", "a = 1 b", "(a = 1", "a = 1)", "a IN 1", "a IN (1", "a IN ()", "a LIKE 1", "a NOT IN (1)", "a NOT LIKE 'x'", "a BETWEEN 1 AND 2", "a IS 1", "a = 'x", "a == 1", "a = b", "a = 1e5", "a > > 1", "NOT", "a # 1"])
def test_syntax_errors(text):
    with pytest.raises(f.FilterSyntaxError):
        f.parse_filter(text)


def test_filter_reaches_the_scan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    text = rows.where(f.compile_filter(f.parse_filter("c_custkey > 100"), f.struct_lookup(rows.schema)))._jdf.queryExecution().executedPlan().toString()
    assert "c_custkey" in text and "Python" not in text

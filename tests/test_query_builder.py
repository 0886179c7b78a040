"""The declarative builder against the fixture workbook and its rules."""

import pytest

from lexigrain.functions.values import decimal_text, number, value_text
from lexigrain.plans.query import Aggregate, Condition, Query, header_keys, resolve, run

ROWS = [("East", "Alice", "10"), ("West", "Bob", "20"), ("East", "Cara", "30")]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)], "at long, Region string, Rep string, Amount string")


def values(df):
    return [tuple(r) for r in df.collect()]


def test_where_select_order_limit(sales):
    q = Query(where=[Condition("Region", "eq", "East")], select=["Rep", "Amount"], order_by=[("Rep", True)], limit=1)
    assert values(run(sales, q, "at")) == [("Cara", "30")]


def test_conditions_all_hold(sales):
    q = Query(where=[Condition("Rep", "contains", "A"), Condition("Amount", "gt", 15), Condition("Amount", "lt", "35")])
    assert values(run(sales, q, "at")) == [("East", "Cara", "30")]


def test_groups(sales):
    q = Query(group_by=["Region"], aggregates=[Aggregate(op, "Amount") for op in ("sum", "avg", "min", "max", "count")])
    found = run(sales, q, "at")
    assert found.columns[1:] == ["sum_Amount", "avg_Amount", "min_Amount", "max_Amount", "count_Amount"]
    assert sorted(values(found)) == [("East", "40", "20.0", "10", "30", "2"), ("West", "20", "20.0", "20", "20", "1")]


def test_groups_without_numbers(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "1.50"), (3, "a", None)], "at long, k string, v string")
    found = run(df, Query(group_by=["k"], aggregates=[Aggregate("avg", "v"), Aggregate("sum", "v"), Aggregate("count", "*", "n")]), "at")
    assert sorted(values(found)) == [("", "1.5", "1.5", "1"), ("a", "0", None, "2")]


def test_numbers_before_text(spark):
    df = spark.createDataFrame([(1, "100"), (2, "b"), (3, "9"), (4, None), (5, "10"), (6, "9")], "at long, v string")
    assert [v for v, in values(run(df, Query(order_by=[("v", False)]), "at"))] == ["9", "9", "10", "100", None, "b"]


@pytest.mark.parametrize("bad", [Query(where=[Condition("Region", "like", "x")]), Query(group_by=["Region"], aggregates=[Aggregate("median", "Amount")]), Query(where=[Condition("Nope!", "eq", "x")])])
def test_unknown_parts(sales, bad):
    with pytest.raises(ValueError):
        run(sales, bad, "at")


def test_columns_by_letter_and_place():
    names = ["Region", "Rep", "Amount"]
    assert [resolve(names, n) for n in ("C", "Col2", "Region")] == ["Amount", "Rep", "Region"]
    with pytest.raises(ValueError, match="Region, Rep, Amount"):
        resolve(names, "D")


def test_header_labels():
    assert header_keys([" A ", "", "A", None, "A"]) == ["A", "__col2", "A_2", "__col4", "A_3"]


TYPED = [("1_000", 1000.0), (" 7 ", 7.0), ("1.5e3", 1500.0), (".5", 0.5), ("5.", 5.0), ("1e5", None), ("nan", None), ("10%", None), ("1,234", None), ("", None), ("+3", 3.0), ("2020-01-01", None)]


def test_typing(spark):
    df = spark.createDataFrame([(t,) for t, _ in TYPED], "t string")
    assert [r[0] for r in df.select(number(df["t"])).collect()] == [n for _, n in TYPED]


def test_texts_of_values(spark):
    texts = ["007", "1.50", "-0", "1_0", "x", "10000000.0", "0.00001", "123456789012.5", "1.5e300", "0.0001", "20."]
    want = ["7", "1.5", "0", "10", "x", "10000000.0", "1e-05", "123456789012.5", "1.5e+300", "0.0001", "20.0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(value_text(df["t"])).collect()] == want
    numbers = [1e16, 123456.789, 1e7, 0.1, -2.5e-7, 0.0]
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    assert [r[0] for r in df.select(decimal_text(df["v"])).collect()] == [repr(v) for v in numbers]


def test_spellings_of_a_number_are_one_group(spark):
    df = spark.createDataFrame([(1, "007", "9007199254740993"), (2, "7.0", "1"), (3, "7", None), (4, "7.5", "2"), (5, "x", "1.50"), (6, None, "3")], "at long, k string, v string")
    found = run(df, Query(group_by=["k"], aggregates=[Aggregate("sum", "v"), Aggregate("min", "v"), Aggregate("count", "*", "n")]), "at")
    assert sorted(values(found)) == [("", "3", "3", "1"), ("7", "9007199254740994", "1", "3"), ("7.5", "2", "2", "1"), ("x", "1.5", "1.5", "1")]
    assert values(run(df, Query(where=[Condition("v", "contains", "50")]), "at")) == []
    assert values(run(df, Query(where=[Condition("v", "eq", "1.5")]), "at")) == [("x", "1.5")]
    assert values(run(df, Query(where=[Condition("v", "contains", "none")], select=["k"]), "at")) == [("7",)]
    assert values(run(df, Query(where=[Condition("k", "eq", "None")], select=["v"]), "at")) == [("3",)]


def test_typed_columns_are_compared_in_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) as t", "id / 4 as d", "'w' || id as w").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    q = Query(where=[Condition("id", "gt", 3), Condition("w", "eq", "w8"), Condition("d", "lt", "9")])
    found = run(df, q)
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1]
    assert [x for x in ("GreaterThan(id,3", "EqualTo(w,w8)", "LessThan(d,9.0)") if x not in pushed] == []
    assert values(found) == [("8", "8", "2.0", "w8")]
    assert values(run(df, Query(where=[Condition("id", "eq", "8.0")]))) == []
    assert values(run(df, Query(group_by=["d"], aggregates=[Aggregate("max", "id")], where=[Condition("id", "lt", 1)]))) == [("0.0", "0")]

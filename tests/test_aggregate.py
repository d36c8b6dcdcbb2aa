import pytest
from pyspark.sql import functions as F

from layerkit.operators import aggregate as A, sets as S


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [("n", 1, 10.0, "a"), ("n", 2, None, "b"), ("s", 3, 5.0, "c"), ("s", 4, 7.0, None)],
        "area string, day int, amount double, tag string",
    )


def test_group_by_source_names(sales):
    out = A.group(
        sales, "area",
        {
            "total": ("List.Sum", "amount"), "n": ("Table.RowCount",), "filled": ("List.Count", "amount"),
            "first": ("List.First", "tag", "day"), "last": ("List.Last", "tag", "day"),
            "latest_down": ("List.First", "tag", [("day", "desc")]), "kinds": ("List.Distinct", "tag"),
        },
    )
    assert rows(out) == [("n", 10.0, 2, 1, "a", "b", "b", 2), ("s", 12.0, 2, 2, "c", None, None, 1)]


def test_group_without_aggregates_counts(sales):
    assert rows(A.group(sales, "area")) == [("n", 2), ("s", 2)]
    assert rows(A.group(sales, (), {"n": ("rows",), "top": ("max", "amount")})) == [(4, 10.0)]


def test_first_needs_an_order(sales):
    with pytest.raises(ValueError, match="order_by"):
        A.group(sales, "area", {"x": ("List.First", "tag")})


def test_an_unknown_aggregate_is_first(sales):
    with pytest.raises(ValueError, match="order_by"):
        A.group(sales, "area", {"x": ("List.Median", "tag")})


def test_pivot_keeps_the_other_columns_as_keys(spark):
    df = spark.createDataFrame(
        [("E1", "births", 5), ("E1", "deaths", 3), ("E2", "births", 4)], "code string, attribute string, value int"
    )
    out = A.pivot(df, "attribute", "value", ["births", "deaths"])
    assert out.columns == ["code", "births", "deaths"]
    assert rows(out) == [("E1", 5, 3), ("E2", 4, None)]
    assert rows(A.pivot(df, "attribute", "value")) == rows(out)
    holes = df.union(spark.createDataFrame([("E2", None, 99)], df.schema))
    assert A.pivot(holes, "attribute", "value").columns == ["code", "births", "deaths", "null"]
    assert rows(A.pivot(holes, "attribute", "value")) == [("E1", 5, 3, None), ("E2", 4, None, 99)]
    with pytest.raises(ValueError, match="null_name"):
        A.pivot(holes, "attribute", "value", null_name="births")


def test_pivot_first_follows_its_order(spark):
    df = spark.createDataFrame([("E1", "a", 5, 2), ("E1", "a", 9, 1)], "code string, kind string, value int, t int")
    assert rows(A.pivot(df, "kind", "value", ["a"], keys=["code"], order_by="t")) == [("E1", 9)]
    assert rows(A.pivot(df, "kind", "value", ["a"], keys=["code"], how="List.Sum")) == [("E1", 14)]


def test_unpivot_named_and_other(spark):
    df = spark.createDataFrame([("E1", 1, None)], "`LSOA Code` string, `2020` int, `2021` int")
    want = [("E1", "2020", 1), ("E1", "2021", None)]
    assert rows(A.unpivot(df, ["2020", "2021"], "Year", "Value")) == want
    assert rows(A.unpivot_other(df, ["LSOA Code"], "Year", "Value")) == want
    assert rows(A.unpivot_other(df, ["LSOA Code"], "Year", "Value", drop_nulls=True)) == want[:1]


def test_unpivot_mixed_types_after_a_cast(spark):
    df = spark.createDataFrame([(1, 2, "x")], "id int, a int, b string")
    assert rows(A.unpivot_other(df, ["id"], type="string")) == [(1, "a", "2"), (1, "b", "x")]


def test_combine_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    b = spark.createDataFrame([(True, 2)], "flag boolean, id int")
    out = S.combine([a, b])
    assert out.columns == ["id", "v", "flag"]
    assert rows(out) == [(1, "x", None), (2, None, True)]


def test_distinct_and_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "id int, v string")
    assert S.distinct(df).count() == 2
    assert S.distinct_by(df, "id").count() == 1
    assert rows(S.row_counts({"t": df, "empty": df.limit(0)})) == [("empty", 0), ("t", 3)]


def test_a_hot_group_is_combined_before_the_shuffle(spark):
    plan = A.group(spark.range(10).select((F.col("id") % 2).alias("k"), "id"), "k", {"n": ("sum", "id")})
    assert "partial_sum" in plan._jdf.queryExecution().executedPlan().toString()

import pytest
from pyspark.sql import functions as F, types as T

from layerkit.functions import predicates as P
from layerkit.functions.columns import col, sort_keys
from layerkit.functions.types import spark_type
from layerkit.operators import project as X
from layerkit.operators.recipe import run_recipe


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        [(1, "a.b", None), (2, None, 1.5), (3, "", 2.5), (None, "A", 3.5)], "id int, `full name` string, `x.y` double"
    )


def test_select_rows_drops_null_conditions(df):
    assert [r[0] for r in rows(X.select_rows(df, F.col("id") > 1))] == [2, 3]


def test_compare_with_null_and_with_columns(df):
    assert [r[0] for r in rows(X.select_rows(df, P.compare(col("x.y"), "=", None)))] == [1]
    assert len(rows(X.select_rows(df, P.compare(col("x.y"), "<>", None)))) == 3
    assert [r[0] for r in rows(X.select_rows(df, P.compare(F.col("id"), ">", col("x.y"))))] == [2, 3]
    with pytest.raises(ValueError):
        P.compare(F.col("id"), "<", None)


def test_operator_words_inside_a_text_are_left_alone(spark):
    df = spark.createDataFrame([("salt and pepper",), ("x",)], "t string")
    assert rows(X.select_rows(df, P.compare(F.col("t"), "=", "salt and pepper"))) == [("salt and pepper",)]


def test_case_with_many_branches_and_no_default(df):
    c = X.case([(F.col("id") == 1, "one"), (F.col("id") == 2, "two"), (F.col("id") == 3, None)])
    assert [r[0] for r in rows(df.select(c))] == ["one", "two", None, None]
    assert rows(df.limit(1).select(X.case([], 5))) == [(5,)]


def test_rename_remove_select(df):
    out = X.rename(df, {"full name": "name", "x.y": "x"})
    assert out.columns == ["id", "name", "x"]
    assert X.remove_columns(out, ["name", "nothing"]).columns == ["id", "x"]
    with pytest.raises(ValueError):
        X.remove_columns(out, "nothing", strict=True)
    with pytest.raises(ValueError):
        X.rename(out, {"nothing": "y"})
    assert X.select_columns(df, ["x.y", "id"]).columns == ["x.y", "id"]


def test_cast_raises_or_gives_null(spark):
    df = spark.createDataFrame([("1",), ("y",)], "v string")
    assert rows(X.cast_types(df, {"v": "Int64.Type"}, on_error="null")) == [(1,), (None,)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        X.cast_types(df, {"v": "Int64.Type"}).collect()


def test_source_types():
    assert spark_type("Currency.Type") == T.DecimalType(19, 4)
    assert spark_type("type datetime", ntz=True) == T.TimestampNTZType()
    assert spark_type("no such type") == T.StringType()
    assert spark_type("decimal(18,2)") == T.DecimalType(18, 2)


def test_replace_text_is_literal(spark):
    df = spark.createDataFrame([("a.b",)], "v string")
    assert rows(X.replace_value(df, ".", "-", "v", "text")) == [("a-b",)]


def test_replace_null_takes_empty_texts_too(df):
    out = X.replace_value(df, None, "none", "full name")
    assert [r[1] for r in rows(out)] == ["a.b", "none", "none", "A"]
    assert [r[2] for r in rows(X.replace_value(df, None, 0.0, "x.y"))] == [0.0, 1.5, 2.5, 3.5]


def test_map_values_keeps_or_defaults(spark):
    df = spark.createDataFrame([("F",), ("Z",), (None,)], "v string")
    assert rows(X.map_values(df, "v", {"F": "Flat"})) == [("Flat",), ("Z",), (None,)]
    assert rows(X.map_values(df, "v", {"F": "Flat"}, default="Other")) == [("Flat",), ("Other",), ("Other",)]


def test_snake_case_and_collisions(spark):
    df = spark.createDataFrame([(1, 2)], "CustName int, `Date  Code` int")
    assert X.snake_case(df).columns == ["cust_name", "date_code"]
    with pytest.raises(ValueError, match="cust_name"):
        X.snake_case(spark.createDataFrame([(1, 2)], "CustName int, cust_name int"))


@pytest.mark.parametrize(
    "name, safe",
    [
        ("Total (%)", "total_pct"), ("2020 Sales", "_2020_sales"), ("A&B", "aandb"), ("a__b--c", "a_b_c"),
        ("***", "column"), ("Prix €", "prix"), ("x<y>z", "xltygtz"), ("C#", "cnum"),
    ],
)
def test_safe_name(name, safe):
    assert X.safe_name(name) == safe


def test_name_mapping(spark):
    df = spark.createDataFrame([(1, 2)], "`A b` int, c int")
    assert rows(X.name_mapping(df)) == [(0, "A b", "a_b", True), (1, "c", "c", False)]


def test_lineage(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    raw = X.add_load_lineage(spark.read.parquet(str(tmp_path / "t")), "load-1")
    found = raw.select("_source_file", "_load_id").distinct().collect()
    assert all("part-" in r[0] and r[1] == "load-1" for r in found)
    clean = X.to_clean_lineage(raw, "run-1")
    assert clean.columns == ["id", "_silver_timestamp", "_load_id"]


def test_duplicate_and_transform(df):
    out = X.duplicate_column(df, "id")
    assert out.columns[-1] == "id_copy"
    assert [r[0] for r in rows(X.transform_columns(df, {"id": lambda c: c * 10}))] == [10, 20, 30, None]


def test_buffer_keeps_the_table(df):
    kept = X.buffer(df)
    assert kept.storageLevel.useMemory and kept.count() == 4
    kept.unpersist()


def test_sort_keys_forms():
    assert [(k.name, k.descending) for k in sort_keys(["a", ("b", "desc"), ("c", "asc")])] == [
        ("a", False), ("b", True), ("c", False)
    ]
    assert sort_keys(("b", "desc"))[0].descending
    assert sort_keys(["a", "desc"])[1].name == "desc"
    with pytest.raises(ValueError):
        sort_keys([])


def test_recipe_folds_steps_and_rejects_unknown_ones(df):
    out = run_recipe(df, [("filter", {"condition": F.col("id").isNotNull()}), ("remove_columns", {"names": "x.y"})])
    assert out.columns == ["id", "full name"] and out.count() == 3
    with pytest.raises(ValueError, match="unknown step"):
        run_recipe(df, [("promote", {})])


def test_recipe_steps_over_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, "a", None), (4, "c", 7)], "id int, k string, v int")
    out = run_recipe(
        df,
        [
            ("fill_down", {"columns": "v", "order_by": "id"}),
            ("skip", {"n": 1, "order_by": "id"}),
            ("remove_last_n", {"n": 1, "order_by": "id"}),
            ("union", {"tables": [df.filter("id = 1")]}),
            ("sort", {"order_by": [("id", "desc")]}),
        ],
    )
    assert rows(out) == [(3, "a", 5), (2, "b", 5), (1, "a", None)]

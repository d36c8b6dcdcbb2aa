import pytest
from pyspark.sql import functions as F

from layerkit.operators import joins as J


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "n")], "id int, l string")
    right = spark.createDataFrame([(2, "x"), (3, "y"), (None, "z")], "rid int, r string")
    return left, right


@pytest.mark.parametrize(
    "kind, expected",
    [
        ("JoinKind.Inner", [(2, "b", 2, "x"), (2, "c", 2, "x")]),
        ("JoinKind.LeftOuter", [(1, "a", None, None), (2, "b", 2, "x"), (2, "c", 2, "x"), (None, "n", None, None)]),
        ("JoinKind.RightOuter", [(2, "b", 2, "x"), (2, "c", 2, "x"), (None, None, 3, "y"), (None, None, None, "z")]),
        ("JoinKind.LeftAnti", [(1, "a"), (None, "n")]),
        ("JoinKind.RightAnti", [(3, "y"), (None, "z")]),
        ("no such kind", [(1, "a", None, None), (2, "b", 2, "x"), (2, "c", 2, "x"), (None, "n", None, None)]),
    ],
)
def test_kinds(sides, kind, expected):
    assert rows(J.join_on(*sides, "id", "rid", kind)) == sorted(expected, key=repr)


def test_full_outer_with_a_shared_key_name_shows_either_side(spark):
    left = spark.createDataFrame([(1, "a")], "k int, l string")
    right = spark.createDataFrame([(2, "b")], "k int, r string")
    out = J.join_on(left, right, "k", how="outer")
    assert out.columns == ["k", "l", "r"]
    assert rows(out) == [(1, "a", None), (2, None, "b")]
    assert rows(J.join_on(left, right, "k", how="right")) == [(2, None, "b")]


def test_key_type_makes_unreadable_keys_match_nothing(spark):
    left = spark.createDataFrame([(1,), (2,)], "id long")
    right = spark.createDataFrame([("1", "Good"), ("zz", "Bad")], "urn string, rating string")
    out = J.join_on(left, right, "id", "urn", key_type="bigint")
    assert rows(out) == [(1, "1", "Good"), (2, None, None)]


def test_clashing_names_raise_before_they_are_ambiguous(spark):
    left = spark.createDataFrame([(1, "a")], "id int, v string")
    right = spark.createDataFrame([(1, "b")], "rid int, v string")
    with pytest.raises(ValueError, match="v"):
        J.join_on(left, right, "id", "rid")
    out = J.merge_queries(left, right, "id", "rid", expand={"v": "right v"})
    assert rows(out) == [(1, "a", "b")] and out.columns == ["id", "v", "right v"]


def test_merge_without_expand_takes_the_columns_the_left_side_lacks(sides):
    assert J.merge_queries(*sides, "id", "rid", "inner").columns == ["id", "l", "r"]


def test_nested_aggregates(sides):
    out = J.merge_queries(*reversed(sides), "rid", "id", aggregate={"n": F.count("*"), "first": F.min("l")})
    assert rows(out) == sorted([(2, "x", 2, "b"), (3, "y", None, None), (None, "z", None, None)], key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_salting_changes_nothing(spark, how):
    left = spark.range(2000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "rk long, w string")
    plain, salted = J.join_on(left, right, "k", "rk", how), J.join_on(left, right, "k", "rk", how, salt=5)
    assert rows(plain) == rows(salted)


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_a_repeated_side_is_never_broadcast(spark, how):
    left = spark.range(2000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    right = spark.range(3).select(F.col("id").alias("rk"))
    out = J.join_on(left, right, "k", "rk", how, salt=5)
    assert out.count() == sum(1 for i in range(2000) if how == "left" or (i % 7 < 3) == (how == "inner"))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_salt_is_refused_where_it_would_repeat_rows(sides):
    with pytest.raises(ValueError):
        J.join_on(*sides, "id", "rid", "right", salt=3)


def test_a_self_join_is_possible(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    out = J.join_on(df, df.withColumnsRenamed({"a": "a2", "b": "b2"}), "b", "a2", "inner")
    assert rows(out) == [(1, 2, 2, 3)]


def test_expand_keeps_or_drops_empty_rows(spark):
    df = spark.createDataFrame(
        [(1, [("x", 1)]), (2, []), (3, None)], "id int, nested array<struct<name:string,n:int>>"
    )
    assert rows(J.expand(df, "nested", {"name": "N"})) == [(1, "x"), (2, None), (3, None)]
    assert rows(J.expand(df, "nested", {"n": "n"}, outer=False)) == [(1, 1)]

import datetime

import pytest
from pyspark.sql import functions as F

from layerkit.profiling import findings as G, infer as I, profile as P, relations as R


@pytest.fixture(scope="module")
def df(spark):
    rows = [
        (i, f"u{i}@x.org" if i < 81 else "none", f"u{i}@x.org" if i < 79 else "none", i % 10, i % 11, None, float(i - 3),
         datetime.date(2024, 1, 1) + datetime.timedelta(days=i % 5), i % 2 == 0, "+44 20 7946" if i % 2 else None)
        for i in range(100)
    ]
    return spark.createDataFrame(
        rows, "id long, mail81 string, mail79 string, ten int, eleven int, none string, amount double, on date, flag boolean, phone string"
    )


@pytest.fixture(scope="module")
def profile(df):
    return {r["column_name"]: r for r in P.profile(df, "t").collect()}


def test_counts_and_types(profile):
    assert {n: r["data_type"] for n, r in profile.items()} == {
        "id": "bigint", "mail81": "nvarchar", "mail79": "nvarchar", "ten": "bigint", "eleven": "bigint",
        "none": "nvarchar", "amount": "decimal", "on": "datetime2", "flag": "bit", "phone": "nvarchar",
    }
    none = profile["none"]
    assert (none["null_count"], none["null_percentage"], none["distinct_count"], none["cardinality_percentage"]) == (100, 100.0, 0, 0.0)
    assert none["top_values"] is None and none["pattern"] is None
    assert profile["phone"]["cardinality_percentage"] == 2.0


def test_pattern_needs_more_than_four_fifths(profile):
    assert profile["mail81"]["pattern"] == "email" and profile["mail79"]["pattern"] is None
    assert profile["phone"]["pattern"] == "phone"


def test_top_values_up_to_ten_distinct(profile):
    assert [tuple(v) for v in profile["ten"]["top_values"]] == [(str(i), 10) for i in range(5)]
    assert profile["eleven"]["top_values"] is None
    assert [tuple(v) for v in profile["flag"]["top_values"]] == [("false", 50), ("true", 50)]


def test_ranges(profile):
    assert (profile["amount"]["min_value"], profile["amount"]["max_value"], profile["amount"]["avg_value"]) == (-3.0, 96.0, 46.5)
    assert (profile["on"]["min_date"], profile["on"]["max_date"]) == ("2024-01-01", "2024-01-05")
    assert (profile["mail81"]["min_length"], profile["mail81"]["max_length"]) == (4, 9)


def test_empty_table(df):
    empty = {r["column_name"]: r for r in P.profile(df.filter("id < 0"), "t").collect()}
    assert empty["id"]["total_count"] == 0 and empty["id"]["null_percentage"] == 0.0 and empty["id"]["min_value"] is None


def test_estimated_distinct_keeps_exact_top_values(df):
    rough = {r["column_name"]: r for r in P.profile(df, "t", distinct_error=0.02).collect()}
    assert [tuple(v) for v in rough["ten"]["top_values"]] == [(str(i), 10) for i in range(5)]
    assert abs(rough["id"]["distinct_count"] - 100) <= 5


def test_odd_column_types(spark):
    df = spark.createDataFrame([([1, 2], {"a": 1}, b"x", 0.0), (None, None, None, -0.0)], "a array<int>, m map<string,int>, b binary, z double")
    found = {r["column_name"]: r["distinct_count"] for r in P.profile(df, "t").collect()}
    assert found == {"a": 1, "m": 1, "b": 1, "z": 1}


def test_keys_tests_findings_and_advice(df):
    profiled = P.profile(df, "t")
    assert [r["column_name"] for r in G.pk_candidates(profiled).collect()] == ["id"]
    tests = {r["column_name"]: r["tests"] for r in G.recommended_tests(profiled).collect()}
    assert tests["id"] == ["unique", "not_null"]
    assert tests["ten"] == ["not_null", "accepted_values: ['0', '1', '2', '3', '4']"]
    assert tests["amount"] == ["not_null", "non_negative (custom test)"]
    assert tests["mail81"] == ["not_null", "email_format (custom test)"]
    found = {(r["column_name"], r["kind"]): r["message"] for r in G.quality_findings(profiled).collect()}
    assert found[("phone", "many_nulls")] == "phone has 50 nulls (50.0%) - Consider if column is needed"
    assert ("amount", "negative") in found and ("flag", "few_values") not in found
    advice = [r["recommendation"] for r in G.recommendations(profiled).orderBy("position").collect()]
    assert advice[0] == "Use id as primary key"
    assert advice[2] == "Add not_null tests to: mail81, mail79, ten, eleven, amount"


def test_no_key_advises_a_surrogate(df):
    advice = G.recommendations(P.profile(df.select("ten"), "t")).orderBy("position").collect()
    assert advice[0]["recommendation"].startswith("No clear primary key candidate")


def test_relationship_test_names_the_parent(spark):
    df = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "order_id int, customer_key int")
    tests = {r["column_name"]: r["tests"] for r in G.recommended_tests(P.profile(df, "t")).collect()}
    assert "relationships to dim_customer or fct_customer" in tests["customer_key"]
    assert tests["order_id"][0] == "unique"


def test_sample_is_repeatable(df):
    a, b = P.sample_fraction(df, 0.3, "id"), P.sample_fraction(df.repartition(7), 0.3, "id")
    assert sorted(r["id"] for r in a.collect()) == sorted(r["id"] for r in b.collect())
    assert 10 < a.count() < 60


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (
            str(i), "x" if i < 9 else str(i), "x" if i < 11 else str(i), f"{i % 28 + 1:02d}/03/2024", f"{i % 12 + 1}/{i % 12 + 1}/2024",
            f"2024-03-{i % 28 + 1:02d}", f"202403{i % 28 + 1:02d}", f"{i % 28 + 1}/3/24", f"{i % 28 + 1}.3.2024 10:30:00", "word",
        )
        for i in range(100)
    ]
    return spark.createDataFrame(
        rows, "whole string, num91 string, num89 string, day_first string, unsure string, iso string, compact string, short string, timed string, word string"
    )


def test_infer_types(raw):
    found = {r["column_name"]: (r["data_type"], r["pattern"], r["use_day_first"], r["ambiguous"]) for r in I.infer_types(raw).collect()}
    assert found["whole"][0] == "bigint" and found["num91"][0] == "decimal" and found["num89"][0] == "nvarchar"
    assert found["day_first"] == ("datetime2", "DD/M/YYYY", True, False)
    assert found["unsure"] == ("datetime2", "D/M/YYYY", False, True)
    assert found["iso"] == ("datetime2", "YYYY-MM-DD", False, False)
    assert found["short"][:3] == ("datetime2", "DD/M/YY", True)
    assert found["timed"][:3] == ("datetime2", "DD.M.YYYY", True)
    assert found["word"][0] == "nvarchar"
    # Eight digits are numbers first.
    assert found["compact"][:2] == ("bigint", "YYYYMMDD")


def test_apply_inferred(raw):
    typed = I.apply_inferred(raw, I.infer_types(raw))
    assert dict(typed.dtypes)["whole"] == "bigint" and dict(typed.dtypes)["num89"] == "string"
    row = typed.filter("whole = 20").collect()[0]
    assert row["day_first"] == datetime.datetime(2024, 3, 21)
    assert row["timed"] == datetime.datetime(2024, 3, 21, 10, 30)
    assert row["short"] == datetime.datetime(2024, 3, 21)
    assert row["num91"] == 20.0
    assert typed.filter("num91 is null").count() == 9


@pytest.mark.parametrize(
    "text, day_first, expected",
    [
        ("31/12/1999", True, datetime.datetime(1999, 12, 31)),
        ("31/12/1999", False, None),
        ("30/02/2024", True, None),
        ("29.02.2024", True, datetime.datetime(2024, 2, 29)),
        ("29-02-2023", True, None),
        ("1/2/69", False, datetime.datetime(1969, 1, 2)),
        ("1/2/68", False, datetime.datetime(2068, 1, 2)),
        ("2024/1/5", False, datetime.datetime(2024, 1, 5)),
        ("20240105", True, datetime.datetime(2024, 1, 5)),
        ("1/2.2024", True, None),
        ("2024", False, None),
        ("word", False, None),
    ],
)
def test_parse_date(spark, text, day_first, expected):
    assert spark.createDataFrame([(text,)], "v string").select(I.parse_date(F.col("v"), day_first)).collect()[0][0] == expected


@pytest.mark.parametrize(
    "text, status, names",
    [
        ("id,name,born\n1,Ann,1990\n2,Bob,1991\n3,Cy,1992\n", "present", ["id", "name", "born"]),
        ("\n  \nid,\"full, name\"\n1,\"x, y\"\n2,z\n", "present", ["id", "full, name"]),
        ("1,5,9\n2,6,8\n3,7,7\n", "missing", ["col_0", "col_1", "col_2"]),
        ("1,2,x\n3,4,y\n5,6,z\n", "missing", ["col_0", "col_1", "col_2"]),
        ("ab,x\ncd,yy\nef,z\n", "missing", ["col_0", "col_1"]),
        ("code\nAA1\nBB2\nCC3\n", "present", ["code"]),
        ("red\nlilac\nblue\n", "ambiguous", ["col_0"]),
        ("id,name\n", "ambiguous", ["col_0", "col_1"]),
        ("\n  \n", "missing", []),
    ],
)
def test_detect_headers(spark, tmp_path, text, status, names):
    (tmp_path / "a.csv").write_text(text)
    found = I.detect_headers(spark, str(tmp_path)).collect()
    assert [(r.status, r.names) for r in found] == [(status, names)]


def test_detect_headers_looks_at_all_lines_of_each_file(spark, tmp_path):
    (tmp_path / "late.csv").write_text("key\n" + "word\n" * 50 + "".join(f"{i}\n" for i in range(5000)))
    (tmp_path / "none.csv").write_text("key\n" + "1\n" * 50 + "".join(f"word{i}\n" for i in range(5000)))
    found = {r.file_path.rpartition("/")[2]: r.status for r in I.detect_headers(spark, str(tmp_path)).collect()}
    assert found == {"late.csv": "present", "none.csv": "ambiguous"}


def test_percentiles_against_brute_force(spark):
    import math
    import random

    rng = random.Random(5)
    values = [rng.choice([None, 1.0, 2.0, 2.0, 2.0, rng.random() * 10]) for _ in range(500)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "a double, b int").repartition(6)
    points = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {(r[0], r[1]): r[2] for r in R.percentiles(df, ["a", "b"], points).collect()}
    present = sorted(v for v in values if v is not None)
    for p in points:
        assert got[("a", p)] == present[max(math.ceil(p * len(present)), 1) - 1]
        assert got[("b", p)] == max(math.ceil(p * 500), 1) - 1
    rough = {(r[0], r[1]): r[2] for r in R.approximate_percentiles(df, ["b"], (0.5,)).collect()}
    assert abs(rough[("b", 0.5)] - 249) <= 1


@pytest.mark.parametrize("most, accuracy", [(1, 100), (5, 20), (50, 100), (10**6, 10_000)])
def test_percentiles_by_narrowing_brackets(spark, most, accuracy):
    import math
    import random

    rng = random.Random(most)
    hot = [rng.choice([3.0, 3.0, 4.0, -1.0, None, float("nan"), rng.gauss(0, 50)]) for _ in range(3000)]
    df = spark.createDataFrame([(v, i % 7, i * i) for i, v in enumerate(hot)], "a double, few int, wide long").repartition(5)
    points = (0.0, 0.01, 0.25, 0.5, 0.51, 0.99, 1.0)
    got = {(r[0], r[1]): r[2] for r in R.percentiles(df, ["a", "few", "wide"], points, most, accuracy).collect()}
    key = lambda v: (v != v, v if v == v else 0)
    for name, values in (("a", [v for v in hot if v is not None]), ("few", [i % 7 for i in range(3000)]), ("wide", [i * i for i in range(3000)])):
        ordered = sorted(map(float, values), key=key)
        for p in points:
            want = ordered[max(math.ceil(p * len(ordered)), 1) - 1]
            assert key(got[name, p]) == key(want), (name, p)
    empty = R.percentiles(df.where("false"), ["a"], points)
    assert empty.count() == 0 and R.percentiles(df.select(F.lit(None).cast("int").alias("n")), ["n"]).count() == 0


def test_signatures_find_links_of_unlike_names(spark):
    parent = spark.range(1000).select("id", (F.col("id") % 10).alias("small"))
    child = spark.range(5000).select(F.when(F.col("id") % 50 == 0, F.col("id") + 10**6).otherwise(F.col("id") * 7 % 1000).cast("int").alias("ref"), F.concat(F.lit("t"), "id").alias("text"))
    tables = {"a": parent, "b": child}
    found = {(r.child_table, r.child_column, r.parent_table, r.parent_column): r for r in R.inclusions(tables, 80.0, 50.0).collect()}
    assert set(found) == {("b", "ref", "a", "id")}
    r = found["b", "ref", "a", "id"]
    want = {7 * i % 1000 for i in range(5000) if i % 50}
    assert (r.distinct_keys, r.matched_keys, r.orphan_rows, r.parent_keys) == (len(want) + 100, len(want), 100, 1000)
    assert R.inclusions(tables, 99.9, 50.0).count() == 0
    # Small numbers lie in any counted key; only a low coverage lets them pass.
    loose = R.inclusions(tables, 80.0, 0.0).select("child_column", "parent_column").collect()
    assert {tuple(r) for r in loose} == {("ref", "id")}
    small = R.inclusion_candidates(R.key_signatures({"a": parent, "c": parent.select("small")}), 95.0, 50.0).collect()
    assert all(r.child_column != "small" or r.coverage_estimate >= 45 for r in small)
    assert R.inclusion_candidates(R.key_signatures({"a": parent.where("false"), "b": child}), 0.0).count() == 0


def test_links_by_signatures_are_those_of_the_profile(spark):
    tables = {
        "customer": spark.range(400).select(F.col("id").alias("c_custkey"), (F.col("id") % 7).alias("c_nationkey"), F.lit("x").alias("c_name")),
        "orders": spark.range(900).select(F.col("id").alias("o_orderkey"), (F.col("id") % 500).alias("o_custkey"), F.when(F.col("id") % 50 > 1, F.col("id")).alias("o_linekey")),
        "nation": spark.range(7).select(F.col("id").alias("n_nationkey"), F.col("id").cast("double").alias("n_custkey")),
        "line": spark.range(900).select((F.col("id") % 880).alias("l_orderkey"), F.col("id").alias("l_linekey")), "none": spark.range(0).select(F.col("id").alias("x_custkey")),
    }
    want = R.candidate_links(P.key_profile(tables, R.linkable_columns(tables)))
    assert R.named_links(tables) == want and ("orders", "o_custkey", "customer", "c_custkey") in want
    assert R.named_links({"a": spark.range(3)}) == []


def test_large_signatures_bound_what_is_counted(spark):
    a, b = spark.range(200_000), spark.range(100_000, 300_000).select(F.col("id").alias("other"))
    found = R.inclusion_candidates(R.key_signatures({"a": a, "b": b}), 0.0).collect()
    assert len(found) == 2 and all(abs(r.match_estimate - 50) < 5 for r in found)
    assert R.inclusion_candidates(R.key_signatures({"a": a, "b": b}), 90.0).count() == 0


def test_a_sample_of_exactly_n_rows_per_stratum(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), "id").repartition(6)
    ten, four = P.sample_rows(df, 10, "g"), P.sample_rows(df, 4, "g")
    sizes = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    assert {r.g: r["count"] for r in ten.groupBy("g").count().collect()} == {g: min(10, n) for g, n in sizes.items()}
    assert four.exceptAll(ten).isEmpty() and df.exceptAll(df.exceptAll(ten)).exceptAll(ten).isEmpty()
    assert sorted(map(tuple, P.sample_rows(df.repartition(2), 4, "g").collect()), key=str) == sorted(map(tuple, four.collect()), key=str)
    assert sorted(map(tuple, P.sample_rows(df, 4, "g", seed="other").collect()), key=str) != sorted(map(tuple, four.collect()), key=str)
    assert P.sample_rows(df, 25).count() == 25 and P.sample_rows(df.where("false"), 5, "g").count() == 0
    text = ten._jdf.queryExecution().executedPlan().toString()
    assert text.index("WindowGroupLimit") < text.index("Exchange")
    with pytest.raises(ValueError, match="share"):
        P.sample_rows(df, 5000)


def test_states_of_loads_merge_into_the_profile_of_all(spark, tmp_path):
    from layerkit.profiling import state as V

    path = str(tmp_path / "states")
    rows = lambda low, high: spark.range(low, high).select(
        "id", F.when(F.col("id") % 4 == 0, None).otherwise(F.concat(F.lit("v"), F.col("id") % 100)).alias("text"),
        (F.col("id") / 4).alias("amount"), F.timestamp_seconds("id").alias("at"), (F.col("id") % 2 == 0).alias("even"),
    )
    V.add_load(rows(0, 1000), "t", "one", path)
    V.add_load(rows(500, 3000), "t", "two", path)
    V.add_load(rows(500, 3000), "t", "two", path)  # again: replaced
    V.add_load(rows(0, 0), "t", "none", path)
    found = {r.column_name: r for r in V.merged_profile(V.load_states(spark, path)).collect()}
    assert [r.column_name for r in sorted(found.values(), key=lambda r: r.position)] == ["id", "text", "amount", "at", "even"]
    assert all(r.total_count == 3500 and r.loads == 3 for r in found.values())
    text, number = found["text"], found["id"]
    assert (text.non_null_count, text.null_count, text.min_text, text.max_length) == (2625, 875, "v1", 3)
    assert abs(text.distinct_estimate - 75) <= 2 and abs(number.distinct_estimate - 3000) <= 3000 * V.DISTINCT_ERROR
    assert (number.min_value, number.max_value) == (0.0, 2999.0) and number.avg_value == (sum(range(1000)) + sum(range(500, 3000))) / 3500
    assert (found["at"].data_type, found["at"].max_value, found["at"].avg_value) == ("datetime2", 2999.0, None)
    one = {r.column_name: r for r in V.merged_profile(V.load_states(spark, path).where("load = 'one'")).collect()}
    assert one["id"].total_count == 1000 and abs(one["id"].distinct_estimate - 1000) <= 30


@pytest.mark.parametrize("text", [
    "2024-01-31", "2024/1/3", "31/01/2024", "13/13/2024", "1.2.2024", "29.02.2023", "29.02.2024", "1/2/24", "20240131", "20241341", "12345678901234567890",
    "2024-01-31 10:00:00", "2024-01-31 25:00:00", "2024-01-31x", "1234", " 12", "12 ", "+5", "-.5", ".", "1e5", "1e", "12a", "abc", "", " ", "x1", "99999999999999999999", "01/02/2024 rest", "\t7", "007", "é1", "١٢", None,
])
def test_types_of_single_texts(spark, text):
    """The type of a column of one text is that of the conversions tried on it."""
    df = spark.createDataFrame([(text,)] * 3, "t string")
    found = I.infer_types(df).first()
    c = F.col("t")
    one = df.select(
        I.is_number(c).alias("number"), F.trim(c).try_cast("bigint").isNotNull().alias("whole"),
        I.parse_date(c, False).isNotNull().alias("month_first"), I.parse_date(c, True).isNotNull().alias("day_first"),
    ).first()
    want = "bigint" if one.whole else "decimal" if one.number else "datetime2" if one.month_first or one.day_first else "nvarchar"
    assert found.data_type == want and found.total == 3 and found.numbers == (3 if one.number else 0)
    assert found.dates == (3 if one.month_first or one.day_first else 0)


def test_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(1000.0,), (-900.0,)], "v double")
    row = R.outliers(df, ["v"]).collect()[0]
    assert (row["below"], row["above"]) == (1, 1)


def test_date_gaps_and_recency(spark):
    d = datetime.date
    df = spark.createDataFrame([(d(2024, 1, 1),), (d(2024, 1, 4),), (None,)], "on date")
    assert sorted(r[0] for r in R.date_gaps(df, "on").collect()) == [d(2024, 1, 2), d(2024, 1, 3)]
    assert R.date_gaps(df.filter("on is null"), "on").count() == 0
    assert tuple(R.recency(df, ["on"], d(2024, 1, 10)).collect()[0]) == ("on", d(2024, 1, 4), 6)


def test_relationships(spark):
    parent = spark.createDataFrame([(i,) for i in range(10)], "customer_id long")
    child = spark.createDataFrame([(i, i % 12) for i in range(24)] + [(24, None)], "order_id long, customer_id long")
    tables = {"customer": parent, "orders": child}
    links = R.candidate_links(P.key_profile(tables))
    assert links == R.candidate_links(P.profile_all(tables))
    assert links == [("orders", "customer_id", "customer", "customer_id")]
    row = R.relationships(tables, links).collect()[0]
    assert (row["distinct_keys"], row["matched_keys"], row["orphan_rows"]) == (12, 10, 4)


def test_profile_diff(spark, df):
    before, after = P.profile(df.select("id", "ten"), "a"), P.profile(df.filter("id < 50").select("id", F.lit("x").alias("new")), "b")
    got = {r["column_name"]: (r["change"], r["rows_delta"]) for r in P.profile_diff(before, after).collect()}
    assert got == {"id": ("kept", -50), "ten": ("removed", None), "new": ("added", None)}


def test_save_profile(spark, df, tmp_path):
    profiled = P.profile(df.select("ten"), "t")
    P.save_profile(profiled, str(tmp_path / "json"))
    P.save_profile(profiled, str(tmp_path / "csv"), "csv")
    assert spark.read.json(str(tmp_path / "json")).select("top_values.count").collect()[0][0] == [10] * 5
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_ends_of_whole_numbers_and_decimals_are_exact(spark):
    from decimal import Decimal

    df = spark.createDataFrame([(9007199254740993, Decimal("0.1000000000000000001")), (-9007199254740993, Decimal("12345678901234567.7")), (None, None)], "n bigint, d decimal(38,19)")
    found = {r.column_name: (r.min_exact, r.max_exact) for r in P.profile(df, "t").collect()}
    assert found == {"n": ("-9007199254740993", "9007199254740993"), "d": ("0.1000000000000000001", "12345678901234567.7000000000000000000")}


def test_linkable_columns_hold_both_ends_of_every_link(spark):
    tables = {
        "customer": spark.createDataFrame([(i, f"n{i}", 1.5) for i in range(20)], "c_custkey bigint, c_name string, c_score double"),
        "orders": spark.createDataFrame([(i, i % 20, "x") for i in range(40)], "o_id bigint, customer_id bigint, note string"),
        "returns": spark.createDataFrame([(i,) for i in range(9)], "r_custkey bigint"),
    }
    some = R.linkable_columns(tables)
    assert some == {"customer": ["c_custkey"], "orders": ["customer_id"], "returns": ["r_custkey"]}
    links = R.candidate_links(P.key_profile(tables, some))
    assert links == R.candidate_links(P.key_profile(tables)) and ("orders", "customer_id", "customer", "c_custkey") in links

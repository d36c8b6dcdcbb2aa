import pytest
from pyspark.sql import functions as F

from layerkit import quality as Q


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        [(1, "ACTIVE", 10.0, "5"), (2, "OLD", -1.0, "x"), (2, None, None, None), (None, "ACTIVE", 2.0, "7")],
        "id int, status string, amount double, code string",
    )


def passed(report):
    return {(r["check"], r["column_name"]): (r["passed"], r["observed"]) for r in report.collect()}


def test_all_kinds_of_check(df):
    report = Q.run_checks(
        df, "t",
        [
            Q.min_rows(4), Q.rows_between(5, 9), Q.row_drift(5, 0.2), Q.not_null("id"), Q.null_share("amount", 0.25),
            Q.unique("id"), Q.unique("id", "status"), Q.non_negative("amount"), Q.accepted("status", ["ACTIVE"]),
            Q.castable("code", "int"), Q.in_range("amount", 0, 10), Q.rule("old", "status", F.col("status") == "OLD"),
        ],
    )
    assert passed(report) == {
        ("min_rows", ""): (True, 4.0), ("rows_between", ""): (False, 4.0), ("row_drift", ""): (True, 4.0),
        ("not_null", "id"): (False, 1.0), ("null_share", "amount"): (True, 0.25), ("unique", "id"): (False, 1.0),
        ("unique", "id, status"): (True, 0.0), ("non_negative", "amount"): (False, 1.0),
        ("accepted", "status"): (False, 1.0), ("castable", "code"): (False, 1.0),
        ("in_range", "amount"): (False, 1.0), ("old", "status"): (False, 1.0),
    }


def test_row_checks_share_one_scan(df):
    report = Q.run_checks(df, "t", [Q.not_null("id"), Q.non_negative("amount"), Q.accepted("status", ["A"])])
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


def test_empty_tables(df):
    empty = df.filter("id > 99")
    got = passed(Q.run_checks(empty, "t", [Q.min_rows(), Q.null_share("id"), Q.unique("id"), Q.not_null("id")]))
    assert got == {
        ("min_rows", ""): (False, 0.0), ("null_share", "id"): (True, 0.0), ("unique", "id"): (True, 0.0),
        ("not_null", "id"): (True, 0.0),
    }


def test_drift_bounds_are_cut_to_whole_rows():
    assert Q.row_drift(11, 0.2).expected == "8..13"


def test_assert_checks_raises_with_every_failure(df):
    report = Q.run_checks(df, "t", [Q.not_null("id"), Q.non_negative("amount"), Q.min_rows()])
    with pytest.raises(Q.CheckFailed, match="not_null.*non_negative"):
        Q.assert_checks(report)
    Q.assert_checks(report.filter("passed"))


def test_unknown_columns_raise(df):
    with pytest.raises(ValueError, match="nothing"):
        Q.run_checks(df, "t", [Q.not_null("nothing")])


def test_referential_counts_rows_and_null_keys(spark, df):
    dim = spark.createDataFrame([(1,), (1,), (None,)], "key int")
    report = Q.referential(df, "t", [("id", dim, "key", "dim")])
    assert passed(report) == {("referential", "id"): (False, 3.0)}
    assert sorted(r["id"] or 0 for r in Q.orphans(df, "id", dim, "key").collect()) == [0, 2, 2]
    assert passed(Q.referential(df.filter("id = 1"), "t", [("id", dim, "key", "dim")]))[("referential", "id")] == (True, 0.0)


def test_types_include_missing_columns(df):
    got = passed(Q.has_types(df, "t", {"id": "Int32.Type", "amount": "decimal(18,2)", "gone": "type date"}))
    assert got == {("type", "id"): (True, 0.0), ("type", "amount"): (False, 1.0), ("type", "gone"): (False, 1.0)}


def test_failing_rows_and_duplicates(df):
    assert [r["id"] for r in Q.failing_rows(df, Q.non_negative("amount")).collect()] == [2]
    assert [tuple(r) for r in Q.duplicates(df, "id").collect()] == [(2, 2)]
    with pytest.raises(ValueError):
        Q.failing_rows(df, Q.min_rows())
    with pytest.raises(ValueError):
        Q.failing_rows(df, Q.unique("id"))


def test_totals_and_row_counts(df):
    assert passed(Q.totals_match(df, "amount", df.filter("id = 1"), "amount", "t")) == {("totals_match", "amount"): (False, 1.0)}
    assert passed(Q.totals_match(df, "amount", df, "amount", "t")) == {("totals_match", "amount"): (True, 0.0)}
    assert passed(Q.same_rows(df, df.limit(3), "t"))[("same_rows", "")] == (False, -1.0)
    assert passed(Q.grain_kept(df, df.select("id").distinct(), "id", "t"))[("grain_kept", "")] == (True, 0.0)


def test_status(spark):
    counts = spark.createDataFrame([("a", 0), ("b", 5), ("c", 50)], "table_name string, row_count long")
    got = dict((r["table_name"], r["status"]) for r in Q.table_status(counts, {"b": 10, "c": 10}).collect())
    assert got == {"a": "FAIL", "b": "WARN", "c": "PASS"}


def test_required_checks_by_layer():
    assert [c.name for c in Q.required_checks("silver", ["a", "b"])] == ["not_null", "not_null", "unique"]
    assert [c.label for c in Q.required_checks("dimension", ["a"], "k")] == ["k", "k", "a"]
    with pytest.raises(ValueError):
        Q.required_checks("nowhere")

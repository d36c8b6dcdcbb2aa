import pytest
from pyspark.sql import functions as F

from layerkit.functions.columns import col
from layerkit.layers import pipeline as L
from layerkit.quality import CheckFailed, assert_checks
from layerkit.sources.store import TableStore


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path))


def at(day):
    return F.lit(f"2024-01-0{day}").cast("timestamp")


STEPS = [
    ("rename", {"pairs": {"CustId": "customer_id", "CustName": "customer_name"}}),
    ("filter", {"condition": col("customer_id").isNotNull()}),
]


def load(spark, store, day, data):
    df = spark.createDataFrame(data, "CustId long, CustName string, city string")
    return L.load_bronze(store, "bronze_customers", df, f"load-{day}", "crm", at(day))


def test_raw_keeps_everything_and_counts(spark, store):
    load(spark, store, 1, [(1, " ann ", "Leeds"), (1, " ann ", "Leeds"), (None, "x", "y")])
    report = load(spark, store, 2, [(1, "Ann", "York")]).collect()
    assert [(r["check"], r["passed"], r["observed"]) for r in report] == [("min_rows", True, 4.0)]


@pytest.mark.parametrize("mode", ["refresh", "merge"])
def test_silver_takes_the_newest_row(spark, store, mode):
    load(spark, store, 1, [(1, "ann", "Leeds"), (2, "bob", "Hull"), (None, "x", "y")])
    build = lambda run: L.build_silver(
        store, "silver_customers", "bronze_customers", STEPS, "customer_id", mode=mode, load_id=run, built_at=at(9)
    )
    assert_checks(build("run-1"))
    load(spark, store, 2, [(1, "ann", "York"), (3, "cy", "Bath")])
    assert_checks(build("run-2"))
    silver = store.read("silver_customers")
    assert set(silver.columns) == {"customer_id", "customer_name", "city", "_silver_timestamp", "_load_id"}
    assert rows(silver.select("customer_id", "city")) == [(1, "York"), (2, "Hull"), (3, "Bath")]


def test_silver_reads_raw_tables_only(store):
    with pytest.raises(ValueError, match="raw"):
        L.build_silver(store, "silver_b", "silver_a", [], "id")


def test_dimension_merges_by_surrogate_key(spark, store):
    schema = "id long, name string, t int"
    first = L.build_dimension(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], schema), ["name"], "id", "t", "key")
    assert_checks(L.store_dimension(store, "dim_x", first, "key"))
    second = L.build_dimension(spark.createDataFrame([(2, "C", 5), (3, "d", 5)], schema), ["name"], "id", "t", "key")
    assert_checks(L.store_dimension(store, "dim_x", second, "key"))
    assert rows(store.read("dim_x").select("id", "name")) == [(1, "b"), (2, "C"), (3, "d")]


def test_fact_leaves_unmatched_keys_null_and_reports_them(spark, store):
    dim = L.build_dimension(spark.createDataFrame([(1, "a", 1)], "id long, name string, t int"), ["name"], "id", "t", "customer_key")
    L.store_dimension(store, "dim_customer", dim, "customer_key")
    sales = spark.createDataFrame([(1, 5.0), (9, 7.0)], "customer_id long, amount double")
    fact = L.build_fact(sales, [(store.read("dim_customer"), "customer_id", "id", "customer_key")], ["amount"])
    report = {r["check"]: r for r in L.store_fact(store, "fct_sales", fact, [("customer_key", "dim_customer")]).collect()}
    assert report["min_rows"]["passed"] and report["referential"]["observed"] == 1.0
    assert store.read("fct_sales").filter("customer_key is null").count() == 1


def test_a_run_stops_at_the_first_failed_stage(spark, store):
    done = []

    def stage(name, n):
        def run():
            done.append(name)
            store.write_silver(spark.range(n), f"silver_{name}")
            from layerkit.quality import min_rows, run_checks

            return run_checks(store.read(f"silver_{name}"), name, [min_rows(1)])

        return name, run

    report = L.run_layers(spark, [stage("a", 1), stage("b", 0), stage("c", 1)])
    assert done == ["a", "b"]
    assert [(r["stage"], r["passed"]) for r in report.orderBy("place").collect()] == [("a", True), ("b", False)]
    with pytest.raises(CheckFailed, match="b"):
        assert_checks(report)
    assert L.run_layers(spark, [stage("a", 0), stage("c", 1)], strict=False).count() == 2


def test_silver_merges_what_was_loaded_since(spark, store):
    load(spark, store, 1, [(1, "ann", "Leeds"), (2, "bob", "Hull")])
    build = lambda **more: L.build_silver(
        store, "silver_customers", "bronze_customers", STEPS, "customer_id", load_id="r", built_at=at(9), **more
    )
    assert_checks(build())
    load(spark, store, 2, [(2, "bob", "York")])
    assert_checks(build(mode="merge", since=at(1)))
    assert rows(store.read("silver_customers").select("customer_id", "city")) == [(1, "Leeds"), (2, "York")]
    with pytest.raises(ValueError, match="merge"):
        build(since=at(1))

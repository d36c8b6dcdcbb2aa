"""Plans that matter at scale: what is read, shuffled, and sent to Python."""

import os
import re

import pytest

from layerkit.plans import QUERIES, load_all

FOLDER = "/root/testdata/sf0.001"
load_all()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are missing")

# Scans that have to hand lines to Python.
USES_PYTHON = {"csv_after_preamble"}


@pytest.fixture
def plan(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")

    def get(name, broadcast=True):
        if not broadcast:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()

    yield get
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - USES_PYTHON))
def test_no_python_no_cross_join_no_whole_table_in_one_task(plan, name):
    text = plan(name, broadcast=False)
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|MapInArrow|FlatMapGroups", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # A single task may only take in partial aggregates, tops, or the sizes of ranges.
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = "\n".join(lines[i + 1 : i + 4])
            assert re.search(r"partial_|LocalLimit|HashAggregate|SortAggregate", below), f"{line}\n{below}"


def test_filters_and_columns_reach_the_scan(plan):
    text = plan("filter_predicates")
    assert "PushedFilters: [" in text and "GreaterThan(o_totalprice,100000.0)" in text
    text = plan("conditional_band")
    assert "ReadSchema: struct<o_totalprice:double>" in text
    assert "GreaterThanOrEqual(l_shipdate" in plan("daily_totals")


def test_partitions_are_pruned(plan):
    assert re.search(r"PartitionFilters: \[[^\]]*l_returnflag", plan("partitioned_write"))


def test_latest_rows_are_cut_before_the_shuffle(plan):
    text = plan("dedup_latest")
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_keys_are_counted_before_the_referential_join(plan):
    text = plan("dq_referential", broadcast=False)
    assert text.index("LeftAnti") < text.index("partial_count")


def test_rows_of_a_check_share_one_scan(plan):
    assert plan("dq_rules").count("FileScan") == 1


def test_top_rows_use_a_top_k(plan):
    assert "TakeOrderedAndProject" in plan("first_rows")


def test_nested_totals_are_aggregated_before_the_join(plan):
    text = plan("nested_join_totals", broadcast=False)
    assert text.index("Join") < text.index("HashAggregate")


def test_a_text_is_scanned_without_a_shuffle_by_key(plan):
    assert "hashpartitioning" not in plan("rule_scan") and "hashpartitioning" not in plan("redact_text")
    assert "hashpartitioning" not in plan("query_inventory")


def test_no_value_of_a_unique_or_long_column_is_shuffled(spark):
    from layerkit.profiling import profile as P

    df = QUERIES["profile_table"](spark, FOLDER)
    text = df._jdf.queryExecution().executedPlan().toString()
    read = set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*)", text)))) & {"o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"}
    assert read == {"o_orderstatus"}  # the others are known from the staged statistics
    parts, _ = P._parts({"documents": spark.read.parquet(f"{FOLDER}/documents.parquet")})
    moved = P._distinct_counts(parts)._jdf.queryExecution().optimizedPlan().toString()
    keys = re.search(r"Aggregate \[id#\d+, a#\d+L, b#\d+L\], \[id#\d+", moved)
    assert keys and "value" not in moved


@pytest.fixture
def small_tasks(spark):
    """Thresholds that make a few kilobytes count as a big partition."""
    changed = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1000",
    }
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_a_hot_key_is_split_in_joins(spark, small_tasks, how):
    from pyspark.sql import functions as F

    from layerkit.operators.joins import join_on, merge_queries
    from layerkit.session import configure

    configure(spark)
    # A third of all rows holds key 0.
    left = spark.range(0, 60000, 1, 16).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 30000, 1, 4).select((F.col("id") * 2).alias("rk"), F.lit("x").alias("v"))
    out = join_on(left, right, "k", "rk", how)
    rows = out.collect()
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    if how == "left":
        totals = merge_queries(left, right, "k", "rk", aggregate={"n": F.count("*")})
        assert totals.filter("n > 0").count() == sum(1 for i in range(60000) if i % 3 == 0 or i % 2 == 0)
        totals.collect()
        assert "skew=true" in totals._jdf.queryExecution().executedPlan().toString()
    matched = sum(1 for i in range(60000) if i % 3 == 0 or i % 2 == 0)
    assert len(rows) == {"inner": matched, "left": 60000, "left_anti": 60000 - matched}[how]


@pytest.mark.parametrize("how", ["left", "right", "outer", "expand", "expand_right"])
@pytest.mark.parametrize("hot", ["left", "right", "both"])
def test_a_hot_key_of_either_side_is_split(spark, small_tasks, monkeypatch, how, hot):
    from pyspark.sql import functions as F

    from layerkit.operators import joins as J
    from layerkit.session import configure

    configure(spark)
    monkeypatch.setattr(J, "HOT_BYTES", 0)
    many = spark.range(0, 60000, 1, 16).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 1, None).otherwise(F.col("id")).alias("mk"), F.col("id").alias("m"))
    one = spark.range(0, 30000, 1, 4).select((F.col("id") * 4).cast("int").alias("ok"), F.lit("x").alias("v"))
    if hot == "both":
        many = many.where("m < 900 or (m < 6000 and m % 3 > 0)")  # 300 rows of key 0, and 1,500 on the other side
        one = one.union(spark.range(1500).select(F.lit(0), F.col("id").cast("string")))
    left, right, lk, rk = (one, many, "ok", "mk") if hot == "right" else (many, one, "mk", "ok")
    kind = {"expand": "left", "expand_right": "right"}.get(how, how)
    if how.startswith("expand"):
        out = J.merge_queries(left, right, lk, rk, kind, expand={c: c for c in right.columns if c != rk})
    else:
        out = J.join_on(left, right, lk, rk, kind)
    plain = left.join(right, left[lk] == right[rk], kind).select(*[c for c in left.columns + right.columns if c in out.columns])
    assert out.exceptAll(plain).isEmpty() and plain.exceptAll(out).isEmpty()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 60000") == 1 and plan.count("Range (0, 30000") == 1 and plan.count("Join") == 1
    if "_at_" in plan:  # dealt by plan
        hot_rows = out.where(F.col("m") % 3 == 0).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(hot_rows) > 3 and max(r["count"] for r in hot_rows) < 0.6 * sum(r["count"] for r in hot_rows)
    else:  # the hot side is the one that Spark splits at run time
        assert (kind, hot) in (("left", "left"), ("right", "right"))
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_looked_for_in_large_sides_only(spark):
    from pyspark.sql import functions as F

    from layerkit.operators import joins as J

    left = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    assert sorted(J.hot_keys(left, F.col("k"), F.lit(True), share=0.3)) == [0, 1]
    assert J.hot_keys(left.where("false"), F.col("k"), F.lit(True)) == []
    out = J.join_on(left, left.select(F.col("k").alias("rk"), F.col("id").alias("other")), "k", "rk", "outer")
    assert "at_" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["rule_scan", "all_risks", "redact_text"])
def test_all_rules_share_one_scan(plan, name):
    assert plan(name).count("FileScan parquet") == 1


@pytest.mark.parametrize("name", ["join_full", "nested_join_expand"])
def test_an_outer_join_reads_each_side_once(plan, name):
    text = plan(name, broadcast=False)
    for table in ("orders", "customer"):
        assert text.count(f"{table}.parquet") <= 1, text
    assert text.count("SortMergeJoin") == 1


def test_a_hot_partition_value_is_written_by_several_tasks(spark, small_tasks, tmp_path):
    from pyspark.sql import functions as F

    from layerkit.sources.sinks import write_partitioned

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300000")
    df = spark.range(0, 60000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50 + 1).otherwise(0).alias("p"), F.sha1(F.col("id").cast("string")).alias("v"))
    write_partitioned(df, str(tmp_path / "t"), "p")
    files = {}
    for name in spark.read.parquet(str(tmp_path / "t")).inputFiles():
        part = re.search(r"p=(\d+)", name).group(1)
        files[part] = files.get(part, 0) + 1
    assert files["0"] > 3 and sum(n for p, n in files.items() if p != "0") <= 2 * len(files)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 60000

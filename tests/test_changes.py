import datetime

import pytest
from pyspark.sql import functions as F

from layerkit.sources import changes as M


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


SCHEMA = "id int, name string, modified int"


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "c", 5), (None, "n", 1)], SCHEMA)


def test_merge_updates_and_inserts(spark, target):
    source = spark.createDataFrame([(2, "B", 9), (4, "D", 1)], SCHEMA)
    assert rows(M.merge(target, source, "id")) == sorted(
        [(1, "a", 5), (2, "B", 9), (3, "c", 5), (None, "n", 1), (4, "D", 1)], key=repr
    )


def test_merge_only_newer(spark, target):
    source = spark.createDataFrame([(2, "B", 9), (3, "C", 4), (1, "A", None)], SCHEMA)
    out = M.merge(target, source, "id", update_when=lambda t, s: s("modified") > t("modified"), set={"name": "name"})
    assert rows(out.filter("id is not null")) == [(1, "a", 5), (2, "B", 5), (3, "c", 5)]


def test_null_keys_match_nothing(spark, target):
    source = spark.createDataFrame([(None, "x", 1), (None, "y", 1)], SCHEMA)
    out = M.merge(target, source, "id")
    assert sorted(r["name"] for r in out.filter("id is null").collect()) == ["n", "x", "y"]


def test_repeated_source_keys_raise(spark, target):
    source = spark.createDataFrame([(2, "B", 9), (2, "BB", 9)], SCHEMA)
    with pytest.raises(M.DuplicateKeys, match="id"):
        M.merge(target, source, "id")


def test_repeated_target_keys_are_all_updated(spark):
    target = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], SCHEMA)
    source = spark.createDataFrame([(1, "z", 3)], SCHEMA)
    assert rows(M.merge(target, source, "id")) == [(1, "z", 3), (1, "z", 3)]


def test_new_columns_raise_or_evolve(spark, target):
    source = spark.createDataFrame([(2, "B", 9, "x"), (9, "N", 1, "y")], SCHEMA + ", extra string")
    with pytest.raises(ValueError, match="extra"):
        M.merge(target, source, "id")
    out = M.merge(target, source, "id", evolve=True)
    assert {r["id"]: r["extra"] for r in out.collect()} == {1: None, 2: "x", 3: None, None: None, 9: "y"}


def test_merge_with_two_keys_and_a_set_value(spark):
    target = spark.createDataFrame([(1, "x", 0), (1, "y", 0)], "a int, b string, n int")
    source = spark.createDataFrame([(1, "y", 7), (2, "y", 8)], "a int, b string, n int")
    out = M.merge(target, source, ["a", "b"], set={"n": F.col("__s_n") + F.col("n")})
    assert rows(out) == [(1, "x", 0), (1, "y", 7), (2, "y", 8)]


def test_a_small_source_leaves_the_target_unshuffled(spark, tmp_path):
    spark.range(1000).select("id", F.lit("a").alias("v")).write.parquet(str(tmp_path / "t"))
    target = spark.read.parquet(str(tmp_path / "t"))
    source = spark.createDataFrame([(5, "b")], "id long, v string").limit(1)
    out = M.merge(target, source, "id", check=False)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and out.count() == 1000


def test_changes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1), (None, "n", 1)], "id int, v string, w int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 2), (4, "d", 1), (None, "n", 1)], "id int, v string, w int")
    assert rows(M.table_changes(old, new, "id")) == sorted([
        ("update_preimage", 2, "b", 1), ("update_postimage", 2, "b", 2), ("delete", 3, "c", 1), ("insert", 4, "d", 1),
    ])
    assert rows(M.table_changes(old, old, "id")) == []


def test_changes_over_a_new_column(spark):
    old = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "a", 5)], "id int, v string, w int")
    assert rows(M.table_changes(old, new, "id")) == [("update_postimage", 1, "a", 5), ("update_preimage", 1, "a", None)]
    with pytest.raises(M.DuplicateKeys):
        M.table_changes(old.union(old), new, "id")


def test_versions(spark):
    t = [F.lit(f"2024-0{i}-01").cast("timestamp_ntz") for i in (1, 2, 3)]
    first = M.start_versions(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string"), "id", ["v"], t[0])
    second = M.next_versions(first, spark.createDataFrame([(1, "A"), (2, "b"), (4, "d")], "id int, v string"), "id", ["v"], t[1])
    third = M.next_versions(
        second, spark.createDataFrame([(1, "a"), (4, "d")], "id int, v string"), "id", ["v"], t[2], close_missing=True
    )
    d = lambda m: datetime.datetime(2024, m, 1)
    assert rows(third.drop("version_key")) == sorted([
        (1, "a", d(1), d(2), False), (1, "A", d(2), d(3), False), (1, "a", d(3), None, True),
        (2, "b", d(1), d(3), False), (3, "c", d(1), d(3), False), (4, "d", d(2), None, True),
    ], key=repr)
    assert third.select("version_key").distinct().count() == 6
    assert third.filter("is_current").groupBy("id").count().filter("count > 1").count() == 0


def test_late_snapshots_cut_the_version_of_their_time(spark):
    t = {m: F.lit(f"2024-{m:02}-01").cast("timestamp_ntz") for m in range(1, 13)}
    d = lambda m: m and datetime.datetime(2024, m, 1)
    table = lambda data: spark.createDataFrame(data, "id int, v string")
    shown = lambda df: rows(df.drop("version_key"))
    want = lambda data: sorted([(i, v, d(a), d(b), b is None) for i, v, a, b in data], key=repr)
    dim = M.start_versions(table([(1, "a"), (2, "b")]), "id", ["v"], t[3])
    dim = M.next_versions(dim, table([(1, "A"), (2, "b"), (4, "d")]), "id", ["v"], t[9])
    # Between two versions, before the first, of a new key, and in agreement.
    dim = M.next_versions(dim, table([(1, "x"), (2, "b"), (3, "c")]), "id", ["v"], t[6])
    assert shown(dim) == want([(1, "a", 3, 6), (1, "x", 6, 9), (1, "A", 9, None), (2, "b", 3, None), (3, "c", 6, None), (4, "d", 9, None)])
    dim = M.next_versions(dim, table([(1, "old"), (2, "b"), (4, "d")]), "id", ["v"], t[1])
    assert shown(dim.filter("id < 3")) == want([(1, "old", 1, 3), (1, "a", 3, 6), (1, "x", 6, 9), (1, "A", 9, None), (2, "b", 1, 3), (2, "b", 3, None)])
    assert shown(dim.filter("id = 4")) == want([(4, "d", 1, 9), (4, "d", 9, None)])
    # Restated at the very time a version starts; missing in a late snapshot.
    dim = M.next_versions(dim, table([(1, "X"), (3, "c")]), "id", ["v"], t[6], close_missing=True)
    assert shown(dim.filter("id in (1, 4)")) == want([(1, "old", 1, 3), (1, "a", 3, 6), (1, "X", 6, 9), (1, "A", 9, None), (4, "d", 1, 6), (4, "d", 9, None)])
    assert shown(dim.filter("id = 2")) == [(2, "b", d(1), d(3), False), (2, "b", d(3), d(6), False)]
    overlaps = dim.alias("a").join(dim.alias("b"), F.expr("a.id = b.id and a.valid_from < b.valid_from and coalesce(a.valid_to, date '2030-01-01') > b.valid_from"))
    assert overlaps.isEmpty() and dim.filter("valid_to <= valid_from").isEmpty()
    assert dim.select("version_key").distinct().count() == dim.count()


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    M.write_buckets(spark.range(200).select("id", F.lit("old").alias("v")), path, "id", 16)
    before = {f for f in spark.read.parquet(path).inputFiles()}
    source = spark.createDataFrame([(5, "new"), (777, "added")], "id long, v string")
    rewritten = M.merge_buckets(spark, path, source, "id", 16)
    after = spark.read.parquet(path)
    assert 1 <= rewritten <= 2 and len(before & {f for f in after.inputFiles()}) == len(before) - rewritten
    want = [(i, "new" if i == 5 else "old") for i in range(200)] + [(777, "added")]
    assert rows(after.select("id", "v")) == sorted(want, key=repr)
    assert M.merge_buckets(spark, path, source.limit(0), "id", 16) == 0


def test_a_merged_table_rewrites_only_touched_buckets(spark, tmp_path):
    import os

    from layerkit.sources.store import TableStore

    store = TableStore(spark, str(tmp_path))
    table = lambda rows: spark.createDataFrame(rows, "k bigint, v string")
    assert M.merge_table(store, "silver_t", table([]), "k", buckets=8).count() == 0
    want = {i: "a" for i in range(100)}
    M.merge_table(store, "silver_t", table(list(want.items())), "k", notes={"by": "me"})
    for n, step in enumerate(([(5, "b")], [(5, "c"), (100, "new")], [], [(7, "d")])):
        out = M.merge_table(store, "silver_t", table(step), "k", notes={"by": f"step {n}"})
        want |= dict(step)
        assert dict(map(tuple, out.collect())) == want and store.notes("silver_t") == {"by": f"step {n}"}
        folder = f"{tmp_path}/silver_t/{store.state('silver_t').folder}"
        assert len([d for d in os.listdir(folder) if d.startswith("_bucket=")]) <= len(step)
    before = store.read("silver_t", store.version("silver_t") - 1)
    assert dict(map(tuple, before.collect())) == want | {7: "a"}
    store.write_silver(table([(1, "whole")]), "silver_t")
    assert store.bucket_count("silver_t") == 0 and store.read("silver_t").count() == 1
    out = M.merge_table(store, "silver_t", table([(2, "x")]), "k", buckets=4)
    assert dict(map(tuple, out.collect())) == {1: "whole", 2: "x"} and store.bucket_count("silver_t") == 4


def test_a_bucket_that_grows_too_big_splits_and_the_others_stay(spark, tmp_path):
    from layerkit.sources.store import TableStore

    store = TableStore(spark, str(tmp_path))
    table = lambda low, high: spark.range(low, high).select("id", F.concat(F.lit("value "), F.col("id").cast("string")).alias("v"))
    merge = lambda df: M.merge_table(store, "silver_t", df, "id", bucket_bytes=4000)
    merge(table(0, 3))
    counts, versions = [store.bucket_count("silver_t")], [store.state("silver_t")]
    for high in (1000, 3000, 9000):
        merge(table(0, high))
        counts.append(store.bucket_count("silver_t"))
    assert counts[0] == 1 and counts == sorted(counts) and counts[-1] > 8
    before = store.state("silver_t")
    merge(table(7, 8).withColumn("v", F.lit("changed")))
    after = store.state("silver_t")
    moved = {b for b in after.buckets if after.buckets[b] != before.buckets.get(b)}
    # The one bucket of the key, and what a split of one bucket adds.
    assert len(moved) <= 1 + 2 * (after.count - before.count) and after.count - before.count <= 1
    out = {r.id: r.v for r in store.read("silver_t").collect()}
    assert len(out) == 9000 and out[7] == "changed" and out[8] == "value 8"
    assert versions[0].count == 1


def test_splitting_moves_rows_of_split_buckets_only(spark):
    hashes = spark.range(4000).select(F.xxhash64("id").alias("h"))
    for count, grown in ((1, 2), (5, 6), (7, 8), (8, 9), (3, 17), (6, 6)):
        placed = hashes.select(M._address(F.col("h"), count).alias("a"), M._address(F.col("h"), grown).alias("b")).collect()
        assert {r.a for r in placed} == set(range(count)) and {r.b for r in placed} == set(range(grown))
        assert {r.a for r in placed if r.a != r.b} <= M.split_parents(count, grown)
        assert {r.a for r in placed if r.b >= count} == M.split_parents(count, grown)


def test_null_keys_spread_over_buckets_and_stay(spark, tmp_path):
    from layerkit.sources.store import TableStore

    store = TableStore(spark, str(tmp_path))
    rows_ = lambda mark: spark.range(300).select(F.lit(None).cast("long").alias("k"), F.concat(F.lit(mark), F.col("id").cast("string")).alias("v"), F.col("id").alias("n"))
    M.merge_table(store, "silver_t", rows_("a"), "k", buckets=4)
    # Fewer columns, in another order and of a narrower type.
    M.merge_table(store, "silver_t", rows_("b").select("v", F.col("k").cast("int").alias("k")), "k", check=False, bucket_bytes=1500)
    state = store.state("silver_t")
    assert state.count > 4 and len(state.buckets) == state.count
    out = store.read("silver_t")
    assert out.count() == 600 and out.where("n is null").count() == 300 and dict(out.dtypes)["k"] == "bigint"


def test_two_writers_of_one_version(spark, tmp_path):
    from layerkit.sources.store import ConcurrentWrite, TableStore

    store = TableStore(spark, str(tmp_path))
    store.write_silver(spark.range(3), "silver_t")
    seen = store.state("silver_t")
    M.merge_table(store, "silver_t", spark.range(2, 5), "id", before=seen)
    with pytest.raises(ConcurrentWrite):
        M.merge_table(store, "silver_t", spark.range(9, 10), "id", before=seen)
    assert sorted(r.id for r in store.read("silver_t").collect()) == [0, 1, 2, 3, 4] and store.version("silver_t") == 2
    # A marker that a lost writer left half written takes its number out of use.
    (tmp_path / "silver_t" / "_versions" / "3.json").write_text("{")
    assert store.version("silver_t") == 2
    store.write_silver(spark.range(1), "silver_t")
    assert store.version("silver_t") == 4 and store.read("silver_t").count() == 1

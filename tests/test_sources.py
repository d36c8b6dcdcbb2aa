import pytest
from pyspark.sql import functions as F, types as T

from layerkit.sources import readers as R, sinks as S
from layerkit.sources.store import TableStore
from layerkit.sources.workbooks import read_workbooks
from tests.workbook import write_workbook


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_csv_with_and_without_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,amount\n1,Ann,2.5\n2,,x\n")
    inferred = R.read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(inferred.dtypes) == {"id": "int", "name": "string", "amount": "string"}
    declared = R.read_csv(spark, str(tmp_path / "a.csv"), "id long, name string, amount double")
    assert rows(declared) == [(1, "Ann", 2.5), (2, None, None)]


@pytest.mark.parametrize("skip, block", [(0, None), (3, None), (3, 64)])
def test_csv_after_a_preamble_over_files_and_blocks(spark, tmp_path, skip, block):
    for name, start in (("a", 0), ("b", 1000)):
        body = "".join(f'{start + i},"v, {i}"\n' for i in range(200))
        (tmp_path / f"{name}.csv").write_text("".join(f"note {i}\n" for i in range(skip)) + "id,text\n" + body + "\n")
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block * 8))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = R.read_csv_skip(spark, str(tmp_path), skip, T.StructType.fromDDL("id int, text string"))
        got = rows(df)
        named = R.read_csv_skip(spark, str(tmp_path), skip)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted([(s + i, f"v, {i}") for s in (0, 1000) for i in range(200)], key=repr)
    assert named.columns == ["id", "text"]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_csv_shorter_than_its_preamble(spark, tmp_path):
    (tmp_path / "a.csv").write_text("only\n")
    with pytest.raises(ValueError, match="no line"):
        R.read_csv_skip(spark, str(tmp_path), 3)
    assert rows(R.read_csv_skip(spark, str(tmp_path), 3, T.StructType.fromDDL("a string"))) == []


def test_json_and_xml(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "tags": ["x"]}\n{"id": 2}\n')
    assert rows(R.read_json(spark, str(tmp_path / "a.json"), "id long, tags array<string>")) == [(1, ["x"]), (2, None)]
    (tmp_path / "a.xml").write_text("<all><item><id>1</id><name>Ann</name></item><item><id>2</id></item></all>")
    assert rows(R.read_xml(spark, str(tmp_path / "a.xml"), "item", "id long, name string")) == [(1, "Ann"), (2, None)]


def test_folder_by_pattern(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "street_1.csv").write_text("id\n1\n")
    (tmp_path / "sub" / "street_2.csv").write_text("id\n2\n")
    (tmp_path / "other.csv").write_text("id\n9\n")
    assert rows(R.read_folder(spark, str(tmp_path), "street*.csv", schema="id int")) == [(1,), (2,)]


def test_file_listing(spark, tmp_path):
    (tmp_path / "Sub").mkdir()
    (tmp_path / "Sub" / "A.CSV").write_text("abc")
    (tmp_path / "b.xlsx").write_text("")
    listed = R.list_files(spark, str(tmp_path)).filter(F.col("extension") == ".csv").collect()
    assert [(r["name"], r["size"]) for r in listed] == [("A.CSV", 3)]
    assert listed[0]["folder_path"].endswith("/Sub/")


def test_jdbc_needs_bounds_for_a_partitioned_read(spark):
    with pytest.raises(ValueError, match="bounds"):
        R.read_jdbc(spark, "jdbc:x", "t", partition_column="id")


def test_named_roots():
    sources = R.Sources({"crime": "s3a://bucket/crime/"})
    assert sources.path("crime", "/2024/a.csv") == "s3a://bucket/crime/2024/a.csv"
    with pytest.raises(KeyError, match="crime"):
        sources.path("tax", "a.csv")


def test_read_since_is_strict(spark):
    assert rows(R.read_since(spark.range(5), "id", 2)) == [(3,), (4,)]


def test_read_table(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert R.read_table(spark, "three").count() == 3


def test_workbooks(spark, tmp_path):
    head = [["Mid-2020 estimates"], [], [None, "note"], ["x"]]
    write_workbook(tmp_path / "a.xlsx", {
        "Contents": [["nothing"]],
        "Mid-2020 Persons": [*head, ["LSOA Code", "LA Name", "0-4"], ["E1", "Leeds", 10], ["E2", "inline:York & Co", None], [None, None, None]],
    })
    # The second file has its columns in another order, and one more.
    write_workbook(tmp_path / "b.xlsx", {
        "Mid-2020 Persons": [*head, ["0-4", "extra", "LSOA Code", "LA Name"], [7.5, True, "E3", "Hull"]],
    })
    df = read_workbooks(spark, str(tmp_path), "Mid-2020 Persons", skip=4)
    assert df.columns == ["LSOA Code", "LA Name", "0-4", "_source_file"]
    assert rows(df.drop("_source_file")) == [("E1", "Leeds", "10"), ("E2", "York & Co", None), ("E3", "Hull", "7.5")]
    assert df.select("_source_file").distinct().count() == 2
    chosen = read_workbooks(spark, str(tmp_path), "Mid-2020 Persons", 4, ["LA Name", "extra"], glob="b*")
    assert rows(chosen.drop("_source_file")) == [("Hull", "true")]


def test_a_missing_sheet_is_named(spark, tmp_path):
    write_workbook(tmp_path / "a.xlsx", {"One": [["a"], [1]]})
    with pytest.raises(Exception, match="no sheet"):
        read_workbooks(spark, str(tmp_path), "Two", columns=["a"]).collect()
    assert rows(read_workbooks(spark, str(tmp_path)).drop("_source_file")) == [("1",)]


def test_raw_tables_append_and_evolve(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    assert not store.exists("bronze_t")
    store.write_bronze(spark.createDataFrame([(1,)], "id int"), "bronze_t")
    store.write_bronze(spark.createDataFrame([(2, "x")], "id int, note string"), "bronze_t")
    assert store.exists("bronze_t")
    assert rows(store.read("bronze_t")) == [(1, None), (2, "x")]
    with pytest.raises(ValueError):
        store.write_bronze(spark.range(1), "silver_t")
    with pytest.raises(ValueError, match="raw"):
        store.read_bronze("silver_t")


def test_loads_are_known_without_opening_them(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    day = lambda n: F.lit(f"2024-01-0{n}").cast("timestamp")
    for n, frame in enumerate((spark.range(5), spark.range(5, 9).withColumn("note", F.lit("x")), spark.range(9, 12).select(F.col("id").cast("int").alias("id"))), 1):
        store.write_bronze(frame.withColumn("_load_timestamp", day(n)), "bronze_t", ends=("_load_timestamp", "id"))
    loads = store.loads("bronze_t")
    assert [x.order for x in loads] == [1, 2, 3] and store.raw_rows("bronze_t") == 12
    assert all({"_load_timestamp", "id"} == set(f["ends"]) for x in loads for f in x.files if f["rows"])
    raw = store.read_bronze("bronze_t")
    assert dict(raw.dtypes) == {"id": "bigint", "_load_timestamp": "timestamp", "note": "string"}
    assert rows(raw.select("id", "note")) == sorted([(i, "x" if 5 <= i < 9 else None) for i in range(12)], key=repr)
    late = store.read_since("bronze_t", "_load_timestamp", day(2))
    assert [r.id for r in late.orderBy("id").collect()] == [9, 10, 11]
    assert late.inputFiles() and all(loads[2].name in f for f in late.inputFiles())
    # Within a load single files are left out too.
    assert [r.id for r in store.read_since("bronze_t", "id", 10).collect()] == [11] and len(store.read_since("bronze_t", "id", 10).inputFiles()) == 1
    assert store.read_since("bronze_t", "id", 99).count() == 0
    # A column whose ends were not noted is filtered only.
    assert store.read_since("bronze_t", "note", "a").count() == 4
    with pytest.raises(ValueError, match="no such column"):
        store.read_since("bronze_t", "gone", 1)
    # Deleting the data of the first load does not keep later ones from being read.
    import shutil
    shutil.rmtree(tmp_path / "bronze_t" / loads[0].name)
    assert store.read_since("bronze_t", "_load_timestamp", day(1)).count() == 7


def test_a_load_is_replaced_by_its_repetition_and_types_must_agree(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write_bronze(spark.range(5), "bronze_t", "batch-1")
    store.write_bronze(spark.range(7), "bronze_t", "batch-1")
    assert store.read("bronze_t").count() == 7 and store.raw_rows("bronze_t") == 7
    with pytest.raises(ValueError, match="id is bigint in one load and string"):
        store.write_bronze(spark.createDataFrame([("a",)], "id string"), "bronze_t")
    store.write_bronze(spark.range(0), "bronze_t", "empty")
    assert store.read("bronze_t").count() == 7
    spark.range(2).write.parquet(str(tmp_path / "bronze_other" / "part"))
    assert store.read_bronze("bronze_other").count() == 2


def test_many_loads_are_listed_by_a_job(spark, tmp_path, monkeypatch):
    from layerkit.sources import store as module

    store = TableStore(spark, str(tmp_path))
    for n in range(4):
        store.write_bronze(spark.range(n, n + 1), "bronze_t")
    want = store.loads("bronze_t")
    monkeypatch.setattr(module, "_FEW_LOADS", 2)
    assert store.loads("bronze_t") == want and store.read("bronze_t").count() == 4


def test_a_table_can_be_rebuilt_from_itself_and_half_written_versions_do_not_count(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write_silver(spark.range(3), "silver_t")
    store.write_silver(store.read("silver_t").filter("id > 0"), "silver_t")
    assert rows(store.read("silver_t")) == [(1,), (2,)] and store.version("silver_t") == 2
    assert store.read("silver_t", 1).count() == 3
    (tmp_path / "silver_t" / "data-3-lost").mkdir()
    assert store.version("silver_t") == 2
    with pytest.raises(ValueError, match="no table"):
        store.read("silver_other")


def test_partitioned_write_and_reclustering_one_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(300).select("id", (F.col("id") % 3).cast("int").alias("p"))
    S.write_partitioned(df, path, "p")
    before = {f for f in spark.read.parquet(path).inputFiles()}
    S.recluster_partitions(spark, path, "p", F.col("p") == 1, "id", 2)
    after = {f for f in spark.read.parquet(path).inputFiles()}
    assert rows(spark.read.parquet(path)) == rows(df)
    assert {f for f in before & after if "p=1" in f} == set() and len(before & after) == len([f for f in before if "p=1" not in f])


def test_reclustering_gives_files_disjoint_ranges(spark, tmp_path):
    out = S.recluster(spark.range(1000).repartition(7), str(tmp_path / "t"), "id", 4)
    ranges = sorted(tuple(r) for r in out.groupBy(F.input_file_name()).agg(F.min("id"), F.max("id")).select("min(id)", "max(id)").collect())
    assert len(ranges) == 4 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_clustering_by_several_columns_narrows_files_in_each(spark, tmp_path):
    # Two columns without any relation, one of them text, a hot value, nulls.
    df = spark.range(20000).select(
        "id", F.pmod(F.xxhash64("id"), F.lit(1000)).alias("a"),
        F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 5 == 0, "hot").otherwise(F.sha1(F.col("id").cast("string"))).alias("b"),
    ).repartition(5)
    probes = {"a": 500, "b": "8"}
    plain = S.file_pruning(S.recluster(df, str(tmp_path / "plain"), ["a", "b"], 64), probes).collect()
    out = S.z_recluster(df, str(tmp_path / "z"), ["a", "b"], 64)
    both = S.file_pruning(out, probes).collect()
    assert {r.column_name: r.files for r in both} == {"a": 64, "b": 64} and all(r.rows == 20000 for r in both)
    assert all(r.excluded >= 40 for r in both) and min(r.excluded for r in plain) < 10
    assert df.exceptAll(out).isEmpty() and out.count() == 20000


def test_ranks_and_interleaved_bits(spark):
    from pyspark.sql import types as T

    bounds = list(range(10, 1000, 7))
    values = [None, -5, 9, 10, 11, 500, 993, 996, 997, 5000]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = [r[0] for r in df.select(S._rank(F.col("v"), bounds, T.IntegerType())).collect()]
    assert got == [0 if v is None else sum(b <= v for b in bounds) for v in values]
    assert df.select(S._rank(F.col("v"), [], T.IntegerType())).distinct().count() == 1
    pairs = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (3, 3), (5, 2)], "x int, y int")
    keys = [r[0] for r in pairs.select(S.interleaved([F.col("x"), F.col("y")], 3)).collect()]
    assert keys == [0, 2, 1, 15, 0b100110]
    with pytest.raises(ValueError, match="too many"):
        S.z_clustered(spark.range(1).select(*[F.lit(0).alias(f"c{i}") for i in range(31)]), [f"c{i}" for i in range(31)], 2)
    assert S.z_clustered(df.limit(0), ["v"], 3).count() == 0


def test_a_hot_value_is_spread_over_files(spark, tmp_path):
    out = S.recluster(spark.range(4000).select(F.lit(1).alias("k"), "id"), str(tmp_path / "t"), "k", 4)
    sizes = [r[0] for r in out.groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


def test_export(spark, tmp_path):
    S.export_csv(spark.range(10), str(tmp_path / "csv"), limit=4)
    assert R.read_csv(spark, str(tmp_path / "csv"), "id long").count() == 4


def test_files_with_other_headers_or_quoted_line_ends_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\nid,name\n1,Ann\n2,\"B, \"\"C\"\"\"\n3,5\" pipe\n")
    folder = str(tmp_path)
    assert sorted(r.name for r in R.read_csv_skip(spark, folder, 1).collect()) == ["5\" pipe", "Ann", "B, \"C\""]
    (tmp_path / "b.csv").write_text("x\nname,id\nBob,2\n")
    for schema in (None, T.StructType.fromDDL("id string, name string")):
        with pytest.raises(Exception, match="has the columns name, id"):
            R.read_csv_skip(spark, folder, 1, schema).collect()
    assert R.read_csv_skip(spark, folder, 1, T.StructType.fromDDL("p string, q string")).count() == 4
    (tmp_path / "b.csv").write_text("x\nid,name\n4,\"one\ntwo\"\n")
    with pytest.raises(Exception, match="spans lines"):
        R.read_csv_skip(spark, folder, 1).collect()

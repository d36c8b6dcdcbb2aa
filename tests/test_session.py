import pytest
from pyspark.sql import functions as F

from layerkit import session as S


def test_the_size_of_rows_in_memory_is_unknown(spark):
    assert S.estimated_bytes(spark.createDataFrame([(1,)], "a int")) is None


def test_tasks_follow_the_size(spark, tmp_path, monkeypatch):
    spark.range(10000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    assert S.task_count(df) == cores
    monkeypatch.setattr(S, "_TASK_BYTES", 100)
    assert S.task_count(df) > cores
    assert S.task_count(spark.createDataFrame([(1,)], "a int")) == int(spark.conf.get("spark.sql.shuffle.partitions"))


class Named:
    """A session whose configuration names a folder, or none."""

    def __init__(self, spark, master, folder=None):
        self._spark, self.folder = spark, folder
        self.conf = self
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})()

    def get(self, key, default=None):
        return self.folder or default


def test_the_shared_folder_is_the_one_the_session_names(spark):
    assert S.shared_dir(Named(spark, "yarn", "hdfs:///work/")) == "hdfs:///work"
    assert S.scratch_path(Named(spark, "yarn", "hdfs:///work"), "x").startswith("hdfs:///work/layerkit/app-1/x-")
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert S.shared_dir(spark) == named.rstrip("/")


def test_only_local_mode_may_use_a_folder_of_its_own(spark):
    local = Named(spark, "local[2]")
    assert "layerkit-" in S.shared_dir(local) and S.shared_dir(local) == S.shared_dir(local)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.shared_dir(Named(spark, "yarn"))


def test_staged_tables_can_be_cleared(spark):
    staged = S.stage(spark.range(3), "x")
    assert staged.count() == 3
    S.clear_scratch(spark)
    with pytest.raises(Exception):
        spark.read.parquet(staged.inputFiles()[0]).count()


def test_configure(spark):
    assert S.configure(spark).conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"


ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.fixture
def fresh(spark):
    """A session of its own settings."""
    return spark.newSession()


def test_a_task_takes_in_little_and_files_stay_large(fresh):
    fresh.conf.set(ADVISORY, "64m")
    S.configure(S.configure(fresh))
    assert fresh.conf.get(ADVISORY) == str(S.SHUFFLE_TASK_BYTES)
    with S.sized_files(fresh):
        assert fresh.conf.get(ADVISORY) == str(64 << 20)
    assert fresh.conf.get(ADVISORY) == str(S.SHUFFLE_TASK_BYTES)
    fresh.conf.set(ADVISORY, "2m")
    S.configure(fresh)
    with S.sized_files(fresh):
        assert fresh.conf.get(ADVISORY) == "2m"


def test_shuffles_start_with_partitions_by_the_input(fresh):
    fresh.conf.set("spark.sql.shuffle.partitions", "12")
    found = []
    for size in (0, 1 << 20, 10 << 20, 1 << 30, 6 << 30):
        S.fit_shuffles(fresh, size)
        found.append(int(fresh.conf.get(S._INITIAL)))
    assert found == [12, 12, 40, 200, 384]
    S.fit_shuffles(fresh, None)
    assert fresh.conf.get(S._INITIAL, None) is None


def test_a_task_groups_no_more_rows_when_there_are_more(fresh, tmp_path, monkeypatch):
    from layerkit.plans.base import Tables

    fresh.conf.set("spark.sql.shuffle.partitions", "2")
    fresh.conf.set(ADVISORY, "64m")
    # Thresholds that make some kilobytes count as much.
    fresh.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    fresh.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1000")
    monkeypatch.setattr(S, "SHUFFLE_TASK_BYTES", 64 << 10)
    monkeypatch.setattr(S, "_PARTITION_BYTES", 16 << 10)
    most = []
    for n in (20_000, 200_000):
        folder = str(tmp_path / str(n))
        fresh.range(0, n, 1, 2).select(F.xxhash64("id").alias("k")).write.parquet(f"{folder}/t.parquet")
        t = Tables(S.configure(fresh), folder)
        counts = t.t.groupBy("k").count().groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in counts) == n
        most.append(max(r["count"] for r in counts))
    assert most[1] < 2 * most[0]

import pytest
from layerkit.sources.store import TableStore
from layerkit.streaming import ingest as I

SCHEMA = "id int, t int, v string"


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.fixture
def place(spark, tmp_path):
    (tmp_path / "in").mkdir()
    return TableStore(spark, str(tmp_path / "store")), str(tmp_path / "in"), str(tmp_path / "checkpoint")


def drop(spark, folder, name, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def test_each_file_is_taken_once(spark, place):
    store, landing, checkpoint = place
    run = lambda load: I.ingest_bronze(
        store, I.stream_folder(spark, landing, SCHEMA), "bronze_t", load, checkpoint
    ).awaitTermination()
    drop(spark, landing, "a", [(1, 1, "a")])
    run("load-1")
    drop(spark, landing, "b", [(2, 1, "b")])
    run("load-2")
    run("load-3")
    assert rows(store.read("bronze_t").select("id", "_load_id")) == [(1, "load-1"), (2, "load-2")]
    store.write_bronze(spark.createDataFrame([(3, 1, "c")], SCHEMA), "bronze_t")
    assert store.read("bronze_t").count() == 3


def test_raw_tables_only(spark, place):
    store, landing, checkpoint = place
    with pytest.raises(ValueError):
        I.ingest_bronze(store, I.stream_folder(spark, landing, SCHEMA), "silver_t", "x", checkpoint)


def test_batches_merge_and_late_rows_do_not_win(spark, place):
    store, landing, checkpoint = place
    run = lambda: I.merge_silver(
        store, I.stream_folder(spark, landing, SCHEMA), "silver_t", "id", ["t"], checkpoint
    ).awaitTermination()
    drop(spark, landing, "a", [(1, 5, "five"), (2, 1, "one"), (1, 4, "four")])
    run()
    drop(spark, landing, "b", [(1, 3, "late"), (2, 2, "two"), (3, 1, "new")])
    run()
    want = [(1, "five"), (2, "two"), (3, "new")]
    assert rows(store.read("silver_t").select("id", "v")) == want
    version = store.version("silver_t")
    run()
    assert rows(store.read("silver_t").select("id", "v")) == want and store.version("silver_t") == version


def test_a_replayed_batch_changes_nothing(spark, place, monkeypatch):
    store, landing, checkpoint = place
    drop(spark, landing, "a", [(1, 5, "five")])
    applied = []
    write = store.write_buckets

    def failing(*args):  # the batch is written, then the stream fails before it notes so
        applied.append(args)
        write(*args)
        if len(applied) == 1:
            raise RuntimeError("lost")

    monkeypatch.setattr(store, "write_buckets", failing)
    run = lambda: I.merge_silver(
        store, I.stream_folder(spark, landing, SCHEMA), "silver_t", "id", ["t"], checkpoint
    ).awaitTermination()
    with pytest.raises(Exception):
        run()
    run()
    assert len(applied) == 1 and store.version("silver_t") == 1 and rows(store.read("silver_t")) == [(1, 5, "five")]


def test_two_streams_feed_one_table(spark, place, tmp_path):
    store, landing, _ = place
    for k, part in enumerate(("one", "two")):
        drop(spark, landing, part, [(10 * k + i, i, part) for i in range(10)])
        I.merge_silver(
            store, I.stream_folder(spark, f"{landing}/{part}", SCHEMA), "silver_t", "id", [("t", "desc")], str(tmp_path / part)
        ).awaitTermination()
    assert store.read("silver_t").count() == 20 and len(store.notes("silver_t")) == 2
    assert store.read("silver_t").columns == ["id", "t", "v"]

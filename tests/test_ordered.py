"""Operators over row order, against plain Python, at several partition counts."""

import random

import pytest
from pyspark.sql import functions as F

from layerkit.operators import ordered as O


def rows(df):
    return [tuple(r) for r in df.collect()]


def random_rows(seed, n=200):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        # A third of all rows belongs to one group; many values are null or tied.
        group = "hot" if rng.random() < 0.34 else rng.choice("abc")
        out.append((i, group, rng.choice([None, 1, 2, 3]), rng.choice([None, None, "x", "y", "z"]), rng.random()))
    return out


SCHEMA = "id int, g string, k int, v string, w double"


@pytest.fixture(params=[1, 4, 16])
def partitions(request):
    return request.param


def test_index_is_consecutive_and_follows_the_order(spark, partitions):
    data = random_rows(1)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = dict(rows(O.add_index(df, "idx", [("k", "desc"), "id"], 10, 2, partitions).select("id", "idx")))
    want = sorted(data, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert got == {r[0]: 10 + 2 * i for i, r in enumerate(want)}


def test_a_hot_order_value_is_spread(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), "id")
    placed, tag = O.range_sorted(df, [], "k", 8, "test")
    sizes = [r[0] for r in placed.groupBy(O.partition_no(tag)).count().select("count").collect()]
    assert len(sizes) > 4 and max(sizes) < 2000
    assert sorted(r[0] for r in O.add_index(df, "i", "k", partitions=8).select("i").collect()) == list(range(4000))


def test_index_of_an_empty_table(spark):
    assert rows(O.add_index(spark.range(0), "i", "id")) == []


@pytest.mark.parametrize("grouped", [False, True])
def test_fill_down_and_up(spark, partitions, grouped):
    data = random_rows(2)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    keys = ["g"] if grouped else []

    def brute(ordered):
        last, out = {}, {}
        for r in ordered:
            group = r[1] if grouped else None
            if r[3] is not None:
                last[group] = r[3]
            out[r[0]] = last.get(group)
        return out

    down = dict(rows(O.fill_down(df, "v", "id", keys, partitions).select("id", "v")))
    up = dict(rows(O.fill_up(df, "v", "id", keys, partitions).select("id", "v")))
    assert down == brute(data)
    assert up == brute(list(reversed(data)))


def test_fill_two_columns_over_a_group_of_nulls(spark):
    df = spark.createDataFrame(
        [(1, None, None, 1), (1, "a", None, 2), (1, None, 5, 3), (2, None, None, 1), (None, "n", 1, 1), (None, None, None, 2)],
        "g int, s string, n int, t int",
    )
    out = O.fill_down(df, ["s", "n"], "t", "g", partitions=3)
    assert out.columns == df.columns
    assert sorted(rows(out), key=repr) == sorted(
        [(1, None, None, 1), (1, "a", None, 2), (1, "a", 5, 3), (2, None, None, 1), (None, "n", 1, 1), (None, "n", 1, 2)],
        key=repr,
    )


@pytest.mark.parametrize("n", [0, 1, 7, 199, 200, 500])
def test_first_last_skip_remove(spark, n):
    data = random_rows(3)
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    order = ["k", ("id", "desc")]
    want = sorted(data, key=lambda r: (r[2] is not None, r[2] or 0, -r[0]))
    ids = [r[0] for r in want]

    def got(out):
        return sorted(r[0] for r in out.select("id").collect())

    assert got(O.first_n(df, n, order)) == sorted(ids[:n])
    assert got(O.last_n(df, n, order)) == sorted(ids[len(ids) - min(n, len(ids)):])
    assert got(O.skip(df, n, order)) == sorted(ids[n:])
    assert got(O.remove_last(df, n, order)) == sorted(ids[: max(0, len(ids) - n)])


def test_first_and_skip_by_position_and_in_groups(spark, monkeypatch, tmp_path):
    spark.createDataFrame(random_rows(4), SCHEMA).repartition(9).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    want_head = sorted(r[0] for r in O.first_n(df, 30, "id").select("id").collect())
    want_tail = sorted(r[0] for r in O.skip(df, 30, "id").select("id").collect())
    monkeypatch.setattr(O, "_SCAN_BYTES", 64)
    monkeypatch.setattr(O, "TOP_BYTES", 600 * O._row_bytes(df.withColumn("t", F.lit(1).cast("long"))))  # merged in groups
    grouped = O.first_n(df, 30, "id")
    assert "WindowGroupLimit" in grouped._jdf.queryExecution().toString()
    assert sorted(r[0] for r in grouped.select("id").collect()) == want_head
    assert sorted(r[0] for r in O.skip(df, 30, "id").select("id").collect()) == want_tail
    monkeypatch.setattr(O, "TOP_BYTES", 10)  # by position
    assert sorted(r[0] for r in O.first_n(df, 30, "id").select("id").collect()) == want_head
    assert sorted(r[0] for r in O.skip(df, 30, "id").select("id").collect()) == want_tail


def test_skip_removes_exactly_n_among_ties_and_copies(spark):
    df = spark.createDataFrame([(1, "a")] * 5 + [(0, "b")] * 2 + [(2, "c")], "k int, v string")
    assert sorted(rows(O.skip(df, 4, "k"))) == [(1, "a")] * 3 + [(2, "c")]
    assert sorted(rows(O.remove_last(df, 4, "k"))) == [(0, "b"), (0, "b"), (1, "a"), (1, "a")]
    assert rows(O.skip(df.filter("k > 9"), 2, "k")) == []


def test_order_is_required(spark):
    df = spark.range(3)
    for call in (lambda: O.first_n(df, 1, None), lambda: O.skip(df, 1, []), lambda: O.add_index(df, "i", None)):
        with pytest.raises(ValueError, match="order_by"):
            call()


def test_dedup_latest_keeps_the_newest_with_ties_broken(spark):
    df = spark.createDataFrame(
        [(1, 10, "old"), (1, 20, "b"), (1, 20, "a"), (2, None, "n"), (None, 1, "null key")], "k int, t int, v string"
    )
    out = O.dedup_latest(df, "k", ["t", "v"])
    assert sorted(rows(out), key=repr) == sorted([(1, 20, "b"), (2, None, "n"), (None, 1, "null key")], key=repr)


def test_sort_places_nulls_low(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "k int")
    assert [r[0] for r in rows(O.sort(df, "k"))] == [None, 1, 2]
    assert [r[0] for r in rows(O.sort(df, ("k", "desc")))] == [2, 1, None]


def test_top_values_breaks_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "bbaaacdef"] + [(None,)], "v string")
    assert rows(O.top_values(df, "v", 3)) == [("a", 3), ("b", 2), ("c", 1)]


def test_promote_headers(spark):
    df = spark.createDataFrame([(0, "id", "name"), (1, "7", "Ann"), (2, "8", "Bob")], "n int, a string, b string")
    out = O.promote_headers(df, "n")
    assert out.columns == ["0", "id", "name"] and sorted(rows(out)) == [(1, "7", "Ann"), (2, "8", "Bob")]


def test_a_tied_header_raises(spark):
    df = spark.createDataFrame([(1, "id"), (1, "a"), (2, "b")], "n int, a string").repartition(3)
    with pytest.raises(ValueError, match="first place"):
        O.promote_headers(df, "n")
    assert O.promote_headers(df.limit(0), "n").columns == ["n", "a"]


@pytest.mark.parametrize("most", [1 << 30, 4000, 10])
@pytest.mark.parametrize("n", [1, 100, 999])
def test_first_and_skip_are_complements_on_ties(spark, tmp_path, monkeypatch, most, n):
    spark.range(1000).select("id", (F.col("id") % 3).alias("k")).repartition(7).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    whole = sorted(rows(O.first_n(df, n, "k")))
    monkeypatch.setattr(O, "TOP_BYTES", most)
    first, rest = rows(O.first_n(df, n, "k")), rows(O.skip(df, n, "k"))
    assert sorted(first) == whole and len(first) == n
    assert sorted(first + rest) == sorted(rows(df))
    last, front = rows(O.last_n(df, n, "k")), rows(O.remove_last(df, n, "k"))
    assert len(last) == n and sorted(last + front) == sorted(rows(df))

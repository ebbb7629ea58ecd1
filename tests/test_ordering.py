import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from duotide.operators import features, ordering


def _rows(spark, n, series, seed, ties=False):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(series)]
    # the first series gets about half of all rows
    data = [
        (
            names[0] if rng.random() < 0.5 else rng.choice(names),
            rng.randrange(5) if ties else rng.randrange(10**6),
            i,
            rng.choice([None, float(rng.randrange(100))]),
        )
        for i in range(n)
    ]
    return spark.createDataFrame(data, "k string, t long, id long, v double")


def _same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    left = sorted(map(str, a.select(*cols).collect()))
    assert left == sorted(map(str, b.select(*cols).collect()))


@pytest.mark.parametrize("partitions", [1, 3, 16, 40])
@pytest.mark.parametrize("keys", [(), ("k",)])
def test_ranged_lags_equal_the_whole_window(spark, partitions, keys):
    df = _rows(spark, 60, 4, partitions)  # 40 ranges of 60 rows: many are shorter than the lag
    want = features.add_lags(df, 4, ["v"], keys, ("t", "id"), const=True, drop_warmup=False, nth="nth", layout="keyed")
    got = features.add_lags(
        df, 4, ["v"], keys, ("t", "id"), const=True, drop_warmup=False, nth="nth", layout="ranged", partitions=partitions
    )
    _same(got, want)


@pytest.mark.parametrize("partitions", [1, 5, 30])
@pytest.mark.parametrize("pad", ["forward", "first", "null"])
@pytest.mark.parametrize("n", [3, 7, 10])
def test_ranged_serie_equals_the_whole_window(spark, partitions, pad, n):
    df = _rows(spark, 50, 3, n)
    options = dict(n=n, pad=pad, keys=("k",), order=("t", "id"))
    want = features.serie(df, "v", layout="keyed", **options)
    got = features.serie(df, "v", layout="ranged", partitions=partitions, **options)
    _same(got, want)


@pytest.mark.parametrize("partitions", [1, 4, 25])
@pytest.mark.parametrize("keys", [(), ("k",)])
def test_rank_with_ties_across_ranges(spark, partitions, keys):
    df = _rows(spark, 80, 3, 7, ties=True)  # five times only: runs of equal times span ranges
    want = df.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy("t")))
    got = ordering.rank(df, keys, "t", ("id",), layout="ranged", partitions=partitions)
    _same(got, want)
    _same(ordering.rank(df, keys, "t", ("id",), layout="keyed"), want)


def test_rank_when_all_times_are_equal(spark):
    df = spark.range(100).select(F.lit("a").alias("k"), F.lit(1).alias("t"), "id")
    got = ordering.rank(df, ("k",), "t", ("id",), layout="ranged", partitions=9)
    assert {r["rank"] for r in got.collect()} == {1}


@pytest.mark.parametrize("partitions", [1, 6, 50])
def test_row_index_counts_every_row_once(spark, partitions):
    df = _rows(spark, 90, 4, 3)
    want = df.withColumn("row_index", F.row_number().over(Window.orderBy("t", "id")).cast("long"))
    _same(ordering.row_index(df, ("t", "id"), partitions=partitions), want)


def test_empty_input(spark):
    df = _rows(spark, 5, 1, 0).where("id < 0")
    for layout in ("keyed", "ranged"):
        assert features.add_lags(df, 2, ["v"], ("k",), ("t",), layout=layout).count() == 0
    assert ordering.row_index(df, ("t",)).count() == 0


def test_auto_splits_only_series_over_the_limit(spark):
    df = _rows(spark, 200, 4, 11)
    rows, longest = ordering.measure(df, ("k",))
    assert rows == 200 and 80 < longest < 200
    assert ordering.choose_layout(df, ("k",), "auto", longest) == ("keyed", None)
    assert ordering.choose_layout(df, ("k",), "auto", longest - 1) == ("ranged", 8)
    assert ordering.choose_layout(df, (), "auto", 10) == ("ranged", 20)
    with pytest.raises(ValueError):
        ordering.choose_layout(df, (), "other", 1)


@pytest.mark.parametrize("limit", [5, 40, 60, 10**6])
def test_auto_equals_keyed_whatever_the_limit(spark, limit):
    df = _rows(spark, 120, 4, 13).withColumn("k", F.when(F.col("k") != "s1", F.col("k")))  # one series has no name
    options = dict(n=4, keys=("k",), order=("t", "id"))
    want = features.serie(df, "v", layout="keyed", **options)
    _same(features.serie(df, "v", rows_per_task=limit, **options), want)


def test_many_large_keys_fall_back_to_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordering, "MAX_LARGE_KEYS", 1)
    df = _rows(spark, 120, 4, 13)
    want = features.add_lags(df, 2, ["v"], ("k",), ("t", "id"), layout="keyed")
    _same(features.add_lags(df, 2, ["v"], ("k",), ("t", "id"), rows_per_task=3), want)


def test_ranged_rows_of_one_series_reach_many_tasks(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.rand(1).alias("v"))
    ranges = ordering.lay_out(df, ["k", "t"], 8)
    sizes = [n for _, _, n in ranges.summary]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / 8


def test_rank_moves_rows_once_after_the_ranges(spark):
    rows = spark.range(600).selectExpr("CASE WHEN id % 3 > 0 THEN id % 2 END AS k", "CAST(id % 7 AS double) AS Date_time", "id")
    for keys in (["k"], []):
        ranked = ordering.rank(rows, keys, tie=["id"], layout="ranged", partitions=5)
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan
        want = rows.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy("Date_time")))
        assert sorted(map(str, ranked.collect())) == sorted(map(str, want.collect()))

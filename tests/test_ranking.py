import random

import pytest
from pyspark.sql import functions as F

from panelloom.functions.ranking import average_ranks, first_rows, positions, running_totals
from panelloom.operators import windows


@pytest.mark.parametrize("slices", ["1", "8"])
def test_running_totals_with_one_hot_key(spark, slices):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        rng = random.Random(7)
        rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}", i, rng.randrange(5)) for i in range(2000)]
        df = spark.createDataFrame(rows, "k string, i int, v int")
        out = running_totals(df, ["i"], {"s": F.col("v")}, ["k"])
        want, sums = {}, {}
        for k, i, v in rows:
            sums[k] = sums.get(k, 0) + v
            want[i] = sums[k]
        assert {r["i"]: r["s"] for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_positions_are_a_permutation_with_ties(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("v"))
    out = positions(df, [F.col("v").desc(), "id"]).orderBy("position").collect()
    assert [r["position"] for r in out] == list(range(1, 501))
    assert [(-r["v"], r["id"]) for r in out] == sorted((-r["v"], r["id"]) for r in out)


def test_average_ranks(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (5,)], "v int")
    ranks = sorted(r["r"] for r in average_ranks(df, "v", "r").collect())
    assert ranks == [1.0, 2.5, 2.5, 4.0]


def test_first_rows(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in first_rows(df, ["k"], ["o"]).collect()} == {("a", "y"), ("b", "z")}


def test_window_is_open_on_the_left(spark):
    rows = [(1, "k", 0), (2, "k", 30), (3, "k", 60), (4, "k", 60), (5, "k", 121)]
    df = spark.createDataFrame(rows, "id int, k string, s int").withColumn("t", F.timestamp_seconds("s"))
    out = windows.events_in_window(df, "k", "t", "id", 60)
    assert {r["id"]: r["recent"] for r in out.collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 1}

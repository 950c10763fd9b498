import random

import pytest
from pyspark.sql import functions as F

from panelloom.functions.ranking import running_totals
from panelloom.operators import sampling
from panelloom.operators.selection import first_per_group


def table(spark, seed, n=3000, hot=0.9):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < hot else rng.choice(["a", "b", None]), rng.randrange(500)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, s string, r bigint").repartition(5)


@pytest.mark.parametrize("seed", range(2))
def test_first_per_group_equals_sorting(spark, seed):
    rows, df = table(spark, seed)
    groups = {}
    for i, s, r in rows:
        groups.setdefault(s or "0", []).append((r, i))
    want = {g: random.Random(seed).choice([0, 1, len(v) // 3, len(v), len(v) + 5]) for g, v in groups.items()}
    asked = spark.createDataFrame(
        [(g, w, len(groups[g])) for g, w in want.items()], "__g string, __want bigint, __size bigint"
    )
    found = first_per_group(df, asked, F.coalesce("s", F.lit("0")), F.col("r"), "id", "t")
    assert found.columns == df.columns
    assert {r["id"] for r in found.collect()} == {i for g, v in groups.items() for _, i in sorted(v)[: want[g]]}


def test_samples_equal_sorting_and_move_no_rows(spark):
    rows, df = table(spark, 7)
    for n in (0, 1, 99, 2999, 5000):
        found = sampling.sample_n(df, n, "id", order=F.col("r"))
        assert {r["id"] for r in found.collect()} == {i for _, i in sorted((r, i) for i, _, r in rows)[:n]}
    stored = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    for drawn in (
        sampling.sample_n(stored, 20, "c_custkey"), sampling.stratified_sample(stored, 20, "c_mktsegment", "c_custkey"),
    ):
        plan = drawn._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" not in plan and "Sort [" not in plan.replace("WindowSort", "")
    assert sampling.sample_n(df.limit(0), 5, "id").count() == 0
    assert sampling.stratified_sample(df.limit(0), 5, "s", "id").count() == 0


def test_stratified_equals_sorting(spark):
    rows, df = table(spark, 3)
    groups = {}
    for i, s, r in rows:
        groups.setdefault(s or "0", []).append((r, i))
    for n in (2, 50, 1234, 2998):
        order = []
        for v in groups.values():
            quota = min(len(v), max(1, int(n * (len(v) / len(rows)))))
            order += [(at >= quota, *pair) for at, pair in enumerate(sorted(v))]
        found = sampling.stratified_sample(df, n, "s", "id", order=F.col("r"))
        assert {r["id"] for r in found.collect()} == {i for _, _, i in sorted(order)[:n]}


def test_cross_frame_in_parts(spark):
    names = spark.createDataFrame([(f"q{i:02}",) for i in range(40)], "question_id string")
    rows = spark.range(7).withColumnRenamed("id", "panelist_id")
    for most in (1 << 20, 100):
        found = sampling.cross_frame(rows, names, most)
        assert found.distinct().count() == found.count() == 280


def test_totals_of_keys_over_many_slices(spark):
    rows = [(i, "hot" if i % 10 else f"k{i % 50}") for i in range(1500)]
    df = spark.createDataFrame(rows, "id bigint, k string")
    out = running_totals(df, ["id"], {"at": F.lit(1)}, ["k"], totals={"at": "n"}).collect()
    groups = {}
    for i, k in rows:
        groups.setdefault(k, []).append(i)
    assert {(r["id"], r["at"], r["n"]) for r in out} == {
        (i, at, len(v)) for v in groups.values() for at, i in enumerate(sorted(v), 1)
    }

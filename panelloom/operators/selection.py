"""The first n rows of an order, per group, without sorting the table.

Ranks are cut into 4096 buckets and each of these into 4096 again. Two counts per (group,
bucket), which combine before the shuffle, tell the bucket in which a group's n-th row lies;
only its rows, one in 16 million of evenly spread ranks, are ranked. What comes out is the last
row of each group that belongs to it, so the rows themselves pass one filter and never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.session import one, small_side

BITS = 12


def _cut(counts: DataFrame, bucket: str, before: str) -> DataFrame:
    """The bucket of each group in which the row ``__want`` lies, and the rows ahead of it."""
    ahead = Window.partitionBy("__g").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("__ahead", F.col(before) + F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
        .filter((F.col("__ahead") < F.col("__want")) & (F.col("__ahead") + F.col("__n") >= F.col("__want")))
    )


def first_per_group(
    df: DataFrame, want: DataFrame, group: Column, rank: Column, key: str, label: str
) -> DataFrame:
    """Rows of ``df`` among the first ``__want`` of their group in the order of (rank, key).

    ``want`` has one row per group (``__g``, ``__want``, ``__size``, the rows of the group); groups
    without a row there give nothing. ``rank`` is a whole number that is never null; rows with equal
    rank and key count as one place, so ``key`` should tell rows apart.
    """
    keyed = df.select(group.alias("__g"), rank.alias("__r"), F.col(key).alias("__k"))
    low = one(keyed, F.min("__r").cast("double"))
    high = one(keyed, F.max("__r").cast("double"))
    share = (F.col("__r").cast("double") - low) / (high - low + 1)
    place = F.least(F.floor(share * (1 << 2 * BITS)), F.lit((1 << 2 * BITS) - 1)).cast("int")
    keyed = keyed.withColumn("__p", place)
    partial = small_side(want.filter("__want > 0 and __want < __size").select("__g", "__want"), f"{label}-want")

    coarse = F.shiftright("__p", BITS)
    counts = keyed.join(partial, "__g").groupBy("__g", "__want", coarse.alias("__b")).agg(
        F.count(F.lit(1)).alias("__n")
    ).withColumn("__zero", F.lit(0).cast("bigint"))
    cut = small_side(
        _cut(counts, "__b", "__zero").select("__g", "__want", "__b", F.col("__ahead").alias("__ahead1")),
        f"{label}-coarse",
    )
    inside = keyed.withColumn("__b", coarse).join(cut, ["__g", "__b"])
    counts = inside.groupBy("__g", "__want", "__ahead1", "__p").agg(F.count(F.lit(1)).alias("__n"))
    fine = small_side(_cut(counts, "__p", "__ahead1").select("__g", "__want", "__p", "__ahead"), f"{label}-fine")
    order = Window.partitionBy("__g").orderBy("__r", "__k")
    last = (
        keyed.join(fine, ["__g", "__p"])
        .withColumn("__at", F.row_number().over(order))
        .filter(F.col("__at") + F.col("__ahead") == F.col("__want"))
        .select("__g", F.struct("__r", "__k").alias("__last"))
    )
    whole = want.filter("__want >= __size and __want > 0").select("__g")
    bounds = small_side(
        last.unionByName(whole, allowMissingColumns=True), f"{label}-bounds"
    )
    marked = df.withColumn("__g", group).withColumn("__row", F.struct(rank.alias("__r"), F.col(key).alias("__k")))
    taken = marked.join(bounds, "__g").filter(F.col("__last").isNull() | (F.col("__row") <= F.col("__last")))
    return taken.select(*df.columns)

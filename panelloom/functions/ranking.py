"""Order-dependent values that stay spread out when one group holds most rows.

A plain window puts a whole group (or, without keys, the whole table) in one
task. Here rows are range-partitioned on ``keys + order``, so a hot group covers
many slices; each slice is summed, and only the carry into a slice is passed on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.session import materialize

_SLICE = "__slice"


def _column(item: str | Column) -> Column:
    return F.col(item) if isinstance(item, str) else item


def running_totals(
    df: DataFrame,
    order: Sequence[str | Column],
    sums: Mapping[str, Column],
    keys: Sequence[str] = (),
    label: str = "running",
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``sums`` in ``order`` within ``keys``; ``totals`` names those
    of them whose whole sum per key is added too, and how that is called.

    ``order`` must end in a tie-break that makes rows distinct. The slice number
    is stored with the rows, so later stages agree on it even after a retry. At
    most one group crosses each slice boundary, hence the carry table has at most two rows
    per slice and may be broadcast.
    """
    totals = totals or {}
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordering = [_column(o) for o in order]
    inputs = {name: f"__in_{name}" for name in sums}
    ranged = (
        df.select("*", *[expr.alias(inputs[name]) for name, expr in sums.items()])
        .repartitionByRange(slices, *[F.col(k) for k in keys], *ordering)
        .withColumn(_SLICE, F.spark_partition_id())
    )
    stored = materialize(ranged, label)

    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    carry = (
        stored.groupBy(*keys, _SLICE)
        .agg(*[F.sum(inputs[name]).alias(f"__part_{name}") for name in sums])
        .select(
            *keys,
            _SLICE,
            *[F.sum(f"__part_{name}").over(earlier).alias(f"__carry_{name}") for name in sums],
            *[
                (F.sum(f"__part_{name}").over(every) - F.col(f"__part_{name}")).alias(f"__other_{name}")
                for name in totals
            ],
            F.count(F.lit(1)).over(earlier).alias("__before"),
            F.count(F.lit(1)).over(every).alias("__slices"),
        )
        .filter("__slices > 1" if totals else "__before > 0")
        .drop("__before", "__slices")
    )
    whole = Window.partitionBy(*keys, _SLICE)
    inside = (
        Window.partitionBy(*keys, _SLICE)
        .orderBy(*ordering)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    matched = stored.alias("s").join(
        F.broadcast(carry.alias("c")),
        [F.col(f"s.{_SLICE}") == F.col(f"c.{_SLICE}")]
        + [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys],
        "left",
    )
    flat = matched.select(
        "s.*", *[f"c.__carry_{name}" for name in sums], *[f"c.__other_{name}" for name in totals]
    )
    return flat.select(
        *df.columns,
        *[
            (F.sum(inputs[name]).over(inside) + F.coalesce(F.col(f"__carry_{name}"), F.lit(0))).alias(
                name
            )
            for name in sums
        ],
        *[
            (F.sum(inputs[name]).over(whole) + F.coalesce(F.col(f"__other_{name}"), F.lit(0))).alias(out)
            for name, out in totals.items()
        ],
    )


def positions(
    df: DataFrame,
    order: Sequence[str | Column],
    keys: Sequence[str] = (),
    name: str = "position",
    label: str = "positions",
) -> DataFrame:
    """1-based row number in ``order`` (within ``keys``)."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, keys, label)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(picked).select(*keys, "row.*").select(*df.columns)


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key; Spark cuts each key to ``k`` before the shuffle."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(ranked)).filter(F.col(name) <= k)


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Rank with ties averaged: distinct values are counted first, so ties never
    meet in one task; then ``rank = below + (ties + 1) / 2``."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("ties"))
    ranked = running_totals(counts, [value], {"upto": F.col("ties")}, label="ranks").select(
        F.col(value).alias("__v"), (F.col("upto") - (F.col("ties") - 1) / 2).alias(out)
    )
    return df.join(ranked, df[value].eqNullSafe(ranked["__v"])).drop("__v")

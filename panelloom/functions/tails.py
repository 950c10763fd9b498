"""Tail probabilities as column expressions (no native ``erf`` needed)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelloom.functions.expr import LikeCol, col

_SERIES_TERMS = 60  # enough to full precision up to _SPLIT
_FRACTION_TERMS = 80  # and beyond it
_SPLIT = 2.0


def erfc(z: Column) -> Column:
    """Complementary error function for z >= 0.

    Small arguments: one minus the all-positive series. Large ones: the continued fraction, so
    that tails keep their digits down to the smallest numbers.
    """
    z = z.cast("double")
    near = F.least(z, F.lit(_SPLIT))
    square = near * near
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(_SERIES_TERMS)),
        F.struct(near.alias("term"), near.alias("total")),
        lambda acc, n: F.struct(
            (acc["term"] * 2 * square / (2 * n + 1)).alias("term"),
            (acc["total"] + acc["term"] * 2 * square / (2 * n + 1)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    small = 1 - F.lit(2 / math.sqrt(math.pi)) * F.exp(-square) * series
    far = F.greatest(z, F.lit(_SPLIT))
    fraction = F.aggregate(
        F.sequence(F.lit(_FRACTION_TERMS), F.lit(1)),
        F.lit(1.0),
        lambda acc, n: 1 + n / (2 * far * far) / acc,
    )
    large = F.exp(-far * far) / (far * F.lit(math.sqrt(math.pi)) * fraction)
    return F.when(z > _SPLIT, large).otherwise(F.greatest(small, F.lit(0.0)))


def chi2_sf(statistic: LikeCol, dof: LikeCol) -> Column:
    """P(X > statistic) for a chi-square variable with whole degrees of freedom.

    Even dof: a finite Poisson sum. Odd dof: ``erfc`` plus a finite sum. Terms are carried as
    logarithms, since the first ones of a large statistic are too small for a double.
    """
    x, k = col(statistic).cast("double") / 2, col(dof).cast("int")
    log_x = F.ln(F.greatest(x, F.lit(1e-300)))

    def finite(first: Column, start: float, count: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
            F.struct(first.alias("log"), F.exp(first).alias("total"), F.lit(start).alias("at")),
            lambda acc, n: F.struct(
                (acc["log"] + log_x - F.ln(acc["at"] + 1)).alias("log"),
                F.when(n < count, acc["total"] + F.exp(acc["log"] + log_x - F.ln(acc["at"] + 1)))
                .otherwise(acc["total"]).alias("total"),
                (acc["at"] + 1).alias("at"),
            ),
            lambda acc: acc["total"],
        )

    even = finite(-x, 0.0, (k / 2).cast("int"))
    half = -x + log_x / 2 + F.lit(math.log(2 / math.sqrt(math.pi)))
    odd_sum = finite(half, 0.5, ((k - 1) / 2).cast("int"))
    odd = erfc(F.sqrt(x)) + F.when(k > 1, odd_sum).otherwise(0.0)
    tail = F.when(x <= 0, F.lit(1.0)).when(k % 2 == 0, even).otherwise(odd)
    return F.least(tail, F.lit(1.0))


def kolmogorov_sf(x: LikeCol) -> Column:
    """Limiting two-sided Kolmogorov tail ``2 * sum (-1)^(j-1) exp(-2 j^2 x^2)``."""
    v = col(x).cast("double")
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, j: acc
        + F.when(j % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(-2.0 * j * j * v * v),
    )
    return F.when(v < 0.05, F.lit(1.0)).otherwise(
        F.least(F.greatest(2 * total, F.lit(0.0)), F.lit(1.0))
    )

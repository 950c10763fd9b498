"""Behavior features, demographic vectors and token sequences."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom import schemas
from panelloom.functions import expr
from panelloom.functions.ranking import positions, top_rows
from panelloom.session import materialize, n_rows, one

MAX_CATEGORIES = 1_000
PAD, OOV, FIRST_TOKEN = 0, 1, 2
MAX_LENGTH = 128


def category_levels(purchases: DataFrame) -> list[str]:
    """Sorted category names; a feature layout must be known before the job is planned."""
    rows = purchases.select("product_category").distinct().limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories; pass the levels explicitly")
    return sorted(r[0] for r in rows if r[0] is not None)


def feature_names(categories: Sequence[str]) -> list[str]:
    return [
        *[f"cat_{c}" for c in categories], *[f"bin_{b}" for b in schemas.PRICE_TIERS],
        "promo_rate", "log_rows", "mean_basket",
    ]


def behavior_features(
    purchases: DataFrame, panelists: DataFrame, categories: Sequence[str] | None = None
) -> DataFrame:
    """Spend shares by category, row shares by price bin, promotion rate, ln(1+rows)
    and mean basket per household; zeros without purchases.

    One aggregation with conditional sums: no pivot job per block.
    """
    levels = list(categories) if categories is not None else category_levels(purchases)
    bin_of = expr.price_bin("unit_price")
    sums = purchases.groupBy("panelist_id").agg(
        n_rows().alias("rows"),
        F.sum("total_value").alias("spend"),
        F.avg(F.col("is_promotion").cast("int")).alias("promo_rate"),
        F.avg("total_value").alias("mean_basket"),
        *[
            F.sum(F.when(F.col("product_category") == c, F.col("total_value")).otherwise(0.0)).alias(
                f"cat_{c}"
            )
            for c in levels
        ],
        *[F.count_if(bin_of == b).alias(f"bin_{b}") for b in schemas.PRICE_TIERS],
    )
    divisor = F.when(F.col("spend") == 0, 1.0).otherwise(F.col("spend"))
    shares = sums.select(
        "panelist_id",
        *[(F.col(f"cat_{c}") / divisor).alias(f"cat_{c}") for c in levels],
        *[(F.col(f"bin_{b}") / F.col("rows")).alias(f"bin_{b}") for b in schemas.PRICE_TIERS],
        "promo_rate", F.log1p("rows").alias("log_rows"), "mean_basket",
    )
    return panelists.select("panelist_id").join(shares, "panelist_id", "left").na.fill(0.0)


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit *population* deviation; a constant column only centers. ``df`` is stored, since
    its moments are needed before its rows."""
    df = materialize(df, "standardize")
    stats = one(
        df,
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        ),
    )
    rest = [c for c in df.columns if c not in columns]
    return df.withColumn("__stats", stats).select(
        *rest,
        *[
            (
                (F.col(c) - F.col("__stats")[f"m_{c}"])
                / F.when(F.col("__stats")[f"s_{c}"] == 0, 1.0).otherwise(F.col("__stats")[f"s_{c}"])
            ).alias(c)
            for c in columns
        ],
    )


def as_vector(df: DataFrame, columns: Sequence[str], key: str = "panelist_id") -> DataFrame:
    return df.select(F.col(key).alias("id"), F.array(*columns).alias("vector"))


def random_projection(df: DataFrame, size: int, d: int = 128, seed: int = 42) -> DataFrame:
    """Project ``vector`` of length ``size`` to ``d`` dimensions by a seeded Gaussian
    matrix over the square root of ``size``."""
    matrix = np.random.default_rng(seed).standard_normal((size, d)).astype(np.float32) / np.float32(
        math.sqrt(size)
    )

    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        stacked = np.stack(vectors.to_numpy()).astype(np.float32) if len(vectors) else np.zeros((0, size))
        return pd.Series(list((stacked @ matrix).astype(float)))

    return df.withColumn("vector", project("vector"))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(df: DataFrame, column: str = "vector") -> DataFrame:
    """Unit length; a zero vector stays zero."""
    return (
        df.withColumn("__n", l2_norm(F.col(column)))
        .withColumn("__n", F.when(F.col("__n") == 0, 1.0).otherwise(F.col("__n")))
        .withColumn(column, F.transform(column, lambda x: x / F.col("__n")))
        .drop("__n")
    )


def encode_demographics(panelists: DataFrame) -> DataFrame:
    """20 dimensions: four ordinals in [0, 1] (unknown 0.5), children, region and
    employment indicators."""
    def ordinal(name: str, scale: Sequence[str]) -> Column:
        place = expr.scale_position(name, scale)
        return F.coalesce(place / F.lit(float(len(scale) - 1)), F.lit(0.5))

    def flag(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False)).cast("double")

    return panelists.select(
        F.col("panelist_id").alias("id"),
        F.array(
            ordinal("age_group", schemas.AGE_GROUPS),
            ordinal("income_group", schemas.INCOME_GROUPS),
            ordinal("household_size", schemas.HOUSEHOLD_SIZES),
            ordinal("education_level", schemas.EDUCATION_LEVELS),
            flag(F.col("has_children")),
            *[flag(F.col("region") == r) for r in schemas.REGIONS],
            *[flag(F.col("employment_status") == e) for e in schemas.EMPLOYMENT],
        ).alias("vector"),
    )


def conditioning(embeddings: DataFrame, demographics: DataFrame) -> DataFrame:
    """Embedding and demographic vector end to end; a household without embedding
    is an error."""
    joined = demographics.select("id", F.col("vector").alias("d")).join(
        embeddings.select("id", F.col("vector").alias("e")), "id", "left"
    )
    missing = F.raise_error(F.concat(F.lit("no embedding for "), F.col("id").cast("string")))
    return joined.select(
        "id",
        F.when(F.col("e").isNull(), missing.cast("array<double>"))
        .otherwise(F.concat("e", "d"))
        .alias("vector"),
    )


def fit_vocabulary(tokens: DataFrame) -> DataFrame:
    """Sorted distinct tokens with ids from 2."""
    distinct = tokens.select("token").filter("token IS NOT NULL").distinct()
    return positions(distinct, ["token"], label="vocabulary").select(
        "token", (F.col("position") - 1 + FIRST_TOKEN).cast("int").alias("token_id")
    )


def encode_sequences(
    tokens: DataFrame, vocabulary: DataFrame, order: Sequence[str], length: int = MAX_LENGTH
) -> DataFrame:
    """The ``length`` newest token ids per household, oldest first, zero-padded right.

    Each household is cut to its newest events before the shuffle.
    """
    newest = top_rows(
        tokens.select("panelist_id", "token", *order), ["panelist_id"],
        [F.col(c).desc() for c in order], length,
    )
    known = newest.join(vocabulary, "token", "left").withColumn(
        "token_id", F.coalesce("token_id", F.lit(OOV))
    )
    entry = F.struct(F.col("rank"), "token_id")
    return known.groupBy("panelist_id").agg(
        F.sort_array(F.collect_list(entry), asc=False).alias("entries")
    ).select(
        "panelist_id",
        F.concat(
            F.transform("entries", lambda e: e["token_id"]),
            F.array_repeat(F.lit(PAD), (F.lit(length) - F.size("entries")).cast("int")),
        ).alias("token_ids"),
    )


def centroids(df: DataFrame, group: str, column: str = "vector") -> DataFrame:
    """Mean vector per group, combined before the shuffle."""
    means = df.groupBy(group).agg(Summarizer.mean(array_to_vector(F.col(column))).alias("m"))
    return means.select(group, vector_to_array("m").alias("centroid"))

"""Panel, purchase and survey exploration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom import schemas
from panelloom.functions import expr
from panelloom.functions.ranking import positions
from panelloom.session import materialize, n_rows, one



def _share(n: Column, total: Column, digits: int = 4) -> Column:
    return F.bround(n / F.greatest(total, F.lit(1)), digits)


def ordered_distribution(df: DataFrame, column: str, scale: Sequence[str] = ()) -> DataFrame:
    """Counts and shares by value in scale order, then by falling count.

    Nulls stay in the denominator but are not listed.
    """
    every = df.groupBy(F.col(column).cast("string").alias("label")).agg(n_rows().alias("count"))
    total = one(every, F.sum("count"))
    counts = every.filter("label IS NOT NULL")
    place = expr.scale_position("label", scale) if scale else F.lit(None).cast("int")
    order = [F.col("place").asc_nulls_last(), F.col("count").desc(), F.col("label")]
    listed = counts.select("label", "count", _share(F.col("count"), total).alias("share"), place.alias("place"))
    return positions(listed, order, label="distribution").select(
        "label", "count", "share", F.col("position").cast("int").alias("position")
    )


def panel_kpis(panelists: DataFrame) -> DataFrame:
    size = (
        F.when(F.col("household_size") == "1", 1.0)
        .when(F.col("household_size") == "2", 2.0)
        .when(F.col("household_size") == "3-4", 3.5)
        .when(F.col("household_size") == "5+", 5.5)
        .otherwise(2.0)
    )
    return panelists.agg(
        n_rows().alias("total_households"),
        F.floor(F.sum(size)).cast("bigint").alias("total_members"),
        F.bround(F.avg(size), 2).alias("avg_household_size"),
        F.count_distinct("region").alias("regions_covered"),
    )


def crosstab(
    df: DataFrame, rows: str, cols: str, row_scale: Sequence[str], col_scale: Sequence[str]
) -> DataFrame:
    """Long contingency cells over the scale levels that occur, zero-filled."""
    joint = df.groupBy(F.col(rows).alias("row"), F.col(cols).alias("col")).agg(n_rows().alias("n"))
    known = joint.filter("row IS NOT NULL AND col IS NOT NULL")
    cells = known.filter(F.col("row").isin(list(row_scale)) & F.col("col").isin(list(col_scale)))
    levels = one(known.filter(F.col("col").isin(list(col_scale))), F.collect_set("col"))
    frame = known.filter(F.col("row").isin(list(row_scale))).select("row").distinct().select(
        "row", F.explode(levels).alias("col")
    )
    return frame.join(cells, ["row", "col"], "left").select(
        "row", "col", F.coalesce("n", F.lit(0)).alias("n")
    )


def crosstab_wide(df: DataFrame, rows: str, cols: str, col_scale: Sequence[str]) -> DataFrame:
    """The same as a pivot with fixed levels."""
    return df.groupBy(rows).pivot(cols, list(col_scale)).agg(n_rows()).na.fill(0)


def purchase_kpis(purchases: DataFrame) -> DataFrame:
    return purchases.agg(
        n_rows().alias("total_transactions"),
        F.bround(F.avg("total_value"), 2).alias("avg_basket_value"),
        F.bround(F.avg("unit_price"), 2).alias("avg_unit_price"),
        F.bround(F.avg(F.col("is_promotion").cast("int")), 4).alias("promotion_rate"),
    )


def penetration(purchases: DataFrame, top: int = 10) -> DataFrame:
    """Distinct buyers per category over distinct purchasing households."""
    # (household, category) pairs are made unique and stored once; both counts use that.
    pairs = materialize(purchases.select("panelist_id", "product_category").distinct(), "buyers")
    households = one(pairs, F.count_distinct("panelist_id"))
    return (
        pairs.filter(F.col("product_category").isNotNull() & F.col("panelist_id").isNotNull())
        .groupBy(F.col("product_category").alias("label"))
        .agg(n_rows().alias("buyers"))
        .orderBy(F.col("buyers").desc(), "label")
        .limit(top)
        .select("label", "buyers", _share(F.col("buyers"), households).alias("share"))
    )


def tier_counts(purchases: DataFrame) -> DataFrame:
    tiers = purchases.select(expr.price_tier("unit_price").alias("tier"))
    return ordered_distribution(tiers, "tier", schemas.PRICE_TIERS)


def promo_by_archetype(purchases: DataFrame, panelists: DataFrame) -> DataFrame:
    joined = purchases.select("panelist_id", "is_promotion").join(
        panelists.select("panelist_id", "behavioral_archetype"), "panelist_id"
    )
    return joined.groupBy("behavioral_archetype").agg(
        F.bround(F.avg(F.col("is_promotion").cast("int")), 4).alias("share")
    ).select(expr.humanize("behavioral_archetype").alias("label"), "share")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, the last one closed; a constant column widens by half a unit."""
    x = F.col(column).cast("double")
    span = one(df, F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")))
    flat = span["lo"] == span["hi"]
    lo = F.when(flat, span["lo"] - 0.5).otherwise(span["lo"])
    width = F.when(flat, F.lit(1.0)).otherwise(span["hi"] - span["lo"]) / bins
    counts = (
        df.filter(x.isNotNull())
        .select(F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(n_rows().alias("n"))
    )
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select(
        "bin",
        F.bround(lo + F.col("bin") * width, 1).alias("lower"),
        F.bround(lo + (F.col("bin") + 1) * width, 1).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def purchase_frequency(purchases: DataFrame, bins: int = 10) -> DataFrame:
    counts = purchases.filter(F.col("panelist_id").isNotNull()).groupBy("panelist_id").agg(
        n_rows().alias("frequency")
    )
    return histogram(counts, "frequency", bins)


def monthly_volume(purchases: DataFrame) -> DataFrame:
    """Rows per month; rows without a valid date form their own bucket."""
    month = F.coalesce(F.date_format("transaction_date", "yyyy-MM"), F.lit("NaT"))
    return purchases.groupBy(month.alias("month")).agg(n_rows().alias("n")).orderBy("month")


def rfm(purchases: DataFrame, as_of: str | None = None) -> DataFrame:
    """Recency in days (against ``as_of`` or the newest purchase), frequency, spend."""
    now = F.to_date(F.lit(as_of)) if as_of else one(purchases, F.max("transaction_date"))
    return purchases.groupBy("panelist_id").agg(
        F.max("transaction_date").alias("last_purchase"),
        F.count("transaction_date").alias("frequency"),
        F.sum("total_value").alias("monetary"),
    ).select(
        "panelist_id",
        F.date_diff(now, "last_purchase").alias("recency_days"),
        "frequency",
        F.round("monetary", 2).alias("monetary"),
    )


def survey_kpis(responses: DataFrame) -> DataFrame:
    """Completion: share of respondents whose row count equals the question count."""
    questions = one(responses, F.count_distinct("question_id"))
    per = responses.groupBy("panelist_id").agg(n_rows().alias("n"))
    return per.agg(
        F.sum("n").alias("total_responses"),
        questions.cast("bigint").alias("questions"),
        n_rows().alias("respondents"),
        F.bround(F.avg((F.col("n") == questions).cast("int")), 4).alias("completion_rate"),
    )


def cluster_sizes(panelists: DataFrame, column: str = "behavioral_archetype") -> DataFrame:
    every = panelists.groupBy(column).agg(n_rows().alias("count"))
    share = _share(F.col("count"), one(every, F.sum("count")))
    return every.filter(F.col(column).isNotNull()).select(
        expr.humanize(column).alias("label"), "count", share.alias("share")
    )


PROFILE_DIMENSIONS = [
    "price_sensitivity", "brand_loyalty", "category_breadth", "promotion_response",
    "convenience_preference",
]


def cluster_profile(purchases: DataFrame, panelists: DataFrame) -> DataFrame:
    """Five behavior dimensions per archetype, min-max scaled per dimension.

    Per household: share of rows in the two lowest price bins, share of rows of
    its leading brand, distinct categories, promotion share, and share of
    convenience or online rows. Averages over households give the profile.
    """
    cheap = expr.price_bin("unit_price").isin("budget", "value").cast("int")
    near = F.col("store_type").isin("convenience", "online").cast("int")
    by_brand = purchases.groupBy("panelist_id", "brand").agg(
        n_rows().alias("rows"), F.sum(cheap).alias("cheap"), F.sum(near).alias("near"),
        F.sum(F.col("is_promotion").cast("int")).alias("promo"),
    )
    kinds = purchases.filter("product_category is not null").select("panelist_id", "product_category").distinct()
    breadth = kinds.groupBy("panelist_id").agg(n_rows().cast("double").alias("breadth"))
    house = by_brand.groupBy("panelist_id").agg(
        (F.sum("cheap") / F.sum("rows")).alias("price_sensitivity"),
        (F.max("rows") / F.sum("rows")).alias("brand_loyalty"),
        (F.sum("promo") / F.sum("rows")).alias("promotion_response"),
        (F.sum("near") / F.sum("rows")).alias("convenience_preference"),
    ).join(breadth, "panelist_id", "left").withColumn("category_breadth", F.coalesce("breadth", F.lit(0.0)))
    means = (
        panelists.select("panelist_id", "behavioral_archetype")
        .join(house, "panelist_id")
        .groupBy("behavioral_archetype")
        .agg(*[F.avg(d).alias(d) for d in PROFILE_DIMENSIONS])
    )
    everywhere = Window.partitionBy()  # one row per archetype

    def scaled(d: str) -> Column:
        lo, hi = F.min(d).over(everywhere), F.max(d).over(everywhere)
        return F.round(
            F.when(hi > lo, (F.col(d) - lo) / (hi - lo)).otherwise(F.lit(0.5)), 6
        ).alias(d)

    return means.select(
        expr.humanize("behavioral_archetype").alias("label"), *[scaled(d) for d in PROFILE_DIMENSIONS]
    )


def profile(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Null rate and distinct count per column, with the highest null rate.

    Long form: each (column, value) pair is counted once, so wide tables need one
    shuffle of distinct pairs instead of one expansion per column.
    """
    if approximate:
        distinct = [F.approx_count_distinct(c).alias(f"d_{c}") for c in columns]
        row = df.agg(n_rows().alias("n"), *[F.count(c).alias(f"c_{c}") for c in columns], *distinct)
        out = row.select(
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(c).alias("column"),
                            (1 - F.col(f"c_{c}") / F.col("n")).alias("null_rate"),
                            F.col(f"d_{c}").alias("distinct_values"),
                        )
                        for c in columns
                    ]
                )
            ).alias("r")
        ).select("r.*")
    else:
        values = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
            [], list(columns), "column", "value"
        )
        out = (
            values.groupBy("column", "value")
            .agg(n_rows().alias("n"))
            .groupBy("column")
            .agg(
                (F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias(
                    "null_rate"
                ),
                F.count("value").alias("distinct_values"),
            )
        )
    return out.withColumn("max_null_rate", F.max("null_rate").over(Window.partitionBy()))


def outliers(df: DataFrame, columns: Sequence[str], sigmas: float = 3.0) -> DataFrame:
    """Rows further than ``sigmas`` sample standard deviations from the mean."""
    stats = one(
        df,
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
        ),
    )
    hits = df.agg(
        *[
            F.count_if(F.abs(F.col(c) - stats[f"m_{c}"]) > sigmas * stats[f"s_{c}"]).alias(c)
            for c in columns
        ]
    )
    return hits.unpivot([], list(columns), "column", "outliers")


def rfm_scores(frame: DataFrame, key: str = "panelist_id") -> DataFrame:
    """Quintile scores 1-5 by rank: recency falling, frequency and spend rising.

    Ranks are unique (the id breaks ties) and are computed slice by slice, so no
    task ever orders the whole panel.
    """
    out = materialize(frame, "rfm")
    n = out.count()
    for column, rising in (("recency_days", False), ("frequency", True), ("monetary", True)):
        order = [F.col(column).asc() if rising else F.col(column).desc(), F.col(key).asc()]
        out = positions(out, order, name="__pos", label=f"rfm-{column}")
        score = F.ceil(5 * (F.col("__pos") - 1) / max(n - 1, 1))
        out = out.withColumn(
            f"{column}_score", F.greatest(F.lit(1), score).cast("int")
        ).drop("__pos")
    return out

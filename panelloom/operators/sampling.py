"""Exact-size samples and answer draws, reproducible from hashes of the id."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.ranking import running_totals
from panelloom.operators import distributions as dist
from panelloom.operators.selection import first_per_group
from panelloom.session import materialize, n_rows, one, small_side



def hash_order(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42, order: Column | None = None) -> DataFrame:
    """``n`` rows in hash order (all of a smaller table). ``key`` must tell rows apart; the rows
    stay where they are, see ``selection``."""
    rank = order if order is not None else hash_order(key, seed)
    want = df.agg(n_rows().alias("__size")).select(
        F.lit(0).alias("__g"), F.lit(n).cast("bigint").alias("__want"), "__size"
    )
    return first_per_group(df, want, F.lit(0), rank, key, "sample")


def stratified_sample(
    df: DataFrame, n: int, stratum: str, key: str, seed: int = 42, order: Column | None = None
) -> DataFrame:
    """Exactly ``n`` rows (or all of a smaller pool), proportional by stratum.

    Each stratum gives ``max(1, floor(n * share))``; a surplus is trimmed and a
    shortfall topped up, both in hash order. ``key`` must tell rows apart. The rows stay where
    they are, see ``selection``, so a dominant stratum does not gather in one task.
    """
    rank = order if order is not None else hash_order(key, seed)
    name = F.coalesce(F.col(stratum).cast("string"), F.lit("0"))
    sizes = materialize(df.groupBy(name.alias("__g")).agg(n_rows().alias("__size")), "strata")
    total = one(sizes, F.sum("__size"))
    want = sizes.select(
        "__g",
        F.least(
            F.col("__size"), F.greatest(F.lit(1), F.floor(n * (F.col("__size") / total)))
        ).cast("bigint").alias("__want"),
        "__size",
    )
    chosen = first_per_group(df, want, name, rank, key, "strata")
    counts = want.agg(F.sum("__want").alias("chosen"), F.sum("__size").alias("size")).first()
    drawn, size = counts["chosen"] or 0, counts["size"] or 0

    def first(rows: DataFrame, least: int, pool: int) -> DataFrame:
        whole = sizes.limit(1).select(
            F.lit(0).alias("__g"), F.lit(least).cast("bigint").alias("__want"), F.lit(pool).cast("bigint").alias("__size")
        )
        return first_per_group(rows, whole, F.lit(0), rank, key, "drawn")

    if drawn > n:
        return first(chosen, n, drawn)
    if drawn == min(n, size):
        return chosen
    rest = df.join(chosen.select(F.col(key).alias("__k")), F.col(key).eqNullSafe(F.col("__k")), "left_anti")
    return chosen.unionByName(first(rest, n - drawn, size - drawn))


def unit_hash(key: Column, modulus: int = 2_147_483_647, factor: int = 48_271) -> Column:
    """Uniform in [0, 1) from a whole-number key by a multiplicative generator."""
    return F.pmod(F.pmod(key, F.lit(modulus)) * F.lit(factor), F.lit(modulus)) / F.lit(float(modulus))


def cross_frame(panelists: DataFrame, catalog: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """One row per panelist and question.

    A catalog of at most ``most_bytes`` of names becomes one array that each row explodes; a larger
    one comes in parts of that size, one pass over the panel each. Panel rows never move.
    """
    names = materialize(catalog.select("question_id").distinct(), "questions")
    size = names.agg(F.sum(F.octet_length("question_id") + 16)).first()[0] or 0
    parts = max(1, -(-size // most_bytes))
    part = F.pmod(F.xxhash64("question_id"), F.lit(parts))
    frames = []
    for i in range(parts):
        questions = one(names.filter(part == i), F.array_sort(F.collect_list("question_id")))
        frames.append(panelists.withColumn("question_id", F.explode(questions)))
    return reduce(DataFrame.unionByName, frames)


def _draw(frame: DataFrame, intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Option whose interval holds ``u``; the last one also takes rounding slack.

    Intervals of a key form one array, so each row meets one match, not one row
    per option.
    """
    cell = F.struct("option_idx", "cdf_hi", "option")
    arrays = intervals.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    joined = frame.join(small_side(arrays, "intervals"), list(keys), "left")
    hit = F.filter("cells", lambda c: F.col("u") < c["cdf_hi"])
    found = F.when(F.size(hit) > 0, hit[0]).otherwise(F.element_at("cells", -1))
    return joined.withColumn("drawn", found)


def impute_answers(
    frame: DataFrame, conditionals: DataFrame, catalog: DataFrame, u: Column,
    given: str = "behavioral_archetype",
) -> DataFrame:
    """Draw an answer per (panelist, question) from P(option | group); uniform over
    the options where the group is unknown."""
    cdfs = dist.cdf(conditionals, ["question_id", given])
    drawn = _draw(frame.withColumn("u", u), cdfs, ["question_id", given])
    sized = drawn.join(
        small_side(catalog.select("question_id", "options"), "options"), "question_id"
    )
    even = F.floor(F.col("u") * F.size("options")).cast("int")
    return sized.withColumn(
        "answer_index", F.coalesce(F.col("drawn.option_idx"), even)
    ).withColumn("answer", F.col("options")[F.col("answer_index")]).drop(
        "drawn", "cells", "options"
    )


def quantile_map(frame: DataFrame, distribution: DataFrame, u: str = "u") -> DataFrame:
    """First option whose cumulative share reaches ``u`` (closed on the right)."""
    cell = F.struct("option_idx", "cdf_hi")
    arrays = dist.cdf(distribution).groupBy("question_id").agg(
        F.array_sort(F.collect_list(cell)).alias("cells")
    )
    joined = frame.join(small_side(arrays, "quantiles"), "question_id")
    hit = F.filter("cells", lambda c: c["cdf_hi"] >= F.col(u))
    picked = F.when(F.size(hit) > 0, hit[0]["option_idx"]).otherwise(
        F.element_at("cells", -1)["option_idx"]
    )
    return joined.withColumn("answer_index", picked).drop("cells")


def midpoint_views(events: DataFrame, key: str, order: Sequence[str], least: int = 4) -> DataFrame:
    """First half against second half of each key's events, keys with ``least`` events.

    ``order`` must make the rows of a key distinct. Positions and the number of a key's events
    come from one pass.
    """
    one_each = {"position": F.lit(1).cast("bigint")}
    placed = running_totals(events, list(order), one_each, [key], "views", {"position": "events"})
    half = F.when(F.col("position") <= F.floor(F.col("events") / 2), 1).otherwise(2)
    return placed.filter(F.col("events") >= least).withColumn("view", half)

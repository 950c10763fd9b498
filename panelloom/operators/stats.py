"""Two-sample comparison, independence tests, weights and drift."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import tails
from panelloom.functions.ranking import average_ranks, running_totals
from panelloom.operators.distributions import xlog2
from panelloom.session import materialize, n_rows, one

SMOOTHING = 0.5


def ks_two_sample(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Largest gap between two empirical distribution functions, asymptotic p."""
    flag = "__in_a"
    return ks_by_flag(
        a.select(value, F.lit(True).alias(flag)).unionByName(b.select(value, F.lit(False).alias(flag))),
        value, flag,
    )


def ks_by_flag(df: DataFrame, value: str, flag: str) -> DataFrame:
    """The same for two samples that a flag tells apart in one table, read once.

    Rows are counted per distinct value first; the running counts then go slice
    by slice over the value range. Rows with a null flag take no part.
    """
    both = df.select(F.col(value).alias("v"), F.col(flag).cast("int").alias("in_a")).filter(
        "v IS NOT NULL AND in_a IS NOT NULL"
    )
    ties = both.groupBy("v").agg(F.sum("in_a").alias("a"), F.sum(1 - F.col("in_a")).alias("b"))
    upto = running_totals(ties, ["v"], {"ca": F.col("a"), "cb": F.col("b")}, label="ks")
    size = one(upto, F.struct(F.max("ca").alias("na"), F.max("cb").alias("nb")))
    gap = F.max(F.abs(F.col("ca") / size["na"] - F.col("cb") / size["nb"]))
    out = upto.agg(gap.alias("statistic"), F.max("ca").alias("n_a"), F.max("cb").alias("n_b"))
    effective = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    return out.withColumn("p_value", tails.kolmogorov_sf(effective * F.col("statistic")))


def chi_square_gof(pairs: DataFrame, keys: Sequence[str] = ("question_id",)) -> DataFrame:
    """Goodness of fit of ``observed`` to ``expected``, rescaled to the same total."""
    w = Window.partitionBy(*keys)
    scaled = F.col("expected") * F.sum("observed").over(w) / F.greatest(
        F.sum("expected").over(w), F.lit(1e-12)
    )
    out = (
        pairs.withColumn("e", scaled)
        .groupBy(*keys)
        .agg(
            F.sum(F.pow(F.col("observed") - F.col("e"), 2) / F.col("e")).alias("statistic"),
            (n_rows() - 1).alias("dof"),
        )
    )
    return out.withColumn("p_value", tails.chi2_sf("statistic", "dof"))


def chi_square_breakdown(
    tables: DataFrame, alpha: float = 0.05, min_expected: float = 5.0
) -> DataFrame:
    """Independence of option and group per (question, dimension).

    Zero margins drop out; below 2 x 2 the table is not testable. One degree of
    freedom gets the continuity correction. Significance is null unless every
    expected cell reaches ``min_expected``.
    """
    keys = ["question_id", "dimension"]
    by = Window.partitionBy(*keys)
    cells = tables.select(
        *keys, "group", "option", F.col("n").cast("double").alias("n"),
        F.sum("n").over(Window.partitionBy(*keys, "option")).alias("r"),
        F.sum("n").over(Window.partitionBy(*keys, "group")).alias("c"),
    )
    kept = cells.filter("r > 0 AND c > 0").select(
        "*",
        F.sum("n").over(by).alias("total"),
        F.size(F.collect_set("option").over(by)).alias("rows"),
        F.size(F.collect_set("group").over(by)).alias("cols"),
    )
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    expected = F.col("r") * F.col("c") / F.col("total")
    gap = F.abs(F.col("n") - expected)
    corrected = F.when(dof == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = kept.groupBy(*keys).agg(
        F.max(F.least("rows", "cols")).alias("smallest"),
        F.max(dof).alias("dof"),
        F.sum(corrected * corrected / expected).alias("chi2"),
        F.min(expected).alias("min_expected"),
    )
    full = F.col("smallest") >= 2
    # Not in the select below: inside a lambda, ``chi2`` would mean its rounded alias.
    out = out.withColumn("p", tails.chi2_sf("chi2", "dof"))
    p = F.col("p")
    testable = full & (F.col("min_expected") >= min_expected)
    return out.select(
        *keys,
        F.when(full, F.bround("chi2", 4)).alias("chi2"),
        F.when(full, F.col("dof")).cast("int").alias("dof"),
        F.when(full, F.bround(p, 6)).alias("p_value"),
        testable.alias("testable"),
        F.when(testable, p < alpha).alias("significant"),
        F.when(~full, "degenerate table")
        .when(~testable, "expected cell count too small")
        .alias("reason"),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 when either has no length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(
        (F.sqrt(dot(a, a)) < 1e-12) | (F.sqrt(dot(b, b)) < 1e-12), 0.0
    ).otherwise(dot(a, b) / norm)
    return F.when(value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def overall_cosine(pairs: DataFrame) -> DataFrame:
    """Cosine of the concatenated per-question vectors, from three sums."""
    p, q = F.col("p"), F.col("q")
    norm = F.sqrt(F.sum(p * p)) * F.sqrt(F.sum(q * q))
    return pairs.agg(F.when(norm < 1e-12, 0.0).otherwise(F.sum(p * q) / norm).alias("cosine"))


def pair_consistency(pairs: DataFrame, n_a: Column, n_b: Column, gap: float = 0.75) -> DataFrame:
    """Spearman correlation and share of answers at opposite scale ends."""
    ranked = average_ranks(average_ranks(pairs, "index_a", "ra"), "index_b", "rb")
    far = F.abs(F.col("index_a") / (n_a - 1) - F.col("index_b") / (n_b - 1)) >= gap
    rate = F.avg(far.cast("int"))
    return ranked.agg(
        n_rows().alias("pairs"), F.corr("ra", "rb").alias("spearman"),
        rate.alias("contradiction_rate"), (1 - rate).alias("consistency_rate"),
    )


def representativeness(panel: DataFrame, column: str, reference: DataFrame) -> DataFrame:
    """Panel share against reference ``(group, reference_share)``; extra groups ignored."""
    counts = panel.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("group")).agg(
        n_rows().alias("n")
    )
    shares = counts.select("group", (F.col("n") / one(counts, F.sum("n"))).alias("observed"))
    joined = reference.join(shares, "group", "left")
    delta = F.bround(F.coalesce("observed", F.lit(0.0)) - F.col("reference_share"), 4)
    return joined.select(
        "group",
        F.bround(F.coalesce("observed", F.lit(0.0)), 4).alias("panel_share"),
        F.bround("reference_share", 4).alias("reference_share"),
        delta.alias("delta"),
        F.max(F.abs(delta)).over(Window.partitionBy()).alias("max_delta"),
    )


# --- raking ---------------------------------------------------------------

#: Cells that one task iterates over by itself; more stay distributed.
TASK_CELLS = 1_000_000


def _seen(cells: pd.DataFrame, keys: list[str], factors: list[np.ndarray], axis: int) -> tuple[np.ndarray, float]:
    """Weighted rows per level of a margin, and in all; code -1 marks a level without a target."""
    mass = cells["n"].to_numpy(dtype=float)
    for key, factor in zip(keys, factors):
        code = cells[key].to_numpy(dtype=int)
        mass = mass * np.where(code >= 0, factor[code], 1.0)
    code = cells[keys[axis]].to_numpy(dtype=int)
    known = code >= 0
    return np.bincount(code[known], weights=mass[known], minlength=len(factors[axis])), float(mass.sum())


def rake_factors(
    seen: Callable[[list[np.ndarray], int], tuple[np.ndarray, float]], targets: list[np.ndarray],
    passes: int, tolerance: float,
) -> list[np.ndarray]:
    """Factor per level of every margin, by proportional fitting; ``seen`` weighs the cells."""
    factors = [np.ones(len(t)) for t in targets]
    for _ in range(passes):
        largest = 0.0
        for axis, target in enumerate(targets):
            mass, total = seen(factors, axis)
            share = mass / total if total else mass
            step = np.where(share > 0, target / np.where(share > 0, share, 1.0), 1.0)
            largest = max(largest, float(np.abs(step - 1.0).max(initial=0.0)))
            factors[axis] = factors[axis] * step
        if largest < tolerance:
            break
    return factors


def rake(
    df: DataFrame,
    margins: Mapping[str, Mapping[str, float]],
    passes: int = 50,
    tolerance: float = 1e-6,
    task_cells: int = TASK_CELLS,
) -> DataFrame:
    """Row weights (mean 1) that match the target shares of every margin.

    Rows with equal margin levels share a weight, which is a product of one factor per margin,
    so the iteration runs on the distinct level combinations, stored once. Few of them are
    iterated over in one task; many stay where they are, with one grouped sum per margin and
    pass, after which only the factors go out again. Levels without a target count as one and
    keep their weight.
    """
    names = list(margins)
    targets = [np.array(list(margins[name].values()), dtype=float) for name in names]
    coded = df
    for name in names:
        places = F.create_map(*[F.lit(x) for i, level in enumerate(margins[name]) for x in (str(level), i)])
        coded = coded.withColumn(f"__{name}", F.coalesce(places[F.col(name).cast("string")], F.lit(-1)))
    keys = [f"__{name}" for name in names]
    cells = materialize(coded.groupBy(*keys).agg(n_rows().alias("n")), "rake")
    schema = "axis INT, code INT, value DOUBLE"

    if cells.count() <= task_cells:
        def solve(frame: pd.DataFrame) -> pd.DataFrame:
            found = rake_factors(lambda f, axis: _seen(frame, keys, f, axis), targets, passes, tolerance)
            return pd.DataFrame(
                [(i, j, x) for i, factor in enumerate(found) for j, x in enumerate(factor)],
                columns=["axis", "code", "value"],
            )

        solved = cells.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(solve, schema)
        factors = [np.ones(len(t)) for t in targets]
        for row in solved.collect():
            factors[row["axis"]][row["code"]] = row["value"]
    else:
        def seen(current: list[np.ndarray], axis: int) -> tuple[np.ndarray, float]:
            def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    mass, total = _seen(frame, keys, current, axis)
                    yield pd.DataFrame({"axis": axis, "code": range(-1, len(mass)), "value": [total, *mass]})

            sums = cells.mapInPandas(add, schema).groupBy("code").agg(F.sum("value").alias("value"))
            found = {r["code"]: r["value"] for r in sums.collect()}  # one row per level
            return np.array([found[i] for i in range(len(targets[axis]))]), found[-1]

        factors = rake_factors(seen, targets, passes, tolerance)

    weight = F.lit(1.0)
    for key, factor in zip(keys, factors):
        level = F.create_map(*[F.lit(x) for i, v in enumerate(factor.tolist()) for x in (i, v)])
        weight = weight * F.coalesce(level[F.col(key)], F.lit(1.0))
    weighted = cells.select((F.col("n") * weight).alias("mass"), "n")
    scale = one(weighted, F.sum("n") / F.sum("mass"))
    return coded.withColumn("weight", weight * scale).drop(*keys)


# --- drift ----------------------------------------------------------------

def period_counts(df: DataFrame, period: str, category: str) -> DataFrame:
    return df.filter(F.col(period).isNotNull() & F.col(category).isNotNull()).groupBy(
        F.col(period).alias("period"), F.col(category).alias("category")
    ).agg(n_rows().alias("n"))


def _mixes(counts: DataFrame) -> DataFrame:
    """Counts of every category in every period, with the period's rank."""
    levels = one(counts, F.array_sort(F.collect_set("category")))
    # Periods are calendar buckets: one row each.
    periods = counts.select("period").distinct().withColumn(
        "rank", F.row_number().over(Window.orderBy("period"))
    )
    frame = periods.select("period", "rank", F.explode(levels).alias("category"))
    return frame.join(counts, ["period", "category"], "left").na.fill(0, ["n"])


def drift_from_counts(counts: DataFrame, k: int, base_smoothing: float) -> DataFrame:
    """Divergence of each period after the first ``k`` from their sum."""
    mixes = _mixes(counts)
    first = mixes.filter(F.col("rank") <= k).groupBy("category").agg(
        (F.sum("n") + base_smoothing).alias("b")
    )
    cells = mixes.filter(F.col("rank") > k).join(first, "category").withColumn(
        "a", F.col("n") + SMOOTHING
    )
    w = Window.partitionBy("period")
    shares = cells.select(
        "period", (F.col("a") / F.sum("a").over(w)).alias("ps"),
        (F.col("b") / F.sum("b").over(w)).alias("qs"),
    )
    mid = (F.col("ps") + F.col("qs")) / 2
    js = F.sum(xlog2(F.col("ps"), mid) / 2 + xlog2(F.col("qs"), mid) / 2)
    return shares.groupBy("period").agg(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), js)).alias("divergence")
    )


def drift_pooled(df: DataFrame, period: str, category: str, k: int = 3) -> DataFrame:
    """Divergence of each later period from the pooled first ``k``, smoothed once."""
    return drift_from_counts(period_counts(df, period, category), k, SMOOTHING)


def drift_summed(df: DataFrame, period: str, category: str, k: int = 3) -> DataFrame:
    """The same against the sum of ``k`` separately smoothed periods."""
    return drift_from_counts(period_counts(df, period, category), k, SMOOTHING * k)


def streaks(df: DataFrame, order: str, cond: str) -> DataFrame:
    """Length of the run of true ``cond`` ending at each row, over a period series."""
    w = Window.orderBy(order)  # one row per period
    breaks = F.sum(F.when(F.col(cond), 0).otherwise(1)).over(
        w.rowsBetween(Window.unboundedPreceding, 0)
    )
    return df.withColumn("__island", breaks).withColumn(
        "streak",
        F.sum(F.col(cond).cast("int")).over(Window.partitionBy("__island").orderBy(order)),
    ).drop("__island")


def event_streaks(df: DataFrame, key: str, order: Sequence[str], cond: str) -> DataFrame:
    """The same over an event log of any size, per key: islands are numbered by
    slice-wise running counts of breaks."""
    marked = running_totals(
        df, order, {"__island": F.when(F.col(cond), 0).otherwise(1)}, [key], "islands"
    )
    return running_totals(
        marked, order, {"streak": F.col(cond).cast("int")}, [key, "__island"], "streaks"
    ).drop("__island")


def drift_decision(
    series: DataFrame,
    k_sigma: float = 3.0,
    consecutive: int = 2,
    hard: float = 2.0,
    reference: DataFrame | None = None,
) -> DataFrame:
    """Trigger level and the first period where a rule fires.

    The level is mean plus ``k_sigma`` population deviations of ``reference``, or
    of the series itself.
    """
    noise = one(
        reference if reference is not None else series,
        F.struct(F.avg("divergence").alias("m"), F.stddev_pop("divergence").alias("s")),
    )
    level = noise["m"] + k_sigma * noise["s"]
    judged = series.select(
        "period", "divergence", (F.col("divergence") > level).alias("breach"),
        (F.col("divergence") > hard * level).alias("is_hard"),
    )
    ruled = streaks(judged, "period", "breach").withColumn(
        "rule",
        F.when(F.col("is_hard"), "hard").when(F.col("streak") >= consecutive, "consecutive"),
    )
    fired = F.min(F.when(F.col("rule").isNotNull(), F.struct("period", "rule")))
    return ruled.agg(
        n_rows().alias("periods"),
        F.count_if("breach").alias("breaches"),
        F.array_join(
            F.array_sort(F.collect_list(F.when(F.col("breach"), F.col("period")))), ","
        ).alias("breach_periods"),
        F.round(F.first(noise["m"]), 6).alias("noise_mean"),
        F.round(F.first(noise["s"]), 6).alias("noise_std"),
        F.round(F.first(level), 6).alias("trigger_level"),
        fired.isNotNull().alias("fired"),
        fired["period"].alias("fired_period"),
        fired["rule"].alias("rule"),
    ).withColumn(
        "periods",
        F.when(F.col("periods") > 0, F.col("periods")).otherwise(
            F.raise_error(F.lit("drift needs more periods than its baseline")).cast("bigint")
        ),
    )


def diversity_check(
    entropies: DataFrame, floor: float = 1.5, bump: float = 0.1, gain: float = 0.3
) -> DataFrame:
    """Calibrated entropy if present, else raw; below the floor an adjustment."""
    e = F.coalesce("calibrated_entropy", "entropy")
    low = e < floor
    return entropies.select(
        "question_id", F.bround(e, 3).alias("entropy"), (~low).alias("acceptable"),
        F.when(low, F.bround(bump + (floor - e) * gain, 2)).alias("adjustment"),
    )

"""Calibration of answer distributions to empirical ones."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators import distributions as dist
from panelloom.session import materialize

LAMBDA_B, LAMBDA_F, EPSILON = 0.3, 0.2, 0.1
FLOOR = 1e-12


def calibrate(
    pairs: DataFrame, keys: Sequence[str] = ("question_id",), blend: Column | float = LAMBDA_B
) -> DataFrame:
    """``(1 - blend) * q + blend * p`` per option, normalized.

    ``p`` is the observed and ``q`` the empirical share. This is the transported
    distribution itself: entropic transport ends on the target marginal at every
    step, so no solver is needed for it.
    """
    b = blend if isinstance(blend, Column) else F.lit(float(blend))
    raw = (1 - b) * F.col("qs") + b * F.col("ps")
    shares = dist.with_shares(pairs, keys).withColumn("raw", raw)
    return shares.select(
        *keys, "option_idx", "option", F.col("ps").alias("source"), F.col("qs").alias("target"),
        (F.col("raw") / F.sum("raw").over(Window.partitionBy(*keys))).alias("mass"),
    )


def calibration_metrics(calibrated: DataFrame, keys: Sequence[str] = ("question_id",)) -> DataFrame:
    """W1 and JS to the target before and after, with percent improvement."""
    stages = F.explode(
        F.array(
            F.struct(F.lit("before").alias("stage"), F.col("source").alias("p")),
            F.struct(F.lit("after").alias("stage"), F.col("mass").alias("p")),
        )
    )
    pairs = calibrated.select(
        *keys, "option_idx", F.col("target").alias("q"), stages.alias("s")
    ).select(*keys, "option_idx", "q", "s.*")
    measured = dist.divergences(pairs, [*keys, "stage"])

    def at(measure: str, stage: str) -> Column:
        return F.max(F.when(F.col("stage") == stage, F.col(measure)))

    both = measured.groupBy(*keys).agg(
        at("wasserstein", "before").alias("w_before"), at("wasserstein", "after").alias("w_after"),
        at("js", "before").alias("js_before"), at("js", "after").alias("js_after"),
    )

    def better(m: str) -> Column:
        a, b = F.col(f"{m}_before"), F.col(f"{m}_after")
        return F.bround(F.when(a > 0, (a - b) / a * 100).otherwise(0.0), 2)

    return both.select(
        *keys,
        F.bround("w_before", 6).alias("wasserstein_before"),
        F.bround("w_after", 6).alias("wasserstein_after"),
        F.bround("js_before", 6).alias("js_before"),
        F.bround("js_after", 6).alias("js_after"),
        better("w").alias("wasserstein_improvement_pct"),
        better("js").alias("js_improvement_pct"),
    )


def cost_cells(
    options: DataFrame, keys: Sequence[str] = ("question_id",), eta: float = 0.0
) -> DataFrame:
    """Squared index distance over its maximum; uncertain source rows get cheaper.

    ``options`` has ``option_idx`` (and ``uncertainty`` when ``eta`` > 0); the
    self join is on the question, a handful of options each.
    """
    u = F.col("uncertainty") if eta > 0 else F.lit(0.0)
    left = options.select(*keys, F.col("option_idx").alias("i"), u.alias("u"))
    right = options.select(*keys, F.col("option_idx").alias("j"))
    cells = left.join(right, list(keys))
    gap = F.pow(F.col("i") - F.col("j"), 2)
    top = F.greatest(F.max(gap).over(Window.partitionBy(*keys)), F.lit(FLOOR))
    return cells.select(*keys, "i", "j", (gap / top / (1 + eta * F.col("u"))).alias("cost"))


def fairness_repair(
    groups: DataFrame, overall: DataFrame, strength: float = LAMBDA_F, tolerance: float = 0.1,
    keys: Sequence[str] = ("question_id", "group"),
) -> DataFrame:
    """Groups further than ``tolerance`` from the overall shares move towards them.

    Returns the adjusted shares with the gap before and after on every row.
    """
    base = overall.select("question_id", "option_idx", F.col("mass").alias("overall"))
    w = Window.partitionBy(*keys)
    joined = groups.join(base, ["question_id", "option_idx"])
    gap = F.sum(F.abs(F.col("mass") - F.col("overall"))).over(w) / 2
    moved = (1 - strength) * F.col("mass") + strength * F.col("overall")
    cells = joined.withColumn("gap", gap).withColumn(
        "raw", F.when(F.col("gap") > tolerance, moved).otherwise(F.col("mass"))
    )
    cells = cells.withColumn(
        "adjusted",
        F.when(F.col("gap") > tolerance, F.col("raw") / F.sum("raw").over(w)).otherwise(F.col("mass")),
    )
    after = F.sum(F.abs(F.col("adjusted") - F.col("overall"))).over(w) / 2
    return cells.select(
        *keys, "option_idx", F.col("adjusted").alias("mass"),
        F.bround("gap", 4).alias("gap_before"), F.bround(after, 4).alias("gap_after"),
    )


def parity_gaps(repaired: DataFrame, keys: Sequence[str] = ("question_id", "group")) -> DataFrame:
    return repaired.groupBy(*keys).agg(
        F.first("gap_before").alias("gap_before"), F.first("gap_after").alias("gap_after")
    )


def survey_shares(
    responses: DataFrame, history: DataFrame, catalog: DataFrame, answer: str = "answer",
    group: str = "age_group",
) -> tuple[DataFrame, DataFrame]:
    """Observed against empirical shares, and the group shares.

    Responses and history are each read once; ``catalog`` should be a stored table. The results
    have a row per option (and group); they are stored, so what follows never goes back to
    the answers.
    """
    cells = materialize(dist.weighted_cells(responses, catalog, group, answer), "weights")
    source = dist.overall_from_cells(cells, catalog)
    target = dist.empirical_target(history, catalog)
    pairs = materialize(dist.align(source, target), "pairs")
    return pairs, materialize(dist.groups_from_cells(cells, catalog), "groups")


def calibrate_survey(
    responses: DataFrame, history: DataFrame, catalog: DataFrame, answer: str = "answer",
    blend: float = LAMBDA_B, fairness: float = LAMBDA_F, tolerance: float = 0.1,
    group: str = "age_group",
) -> DataFrame:
    """Weighted source, empirical target, blend, fairness and metrics per question.

    A question whose masses are unusable gets null metrics; others are unaffected.
    """
    pairs, groups = survey_shares(responses, history, catalog, answer, group)
    return survey_metrics(pairs, groups, blend, fairness, tolerance)


def survey_metrics(
    pairs: DataFrame, groups: DataFrame, blend: float = LAMBDA_B, fairness: float = LAMBDA_F,
    tolerance: float = 0.1,
) -> DataFrame:
    calibrated = calibrate(pairs, blend=blend)
    gaps = parity_gaps(fairness_repair(groups, calibrated, fairness, tolerance))
    worst = gaps.groupBy("question_id").agg(
        F.max("gap_before").alias("max_gap_before"), F.max("gap_after").alias("max_gap_after")
    )
    return calibration_metrics(calibrated).join(worst, "question_id", "left")


def calibration_sweep(
    pairs: DataFrame, blends: Sequence[float], strengths: Sequence[float],
    groups: DataFrame, tolerance: float = 0.1,
) -> DataFrame:
    """Mean metrics per parameter value over all questions, one plan per parameter."""
    grid = F.explode(F.array(*[F.lit(float(b)) for b in blends]))
    swept = calibrate(
        pairs.withColumn("blend", grid), ["question_id", "blend"], F.col("blend")
    )
    by_blend = calibration_metrics(swept, ["question_id", "blend"]).groupBy("blend").agg(
        F.avg("wasserstein_after").alias("wasserstein"), F.avg("js_after").alias("js")
    ).select(
        F.lit("blend").alias("parameter"), F.col("blend").alias("value"), "wasserstein", "js",
        F.lit(None).cast("double").alias("gap"),
    )
    overall = calibrate(pairs)
    frames = [by_blend]
    for s in strengths:
        gaps = parity_gaps(fairness_repair(groups, overall, s, tolerance))
        frames.append(
            gaps.agg(F.avg("gap_after").alias("gap")).select(
                F.lit("fairness").alias("parameter"), F.lit(float(s)).alias("value"),
                F.lit(None).cast("double").alias("wasserstein"),
                F.lit(None).cast("double").alias("js"), "gap",
            )
        )
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


# --- transport plans ------------------------------------------------------

def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def solve_plan(
    a: np.ndarray, b: np.ndarray, cost: np.ndarray, epsilon: float, cap: int, threshold: float
) -> tuple[np.ndarray, list[float]]:
    """Log-domain scaling: rows, then columns, until the row error is small."""
    kernel = -cost / epsilon
    log_a, log_b = np.log(a + FLOOR), np.log(b + FLOOR)
    v = np.zeros_like(b)
    errors: list[float] = []
    plan = np.zeros_like(cost)
    for _ in range(cap):
        u = log_a - _lse(kernel + v[None, :], 1)
        v = log_b - _lse(kernel + u[:, None], 0)
        plan = np.exp(kernel + u[:, None] + v[None, :])
        errors.append(float(np.abs(plan.sum(axis=1) - a).sum()))
        if errors[-1] < threshold:
            break
    return plan, errors


def transport_plans(
    pairs: DataFrame, cost: DataFrame, epsilons: Sequence[float],
    keys: Sequence[str] = ("question_id",), cap: int = 1000, threshold: float = 1e-6,
) -> DataFrame:
    """Entropic transport plan cells for every (key, epsilon) problem.

    A problem is one question's option square, so a group has at most
    options^2 rows; problems run in parallel. Each row carries the problem's
    iteration count, convergence flag and error history.
    """
    shares = dist.with_shares(pairs, keys)
    rows = shares.select(*keys, F.col("option_idx").alias("i"), F.col("ps").alias("a"))
    cols = shares.select(*keys, F.col("option_idx").alias("j"), F.col("qs").alias("b"))
    cells = (
        cost.join(rows, [*keys, "i"]).join(cols, [*keys, "j"])
        .withColumn("epsilon", F.explode(F.array(*[F.lit(float(e)) for e in epsilons])))
    )

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        grid = frame.sort_values(["i", "j"])
        n = grid["i"].nunique()
        a = grid["a"].to_numpy().reshape(n, n)[:, 0]
        b = grid["b"].to_numpy().reshape(n, n)[0, :]
        plan, errors = solve_plan(
            a, b, grid["cost"].to_numpy().reshape(n, n), float(grid["epsilon"].iloc[0]), cap, threshold
        )
        return grid[[*keys, "epsilon", "i", "j"]].assign(
            mass=plan.ravel(), iterations=len(errors), converged=errors[-1] < threshold,
            final_error=errors[-1], history=[errors] * len(grid),
        )

    key_ddl = ", ".join(f"`{k}` STRING" for k in keys)
    schema = (
        f"{key_ddl}, epsilon DOUBLE, i INT, j INT, mass DOUBLE, iterations INT, "
        "converged BOOLEAN, final_error DOUBLE, history ARRAY<DOUBLE>"
    )
    return cells.groupBy(*keys, "epsilon").applyInPandas(solve, schema)


def plan_entropy(plans: DataFrame, keys: Sequence[str] = ("question_id", "epsilon")) -> DataFrame:
    """Entropy of the plan over the logarithm of its cell count."""
    m = F.col("mass")
    return plans.groupBy(*keys).agg(
        (F.sum(F.when(m > FLOOR, -m * F.ln(m)).otherwise(0.0)) / F.ln(F.count(F.lit(1)))).alias(
            "plan_entropy"
        )
    )


def epsilon_sweep(plans: DataFrame) -> DataFrame:
    """Mean iterations, final error, convergence and plan entropy per epsilon."""
    problems = plans.groupBy("question_id", "epsilon").agg(
        F.first("iterations").alias("iterations"), F.first("final_error").alias("final_error"),
        F.first("converged").alias("converged"),
    ).join(plan_entropy(plans), ["question_id", "epsilon"])
    return problems.groupBy("epsilon").agg(
        F.avg("iterations").alias("iterations"), F.avg("final_error").alias("final_error"),
        F.avg(F.col("converged").cast("int")).alias("converged_share"),
        F.avg("plan_entropy").alias("plan_entropy"),
    )


def plan_marginals(plans: DataFrame, keys: Sequence[str] = ("question_id", "epsilon")) -> DataFrame:
    return plans.groupBy(*keys, F.col("j").alias("option_idx")).agg(F.sum("mass").alias("mass"))


def default_blend(catalog: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Blend per question: the override when given, else the default."""
    base = catalog.select("question_id")
    if overrides is None:
        return base.withColumn("blend", F.lit(LAMBDA_B))
    return base.join(overrides, "question_id", "left").na.fill(LAMBDA_B, ["blend"])



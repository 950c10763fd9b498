"""Run-level summaries: quality rates, costs, latency and verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.session import n_rows, one, small_table


# Flags, acceptance rules and audit gates.
HALLUCINATION = "hallucination_detected"
INCONSISTENCY = ["age_inconsistency", "income_inconsistency", "sequential_inconsistency"]
ACCEPTANCE = [
    ("cosine", "min", 0.80), ("js", "max", 0.05), ("wasserstein", "max", 0.15),
    ("hallucination", "max", 0.05), ("consistency", "min", 0.90), ("entropy", "min", 1.50),
]
AUDIT_GATES = [
    ("hallucination_rate", "below", 0.05), ("consistency_score", "above", 0.90),
    ("validity_share", "above", 0.93),
]


def flag_rate(flag: str = HALLUCINATION, flags: str = "validation_flags") -> Column:
    """Aggregate: share of rows carrying ``flag``; 0 without rows."""
    hit = F.coalesce(F.array_contains(flags, flag), F.lit(False))
    return F.coalesce(F.avg(hit.cast("int")), F.lit(0.0))


def consistency_rate(flags: str = "validation_flags") -> Column:
    """Aggregate: share of rows free of inconsistency flags; 1 without rows."""
    bad = F.array(*[F.lit(f) for f in INCONSISTENCY])
    hit = F.coalesce(F.arrays_overlap(F.col(flags), bad), F.lit(False))
    return F.coalesce(F.avg((~hit).cast("int")), F.lit(1.0))


def run_summary(responses: DataFrame) -> DataFrame:
    return responses.agg(
        n_rows().alias("total_responses"),
        F.count_if(F.coalesce(F.col("is_valid"), F.lit(True))).alias("valid_responses"),
        F.bround(flag_rate(), 4).alias("hallucination_rate"),
        F.bround(consistency_rate(), 4).alias("consistency_score"),
        F.bround(F.coalesce(F.avg(F.coalesce("confidence", F.lit(0.0))), F.lit(0.0)), 3).alias(
            "mean_confidence"
        ),
    )


def flag_counts(responses: DataFrame, prefix: str = "", flags: str = "validation_flags") -> DataFrame:
    return (
        responses.select(F.explode(flags).alias("flag"))
        .filter(F.startswith(F.col("flag"), F.lit(prefix)))
        .groupBy("flag")
        .agg(n_rows().alias("n"))
    )


def model_costs(calls: DataFrame, budget: float | None = None) -> DataFrame:
    """Calls, latency, tokens and cost per model, with the run total and budget flag."""
    out = calls.groupBy("model_used").agg(
        n_rows().alias("calls"),
        F.avg("generation_time_ms").alias("avg_latency_ms"),
        F.sum("token_count").alias("tokens"),
        F.sum("cost_usd").alias("cost_usd"),
    )
    total = one(out, F.sum("cost_usd"))
    out = out.withColumn("cost_per_response", F.col("cost_usd") / F.col("calls")).withColumn(
        "total_cost_usd", total
    )
    over = total > budget if budget is not None else F.lit(False)
    return out.withColumn("budget_exceeded", over)


def bucket_counts(df: DataFrame, value: str, bounds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts per upper bound, as a histogram metric keeps them."""
    sums = [
        F.count_if(F.col(value) <= float(b)).alias(f"b{i}") for i, b in enumerate(bounds)
    ]
    wide = df.groupBy(*keys).agg(n_rows().alias("total"), *sums)
    cells = F.array(
        *[
            F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("upto"))
            for i, b in enumerate(bounds)
        ]
    )
    return wide.select(*keys, "total", F.explode(cells).alias("c")).select(*keys, "total", "c.*")


def bucket_quantile(buckets: DataFrame, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """Quantile from cumulative buckets ``(bound, upto, total)``, linear inside one.

    Buckets of all series are merged by key first; beyond the last bound the
    answer is that bound.
    """
    merged = buckets.groupBy(*keys, "bound").agg(
        F.sum("upto").alias("upto"), F.sum("total").alias("total")
    )
    w = Window.partitionBy(*keys).orderBy("bound")
    before = F.coalesce(F.lag("upto").over(w), F.lit(0))
    lower = F.coalesce(F.lag("bound").over(w), F.lit(0.0))
    want = F.col("total") * q
    inside = F.when(F.col("upto") == F.col("before"), F.col("bound")).otherwise(
        F.col("lower")
        + (F.col("bound") - F.col("lower")) * (want - F.col("before")) / (F.col("upto") - F.col("before"))
    )
    cells = merged.withColumn("before", before).withColumn("lower", lower)
    hit = F.when(F.col("upto") >= want, F.struct(F.col("bound").alias("at"), inside.alias("v")))
    return cells.groupBy(*keys).agg(
        F.coalesce(F.min(hit)["v"], F.max("bound")).alias("quantile")
    )


def ops_by_label(calls: DataFrame) -> DataFrame:
    """Latency, calls and error rate per label."""
    return calls.groupBy("label").agg(
        n_rows().alias("calls"),
        F.count_if("failed").alias("errors"),
        F.bround(F.avg("value"), 1).alias("avg_latency"),
        F.bround(F.avg(F.col("failed").cast("int")), 4).alias("error_rate"),
    )


def rule_table(df: DataFrame, rules: Sequence[tuple[str, str, float]]) -> DataFrame:
    return small_table(df.sparkSession, list(rules), ["metric", "rule", "threshold"])


def verdicts(
    metrics: DataFrame, rules: Sequence[tuple[str, str, float]], keys: Sequence[str] = ()
) -> DataFrame:
    """Each metric against its rule, plus whether all of the key's rules pass.

    ``min``/``max`` include the threshold, ``above``/``below`` do not.
    """
    names = [m for m, _, _ in rules if m in metrics.columns]
    long = metrics.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        list(keys), names, "metric", "value"
    )
    v, t = F.col("value"), F.col("threshold")
    ok = (
        F.when(F.col("rule") == "min", v >= t)
        .when(F.col("rule") == "max", v <= t)
        .when(F.col("rule") == "above", v > t)
        .otherwise(v < t)
    )
    judged = long.join(rule_table(metrics, rules), "metric").withColumn(
        "passed", F.coalesce(ok, F.lit(False))
    )
    # At most one row per rule and key.
    return judged.withColumn("all_passed", F.every("passed").over(Window.partitionBy(*keys)))


def audit_metrics(responses: DataFrame) -> DataFrame:
    return responses.agg(
        flag_rate().alias("hallucination_rate"),
        consistency_rate().alias("consistency_score"),
        (F.count_if("is_valid") / F.greatest(n_rows(), F.lit(1))).alias("validity_share"),
    )


def compare_runs(per_question: DataFrame, run: str, metrics: Sequence[str]) -> DataFrame:
    return per_question.groupBy(run).agg(
        n_rows().alias("questions"), *[F.avg(m).alias(m) for m in metrics]
    )


def parse_rates(parsed: DataFrame, method: str = "parse_method") -> DataFrame:
    counts = parsed.groupBy(method).agg(n_rows().alias("n"))
    return counts.withColumn("rate", F.col("n") / one(counts, F.sum("n")))


def trace_durations(trace: DataFrame, step: str, duration: str) -> DataFrame:
    sums = trace.groupBy(step).agg(F.sum(duration).alias("duration"))
    total = one(sums, F.sum("duration"))
    return sums.select(step, "duration", (F.col("duration") / total).alias("share"))


def labelled(names: Mapping[str, str], column: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(table[column], column)

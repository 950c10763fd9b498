"""Composed jobs: cohort, benchmark, embedding, analysis, audit, cross-validation."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom import schemas
from panelloom.functions import expr
from panelloom.functions.ranking import first_rows
from panelloom.operators import calibrate as cal
from panelloom.operators import clusters, eda, features, quality, reports, stats
from panelloom.operators import distributions as dist
from panelloom.session import materialize, n_rows, one
from panelloom.sources import landings, panel, store

# Gate settings of the jobs.
COHORT_COLUMNS = ["panelist_id", "age_group", "income_group", "region"]
MIN_COHORT, MAX_NULLS, MAX_SHARE, MIN_SAMPLE = 10, 0.02, 0.80, 30


# --- run record -----------------------------------------------------------

@dataclass
class Stages:
    """The parts of one job; each takes and returns a frame."""

    extract: Callable[[], DataFrame]
    validate: Callable[[DataFrame], DataFrame] = lambda df: df
    transform: Callable[[DataFrame], DataFrame] = lambda df: df
    checks: Callable[[DataFrame], Sequence[quality.Check]] = lambda df: []
    load: Callable[[DataFrame], None] = lambda df: None


RUN_RECORD = (
    "job STRING, state STRING, rows_extracted BIGINT, rows_transformed BIGINT, rows_loaded BIGINT, "
    "passed BIGINT, warnings BIGINT, failures BIGINT, error STRING, duration_seconds DOUBLE, "
    "dry_run BOOLEAN"
)


def run_job(spark: SparkSession, name: str, stages: Stages, dry_run: bool = False) -> DataFrame:
    """Extract, validate, transform, gate, load; returns the one-row run record.

    A failed gate loads nothing. Data problems end in state ``failed`` with the
    error cut to 500 characters; they do not raise. The transformed rows are
    stored once, so the gate and the load judge and write the same data.
    """
    started = time.perf_counter()
    counts = {"extracted": 0, "transformed": 0, "loaded": 0}
    verdict = {"passed": 0, "warnings": 0, "failures": 0}
    state, error = "complete", ""
    try:
        extracted = stages.extract()
        counts["extracted"] = extracted.count()
        ready = materialize(stages.transform(stages.validate(extracted)), f"job-{name}")
        counts["transformed"] = ready.count()
        checks = list(stages.checks(ready))
        if checks:
            row = quality.gate(quality.run_checks(ready, checks)).first()
            verdict = {k: row[k] for k in verdict}
            if not row["ok"]:
                raise quality.QualityError(f"{name}: {row['failures']} blocking failures")
        if not dry_run:
            stages.load(ready)
            counts["loaded"] = counts["transformed"]
    except Exception as exc:  # noqa: BLE001 - recorded, as the contract says
        state, error = "failed", str(exc)
    row = (
        name, state, counts["extracted"], counts["transformed"], counts["loaded"],
        verdict["passed"], verdict["warnings"], verdict["failures"], error,
        round(time.perf_counter() - started, 2), dry_run,
    )
    return spark.createDataFrame([row], RUN_RECORD)


# --- cohort ---------------------------------------------------------------

def attach_rfm(cohort: DataFrame, purchases: DataFrame, as_of: str) -> DataFrame:
    """Cohort with frequency, spend and recency; 0, 0 and 999 without purchases."""
    sums = eda.rfm(purchases, as_of)
    return cohort.join(sums, "panelist_id", "left").na.fill(
        {"frequency": 0, "monetary": 0.0, "recency_days": 999}
    )


def cohort_frame(
    panelists: DataFrame, purchases: DataFrame, filters: Mapping[str, object], size: int, as_of: str
) -> DataFrame:
    """Filtered, bounded, deduplicated cohort on known scales with RFM scores."""
    cohort = panel.scan_panelists(panelists, filters, size, cap=None)
    bought = panel.scan_purchases(purchases, cohort)
    merged = attach_rfm(first_rows(cohort, ["panelist_id"], ["region"]), bought, as_of)
    scaled = merged.withColumn(
        "age_group", expr.normalize_scale("age_group", schemas.AGE_GROUPS)
    ).withColumn("income_group", expr.normalize_scale("income_group", schemas.INCOME_GROUPS))
    return eda.rfm_scores(scaled)


def cohort_checks(df: DataFrame) -> list[quality.Check]:
    return [
        quality.required_columns(df, COHORT_COLUMNS),
        quality.unique_key("panelist_id"),
        quality.null_rate(df, COHORT_COLUMNS, MAX_NULLS),
        quality.distribution_balance("age_group", MAX_SHARE),
        quality.custom(
            "minimum_size", quality.CRITICAL, n_rows().cast("double"), lambda v: v >= MIN_COHORT
        ),
    ]


def cohort_job(
    spark: SparkSession, panelists: DataFrame, purchases: DataFrame, filters: Mapping[str, object],
    size: int, as_of: str, path: str, run_id: str, dry_run: bool = False,
) -> DataFrame:
    return run_job(
        spark, "cohort",
        Stages(
            extract=lambda: panel.scan_panelists(panelists, filters, size, cap=None),
            transform=lambda df: cohort_frame(df, purchases, {}, size, as_of),
            checks=cohort_checks,
            load=lambda df: store.save_cohort(df, path, run_id),
        ),
        dry_run,
    )


# --- benchmarks -----------------------------------------------------------

def benchmark_frame(landed: DataFrame, source: str, version: str) -> DataFrame:
    """Distribution rows of one landed benchmark."""
    if landed.limit(MIN_SAMPLE).count() < MIN_SAMPLE:
        raise landings.LandingError(f"{source} {version}: fewer than {MIN_SAMPLE} rows")
    rows = landings.harmonize(landed)
    return dist.benchmark_distributions(
        rows, landings.question_columns(rows), source, version
    ).select(*schemas.BENCHMARK_COLUMNS)


def benchmark_checks(df: DataFrame) -> list[quality.Check]:
    return [
        quality.required_columns(df, schemas.BENCHMARK_COLUMNS),
        quality.null_rate(df, schemas.BENCHMARK_COLUMNS, 0.0),
        quality.distribution_balance("option", MAX_SHARE),
    ]


BENCHMARK_KEY = ["source", "version", "question_id", "demographic_group", "option"]


def benchmark_job(
    spark: SparkSession, root: str, source: str, version: str, target: str, dry_run: bool = False
) -> DataFrame:
    """Landed benchmark to distribution rows; each load replaces its own version."""
    def load(df: DataFrame) -> None:
        (
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("source", "version").parquet(target)
        )

    return run_job(
        spark, "benchmark",
        Stages(
            extract=lambda: landings.read_benchmark(spark, root, source, version),
            transform=lambda df: benchmark_frame(df, source, version),
            checks=benchmark_checks,
            load=load,
        ),
        dry_run,
    )


def cross_validate(results: DataFrame, benchmarks: DataFrame, js_limit: float = 0.05, w1_limit: float = 0.15) -> DataFrame:
    """Calibrated shares ``(question_id, option_idx, option, mass)`` against the
    benchmark rows of each source: mean JS and W1 with a verdict."""
    weighted = benchmarks.groupBy("source", "question_id", "option").agg(
        F.sum(F.col("share") * F.col("sample_size")).alias("q")
    )
    shares = results.select("question_id", "option_idx", "option", "mass")
    frame = shares.join(weighted.select("source", "question_id").distinct(), "question_id")
    pairs = frame.join(weighted, ["source", "question_id", "option"], "left").select(
        "source", "question_id", "option_idx", F.col("mass").alias("p"),
        F.coalesce("q", F.lit(0.0)).alias("q"),
    )
    per = dist.divergences(pairs, ["source", "question_id"])
    means = per.groupBy("source").agg(
        n_rows().alias("questions"), F.avg("js").alias("js"), F.avg("wasserstein").alias("wasserstein")
    )
    return means.withColumn(
        "passed", (F.col("js") <= js_limit) & (F.col("wasserstein") <= w1_limit)
    )


# --- embeddings -----------------------------------------------------------

def embed_households(purchases: DataFrame, panelists: DataFrame, d: int = 128, seed: int = 42) -> DataFrame:
    """Standardized behavior features, projected to unit vectors."""
    levels = features.category_levels(purchases)
    names = features.feature_names(levels)
    raw = features.standardize(features.behavior_features(purchases, panelists, levels), names)
    return features.l2_normalize(
        features.random_projection(features.as_vector(raw, names), len(names), d, seed)
    )


def embedding_job(
    panelists: DataFrame, purchases: DataFrame | None, k: int = clusters.CLUSTERS,
    restarts: int = clusters.RESTARTS, seed: int = 42,
) -> DataFrame:
    """Panelists with ``cluster_id``; 0 where no embedding exists.

    Without purchases the panel passes through with cluster 0 instead of failing.
    """
    if purchases is None:
        return panelists.withColumn("cluster_id", F.lit(0))
    assigned, _ = clusters.cluster_scan(
        embed_households(purchases, panelists, seed=seed), (k,), restarts, seed
    )
    named = assigned.withColumnRenamed("id", "panelist_id")
    return panelists.join(named, "panelist_id", "left").na.fill(0, ["cluster_id"])


# --- analysis and audit ---------------------------------------------------

def analyze_survey(
    responses: DataFrame, catalog: DataFrame, dims: Sequence[str] = tuple(schemas.BREAKDOWN_DIMENSIONS),
    drift: DataFrame | None = None, answer: str = "answer",
) -> DataFrame:
    """Per-question results, run summary, tests per dimension and optional drift as
    one report row. Responses are read through their per-answer counts."""
    results = dist.question_results(responses, catalog, answer)
    tests = stats.chi_square_breakdown(dist.contingency(responses, catalog, list(dims)))
    return store.build_report(results, reports.run_summary(responses), tests, drift)


def provenance(config: Mapping[str, object], digits: int = 64) -> str:
    """SHA-256 of the run configuration with sorted keys, cut to ``digits`` hex digits."""
    import hashlib

    canonical = json.dumps(config, sort_keys=True, default=str)
    return hashlib.sha256(canonical.encode()).hexdigest()[:digits]


def provenance_column(config: F.Column, digits: int = 64) -> F.Column:
    """The same for a table of JSON configurations already in canonical key order."""
    return F.left(F.sha2(config, 256), F.lit(digits))


def audit_record(
    accepted: DataFrame, rejected: DataFrame, catalog: DataFrame, metrics: DataFrame,
    config: Mapping[str, object], answer: str = "answer",
) -> DataFrame:
    """One row: provenance, rates over accepted and rejected answers, and the
    per-question results with their calibration evidence."""
    every = accepted.unionByName(rejected)
    results = dist.question_results(accepted, catalog, answer)
    per = results.groupBy("question_id").agg(
        F.first("entropy").alias("entropy"), F.first("valid_responses").alias("valid_responses")
    ).join(metrics, "question_id", "left")
    listed = F.array_sort(F.collect_list(F.struct(*per.columns)))
    return reports.audit_metrics(every).withColumn(
        "provenance_hash", F.lit(provenance(config, 16))
    ).withColumn("results", one(per, listed))


def survey_chain(
    raw: DataFrame, history: DataFrame, catalog: DataFrame, answer: str = "answer"
) -> DataFrame:
    """Calibration metrics and diversity per question in one plan."""
    pairs, groups = cal.survey_shares(raw, history, catalog, answer)
    entropy = dist.entropies(pairs.withColumn("mass", F.col("p"))).select(
        "question_id", "entropy"
    ).join(
        dist.entropies(cal.calibrate(pairs)).select(
            "question_id", F.col("entropy").alias("calibrated_entropy")
        ),
        "question_id",
    )
    return cal.survey_metrics(pairs, groups).join(stats.diversity_check(entropy), "question_id")

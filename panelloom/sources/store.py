"""Run-scoped working sets, versioned artifacts and exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_VERSION = "1.0"


def _put(df: DataFrame, path: str, key: str, value: str) -> None:
    """Replace one partition of a partitioned table and leave the others alone."""
    (
        df.withColumn(key, F.lit(value))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .parquet(path)
    )


def _get(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    reader = spark.read.option("basePath", path)
    return reader.parquet(path).filter(F.col(key) == F.lit(value)).drop(key)


def save_cohort(df: DataFrame, path: str, run_id: str) -> None:
    _put(df, path, "run_id", run_id)


def load_cohort(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return _get(spark, path, "run_id", run_id)


def save_embeddings(df: DataFrame, path: str, data_version: str) -> None:
    _put(df, path, "data_version", data_version)


def load_embeddings(spark: SparkSession, path: str, data_version: str) -> DataFrame:
    """Rows of exactly this data version; a stale version yields none."""
    return _get(spark, path, "data_version", data_version)


def export_responses(responses: DataFrame, path: str) -> None:
    """Responses as CSV, without the flag list."""
    responses.drop("validation_flags").write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON document per row (results, audit and exploration reports)."""
    df.write.mode("overwrite").json(path)


def _list(df: DataFrame, order: list[str]) -> F.Column:
    """All rows of a small report table as an ordered array."""
    rest = [c for c in df.columns if c not in order]
    return F.array_sort(F.collect_list(F.struct(*order, *rest)))


def build_report(
    results: DataFrame,
    summary: DataFrame,
    breakdowns: DataFrame | None = None,
    drift: DataFrame | None = None,
) -> DataFrame:
    """Versioned one-row report; breakdown and drift sections only when given.

    Its inputs are aggregates (a row per question and option, group or period),
    not answers.
    """
    out = summary.select(
        F.lit(REPORT_VERSION).alias("report_schema_version"),
        F.struct(*summary.columns).alias("summary"),
    ).withColumn("results", results.agg(_list(results, ["question_id"]).alias("v")).scalar())
    if breakdowns is not None:
        section = breakdowns.agg(_list(breakdowns, ["question_id", "dimension"]).alias("v")).scalar()
        out = out.withColumn("demographic_breakdowns", section)
    if drift is not None:
        out = out.withColumn("drift", drift.agg(_list(drift, ["period"]).alias("v")).scalar())
    return out


def export_eda(sections: Mapping[str, DataFrame]) -> DataFrame:
    """One-row exploration report, one JSON section per table."""
    spark = next(iter(sections.values())).sparkSession
    cells = [
        df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("v"))
        .scalar()
        .alias(name)
        for name, df in sections.items()
    ]
    return spark.range(1).select(*cells)

"""Benchmark landings: format checks, column conventions, parquet plus manifest."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom import schemas

# Required fields, field families and size floors per source.
PEW_REQUIRED = ["QKEY", "WEIGHT"]
PEW_FAMILIES = ("F_AGECAT", "F_INC", "F_EDUCCAT", "F_CREGION")
PEW_MIN_ROWS = 1_000
ESS_REQUIRED = ["idno", "cntry"]
ESS_FAMILIES = ("trst", "stf", "imp", "ppl")
TWIN_MIN_PERSONAS = 500
GENERIC_MIN_ROWS = 30
GENERIC_MIN_COLUMNS = 2
PATHS = {"pew": "pew/wave_{0}", "ess": "ess/round_{0}", "twin2k": "twin2k"}


class LandingError(ValueError):
    """The input does not follow the source's convention."""


def _floor(df: DataFrame, rows: int, what: str) -> None:
    """Refuse short input; reads no more than ``rows`` rows."""
    if df.limit(rows).count() < rows:
        raise LandingError(f"{what}: fewer than {rows} rows")


def _stamp(df: DataFrame, source: str, key: str, version: str) -> DataFrame:
    return (
        df.withColumn("source", F.lit(source))
        .withColumn(key, F.lit(str(version)))
        .withColumn("ingested_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    )


def land_pew(df: DataFrame, version: str, min_rows: int = PEW_MIN_ROWS) -> DataFrame:
    missing = [c for c in PEW_REQUIRED if c not in df.columns]
    if missing:
        raise LandingError(f"wave {version}: missing columns {missing}")
    if not any(c.startswith(PEW_FAMILIES) for c in df.columns):
        raise LandingError(f"wave {version}: no demographic field family")
    _floor(df, min_rows, f"wave {version}")
    return _stamp(df.toDF(*[c.lower() for c in df.columns]), "pew_atp", "wave_id", version)


def land_ess(df: DataFrame, version: str) -> DataFrame:
    df = df.toDF(*[c.lower() for c in df.columns])
    missing = [c for c in ESS_REQUIRED if c not in df.columns]
    if missing:
        raise LandingError(f"round {version}: missing columns {missing}")
    if "essround" in df.columns:
        wrong = ~F.col("essround").cast("string").eqNullSafe(F.lit(str(version)))
        if not df.filter(wrong).isEmpty():
            raise LandingError(f"round {version}: round marker mismatch")
    keep = [c for c in df.columns if c in ESS_REQUIRED]
    keep += [c for c in df.columns if c.startswith(ESS_FAMILIES)]
    return _stamp(df.select(*keep), "ess", "round_id", version)


def land_twin2k(
    df: DataFrame, version: str, min_personas: int = TWIN_MIN_PERSONAS
) -> DataFrame:
    """One row per (persona, response) out of nested JSON lines."""
    missing = [c for c in ("persona_id", "responses") if c not in df.columns]
    if missing:
        raise LandingError(f"release {version}: missing keys {missing}")
    holes = F.col("persona_id").isNull() | F.col("responses").isNull()
    if not df.filter(holes).isEmpty():
        raise LandingError(f"release {version}: records without persona or responses")
    _floor(df, min_personas, f"release {version}")
    flat = df.select("persona_id", F.explode("responses").alias("r")).select("r.*", "persona_id")
    return _stamp(flat.toDF(*[c.lower() for c in flat.columns]), "twin2k_500", "release", version)


def snake_case(name: str) -> str:
    return re.sub(" ", "_", name.strip().lower())


def land_generic_csv(df: DataFrame, ref: str) -> DataFrame:
    if len(df.columns) < GENERIC_MIN_COLUMNS:
        raise LandingError(f"{ref}: fewer than {GENERIC_MIN_COLUMNS} columns")
    _floor(df, GENERIC_MIN_ROWS, ref)
    return _stamp(df.toDF(*[snake_case(c) for c in df.columns]), "kaggle", "dataset_ref", ref)


def harmonize(df: DataFrame) -> DataFrame:
    """Map demographic fields onto panel names; two fields for one name coalesce."""
    # Benchmark field to panel attribute.
    mapping = {
        "age_group": ["age_group", "f_agecat", "agea"],
        "income_group": ["income_group", "f_inc_sdt1"],
    }
    out = df
    for target, sources in mapping.items():
        present = [s for s in sources if s in df.columns]
        if present:
            merged = F.coalesce(*[F.col(s) for s in present]) if len(present) > 1 else F.col(present[0])
            out = out.withColumn("__merged", merged).drop(*present)
            out = out.withColumnRenamed("__merged", target)
    return out


def question_columns(df: DataFrame) -> list[str]:
    """Text columns that are neither lineage, key nor demographic."""
    skip = set(schemas.LINEAGE_COLUMNS) | set(schemas.BENCHMARK_KEYS)
    return [n for n, t in df.dtypes if t == "string" and n not in skip]


def landing_path(root: str, source: str, version: str = "") -> str:
    return f"{root.rstrip('/')}/benchmarks/{PATHS[source].format(version)}"


def write_landing(df: DataFrame, root: str, source: str, version: str, url: str = "") -> DataFrame:
    """Write parquet and a one-row manifest; returns the manifest.

    The digest folds one hash per row, so it needs no ordering and no gathering.
    """
    path = landing_path(root, source, version)
    df.write.mode("overwrite").parquet(f"{path}/data")
    written = df.sparkSession.read.parquet(f"{path}/data")
    files = written.select("_metadata.file_path", "_metadata.file_size").distinct()
    manifest = written.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sha2(
            F.concat_ws(
                ":",
                F.count(F.lit(1)),
                F.bit_xor(F.xxhash64(*sorted(written.columns))),
                F.sum(F.pmod(F.hash(*sorted(written.columns)), F.lit(1_000_003)).cast("bigint")),
            ),
            256,
        ).alias("sha256"),
    ).select(
        F.lit(source).alias("source"), F.lit(url).alias("source_url"),
        F.lit(str(version)).alias("version"), F.current_date().alias("download_date"),
        files.agg(F.coalesce(F.sum("file_size"), F.lit(0))).scalar().alias("file_size_bytes"),
        F.lit("parquet").alias("file_format"), "row_count", "sha256",
        F.array(*[F.lit(c) for c in written.columns]).alias("schema_columns"),
    )
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return df.sparkSession.read.json(f"{path}/manifest")


def read_benchmark(
    spark: SparkSession, root: str, source: str, version: str = "", fmt: str = "parquet"
) -> DataFrame:
    if source not in PATHS:
        raise LandingError(f"unknown benchmark source {source!r}")
    path = f"{landing_path(root, source, version)}/data"
    if fmt == "csv":
        return spark.read.option("header", True).csv(path)
    return spark.read.format(fmt).load(path)


def list_landings(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder, from metadata only."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length", "modificationTime")
    )

"""Scans of panel tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom import schemas
from panelloom.functions import expr
from panelloom.session import n_rows, one


def read_panel(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Scan one panel table with its fixed schema; a missing path is an error."""
    if name not in schemas.DATASETS:
        raise ValueError(f"unknown dataset {name!r}")
    schema = schemas.DATASETS[name]
    reader = spark.read.schema(schema)
    if path.rstrip("/").endswith(".csv"):
        return reader.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return reader.parquet(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: int,
    upper: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """Relational scan split on a numeric or date column, so no single task reads it all."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, **options)
        .options(
            partitionColumn=partition_column, lowerBound=lower, upperBound=upper,
            numPartitions=partitions,
        )
        .load()
    )


def scan_panelists(
    panelists: DataFrame,
    filters: Mapping[str, object] | None = None,
    limit: int | None = None,
    cap: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """Equality filters, then at most ``min(limit, cap)`` rows in id order.

    File form: unknown columns are ignored. Warehouse form (``strict``): names
    other than letters, digits and ``_`` are refused. Without ``limit`` and ``cap``
    every row comes back.
    """
    out = panelists
    for name, wanted in (filters or {}).items():
        if strict and not name.replace("_", "").isalnum():
            raise ValueError(f"invalid filter column {name!r}")
        if strict or name in panelists.columns:
            out = out.filter(F.col(name) == F.lit(wanted))
    bounds = [b for b in (limit, cap) if b]
    return out.orderBy("panelist_id").limit(min(bounds)) if bounds else out


def scan_purchases(
    purchases: DataFrame, cohort: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Purchases of a cohort in an optional closed date range."""
    out = purchases
    if start is not None and end is not None:
        out = out.filter(F.col("transaction_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return out.join(cohort.select("panelist_id"), "panelist_id", "left_semi")


def derive_products(purchases: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    out = purchases
    if categories:
        out = out.filter(F.col("product_category").isin(list(categories)))
    return out.groupBy("product_category", "brand").agg(
        F.avg("unit_price").alias("avg_price"), F.count(F.lit(1)).alias("transactions")
    )


def scan_responses(responses: DataFrame, question_ids: Sequence[str] | None = None) -> DataFrame:
    if not question_ids:
        return responses
    return responses.filter(F.col("question_id").isin(list(question_ids)))


def panel_summary(panelists: DataFrame, purchases: DataFrame, responses: DataFrame) -> DataFrame:
    return purchases.agg(
        F.count(F.lit(1)).alias("purchases"),
        F.min("transaction_date").alias("first_purchase"),
        F.max("transaction_date").alias("last_purchase"),
    ).select(
        one(panelists, F.count(F.lit(1))).alias("panelists"),
        "purchases",
        one(responses, F.count(F.lit(1))).alias("survey_responses"),
        "first_purchase",
        "last_purchase",
    )


def data_version(tables: Mapping[str, DataFrame]) -> DataFrame:
    """16 hex digits over ``name:rows`` of each table; changes on every refresh."""
    parts = [
        F.concat(F.lit(f"{name}:"), one(df, F.count(F.lit(1))).cast("string"))
        for name, df in tables.items()
    ]
    spark = next(iter(tables.values())).sparkSession
    digest = F.sha2(F.concat(*parts), 256)
    return spark.range(1).select(F.left(digest, F.lit(16)).alias("data_version"))


def content_version(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of the rows themselves, repeated rows included.

    A row is the text of its columns in the order of their names, nulls marked. Two halves of its
    digest are summed, so equal rows add up where an exclusive or would cancel them.
    """
    cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in sorted(df.columns)]
    digest = F.md5(F.concat_ws("\x1f", *cells))
    halves = [
        F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 16)
    ]
    return df.agg(n_rows().alias("rows"), *[h.alias(f"h{i}") for i, h in enumerate(halves)]).select(
        "rows", F.left(F.sha2(F.concat_ws(":", F.col("rows").cast("string"), "h0", "h1"), 256), F.lit(16)).alias("content")
    )


def file_version(spark: SparkSession, path: str) -> DataFrame:
    """16 hex digits over the size and time of every file under ``path``."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.concat_ws(":", "path", "length", F.unix_micros("modificationTime")).alias("f"))
    )
    # One hash per file is folded, so the listing itself never gathers anywhere.
    return files.agg(F.bit_xor(F.xxhash64("f")).alias("x"), F.count(F.lit(1)).alias("n")).select(
        F.left(F.sha2(F.concat_ws(":", "n", "x"), 256), F.lit(16)).alias("data_version")
    )


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def fetch_rows(
    df: DataFrame, filters: Mapping[str, object], limit: int, order: Sequence[str]
) -> DataFrame:
    """Keyed fetch: equality filters, then the first ``limit`` rows."""
    for name, wanted in filters.items():
        df = df.filter(F.col(name) == F.lit(wanted))
    return df.orderBy(*order).limit(limit)


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Newest row per composite key; ``version`` grows with each write.

    Returns the merged rows; the caller writes them as a new table version.
    """
    both = target.unionByName(updates)
    rest = [c for c in both.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("row"))
    return newest.select(*keys, "row.*").select(*both.columns)


def known_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that the frame lacks."""
    return [c for c in required if c not in df.columns]


def tokens_of(purchases: DataFrame) -> DataFrame:
    """Purchases with their behavior token."""
    return purchases.withColumn(
        "token", expr.behavior_token("product_category", "unit_price", "is_promotion")
    )

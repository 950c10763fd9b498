"""Row contracts and data-quality gates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom import schemas
from panelloom.session import n_rows, one

WARNING, ERROR, CRITICAL = "warning", "error", "critical"


class QualityError(ValueError):
    """Too many rows break their contract, or a gate failed."""


# --- row contracts --------------------------------------------------------

def _known(name: str, scale: Sequence[str]) -> Column:
    return F.col(name).cast("string").isin(list(scale))


def contract(dataset: str, columns: Sequence[str]) -> dict[str, Column]:
    """Field name to predicate; a field that fails names the error."""
    if dataset == "panelists":
        rules = {
            "age_group": _known("age_group", schemas.AGE_GROUPS),
            "income_group": _known("income_group", schemas.INCOME_GROUPS),
            "region": _known("region", schemas.REGIONS),
            "household_size": _known("household_size", schemas.HOUSEHOLD_SIZES),
            "panelist_id": F.length(F.col("panelist_id").cast("string")) > 0,
        }
    elif dataset == "purchases":
        rules = {
            "transaction_date": F.expr("try_cast(transaction_date AS DATE)").isNotNull(),
            "quantity": F.expr("try_cast(quantity AS INT)") >= 1,
            "unit_price": F.expr("try_cast(unit_price AS DOUBLE)") >= 0,
            "total_value": F.expr("try_cast(total_value AS DOUBLE)") >= 0,
        }
    elif dataset == "survey_responses":
        rules = {
            "question_id": F.col("question_id").isNotNull(),
            "panelist_id": F.col("panelist_id").isNotNull(),
            "answer": F.col("answer").isNotNull(),
        }
        if "answer_index" in columns:
            rules["answer_index"] = F.expr("try_cast(answer_index AS INT)").isNotNull()
    else:
        raise QualityError(f"unknown dataset {dataset!r}")
    return rules


@dataclass
class Validated:
    valid: DataFrame
    rejected: DataFrame
    report: DataFrame


def validate_rows(
    df: DataFrame, dataset: str, tolerance: float = 0.05, order: str | None = None
) -> Validated:
    """Split rows by contract. More than ``tolerance`` invalid rows is an error.

    The report holds counts, the fraction and the first error: the first failing
    field of the first invalid row in ``order``, or the lowest field name.
    """
    rules = contract(dataset, df.columns)
    error = F.coalesce(
        *[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()],
    )
    marked = df.withColumn("__error", error)
    first = F.min("__error") if order is None else F.min_by(
        "__error", F.when(F.col("__error").isNotNull(), F.col(order))
    )
    report = marked.agg(
        n_rows().alias("total_rows"),
        F.count("__error").alias("invalid_rows"),
        first.alias("first_error"),
    ).withColumn("invalid_fraction", F.col("invalid_rows") / F.greatest("total_rows", F.lit(1)))
    row = report.first()
    if row["invalid_fraction"] > tolerance:
        raise QualityError(
            f"{dataset}: {row['invalid_fraction']:.1%} invalid rows exceed {tolerance:.1%}; "
            f"first error: {row['first_error']}"
        )
    return Validated(
        marked.filter("__error IS NULL").drop("__error"),
        marked.filter("__error IS NOT NULL").withColumnRenamed("__error", "error"),
        report,
    )


# --- checks ---------------------------------------------------------------

@dataclass
class Check:
    """A named check. ``measure`` is an aggregate column, so that all checks of a
    gate share one pass; ``job`` is for the few that need a frame of their own
    (one row, column ``value``). ``passes`` judges the measured value."""

    name: str
    severity: str
    passes: Callable[[Column], Column]
    measure: Column | None = None
    job: Callable[[DataFrame], DataFrame] | None = None
    detail: str = ""


def _missing(c: str, dtype: str) -> Column:
    null = F.col(c).isNull()
    return null | F.isnan(c) if dtype in ("double", "float") else null


def null_rate(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 0.02) -> Check:
    """Highest null rate over the columns; NaN counts as null."""
    types = dict(df.dtypes)
    present = [c for c in (columns or df.columns) if c in types]
    rates = [F.coalesce(F.avg(_missing(c, types[c]).cast("int")), F.lit(0.0)) for c in present]
    worst = F.greatest(*rates) if len(rates) > 1 else rates[0]
    return Check("null_rate", ERROR, lambda v: v <= limit, measure=worst)


def unique_key(column: str) -> Check:
    """Rows beyond the first per key. Null counts as one value."""
    def job(df: DataFrame) -> DataFrame:
        per = df.groupBy(column).agg(n_rows().alias("n"))
        return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("double").alias("value"))

    return Check("unique_key", CRITICAL, lambda v: v == 0, job=job, detail=column)


def value_range(column: str, low: float, high: float) -> Check:
    """Numbers outside the closed range; what does not parse passes."""
    x = F.expr(f"try_cast(`{column}` AS DOUBLE)")
    outside = F.count_if((x < low) | (x > high)).cast("double")
    return Check("value_range", ERROR, lambda v: v == 0, measure=outside, detail=column)


def distribution_balance(column: str, limit: float = 0.80) -> Check:
    """Share of the most frequent value among non-nulls; an empty frame fails."""
    def job(df: DataFrame) -> DataFrame:
        counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(n_rows().alias("n"))
        return counts.agg((F.max("n") / F.sum("n")).alias("value"))

    return Check("distribution_balance", WARNING, lambda v: v <= limit, job=job, detail=column)


def referential(column: str, parent: DataFrame, key: str) -> Check:
    """Rows whose key is absent from the parent; null is an orphan."""
    def job(df: DataFrame) -> DataFrame:
        # Keys are counted first, so a hot key is one row in the join.
        child = df.groupBy(F.col(column).alias("__k")).agg(n_rows().alias("n"))
        known = parent.select(F.col(key).alias("__k")).distinct()
        return child.join(known, "__k", "left_anti").agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("value")
        )

    return Check("referential_integrity", CRITICAL, lambda v: v == 0, job=job, detail=column)


def freshness(column: str, as_of: str, max_age_days: int = 45) -> Check:
    """Age in days of the newest parseable time; none parseable fails."""
    newest = F.max(F.expr(f"try_cast(`{column}` AS TIMESTAMP)"))
    age = F.date_diff(F.to_date(F.lit(as_of)), newest).cast("double")
    return Check("freshness", WARNING, lambda v: v <= max_age_days, measure=age, detail=column)


def row_count_delta(previous: int, limit: float = 0.5) -> Check:
    """Relative change against the prior load; without one it passes."""
    if previous <= 0:
        return Check("row_count_delta", ERROR, lambda v: v >= 0, measure=F.lit(0.0) + 0 * n_rows())
    delta = F.abs(n_rows() - previous) / previous
    return Check("row_count_delta", ERROR, lambda v: v <= limit, measure=delta)


def required_columns(df: DataFrame, required: Sequence[str]) -> Check:
    missing = [c for c in required if c not in df.columns]
    return Check(
        "schema", CRITICAL, lambda v: v == 0, measure=F.lit(float(len(missing))) + 0 * n_rows(),
        detail=",".join(missing),
    )


def custom(name: str, severity: str, measure: Column, passes: Callable[[Column], Column]) -> Check:
    """A user's own check from an aggregate column."""
    return Check(name, severity, passes, measure=measure)


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check: name, severity, value, passed.

    All aggregate checks run in one pass over the frame.
    """
    fused = [c for c in checks if c.measure is not None]
    rows = []
    if fused:
        wide = df.agg(*[c.measure.cast("double").alias(f"m{i}") for i, c in enumerate(fused)])
        cells = [
            F.struct(
                F.lit(c.name).alias("check_name"), F.lit(c.severity).alias("severity"),
                F.lit(c.detail).alias("detail"), F.col(f"m{i}").alias("value"),
                F.coalesce(c.passes(F.col(f"m{i}")), F.lit(False)).alias("passed"),
            )
            for i, c in enumerate(fused)
        ]
        rows.append(wide.select(F.explode(F.array(*cells)).alias("r")).select("r.*"))
    for c in checks:
        if c.job is None:
            continue
        rows.append(
            c.job(df).select(
                F.lit(c.name).alias("check_name"), F.lit(c.severity).alias("severity"),
                F.lit(c.detail).alias("detail"), F.col("value").cast("double").alias("value"),
                F.coalesce(c.passes(F.col("value")), F.lit(False)).alias("passed"),
            )
        )
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def gate(results: DataFrame) -> DataFrame:
    """Passed, warnings, blocking failures and the verdict."""
    bad = ~F.col("passed")
    blocking = bad & (F.col("severity") != WARNING)
    return results.agg(
        F.count_if("passed").alias("passed"),
        F.count_if(bad & (F.col("severity") == WARNING)).alias("warnings"),
        F.count_if(blocking).alias("failures"),
        (F.count_if(blocking) == 0).alias("ok"),
    )


def quality_card(
    panelists: DataFrame, purchases: DataFrame, key: str, date: str, scale: str, pii: Mapping[str, Column]
) -> DataFrame:
    """Headline quality facts with a real scan for personal data in text columns."""
    types = dict(panelists.dtypes)
    nulls = F.greatest(*[F.avg(_missing(c, types[c]).cast("int")) for c in panelists.columns])
    per = panelists.groupBy(key).agg(n_rows().alias("n"))
    top = panelists.filter(F.col(scale).isNotNull()).groupBy(scale).agg(n_rows().alias("n"))
    hits = F.lit(0)
    for flag in pii.values():
        hits = hits + F.when(flag, 1).otherwise(0)
    return panelists.agg(nulls.alias("max_null_rate"), F.sum(hits).alias("pii_cells")).select(
        "max_null_rate", (F.col("max_null_rate") < 0.02).alias("nulls_ok"),
        one(per, F.max("n") == 1).alias("key_unique"),
        one(purchases, F.count_if(F.col(date).isNull()) == 0).alias("dates_valid"),
        F.bround(one(top, F.max("n") / F.sum("n")), 4).alias("top_share"),
        (one(top, F.max("n") / F.sum("n")) < 0.8).alias("balanced"),
        "pii_cells",
    )

"""Windowed rates, ratios and quantiles over an event log.

Every function takes a batch or a streaming frame with ``event_time``, ``label``,
``value`` and ``failed``. A stream gets a watermark: rows later than it are
dropped by Spark and counted in the query's progress.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.ranking import running_totals
from panelloom.operators import reports
from panelloom.session import n_rows

LATENESS = "10 minutes"


def _timed(events: DataFrame, lateness: str) -> DataFrame:
    return events.withWatermark("event_time", lateness) if events.isStreaming else events


def _span(size: str, slide: str | None) -> Column:
    return F.window("event_time", size, slide) if slide else F.window("event_time", size)


def _bounds(df: DataFrame, *rest: str) -> DataFrame:
    return df.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest
    )


def windowed_rate(
    events: DataFrame, size: str, slide: str | None = None, by: Sequence[str] = ("label",),
    lateness: str = LATENESS,
) -> DataFrame:
    """Count, sum and per-second rate per window and label."""
    out = _timed(events, lateness).groupBy(_span(size, slide).alias("window"), *by).agg(
        n_rows().alias("increase"), F.sum("value").alias("total")
    )
    seconds = F.unix_timestamp(F.col("window.end")) - F.unix_timestamp(F.col("window.start"))
    return _bounds(out.withColumn("rate", F.col("increase") / seconds), *by, "increase", "total", "rate")


def windowed_ratio(
    events: DataFrame, size: str, part: Column, limit: float, whole: Column | None = None,
    slide: str | None = None, lateness: str = LATENESS,
) -> DataFrame:
    """Share of ``part`` among ``whole`` per window, and whether it exceeds ``limit``."""
    of = whole if whole is not None else F.lit(True)
    out = _timed(events, lateness).groupBy(_span(size, slide).alias("window")).agg(
        F.count_if(part & of).alias("part"), F.count_if(of).alias("whole")
    )
    ratio = F.col("part") / F.nullif(F.col("whole"), F.lit(0))
    return _bounds(
        out.withColumn("ratio", ratio).withColumn("breach", F.coalesce(ratio > limit, F.lit(False))),
        "part", "whole", "ratio", "breach",
    )


def windowed_buckets(
    events: DataFrame, size: str, bounds: Sequence[float], by: Sequence[str] = (),
    slide: str | None = None, lateness: str = LATENESS,
) -> DataFrame:
    """Cumulative bucket counts per window, as ``(bound, upto, total)`` rows."""
    timed = _timed(events, lateness).withColumn("window", _span(size, slide))
    return reports.bucket_counts(timed, "value", bounds, ["window", *by])


def windowed_quantile(
    events: DataFrame, size: str, bounds: Sequence[float], quantiles: Sequence[float] = (0.5, 0.95, 0.99),
    by: Sequence[str] = (),
) -> DataFrame:
    """Quantiles per window from its buckets (batch, or inside ``foreachBatch``)."""
    buckets = windowed_buckets(events, size, bounds, by)
    cells = buckets.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    keys = ["window", *by, "q"]
    w = Window.partitionBy(*keys).orderBy("bound")  # one row per bound
    want = F.col("total") * F.col("q")
    steps = cells.select(
        "*",
        F.coalesce(F.lag("upto").over(w), F.lit(0)).alias("before"),
        F.coalesce(F.lag("bound").over(w), F.lit(0.0)).alias("lower"),
    )
    inside = F.when(F.col("upto") == F.col("before"), F.col("bound")).otherwise(
        F.col("lower")
        + (F.col("bound") - F.col("lower")) * (want - F.col("before")) / (F.col("upto") - F.col("before"))
    )
    hit = F.min(F.when(F.col("upto") >= want, F.struct(F.col("bound").alias("at"), inside.alias("v"))))
    out = steps.groupBy(*keys).agg(F.coalesce(hit["v"], F.max("bound")).alias("quantile"))
    return _bounds(out, *by, "q", "quantile")


def throughput_drop(
    events: DataFrame, short: str = "1 hour", long_hours: int = 168, limit: float = 0.5
) -> DataFrame:
    """Hourly throughput against the average of the ``long_hours`` up to that hour.

    Hourly counts are summed first; the long window then runs over a row per hour.
    Hours without events count as zero within the observed span.
    """
    hours = events.groupBy(F.window("event_time", short).alias("window")).agg(n_rows().alias("n"))
    span = hours.agg(
        F.min("window.start").alias("lo"), F.max("window.start").alias("hi")
    ).select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {short}"))).alias("hour"))
    filled = span.join(
        hours.select(F.col("window.start").alias("hour"), "n"), "hour", "left"
    ).na.fill(0, ["n"])
    w = Window.orderBy(F.unix_timestamp("hour")).rangeBetween(-(long_hours - 1) * 3600, 0)
    average = F.sum("n").over(w) / F.lit(float(long_hours))
    return filled.select(
        "hour", "n", average.alias("average"), (F.col("n") < limit * average).alias("dropped")
    )


def held_for(series: DataFrame, key: str, time: str, cond: str, seconds: int) -> DataFrame:
    """Stretches where ``cond`` held without a break for at least ``seconds``.

    Breaks are numbered by slice-wise running counts, so one busy key spreads out.
    """
    marked = running_totals(
        series, [time, *[c for c in series.columns if c not in (key, time)]],
        {"__island": F.when(F.col(cond), 0).otherwise(1)}, [key], "held",
    ).filter(cond)
    out = marked.groupBy(key, "__island").agg(
        F.min(time).alias("since"), F.max(time).alias("until"), n_rows().alias("observations")
    ).drop("__island")
    lasted = F.unix_micros("until") - F.unix_micros("since")
    return out.filter(lasted >= seconds * 1_000_000)

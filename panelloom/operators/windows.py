"""Per-key recency, shares, first hits and bounded results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom import schemas
from panelloom.functions import expr
from panelloom.functions.ranking import running_totals, top_rows


def last_n(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """Newest ``n`` rows per key, cut before the shuffle."""
    return top_rows(df, [key], [F.col(c).desc() for c in order], n)


def share(
    df: DataFrame, within: Sequence[str], by: Sequence[str], amount: Column
) -> DataFrame:
    """Amount per ``by`` as a share of its ``within`` total, over aggregated rows."""
    sums = df.groupBy(*within, *by).agg(amount.alias("amount"))
    return sums.withColumn(
        "share", F.col("amount") / F.sum("amount").over(Window.partitionBy(*within))
    )


def first_fire(
    df: DataFrame, keys: Sequence[str], rule: Column, time: str, event: str
) -> DataFrame:
    """First time each key's rule holds, with the event (lowest id on ties)."""
    first = F.min(F.struct(time, event)).alias("first")
    return df.filter(rule).groupBy(*keys).agg(first).select(
        *keys, F.col(f"first.{time}").alias("first_time"), F.col(f"first.{event}").alias("first_event")
    )


def events_in_window(
    df: DataFrame, key: str, time: str, event: str, seconds: int
) -> DataFrame:
    """Events of the same key in ``(t - seconds, t]``.

    Two running counts over the event log and its time-shifted copy give the
    answer: arrivals up to ``t`` less departures up to ``t``. Both are computed
    slice by slice, so a key with most of the log is spread out. Simultaneous
    events count each other.
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    ticks = df.select(key, us.alias("__at")).groupBy(key, "__at").agg(
        F.count(F.lit(1)).alias("__n")
    )
    leave = ticks.select(key, (F.col("__at") + seconds * 1_000_000).alias("__at"), (-F.col("__n")).alias("__n"))
    net = ticks.unionByName(leave).groupBy(key, "__at").agg(F.sum("__n").alias("__n"))
    levels = running_totals(net, ["__at"], {"recent": F.col("__n")}, [key], "arrivals")
    return df.withColumn("__at", us).join(
        levels.select(key, "__at", "recent"), [key, "__at"]
    ).drop("__at")


def load_delta(loads: DataFrame, load: str, n: str) -> DataFrame:
    """Relative change of each load against the one before (a row per load)."""
    w = Window.orderBy(load)
    before = F.lag(n).over(w)
    return loads.withColumn("previous", before).withColumn(
        "delta", F.abs(F.col(n) - F.col("previous")) / F.col("previous")
    )


def top_n(df: DataFrame, group: str, measure: Column, name: str, n: int) -> DataFrame:
    return df.groupBy(group).agg(measure.alias(name)).orderBy(F.col(name).desc(), group).limit(n)


def order_scale(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows in scale order; values off the scale come last."""
    place = expr.scale_position(column, schemas.SCALES[column])
    return df.withColumn(name, place).orderBy(F.col(name).asc_nulls_last(), column)


def recent(df: DataFrame, time: str, event: str, since: str, n: int) -> DataFrame:
    """Newest ``n`` events at or after ``since``."""
    newer = df.filter(F.col(time) >= F.to_timestamp(F.lit(since)))
    return newer.orderBy(F.col(time).desc(), F.col(event).desc()).limit(n)

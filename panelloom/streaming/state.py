"""Stateful jobs: the alert state machine and sliding-window admission.

Both have a streaming form on Spark's keyed state and a batch form. Alerts of a finished log are
composed from slices of it; admission carries its small state over sorted batches, so a key's
events are never held together in memory.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelloom.functions.ranking import running_totals
from panelloom.session import materialize, small_side, small_table
from panelloom.streaming.windows import LATENESS

# The alert rules, with thresholds of the default configuration.
COOLDOWN_MINUTES = 15
RULES = [
    ("hallucination_rate_critical", "critical", 0.10, 3),
    ("llm_api_error_rate", "critical", 0.20, 1),
    ("prompt_injection_high_risk", "critical", 0.0, 1),
    ("calibration_nonconvergence", "warning", 0.30, 1),
    ("budget_utilization", "warning", 0.80, 1),
    ("data_quality_critical", "warning", 0.0, 1),
    ("latency_p95", "warning", 30.0, 1),
    ("behavioral_drift", "info", 0.0, 1),
    ("throughput_drop", "info", 0.50, 1),
]
RULE_NAMES = ["rule", "severity", "threshold", "required", "cooldown_minutes"]


def alert_rules(spark, cooldown: int = COOLDOWN_MINUTES) -> DataFrame:
    return small_table(spark, [(*r, cooldown) for r in RULES], RULE_NAMES)


def alert_summary(events: DataFrame, rules: DataFrame, since: str | None = None) -> DataFrame:
    """Alerts still active and alerts fired since a time, per severity.

    An alert that fires and resolves at one timestamp is resolved.
    """
    recent = F.lit(True) if since is None else F.col("at") >= F.to_timestamp(F.lit(since))
    fired = events.filter(F.col("kind") == "fired").groupBy("rule").agg(
        F.count_if(recent).alias("fired")
    )
    open_now = events.groupBy("rule").agg(
        (F.max_by("kind", F.struct("at", F.col("kind") != "fired")) == "fired").cast("int").alias("active")
    )
    joined = rules.join(fired, "rule", "left").join(open_now, "rule", "left")
    return joined.groupBy("severity").agg(
        F.coalesce(F.sum("active"), F.lit(0)).alias("active"),
        F.coalesce(F.sum("fired"), F.lit(0)).alias("fired"),
    )


# --- alert state machine ------------------------------------------------------

ALERT_SCHEMA = "rule STRING, at TIMESTAMP, kind STRING, observed DOUBLE"
ALERT_STATE = "firing BOOLEAN, last_fired BIGINT, streak BIGINT"


def step_alert(
    state: tuple[bool, int | None, int], at: int, met: bool, required: int, cooldown_us: int
) -> tuple[tuple[bool, int | None, int], str | None]:
    """One observation: fires after ``required`` breaches in a row outside the
    cooldown, stays silent while firing, resolves on the first clear."""
    firing, last, streak = state
    if not met:
        return (False, last, 0), "resolved" if firing else None
    streak += 1
    cooling = last is not None and at - last < cooldown_us
    if firing or streak < required or cooling:
        return (firing, last, streak), None
    return (True, at, streak), "fired"


def _observe(
    rows: Iterable[tuple], state: tuple[bool, int | None, int]
) -> tuple[list[tuple], tuple[bool, int | None, int]]:
    out = []
    for rule, at, observed, flag, threshold, required, cooldown in rows:
        met = bool(flag) if flag is not None else observed > threshold
        state, kind = step_alert(state, at, met, required, cooldown * 60_000_000)
        if kind:
            out.append((rule, at, kind, observed))
    return out, state



def _prepared(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """``(rule, event_time, observed [, flag])`` joined with its rule; a boolean
    ``flag`` overrides the threshold test."""
    flag = F.col("flag") if "flag" in observations.columns else F.lit(None).cast("boolean")
    return observations.withColumn("flag", flag).join(rules.drop("severity"), "rule").select(
        "rule", "event_time", F.unix_micros("event_time").alias("at_us"), "observed", "flag",
        "threshold", "required", "cooldown_minutes",
    )


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["rule", "at", "kind", "observed"])
    out["at"] = pd.to_datetime(out["at"], unit="us")
    return out


def _carry(
    batches: Iterator[pd.DataFrame], keys: list[str], columns: list[str], fresh: Callable[[], object],
    step: Callable, to_frame: Callable[[list[tuple]], pd.DataFrame],
) -> Iterator[pd.DataFrame]:
    """Run ``step`` over sorted batches, keeping one key's state between them."""
    current, state = None, None
    for batch in batches:
        rows: list[tuple] = []
        for key, part in batch.groupby(keys, sort=False):
            if key != current:
                current, state = key, fresh()
            values = [
                tuple(None if pd.isna(v) else v for v in row)
                for row in part[columns].itertuples(index=False, name=None)
            ]
            out, state = step(values, state)
            rows += out
        yield to_frame(rows)


# A finished log is cut into slices of (rule, time). What a slice does to the state depends on the
# time of the last firing only as far as its first breaches lie within the cooldown of it, so a
# slice boils down to a short table of exits. One pass over these tables gives each slice its
# entry state, and all slices are replayed side by side.

_SLICED = ["rule", "slice", "at_us", "observed", "met", "required", "cooldown_us"]
_STREAKS = "rule STRING, slice INT, cleared BOOLEAN, trailing BIGINT"
_EXITS = "rule STRING, slice INT, firing_in BOOLEAN, at BIGINT, cooldown_us BIGINT, firing BOOLEAN, last BIGINT"
_ENTRY = "rule STRING, slice INT, firing BOOLEAN, last BIGINT"


class _Slice:
    """Observations of one rule in a slice, in order, as arrays; pointers from firing to firing."""

    def __init__(self, rows: pd.DataFrame) -> None:
        rows = rows.sort_values(["at_us", "observed", "met"], kind="stable")
        self.at = rows["at_us"].to_numpy(np.int64)
        self.observed = rows["observed"].to_numpy()
        met = rows["met"].to_numpy(bool)
        n = len(met)
        place = np.arange(n)
        last_clear = np.maximum.accumulate(np.where(met, -1, place))
        streak = place - last_clear
        # Before the first clear, the streak that came in counts too.
        streak = streak + np.where(last_clear < 0, int(rows["entry"].iloc[0]) if "entry" in rows else 0, 0)
        able = met & (streak >= int(rows["required"].iloc[0]))
        self.cooldown = int(rows["cooldown_us"].iloc[0])
        self.clear = self._next(~met)  # first clear at or after a place
        self.able = self._next(able)  # first breach that may fire at or after a place
        self.trailing = int(streak[-1]) if met[-1] else 0
        self.cleared = not met.all()

    @staticmethod
    def _next(mask: np.ndarray) -> np.ndarray:
        n = len(mask)
        at = np.where(mask, np.arange(n), n)
        return np.append(np.minimum.accumulate(at[::-1])[::-1], n)

    def fires_after(self, place: np.ndarray, last: np.ndarray) -> np.ndarray:
        """First breach from ``place`` on that is outside of the cooldown of ``last``."""
        cold = np.searchsorted(self.at, last + self.cooldown)
        return self.able[np.maximum(place, cold)]

    def next_firing(self) -> np.ndarray:
        """Place that fires after a firing at each place; the length if none does."""
        n = len(self.at)
        cleared = np.minimum(self.clear[1:], n)
        return np.where(cleared < n, self.fires_after(np.minimum(cleared + 1, n), self.at), n)

    def exits(self) -> list[tuple]:
        """(firing_in, candidate time, firing, last): for the candidates that can fire first."""
        n = len(self.at)
        step = self.next_firing()
        final = np.where(step < n, step, np.arange(n))
        while (final[final] != final).any():
            final = final[final]
        still = self.clear[np.minimum(final + 1, n)] == n
        out = []
        for firing in (False, True):
            begin = min(int(self.clear[0]) + 1, n) if firing else 0
            out.append((firing, None, firing and not self.cleared, None))
            if firing and not self.cleared:
                continue
            at = int(self.able[begin])
            while at < n:
                # Of candidates with one exit the last is enough: an entry takes the first row from
                # its own time on. Beyond the cooldown of the slice's start one more is enough.
                following = int(self.able[at + 1])
                beyond = self.at[at] >= self.at[0] + self.cooldown
                if beyond or following >= n or final[following] != final[at]:
                    out.append((firing, int(self.at[at]), bool(still[at]), int(self.at[final[at]])))
                if beyond:
                    break
                at = following
        return out

    def replay(self, firing: bool, last: int | None) -> list[tuple]:
        """(place, kind) of all transitions from an entry state."""
        n, out = len(self.at), []
        if firing:
            if not self.cleared:
                return out
            out.append((int(self.clear[0]), "resolved"))
        begin = np.array([int(self.clear[0]) + 1 if firing else 0])
        low = np.array([np.iinfo(np.int64).min // 2 if last is None else last])
        at = int(self.fires_after(begin, low)[0])
        step = self.next_firing()
        while at < n:
            out.append((at, "fired"))
            cleared = int(self.clear[at + 1])
            if cleared < n:
                out.append((cleared, "resolved"))
            at = int(step[at])
        return out


def _entries(tables: pd.DataFrame) -> pd.DataFrame:
    """State at the start of each slice of one rule, from the exits of those before."""
    rows, firing, last = [], False, None
    for number, part in tables.sort_values("slice").groupby("slice"):
        rows.append((part["rule"].iloc[0], number, firing, last))
        own = part[part["firing_in"] == firing]
        timed = own[own["at"].notna()].sort_values("at")
        due = -math.inf if last is None else last + int(part["cooldown_us"].iloc[0])
        hit = timed[timed["at"].astype("int64") >= due]
        if len(hit):
            firing, last = bool(hit["firing"].iloc[0]), int(hit["last"].iloc[0])
        else:
            firing = bool(own[own["at"].isna()]["firing"].iloc[0])
    out = pd.DataFrame(rows, columns=["rule", "slice", "firing", "last"])
    out["last"] = out["last"].astype("Int64")
    return out


def alert_batch(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """Transitions of every rule over a finished log. A rule with most of the observations
    covers most of the slices, and so most of the tasks."""
    spark = observations.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prepared = _prepared(observations, rules).select(
        "rule", "at_us", "observed", F.coalesce("flag", F.col("observed") > F.col("threshold")).alias("met"),
        F.col("required").cast("int").alias("required"),
        (F.col("cooldown_minutes") * 60_000_000).cast("bigint").alias("cooldown_us"),
    )
    stored = materialize(
        prepared.repartitionByRange(slices, "rule", "at_us", "observed")
        .withColumn("slice", F.spark_partition_id()).select(*_SLICED), "alerts",
    )

    def streaks(rows: pd.DataFrame) -> pd.DataFrame:
        own = _Slice(rows)
        return pd.DataFrame(
            [(rows["rule"].iloc[0], rows["slice"].iloc[0], own.cleared, own.trailing)],
            columns=["rule", "slice", "cleared", "trailing"],
        )

    # One row per rule and slice, here and in the entries below: windows over rules are short.
    ends = stored.groupBy("rule", "slice").applyInPandas(streaks, _STREAKS)
    before = Window.partitionBy("rule").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    group = F.coalesce(F.sum(F.col("cleared").cast("int")).over(before), F.lit(0))
    inside = Window.partitionBy("rule", "__group").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    reset = Window.partitionBy("rule").orderBy("slice")
    entry = (
        ends.withColumn("__group", group)
        # What the slice with the last clear ends with, and all breaches since.
        .withColumn("__carried", F.when(F.lag("cleared").over(reset), F.lag("trailing").over(reset)))
        .withColumn("__base", F.first("__carried", ignorenulls=True).over(
            Window.partitionBy("rule", "__group").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("entry", F.coalesce("__base", F.lit(0)) + F.coalesce(F.sum("trailing").over(inside), F.lit(0)))
        .select("rule", "slice", "entry")
    )
    sliced = stored.join(small_side(entry, "alert-streaks"), ["rule", "slice"])

    def exits(rows: pd.DataFrame) -> pd.DataFrame:
        own = _Slice(rows)
        out = [(rows["rule"].iloc[0], rows["slice"].iloc[0], f, at, own.cooldown, g, last) for f, at, g, last in own.exits()]
        frame = pd.DataFrame(out, columns=["rule", "slice", "firing_in", "at", "cooldown_us", "firing", "last"])
        return frame.astype({"at": "Int64", "last": "Int64"})

    tables = sliced.groupBy("rule", "slice").applyInPandas(exits, _EXITS)
    states = small_side(tables.groupBy("rule").applyInPandas(_entries, _ENTRY), "alert-entries")

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        own, last = _Slice(rows), rows["last"].iloc[0]
        found = own.replay(bool(rows["firing"].iloc[0]), None if pd.isna(last) else int(last))
        return _frame([(rows["rule"].iloc[0], own.at[i], kind, own.observed[i]) for i, kind in found])

    return sliced.join(states, ["rule", "slice"]).groupBy("rule", "slice").applyInPandas(replay, ALERT_SCHEMA)


def _in_order(held: list[tuple], frames: Iterable[pd.DataFrame], columns: list[str], upto_us: int):
    """Rows that are final at this watermark, in order, and the rows that still wait.

    A row waits until the watermark has passed its time: nothing older can follow then, so
    the rows of several micro-batches are stepped in event time, as in the batch form.
    """
    for part in frames:
        held += [
            tuple(None if pd.isna(v) else v for v in row)
            for row in part[columns].itertuples(index=False, name=None)
        ]
    held.sort()
    ready = [row for row in held if row[0] <= upto_us]
    return ready, held[len(ready) :]


_WAITING = "wait_at ARRAY<BIGINT>, wait_observed ARRAY<DOUBLE>, wait_met ARRAY<BOOLEAN>"


def alert_stream(observations: DataFrame, rules: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The same over a stream: a rule's state and its observations that are not final yet.

    Observations behind the watermark are dropped by Spark, which counts them in the progress
    of the query (see ``live.run_available``).
    """
    prepared = _prepared(observations.withWatermark("event_time", lateness), rules)
    prepared = prepared.withColumn("met", F.coalesce("flag", F.col("observed") > F.col("threshold")))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        firing, last, streak, required, cooldown, *waiting = (
            state.get if state.exists else (False, None, 0, 1, 0, [], [], [])
        )
        frames = [] if state.hasTimedOut else list(frames)
        for part in frames:
            required, cooldown = int(part["required"].iloc[0]), int(part["cooldown_minutes"].iloc[0])
        mark = state.getCurrentWatermarkMs()
        ready, left = _in_order(
            list(zip(*waiting)), frames, ["at_us", "observed", "met"], mark * 1000
        )
        values = [(key[0], at, observed, met, None, required, cooldown) for at, observed, met in ready]
        out, (firing, last, streak) = _observe(values, (firing, last, streak))
        state.update((firing, last, streak, required, cooldown, *([r[i] for r in left] for i in range(3))))
        if left:
            state.setTimeoutTimestamp(max(left[0][0] // 1000, mark + 1))
        yield _frame(out)

    return prepared.groupBy("rule").applyInPandasWithState(
        update, ALERT_SCHEMA, f"{ALERT_STATE}, required INT, cooldown INT, {_WAITING}", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


# --- admission ------------------------------------------------------------------

ADMIT_SCHEMA = "key STRING, event_id BIGINT, at_us BIGINT, admitted BOOLEAN"


def step_admit(times: deque, at: int, limit: int, window_us: int) -> bool:
    """Admit when fewer than ``limit`` admitted events lie in ``(at - window, at]``."""
    while times and times[0] <= at - window_us:
        times.popleft()
    if len(times) >= limit:
        return False
    times.append(at)
    return True


def admit_batch(
    events: DataFrame, key: str, time: str, event: str, limit: int, seconds: int
) -> DataFrame:
    """Which events a limiter admits; refused events do not count.

    A gap of a whole window empties the limiter, so stretches between gaps are
    independent and spread over tasks even for one busy key. A stretch that never
    has more than ``limit`` events in any window admits all of them without a
    simulation.
    """
    window_us = seconds * 1_000_000
    rows = events.select(
        F.col(key).cast("string").alias("key"), F.col(event).cast("bigint").alias("event_id"),
        F.unix_micros(time).alias("at_us"),
    )
    # Arrivals and window ends per key: a stretch starts where nothing is in the window.
    ticks = rows.groupBy("key", "at_us").agg(F.count(F.lit(1)).alias("n"))
    ends = ticks.select("key", (F.col("at_us") + window_us).alias("at_us"), (-F.col("n")).alias("n"))
    net = ticks.unionByName(ends).groupBy("key", "at_us").agg(
        F.sum("n").alias("net"), F.sum(F.greatest("n", F.lit(0))).alias("arrived")
    )
    levels = running_totals(net, ["at_us"], {"level": F.col("net")}, ["key"], "admit-levels")
    starts = (F.col("arrived") > 0) & (F.col("level") == F.col("arrived"))
    stretches = running_totals(
        levels, ["at_us"], {"stretch": starts.cast("bigint")}, ["key"], "admit-stretches"
    ).filter("arrived > 0")
    peaks = stretches.groupBy("key", "stretch").agg(F.max("level").alias("peak"))
    # Stored, so that the repartition below is a shuffle of its own: one that a join already implies
    # is left out of the plan, and a join turned into a broadcast then cuts stretches in two.
    placed = materialize(
        rows.join(stretches.select("key", "at_us", "stretch"), ["key", "at_us"]).join(peaks, ["key", "stretch"]),
        "admit-placed",
    )
    free = placed.filter(F.col("peak") <= limit).select(
        "key", "event_id", "at_us", F.lit(True).alias("admitted")
    )
    busy = (
        placed.filter(F.col("peak") > limit)
        .repartition("key", "stretch")
        .sortWithinPartitions("key", "stretch", "at_us", "event_id")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def step(values: list[tuple], times: deque) -> tuple[list[tuple], deque]:
            return [(*v, step_admit(times, v[2], limit, window_us)) for v in values], times

        def to_frame(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=["key", "event_id", "at_us", "admitted"])

        return _carry(
            batches, ["key", "stretch"], ["key", "event_id", "at_us"], deque, step, to_frame
        )

    return free.unionByName(busy.mapInPandas(run, ADMIT_SCHEMA))


def admit_stream(
    events: DataFrame, key: str, time: str, event: str, limit: int, seconds: int,
    lateness: str = LATENESS,
) -> DataFrame:
    """The same over a stream, in event time: events wait until the watermark has passed them.
    Besides them, state holds at most ``limit`` times per key, and goes once the watermark
    passes the window. Events behind the watermark are dropped and counted by Spark."""
    window_us = seconds * 1_000_000
    rows = events.withWatermark(time, lateness).select(
        F.col(key).cast("string").alias("key"), F.col(event).cast("bigint").alias("event_id"),
        F.col(time).alias("event_time"), F.unix_micros(time).alias("at_us"),
    )

    def update(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, *waiting = state.get if state.exists else ([], [], [])
        times = deque(held)
        mark = state.getCurrentWatermarkMs()
        ready, left = _in_order(
            list(zip(*waiting)), [] if state.hasTimedOut else frames, ["at_us", "event_id"], mark * 1000
        )
        out = [(name[0], event, at, step_admit(times, at, limit, window_us)) for at, event in ready]
        while times and times[0] <= mark * 1000 - window_us:
            times.popleft()
        if left or times:
            state.update((list(times), [r[0] for r in left], [r[1] for r in left]))
            until = left[0][0] if left else times[-1] + window_us
            state.setTimeoutTimestamp(max(until // 1000, mark) + 1)
        else:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "event_id", "at_us", "admitted"])

    return rows.groupBy("key").applyInPandasWithState(
        update, ADMIT_SCHEMA, "times ARRAY<BIGINT>, wait_at ARRAY<BIGINT>, wait_id ARRAY<BIGINT>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )

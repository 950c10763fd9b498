"""Queries over the event log: windows, alerts, admission and live jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.catalog.aggregates import BOUNDS, catalog_of, r6
from panelloom.catalog.base import folder, query
from panelloom.catalog.screening import _RED, _flags
from panelloom.catalog.statistics import drift_decision_sql
from panelloom.streaming import live, state, windows

_HOUR = "time_bucket(INTERVAL '1 hour', event_time)"


@query(
    "k01_windowed_rate",
    f"""SELECT {_HOUR} AS window_start, {_HOUR} + INTERVAL '1 hour' AS window_end, label,
    count(*) AS increase, round(sum(value), 4) AS total, round(count(*) / CAST(3600 AS DOUBLE), 6) AS rate
    FROM calls GROUP BY ALL""",
    ("calls",),
)
def _(t):
    out = windows.windowed_rate(t.calls, "1 hour")
    return r6(out, "rate").withColumn("total", F.round("total", 4))


@query(
    "k01_sliding_rate",
    """SELECT w AS window_start, w + INTERVAL '1 day' AS window_end, label, count(*) AS increase,
    round(sum(value), 4) AS total, round(count(*) / CAST(86400 AS DOUBLE), 6) AS rate FROM (SELECT *,
    unnest([time_bucket(INTERVAL '12 hours', event_time), time_bucket(INTERVAL '12 hours', event_time)
    - INTERVAL '12 hours']) AS w FROM calls) GROUP BY ALL""",
    ("calls",),
)
def _(t):
    out = windows.windowed_rate(t.calls, "1 day", "12 hours")
    return r6(out, "rate").withColumn("total", F.round("total", 4))


@query(
    "k02_windowed_ratio",
    f"""SELECT {_HOUR} AS window_start, {_HOUR} + INTERVAL '1 hour' AS window_end,
    count(*) FILTER (WHERE failed) AS part, count(*) AS whole, round(count(*) FILTER (WHERE failed) /
    CAST(count(*) AS DOUBLE), 6) AS ratio, count(*) FILTER (WHERE failed) / CAST(count(*) AS DOUBLE) >
    CAST(0.2 AS DOUBLE) AS breach FROM calls GROUP BY ALL""",
    ("calls",),
)
def _(t):
    return r6(windows.windowed_ratio(t.calls, "1 hour", F.col("failed"), 0.2), "ratio")


@query(
    "k02_stream_ratio",
    f"""SELECT {_HOUR} AS window_start, {_HOUR} + INTERVAL '1 hour' AS window_end,
    count(*) FILTER (WHERE failed) AS part, count(*) AS whole, round(count(*) FILTER (WHERE failed) /
    CAST(count(*) AS DOUBLE), 6) AS ratio, count(*) FILTER (WHERE failed) / CAST(count(*) AS DOUBLE) >
    CAST(0.2 AS DOUBLE) AS breach FROM calls GROUP BY ALL""",
    ("calls",),
)
def _(t):
    # The same job as a stream, run to the end of what is there.
    stream = live.read_stream(t.spark, f"{t.sf_dir}/events.parquet").select(
        F.col("ts").cast("timestamp").alias("event_time"), "value",
        (F.col("event_type") == "error").alias("failed"),
    )
    out = windows.windowed_ratio(stream, "1 hour", F.col("failed"), 0.2)
    rows = live.run_available(out, folder(t, "ratio"), "update")
    keys = ["window_start", "window_end"]
    newest = F.max_by(F.struct("part", "whole", "ratio", "breach"), "batch").alias("r")
    return r6(rows.groupBy(*keys).agg(newest).select(*keys, "r.*"), "ratio")


def _quantile_sql(q: str) -> str:
    bounds = ", ".join(f"CAST({b} AS DOUBLE)" for b in BOUNDS)
    return f"""SELECT window_start, CAST({q} AS DOUBLE) AS q, coalesce(arg_min(CASE WHEN upto = before THEN
    bound ELSE lower + (bound - lower) * (CAST({q} AS DOUBLE) * total - before) / (upto - before) END, bound)
    FILTER (WHERE upto >= CAST({q} AS DOUBLE) * total), max(bound)) AS quantile FROM (SELECT *,
    coalesce(lag(upto) OVER w, 0) AS before, coalesce(lag(bound) OVER w, 0) AS lower FROM
    (SELECT window_start, bound, count(*) FILTER (WHERE value <= bound) AS upto, count(*) AS total FROM
    (SELECT time_bucket(INTERVAL '1 day', event_time) AS window_start, value, unnest([{bounds}]) AS bound
    FROM calls) GROUP BY ALL) WINDOW w AS (PARTITION BY window_start ORDER BY bound)) GROUP BY window_start"""


@query(
    "k03_windowed_quantile",
    "SELECT window_start, window_start + INTERVAL '1 day' AS window_end, q, round(quantile, 6) AS quantile "
    "FROM (" + " UNION ALL ".join(_quantile_sql(q) for q in ("0.5", "0.95", "0.99")) + ")",
    ("calls",),
)
def _(t):
    return r6(windows.windowed_quantile(t.calls, "1 day", BOUNDS), "quantile")


@query(
    "k04_throughput_drop",
    """WITH h AS (SELECT time_bucket(INTERVAL '1 hour', event_time) AS hour, count(*) AS n FROM calls
    GROUP BY 1), f AS (SELECT g.hour, coalesce(h.n, 0) AS n FROM (SELECT unnest(generate_series(
    (SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL '1 hour')) AS hour) g LEFT JOIN h
    USING (hour)), a AS (SELECT hour, n, sum(n) OVER (ORDER BY hour RANGE BETWEEN INTERVAL '167 hours'
    PRECEDING AND CURRENT ROW) / CAST(168 AS DOUBLE) AS average FROM f) SELECT hour, n,
    round(average, 6) AS average, n < CAST(0.5 AS DOUBLE) * average AS dropped FROM a""",
    ("calls",),
)
def _(t):
    return r6(windows.throughput_drop(t.calls), "average")


@query(
    "k05_held_for",
    """WITH e AS (SELECT label, event_time, event_id, value, value > 20 AS c, row_number() OVER
    (PARTITION BY label ORDER BY event_time, value, event_id) - row_number() OVER (PARTITION BY label,
    value > 20 ORDER BY event_time, value, event_id) AS isl FROM calls) SELECT label,
    min(event_time) AS since, max(event_time) AS until, count(*) AS observations FROM e WHERE c
    GROUP BY label, isl HAVING max(event_time) - min(event_time) >= INTERVAL '1 hour'""",
    ("calls",),
)
def _(t):
    series = t.calls.select("label", "event_time", "value", "event_id").withColumn(
        "c", F.col("value") > 20
    )
    return windows.held_for(series, "label", "event_time", "c", 3_600)


def _observations(t):
    names = [r[0] for r in state.RULES]
    place = F.pmod(F.col("event_id"), F.lit(len(names))) + 1
    return t.calls.select(
        F.element_at(F.array(*[F.lit(n) for n in names]), place.cast("int")).alias("rule"),
        "event_time", (F.col("value") / 50.0).alias("observed"),
    )


_RULE_ROWS = ", ".join(
    f"({i}, '{n}', '{s}', CAST({x} AS DOUBLE), {r})" for i, (n, s, x, r) in enumerate(state.RULES)
)
#: The state machine, one observation of every rule per step.
_ALERTS = f"""WITH RECURSIVE r(place, rule, severity, threshold, required) AS (VALUES {_RULE_ROWS}),
  o AS (SELECT rule, CAST(ts AS TIMESTAMP) AS seen, value / 50.0 AS observed, value / 50.0 > threshold AS met,
    required, row_number() OVER (PARTITION BY rule ORDER BY ts, value) AS i
    FROM events JOIN r ON event_id % {len(state.RULES)} = place),
  n AS (SELECT r.rule, CAST(0 AS BIGINT) AS i, false AS firing, CAST(NULL AS TIMESTAMP) AS last,
    CAST(0 AS BIGINT) AS streak, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS TIMESTAMP) AS seen,
    CAST(NULL AS DOUBLE) AS observed FROM r
    UNION ALL SELECT rule, i, met AND (firing OR fires), CASE WHEN fires THEN seen ELSE last END,
    CASE WHEN met THEN streak + 1 ELSE 0 END,
    CASE WHEN fires THEN 'fired' WHEN firing AND NOT met THEN 'resolved' END, seen, observed
    FROM (SELECT o.*, n.firing, n.last, n.streak, o.met AND NOT n.firing AND n.streak + 1 >= o.required
      AND (n.last IS NULL OR o.seen - n.last >= INTERVAL {state.COOLDOWN_MINUTES} MINUTE) AS fires
      FROM n JOIN o ON o.rule = n.rule AND o.i = n.i + 1)),
  alerts AS (SELECT rule, seen, kind, observed FROM n WHERE kind IS NOT NULL)
"""
#: Observations within the lateness of the newest one are not final when a stream stops.
_FINAL = "(SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 10 MINUTE FROM events)"


_TRANSITIONS = _ALERTS + 'SELECT rule, seen AS "at", kind, observed FROM alerts'


@query("k06_alert_batch", _TRANSITIONS)
def _(t):
    return state.alert_batch(_observations(t), state.alert_rules(t.spark))


def _in_turn(t, name: str):
    """The events as four files that overlap by a few minutes, read one per trigger."""
    events = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").select(
        "event_id", F.col("ts").cast("timestamp").alias("event_time"), "value", "user_id"
    )
    jitter = F.unix_micros("event_time") + F.pmod(F.xxhash64("event_id"), F.lit(300_000_000))
    path = live.write_in_turn(events, folder(t, name), 4, jitter)
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("k06_alert_stream", f"{_TRANSITIONS} WHERE seen <= {_FINAL}")
def _(t):
    names = [r[0] for r in state.RULES]
    place = F.pmod(F.col("event_id"), F.lit(len(names))) + 1
    observed = _in_turn(t, "alerts-in").select(
        F.element_at(F.array(*[F.lit(n) for n in names]), place.cast("int")).alias("rule"),
        "event_time", (F.col("value") / 50.0).alias("observed"),
    )
    out = state.alert_stream(observed, state.alert_rules(t.spark))
    return live.run_available(out, folder(t, "alerts")).drop("batch")


@query(
    "k07_alert_summary",
    _ALERTS + """SELECT severity, CAST(coalesce(sum(active), 0) AS BIGINT) AS active,
    CAST(coalesce(sum(fired), 0) AS BIGINT) AS fired FROM r LEFT JOIN (SELECT rule,
    CAST(count(*) FILTER (WHERE kind = 'fired' AND seen >= TIMESTAMP '2024-01-15') AS BIGINT) AS fired,
    CAST(max_by(kind, {'seen': seen, 'last': kind <> 'fired'}) = 'fired' AS BIGINT) AS active
    FROM alerts GROUP BY rule) USING (rule) GROUP BY severity""",
)
def _(t):
    rules = state.alert_rules(t.spark)
    return state.alert_summary(state.alert_batch(_observations(t), rules), rules, "2024-01-15")


@query(
    "k07_alert_rules",
    "SELECT severity, count(*) AS breaches FROM (SELECT ["
    + ", ".join(f"'{s}'" for _, s, _, _ in state.RULES)
    + "][event_id % 9 + 1] AS severity, value / 50 > ["
    + ", ".join(f"CAST({x} AS DOUBLE)" for _, _, x, _ in state.RULES)
    + "][event_id % 9 + 1] AS b FROM calls) WHERE b GROUP BY 1",
    ("calls",),
)
def _(t):
    joined = _observations(t).join(state.alert_rules(t.spark), "rule")
    return joined.filter(F.col("observed") > F.col("threshold")).groupBy("severity").agg(
        F.count(F.lit(1)).alias("breaches")
    )


#: The limiter, one event of every key per step.
_ADMITTED = """WITH RECURSIVE o AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id,
    CAST(ts AS TIMESTAMP) AS seen, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  n AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id,
    CAST(NULL AS TIMESTAMP) AS seen, CAST([] AS TIMESTAMP[]) AS times, false AS admitted FROM o
    UNION ALL SELECT key, i, event_id, seen, CASE WHEN len(held) < 2 THEN list_append(held, seen) ELSE held END,
    len(held) < 2 FROM (SELECT o.*, list_filter(n.times, lambda x: x > o.seen - INTERVAL 1 DAY) AS held
      FROM n JOIN o ON o.key = n.key AND o.i = n.i + 1))
SELECT key, event_id, epoch_us(seen) AS at_us, admitted FROM n WHERE i > 0"""


@query("k08_admit_batch", _ADMITTED)
def _(t):
    return state.admit_batch(t.calls, "key", "event_time", "event_id", 2, 86_400)


@query(
    "k08_admit_all",
    """SELECT key, event_id, epoch_us(event_time) AS at_us, true AS admitted FROM calls""",
    ("calls",),
)
def _(t):
    # A limit no window reaches admits everything.
    return state.admit_batch(t.calls, "key", "event_time", "event_id", 1_000_000, 60)


@query("k08_admit_stream", f"{_ADMITTED} AND seen <= {_FINAL}")
def _(t):
    stream = _in_turn(t, "admit-in").select(
        "event_id", "event_time", F.col("user_id").cast("string").alias("key")
    )
    out = state.admit_stream(stream, "key", "event_time", "event_id", 2, 86_400)
    return live.run_available(out, folder(t, "admit")).drop("batch")


@query(
    "k09_drift_stream",
    # Periods of 30 days since the epoch, closed once the watermark of 31 days has passed their end.
    drift_decision_sql(
        "3",
        """SELECT strftime(DATE '1970-01-01' + CAST(p * 30 AS INTEGER), '%Y-%m-%d') AS period, c, count(*) AS n
        FROM (SELECT (CAST(l_shipdate AS DATE) - DATE '1970-01-01') // 30 AS p, p_type AS c,
        max(CAST(l_shipdate AS DATE) - DATE '1970-01-01') OVER () AS newest FROM lineitem JOIN part
        ON l_partkey = p_partkey) WHERE (p + 1) * 30 <= newest - 31 GROUP BY ALL""",
    ),
)
def _(t):
    parts = t.spark.read.parquet(f"{t.sf_dir}/part.parquet").select("p_partkey", "p_type")
    stream = live.read_stream(t.spark, f"{t.sf_dir}/lineitem.parquet").join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    ).select(F.to_date("l_shipdate").alias("transaction_date"), F.col("p_type").alias("product_category"))
    path = folder(t, "drift")
    live.drift_stream(stream, path).awaitTermination()
    return live.latest(t.spark, path, "decision")


@query(
    "k10_live_distribution",
    """SELECT question_id, option_idx, option, count(*) AS count FROM (SELECT 'q_' || o_orderstatus
    AS question_id, o_orderpriority AS option, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1
    AS option_idx FROM orders) GROUP BY ALL""",
)
def _(t):
    # The stream carries every answer twice; each id counts once.
    stream = live.read_stream(t.spark, f"{t.sf_dir}/orders.parquet").select(
        F.explode(F.array_repeat(F.col("o_orderkey"), 2)).alias("response_id"),
        F.concat(F.lit("q_"), "o_orderstatus").alias("question_id"),
        F.col("o_orderpriority").alias("answer"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
    )
    out = live.live_distribution(stream, catalog_of(t), "at")
    rows = live.run_available(out, folder(t, "live"), "update")
    return rows.groupBy("question_id", "option_idx", "option").agg(
        F.max_by("count", "batch").alias("count")
    )


@query(
    "k11_screen_stream",
    f"SELECT id, {_flags(_RED)} AS flags FROM (SELECT doc_id AS id, text || ' ' AS text FROM documents)",
)
def _(t):
    stream = live.read_stream(t.spark, f"{t.sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("text").alias("answer"), F.lit("").alias("reasoning")
    )
    out = live.screen_stream(stream).select("id", F.array_join("red_team_flags", ",").alias("flags"))
    return live.run_available(out, folder(t, "screen")).drop("batch")

import random
from collections import deque
from datetime import UTC, datetime, timedelta

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from panelloom.streaming import live, state, windows

START = datetime(2026, 1, 1)


def replay(rows, limit, seconds):
    """Plain replay of the admission rule."""
    held, out = {}, {}
    for key, event, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        times = held.setdefault(key, deque())
        while times and times[0] <= at - seconds:
            times.popleft()
        out[event] = len(times) < limit
        if out[event]:
            times.append(at)
    return out


@pytest.mark.parametrize("limit,seconds", [(3, 60), (1, 10), (50, 600)])
def test_admission_equals_replay(spark, limit, seconds):
    rng = random.Random(11)
    rows, at = [], {"hot": 0, "cold": 0}
    for i in range(900):
        key = "hot" if rng.random() < 0.7 else "cold"
        at[key] += rng.choice([0, 1, 5, 20, 90])
        rows.append((key, i, at[key]))
    df = spark.createDataFrame(rows, "key string, event_id bigint, s bigint").withColumn("t", F.timestamp_seconds("s"))
    out = state.admit_batch(df, "key", "t", "event_id", limit, seconds)
    got = {r["event_id"]: r["admitted"] for r in out.collect()}
    assert got == replay(rows, limit, seconds)


def alerts(spark, values, required=1, cooldown=15, flags=None):
    rows = [("r", START + timedelta(minutes=m), float(v)) for m, v in values]
    df = spark.createDataFrame(rows, "rule string, event_time timestamp, observed double")
    if flags is not None:
        df = df.withColumn("flag", F.col("observed") > 0)
    rules = spark.createDataFrame([("r", "info", 0.5, required, cooldown)], "rule string, severity string, threshold double, required int, cooldown_minutes int")
    out = state.alert_batch(df, rules).orderBy("at").collect()
    return [(int((r["at"] - START).total_seconds() // 60), r["kind"]) for r in out]


def test_alert_fires_once_and_resolves(spark):
    assert alerts(spark, [(0, 1), (1, 1), (2, 1), (3, 0), (4, 0)]) == [(0, "fired"), (3, "resolved")]


def test_alert_needs_its_streak(spark):
    assert alerts(spark, [(0, 1), (1, 1), (2, 0), (3, 1), (4, 1), (5, 1), (6, 0)], required=3) == [
        (5, "fired"), (6, "resolved"),
    ]


def test_alert_cooldown_counts_from_the_last_firing(spark):
    values = [(0, 1), (1, 0), (2, 1), (10, 1), (15, 1), (16, 0)]
    assert alerts(spark, values) == [(0, "fired"), (1, "resolved"), (15, "fired"), (16, "resolved")]


def test_boolean_observation_overrides_the_threshold(spark):
    assert alerts(spark, [(0, 0.2), (1, -1)], flags=True) == [(0, "fired"), (1, "resolved")]


def test_decisive_rows_keep_the_machine_exact(spark):
    rng = random.Random(2)
    for required in (1, 3):
        values = [(i * rng.choice([1, 1, 2]) + i, rng.choice([0, 1, 1])) for i in range(300)]
        values = sorted(dict(values).items())
        held, want = (False, None, 0), []
        for m, v in values:
            held, kind = state.step_alert(held, m * 60_000_000, v > 0.5, required, 15 * 60_000_000)
            if kind:
                want.append((m, kind))
        assert alerts(spark, values, required) == want


def write_days(spark, path, days):
    for n, rows in enumerate(days):
        spark.createDataFrame(rows, "response_id string, question_id string, answer string, at timestamp").coalesce(1).write.mode("append").parquet(path)
        assert n >= 0


def test_live_distribution_counts_each_id_once(spark, tmp_path):
    path = str(tmp_path / "in")
    days = [
        [("1", "q", "yes", START), ("2", "q", "no", START)],
        [("1", "q", "yes", START), ("3", "q", "yes", START + timedelta(hours=1))],
    ]
    write_days(spark, path, days)
    catalog = spark.createDataFrame([("q", ["yes", "no"])], "question_id string, options array<string>")
    out = live.live_distribution(live.read_stream(spark, path, 1), catalog, "at")
    rows = live.run_available(out, str(tmp_path / "out"), "update")
    newest = rows.groupBy("option").agg(F.max_by("count", "batch").alias("n"))
    assert {r["option"]: r["n"] for r in newest.collect()} == {"yes": 2, "no": 1}


def final(spark, rows, at):
    """Rows whose time the watermark of the last micro-batch has passed."""
    newest = spark.read.parquet(f"{SMALL}/events.parquet").agg(F.max("ts").cast("timestamp")).first()[0]
    return {r for r in rows if at(r) <= newest - timedelta(minutes=10)}


def test_stream_and_batch_alerts_agree(spark, tables):
    import __spark_entry__ as registry

    queries = registry.queries()
    batch = {tuple(r) for r in queries["k06_alert_batch"](spark, SMALL).collect()}
    stream = {tuple(r) for r in queries["k06_alert_stream"](spark, SMALL).collect()}
    assert final(spark, batch, lambda r: r[1]) == stream


def test_admission_shuffles_stretches_whole(spark, tmp_path):
    """A join's partitions may be cut while running; only a shuffle of its own keeps stretches whole."""
    spark.range(3_000).select(
        (F.col("id") % 31).cast("string").alias("key"), F.col("id").alias("event_id"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 3 + F.col("id") % 7 * 400).alias("t"),
    ).write.parquet(f"{tmp_path}/events")
    stored = spark.read.parquet(f"{tmp_path}/events")
    rows = [tuple(r) for r in stored.select("key", "event_id", F.unix_seconds("t")).collect()]
    found = state.admit_batch(stored, "key", "t", "event_id", 2, 1_000)
    assert "REPARTITION_BY_COL" in found._jdf.queryExecution().executedPlan().toString()
    assert {r["event_id"]: r["admitted"] for r in found.collect()} == replay(rows, 2, 1_000)


def test_stream_and_batch_admission_agree(spark, tables):
    import __spark_entry__ as registry

    queries = registry.queries()
    batch = {tuple(r) for r in queries["k08_admit_batch"](spark, SMALL).collect()}
    stream = {tuple(r) for r in queries["k08_admit_stream"](spark, SMALL).collect()}
    assert final(spark, batch, lambda r: datetime.fromtimestamp(r[2] / 1e6, UTC).replace(tzinfo=None)) == stream


def files_of(spark, path, schema, batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streams_step_in_event_time_over_files(spark, tmp_path):
    """Rows shuffled across files, each within the lateness, give what the batch form gives; a
    row far behind the watermark is counted as late."""
    rng = random.Random(8)
    rows = [("r", START + timedelta(seconds=20 * i), float(rng.random() < 0.8), "hot", i) for i in range(600)]
    dealt = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(500)))
    batches = [dealt[i : i + 120] for i in range(0, 600, 120)]
    assert any(a[-1] > b[0] for a, b in zip(map(sorted, batches), map(sorted, batches[1:])))
    batches.append([("r", START, 1.0, "hot", -1)])
    schema = "rule string, event_time timestamp, observed double, key string, event_id bigint"
    path = str(tmp_path / "in")
    stream = files_of(spark, path, schema, batches)
    edge = rows[-1][1] - timedelta(minutes=10)
    rules = spark.createDataFrame(
        [("r", "info", 0.5, 2, 3)],
        "rule string, severity string, threshold double, required int, cooldown_minutes int",
    )
    whole = spark.createDataFrame(rows, schema)
    counts = {}
    out = live.run_available(state.alert_stream(stream, rules), str(tmp_path / "alerts"), counts=counts)
    want = {tuple(r) for r in state.alert_batch(whole, rules).collect() if r["at"] <= edge}
    assert {tuple(r)[:4] for r in out.collect()} == want and len(want) > 10
    assert counts == {"batches": 6, "late": 1}

    out = live.run_available(
        state.admit_stream(stream, "key", "event_time", "event_id", 3, 200), str(tmp_path / "admit"), counts=counts
    )
    want = {
        tuple(r) for r in state.admit_batch(whole, "key", "event_time", "event_id", 3, 200).collect()
        if r["event_id"] * 20 <= (edge - START).total_seconds()
    }
    assert {tuple(r)[:4] for r in out.collect()} == want and counts["late"] == 1


def test_held_for_needs_an_unbroken_stretch(spark):
    rows = [("k", START + timedelta(minutes=m), c) for m, c in [(0, True), (4, True), (6, True), (7, False), (8, True), (9, True)]]
    df = spark.createDataFrame(rows, "k string, t timestamp, c boolean")
    out = windows.held_for(df, "k", "t", "c", 300).collect()
    assert [(r["since"], r["observations"]) for r in out] == [(START, 3)]


def test_drift_stream_decides_from_closed_periods(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = []
    for p in range(8):
        share = 90 if p == 7 else 50
        day = START + timedelta(days=30 * p)
        rows += [(day.date(), "a" if i < share else "b") for i in range(100)]
    last = (START + timedelta(days=30 * 12)).date()
    spark.createDataFrame(rows + [(last, "a")], "transaction_date date, product_category string").write.parquet(path)
    live.drift_stream(live.read_stream(spark, path), str(tmp_path / "out"), k_sigma=1.0).awaitTermination()
    decision = live.latest(spark, str(tmp_path / "out"), "decision").first()
    assert decision["periods"] == 5 and decision["breaches"] == 1


def test_slices_compose_to_the_machine():
    """Any cut of a log into slices gives the transitions of the plain machine."""
    import pandas as pd

    rng = random.Random(1)
    for _ in range(300):
        n, required, cooldown = rng.randint(1, 40), rng.choice([1, 1, 2, 3]), rng.choice([0, 3, 10, 40])
        rows, at = [], 0
        for i in range(n):
            at += rng.choice([0, 1, 1, 2, 5])
            rows.append((at, float(i), rng.random() < rng.choice([0.3, 0.8])))
        held, want = (False, None, 0), []
        for at, seen, met in rows:
            held, kind = state.step_alert(held, at, met, required, cooldown)
            want += [(at, kind, seen)] if kind else []
        cuts = sorted({0, n, *(rng.randrange(n) for _ in range(rng.randint(0, 4)))})
        slices, tables, entry = [], [], 0
        for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = pd.DataFrame(rows[a:b], columns=["at_us", "observed", "met"]).assign(
                required=required, cooldown_us=cooldown, entry=entry
            )
            slices.append(state._Slice(part))
            entry = slices[-1].trailing
            tables += [("r", number, f, t, cooldown, g, last) for f, t, g, last in slices[-1].exits()]
        frame = pd.DataFrame(tables, columns=["rule", "slice", "firing_in", "at", "cooldown_us", "firing", "last"])
        entries = state._entries(frame.astype({"at": "Int64", "last": "Int64"}))
        got = []
        for own, (_, e) in zip(slices, entries.iterrows()):
            found = own.replay(bool(e["firing"]), None if pd.isna(e["last"]) else int(e["last"]))
            got += [(int(own.at[i]), kind, own.observed[i]) for i, kind in found]
        assert got == want


def test_one_busy_rule_over_many_slices(spark):
    rng = random.Random(4)
    rows = [("busy" if rng.random() < 0.9 else "calm", START + timedelta(seconds=rng.randrange(40_000)), rng.random()) for _ in range(1500)]
    schema = "rule string, event_time timestamp, observed double"
    rules = spark.createDataFrame(
        [("busy", "info", 0.3, 3, 2), ("calm", "info", 0.5, 1, 15), ("unseen", "info", 0.5, 1, 15)],
        "rule string, severity string, threshold double, required int, cooldown_minutes int",
    )
    found = {tuple(r) for r in state.alert_batch(spark.createDataFrame(rows, schema), rules).collect()}
    want = set()
    for rule, level, required, minutes in (("busy", 0.3, 3, 2), ("calm", 0.5, 1, 15)):
        held = (False, None, 0)
        for _, at, seen in sorted(r for r in rows if r[0] == rule):
            us = int((at - START).total_seconds()) * 1_000_000
            held, kind = state.step_alert(held, us, seen > level, required, minutes * 60_000_000)
            if kind:
                want.add((rule, at, kind, seen))
    assert found == want
    assert state.alert_batch(spark.createDataFrame([], schema), rules).count() == 0

"""Queries over quality checks and composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom import schemas
from panelloom.catalog.aggregates import _CELLS, _RESULTS, catalog_of, r6
from panelloom.catalog.base import folder, query
from panelloom.catalog.scans import _WAVE, _pew, aligned
from panelloom.catalog.statistics import _CAL, _PQ, _js
from panelloom.functions import screens
from panelloom.operators import calibrate as cal
from panelloom.operators import quality, reports
from panelloom.plans import jobs
from panelloom.sources import landings, panel, store

AS_OF = "2001-12-31"


def _one(check_sql: str, value: str, ok: str, name: str, severity: str) -> str:
    return (
        f"SELECT '{name}' AS check_name, '{severity}' AS severity, round(CAST({value} AS DOUBLE), 6) "
        f"AS value, {ok} AS passed FROM ({check_sql})"
    )


def _run(df, *checks):
    return r6(quality.run_checks(df, checks).drop("detail"), "value")


@query(
    "n01_null_rate",
    _one("SELECT avg(CASE WHEN uncertainty IS NULL THEN 1 ELSE 0 END) AS v FROM generated", "v",
         "v <= CAST(0.02 AS DOUBLE)", "null_rate", "error"),
    ("generated",),
)
def _(t):
    return _run(t.generated, quality.null_rate(t.generated, ["answer", "uncertainty"]))


@query(
    "n02_unique_key",
    _one("SELECT count(*) - count(DISTINCT panelist_id) AS v FROM responses", "v", "v = 0",
         "unique_key", "critical"),
    ("responses",),
)
def _(t):
    return _run(t.responses, quality.unique_key("panelist_id"))


@query(
    "n03_value_range",
    _one("SELECT count(*) FILTER (WHERE unit_price NOT BETWEEN 1 AND 20) AS v FROM purchases", "v",
         "v = 0", "value_range", "error"),
    ("purchases",),
)
def _(t):
    return _run(t.purchases, quality.value_range("unit_price", 1, 20))


@query(
    "n04_distribution_balance",
    _one("""SELECT max(n) / CAST(sum(n) AS DOUBLE) AS v FROM (SELECT count(*) AS n FROM purchases
         GROUP BY product_category)""", "v", "v <= CAST(0.8 AS DOUBLE)", "distribution_balance", "warning"),
    ("purchases",),
)
def _(t):
    return _run(t.purchases, quality.distribution_balance("product_category"))


@query(
    "n05_referential",
    _one("""SELECT count(*) AS v FROM purchases WHERE panelist_id NOT IN (SELECT panelist_id FROM panelists
         WHERE region <> 'ASIA')""", "v", "v = 0", "referential_integrity", "critical"),
    ("panelists", "purchases"),
)
def _(t):
    parent = t.panelists.filter(F.col("region") != "ASIA")
    return _run(t.purchases, quality.referential("panelist_id", parent, "panelist_id"))


@query(
    "n06_freshness",
    _one("SELECT date_diff('day', max(transaction_date), DATE '2001-12-31') AS v FROM purchases", "v",
         "v <= 45", "freshness", "warning"),
    ("purchases",),
)
def _(t):
    return _run(t.purchases, quality.freshness("transaction_date", AS_OF))


@query(
    "n07_row_count_delta",
    _one("SELECT abs(count(*) - 1000) / CAST(1000 AS DOUBLE) AS v FROM panelists", "v",
         "v <= CAST(0.5 AS DOUBLE)", "row_count_delta", "error"),
    ("panelists",),
)
def _(t):
    return _run(t.panelists, quality.row_count_delta(1_000))


@query(
    "n08_required_columns",
    _one("SELECT count(*) * 0 + 1 AS v FROM panelists", "v", "false", "schema", "critical"),
    ("panelists",),
)
def _(t):
    return _run(t.panelists, quality.required_columns(t.panelists, ["panelist_id", "shoe_size"]))


@query(
    "j04_missing_columns",
    "SELECT count(*) AS panelists, 'shoe_size' AS missing FROM panelists",
    ("panelists",),
)
def _(t):
    missing = panel.known_columns(t.panelists, ["panelist_id", "shoe_size"])
    return t.panelists.agg(F.count(F.lit(1)).alias("panelists")).withColumn(
        "missing", F.lit(",".join(missing))
    )


@query(
    "l01_custom_check",
    _one("SELECT avg(CAST(is_promotion AS INTEGER)) AS v FROM purchases", "v", "v < CAST(0.5 AS DOUBLE)",
         "promotion_share", "warning"),
    ("purchases",),
)
def _(t):
    share = F.avg(F.col("is_promotion").cast("int"))
    return _run(
        t.purchases, quality.custom("promotion_share", quality.WARNING, share, lambda v: v < 0.5)
    )


@query(
    "n09_gate",
    """WITH c AS (SELECT 'e' AS s, (SELECT max(n) = 1 FROM (SELECT count(*) AS n FROM panelists
    GROUP BY panelist_id)) AS ok UNION ALL SELECT 'e', (SELECT count(*) = 0 FROM panelists WHERE
    expansion_factor NOT BETWEEN 1 AND 5) UNION ALL SELECT 'w', (SELECT max(n) / CAST(sum(n) AS DOUBLE)
    <= CAST(0.8 AS DOUBLE) FROM (SELECT count(*) AS n FROM panelists GROUP BY region)) UNION ALL
    SELECT 'e', (SELECT count(*) FILTER (WHERE region IS NULL) = 0 FROM panelists))
    SELECT count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok AND s = 'w') AS warnings,
    count(*) FILTER (WHERE NOT ok AND s = 'e') AS failures, count(*) FILTER (WHERE NOT ok AND s = 'e') = 0
    AS ok FROM c""",
    ("panelists",),
)
def _(t):
    p = t.panelists
    checks = [
        quality.unique_key("panelist_id"), quality.value_range("expansion_factor", 1, 5),
        quality.distribution_balance("region"), quality.null_rate(p, ["region"]),
    ]
    return quality.gate(quality.run_checks(p, checks))


@query(
    "n10_run_job",
    """SELECT 'panel' AS job, 'complete' AS state, count(*) AS rows_extracted, count(*) FILTER
    (WHERE region = 'ASIA') AS rows_transformed, count(*) FILTER (WHERE region = 'ASIA') AS rows_loaded,
    0 AS failures FROM panelists""",
    ("panelists",),
)
def _(t):
    path = folder(t, "job")
    record = jobs.run_job(
        t.spark, "panel",
        jobs.Stages(
            extract=lambda: t.panelists,
            transform=lambda df: df.filter(F.col("region") == "ASIA"),
            checks=lambda df: [quality.unique_key("panelist_id")],
            load=lambda df: df.write.parquet(path),
        ),
    )
    return record.select(
        "job", "state", "rows_extracted", "rows_transformed", "rows_loaded", "failures"
    )


@query(
    "n11_cohort_job",
    """WITH c AS (SELECT * FROM panelists WHERE region = 'EUROPE' ORDER BY panelist_id LIMIT 200),
    r AS (SELECT c.panelist_id, c.age_group, c.income_group, count(p.transaction_date) AS frequency,
    coalesce(round(sum(p.total_value), 2), 0) AS monetary, coalesce(date_diff('day',
    max(p.transaction_date), DATE '2001-12-31'), 999) AS recency_days FROM c LEFT JOIN purchases p
    USING (panelist_id) GROUP BY ALL), k AS (SELECT *, count(*) OVER () AS n, row_number() OVER
    (ORDER BY recency_days DESC, panelist_id) AS kr, row_number() OVER (ORDER BY frequency, panelist_id)
    AS kf, row_number() OVER (ORDER BY monetary, panelist_id) AS km FROM r)
    SELECT panelist_id, age_group, income_group, frequency, monetary, recency_days,
    CAST(greatest(1, ceil(5 * (kr - 1) / CAST(n - 1 AS DOUBLE))) AS INTEGER) AS recency_days_score,
    CAST(greatest(1, ceil(5 * (kf - 1) / CAST(n - 1 AS DOUBLE))) AS INTEGER) AS frequency_score,
    CAST(greatest(1, ceil(5 * (km - 1) / CAST(n - 1 AS DOUBLE))) AS INTEGER) AS monetary_score FROM k""",
    ("panelists", "purchases"),
)
def _(t):
    path = folder(t, "cohorts")
    record = jobs.cohort_job(
        t.spark, t.panelists, t.purchases, {"region": "EUROPE"}, 200, AS_OF, path, "run_1"
    ).first()
    if record["state"] != "complete":
        raise RuntimeError(record["error"])
    return store.load_cohort(t.spark, path, "run_1").select(
        "panelist_id", "age_group", "income_group", "frequency", "monetary", "recency_days",
        "recency_days_score", "frequency_score", "monetary_score",
    )


_BENCH = f"""{_WAVE}, l AS (SELECT age_group, 'atp_q1' AS question_id, atp_q1 AS option FROM wave
  UNION ALL SELECT age_group, 'atp_q2', atp_q2 FROM wave UNION ALL SELECT age_group, 'atp_q3', atp_q3
  FROM wave), bench AS (SELECT 'pew' AS source, '119' AS version, question_id,
  age_group AS demographic_group, option, count(*) / CAST(sum(count(*)) FILTER (WHERE option IS NOT NULL)
  OVER (PARTITION BY question_id, age_group) AS DOUBLE) AS share, sum(count(*)) OVER
  (PARTITION BY question_id, age_group) AS sample_size FROM l GROUP BY question_id, age_group, option
  QUALIFY option IS NOT NULL)"""


def _bench(t):
    landed = landings.land_pew(_pew(t), "119", min_rows=100)
    root, target = folder(t, "lake"), folder(t, "benchmarks")
    landings.write_landing(landed, root, "pew", "119")
    record = jobs.benchmark_job(t.spark, root, "pew", "119", target).first()
    if record["state"] != "complete":
        raise RuntimeError(record["error"])
    rows = t.spark.read.parquet(target).withColumn("version", F.col("version").cast("string"))
    return rows.select(*schemas.BENCHMARK_COLUMNS)


@query(
    "n12_benchmark_job",
    f"WITH {_BENCH} SELECT source, version, question_id, demographic_group, option, "
    "round(share, 6) AS share, sample_size FROM bench",
    ("responses",),
)
def _(t):
    return r6(_bench(t), "share")


@query(
    "a09_read_benchmark",
    f"WITH {_WAVE} SELECT qkey, age_group AS f_agecat, atp_q1, atp_q2, atp_q3 FROM wave",
    ("responses",),
)
def _(t):
    root = folder(t, "lake")
    landings.write_landing(landings.land_pew(_pew(t), "119", min_rows=100), root, "pew", "119")
    return landings.read_benchmark(t.spark, root, "pew", "119").select(
        "qkey", "f_agecat", "atp_q1", "atp_q2", "atp_q3"
    )


@query("a10_list_landings")
def _(t):
    root = folder(t, "lake")
    landings.write_landing(landings.land_pew(_pew(t), "119", min_rows=100), root, "pew", "119")
    return landings.list_landings(t.spark, root).select(
        F.substring_index("path", "/", -1).alias("file"), "length"
    )


@query(
    "n13_quality_card",
    """SELECT CAST(0 AS DOUBLE) AS max_null_rate, true AS nulls_ok, true AS key_unique, true AS dates_valid,
    (SELECT round_even(max(n) / CAST(sum(n) AS DOUBLE), 4) FROM (SELECT count(*) AS n FROM panelists
    GROUP BY age_group)) AS top_share, true AS balanced, 0 AS pii_cells""",
    ("panelists",),
)
def _(t):
    text_columns = ["region", "education_level", "behavioral_archetype"]
    pii = {c: screens.has_pii(c) for c in text_columns}
    return quality.quality_card(
        t.panelists, t.purchases, "panelist_id", "transaction_date", "age_group", pii
    )


@query(
    "n15_analyze_survey",
    f"""WITH {_CELLS}, {_RESULTS} SELECT '1.0' AS report_schema_version,
    (SELECT count(*) FROM generated) AS total_responses, (SELECT count(*) FROM options) AS result_rows,
    (SELECT count(DISTINCT (question_id, dimension)) FROM tables) AS tests,
    (SELECT sum(n) FROM c) AS matched""",
    ("generated", "options"),
)
def _(t):
    report = jobs.analyze_survey(t.generated, catalog_of(t), answer="loose_answer")
    return report.select(
        "report_schema_version", F.col("summary.total_responses").alias("total_responses"),
        F.size("results").cast("bigint").alias("result_rows"),
        F.size("demographic_breakdowns").cast("bigint").alias("tests"),
        F.aggregate("results", F.lit(0).cast("bigint"), lambda s, r: s + r["count"]).alias("matched"),
    )


@query(
    "a20_exports",
    "SELECT question_id, count(*) AS n, 21 AS columns FROM generated GROUP BY 1",
    ("generated",),
)
def _(t):
    path = folder(t, "exports")
    store.export_responses(t.generated.drop("uncertainty"), f"{path}/csv")
    store.export_json(reports.run_summary(t.generated), f"{path}/summary")
    back = t.spark.read.option("header", True).csv(f"{path}/csv")
    return back.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "columns", F.lit(len(back.columns))
    )


@query("a20_export_eda")
def _(t):
    from panelloom.operators import eda

    return store.export_eda(
        {
            "panel": eda.panel_kpis(t.panelists),
            "purchases": eda.purchase_kpis(t.purchases),
            "price_tiers": eda.tier_counts(t.purchases),
        }
    )


@query("a21_report")
def _(t):
    report = jobs.analyze_survey(t.generated, catalog_of(t), answer="loose_answer")
    return report.select(F.to_json(F.struct(*report.columns)).alias("report"))


@query(
    "n16_audit_record",
    """SELECT round(avg(CASE WHEN list_contains(validation_flags, 'hallucination_detected') THEN 1 ELSE 0
    END), 6) AS hallucination_rate, round(avg(CASE WHEN list_contains(validation_flags, 'age_inconsistency')
    THEN 0 ELSE 1 END), 6) AS consistency_score, round(avg(CASE WHEN is_valid THEN 1 ELSE 0 END), 6)
    AS validity_share, 16 AS digits, (SELECT count(DISTINCT question_id) FROM options) AS questions
    FROM generated""",
    ("generated", "options"),
)
def _(t):
    catalog = catalog_of(t)
    metrics = cal.calibration_metrics(cal.calibrate(aligned(t)))
    record = jobs.audit_record(
        t.generated.filter("is_valid"), t.generated.filter("NOT is_valid"), catalog, metrics,
        {"questions": ["q_F", "q_O", "q_P"], "seed": 42, "cohort_size": 200}, "loose_answer",
    )
    return r6(record, "hallucination_rate", "consistency_score", "validity_share").select(
        "hallucination_rate", "consistency_score", "validity_share",
        F.length("provenance_hash").alias("digits"), F.size("results").cast("bigint").alias("questions"),
    )


@query(
    "n17_cross_validate",
    f"""WITH {_PQ}, {_CAL}, {_BENCH}, w AS (SELECT CASE question_id WHEN 'atp_q1' THEN 'q_F' WHEN 'atp_q2'
    THEN 'q_O' ELSE 'q_P' END AS question_id, option, sum(share * sample_size) AS x FROM bench GROUP BY ALL),
    y AS (SELECT cal.question_id, cal.option_idx, m / sum(m) OVER (PARTITION BY cal.question_id) AS p,
    coalesce(x, 0) / sum(coalesce(x, 0)) OVER (PARTITION BY cal.question_id) AS q FROM cal LEFT JOIN w
    ON w.question_id = cal.question_id AND w.option = cal.option), j AS (SELECT question_id,
    {_js('p', 'q')} AS js FROM y GROUP BY 1), g AS (SELECT question_id, abs(sum(p - q) OVER
    (PARTITION BY question_id ORDER BY option_idx)) AS g FROM y), ww AS (SELECT question_id, sum(g) AS w1
    FROM g GROUP BY 1) SELECT 'pew' AS source, count(*) AS questions, round(avg(js), 6) AS js,
    round(avg(w1), 6) AS wasserstein, avg(js) <= CAST(0.05 AS DOUBLE) AND avg(w1) <= CAST(0.15 AS DOUBLE)
    AS passed FROM j JOIN ww USING (question_id)""",
    ("generated", "empirical", "options"),
)
def _(t):
    names = F.create_map(*[F.lit(x) for x in ("atp_q1", "q_F", "atp_q2", "q_O", "atp_q3", "q_P")])
    bench = _bench(t).withColumn("question_id", names[F.col("question_id")])
    return r6(jobs.cross_validate(cal.calibrate(aligned(t)), bench), "js", "wasserstein")


@query("n15_survey_chain")
def _(t):
    return jobs.survey_chain(t.generated, t.empirical, catalog_of(t), "loose_answer")



"""Queries over exploration, distributions and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom import schemas
from panelloom.catalog.base import query
from panelloom.catalog.scans import _NEAR, _PAIRS, _SOURCE, _TARGET, _TIER, _WAVE, _pew
from panelloom.operators import distributions as dist
from panelloom.operators import eda, joins, reports
from panelloom.sources import landings


def r6(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def catalog_of(t):
    return t.catalog


@query(
    "d01_ordered_distribution",
    """SELECT income_group AS label, count(*) AS count, round_even(count(*) / CAST((SELECT count(*)
    FROM panelists) AS DOUBLE), 4) AS share, row_number() OVER (ORDER BY list_position(['low',
    'lower_middle','middle','upper_middle','high'], income_group)) AS position FROM panelists GROUP BY 1""",
    ("panelists",),
)
def _(t):
    return eda.ordered_distribution(t.panelists, "income_group", schemas.INCOME_GROUPS)


@query(
    "d01_region_distribution",
    """SELECT region AS label, count(*) AS count, round_even(count(*) / CAST((SELECT count(*)
    FROM panelists) AS DOUBLE), 4) AS share, row_number() OVER (ORDER BY count(*) DESC, region)
    AS position FROM panelists GROUP BY 1""",
    ("panelists",),
)
def _(t):
    return eda.ordered_distribution(t.panelists, "region")


@query(
    "d02_panel_kpis",
    """SELECT count(*) AS total_households, CAST(floor(sum(s)) AS BIGINT) AS total_members,
    round_even(avg(s), 2) AS avg_household_size, count(DISTINCT region) AS regions_covered
    FROM (SELECT region, CAST(CASE household_size WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3-4' THEN 3.5
    WHEN '5+' THEN 5.5 ELSE 2 END AS DOUBLE) AS s FROM panelists)""",
    ("panelists",),
)
def _(t):
    return eda.panel_kpis(t.panelists)


@query(
    "d03_crosstab",
    """SELECT a.age_group AS "row", i.income_group AS col, count(p.panelist_id) AS n
    FROM (SELECT DISTINCT age_group FROM panelists) a CROSS JOIN
    (SELECT DISTINCT income_group FROM panelists) i LEFT JOIN panelists p
    ON p.age_group = a.age_group AND p.income_group = i.income_group GROUP BY ALL""",
    ("panelists",),
)
def _(t):
    return eda.crosstab(
        t.panelists, "age_group", "income_group", schemas.AGE_GROUPS, schemas.INCOME_GROUPS
    )


@query(
    "d03_crosstab_wide",
    """SELECT age_group, count(*) FILTER (WHERE income_group = 'low') AS low,
    count(*) FILTER (WHERE income_group = 'lower_middle') AS lower_middle,
    count(*) FILTER (WHERE income_group = 'middle') AS middle,
    count(*) FILTER (WHERE income_group = 'upper_middle') AS upper_middle,
    count(*) FILTER (WHERE income_group = 'high') AS high FROM panelists GROUP BY 1""",
    ("panelists",),
)
def _(t):
    return eda.crosstab_wide(t.panelists, "age_group", "income_group", schemas.INCOME_GROUPS)


@query(
    "d04_purchase_kpis",
    """SELECT count(*) AS total_transactions, round_even(avg(total_value), 2) AS avg_basket_value,
    round_even(avg(unit_price), 2) AS avg_unit_price,
    round_even(avg(CAST(is_promotion AS INTEGER)), 4) AS promotion_rate FROM purchases""",
    ("purchases",),
)
def _(t):
    return eda.purchase_kpis(t.purchases)


@query(
    "d05_category_penetration",
    """SELECT product_category AS label, count(DISTINCT panelist_id) AS buyers,
    round_even(count(DISTINCT panelist_id) / CAST((SELECT count(DISTINCT panelist_id) FROM purchases)
    AS DOUBLE), 4) AS share FROM purchases GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4""",
    ("purchases",),
)
def _(t):
    return eda.penetration(t.purchases, 4)


@query(
    "d06_tier_counts",
    f"""SELECT label, n AS count, round_even(n / CAST(sum(n) OVER () AS DOUBLE), 4) AS share,
    row_number() OVER (ORDER BY list_position(['budget','value','mid','premium','luxury'], label))
    AS position FROM (SELECT {_TIER} AS label, count(*) AS n FROM purchases GROUP BY 1)""",
    ("purchases",),
)
def _(t):
    return eda.tier_counts(t.purchases)


@query(
    "d07_promo_by_archetype",
    """SELECT upper(behavioral_archetype[1]) || lower(behavioral_archetype[2:]) AS label,
    round_even(avg(CAST(is_promotion AS INTEGER)), 4) AS share FROM purchases
    JOIN panelists USING (panelist_id) GROUP BY 1""",
    ("panelists", "purchases"),
)
def _(t):
    return eda.promo_by_archetype(t.purchases, t.panelists)


@query(
    "d08_frequency_histogram",
    """WITH f AS (SELECT count(*) AS x FROM purchases GROUP BY panelist_id),
    s AS (SELECT CAST(min(x) AS DOUBLE) AS lo, (max(x) - min(x)) / CAST(10 AS DOUBLE) AS w FROM f)
    SELECT CAST(b.bin AS INTEGER) AS bin, round_even(lo + b.bin * w, 1) AS lower,
    round_even(lo + (b.bin + 1) * w, 1) AS upper, count(f.x) AS count
    FROM (SELECT unnest(range(10)) AS bin) b CROSS JOIN s
    LEFT JOIN f ON least(9, floor((f.x - lo) / w)) = b.bin GROUP BY ALL""",
    ("purchases",),
)
def _(t):
    return eda.purchase_frequency(t.purchases, 10)


@query(
    "d09_monthly_volume",
    "SELECT strftime(transaction_date, '%Y-%m') AS month, count(*) AS n FROM purchases GROUP BY 1",
    ("purchases",),
)
def _(t):
    return eda.monthly_volume(t.purchases)


@query(
    "d10_rfm",
    """SELECT panelist_id, date_diff('day', max(transaction_date), DATE '2001-12-31') AS recency_days,
    count(transaction_date) AS frequency, round(sum(total_value), 2) AS monetary
    FROM purchases GROUP BY 1""",
    ("purchases",),
)
def _(t):
    return eda.rfm(t.purchases, "2001-12-31")


@query(
    "d10_rfm_latest",
    """SELECT panelist_id, date_diff('day', max(transaction_date), (SELECT max(transaction_date)
    FROM purchases)) AS recency_days, count(transaction_date) AS frequency,
    round(sum(total_value), 2) AS monetary FROM purchases GROUP BY 1""",
    ("purchases",),
)
def _(t):
    return eda.rfm(t.purchases)


@query(
    "d11_survey_kpis",
    """SELECT sum(n) AS total_responses, (SELECT count(DISTINCT question_id) FROM responses) AS questions,
    count(*) AS respondents, round_even(avg(CASE WHEN n = (SELECT count(DISTINCT question_id)
    FROM responses) THEN 1 ELSE 0 END), 4) AS completion_rate FROM (SELECT panelist_id, count(*) AS n
    FROM responses GROUP BY 1)""",
    ("responses",),
)
def _(t):
    return eda.survey_kpis(t.responses)


@query(
    "d12_cluster_sizes",
    """SELECT upper(behavioral_archetype[1]) || lower(behavioral_archetype[2:]) AS label,
    count(*) AS count, round_even(count(*) / CAST((SELECT count(*) FROM panelists) AS DOUBLE), 4)
    AS share FROM panelists GROUP BY 1""",
    ("panelists",),
)
def _(t):
    return eda.cluster_sizes(t.panelists)


@query(
    "d13_cluster_profile",
    """WITH house AS (SELECT panelist_id, avg(CASE WHEN unit_price < 5 THEN 1 ELSE 0 END) AS ps,
    count(DISTINCT product_category) AS cb, avg(CAST(is_promotion AS INTEGER)) AS pr,
    avg(CASE WHEN store_type IN ('convenience', 'online') THEN 1 ELSE 0 END) AS cp,
    max(bn) / CAST(count(*) AS DOUBLE) AS bl FROM (SELECT *, count(*) OVER
    (PARTITION BY panelist_id, brand) AS bn FROM purchases) GROUP BY 1),
    m AS (SELECT behavioral_archetype AS a, avg(ps) AS ps, avg(bl) AS bl, avg(cb) AS cb, avg(pr) AS pr,
    avg(cp) AS cp FROM panelists JOIN house USING (panelist_id) GROUP BY 1)
    SELECT upper(a[1]) || lower(a[2:]) AS label,
    round((ps - min(ps) OVER ()) / (max(ps) OVER () - min(ps) OVER ()), 6) AS price_sensitivity,
    round((bl - min(bl) OVER ()) / (max(bl) OVER () - min(bl) OVER ()), 6) AS brand_loyalty,
    round((cb - min(cb) OVER ()) / (max(cb) OVER () - min(cb) OVER ()), 6) AS category_breadth,
    round((pr - min(pr) OVER ()) / (max(pr) OVER () - min(pr) OVER ()), 6) AS promotion_response,
    round((cp - min(cp) OVER ()) / (max(cp) OVER () - min(cp) OVER ()), 6) AS convenience_preference
    FROM m""",
    ("panelists", "purchases"),
)
def _(t):
    return eda.cluster_profile(t.purchases, t.panelists)


_RESULTS = """c AS (SELECT o.question_id, o.option_idx, o.option, count(g.response_id) AS n
  FROM options o LEFT JOIN generated g ON g.question_id = o.question_id
  AND lower(trim(g.loose_answer)) = lower(trim(o.option)) GROUP BY ALL),
  p AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY question_id) AS DOUBLE) AS s,
  count(*) OVER (PARTITION BY question_id) AS k FROM c),
  h AS (SELECT question_id, sum(CASE WHEN s > 0 THEN -s * log2(s) ELSE 0 END) AS h, max(k) AS k
  FROM p GROUP BY 1)"""


@query(
    "d14_question_results",
    f"""WITH {_RESULTS} SELECT p.question_id, p.option_idx, p.option, p.n AS count,
    round_even(100 * s, 1) AS percentage, t.total_responses, t.valid_responses,
    round_even(h.h, 3) AS entropy, round_even(h.h / log2(h.k), 3) AS normalized_entropy
    FROM p JOIN h USING (question_id) JOIN (SELECT question_id, count(*) AS total_responses,
    count(*) FILTER (WHERE is_valid) AS valid_responses FROM generated GROUP BY 1) t
    USING (question_id)""",
    ("generated", "options"),
)
def _(t):
    return dist.question_results(t.generated, catalog_of(t), "loose_answer")


@query(
    "d15_run_summary",
    """SELECT count(*) AS total_responses, count(*) FILTER (WHERE is_valid) AS valid_responses,
    round_even(avg(CASE WHEN list_contains(validation_flags, 'hallucination_detected') THEN 1 ELSE 0 END),
    4) AS hallucination_rate, round_even(avg(CASE WHEN list_contains(validation_flags,
    'age_inconsistency') THEN 0 ELSE 1 END), 4) AS consistency_score,
    round_even(avg(confidence), 3) AS mean_confidence FROM generated""",
    ("generated",),
)
def _(t):
    return reports.run_summary(t.generated)


@query(
    "d16_flag_rates",
    """SELECT question_id, round(avg(CASE WHEN list_contains(validation_flags, 'hallucination_detected')
    THEN 1 ELSE 0 END), 6) AS hallucination_rate, round(avg(CASE WHEN list_contains(validation_flags,
    'age_inconsistency') THEN 0 ELSE 1 END), 6) AS consistency_rate FROM generated GROUP BY 1""",
    ("generated",),
)
def _(t):
    rates = t.generated.groupBy("question_id").agg(
        reports.flag_rate().alias("hallucination_rate"),
        reports.consistency_rate().alias("consistency_rate"),
    )
    return r6(rates, "hallucination_rate", "consistency_rate")


@query(
    "d17_flag_counts",
    "SELECT flag, count(*) AS n FROM (SELECT unnest(validation_flags) AS flag FROM generated) GROUP BY 1",
    ("generated",),
)
def _(t):
    return reports.flag_counts(t.generated)


@query(
    "d18_weighted_distribution",
    f"WITH {_SOURCE} SELECT question_id, option_idx, option, round(mass, 6) AS mass FROM source",
    ("generated", "options"),
)
def _(t):
    return r6(dist.weighted_distribution(t.generated, catalog_of(t), "loose_answer"), "mass")


_GROUPS = f"""{_NEAR}, groups AS (SELECT question_id, "group", option_idx, option,
  (w + CAST(1e-6 AS DOUBLE)) / sum(w + CAST(1e-6 AS DOUBLE)) OVER (PARTITION BY question_id, "group")
  AS mass FROM (SELECT o.question_id, a.g AS "group", o.option_idx, o.option,
  coalesce(sum(x.expansion_factor), 0) AS w FROM options o JOIN (SELECT DISTINCT question_id,
  age_group AS g FROM generated) a USING (question_id) LEFT JOIN (SELECT * FROM generated
  JOIN near USING (response_id)) x ON x.question_id = o.question_id AND x.option_idx = o.option_idx
  AND x.age_group = a.g GROUP BY ALL))"""


@query(
    "d19_group_distributions",
    f"""WITH {_GROUPS} SELECT question_id, "group", option_idx, option, round(mass, 6) AS mass
    FROM groups""",
    ("generated", "options"),
)
def _(t):
    return r6(
        dist.group_distributions(t.generated, catalog_of(t), "age_group", "loose_answer"), "mass"
    )


@query(
    "d20_empirical_target",
    f"WITH {_TARGET} SELECT question_id, option_idx, option, round(mass, 6) AS mass FROM target",
    ("empirical", "options"),
)
def _(t):
    return r6(dist.empirical_target(t.empirical, catalog_of(t)), "mass")


_COND = """cond AS (SELECT question_id, behavioral_archetype, option_idx, option,
  (n + CAST(0.5 AS DOUBLE)) / sum(n + CAST(0.5 AS DOUBLE))
  OVER (PARTITION BY question_id, behavioral_archetype) AS mass FROM (SELECT o.question_id,
  a.behavioral_archetype, o.option_idx, o.option, count(e.response_id) AS n FROM options o
  JOIN (SELECT DISTINCT question_id, behavioral_archetype FROM empirical) a USING (question_id)
  LEFT JOIN empirical e ON e.question_id = o.question_id AND e.answer = o.option
  AND e.behavioral_archetype = a.behavioral_archetype GROUP BY ALL))"""


@query(
    "d21_conditional_distribution",
    f"""WITH {_COND} SELECT question_id, behavioral_archetype, option_idx, option,
    round(mass, 6) AS mass FROM cond""",
    ("empirical", "options"),
)
def _(t):
    return r6(dist.conditional_distribution(t.empirical, catalog_of(t)), "mass")


@query(
    "d22_empirical_counts",
    """SELECT o.question_id, o.option_idx, o.option, count(r.response_id) AS count FROM options o
    LEFT JOIN (SELECT * FROM responses WHERE panelist_id IN (SELECT panelist_id FROM panelists
    WHERE household_size = '5+')) r ON r.question_id = o.question_id AND r.answer = o.option
    GROUP BY ALL""",
    ("responses", "options"),
)
def _(t):
    cohort = t.panelists.filter(F.col("household_size") == "5+")
    return dist.empirical_counts(t.responses, catalog_of(t), cohort)


@query(
    "d23_question_catalog",
    """SELECT question_id, min(question_text) AS question_text, min(question_type) AS question_type,
    string_agg(DISTINCT answer, '|' ORDER BY answer) AS options FROM responses GROUP BY 1""",
    ("responses",),
)
def _(t):
    return dist.question_catalog(t.responses).withColumn("options", F.array_join("options", "|"))


@query(
    "d24_benchmark_distributions",
    f"""WITH {_WAVE}, l AS (SELECT age_group, 'atp_q1' AS question_id, atp_q1 AS option FROM wave
    UNION ALL SELECT age_group, 'atp_q2', atp_q2 FROM wave
    UNION ALL SELECT age_group, 'atp_q3', atp_q3 FROM wave)
    SELECT 'pew' AS source, '119' AS version, question_id, age_group AS demographic_group, option,
    round(count(*) / CAST(sum(count(*)) FILTER (WHERE option IS NOT NULL)
    OVER (PARTITION BY question_id, age_group) AS DOUBLE), 6) AS share,
    sum(count(*)) OVER (PARTITION BY question_id, age_group) AS sample_size FROM l
    GROUP BY question_id, age_group, option QUALIFY option IS NOT NULL""",
    ("responses",),
)
def _(t):
    rows = landings.harmonize(landings.land_pew(_pew(t), "119", min_rows=100))
    questions = landings.question_columns(rows)
    return r6(dist.benchmark_distributions(rows, questions, "pew", "119"), "share")


@query(
    "d25_cohort_summary",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS attribute, {a} AS value, count(*) AS n, round_even(count(*) /
        CAST((SELECT count(*) FROM panelists) AS DOUBLE) * 100, 1) AS percentage
        FROM panelists GROUP BY 2"""
        for a in ["age_group", "income_group", "region", "behavioral_archetype", "household_size"]
    ),
    ("panelists",),
)
def _(t):
    return dist.cohort_summary(
        t.panelists, ["age_group", "income_group", "region", "behavioral_archetype", "household_size"]
    )


_CELLS = "cells AS (" + " UNION ALL ".join(
    f"""SELECT question_id, '{d}' AS dimension, {d} AS "group", answer, count(*) AS n
    FROM responses GROUP BY ALL"""
    for d in schemas.BREAKDOWN_DIMENSIONS
) + """), tables AS (SELECT g.question_id, g.dimension, g."group", o.option_idx, o.option,
  coalesce(c.n, 0) AS n FROM (SELECT DISTINCT question_id, dimension, "group" FROM cells) g
  JOIN options o USING (question_id) LEFT JOIN cells c ON c.question_id = g.question_id
  AND c.dimension = g.dimension AND c."group" = g."group" AND c.answer = o.option)"""


@query(
    "d26_breakdown_pct",
    f"""WITH {_CELLS} SELECT question_id, dimension, array_to_string(list_transform(string_split(
    replace("group", '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS "group",
    option_idx, option, round(100 * n / CAST(sum(n) OVER (PARTITION BY question_id, dimension, "group")
    AS DOUBLE), 6) AS pct FROM tables""",
    ("responses", "options"),
)
def _(t):
    return r6(dist.breakdown_pct(t.responses, catalog_of(t), schemas.BREAKDOWN_DIMENSIONS), "pct")


_PROFILED = ["age_group", "region", "has_children", "expansion_factor"]


@query(
    "d27_profile",
    "SELECT *, max(null_rate) OVER () AS max_null_rate FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS null_rate,
        count(DISTINCT {c}) AS distinct_values FROM panelists"""
        for c in _PROFILED
    )
    + ")",
    ("panelists",),
)
def _(t):
    return eda.profile(t.panelists, _PROFILED)


@query(
    "d28_outliers",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS outliers FROM purchases WHERE abs({c} -
        (SELECT avg({c}) FROM purchases)) > 2 * (SELECT stddev_samp({c}) FROM purchases)"""
        for c in ["unit_price", "quantity", "total_value"]
    ),
    ("purchases",),
)
def _(t):
    return eda.outliers(t.purchases, ["unit_price", "quantity", "total_value"], 2.0)


@query(
    "d29_category_uncertainty",
    f"""WITH {_NEAR} SELECT o.question_id, o.option_idx, o.option, round(coalesce(avg(greatest(0,
    least(1, coalesce(x.uncertainty, 1 - x.confidence)))), 0), 6) AS uncertainty FROM options o
    LEFT JOIN (SELECT * FROM generated JOIN near USING (response_id)) x
    ON x.question_id = o.question_id AND x.option_idx = o.option_idx GROUP BY ALL""",
    ("generated", "options"),
)
def _(t):
    return r6(dist.category_uncertainty(t.generated, catalog_of(t), "loose_answer"), "uncertainty")


@query(
    "d30_sample_uncertainty",
    """WITH s AS (SELECT region, question_id, answer, count(*) AS n FROM responses GROUP BY ALL),
    p AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY region, question_id) AS DOUBLE) AS p FROM s)
    SELECT region, question_id, round(least(1, sum(-p * ln(p)) / ln(5)), 6) AS uncertainty FROM p
    GROUP BY ALL""",
    ("responses",),
)
def _(t):
    return r6(
        dist.sample_uncertainty(t.responses, catalog_of(t), ["region"]), "uncertainty"
    )


@query(
    "d30_distribution_uncertainty",
    f"""WITH {_COND} SELECT question_id, behavioral_archetype, round(least(1,
    sum(-mass * ln(mass)) / ln(count(*))), 6) AS uncertainty FROM cond GROUP BY ALL""",
    ("empirical", "options"),
)
def _(t):
    cond = dist.conditional_distribution(t.empirical, catalog_of(t))
    return r6(
        dist.distribution_uncertainty(cond, ["question_id", "behavioral_archetype"]), "uncertainty"
    )


@query(
    "d31_model_costs",
    """SELECT model_used, count(*) AS calls, round(avg(generation_time_ms), 6) AS avg_latency_ms,
    sum(token_count) AS tokens, round(sum(cost_usd), 6) AS cost_usd,
    round(sum(cost_usd) / count(*), 6) AS cost_per_response,
    round((SELECT sum(cost_usd) FROM generated), 6) AS total_cost_usd,
    (SELECT sum(cost_usd) FROM generated) > 5 AS budget_exceeded FROM generated GROUP BY 1""",
    ("generated",),
)
def _(t):
    return r6(
        reports.model_costs(t.generated, 5.0),
        "avg_latency_ms", "cost_usd", "cost_per_response", "total_cost_usd",
    )


BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
_BUCKETS = "buckets AS (" + " UNION ALL ".join(
    f"SELECT label, CAST({b} AS DOUBLE) AS bound, count(*) FILTER (WHERE value <= {b}) AS upto, "
    "count(*) AS total FROM calls GROUP BY label"
    for b in BOUNDS
) + ")"


@query(
    "d32_bucket_quantile",
    f"""WITH {_BUCKETS}, m AS (SELECT bound, sum(upto) AS upto, sum(total) AS total FROM buckets
    GROUP BY 1), w AS (SELECT *, coalesce(lag(upto) OVER (ORDER BY bound), 0) AS before,
    coalesce(lag(bound) OVER (ORDER BY bound), 0) AS lower FROM m)
    SELECT coalesce((SELECT round(CASE WHEN upto = before THEN bound ELSE lower + (bound - lower) *
    (CAST(0.95 AS DOUBLE) * total - before) / (upto - before) END, 6) FROM w
    WHERE upto >= CAST(0.95 AS DOUBLE) * total ORDER BY bound LIMIT 1),
    (SELECT max(bound) FROM m)) AS quantile""",
    ("calls",),
)
def _(t):
    buckets = reports.bucket_counts(t.calls, "value", BOUNDS, ["label"])
    return r6(reports.bucket_quantile(buckets, 0.95), "quantile")


@query(
    "d33_ops_by_label",
    """SELECT label, count(*) AS calls, count(*) FILTER (WHERE failed) AS errors,
    round_even(avg(value), 1) AS avg_latency, round_even(avg(CASE WHEN failed THEN 1 ELSE 0 END), 4)
    AS error_rate FROM calls GROUP BY 1""",
    ("calls",),
)
def _(t):
    return reports.ops_by_label(t.calls)


@query(
    "d34_joint_distribution",
    f"""WITH {_PAIRS} SELECT index_a, index_b, count(*) AS n, round(count(*) /
    CAST((SELECT count(*) FROM pairs) AS DOUBLE), 6) AS share FROM pairs GROUP BY ALL""",
    ("responses",),
)
def _(t):
    return r6(dist.joint_distribution(joins.pair_answers(t.responses, "q_F", "q_O")), "share")


@query(
    "d35_verdicts",
    """WITH m AS (SELECT model_used, avg(CASE WHEN list_contains(validation_flags,
    'hallucination_detected') THEN 1 ELSE 0 END) AS hallucination_rate, avg(CASE WHEN
    list_contains(validation_flags, 'age_inconsistency') THEN 0 ELSE 1 END) AS consistency_score,
    avg(CASE WHEN is_valid THEN 1 ELSE 0 END) AS validity_share FROM generated GROUP BY 1),
    v AS (SELECT model_used, 'hallucination_rate' AS metric, hallucination_rate AS value,
    hallucination_rate < CAST(0.05 AS DOUBLE) AS passed FROM m UNION ALL SELECT model_used,
    'consistency_score', consistency_score, consistency_score > CAST(0.9 AS DOUBLE) FROM m UNION ALL
    SELECT model_used, 'validity_share', validity_share, validity_share > CAST(0.93 AS DOUBLE) FROM m)
    SELECT model_used, metric, round(value, 6) AS value, passed,
    bool_and(passed) OVER (PARTITION BY model_used) AS all_passed FROM v""",
    ("generated",),
)
def _(t):
    metrics = t.generated.groupBy("model_used").agg(
        reports.flag_rate().alias("hallucination_rate"),
        reports.consistency_rate().alias("consistency_score"),
        (F.count_if("is_valid") / F.count(F.lit(1))).alias("validity_share"),
    )
    out = reports.verdicts(metrics, reports.AUDIT_GATES, ["model_used"])
    return r6(out, "value").drop("rule", "threshold")


@query(
    "d36_compare_runs",
    """WITH s AS (SELECT model_used, question_id, avg(confidence) AS confidence,
    avg(generation_time_ms) AS latency FROM generated GROUP BY ALL) SELECT model_used,
    count(*) AS questions, round(avg(confidence), 6) AS confidence, round(avg(latency), 6) AS latency
    FROM s GROUP BY 1""",
    ("generated",),
)
def _(t):
    per = t.generated.groupBy("model_used", "question_id").agg(
        F.avg("confidence").alias("confidence"), F.avg("generation_time_ms").alias("latency")
    )
    return r6(reports.compare_runs(per, "model_used", ["confidence", "latency"]), "confidence", "latency")


@query(
    "d38_trace_durations",
    """SELECT label, round(sum(value), 4) AS duration, round(sum(value) / (SELECT sum(value) FROM calls),
    6) AS share FROM calls GROUP BY 1""",
    ("calls",),
)
def _(t):
    out = reports.trace_durations(t.calls, "label", "value")
    return r6(out, "share").withColumn("duration", F.round("duration", 4))


@query(
    "d39_contingency",
    f'WITH {_CELLS} SELECT question_id, dimension, "group", option_idx, option, n FROM tables',
    ("responses", "options"),
)
def _(t):
    return dist.contingency(t.responses, catalog_of(t), schemas.BREAKDOWN_DIMENSIONS)



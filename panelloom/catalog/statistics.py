"""Queries over tests, divergences, calibration, sampling, windows and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.catalog.aggregates import _CELLS, _COND, _GROUPS, catalog_of, r6
from panelloom.catalog.base import query
from panelloom.catalog.scans import _NEAR, _PAIRS, PAIR_CTES, aligned
from panelloom.operators import calibrate as cal
from panelloom.operators import distributions as dist
from panelloom.operators import eda, features, joins, sampling, stats, windows
from panelloom.operators import reports
from panelloom.session import materialize, small_table
from panelloom.sources import panel

BOTH = ("generated", "empirical", "options")
_PQ = f"""{PAIR_CTES}, pq AS (SELECT s.question_id, s.option_idx, s.option, s.mass AS p, q.mass AS q
  FROM source s JOIN target q ON s.question_id = q.question_id AND s.option_idx = q.option_idx)"""


def _js(p: str, q: str) -> str:
    m = f"(({p} + {q}) / 2)"
    return (
        f"sum(CASE WHEN {p} > 1e-12 THEN {p} * log2({p} / {m}) ELSE 0 END) / 2 + "
        f"sum(CASE WHEN {q} > 1e-12 THEN {q} * log2({q} / {m}) ELSE 0 END) / 2"
    )


# --- E ----------------------------------------------------------------------


@query(
    "e01_ks_two_sample",
    """WITH v AS (SELECT total_value AS v, is_promotion AS a FROM purchases),
    g AS (SELECT v, sum(CASE WHEN a THEN 1 ELSE 0 END) AS a, sum(CASE WHEN a THEN 0 ELSE 1 END) AS b
    FROM v GROUP BY v), c AS (SELECT sum(a) OVER (ORDER BY v) / CAST(sum(a) OVER () AS DOUBLE) AS fa,
    sum(b) OVER (ORDER BY v) / CAST(sum(b) OVER () AS DOUBLE) AS fb FROM g),
    s AS (SELECT max(abs(fa - fb)) AS d, (SELECT sum(a) FROM g) AS na, (SELECT sum(b) FROM g) AS nb FROM c)
    SELECT round(d, 6) AS statistic, na AS n_a, nb AS n_b, round((SELECT least(1, greatest(0,
    2 * sum((CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * j * j * d * d *
    (CAST(na AS DOUBLE) * nb / (na + nb)))))) FROM (SELECT unnest(range(1, 101)) AS j)), 6) AS p_value
    FROM s""",
    ("purchases",),
)
def _(t):
    out = stats.ks_by_flag(t.purchases, "total_value", "is_promotion")
    return r6(out, "statistic", "p_value")


_EVEN_P = """(SELECT sum(exp(-{x} / 2 + k * ln({x} / 2) - lgamma(k + 1)))
  FROM (SELECT unnest(range(0, 64)) AS k) WHERE k < {dof} / 2)"""


@query(
    "e02_chi_square_gof",
    """WITH o AS (SELECT question_id, option_idx, count(*) AS n FROM generated g JOIN options o
    USING (question_id) WHERE g.answer = o.option GROUP BY ALL), e AS (SELECT question_id, option_idx,
    count(*) AS n FROM empirical g JOIN options o USING (question_id) WHERE g.answer = o.option
    GROUP BY ALL), x AS (SELECT question_id, sum((o.n - e.e) * (o.n - e.e) / e.e) AS x, count(*) - 1 AS dof
    FROM o JOIN (SELECT question_id, option_idx, n * (SELECT sum(n) FROM o WHERE o.question_id =
    e.question_id) / CAST(sum(n) OVER (PARTITION BY question_id) AS DOUBLE) AS e FROM e) e
    USING (question_id, option_idx) GROUP BY 1)
    SELECT question_id, round(x, 6) AS statistic, dof, round(exp(-x / 2) * (1 + x / 2), 6) AS p_value
    FROM x""",
    BOTH,
)
def _(t):
    catalog = catalog_of(t)
    observed = dist.empirical_counts(t.generated, catalog).withColumnRenamed("count", "observed")
    expected = dist.empirical_counts(t.empirical, catalog).withColumnRenamed("count", "expected")
    pairs = observed.join(expected.drop("option"), ["question_id", "option_idx"])
    return r6(stats.chi_square_gof(pairs), "statistic", "p_value")


@query(
    "e03_chi_square_breakdown",
    f"""WITH {_CELLS}, m AS (SELECT *, sum(n) OVER (PARTITION BY question_id, dimension, option) AS r,
    sum(n) OVER (PARTITION BY question_id, dimension, "group") AS c,
    sum(n) OVER (PARTITION BY question_id, dimension) AS tot FROM tables),
    x AS (SELECT question_id, dimension, (count(DISTINCT option) - 1) * (count(DISTINCT "group") - 1)
    AS dof, sum((n - r * c / CAST(tot AS DOUBLE)) * (n - r * c / CAST(tot AS DOUBLE)) /
    (r * c / CAST(tot AS DOUBLE))) AS x, min(r * c / CAST(tot AS DOUBLE)) AS lo FROM m
    WHERE r > 0 AND c > 0 GROUP BY ALL), p AS (SELECT *, {_EVEN_P.format(x="x", dof="dof")} AS p FROM x)
    SELECT question_id, dimension, round_even(x, 4) AS chi2, CAST(dof AS INTEGER) AS dof,
    round_even(p, 6) AS p_value, lo >= 5 AS testable, CASE WHEN lo >= 5 THEN p < CAST(0.05 AS DOUBLE) END
    AS significant, CASE WHEN lo < 5 THEN 'expected cell count too small' END AS reason FROM p""",
    ("responses", "options"),
)
def _(t):
    tables = dist.contingency(
        t.responses, catalog_of(t), ["age_group", "income_group", "region", "behavioral_archetype"]
    )
    return stats.chi_square_breakdown(tables)


@query(
    "e04_js_divergence",
    f"WITH {_PQ} SELECT question_id, round({_js('p', 'q')}, 6) AS js FROM pq GROUP BY 1",
    BOTH,
)
def _(t):
    return r6(dist.divergences(aligned(t)).select("question_id", "js"), "js")


_W1 = """w AS (SELECT question_id, abs(sum(p - q) OVER (PARTITION BY question_id ORDER BY option_idx))
  AS gap FROM pq), w1 AS (SELECT question_id, sum(gap) AS w FROM w GROUP BY 1)"""


@query(
    "e05_wasserstein",
    f"WITH {_PQ}, {_W1} SELECT question_id, round(w, 6) AS wasserstein FROM w1",
    BOTH,
)
def _(t):
    return r6(dist.divergences(aligned(t)).select("question_id", "wasserstein"), "wasserstein")


@query(
    "e06_entropy",
    f"""WITH {_PQ} SELECT question_id, round(sum(-p * log2(p)), 6) AS entropy,
    round(sum(-p * log2(p)) / log2(count(*)), 6) AS normalized_entropy FROM pq GROUP BY 1""",
    BOTH,
)
def _(t):
    source = dist.weighted_distribution(t.generated, catalog_of(t), "loose_answer")
    return r6(dist.entropies(source), "entropy", "normalized_entropy")


@query(
    "e07_cosine",
    """WITH c AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m
    FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos,
    unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY label, pos) GROUP BY label)
    SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c.c), 6) AS cosine
    FROM embeddings JOIN c USING (label)""",
)
def _(t):
    means = features.centroids(t.embeddings, "label")
    joined = t.embeddings.join(means, "label")
    return joined.select(
        "id", F.round(stats.cosine(F.col("vector"), F.col("centroid")), 6).alias("cosine")
    )


@query(
    "e08_parity_gap",
    f"""WITH {_GROUPS}, {_PQ.replace(_NEAR + ', ', '')} SELECT g.question_id, g."group",
    round(sum(abs(g.mass - pq.p)) / 2, 6) AS gap FROM groups g JOIN pq ON g.question_id = pq.question_id
    AND g.option_idx = pq.option_idx GROUP BY ALL""",
    BOTH,
)
def _(t):
    catalog = catalog_of(t)
    groups = dist.group_distributions(t.generated, catalog, "age_group", "loose_answer")
    overall = dist.weighted_distribution(t.generated, catalog, "loose_answer")
    return r6(dist.parity_gap(groups, overall), "gap")


@query(
    "e09_pair_consistency",
    f"""WITH {_PAIRS}, r AS (SELECT *, rank() OVER (ORDER BY index_a) + (count(*) OVER
    (PARTITION BY index_a) - 1) / CAST(2 AS DOUBLE) AS ra, rank() OVER (ORDER BY index_b) + (count(*)
    OVER (PARTITION BY index_b) - 1) / CAST(2 AS DOUBLE) AS rb FROM pairs)
    SELECT count(*) AS pairs, round(corr(ra, rb), 6) AS spearman, round(avg(CASE WHEN
    abs(index_a / CAST(4 AS DOUBLE) - index_b / CAST(4 AS DOUBLE)) >= 0.75 THEN 1 ELSE 0 END), 6)
    AS contradiction_rate, round(1 - avg(CASE WHEN abs(index_a / CAST(4 AS DOUBLE) - index_b /
    CAST(4 AS DOUBLE)) >= 0.75 THEN 1 ELSE 0 END), 6) AS consistency_rate FROM r""",
    ("responses",),
)
def _(t):
    pairs = joins.pair_answers(t.responses, "q_F", "q_O")
    out = stats.pair_consistency(pairs, F.lit(5), F.lit(5))
    return r6(out, "spearman", "contradiction_rate", "consistency_rate")


_REFERENCE = """ref AS (SELECT unnest(['low','lower_middle','middle','upper_middle','high']) AS g,
  unnest([CAST(0.3 AS DOUBLE), CAST(0.25 AS DOUBLE), CAST(0.2 AS DOUBLE), CAST(0.15 AS DOUBLE),
  CAST(0.1 AS DOUBLE)]) AS s)"""


@query(
    "e10_representativeness",
    f"""WITH {_REFERENCE}, o AS (SELECT g AS "group", s, coalesce(n, 0) /
    CAST((SELECT count(*) FROM panelists) AS DOUBLE) AS o FROM ref LEFT JOIN (SELECT income_group,
    count(*) AS n FROM panelists GROUP BY 1) p ON p.income_group = ref.g)
    SELECT "group", round_even(o, 4) AS panel_share, round_even(s, 4) AS reference_share,
    round_even(o - s, 4) AS delta, max(abs(round_even(o - s, 4))) OVER () AS max_delta FROM o""",
    ("panelists",),
)
def _(t):
    reference = small_table(
        t.spark,
        [("low", 0.3), ("lower_middle", 0.25), ("middle", 0.2), ("upper_middle", 0.15), ("high", 0.1)],
        ["group", "reference_share"],
    )
    return stats.representativeness(t.panelists, "income_group", reference)


TARGETS = {
    "age_group": {"18-24": 0.1, "25-34": 0.2, "35-44": 0.2, "45-54": 0.2, "55-64": 0.15, "65+": 0.15},
    "income_group": {
        "low": 0.3, "lower_middle": 0.25, "middle": 0.2, "upper_middle": 0.15, "high": 0.1,
    },
}


@query(
    "e11_rake",
    " UNION ALL ".join(
        f"SELECT '{dim}' AS dimension, '{level}' AS level, CAST({share} AS DOUBLE) AS share, "
        "CAST(1 AS DOUBLE) AS mean_weight"
        for dim, levels in TARGETS.items()
        for level, share in levels.items()
    ),
)
def _(t):
    # The margins of the weighted panel must be the targets and the mean weight one.
    weighted = stats.rake(t.panelists.select("panelist_id", *TARGETS), TARGETS)
    totals = dist.one(weighted, F.struct(F.sum("weight").alias("w"), F.avg("weight").alias("m")))
    cells = weighted.groupBy(*TARGETS).agg(F.sum("weight").alias("w"))
    long = cells.unpivot(["w"], list(TARGETS), "dimension", "level")
    return long.groupBy("dimension", "level").agg(F.sum("w").alias("w")).select(
        "dimension", "level", F.round(F.col("w") / totals["w"], 5).alias("share"),
        F.round(totals["m"], 6).alias("mean_weight"),
    )


@query(
    "e12_metric_suite",
    f"""WITH {_PQ}, {_W1}, f AS (SELECT question_id, avg(CASE WHEN list_contains(validation_flags,
    'hallucination_detected') THEN 1 ELSE 0 END) AS hallucination_rate, avg(CASE WHEN
    list_contains(validation_flags, 'age_inconsistency') THEN 0 ELSE 1 END) AS consistency_score
    FROM generated GROUP BY 1) SELECT question_id, round({_js('p', 'q')}, 6) AS js,
    round(any_value(w), 6) AS wasserstein, round(sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))), 6)
    AS cosine, round(sum(-p * log2(p)), 6) AS entropy, round(sum(-p * log2(p)) / log2(count(*)), 6)
    AS normalized_entropy, round(any_value(hallucination_rate), 6) AS hallucination_rate,
    round(any_value(consistency_score), 6) AS consistency_score
    FROM pq JOIN w1 USING (question_id) JOIN f USING (question_id) GROUP BY question_id""",
    BOTH,
)
def _(t):
    rates = t.generated.groupBy("question_id").agg(
        reports.flag_rate().alias("hallucination_rate"),
        reports.consistency_rate().alias("consistency_score"),
    )
    out = dist.divergences(aligned(t)).drop("total_variation").join(rates, "question_id", "left")
    return r6(out, *[c for c in out.columns if c != "question_id"])


@query(
    "e13_overall_cosine",
    f"""WITH {_PQ} SELECT round(sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))), 6) AS cosine
    FROM pq""",
    BOTH,
)
def _(t):
    return r6(stats.overall_cosine(aligned(t)), "cosine")


_MONTHLY = """SELECT strftime(transaction_date, '%Y-%m') AS period, product_category AS c,
  count(*) AS n FROM purchases GROUP BY ALL"""


def _drift_sql(smooth: str, counts: str = _MONTHLY) -> str:
    return f"""n AS ({counts}), ps AS (SELECT period, row_number() OVER (ORDER BY period)
  AS rk FROM (SELECT DISTINCT period FROM n)), f AS (SELECT ps.period, ps.rk, cs.c,
  coalesce(n.n, 0) AS n FROM ps CROSS JOIN (SELECT DISTINCT c FROM n) cs LEFT JOIN n
  ON n.period = ps.period AND n.c = cs.c), b AS (SELECT c, sum(n) + CAST({smooth} AS DOUBLE) AS b FROM f
  WHERE rk <= 3 GROUP BY 1), x AS (SELECT period, (n + CAST(0.5 AS DOUBLE)) / sum(n +
  CAST(0.5 AS DOUBLE)) OVER (PARTITION BY period) AS p, b / sum(b) OVER (PARTITION BY period) AS q
  FROM f JOIN b USING (c) WHERE rk > 3), series AS (SELECT period, {_js('p', 'q')} AS d FROM x
  GROUP BY 1)"""


def _months(t):
    return t.purchases.select(
        F.date_format("transaction_date", "yyyy-MM").alias("month"), "product_category"
    )


@query(
    "e14_drift_pooled",
    f"WITH {_drift_sql('0.5')} SELECT period, round(d, 6) AS divergence FROM series",
    ("purchases",),
)
def _(t):
    return r6(stats.drift_pooled(_months(t), "month", "product_category"), "divergence")


@query(
    "e15_drift_summed",
    f"WITH {_drift_sql('1.5')} SELECT period, round(d, 6) AS divergence FROM series",
    ("purchases",),
)
def _(t):
    return r6(stats.drift_summed(_months(t), "month", "product_category"), "divergence")


def _decision_sql(k: str) -> str:
    return f"""lv AS (SELECT avg(d) AS m, stddev_pop(d) AS s, avg(d) + {k} * stddev_pop(d) AS l
  FROM series), j AS (SELECT period, d, d > l AS br, d > 2 * l AS hd, row_number() OVER
  (ORDER BY period) - row_number() OVER (PARTITION BY d > l ORDER BY period) AS isl FROM series, lv),
  st AS (SELECT *, CASE WHEN br THEN row_number() OVER (PARTITION BY br, isl ORDER BY period) ELSE 0 END
  AS streak FROM j), ru AS (SELECT *, CASE WHEN hd THEN 'hard' WHEN streak >= 2 THEN 'consecutive' END
  AS rule FROM st)"""


def drift_decision_sql(k_sigma: str, counts: str = _MONTHLY) -> str:
    """Decision over the series of ``counts(period, c, n)``."""
    return f"""WITH {_drift_sql('1.5', counts)}, {_decision_sql(k_sigma)} SELECT count(*) AS periods,
    count(*) FILTER (WHERE br) AS breaches, coalesce(string_agg(period, ',' ORDER BY period)
    FILTER (WHERE br), '') AS breach_periods, round(any_value(m), 6) AS noise_mean,
    round(any_value(s), 6) AS noise_std, round(any_value(l), 6) AS trigger_level,
    count(rule) > 0 AS fired, min(period) FILTER (WHERE rule IS NOT NULL) AS fired_period,
    arg_min(rule, period) FILTER (WHERE rule IS NOT NULL) AS rule FROM ru, lv"""


@query("e16_drift_decision", drift_decision_sql("1"), ("purchases",))
def _(t):
    series = stats.drift_summed(_months(t), "month", "product_category")
    return stats.drift_decision(series, k_sigma=1.0)


@query("e17_plan_entropy")
def _(t):
    pairs = aligned(t)
    plans = cal.transport_plans(pairs, cal.cost_cells(pairs), [0.05, 0.1, 0.5])
    return cal.plan_entropy(plans)


@query(
    "e18_diversity_check",
    f"""WITH {_PQ}, e AS (SELECT question_id, sum(-p * log2(p)) AS h FROM (SELECT question_id,
    CAST(0.7 AS DOUBLE) * q + CAST(0.3 AS DOUBLE) * p AS p FROM pq) GROUP BY 1)
    SELECT question_id, round_even(h, 3) AS entropy, h >= 2.5 AS acceptable, CASE WHEN h < 2.5 THEN
    round_even(CAST(0.1 AS DOUBLE) + (2.5 - h) * CAST(0.3 AS DOUBLE), 2) END AS adjustment FROM e""",
    BOTH,
)
def _(t):
    pairs = aligned(t)
    raw = dist.entropies(pairs.withColumn("mass", F.col("p"))).select("question_id", "entropy")
    shipped = dist.entropies(cal.calibrate(pairs)).select(
        "question_id", F.col("entropy").alias("calibrated_entropy")
    )
    return stats.diversity_check(raw.join(shipped, "question_id", "left"), floor=2.5)


# --- F ----------------------------------------------------------------------

_CAL = """cal AS (SELECT question_id, option_idx, option, p, q,
  CAST(0.7 AS DOUBLE) * q + CAST(0.3 AS DOUBLE) * p AS m FROM pq)"""


@query(
    "f01_calibrate",
    f"""WITH {_PQ}, {_CAL} SELECT question_id, option_idx, option, round(p, 6) AS source,
    round(q, 6) AS target, round(m, 6) AS mass FROM cal""",
    BOTH,
)
def _(t):
    return r6(cal.calibrate(aligned(t)), "source", "target", "mass")


@query(
    "f02_cost_cells",
    """SELECT a.question_id, a.option_idx AS i, b.option_idx AS j, (a.option_idx - b.option_idx) *
    (a.option_idx - b.option_idx) / CAST(16 AS DOUBLE) AS cost FROM options a JOIN options b
    USING (question_id)""",
    ("responses", "options"),
)
def _(t):
    return cal.cost_cells(dist.option_table(catalog_of(t)))


@query(
    "f02_cost_uncertainty",
    f"""WITH {_NEAR}, u AS (SELECT o.question_id, o.option_idx, coalesce(avg(greatest(0, least(1,
    coalesce(x.uncertainty, 1 - x.confidence)))), 0) AS u FROM options o LEFT JOIN (SELECT *
    FROM generated JOIN near USING (response_id)) x ON x.question_id = o.question_id
    AND x.option_idx = o.option_idx GROUP BY ALL)
    SELECT a.question_id, a.option_idx AS i, b.option_idx AS j, round((a.option_idx - b.option_idx) *
    (a.option_idx - b.option_idx) / CAST(16 AS DOUBLE) / (1 + 2 * a.u), 6) AS cost
    FROM u a JOIN u b USING (question_id)""",
    ("generated", "options"),
)
def _(t):
    options = dist.category_uncertainty(t.generated, catalog_of(t), "loose_answer")
    return r6(cal.cost_cells(options, eta=2.0), "cost")


@query(
    "f03_transport_marginals",
    f"""WITH {_PQ} SELECT question_id, option_idx, round(q, 5) AS mass, e AS epsilon FROM pq
    CROSS JOIN (SELECT unnest([CAST(0.05 AS DOUBLE), CAST(0.1 AS DOUBLE), CAST(1 AS DOUBLE)]) AS e)""",
    BOTH,
)
def _(t):
    # Column marginals of every plan equal the target, whatever epsilon is.
    pairs = aligned(t)
    plans = cal.transport_plans(pairs, cal.cost_cells(pairs), [0.05, 0.1, 1.0])
    return cal.plan_marginals(plans).withColumn("mass", F.round("mass", 5))


@query("f03_transport_plans")
def _(t):
    pairs = aligned(t)
    plans = cal.transport_plans(pairs, cal.cost_cells(pairs), [0.05, 0.1, 1.0])
    return plans.drop("history")


@query(
    "f04_calibration_metrics",
    f"""WITH {_PQ}, {_CAL}, j AS (SELECT question_id, {_js('p', 'q')} AS jb, {_js('m', 'q')} AS ja FROM cal
    GROUP BY 1), g AS (SELECT question_id, abs(sum(p - q) OVER w) AS gb, abs(sum(m - q) OVER w) AS ga
    FROM cal WINDOW w AS (PARTITION BY question_id ORDER BY option_idx)), w AS (SELECT question_id,
    sum(gb) AS wb, sum(ga) AS wa FROM g GROUP BY 1) SELECT question_id, round(wb, 6) AS wasserstein_before,
    round(wa, 6) AS wasserstein_after, round(jb, 6) AS js_before, round(ja, 6) AS js_after,
    round((wb - wa) / wb * 100, 2) AS wasserstein_improvement_pct, round((jb - ja) / jb * 100, 2)
    AS js_improvement_pct FROM j JOIN w USING (question_id)""",
    BOTH,
)
def _(t):
    return cal.calibration_metrics(cal.calibrate(aligned(t)))


_REPAIR = """d AS (SELECT g.question_id, g."group", g.option_idx, g.mass AS gm, c.m AS om,
  sum(abs(g.mass - c.m)) OVER (PARTITION BY g.question_id, g."group") / 2 AS gap FROM groups g JOIN cal c
  ON g.question_id = c.question_id AND g.option_idx = c.option_idx), e AS (SELECT *, CASE WHEN gap >
  CAST(0.1 AS DOUBLE) THEN CAST(0.8 AS DOUBLE) * gm + CAST(0.2 AS DOUBLE) * om ELSE gm END AS am FROM d),
  gaps AS (SELECT question_id, "group", round_even(any_value(gap), 4) AS gap_before,
  round_even(sum(abs(am - om)) / 2, 4) AS gap_after FROM e GROUP BY ALL)"""


@query(
    "f05_fairness_repair",
    f"WITH {_GROUPS}, {_PQ.replace(_NEAR + ', ', '')}, {_CAL}, {_REPAIR} SELECT * FROM gaps",
    BOTH,
)
def _(t):
    groups = dist.group_distributions(t.generated, catalog_of(t), "age_group", "loose_answer")
    return cal.parity_gaps(cal.fairness_repair(groups, cal.calibrate(aligned(t))))


@query(
    "f06_calibrate_survey",
    f"""WITH {_GROUPS}, {_PQ.replace(_NEAR + ', ', '')}, {_CAL}, {_REPAIR}, j AS (SELECT question_id,
    {_js('p', 'q')} AS jb, {_js('m', 'q')} AS ja FROM cal GROUP BY 1), g2 AS (SELECT question_id,
    abs(sum(p - q) OVER w) AS gb, abs(sum(m - q) OVER w) AS ga FROM cal WINDOW w AS
    (PARTITION BY question_id ORDER BY option_idx)), w AS (SELECT question_id, sum(gb) AS wb,
    sum(ga) AS wa FROM g2 GROUP BY 1), mg AS (SELECT question_id, max(gap_before) AS max_gap_before,
    max(gap_after) AS max_gap_after FROM gaps GROUP BY 1)
    SELECT question_id, round(wb, 6) AS wasserstein_before, round(wa, 6) AS wasserstein_after,
    round(jb, 6) AS js_before, round(ja, 6) AS js_after, round((wb - wa) / wb * 100, 2)
    AS wasserstein_improvement_pct, round((jb - ja) / jb * 100, 2) AS js_improvement_pct,
    max_gap_before, max_gap_after FROM j JOIN w USING (question_id) JOIN mg USING (question_id)""",
    BOTH,
)
def _(t):
    return cal.calibrate_survey(t.generated, t.empirical, catalog_of(t), "loose_answer")


@query(
    "f07_calibration_sweep",
    f"""WITH {_GROUPS}, {_PQ.replace(_NEAR + ', ', '')}, {_CAL}, {_REPAIR},
    s AS (SELECT question_id, option_idx, b, q, b * p + (1 - b) * q AS m FROM pq CROSS JOIN
    (SELECT unnest([CAST(0 AS DOUBLE), CAST(0.3 AS DOUBLE), CAST(0.6 AS DOUBLE)]) AS b)),
    j AS (SELECT question_id, b, round_even({_js('m', 'q')}, 6) AS js FROM s GROUP BY ALL),
    g2 AS (SELECT question_id, b, abs(sum(m - q) OVER (PARTITION BY question_id, b ORDER BY option_idx))
    AS g FROM s), w AS (SELECT question_id, b, round_even(sum(g), 6) AS w FROM g2 GROUP BY ALL)
    SELECT 'blend' AS parameter, b AS value, round(avg(w), 6) AS wasserstein, round(avg(js), 6) AS js,
    CAST(NULL AS DOUBLE) AS gap FROM j JOIN w USING (question_id, b) GROUP BY b UNION ALL
    SELECT 'fairness', CAST(0.2 AS DOUBLE), NULL, NULL, round(avg(gap_after), 6) FROM gaps""",
    BOTH,
)
def _(t):
    groups = dist.group_distributions(t.generated, catalog_of(t), "age_group", "loose_answer")
    out = cal.calibration_sweep(aligned(t), [0.0, 0.3, 0.6], [0.2], groups)
    return r6(out, "wasserstein", "js", "gap")


@query("f07_epsilon_sweep")
def _(t):
    pairs = materialize(aligned(t), "pairs")
    return cal.epsilon_sweep(cal.transport_plans(pairs, cal.cost_cells(pairs), [0.05, 0.1, 0.5, 1.0]))


@query(
    "f08_mix_conditionals",
    f"""WITH {_COND}, sh AS (SELECT behavioral_archetype, count(*) / CAST((SELECT count(*) FROM panelists)
    AS DOUBLE) AS w FROM panelists GROUP BY 1) SELECT question_id, option_idx, option,
    round(sum(w * mass), 6) AS mass FROM cond JOIN sh USING (behavioral_archetype) GROUP BY ALL""",
    ("empirical", "options"),
)
def _(t):
    cond = dist.conditional_distribution(t.empirical, catalog_of(t))
    return r6(dist.mix_conditionals(cond, t.panelists), "mass")


# --- G ----------------------------------------------------------------------

_DRAW = "((CAST(panelist_id AS BIGINT) % 2147483647) * 48271) % 2147483647"


def _draw_order():
    return F.pmod(
        F.pmod(F.col("panelist_id").cast("bigint"), F.lit(2_147_483_647)) * F.lit(48_271),
        F.lit(2_147_483_647),
    )


@query(
    "g01_stratified_sample",
    f"""WITH r AS (SELECT *, {_DRAW} AS h FROM panelists), p AS (SELECT *, row_number() OVER
    (PARTITION BY behavioral_archetype ORDER BY h, panelist_id) AS pos, count(*) OVER
    (PARTITION BY behavioral_archetype) AS sz, count(*) OVER () AS tot FROM r)
    SELECT panelist_id, behavioral_archetype FROM p ORDER BY CASE WHEN pos <= least(sz, greatest(1,
    floor(101 * (sz / CAST(tot AS DOUBLE))))) THEN 0 ELSE 1 END, h, panelist_id LIMIT 101""",
    ("panelists",),
)
def _(t):
    return sampling.stratified_sample(
        t.panelists, 101, "behavioral_archetype", "panelist_id", order=_draw_order()
    ).select("panelist_id", "behavioral_archetype")


@query(
    "g02_sample_n",
    f"SELECT panelist_id FROM panelists ORDER BY {_DRAW}, panelist_id LIMIT 50",
    ("panelists",),
)
def _(t):
    return sampling.sample_n(t.panelists, 50, "panelist_id", order=_draw_order()).select("panelist_id")


_U = f"{_DRAW} / CAST(2147483647 AS DOUBLE)"


@query(
    "g03_impute_answers",
    f"""WITH {_COND}, cd AS (SELECT *, sum(mass) OVER (PARTITION BY question_id, behavioral_archetype
    ORDER BY option_idx) AS hi FROM cond), f AS (SELECT p.panelist_id, p.behavioral_archetype, q.question_id,
    {_U} AS u FROM panelists p CROSS JOIN (SELECT DISTINCT question_id FROM responses) q)
    SELECT f.panelist_id, f.question_id, min(cd.option_idx) AS answer_index FROM f JOIN cd
    ON f.question_id = cd.question_id AND f.behavioral_archetype = cd.behavioral_archetype AND f.u < cd.hi
    GROUP BY ALL""",
    ("empirical", "options"),
)
def _(t):
    catalog = catalog_of(t)
    cond = dist.conditional_distribution(t.empirical, catalog)
    frame = sampling.cross_frame(t.panelists.select("panelist_id", "behavioral_archetype"), catalog)
    u = sampling.unit_hash(F.col("panelist_id").cast("bigint"))
    return sampling.impute_answers(frame, cond, catalog, u).select(
        "panelist_id", "question_id", "answer_index"
    )


@query(
    "g04_quantile_map",
    f"""WITH {PAIR_CTES}, cd AS (SELECT question_id, option_idx, sum(mass) OVER (PARTITION BY question_id
    ORDER BY option_idx) AS hi FROM target), f AS (SELECT panelist_id, question_id, {_U} AS u FROM panelists
    CROSS JOIN (SELECT DISTINCT question_id FROM options)) SELECT panelist_id, question_id,
    min(option_idx) AS answer_index FROM f JOIN cd USING (question_id) WHERE hi >= u GROUP BY ALL""",
    BOTH,
)
def _(t):
    catalog = catalog_of(t)
    frame = sampling.cross_frame(t.panelists.select("panelist_id"), catalog).withColumn(
        "u", sampling.unit_hash(F.col("panelist_id").cast("bigint"))
    )
    return sampling.quantile_map(frame, dist.empirical_target(t.empirical, catalog)).drop("u")


# --- H ----------------------------------------------------------------------


@query(
    "h01_rfm_scores",
    """WITH r AS (SELECT panelist_id, date_diff('day', max(transaction_date), DATE '2001-12-31') AS rd,
    count(*) AS f, round(sum(total_value), 2) AS m FROM purchases GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY rd DESC, panelist_id) AS kr, row_number() OVER
    (ORDER BY f, panelist_id) AS kf, row_number() OVER (ORDER BY m, panelist_id) AS km,
    count(*) OVER () AS n FROM r) SELECT panelist_id,
    CAST(greatest(1, ceil(5 * (kr - 1) / CAST(n - 1 AS DOUBLE))) AS INTEGER) AS recency_days_score,
    CAST(greatest(1, ceil(5 * (kf - 1) / CAST(n - 1 AS DOUBLE))) AS INTEGER) AS frequency_score,
    CAST(greatest(1, ceil(5 * (km - 1) / CAST(n - 1 AS DOUBLE))) AS INTEGER) AS monetary_score FROM k""",
    ("purchases",),
)
def _(t):
    return eda.rfm_scores(eda.rfm(t.purchases, "2001-12-31")).drop(
        "recency_days", "frequency", "monetary"
    )


@query(
    "h02_temporal_views",
    """WITH p AS (SELECT panelist_id, line_ref, row_number() OVER (PARTITION BY panelist_id
    ORDER BY transaction_date, line_ref) AS pos, count(*) OVER (PARTITION BY panelist_id) AS n
    FROM purchases) SELECT panelist_id, line_ref, CASE WHEN pos <= floor(n / 2) THEN 1 ELSE 2 END AS "view"
    FROM p WHERE n >= 4""",
    ("purchases",),
)
def _(t):
    rows = t.purchases.select("panelist_id", "transaction_date", "line_ref")
    return sampling.midpoint_views(rows, "panelist_id", ["transaction_date", "line_ref"]).select(
        "panelist_id", "line_ref", "view"
    )


@query(
    "h03_streaks",
    """WITH e AS (SELECT event_id, key, event_time, value > 20 AS c, row_number() OVER (PARTITION BY key
    ORDER BY event_time, event_id) - row_number() OVER (PARTITION BY key, value > 20 ORDER BY event_time,
    event_id) AS isl FROM calls) SELECT event_id, CASE WHEN c THEN row_number() OVER
    (PARTITION BY key, c, isl ORDER BY event_time, event_id) ELSE 0 END AS streak FROM e""",
    ("calls",),
)
def _(t):
    rows = t.calls.withColumn("c", F.col("value") > 20)
    return stats.event_streaks(rows, "key", ["event_time", "event_id"], "c").select(
        "event_id", "streak"
    )


@query(
    "h04_last_n",
    """SELECT panelist_id, line_ref FROM purchases QUALIFY row_number() OVER (PARTITION BY panelist_id
    ORDER BY transaction_date DESC, line_ref DESC) <= 5""",
    ("purchases",),
)
def _(t):
    return windows.last_n(t.purchases, "panelist_id", ["transaction_date", "line_ref"], 5).select(
        "panelist_id", "line_ref"
    )


@query(
    "h05_cdf",
    f"""WITH {PAIR_CTES} SELECT question_id, option_idx, round(sum(mass) OVER (PARTITION BY question_id
    ORDER BY option_idx), 6) AS cdf FROM target""",
    BOTH,
)
def _(t):
    target = dist.empirical_target(t.empirical, catalog_of(t))
    return dist.cdf(target).select("question_id", "option_idx", F.round("cdf_hi", 6).alias("cdf"))


@query(
    "h06_share",
    """SELECT region, product_category, round(v / sum(v) OVER (PARTITION BY region), 6) AS share FROM
    (SELECT region, product_category, sum(total_value) AS v FROM purchases JOIN panelists
    USING (panelist_id) GROUP BY ALL)""",
    ("panelists", "purchases"),
)
def _(t):
    joined = t.purchases.join(t.panelists.select("panelist_id", "region"), "panelist_id")
    return r6(
        windows.share(joined, ["region"], ["product_category"], F.sum("total_value")), "share"
    ).drop("amount")


@query(
    "h07_first_fire",
    """SELECT key, min(event_time) AS first_time, arg_min(event_id, event_time) AS first_event FROM calls
    WHERE failed GROUP BY 1""",
    ("calls",),
)
def _(t):
    return windows.first_fire(t.calls, ["key"], F.col("failed"), "event_time", "event_id")


@query(
    "h08_events_in_window",
    """SELECT event_id, count(*) OVER (PARTITION BY key ORDER BY epoch_us(event_time)
    RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS recent FROM calls""",
    ("calls",),
)
def _(t):
    return windows.events_in_window(t.calls, "key", "event_time", "event_id", 86_400).select(
        "event_id", "recent"
    )


@query(
    "h09_load_delta",
    """WITH l AS (SELECT strftime(transaction_date, '%Y-%m') AS load, count(*) AS n FROM purchases
    GROUP BY 1) SELECT load, n, lag(n) OVER (ORDER BY load) AS previous, round(abs(n - lag(n)
    OVER (ORDER BY load)) / CAST(lag(n) OVER (ORDER BY load) AS DOUBLE), 6) AS delta FROM l""",
    ("purchases",),
)
def _(t):
    loads = t.purchases.groupBy(F.date_format("transaction_date", "yyyy-MM").alias("load")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return r6(windows.load_delta(loads, "load", "n"), "delta")


# --- I and J ------------------------------------------------------------------


@query(
    "i01_top_n",
    """SELECT brand, round(sum(total_value), 2) AS spend FROM purchases GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 7""",
    ("purchases",),
)
def _(t):
    return windows.top_n(t.purchases, "brand", F.round(F.sum("total_value"), 2), "spend", 7)


@query(
    "i02_bounded_head",
    "SELECT panelist_id FROM panelists ORDER BY panelist_id LIMIT 40",
    ("panelists",),
)
def _(t):
    return panel.scan_panelists(t.panelists, None, 100, cap=40).select("panelist_id")


@query(
    "i03_order_scale",
    """SELECT income_group, count(*) AS n, list_position(['low','lower_middle','middle','upper_middle',
    'high'], income_group) - 1 AS place FROM panelists GROUP BY 1""",
    ("panelists",),
)
def _(t):
    counts = t.panelists.groupBy("income_group").agg(F.count(F.lit(1)).alias("n"))
    return windows.order_scale(counts, "income_group", "place")


@query(
    "i05_recent",
    """SELECT event_id, event_time FROM calls WHERE event_time >= TIMESTAMP '2024-01-20'
    ORDER BY event_time DESC, event_id DESC LIMIT 25""",
    ("calls",),
)
def _(t):
    return windows.recent(t.calls, "event_time", "event_id", "2024-01-20", 25).select(
        "event_id", "event_time"
    )


@query(
    "j01_union_rates",
    """SELECT count(*) AS n, round(avg(CASE WHEN is_valid THEN 1 ELSE 0 END), 6) AS validity_share
    FROM generated""",
    ("generated",),
)
def _(t):
    accepted = t.generated.filter("is_valid")
    rejected = t.generated.filter("NOT is_valid")
    return accepted.unionByName(rejected).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("is_valid").cast("int")), 6).alias("validity_share"),
    )


@query(
    "j02_dedupe",
    """SELECT o_custkey AS customer, o_orderstatus AS status, min(o_orderkey) AS order_key,
    arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY ALL""",
)
def _(t):
    from panelloom.functions.ranking import first_rows

    rows = t.raw("orders").select(
        F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderkey").alias("order_key"), F.col("o_orderpriority").alias("priority"),
    )
    return first_rows(rows, ["customer", "status"], ["order_key"])


@query(
    "j03_distinct_sorted",
    """SELECT period, row_number() OVER (ORDER BY period) AS position FROM (SELECT DISTINCT
    strftime(transaction_date, '%Y-%m') AS period FROM purchases)""",
    ("purchases",),
)
def _(t):
    from panelloom.functions.ranking import positions

    periods = t.purchases.select(F.date_format("transaction_date", "yyyy-MM").alias("period"))
    return positions(periods.distinct(), ["period"])


@query(
    "j05_flags_overlap",
    """SELECT len(list_intersect(validation_flags, ['age_inconsistency', 'invalid_option'])) > 0 AS hit,
    count(*) AS n FROM generated GROUP BY 1""",
    ("generated",),
)
def _(t):
    wanted = F.array(F.lit("age_inconsistency"), F.lit("invalid_option"))
    return t.generated.groupBy(F.arrays_overlap("validation_flags", wanted).alias("hit")).agg(
        F.count(F.lit(1)).alias("n")
    )

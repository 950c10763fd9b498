"""Queries over scans, predicates and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.catalog.base import folder, query
from panelloom.functions import expr
from panelloom.operators import distributions as dist
from panelloom.operators import quality, sampling
from panelloom.session import materialize, small_table
from panelloom.sources import landings, panel

# --- A: scans -------------------------------------------------------------


@query(
    "a01_panel_scan",
    "SELECT panelist_id, age_group, income_group, region, household_size, education_level, "
    "employment_status, has_children, behavioral_archetype, expansion_factor FROM panelists",
    ("panelists",),
)
def _(t):
    # A round trip through files with the fixed schema.
    stored = t.panelists.withColumn("panel_join_date", F.lit(None).cast("date")).withColumn(
        "age", F.lit(None).cast("int")
    )
    path = materialize(stored, "panelists").inputFiles()[0].rsplit("/", 1)[0]
    return panel.read_panel(t.spark, path, "panelists").drop("panel_join_date", "age")


@query(
    "a02_scan_panelists",
    "SELECT * FROM panelists WHERE region = 'ASIA' AND age_group = '25-34'",
    ("panelists",),
)
def _(t):
    return panel.scan_panelists(
        t.panelists, {"region": "ASIA", "age_group": "25-34", "unknown": "x"}
    )


@query(
    "a03_scan_purchases",
    """SELECT * FROM purchases WHERE transaction_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'
    AND panelist_id IN (SELECT panelist_id FROM panelists WHERE region = 'EUROPE')""",
    ("panelists", "purchases"),
)
def _(t):
    cohort = t.panelists.filter(F.col("region") == "EUROPE")
    return panel.scan_purchases(t.purchases, cohort, "1996-01-01", "1997-12-31")


@query(
    "a04_derive_products",
    """SELECT product_category, brand, round(avg(unit_price), 6) AS avg_price,
    count(*) AS transactions FROM purchases GROUP BY ALL""",
    ("purchases",),
)
def _(t):
    return panel.derive_products(t.purchases).withColumn("avg_price", F.round("avg_price", 6))


@query(
    "a05_scan_responses",
    """SELECT response_id, panelist_id, question_id, answer, answer_index, response_date
    FROM responses WHERE question_id IN ('q_F', 'q_O')""",
    ("responses",),
)
def _(t):
    return panel.scan_responses(t.responses, ["q_F", "q_O"]).select(
        "response_id", "panelist_id", "question_id", "answer", "answer_index", "response_date"
    )


@query(
    "a06_panel_summary",
    """SELECT (SELECT count(*) FROM panelists) AS panelists,
    (SELECT count(*) FROM purchases) AS purchases,
    (SELECT count(*) FROM responses) AS survey_responses,
    (SELECT min(transaction_date) FROM purchases) AS first_purchase,
    (SELECT max(transaction_date) FROM purchases) AS last_purchase""",
    ("panelists", "purchases", "responses"),
)
def _(t):
    return panel.panel_summary(t.panelists, t.purchases, t.responses)


@query(
    "a08_data_version",
    """SELECT substr(sha256('panelists:' || (SELECT count(*) FROM panelists) || 'purchases:' ||
    (SELECT count(*) FROM purchases) || 'survey_responses:' || (SELECT count(*) FROM responses)),
    1, 16) AS data_version""",
    ("panelists", "purchases", "responses"),
)
def _(t):
    return panel.data_version(
        {"panelists": t.panelists, "purchases": t.purchases, "survey_responses": t.responses}
    )


_VERSIONED = ["brand", "is_promotion", "line_ref", "panelist_id", "product_category", "quantity", "transaction_date"]


@query(
    "a08_content_version",
    f"""WITH d AS (SELECT md5(concat_ws(chr(31), {", ".join(
        f"coalesce('=' || CAST({c} AS VARCHAR), '-')" for c in _VERSIONED)})) AS digest FROM purchases)
    SELECT count(*) AS rows, left(sha256(count(*) || ':' || sum(CAST('0x' || substr(digest, 1, 15) AS BIGINT))
    || ':' || sum(CAST('0x' || substr(digest, 16, 15) AS BIGINT))), 16) AS content FROM d""",
    ("purchases",),
)
def _(t):
    return panel.content_version(t.purchases.select(*_VERSIONED))


def _pew(t):
    """Answers of the panel laid out as one wave: a row per respondent."""
    wide = t.responses.groupBy("panelist_id", "age_group").pivot(
        "question_id", ["q_F", "q_O", "q_P"]
    ).agg(F.first("answer"))
    return wide.select(
        F.col("panelist_id").alias("QKEY"), F.lit(1.0).alias("WEIGHT"),
        F.col("age_group").alias("F_AGECAT"), F.col("q_F").alias("ATP_Q1"),
        F.col("q_O").alias("ATP_Q2"), F.col("q_P").alias("ATP_Q3"),
    )


_WAVE = """wave AS (SELECT panelist_id AS qkey, age_group,
  max(CASE WHEN question_id = 'q_F' THEN answer END) AS atp_q1,
  max(CASE WHEN question_id = 'q_O' THEN answer END) AS atp_q2,
  max(CASE WHEN question_id = 'q_P' THEN answer END) AS atp_q3
  FROM responses GROUP BY panelist_id, age_group)"""


@query(
    "a11_land_wave",
    f"WITH {_WAVE} SELECT qkey, CAST(1 AS DOUBLE) AS weight, age_group AS f_agecat, atp_q1, atp_q2, "
    "atp_q3, 'pew_atp' AS source, '119' AS wave_id FROM wave",
    ("responses",),
)
def _(t):
    # A test-scale panel is smaller than a real wave, hence the lower size floor.
    return landings.land_pew(_pew(t), "119", min_rows=100).drop("ingested_at")


@query(
    "a12_land_round",
    """SELECT panelist_id AS idno, region AS cntry, answer_index AS trstplc, 'ess' AS source,
    '11' AS round_id FROM responses""",
    ("responses",),
)
def _(t):
    rows = t.responses.select(
        F.col("panelist_id").alias("IDNO"), F.col("region").alias("CNTRY"),
        F.lit(11).alias("essround"), F.col("answer_index").alias("trstplc"),
        F.col("income_group").alias("unrelated"),
    )
    return landings.land_ess(rows, "11").drop("ingested_at")


def _personas(t):
    return t.responses.groupBy(F.col("panelist_id").alias("persona_id")).agg(
        F.collect_list(F.struct(F.col("question_id").alias("q"), F.col("answer").alias("a"))).alias(
            "responses"
        )
    )


@query(
    "a13_land_personas",
    """SELECT question_id AS q, answer AS a, panelist_id AS persona_id, 'twin2k_500' AS source,
    'v1' AS release FROM responses""",
    ("responses",),
)
def _(t):
    return landings.land_twin2k(_personas(t), "v1", min_personas=100).drop("ingested_at")


@query(
    "a14_land_generic",
    """SELECT panelist_id AS household_id, product_category, total_value AS basket_value,
    'kaggle' AS source, 'panel/purchases' AS dataset_ref FROM purchases""",
    ("purchases",),
)
def _(t):
    rows = t.purchases.select(
        F.col("panelist_id").alias(" Household ID"),
        F.col("product_category").alias("Product Category"),
        F.col("total_value").alias("Basket Value "),
    )
    return landings.land_generic_csv(rows, "panel/purchases").drop("ingested_at")


@query(
    "a15_write_landing",
    f"WITH {_WAVE} SELECT 'pew' AS source, '119' AS version, 'parquet' AS file_format, "
    "count(*) AS row_count, 6 AS columns FROM wave",
    ("responses",),
)
def _(t):
    root = folder(t, "landings")
    manifest = landings.write_landing(_pew(t), root, "pew", "119")
    return manifest.select(
        "source", F.col("version").cast("string").alias("version"), "file_format", "row_count",
        F.size("schema_columns").alias("columns"),
    )


@query(
    "a16_upsert",
    """SELECT question_id, panelist_id, coalesce(e.answer, g.answer) AS answer, coalesce(e.seq, g.seq) AS seq
    FROM empirical e FULL JOIN (SELECT question_id, panelist_id, answer, seq FROM generated) g
    USING (question_id, panelist_id) WHERE e.seq IS NULL OR g.seq IS NULL
    UNION ALL SELECT e.question_id, e.panelist_id, CASE WHEN e.seq > g.seq THEN e.answer ELSE g.answer END,
    greatest(e.seq, g.seq) FROM empirical e JOIN generated g USING (question_id, panelist_id)""",
    ("empirical", "generated"),
)
def _(t):
    columns = ["question_id", "panelist_id", "answer", "seq"]
    return panel.upsert(
        t.empirical.select(*columns), t.generated.select(*columns), ["question_id", "panelist_id"], "seq"
    )


@query(
    "a17_append_fetch",
    """SELECT response_id, panelist_id, answer FROM (SELECT * FROM empirical UNION ALL BY NAME
    SELECT response_id, panelist_id, question_id, question_text, question_type, answer, answer_index,
    response_date, seq, age_group, income_group, region, behavioral_archetype, expansion_factor
    FROM generated) WHERE question_id = 'q_O' ORDER BY response_id LIMIT 100""",
    ("empirical", "generated"),
)
def _(t):
    columns = ["response_id", "panelist_id", "question_id", "answer"]
    path = folder(t, "appended")
    panel.append_rows(t.empirical.select(*columns), path)
    panel.append_rows(t.generated.select(*columns), path)
    stored = t.spark.read.parquet(path)
    return panel.fetch_rows(stored, {"question_id": "q_O"}, 100, ["response_id"]).drop("question_id")


@query(
    "a18_cohort_working_set",
    "SELECT panelist_id, region FROM panelists WHERE income_group = 'middle'",
    ("panelists",),
)
def _(t):
    from panelloom.sources import store

    path = folder(t, "cohorts")
    for run, income in (("run_1", "low"), ("run_2", "middle")):
        cohort = t.panelists.filter(F.col("income_group") == income).select("panelist_id", "region")
        store.save_cohort(cohort, path, run)
    return store.load_cohort(t.spark, path, "run_2")


@query(
    "a19_embedding_artifact",
    """WITH e AS (SELECT vec_id AS id, label, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total,
    round(CAST(embedding[1] AS DOUBLE), 4) AS first FROM embeddings)
    SELECT 'v1' AS version, id, label, total, first FROM e UNION ALL
    SELECT 'v2', id, label, -total, -first FROM e WHERE label < 5""",
)
def _(t):
    # Two versions are stored; each comes back as it was written, and a stale one gives no rows.
    from panelloom.sources import store

    path = folder(t, "vectors")
    store.save_embeddings(t.embeddings, path, "v1")
    turned = t.embeddings.filter("label < 5").withColumn("vector", F.transform("vector", lambda x: -x))
    store.save_embeddings(turned, path, "v2")
    found = [
        store.load_embeddings(t.spark, path, version).select(
            F.lit(version).alias("version"), "id", "label",
            F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("total"),
            F.round(F.get("vector", F.lit(0)), 4).alias("first"),
        )
        for version in ("v0", "v1", "v2")
    ]
    return reduce(DataFrame.unionByName, found)


# --- B: projections and predicates ----------------------------------------

_BIN = """CASE WHEN unit_price < 2 THEN 'budget' WHEN unit_price < 5 THEN 'value'
 WHEN unit_price < 10 THEN 'mid' WHEN unit_price < 20 THEN 'premium' ELSE 'luxury' END"""
_TIER = """CASE WHEN unit_price IS NULL OR unit_price < 0 THEN 'nan' WHEN unit_price <= 2 THEN 'budget'
 WHEN unit_price <= 5 THEN 'value' WHEN unit_price <= 10 THEN 'mid'
 WHEN unit_price <= 20 THEN 'premium' ELSE 'luxury' END"""


@query(
    "b01_price_bin",
    f"SELECT {_BIN} AS price_bin, count(*) AS n FROM purchases GROUP BY 1",
    ("purchases",),
)
def _(t):
    return t.purchases.groupBy(expr.price_bin("unit_price").alias("price_bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "b02_price_tier",
    f"SELECT {_TIER} AS price_tier, count(*) AS n FROM purchases GROUP BY 1",
    ("purchases",),
)
def _(t):
    return t.purchases.groupBy(expr.price_tier("unit_price").alias("price_tier")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "b03_behavior_token",
    f"""SELECT product_category || '|' || {_BIN} || '|' ||
    CASE WHEN is_promotion THEN 'promo' ELSE 'no_promo' END AS token, count(*) AS n
    FROM purchases GROUP BY 1""",
    ("purchases",),
)
def _(t):
    return panel.tokens_of(t.purchases).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b04_validate_rows",
    """SELECT count(*) AS total_rows, count(*) FILTER (WHERE NOT (quantity >= 5 AND unit_price >= 0
    AND total_value >= 0)) AS invalid_rows, 'quantity' AS first_error FROM (SELECT *,
    quantity - 4 AS q FROM purchases)""",
    ("purchases",),
)
def _(t):
    # Quantities of four and less fall below one and break the contract.
    rows = t.purchases.withColumn("quantity", F.col("quantity") - 4)
    checked = quality.validate_rows(rows, "purchases", tolerance=1.0)
    return checked.report.select("total_rows", "invalid_rows", "first_error")


@query(
    "b05_normalize_scale",
    """SELECT CASE WHEN income_group IN ('low', 'middle', 'high') THEN income_group ELSE 'unknown' END
    AS income_group, count(*) AS n FROM panelists GROUP BY 1""",
    ("panelists",),
)
def _(t):
    scale = ["low", "middle", "high"]
    return t.panelists.groupBy(
        expr.normalize_scale("income_group", scale).alias("income_group")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b06_match_exact",
    """SELECT g.question_id, o.option_idx, count(*) AS n FROM generated g JOIN options o
    ON g.question_id = o.question_id AND lower(trim(g.loose_answer)) = lower(trim(o.option))
    GROUP BY ALL""",
    ("generated", "options"),
)
def _(t):
    catalog = t.catalog
    return dist.matched_counts(t.generated, catalog, "exact", "loose_answer").withColumnRenamed(
        "count", "n"
    )


_NEAR = """near AS (SELECT g.response_id, min(CASE WHEN lower(trim(g.loose_answer)) = lower(trim(o.option))
  THEN o.option_idx ELSE 1000 + o.option_idx END) % 1000 AS option_idx FROM generated g JOIN options o
  ON g.question_id = o.question_id AND (contains(lower(trim(g.loose_answer)), lower(trim(o.option)))
  OR contains(lower(trim(o.option)), lower(trim(g.loose_answer)))) GROUP BY g.response_id)"""


@query(
    "b07_match_first_substring",
    f"""WITH {_NEAR} SELECT g.question_id, near.option_idx, count(*) AS n FROM generated g
    JOIN near USING (response_id) GROUP BY ALL""",
    ("generated", "options"),
)
def _(t):
    catalog = t.catalog
    return dist.matched_counts(
        t.generated, catalog, "first_substring", "loose_answer"
    ).withColumnRenamed("count", "n")


@query(
    "b08_valid_option",
    f"""WITH {_NEAR} SELECT g.question_id, (near.option_idx IS NOT NULL) AS valid, count(*) AS n
    FROM generated g LEFT JOIN near USING (response_id) GROUP BY ALL""",
    ("generated", "options"),
)
def _(t):
    catalog = t.catalog
    joined = t.generated.join(catalog.select("question_id", "options"), "question_id")
    return joined.groupBy(
        "question_id", expr.is_valid_option("loose_answer", "options").alias("valid")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b09_cohort_lists",
    """SELECT panelist_id FROM panelists WHERE age_group IN ('18-24', '65+')
    AND income_group IN ('low', 'middle', 'high')""",
    ("panelists",),
)
def _(t):
    keep = expr.cohort_lists(
        {"age_group": ["18-24", "65+"], "income_group": ["low", "middle", "high"], "region": []}
    )
    return t.panelists.filter(keep).select("panelist_id")


@query(
    "b10_cohort_equals",
    "SELECT panelist_id FROM panelists WHERE region = 'AFRICA' AND has_children",
    ("panelists",),
)
def _(t):
    keep = expr.cohort_equals(
        t.panelists, {"region": "AFRICA", "has_children": True, "unknown": ""}
    )
    return t.panelists.filter(keep).select("panelist_id")


@query(
    "b11_harmonize",
    f"WITH {_WAVE} SELECT qkey, age_group, atp_q1, atp_q2, atp_q3 FROM wave",
    ("responses",),
)
def _(t):
    wave = _pew(t).toDF("qkey", "weight", "f_agecat", "atp_q1", "atp_q2", "atp_q3")
    both = wave.withColumn("agea", F.col("f_agecat"))
    return landings.harmonize(both).drop("weight")


@query(
    "b12_persona_text",
    """SELECT panelist_id, 'A ' || age_group || ' year old ' || employment_status || ' person from a '
    || region || ' area, living in a household of ' || household_size || ' ' ||
    CASE WHEN has_children THEN 'with children' ELSE 'without children' END || '. Education: ' ||
    education_level || '. Income level: ' || income_group || '.' AS sentence,
    'You are a ' || age_group || ' year old person from the ' || region ||
    ' United States. Your household has ' || household_size || ' members' ||
    CASE WHEN has_children THEN ' including children under 18' ELSE '' END ||
    '. Your education level is ' || education_level || ' and your household income is ' ||
    income_group || '.' AS persona FROM panelists""",
    ("panelists",),
)
def _(t):
    return t.panelists.select(
        "panelist_id", expr.demographic_sentence().alias("sentence"),
        expr.profile_sentence().alias("persona"),
    )


@query(
    "b12_question_prompt",
    """WITH q AS (SELECT question_id, min(question_text) AS text, string_agg(DISTINCT '  ' || (answer_index + 1)
    || '. ' || answer, chr(10) ORDER BY '  ' || (answer_index + 1) || '. ' || answer) AS options
    FROM responses GROUP BY question_id),
    r AS (SELECT question_id, panelist_id, row_number() OVER (PARTITION BY panelist_id ORDER BY question_id) AS i,
    region, answer FROM responses),
    e AS (SELECT r.question_id, r.panelist_id, r.region, r.i, string_agg('  Q' || b.i || ': ' || b.question_id ||
    ' - ' || b.answer, chr(10) ORDER BY b.i) AS earlier FROM r LEFT JOIN r b ON b.panelist_id = r.panelist_id
    AND b.i < r.i GROUP BY ALL)
    SELECT question_id, panelist_id, 'Survey Question: ' || text || chr(10) || chr(10) || 'Response Options:' ||
    chr(10) || options || CASE WHEN region = 'ASIA' THEN '' ELSE chr(10) || chr(10) || 'Context: ' || region END ||
    coalesce(chr(10) || chr(10) || 'Your previous answers in this survey:' || chr(10) || earlier || chr(10) ||
    chr(10) || 'Ensure your answer is logically consistent with your previous responses.', '') AS prompt
    FROM e JOIN q USING (question_id)""",
    ("responses",),
)
def _(t):
    # Each answer's prompt as it would have been: the region as context (but for one region), and
    # the panelist's answers to the questions before.
    given = F.struct("question_id", "answer")
    before = F.filter(
        F.array_sort(F.collect_list(given).over(Window.partitionBy("panelist_id"))),
        lambda g: g["question_id"] < F.col("question_id"),
    )
    asked = t.responses.select("question_id", "panelist_id", "region", before.alias("before"))
    prompt = expr.question_prompt(
        "question_text", "options", F.when(F.col("region") != "ASIA", F.col("region")).otherwise(""),
        F.transform("before", lambda g: F.concat(g["question_id"], F.lit(" - "), g["answer"])),
    )
    return asked.join(t.catalog, "question_id").select("question_id", "panelist_id", prompt.alias("prompt"))


@query(
    "b13_size_bucket",
    """SELECT CASE WHEN n <= 50 THEN '1-50' WHEN n <= 100 THEN '51-100' WHEN n <= 500 THEN '101-500'
    ELSE '500+' END AS bucket, count(*) AS groups FROM (SELECT region, age_group, income_group,
    count(*) AS n FROM panelists GROUP BY ALL UNION ALL SELECT region, '', '', count(*) FROM panelists
    GROUP BY region UNION ALL SELECT '', '', '', count(*) FROM panelists) GROUP BY 1""",
    ("panelists",),
)
def _(t):
    groups = t.panelists.groupingSets(
        [["region", "age_group", "income_group"], ["region"], []], "region", "age_group", "income_group"
    ).agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy(expr.size_bucket("n").alias("bucket")).agg(
        F.count(F.lit(1)).alias("groups")
    )


@query(
    "b14_question_type",
    """WITH k AS (SELECT role, turn % 4 AS shape, CASE WHEN contains(l, 'how likely') OR contains(l, 'recommend')
    OR contains(l, 'nps') THEN 'net_promoter' WHEN contains(l, 'agree') OR contains(l, 'disagree') OR
    contains(l, 'important') OR contains(l, 'satisfied') THEN 'likert_5' WHEN contains(l, 'rank') OR
    contains(l, 'order') OR contains(l, 'prioritize') THEN 'ranking' ELSE 'single_choice' END AS guess
    FROM (SELECT lower(text) AS l, role, turn FROM conversations))
    SELECT CASE shape WHEN 1 THEN 'ranking' WHEN 2 THEN 'single_choice' ELSE guess END AS question_type, role,
    CASE shape WHEN 1 THEN 'taste' WHEN 2 THEN NULL ELSE 'general' END AS category, CAST(CASE WHEN shape = 1 THEN 3
    WHEN shape = 2 OR guess = 'ranking' THEN 0 WHEN guess = 'net_promoter' THEN 11 ELSE 5 END AS INTEGER) AS options,
    count(*) AS n FROM k GROUP BY ALL""",
)
def _(t):
    # Turns carry no spec, a whole one, one of an unknown type, or one that does not parse.
    shape = F.substring_index("id", "-", -1).cast("int") % 4
    given = (
        F.when(shape == 1, '```json\n{"question_type": "ranking", "options": ["a", "b", "c"], "category": "taste"}\n```')
        .when(shape == 2, '{"question_type": "riddle", "options": 7}')
        .when(shape == 3, '{"question_type": "ranking", ').otherwise("no json")
    )
    spec = expr.question_spec(given, "text")
    return t.turns.groupBy(
        spec["question_type"].alias("question_type"), "role", spec["category"].alias("category"),
        F.size(spec["options"]).alias("options"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b15_display_ids",
    """SELECT o_orderkey AS id, 'SRV-' || year(o_orderdate) || '-' || lpad(CAST(o_orderkey AS VARCHAR),
    CAST(greatest(5, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS survey_id, 'NIQ-' || CASE o_custkey % 3
    WHEN 0 THEN 'UNI' WHEN 1 THEN 'KO' ELSE 'GEN' END || '-' || year(o_orderdate) || '-Q' ||
    quarter(o_orderdate) || '-' || lpad(CAST(o_custkey AS VARCHAR),
    CAST(greatest(3, length(CAST(o_custkey AS VARCHAR))) AS INTEGER), '0') AS contract_id FROM orders""",
)
def _(t):
    client = F.element_at(
        F.array(F.lit("Unilever"), F.lit("Coca-Cola"), F.lit("Somebody")),
        (F.col("o_custkey") % 3 + 1).cast("int"),
    )
    return t.raw("orders").select(
        F.col("o_orderkey").alias("id"),
        expr.survey_id(F.year("o_orderdate"), "o_orderkey").alias("survey_id"),
        expr.contract_id(client, "o_orderdate", "o_custkey").alias("contract_id"),
    )


@query(
    "b16_over_budget",
    "SELECT token_count > 512 AS over_budget, count(*) AS n FROM generated GROUP BY 1",
    ("generated",),
)
def _(t):
    return t.generated.groupBy(expr.flag_over_budget("token_count").alias("over_budget")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "b17_humanize",
    """SELECT education_level AS raw, array_to_string(list_transform(string_split(education_level, '_'),
    lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label, count(*) AS n FROM panelists GROUP BY ALL""",
    ("panelists",),
)
def _(t):
    return t.panelists.groupBy(
        F.col("education_level").alias("raw"), expr.humanize("education_level").alias("label")
    ).agg(F.count(F.lit(1)).alias("n"))


# --- C: joins -------------------------------------------------------------


@query(
    "c01_attach_rfm",
    """SELECT p.panelist_id, coalesce(r.frequency, 0) AS frequency,
    coalesce(round(r.monetary, 2), 0) AS monetary, coalesce(r.recency_days, 999) AS recency_days
    FROM panelists p LEFT JOIN (SELECT panelist_id, count(transaction_date) AS frequency,
    sum(total_value) AS monetary, date_diff('day', max(transaction_date), DATE '2001-12-31')
    AS recency_days FROM purchases GROUP BY panelist_id) r USING (panelist_id)""",
    ("panelists", "purchases"),
)
def _(t):
    from panelloom.plans import jobs

    return jobs.attach_rfm(t.panelists, t.purchases, "2001-12-31").select(
        "panelist_id", "frequency", "monetary", "recency_days"
    )


@query(
    "c02_join_archetype",
    """SELECT behavioral_archetype, product_category, count(*) AS n FROM purchases
    JOIN panelists USING (panelist_id) GROUP BY ALL""",
    ("panelists", "purchases"),
)
def _(t):
    joined = t.purchases.select("panelist_id", "product_category").join(
        t.panelists.select("panelist_id", "behavioral_archetype"), "panelist_id"
    )
    return joined.groupBy("behavioral_archetype", "product_category").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "c03_semi_join",
    """SELECT response_id FROM responses WHERE panelist_id IN (SELECT panelist_id FROM panelists
    WHERE income_group = 'high')""",
    ("panelists", "responses"),
)
def _(t):
    cohort = t.panelists.filter(F.col("income_group") == "high").select("panelist_id")
    return t.responses.join(cohort, "panelist_id", "left_semi").select("response_id")


@query(
    "c04_anti_join",
    """SELECT panelist_id FROM panelists WHERE panelist_id NOT IN (SELECT panelist_id FROM responses
    WHERE question_id = 'q_P')""",
    ("panelists", "responses"),
)
def _(t):
    asked = t.responses.filter(F.col("question_id") == "q_P").select("panelist_id")
    return t.panelists.join(asked, "panelist_id", "left_anti").select("panelist_id")


_PAIRS = """pairs AS (SELECT a.panelist_id, a.answer_index AS index_a, b.answer_index AS index_b
  FROM responses a JOIN responses b ON a.panelist_id = b.panelist_id
  WHERE a.question_id = 'q_F' AND b.question_id = 'q_O')"""


@query("c05_pair_answers", f"WITH {_PAIRS} SELECT * FROM pairs", ("responses",))
def _(t):
    from panelloom.operators import joins

    return joins.pair_answers(t.responses, "q_F", "q_O")


@query(
    "c06_scaffold",
    """SELECT o.question_id, o.option_idx, o.option, count(r.response_id) AS n FROM options o
    LEFT JOIN (SELECT * FROM responses WHERE region = 'ASIA' AND answer_index < 3) r
    ON r.question_id = o.question_id AND r.answer = o.option GROUP BY ALL""",
    ("responses", "options"),
)
def _(t):
    catalog = t.catalog
    few = t.responses.filter((F.col("region") == "ASIA") & (F.col("answer_index") < 3))
    return dist.empirical_counts(few, catalog).withColumnRenamed("count", "n")


@query(
    "c07_join_reference",
    """SELECT r.g AS "group", r.reference_share, round(coalesce(p.n, 0) /
    (SELECT CAST(count(*) AS DOUBLE) FROM panelists), 6) AS panel_share FROM (SELECT 'low' AS g,
    CAST(0.25 AS DOUBLE) AS reference_share UNION ALL SELECT 'high', CAST(0.5 AS DOUBLE)
    UNION ALL SELECT 'none', CAST(0.25 AS DOUBLE)) r LEFT JOIN (SELECT income_group, count(*) AS n
    FROM panelists GROUP BY 1) p ON p.income_group = r.g""",
    ("panelists",),
)
def _(t):
    from panelloom.operators import joins

    reference = small_table(
        t.spark, [("low", 0.25), ("high", 0.5), ("none", 0.25)], ["group", "reference_share"]
    )
    return joins.join_reference(t.panelists, "income_group", reference).withColumn(
        "panel_share", F.round("panel_share", 6)
    )


@query(
    "c08_cross_frame",
    """SELECT panelist_id, question_id FROM panelists CROSS JOIN
    (SELECT DISTINCT question_id FROM responses)""",
    ("panelists", "responses"),
)
def _(t):
    catalog = t.catalog
    return sampling.cross_frame(t.panelists.select("panelist_id"), catalog)


_TARGET = """target AS (SELECT question_id, option_idx, option, (n + CAST(1e-12 AS DOUBLE)) /
  sum(n + CAST(1e-12 AS DOUBLE)) OVER (PARTITION BY question_id) AS mass FROM (SELECT o.question_id,
  o.option_idx, o.option, count(e.response_id) AS n FROM options o LEFT JOIN empirical e
  ON e.question_id = o.question_id AND e.answer = o.option GROUP BY ALL))"""
_SOURCE = f"""{_NEAR}, source AS (SELECT question_id, option_idx, option, (w + CAST(1e-6 AS DOUBLE)) /
  sum(w + CAST(1e-6 AS DOUBLE)) OVER (PARTITION BY question_id) AS mass FROM (SELECT o.question_id,
  o.option_idx, o.option, coalesce(sum(g.expansion_factor), 0) AS w FROM options o LEFT JOIN
  (SELECT * FROM generated JOIN near USING (response_id)) g ON g.question_id = o.question_id
  AND g.option_idx = o.option_idx GROUP BY ALL))"""
PAIR_CTES = f"{_SOURCE}, {_TARGET}"


def aligned(t):
    catalog = t.catalog
    return dist.align(
        dist.weighted_distribution(t.generated, catalog, "loose_answer"),
        dist.empirical_target(t.empirical, catalog),
    )


@query(
    "c09_align",
    f"""WITH {PAIR_CTES} SELECT s.question_id, s.option_idx, s.option, round(s.mass, 6) AS p,
    round(q.mass, 6) AS q FROM source s FULL JOIN target q ON s.question_id = q.question_id
    AND s.option_idx = q.option_idx""",
    ("generated", "empirical", "options"),
)
def _(t):
    return aligned(t).withColumn("p", F.round("p", 6)).withColumn("q", F.round("q", 6))


@query(
    "c10_attach_metrics",
    """SELECT o.question_id, m.first_flagged FROM (SELECT DISTINCT question_id FROM responses) o
    LEFT JOIN (SELECT question_id, min(seq) AS first_flagged FROM generated WHERE NOT is_valid
    AND question_id <> 'q_P' GROUP BY 1) m USING (question_id)""",
    ("responses", "generated"),
)
def _(t):
    from panelloom.operators import joins

    catalog = t.catalog.select("question_id")
    evidence = t.generated.filter(~F.col("is_valid") & (F.col("question_id") != "q_P")).select(
        "question_id", F.col("seq").alias("first_flagged")
    )
    return joins.attach_first(catalog, evidence, ["question_id"], ["first_flagged"])

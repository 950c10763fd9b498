"""Entities, scales and column contracts."""

from __future__ import annotations


PANELISTS = (
    "panelist_id STRING, age_group STRING, income_group STRING, region STRING, "
    "household_size STRING, education_level STRING, employment_status STRING, "
    "has_children BOOLEAN, behavioral_archetype STRING, expansion_factor DOUBLE, "
    "panel_join_date DATE, age INT"
)
PURCHASES = (
    "panelist_id STRING, transaction_date DATE, product_category STRING, brand STRING, "
    "quantity INT, unit_price DOUBLE, total_value DOUBLE, store_type STRING, is_promotion BOOLEAN"
)
SURVEY_RESPONSES = (
    "response_id STRING, panelist_id STRING, question_id STRING, question_text STRING, "
    "question_type STRING, answer STRING, answer_index INT, behavioral_archetype STRING, "
    "response_date DATE"
)
PRODUCTS = "product_id STRING, category_id STRING, brand STRING, description STRING"
DATASETS = {
    "panelists": PANELISTS,
    "purchases": PURCHASES,
    "survey_responses": SURVEY_RESPONSES,
    "products": PRODUCTS,
}

# Ordered scales and their levels.
AGE_GROUPS = ["18-24", "25-34", "35-44", "45-54", "55-64", "65+"]
INCOME_GROUPS = ["low", "lower_middle", "middle", "upper_middle", "high"]
HOUSEHOLD_SIZES = ["1", "2", "3-4", "5+"]
EDUCATION_LEVELS = ["high_school", "some_college", "bachelors", "masters", "doctorate"]
EMPLOYMENT = ["employed", "unemployed", "retired", "student"]
PRICE_TIERS = ["budget", "value", "mid", "premium", "luxury"]
REGIONS = [
    "northeast", "mid_atlantic", "southeast", "south", "midwest", "mountain",
    "west", "pacific", "urban", "suburban", "rural",
]
QUESTION_TYPES = [
    "likert_5", "likert_7", "multiple_choice", "single_choice", "ranking",
    "open_ended", "net_promoter",
]
SCALES = {
    "age_group": AGE_GROUPS,
    "income_group": INCOME_GROUPS,
    "household_size": HOUSEHOLD_SIZES,
    "education_level": EDUCATION_LEVELS,
    "region": [],
}
BREAKDOWN_DIMENSIONS = ["age_group", "income_group", "region", "behavioral_archetype"]
ARCHETYPES = {
    0: "Price Sensitive",
    1: "Premium Loyalist",
    2: "Category Explorer",
    3: "Promotion Driven",
    4: "Convenience Oriented",
}
BENCHMARK_COLUMNS = [
    "source", "version", "question_id", "demographic_group", "option", "share", "sample_size",
]
# Column names that describe where benchmark rows come from, never questions.
LINEAGE_COLUMNS = [
    "source", "version", "ingested_at", "wave_id", "round_id", "release", "dataset_ref",
]
BENCHMARK_KEYS = ["age_group", "income_group", "qkey", "weight", "idno", "cntry", "persona_id"]
